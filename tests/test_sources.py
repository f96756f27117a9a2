"""Bucketed keys, tiered logs, quarantined lines, footers and named appends."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from larder import operators as op
from larder.operators.keyed import last_per_key
from larder.operators.ledger import MOVEMENT, net_movements
from larder.sources import KeyTable, TieredLog, append, largest_key, load_quarantined, reject_counts


@pytest.fixture
def large(conf):
    """Nothing is small enough to broadcast."""
    conf(autoBroadcastJoinThreshold="-1", adaptive__autoBroadcastJoinThreshold="-1")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


# --- keys in buckets ---------------------------------------------------------


@pytest.fixture
def key_table(spark, tmp_path):
    """Keys 0 to 4,999, with repeats and missing ones, in 16 buckets."""
    rows = spark.range(5000).select(F.col("id").alias("k"))
    missing = spark.createDataFrame([(None,), (7,)], "k long")
    return KeyTable(spark, str(tmp_path / "keys"), "k", buckets=16).add(rows.unionByName(missing)).add(rows.where("k < 10"))


def batch(spark, keys):
    return spark.createDataFrame(list(enumerate(keys)), "seq long, k long")


def test_stored_keys_are_not_shuffled(spark, key_table, large):
    new = spark.range(4000, 40_000).select(F.col("id").alias("seq"), F.col("id").alias("k"))
    verdict = op.append_to_key_table(key_table, new)
    assert verdict.accepted.count() == 35_000
    stored = next(part for part in re.split(r"\n(?= *[:+]- )", plan(verdict.decided)) if "Bucketed: true" in part)
    lines = plan(verdict.decided).split("\n")
    at = next(i for i, line in enumerate(lines) if "Bucketed: true" in line)
    depth = len(lines[at]) - len(lines[at].lstrip(" :+-"))
    above = []
    for line in reversed(lines[:at]):
        own = len(line) - len(line.lstrip(" :+-"))
        if own < depth:
            above.append(line)
            depth = own
        if "Join" in line and own <= depth:
            break
    assert stored and above and "Join" in above[-1]
    assert not any("Exchange" in line for line in above)


def test_a_small_batch_reads_its_buckets_only(spark, key_table, large):
    verdict = op.append_to_key_table(key_table, batch(spark, [3, None, 6000, 6000]))
    assert {r.seq: r.reason for r in verdict.decided.collect()} == {0: "duplicate key", 1: "missing key", 2: None, 3: "duplicate key"}
    chosen = re.search(r"SelectedBucketsCount: (\d+) out of 16", verdict.decided._jdf.queryExecution().toString())
    explained = spark._jvm.PythonSQLUtils.explainString(verdict.decided._jdf.queryExecution(), "formatted")
    chosen = chosen or re.search(r"SelectedBucketsCount: (\d+) out of 16", explained)
    assert int(chosen[1]) <= 2


def test_bucketed_and_plain_appends_agree(spark, key_table):
    rng = random.Random(2)
    new = batch(spark, [rng.choice([None, rng.randrange(9000), 5500]) for _ in range(300)])
    plain = op.append_keyed(spark.range(5000).select(F.col("id").alias("k")), new, "k")
    found = op.append_to_key_table(key_table, new)
    assert sorted(map(str, found.decided.select("seq", "reason").collect())) == sorted(map(str, plain.decided.select("seq", "reason").collect()))
    key_table.add(found.accepted)
    again = op.append_to_key_table(key_table, new)
    assert again.accepted.count() == 0


def test_an_empty_batch_and_another_session(spark, key_table):
    assert op.append_to_key_table(key_table, batch(spark, [])).decided.count() == 0
    spark.sql(f"DROP TABLE {key_table.name}")
    same = KeyTable(spark, key_table.path, "k", buckets=16)
    assert op.append_to_key_table(same, batch(spark, [4999, 5000])).accepted.collect()[0].k == 5000


# --- tiered logs -------------------------------------------------------------


def test_64_batches_are_read_from_few_folders(spark, tmp_path):
    moves = TieredLog(spark, str(tmp_path / "moves"), MOVEMENT, net_movements)
    assert moves.read().count() == 0
    most = 0
    for n in range(64):
        moves.write(spark.createDataFrame([(n % 3, n, False), (9, -1, None)], "IngredientID long, delta int, unknown boolean"), n)
        cover = moves.cover()
        assert [b for a, z in cover for b in range(a, z + 1)] == list(range(n + 1))
        assert len(cover) == bin(n + 1).count("1")
        most = max(most, len(cover))
    assert most <= 7 and moves.cover() == [(0, 63)]
    total = {r.IngredientID: r.d for r in moves.read().groupBy("IngredientID").agg(F.sum("delta").alias("d")).collect()}
    assert total == {k: sum(n for n in range(64) if n % 3 == k) for k in range(3)} | {9: -64}
    # What shorter runs held has been removed, but for what a replay of the last batch needs.
    assert len(moves.spans()) <= 14


def test_a_replayed_batch_is_folded_once(spark, tmp_path):
    newest = TieredLog(spark, str(tmp_path / "rows"), spark.createDataFrame([], "k long, v long").schema, lambda rows: last_per_key(rows, "k", "batch"))
    rows = {n: [(n % 2, n), (5 + n % 3, -n)] for n in range(12)}

    def put(n, values):
        newest.write(spark.createDataFrame(values, "k long, v long"), n)

    def state(before=None):
        return {r.k: r.v for r in last_per_key(newest.read(before), "k", "batch").collect()}

    for n in range(12):
        put(n, [(0, 999), (77, 1)])  # a first try whose rows must not stay
        put(n, rows[n])
        want = {k: v for m in range(n + 1) for k, v in rows[m]}
        assert state() == want
        assert state(before=n) == {k: v for m in range(n) for k, v in rows[m]}
    with pytest.raises(ValueError, match="another run"):
        put(0, rows[0])


def test_a_run_that_was_not_finished_is_not_read(spark, tmp_path):
    moves = TieredLog(spark, str(tmp_path / "moves"), MOVEMENT, net_movements)
    for n in range(4):
        moves.write(spark.createDataFrame([(1, 1, False)], "IngredientID long, delta int, unknown boolean"), n)
    (tmp_path / "moves" / "from=0,to=3" / "_SUCCESS").unlink()
    assert moves.cover() == [(0, 1), (2, 2), (3, 3)]
    assert moves.read().count() == 3


# --- lines that do not fit ---------------------------------------------------

HEADER = "PO_ID,SupplierID,Order_date,Exp_deleivey_date,Total_Amount,Status"


def test_quarantined_csv(spark, tmp_path):
    lines = [HEADER, "1,7,2026-01-30,2026-02-01,5,Pending", "x,7,2026-01-30,2026-02-01,5,Pending", "2,7,soon,2026-02-01,5,Pending", "3,7,2026-01-30",
             "4,7,2026-01-30,2026-02-01,5,Pending,more", "", '5,,2026-01-30,,,"a, b"', "6,7,2026-01-30,2026-02-01,5.5,Pending"]
    (tmp_path / "po.csv").write_text("\n".join(lines))
    good, rejected = load_quarantined(spark, str(tmp_path / "po.csv"), "Purchase_Order")
    assert [(r.PO_ID, r.SupplierID, str(r.Order_date), r.Status) for r in good.orderBy("PO_ID").collect()] == [
        (1, 7, "2026-01-30", "Pending"), (5, None, "2026-01-30", "a, b"),
    ]
    assert {r.raw: r.reason for r in rejected.collect()} == {
        lines[2]: "PO_ID is no INT: x",
        lines[3]: "Order_date is no DATE: soon",
        lines[4]: "line cannot be read",
        lines[5]: "line cannot be read",
        lines[8]: "Total_Amount is no INT: 5.5",
    }
    counts = {(r.column, r.rule): r.n for r in reject_counts(rejected).collect()}
    assert counts == {("PO_ID", "INT"): 1, ("Order_date", "DATE"): 1, ("Total_Amount", "INT"): 1, (None, None): 2}
    assert good.count() == 2 and rejected.count() == 5


def test_quarantined_columns_in_another_order(spark, tmp_path):
    (tmp_path / "po.csv").write_text("Status,PO_ID,SupplierID,Order_date,Exp_deleivey_date,Total_Amount\nPending,1,2,2026-01-01,2026-01-02,3\n")
    good, rejected = load_quarantined(spark, str(tmp_path / "po.csv"), "Purchase_Order")
    assert good.first().PO_ID == 1 and good.columns[0] == "PO_ID" and rejected.count() == 0
    (tmp_path / "other.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="other columns"):
        load_quarantined(spark, str(tmp_path / "other.csv"), "Purchase_Order")


def test_quarantined_json(spark, tmp_path):
    lines = ['{"PO_ID": 1, "SupplierID": 7, "Order_date": "2026-01-30", "Total_Amount": 5, "Status": "Pending"}', '{"PO_ID": "x", "SupplierID": 7}', "{not json"]
    (tmp_path / "po.json").write_text("\n".join(lines))
    good, rejected = load_quarantined(spark, str(tmp_path / "po.json"), "Purchase_Order", "json")
    assert [r.PO_ID for r in good.collect()] == [1]
    assert {r.raw: r.reason for r in rejected.collect()} == {lines[1]: "PO_ID is no INT: x", lines[2]: "line cannot be read"}


# --- footers and named runs --------------------------------------------------


@pytest.mark.parametrize("fmt", ["parquet", "orc", "json"])
def test_the_largest_key(spark, tmp_path, fmt):
    path = str(tmp_path / fmt)
    rows = spark.range(1000).select(F.when(F.col("id") != 5, F.col("id")).alias("k"), F.lit("x").alias("v"))
    rows.repartition(3).write.format(fmt).save(path)
    found = largest_key(spark, path, "k", fmt)
    assert found.first().largest == 999
    explained = spark._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
    assert ("PushedAggregation: [MAX(k)]" in explained) == (fmt != "json")
    assert spark.conf.get("spark.sql.sources.useV1SourceList") != ""
    append(rows.limit(0), str(tmp_path / "none"), fmt="parquet")
    assert largest_key(spark, str(tmp_path / "none"), "k").first().largest is None


def test_a_repeated_run_adds_its_rows_once(spark, tmp_path):
    path = str(tmp_path / "rows")

    def put(values, run):
        append(spark.createDataFrame([(v,) for v in values], "v long"), path, batch=run)
        return sorted(r.v for r in spark.read.parquet(path).collect())

    assert put([1, 2], "monday") == [1, 2]
    assert put([3], "tuesday") == [1, 2, 3]
    assert put([1, 2], "monday") == [1, 2, 3]
    assert put([1], "monday") == [1, 3]
