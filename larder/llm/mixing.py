"""Mixing sources to target weights by Pfair scheduling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.common import ranked
from larder.session import stored

BLOCK_ROWS = 16
#: Slots of a frame: target weights are met to half a slot of it.
FRAME = 1 << 16
#: Sources that are scheduled by themselves; the others are scheduled as one, and among them by exact weights.
STRATA = 128
#: Slots whose picks are put together at once, and rows of a range in which a source's or the pool's rows are numbered.
RUN = 256
RANGE_ROWS = 1 << 16
TEMPER = 0.5
SEED = 811
ADDED = ("mix_block", "mix_release", "mix_deadline", "mix_slot", "mix_order")


def target_slots(keyed: DataFrame, weights: dict[str, float] | None, temper: float, frame: int, strata: int) -> DataFrame:
    """(stratum, slots, frame): how many blocks of a frame each source gets.

    Without ``weights`` a source's weight is its row count to the power
    ``temper``.  At most ``strata`` sources are told apart (the largest); the
    others are scheduled together as stratum null, with the sum of their
    weights, as are sources that ``weights`` doesn't name (with the weight
    under key ``""``, or the least).  Each stratum gets one slot at least.
    """
    sizes = keyed.groupBy("_source").agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        named = sizes.orderBy(F.desc("n"), "_source").limit(strata).select("_source", F.col("_source").alias("stratum"))
        of = sizes.join(F.broadcast(named), "_source", "left")
        weighed = of.groupBy("stratum").agg(F.sum(F.pow("n", F.lit(temper))).alias("w"))
    else:
        rows = [("=" + k, float(w)) for k, w in weights.items() if k] + [(None, float(weights.get("", min(weights.values()))))]
        weighed = keyed.sparkSession.createDataFrame(rows, "stratum string, w double")
    # A window over all rows: one for each stratum, strata + 1 at most.
    share = F.col("w") / F.sum("w").over(Window.partitionBy())
    return weighed.select("stratum", F.greatest(F.lit(1), F.round(share * frame).cast("int")).alias("slots"))


def frame_schedule(slots: DataFrame) -> DataFrame:
    """(stratum, slots, k, at, frame): at which slot of the frame a stratum's block k is served.

    Earliest deadline first: block k of a stratum with ``a`` of ``D`` slots is
    released at floor(k D / a) and due at ceil((k + 1) D / a).  As the slots add
    up to D, every deadline is met, and the blocks served by any time differ
    from the stratum's share of that time by less than one.
    """
    row = slots.agg(F.array_sort(F.collect_list(F.struct("stratum", "slots"))).alias("strata"))
    row = row.select("strata", F.expr("transform(strata, s -> s.slots)").alias("a"))
    row = row.withColumn("frame", F.expr("aggregate(a, 0, (x, y) -> x + y)")).where("frame > 0")
    due = """array_min(filter(
        transform(a, (n, i) -> named_struct(
            'due', ((s.done[i] + 1L) * frame + n - 1) div n, 'from', (1L * s.done[i] * frame) div n, 'i', i, 'left', n - s.done[i])),
        x -> x.from <= t AND x.left > 0)).i"""
    # Run by run, so that what has been picked is not copied for every slot.
    run = f"""aggregate(sequence(r * {RUN}, least(frame, (r + 1) * {RUN}) - 1),
        named_struct('done', s.done, 'picks', cast(array() AS array<int>)),
        (s, t) -> aggregate(array({due}), s, (u, p) -> named_struct(
            'done', transform(u.done, (c, i) -> c + if(i = p, 1, 0)), 'picks', u.picks || array(p))))"""
    picks = F.expr(f"""flatten(aggregate(sequence(0, (frame - 1) div {RUN}),
        named_struct('done', transform(a, x -> 0), 'runs', cast(array() AS array<array<int>>)),
        (s, r) -> aggregate(array({run}), s, (v, u) -> named_struct('done', u.done, 'runs', v.runs || array(u.picks))),
        s -> s.runs))""")
    served = row.select("strata", "frame", F.posexplode(picks).alias("at", "p")).select(
        F.col("strata")[F.col("p")].alias("s"), "frame", "at", "p"
    )
    seen = served.groupBy("s", "frame").agg(F.array_sort(F.collect_list("at")).alias("times"))
    return seen.select("s.stratum", "s.slots", "frame", F.posexplode("times").alias("k", "at"))


def scheduled(
    docs: DataFrame,
    source: str = "source",
    weights: dict[str, float] | None = None,
    temper: float = TEMPER,
    block_rows: int = BLOCK_ROWS,
    frame: int = FRAME,
    strata: int = STRATA,
    seed: int = SEED,
) -> DataFrame:
    """``docs`` with ``mix_block``, ``mix_release``, ``mix_deadline``, ``mix_slot`` and ``mix_order``.

    A source's rows, in seeded order, make blocks of ``block_rows``; the frame's
    schedule repeats, so a block's slot follows from its number.  Rows sorted by
    ``mix_order`` are the mixture.  No row is dropped or repeated: once a source
    has no blocks left, its slots stay empty and the others go on in the
    proportion of their weights.

    Weights are met to half a slot of each frame.  The sources beyond the
    ``strata`` largest share the slots of one stratum: there each row has its
    source's virtual time, (block + the source's phase) / weight, and they come in that order.
    Release and deadline of such a row are its stratum's.

    Null sources are a source of their own.  Rows of equal hash are in the
    order of their ids; repeated rows each have a place; an empty table has no
    rows.  Columns of ``docs`` with one of the five names are replaced.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("<null>"))
    own = [F.col(f"`{c}`") for c in docs.columns if c not in ADDED]
    # The columns travel as one, so that none can clash with those used here.
    keyed = docs.select(F.struct(*own).alias("_doc"), "doc_id", key.alias("_source"), F.xxhash64(F.lit(seed), "doc_id").alias("_hash"))
    slots = target_slots(keyed, weights, temper, frame, strata)
    # At most strata + 1 rows and, below, one row for each slot of the frame.
    slots = stored(slots, "slots")
    plan = frame_schedule(slots).select(F.coalesce("stratum", F.lit("")).alias("_stratum"), "slots", "frame", "k", "at")
    plan = stored(plan, "frame")
    known = F.broadcast(slots.where("stratum IS NOT NULL").select(F.col("stratum").alias("_source"), F.col("stratum").alias("_own")))
    counts = stored(keyed.groupBy("_source").agg(F.count(F.lit(1)).alias("_rows")).join(known, "_source", "left"), "sources")
    # As many ranges as the largest source needs, a power of two.
    most = counts.agg(F.max("_rows")).first()[0] or 0
    bits = max(10, (most // RANGE_ROWS).bit_length())
    keyed = keyed.join(known, "_source", "left").withColumns(
        {"_stratum": F.coalesce("_own", F.lit("")), "_range": F.shiftrightunsigned("_hash", 64 - bits)}
    )
    rows = ranked(keyed, ["_source"], "_range", ["_hash", "doc_id"], "_rank").drop("_own", "_range")
    if not counts.where("_own IS NULL").isEmpty():
        rows = rows.where("_stratum <> ''").unionByName(_pooled(rows.where("_stratum = ''"), counts.where("_own IS NULL"), temper, block_rows, seed))
    sizes = F.broadcast(plan.where("k = 0").select("_stratum", "slots", "frame"))
    rows = rows.join(sizes, "_stratum")
    rows = rows.withColumn("mix_block", F.expr(f"_rank div {block_rows}L")).withColumn("k", F.expr("int(mix_block % slots)"))
    rows = rows.join(F.broadcast(plan.select("_stratum", "k", "at")), ["_stratum", "k"])
    slot = F.expr("(mix_block div slots) * frame + at")
    return rows.select(
        "_doc.*",
        "mix_block",
        F.expr("(mix_block * frame) div slots").alias("mix_release"),
        F.expr("((mix_block + 1) * frame + slots - 1) div slots").alias("mix_deadline"),
        slot.alias("mix_slot"),
        (slot * block_rows + F.col("_rank") % block_rows).alias("mix_order"),
    )


def _pooled(rows: DataFrame, counts: DataFrame, temper: float, block_rows: int, seed: int) -> DataFrame:
    """The rows of the sources that share a stratum, numbered through by their sources' virtual times.

    Time runs in slots of the pool.  A stretch of it holds as many rows as it
    has slots for, and a block more of each source, so none is large.
    """
    weight = F.pow("_rows", F.lit(temper))
    total = counts.agg(F.sum(weight)).first()[0]
    # Sources start at times of their own, or all of equal weight would come in turns.
    phase = (F.pmod(F.xxhash64(F.lit(seed), "_source"), F.lit(1 << 20)) + 0.5) / (1 << 20)
    shares = counts.select("_source", (weight / F.lit(total)).alias("_w"), phase.alias("_phase"))
    timed = rows.join(shares, "_source").withColumn("_time", (F.expr(f"_rank div {block_rows}L") + F.col("_phase")) / F.col("_w"))
    timed = timed.withColumnRenamed("_rank", "_inside").withColumn("_range", F.floor(F.col("_time") / (RANGE_ROWS // block_rows)))
    order = ["_time", "_source", "_inside", "_hash", "doc_id"]
    return ranked(timed, ["_stratum"], "_range", order, "_rank").drop("_w", "_phase", "_time", "_inside", "_range")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` in the order of the mixture."""
    placed = scheduled(docs.select(F.struct("*").alias("doc"), "doc_id", "source"), **options)
    return placed.repartitionByRange("mix_order").sortWithinPartitions("mix_order").select("doc.*")


def ordered(docs: DataFrame, **options) -> DataFrame:
    """`mixed` with the place of each row in the mixture as column ``mix_order``."""
    placed = scheduled(docs.select(F.struct("*").alias("doc"), "doc_id", "source"), **options)
    own = [F.col(f"doc.`{c}`") for c in docs.columns if c != "mix_order"]
    return placed.repartitionByRange("mix_order").sortWithinPartitions("mix_order").select(*own, "mix_order")
