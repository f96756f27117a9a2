"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns, for every operator."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from larder.llm.covertree import embedding_groups
from larder.llm.forest import forest_neighbours
from larder.llm.licenses import license_scan
from larder.llm.mixing import mixed, scheduled
from larder.llm.packing import packed
from larder.llm.quality import quality_scores, selected
from larder.llm.secrets import redacted, secret_scan
from larder.llm.sharding import interleaved_shards
from larder.llm.simhash import deduplicated, simhash_groups
from larder.llm.toxicity import toxicity_scores

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "mit license " + "one two three. " * 30_000
ROWS = [
    (1, "Released under the MIT License.", "en", "a", 31),
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (4, " \t\n ", "en", "b", 4),
    (5, "token = 'abcdef123'", "en", "b", 19),
    (5, "token = 'abcdef123'", "en", "b", 19),
    (None, "no id", "en", "a", 5),
    (None, None, None, None, None),
    (6, LONG, "en", "c", len(LONG)),
    (7, "word " * 9 + "é İ ſ K 𝛼", "de", "c", 54),
]
CLASHES = ["_fp", "fp", "row", "_row", "doc", "_rank", "_hash", "_range", "_n", "k", "at", "slots", "frame", "rank", "_doc", "_stratum", "mix_block", "words", "found", "size", "score", "text_crc32", "_source", "length", "h", "x", "t"]


@pytest.fixture(scope="module")
def docs(spark):
    plain = spark.createDataFrame(ROWS, DOCS)
    return plain.withColumns({c: F.lit("clash") for c in CLASHES})


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, int(i % 5 > 0), int(i % 4 == 1)) for i in range(1, 8)] + [(None, 1, 1), (2, None, 0), (3, 1, None), (1, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash"))


OPERATORS = {
    "licenses": lambda d, _: license_scan(d),
    "secrets": lambda d, _: secret_scan(d),
    "redacted": lambda d, _: redacted(d),
    "quality": quality_scores,
    "shards": lambda d, _: interleaved_shards(d),
    "packing": lambda d, _: packed(d),
    "simhash": lambda d, _: simhash_groups(d),
    "scheduled": lambda d, _: scheduled(d),
    "mixed": lambda d, _: mixed(d),
    "toxicity": toxicity_scores,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_every_row_has_a_result(docs, labels, name):
    out = OPERATORS[name](docs, labels).collect()
    if name == "packing":
        out = [r for r in out if r.piece == 0]
    assert sorted(str(r.doc_id) for r in out) == sorted(str(r[0]) for r in ROWS)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(docs, labels, name):
    assert OPERATORS[name](docs.limit(0), labels).count() == 0
    assert OPERATORS[name](docs.limit(0), labels.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["quality", "toxicity"])
def test_no_labels(docs, labels, name):
    assert OPERATORS[name](docs, labels.limit(0)).count() == len(ROWS)


def test_filters_keep_columns_and_rows(docs, labels):
    kept = deduplicated(docs)
    assert kept.columns == docs.columns
    # The repeated row goes, and texts without words are one group.
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "5", "6", "7", "None"]
    assert {r._fp for r in kept.collect()} == {"clash"}
    assert selected(docs, labels).columns == docs.columns
    assert mixed(docs).columns == docs.columns
    assert deduplicated(docs.limit(0)).count() == 0


def test_defined_values(docs, labels):
    found = {r.doc_id: r for r in license_scan(docs).collect()}
    assert (found[1].n_words, found[1].n_base, found[1].first_word, found[1].labels) == (5, 1, 3, "mit")
    assert (found[2].n_words, found[2].n_base, found[2].first_word, found[2].labels) == (0, 0, None, "")
    assert (found[6].n_words, found[6].n_base) == (90_002, 1)
    assert found[7].n_words == 14
    hidden = {r.doc_id: r for r in redacted(docs).collect()}
    assert hidden[5].text == "[SECRET]'"
    assert hidden[5].n_chars == 9
    assert hidden[2].text is None
    groups = {r.doc_id: r for r in simhash_groups(docs).collect() if r.doc_id}
    assert groups[2].fingerprint == groups[4].fingerprint == "0" * 16
    assert groups[3].component_id == groups[4].component_id == 2
    toxic = {r.doc_id: r for r in toxicity_scores(docs, labels).collect()}
    assert all(0 <= r.score <= 1 for r in toxic.values())


VECTORS = [
    (0, [1.0, 0.0]), (100, [0.0, 2.0]), (1, [2.0, 0.0]), (2, [1.0, 0.0]), (2, [0.9, 0.1]), (3, None), (4, [0.0, 0.0]),
    (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [1.0, None]), (8, []), (9, [1.0, 2.0, 3.0]), (None, [1.0, 0.0]), (None, None),
]


@pytest.fixture(scope="module")
def vectors(spark):
    rows = spark.createDataFrame(VECTORS, "vec_id long, embedding array<float>")
    return rows.withColumns({c: F.lit("clash") for c in ("node", "row", "vector", "n", "copies", "leaf", "part", "rank", "label")})


def test_vectors_that_cannot_be_compared(vectors):
    out = embedding_groups(vectors).collect()
    assert sorted(str(r.vec_id) for r in out) == sorted(str(v[0]) for v in VECTORS)
    by_id = {r.vec_id: r for r in out if r.vec_id not in (2, None)}
    assert (by_id[0].n_links, by_id[0].component_id, by_id[0].kept) == (3, 0, True)
    assert (by_id[1].component_id, by_id[1].kept) == (0, False)
    assert all((by_id[i].n_links, by_id[i].component_id, by_id[i].kept) == (0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 100))
    assert not any(r.kept for r in out if r.vec_id is None)
    near = forest_neighbours(vectors).collect()
    assert [(r["rank"], r.vec_id) for r in near if r.query_id == 0] == [(1, 2), (2, 1), (3, 100)]
    assert [r["score"] for r in near if r.query_id == 0][:2] == [0.0, 1.0]


def test_no_vectors(vectors):
    assert embedding_groups(vectors.limit(0)).count() == 0
    assert forest_neighbours(vectors.limit(0)).count() == 0
    assert embedding_groups(vectors.where("vec_id = 4")).count() == 1


def test_pipeline(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    total = out.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert total.where("n <> end OR n > 2048").isEmpty()
    assert 3 <= len(corpus_pipeline.STAGES) <= 5
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert out.join(docs, "doc_id", "left_anti").isEmpty()
    assert out.select("doc_id", "piece").distinct().count() == out.count()
