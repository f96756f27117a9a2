"""License scans: a positional index of rare licence words, aligned with templates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.common import text_or_empty
from larder.session import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: An alignment counts from this share of its template's IDF weight.
LEAST_SHARE = 0.5

#: Phrases that are counted at all places: label, words.
BASE = [("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")]

#: Notices: label, words, with the mandatory ones in capitals and words too
#: common to be indexed as a dot.
NOTICES = [
    ("mit", "released under . MIT LICENSE"),
    ("mit", "PERMISSION . HEREBY GRANTED FREE . CHARGE . . person obtaining . copy . . software"),
    ("apache", "licensed under . APACHE LICENSE version 2 0"),
    ("gpl", "licensed under . gnu GENERAL PUBLIC LICENSE version 3"),
    ("gpl", ". program . free software . . redistribute . . . modify . under . terms . . gnu GENERAL PUBLIC LICENSE"),
    ("cc-by-nc", "licensed under CC . NC 4 0"),
    ("cc-by", "licensed under . CREATIVE COMMONS ATTRIBUTION license"),
    ("bsd", "REDISTRIBUTION . use . SOURCE . BINARY FORMS . . without modification . permitted"),
    ("mpl", "subject . . terms . . MOZILLA PUBLIC LICENSE v 2 0"),
    ("public-domain", "free . unencumbered software RELEASED INTO . PUBLIC DOMAIN"),
]


def templates() -> list[tuple[int, str, bool, int, str, bool]]:
    """(template, label, base, place, word, mandatory) for each indexed word."""
    rows = []
    for at, (label, words, base) in enumerate([(*b, True) for b in BASE] + [(*n, False) for n in NOTICES]):
        for place, word in enumerate(words.split()):
            if word != ".":
                rows.append((at, label, base, place, word.lower(), base or word.isupper() and word.isalpha()))
    return rows


VOCABULARY = sorted({row[4] for row in templates()})


def postings(docs: DataFrame) -> DataFrame:
    """(row, doc_id, n_words, found): where each licence word stands in each text."""
    words = F.regexp_extract_all(F.translate(text_or_empty(), UPPER, LOWER), F.lit(WORD), F.lit(0))
    numbered = F.transform("words", lambda w, i: F.struct(i.cast("long").alias("at"), w.alias("word")))
    return docs.select("doc_id", words.alias("words")).select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.filter(numbered, lambda x: x["word"].isin(VOCABULARY)).alias("found"),
    )


def weighted_templates(index: DataFrame) -> DataFrame:
    """The template words with their IDF over all texts, and each template's rarest mandatory word."""
    spark = index.sparkSession
    texts = index.count()
    held = index.select(F.explode(F.array_distinct(F.transform("found", lambda x: x["word"]))).alias("word"))
    held = held.groupBy("word").agg(F.count(F.lit(1)).alias("held"))
    fixed = spark.createDataFrame(templates(), "template int, label string, base boolean, place int, word string, mandatory boolean")
    idf = F.log(F.lit(texts + 1) / (F.coalesce("held", F.lit(0)) + 1)) + 1
    weighed = fixed.join(held, "word", "left").withColumn("idf", idf).drop("held")
    of = Window.partitionBy("template")
    rarest = F.max(F.when(F.col("mandatory"), F.struct("idf", F.col("word").alias("anchor")))).over(of)
    return weighed.select(
        "template", "label", "base", "place", "word", "mandatory", "idf",
        F.sum("idf").over(of).alias("whole"),
        F.sum(F.col("mandatory").cast("int")).over(of).alias("n_mandatory"),
        rarest["anchor"].alias("anchor"),
    )


def license_scan(docs: DataFrame) -> DataFrame:
    """Licence phrases and labels of each text.

    One scan of the texts leaves the places of the licence words.  A template
    is looked up in the files that hold its mandatory word of the highest IDF:
    the places of its words vote for where it would start, a start counts if
    all mandatory words stand there and the words found make up half of the
    template's IDF weight.  The base phrases are templates whose words are all
    mandatory, so all their places are found.

    A null text is empty: no words, no labels, score 0.  Repeated rows and
    null ids each have their own result; other columns are ignored.
    """
    index = stored(postings(docs), "postings")
    # The templates are fixed rows, so the broadcast doesn't grow.
    wanted = F.broadcast(weighted_templates(index))
    places = (
        index.where(F.size("found") > 0)
        .select("row", F.transform("found", lambda x: x["word"]).alias("held"), F.explode("found").alias("f"))
        .join(wanted, F.col("f.word") == F.col("word"))
        .where(F.array_contains("held", F.col("anchor")))
    )
    start = (F.col("f.at") - F.col("place")).alias("start")
    aligned = (
        places.groupBy("row", "template", "label", "base", "whole", "n_mandatory", start)
        .agg(F.sum("idf").alias("weight"), F.sum(F.col("mandatory").cast("int")).alias("n"))
        .where("n = n_mandatory")
        .withColumn("share", F.least(F.lit(1.0), F.col("weight") / F.col("whole")))
        .where(F.col("share") >= LEAST_SHARE)
    )
    base = F.col("base")
    labels = aligned.groupBy("row").agg(
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("start"))).alias("first_word"),
        F.max(F.when(base, F.col("start"))).alias("last_word"),
        F.collect_set(F.when(base, F.col("label"))).alias("base_labels"),
        F.collect_set("label").alias("labels"),
        F.max("share").alias("score"),
    )
    joined = {c: F.coalesce(F.array_join(F.array_sort(c), ","), F.lit("")) for c in ("base_labels", "labels")}
    return (
        index.select("row", "doc_id", "n_words")
        .join(labels, "row", "left")
        .select(
            "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"), "first_word", "last_word",
            *[joined[c].alias(c) for c in joined], F.round(F.coalesce("score", F.lit(0.0)), 6).alias("score"),
        )
    )
