"""Stored results and their removal."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from larder.session import noted, remove, scratch, stored


def there(df) -> bool:
    return os.path.exists(df.stored_at.removeprefix("file:"))


def test_scratch_removes_what_is_not_kept(spark):
    outside = stored(spark.range(2), "outside")
    with scratch(spark) as keep:
        gone, held = stored(spark.range(3), "gone"), keep(stored(spark.range(4), "held"))
        with scratch(spark) as inner:
            deeper, handed = stored(spark.range(5), "deeper"), inner(stored(spark.range(6), "handed"))
        assert there(gone) and there(held) and there(handed) and not there(deeper)
        result = keep(stored(held.select(F.sum("id").alias("n")), "result"))
    assert [there(df) for df in (outside, gone, held, handed, result)] == [True, False, True, False, True]
    assert result.first().n == 6


def test_scratch_cleans_up_after_an_error(spark):
    try:
        with scratch(spark):
            gone = stored(spark.range(3), "gone")
            raise RuntimeError
    except RuntimeError:
        assert not there(gone)


def test_noted_folders_are_removed_later(spark):
    with noted() as written:
        df = stored(spark.range(3), "noted")
        with scratch(spark) as keep:
            kept = keep(stored(df, "kept"))
    assert written == [df.stored_at, kept.stored_at] and there(df)
    remove(spark, written)
    assert not there(df) and not there(kept)
