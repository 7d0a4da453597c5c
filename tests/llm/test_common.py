"""The bitmap that sifts rows before a join."""

import pytest
from pyspark.sql import functions as F

pytest.importorskip("dayloom.llm.registry")

from dayloom.llm import common


@pytest.mark.parametrize("most", [1 << 26, 1 << 15])
def test_sifted_keeps_all_that_are_held(spark, monkeypatch, most):
    monkeypatch.setattr(common, "MOST_BITS", most)
    many = spark.range(40_000).select(F.when(F.col("id") % 1000 != 0, F.col("id")).alias("a"), (F.col("id") % 7).cast("string").alias("b"), F.lit("x").alias("t"))
    few = many.filter("a % 40 = 3 or a is null").select("a", "b")
    got = common.sifted(many, few, ["a", "b"])
    assert got.columns == many.columns
    held = common.join_on(got, few.distinct(), ["a", "b"]).count()
    assert held == common.join_on(many, few.distinct(), ["a", "b"]).count()
    assert got.count() < 0.1 * many.count()
    assert common.sifted(many, few.limit(0), ["a", "b"]).count() == 0 and common.sifted(many.limit(0), few, ["a", "b"]).count() == 0
