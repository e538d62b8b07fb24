"""Queries over instruments and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import validate
from ..sources import instruments
from ..streaming.bars import closed_bars
from .bar_queries import feats


def _mapping(spark, sf):
    """A mapping made of nations: some numbers twice, some without a symbol or time zone."""
    n = spark.read.parquet(f"{sf}/nation.parquet").select("n_name", F.col("n_nationkey").cast("int").alias("k"))
    tails = F.array(*[F.lit(x) for x in (".TA", ".L", ".to", ".V", ".AX", "")])
    return n.select(
        F.concat(F.lit(" "), (F.col("k") % 20).cast("string")).alias("security_number"),
        F.when(F.col("k") % 7 != 3, F.concat(F.substring("n_name", 1, 4), F.get(tails, F.col("k") % 6))).otherwise(" ").alias("yahoo_symbol"),
        F.when(F.col("k") % 3 == 0, F.col("n_name")).alias("name"),
        F.when(F.col("k") % 4 == 0, "nyq").when(F.col("k") % 4 == 1, "Unknown").alias("exchange"),
        F.lit("").alias("currency"),
        F.when(F.col("k") % 5 == 0, "Europe/Paris").alias("timezone"),
        F.col("k").alias("row"),
    )


def instrument_profiles(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet")
    k = F.col("c_custkey")
    asked = c.select("c_custkey", F.when(k % 3 == 0, (k % 23).cast("string")).when(k % 3 == 1, F.concat(F.lit(" abc"), F.when(k % 2 == 0, ".l").otherwise(".TO"))).otherwise("").alias("identifier"))
    return instruments.with_profile(instruments.resolve(asked, _mapping(spark, sf))).drop("identifier")


def streamed_bars(spark, sf):
    return closed_bars(spark, f"{sf}/events*.parquet")


def latest_sessions(spark, sf):
    return validate.latest_sessions(feats(spark, sf))


QUERIES = {f.__name__: f for f in (instrument_profiles, streamed_bars, latest_sessions)}
