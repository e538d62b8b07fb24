"""What became of signals: forward returns, first touches, grouped summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import EvaluationConfig
from .features import by_time, ratio
from .reuse import settled


def outcomes(features: DataFrame, signals: DataFrame, cfg: EvaluationConfig = EvaluationConfig()) -> DataFrame:
    """One row for each signal and horizon. Forward windows are computed on the bars once, before the join."""
    ahead = {}
    for h in cfg.horizons:
        frame = by_time().rowsBetween(1, h)
        ahead[f"exit_{h}"] = F.lead("close", h).over(by_time())
        ahead[f"up_{h}"], ahead[f"down_{h}"] = F.max("high").over(frame), F.min("low").over(frame)
        for name, side, sign in (("bull", "high", 1), ("bear", "low", -1)):
            level = lambda r, s=sign: F.col("close") * (1 + s * r)
            reach = lambda k, up, lv: F.lead("high", k).over(by_time()) >= lv if up else F.lead("low", k).over(by_time()) <= lv
            for what, up, lv in (("target", sign > 0, level(cfg.target_return)), ("stop", sign < 0, level(-cfg.stop_return))):
                ahead[f"{name}_{what}_{h}"] = reduce(lambda a, k, up=up, lv=lv: a.when(reach(k, up, lv), k), range(2, h + 1), F.when(reach(1, up, lv), 1))
    wide = features.select("symbol", "bar_index", "close", *[v.alias(k) for k, v in ahead.items()])
    rows = signals.filter("bias IN ('Bullish', 'Bearish')").join(wide, ["symbol", "bar_index"])
    bull = F.col("bias") == "Bullish"
    over = lambda c: ratio(F.col(c), F.col("close"))
    each = []
    for h in cfg.horizons:
        raw = over(f"exit_{h}") - 1
        t, s = (F.when(bull, F.col(f"bull_{x}_{h}")).otherwise(F.col(f"bear_{x}_{h}")) for x in ("target", "stop"))
        first = (
            F.when(F.col(f"exit_{h}").isNull(), "insufficient_future_bars")
            .when(t.isNull() & s.isNull(), "neither_hit")
            .when(F.coalesce(t == s, F.lit(False)), {"ambiguous": "both_same_bar"}.get(cfg.same_bar, cfg.same_bar))
            .when(s.isNull() | F.coalesce(t < s, F.lit(False)), "target_first")
            .otherwise("stop_first")
        )
        best = F.when(bull, over(f"up_{h}") - 1).otherwise(1 - over(f"down_{h}"))
        worst = F.when(bull, over(f"down_{h}") - 1).otherwise(1 - over(f"up_{h}"))
        each.append(F.struct(F.lit(h).alias("horizon"), F.when(bull, raw).otherwise(-raw).alias("directional_return"), F.when(F.col(f"exit_{h}").isNotNull(), best).alias("mfe"), F.when(F.col(f"exit_{h}").isNotNull(), worst).alias("mae"), first.alias("touch")))
    return rows.select("symbol", "bar_start", "bar_index", "pattern_id", "bias", F.inline(F.array(*each)))


def summaries(results: DataFrame, by: str | None = None) -> DataFrame:
    """Counts, rates, means and exact medians of the available outcomes, by horizon and one more column."""
    r = F.col("directional_return")
    return (
        results.filter(r.isNotNull())
        .groupBy(*([by] if by else []), "horizon")
        .agg(
            F.count(F.lit(1)).alias("signals"),
            F.sum((r > 0).cast("int")).alias("wins"),
            F.sum((r < 0).cast("int")).alias("losses"),
            F.sum((r == 0).cast("int")).alias("flat"),
            F.avg((r > 0).cast("int")).alias("precision"),
            F.avg(r).alias("mean_return"),
            F.median(r).alias("median_return"),
            F.avg("mfe").alias("mean_mfe"),
            F.avg("mae").alias("mean_mae"),
            F.avg((F.col("touch") == "target_first").cast("int")).alias("target_first_rate"),
            F.avg((F.col("touch") == "stop_first").cast("int")).alias("stop_first_rate"),
        )
    )


def traded(results: DataFrame, cfg: EvaluationConfig = EvaluationConfig()) -> DataFrame:
    """Adds raw_return, and trade_return: what leaving at the first touch earns, or at the horizon where none decides."""
    r = F.col("directional_return")
    raw = F.when(F.col("bias") == "Bullish", r).otherwise(F.lit(0.0) - r)
    touched = F.when(F.col("touch") == "target_first", cfg.target_return).when(F.col("touch") == "stop_first", -cfg.stop_return).otherwise(r)
    return results.withColumns({"raw_return": raw, "trade_return": F.when(r.isNotNull(), touched)})


def medians(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Exact medians of any number of values a key: values are ranged and sorted over all tasks, and the middle ones
    are found by their place, so no task holds a key's values."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    order = [*keys, value]
    ordered = settled(rows.select(*order).repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_mid", F.monotonically_increasing_id()))
    part, low = F.shiftright("_mid", 33), F.col("_mid").bitwiseAND((1 << 33) - 1)
    # one row for each partition
    sizes = ordered.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"))
    placed = ordered.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn("_at", F.col("_offset") + low)
    ends = placed.groupBy(*keys).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    wanted = ends.select(*keys, F.explode(F.array_distinct(F.array(F.col("_first") + F.floor((F.col("_n") - 1) / 2), F.col("_first") + F.floor(F.col("_n") / 2)))).alias("_at"))
    return placed.join(wanted, [*keys, "_at"]).groupBy(*keys).agg(F.avg(value).alias("median"))


MEASURES = {"return": "directional_return", "raw": "raw_return", "mfe": "mfe", "mae": "mae"}


def grouped_summaries(results: DataFrame, groups: dict[str, Column | None], cfg: EvaluationConfig = EvaluationConfig()) -> DataFrame:
    """One row for each kind of group, value and horizon, horizons without outcomes included, in one pass over the outcomes.

    groups: the column that a kind groups by, None for all together; rows whose column is null have no group of the kind.
    """
    every = F.array(*[F.struct(F.lit(k).alias("kind"), (F.lit("all") if c is None else c.cast("string")).alias("value")) for k, c in groups.items()])
    seen = settled(traded(results, cfg).filter("directional_return IS NOT NULL").select("horizon", "touch", "trade_return", *MEASURES.values(), F.inline(F.filter(every, lambda g: g["value"].isNotNull()))))
    keys, r, t = ["kind", "value", "horizon"], F.col("directional_return"), F.col("trade_return")
    share = lambda c: F.avg(c.cast("int"))
    touch = lambda x: share(F.col("touch") == x)
    sums = seen.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("signals"),
        *[F.sum(c.cast("int")).alias(n) for n, c in (("wins", r > 0), ("losses", r < 0), ("flat", r == 0))],
        share(r > 0).alias("precision"),
        share(r < 0).alias("false_positive_rate"),
        share(t > 0).alias("win_rate"),
        *[F.avg(c).alias(f"mean_{m}") for m, c in MEASURES.items()],
        F.avg(t).alias("expectancy"),
        *[touch(x).alias(n) for n, x in (("target_first_rate", "target_first"), ("stop_first_rate", "stop_first"), ("neither_rate", "neither_hit"), ("same_bar_rate", "both_same_bar"))],
    )
    melted = seen.select(*keys, F.inline(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(c).alias("x")) for m, c in MEASURES.items()])))
    middle = medians(melted, [*keys, "measure"], "x").groupBy(*keys).agg(*[F.max(F.when(F.col("measure") == m, F.col("median"))).alias(f"median_{m}") for m in MEASURES])
    domain = seen.select("kind", "value").distinct()
    if any(c is None for c in groups.values()):
        whole = [(k, "all") for k, c in groups.items() if c is None]
        domain = domain.unionByName(results.sparkSession.createDataFrame(whole, "kind string, value string")).distinct()
    domain = domain.withColumn("horizon", F.explode(F.array(*map(F.lit, cfg.horizons))))
    out = domain.join(sums, keys, "left").join(middle, keys, "left")
    return out.fillna(0, ["signals", "wins", "losses", "flat"])


def confidence_bucket(score):
    """Bucket of a confidence from 0 to 100."""
    return F.when(score < 25, "0-24").when(score < 50, "25-49").when(score < 75, "50-74").otherwise("75-100")
