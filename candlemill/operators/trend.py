"""Causal trend scores of each bar: broad (three horizons), local (within the session) and before the bar."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .features import break_structure, by_session, by_time, swing_flags

#: Bars of the short, medium and long horizon, with the weight of each in the composite score.
HORIZONS = {"short": (12, 0.50), "medium": (48, 0.35), "long": (120, 0.15)}
FEWEST, LOCAL_BARS, ENTRY_BARS = 8, 20, 15
#: A break's score loses two points a bar, so none of at most 14.5 points is left after seven bars.
BREAK_MEMORY = 7


def clip(c: Column, limit: float) -> Column:
    return F.greatest(F.lit(-limit), F.least(F.lit(limit), c))


def label(score: Column) -> Column:
    return F.when(score >= 18, "Uptrend").when(score <= -18, "Downtrend").otherwise("Neutral")


def with_breaks(df: DataFrame) -> DataFrame:
    """Adds swing flags and break_score: recent breaks in order, each fading, a later one of the other side overriding."""
    df = swing_flags(break_structure(df))
    signed = F.when(F.col("break_up"), F.col("break_base")).when(F.col("break_down"), -F.col("break_base"))
    recent = F.collect_list(F.when(signed.isNotNull(), F.struct(F.col("bar_index").alias("i"), signed.alias("s")))).over(by_time().rowsBetween(-BREAK_MEMORY, 0))
    df = df.withColumn("_recent", recent)

    def step(score, e):
        left = F.greatest(F.lit(0.0), F.abs(e["s"]) - (F.col("bar_index") - e["i"]) * 2.0)
        return F.when(left == 0, score).when(e["s"] > 0, F.greatest(score, left)).otherwise(F.least(score, -left))

    return df.withColumn("break_score", F.aggregate("_recent", F.lit(0.0), step)).drop("_recent")


def _by_count(n: Column, values: dict[int, Column], size) -> Column:
    """The value whose key is size(n), for the few sizes that can occur."""
    keys = sorted(values)
    return reduce(lambda a, k: a.when(size(n) == k, values[k]), keys[1:], F.when(size(n) == keys[0], values[keys[0]]))


def snapshot(df: DataFrame, name: str, horizon: int, break_share: float, session: bool = False) -> DataFrame:
    """Adds <name>_raw (from -100 to 100; 0 for fewer than 8 bars), <name>_slope, <name>_unit and <name>_n.

    The window is the last ``horizon`` bars, or as many as there are (in the session).
    """
    w, place = (by_session(), F.col("session_position")) if session else (by_time(), F.col("bar_index"))
    frame = w.rowsBetween(1 - horizon, 0)
    n = F.least(place + 1, F.lit(horizon))
    third = lambda x: F.least(F.lit(20), F.greatest(F.lit(5), F.floor(x / 3)))
    fast_sizes = range(5, min(20, max(5, horizon // 3)) + 1)
    mean = lambda k: F.avg("close").over(w.rowsBetween(1 - k, 0))
    slow_size = min(50, horizon)
    seen = lambda k: F.sum(F.signum("bar_return")).over(w.rowsBetween(1 - k, 0)) / F.least(n, F.lit(k))
    # swings are known two bars later; in a session their centres need two bars of it before them
    swing = lambda c: F.collect_list(F.when(F.col(f"swing_{c}") & (place >= 2), F.col(c))).over(w.rowsBetween(3 - horizon, -2))
    if session:
        persistence = _by_count(n, {k: seen(k) for k in range(8, max(8, horizon // 2) + 1)}, lambda x: F.greatest(F.lit(8), F.floor(x / 2)))
    else:
        persistence = seen(max(8, horizon // 2))
    df = df.withColumns(
        {
            "_n": n,
            "_unit": F.avg("bar_range").over(frame),
            "_slope": F.regr_slope("close", "bar_index").over(frame),
            "_fast": _by_count(n, {k: mean(k) for k in fast_sizes}, third),
            "_slow": mean(slow_size),
            "_persistence": F.coalesce(persistence, F.lit(0.0)) * 18,
            "_highs": swing("high"),
            "_lows": swing("low"),
        }
    )
    unit = F.when(F.col("_unit") > 1e-9, F.col("_unit")).otherwise(F.greatest(F.abs("close") * 0.001, F.lit(1e-6)))
    df = df.withColumn("_unit", unit)
    fast, slow, price = F.col("_fast"), F.col("_slow"), F.col("close")
    ma = F.when(F.abs(fast - slow) / F.col("_unit") >= 0.12, F.signum(fast - slow) * 10).otherwise(0.0)
    ma += F.when((price > fast) & (price > slow), 5.0).when((price < fast) & (price < slow), -5.0).otherwise(0.0)
    if horizon >= slow_size + 3:
        # the fast period may have grown since; the earlier mean is of today's period
        by_size = {k: F.lag(f"_was{k}", 3).over(w) for k in fast_sizes if k >= min(20, (slow_size + 3) // 3)}
        df = df.withColumns({f"_was{k}": mean(k) for k in by_size})
        fast3 = _by_count(F.col("_n"), by_size, third)
        df = df.withColumns({"_fast3": fast3, "_slow3": F.lag("_slow", 3).over(w)})
        old = F.col("_n") >= slow_size + 3
        ma += F.when(old & (fast > F.col("_fast3")) & (slow > F.col("_slow3")), 5.0).when(old & (fast < F.col("_fast3")) & (slow < F.col("_slow3")), -5.0).otherwise(0.0)
    band = F.greatest(F.col("_unit") / F.greatest(F.abs(price), F.lit(1.0)) * 0.35, F.lit(0.0015))

    def move(c):
        a, b = F.try_element_at(c, F.lit(-2)), F.try_element_at(c, F.lit(-1))
        return F.when(b > a * (1 + band), 7.0).when(b < a * (1 - band), -7.0).otherwise(0.0)

    slope_score = clip(F.col("_slope") / F.col("_unit") * 80, 24.0)
    raw = slope_score + ma + F.col("_persistence") + move(F.col("_highs")) + move(F.col("_lows")) + F.col("break_score") * break_share
    out = df.withColumns(
        {
            f"{name}_raw": F.when(F.col("_n") >= FEWEST, clip(raw, 100.0)).otherwise(0.0),
            f"{name}_slope": slope_score,
            f"{name}_unit": F.col("_unit"),
            f"{name}_n": F.col("_n"),
        }
    )
    return out.drop(*[c for c in out.columns if c.startswith("_")])


def broad(features: DataFrame) -> DataFrame:
    """Adds label and score of each horizon, and trend and trend_score of their weighted mean."""
    df = with_breaks(features)
    for name, (h, _) in HORIZONS.items():
        df = snapshot(df, name, h, 1.0 if h <= 60 else 0.5)
        df = df.withColumns({f"{name}_label": label(F.col(f"{name}_raw")), f"{name}_score": F.round(f"{name}_raw", 2)}).drop(f"{name}_raw", f"{name}_slope", f"{name}_unit", f"{name}_n")
    # in whole hundredths, where halves are exact and every engine rounds them alike
    total = sum((F.round(F.col(f"{name}_score") * 100) * round(weight * 100) for name, (_, weight) in HORIZONS.items()), F.lit(0.0))
    df = df.withColumn("trend_score", F.when(F.col("bar_index") + 1 >= FEWEST, F.round(total / 100.0) / 100.0).otherwise(0.0))
    return df.withColumn("trend", label(F.col("trend_score")))


def local(df: DataFrame) -> DataFrame:
    """Adds local_trend and local_score; needs the columns of ``with_breaks``."""
    df = snapshot(df, "local", LOCAL_BARS, 0.0, session=True)
    gained = clip((F.col("close") - F.col("session_open")) / F.col("local_unit") * 6, 22.0)
    wide = F.col("session_high") - F.col("session_low")
    place = F.when(wide > 1e-9, F.try_divide(F.col("close") - F.col("session_low"), wide)).otherwise(0.5)
    score = clip(F.round("local_raw", 2) + gained + (place - 0.5) * 24, 100.0)
    return df.withColumns({"local_trend": label(score), "local_score": F.round(score, 2)}).drop("local_raw", "local_slope", "local_unit", "local_n")


def entry_context(df: DataFrame) -> DataFrame:
    """Adds entry_direction, entry_score, entry_move and entry_quality: the state just before each bar."""
    df = snapshot(df, "entry", ENTRY_BARS, 1.0)
    first = F.first("close").over(by_time().rowsBetween(1 - ENTRY_BARS, 0))
    df = df.withColumn("_move", F.round((F.col("close") - first) / F.col("entry_unit"), 2))
    s, m, name = F.round("entry_raw", 2), F.col("_move"), label(F.col("entry_raw"))
    direction = (
        F.when(F.col("entry_n") < FEWEST, "ambiguous")
        .when((name == "Uptrend") & (m >= 1.25), "uptrend")
        .when((name == "Downtrend") & (m <= -1.25), "downtrend")
        .when((F.abs(s) >= 16) & (F.abs(m) >= 1.0), F.when(s > 0, "uptrend").otherwise("downtrend"))
        .when(F.abs(s) >= 10, "sideways")
        .otherwise("ambiguous")
    )
    fine = (F.col("entry_n") >= FEWEST) & (F.abs(s) >= 18) & (F.abs("entry_slope") >= 6) & (F.abs(m) >= 1.25)
    now = {"entry_direction": direction, "entry_score": s, "entry_move": m, "entry_quality": fine}
    df = df.withColumns({f"_{k}": v for k, v in now.items()})
    missing = {"entry_direction": "ambiguous", "entry_score": 0.0, "entry_move": 0.0, "entry_quality": False}
    out = df.withColumns({k: F.coalesce(F.lag(f"_{k}").over(by_time()), F.lit(v)) for k, v in missing.items()})
    return out.drop("_move", "entry_raw", "entry_slope", "entry_unit", "entry_n", *[f"_{k}" for k in now])


def rejections(features: DataFrame) -> DataFrame:
    """Pin bars, hammers and shooting stars with what their context makes of them."""
    df = entry_context(local(with_breaks(features)))
    c = F.col
    place = F.try_divide(c("close") - c("low"), c("bar_range"))
    shape = lambda wick, there: F.coalesce((c(wick) >= 0.55) & (c("body_ratio") <= 0.35) & there & c("significant"), F.lit(False))
    lower, upper = shape("lower_wick_ratio", place >= 0.60), shape("upper_wick_ratio", place <= 0.40)
    fell = (c("entry_direction") == "downtrend") & c("entry_quality")
    rose = (c("entry_direction") == "uptrend") & c("entry_quality")
    near_low = F.coalesce(c("low") <= c("support") * 1.005, F.lit(False))
    near_high = F.coalesce(c("high") >= c("resistance") * 0.995, F.lit(False))
    against = F.coalesce(F.lag("local_trend").over(by_time()) == "Downtrend", F.lit(False))
    held = fell | near_low

    def event(pattern_id, name, bias, status):
        return F.struct(F.lit(pattern_id).alias("pattern_id"), name.alias("name"), bias.alias("bias"), status.alias("status"))

    low_event = lambda i, n: F.when(lower, event(i, F.when(fell, n).otherwise("Lower-Wick Rejection"), F.when(held, "Bullish").otherwise("Neutral"), F.when(held, "tentative").otherwise("candidate")))
    star = rose & near_high & ~against
    bear = star | against
    high_event = F.when(
        upper,
        event(
            "shooting_star",
            F.when(star, "Shooting Star").when(against, "Upper-Wick Rejection").when(near_high, "Resistance Rejection").otherwise("Upper-Wick Rejection"),
            F.when(bear, "Bearish").otherwise("Neutral"),
            F.when(bear, "tentative").otherwise("candidate"),
        ),
    )
    df = df.withColumn("_events", F.array_compact(F.array(low_event("bullish_pin_bar", "Bullish Pin Bar"), low_event("hammer", "Hammer"), high_event)))
    return df.select("symbol", "bar_start", "bar_index", F.inline("_events"))
