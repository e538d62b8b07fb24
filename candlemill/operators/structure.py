"""Double tops and bottoms as events: a tentative one when a setup is known, another when it is decided.

Setups that share their second pivot, stage and prices are one event. Confirmed ones are linked to the level break
that confirms them, and the group's first event says in which state a setup is. Confirmed ones are events like all
others: ``rows`` gives them the columns of signals.all_events, and they live until a close beyond the outermost price of
their bars or their greatest age ends them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import PatternConfig
from . import detectors
from .crossings import first_beyond

#: Pattern, bias and the break that confirms it, by whether it is a top.
SIDES = {True: ("double_top", "Bearish", "breakdown"), False: ("double_bottom", "Bullish", "breakout")}
#: Largest relative difference of equal prices, bars between a break and the confirmation it is linked to,
#: greatest age in bars of a setup that waits, and the tolerance of links by price alone (relative, absolute).
SAME_PRICE, LINK_BARS, WAIT_BARS, LOOSE = 0.005, 1, 6, (0.01, 0.5)
PRICES = ("p1", "p2", "neckline", "price")
#: Base score, priority, specificity and greatest age in bars of a double that is decided.
WORTH, MAX_AGE = {"base": 20, "priority": 2, "specificity": 24}, 16
SETUP = ["symbol", "pattern_id", "i1", "i2"]
EVENT = ["symbol", "bar_start", "kind"]


def events(features: DataFrame) -> DataFrame:
    """(symbol, pattern_id, bias, setup columns, status, bar_index, price, confirmation, rim); bar_index is the bar at which
    the event is known, rim the highest high (of a bottom the lowest low) of its bars."""
    closes = features.select("symbol", F.col("bar_index").alias("decided"), F.col("close").alias("_closed"), F.col("high").alias("_high"), F.col("low").alias("_low"))
    valleys = features.select("symbol", F.col("bar_index").alias("valley"), F.col("high").alias("_over"), F.col("low").alias("_under"))
    sides = []
    for top, (name, bias, _) in SIDES.items():
        d = detectors.double_outcomes(features, top, more=("p1", "p2", "depth", "tol", "valley")).join(closes, ["symbol", "decided"], "left").join(valleys, ["symbol", "valley"])
        rim = F.greatest("p1", "p2", "_over", "_high") if top else F.least("p1", "p2", "_under", "_low")
        event = lambda status, at, price, confirmed: F.struct(status.alias("status"), at.alias("bar_index"), price.alias("price"), confirmed.alias("confirmation"))
        status = F.col("status")
        first = event(F.lit("tentative"), F.col("known").cast("int"), F.col("neckline"), F.lit(None).cast("int"))
        at = F.col("decided").cast("int")
        later = F.when(status != "tentative", event(status, at, F.when(status == "expired", F.col("neckline")).otherwise(F.col("_closed")), F.when(status == "confirmed", at)))
        # beside a neckline of zero a depth is infinite
        strength = F.when(F.col("depth") < float("inf"), F.floor(F.round("depth", 9) * 10000 + 0.5) / 100).otherwise(F.col("depth"))
        sides.append(d.select("symbol", F.lit(name).alias("pattern_id"), F.lit(bias).alias("bias"), "i1", "i2", "p1", "p2", "neckline", "tol", strength.alias("strength"), rim.alias("rim"), F.inline(F.array_compact(F.array(first, later)))))
    return sides[0].unionByName(sides[1])


def _same(a: Column, b: Column) -> Column:
    out = F.lit(True)
    for p in PRICES:
        x, y = a[p], b[p]
        out = out & (F.abs(x - y) / F.greatest(F.abs(x), F.abs(y), F.lit(1e-9)) <= SAME_PRICE)
    return out


def deduplicated(doubles: DataFrame) -> DataFrame:
    """One event for each setup and stage, the strongest, with members: how many there were.

    Their rim is that of all their bars. First pivots of one second pivot lie within the greatest gap of a double, so a group holds a few rows at most. In
    order, each joins the first leader whose prices are its own, or leads."""
    keys = ["symbol", "pattern_id", "bias", "i2", "confirmation", "status"]
    row = F.struct("bar_index", "i1", *PRICES, "tol", "strength", "rim")
    g = doubles.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("_rows"))

    def place(seen, x):
        led = F.array_compact(F.transform(seen.leaders, lambda a, i: F.when(_same(a, x), i + 1)))
        at = F.coalesce(F.get(led, F.lit(0)), F.size(seen.leaders) + 1)
        leaders = F.when(at > F.size(seen.leaders), F.concat(seen.leaders, F.array(x))).otherwise(seen.leaders)
        return F.struct(leaders.alias("leaders"), F.concat(seen.places, F.array(at)).alias("places"))

    none = F.struct(F.slice("_rows", 1, 0).alias("leaders"), F.slice(F.transform("_rows", lambda _: F.lit(0)), 1, 0).alias("places"))
    placed = g.withColumn("_places", F.aggregate("_rows", none, place)["places"])
    each = placed.select(*keys, F.inline(F.arrays_zip(F.col("_rows").alias("row"), F.col("_places").alias("place"))))
    best = F.min_by("row", F.struct(-F.col("row.strength"), F.col("row.i1")))
    rim = F.when(F.col("bias") == "Bearish", F.max("row.rim")).otherwise(F.min("row.rim"))
    out = each.groupBy(*keys, "place").agg(best.alias("_best"), rim.alias("_rim"), F.count(F.lit(1)).alias("members")).select(*keys, "_best.*", "_rim", "members")
    return out.drop("rim").withColumnRenamed("_rim", "rim")


def links(doubles: DataFrame, breaks: DataFrame) -> DataFrame:
    """(double, break_bar, relation): breaks that confirm a double near its confirmation ('linked'), else breaks at the event's own bar and about its neckline ('inferred')."""
    trigger = F.when(F.col("pattern_id") == SIDES[True][0], SIDES[True][2]).otherwise(SIDES[False][2])
    ids = ["symbol", "pattern_id", "i1", "i2", "status", "bar_index"]
    d = doubles.withColumn("trigger", trigger)
    b = breaks.select("symbol", F.col("pattern_id").alias("trigger"), F.col("bar_index").alias("break_bar"), "level")
    near = d.filter("status = 'confirmed'").withColumn("break_bar", F.explode(F.sequence(F.col("confirmation") - LINK_BARS, F.col("confirmation") + LINK_BARS)))
    linked = near.join(b, ["symbol", "trigger", "break_bar"]).filter("break_bar >= i2 AND abs(level - neckline) <= tol").select(*ids, "break_bar", F.lit("linked").alias("relation"))
    loose = F.abs(F.col("level") - F.col("neckline")) <= F.greatest(F.abs("neckline") * LOOSE[0], F.lit(LOOSE[1]))
    rest = d.join(linked.select(*ids).distinct(), ids, "left_anti").withColumn("break_bar", F.col("bar_index"))
    inferred = rest.join(b, ["symbol", "trigger", "break_bar"]).filter(loose).select(*ids, "break_bar", F.lit("inferred").alias("relation"))
    return linked.unionByName(inferred)


def first_of_groups(doubles: DataFrame) -> DataFrame:
    """The first event of each setup (second pivot and neckline): its confirmation, else the tentative event, else what decided it."""
    group = Window.partitionBy("symbol", "pattern_id", "i2", F.floor(F.col("neckline") * 100 + 0.5))
    rank = F.when(F.col("status") == "confirmed", 0).when(F.col("status") == "tentative", 1).otherwise(2)
    first = F.row_number().over(group.orderBy(rank, F.col("bar_index").desc(), "i1", "status"))
    return doubles.withColumn("_n", first).filter("_n = 1").drop("_n")


def broken_rims(first: DataFrame, features: DataFrame, cfg: PatternConfig = PatternConfig()) -> DataFrame:
    """Confirmed doubles with bad: the first later close beyond the rim by more than the tolerance at the confirmation, or null."""
    own = features.select("symbol", "bar_index", "atr", "bar_range")
    confirmed = first.filter("status = 'confirmed'").join(own, ["symbol", "bar_index"])
    up, tol = F.col("bias") == "Bearish", detectors.tolerance(F.col("rim"), cfg)
    ask = F.concat_ws("|", "pattern_id", "i1", "i2").alias("ask")
    asks = confirmed.select("symbol", ask, F.lit("bad").alias("what"), F.col("bar_index").cast("int").alias("after"), F.lit("close").alias("field"), up.alias("over"), F.when(up, F.col("rim") + tol).otherwise(F.col("rim") - tol).alias("x"), F.lit(False).alias("closed"))
    met = first_beyond(features, asks).select("symbol", "ask", F.col("at").alias("bad"))
    return confirmed.withColumn("ask", ask).join(met, ["symbol", "ask"], "left").drop("ask", "atr", "bar_range")


def states(doubles: DataFrame, features: DataFrame, cfg: PatternConfig = PatternConfig()) -> DataFrame:
    """State and its bar for each setup (second pivot and neckline).

    One that waits is awaiting confirmation until it is too old. A confirmed one is invalidated by a close beyond its rim,
    expires with age, and is new at the symbol's last bar; it has no retest."""
    last = features.groupBy("symbol").agg(F.max("bar_index").alias("last"))
    first = first_of_groups(doubles)
    i, out = F.col("bar_index"), [*SETUP, "bias", "status"]
    d = first.filter("status <> 'confirmed'").join(last, "symbol")
    waits = F.col("status") == "tentative"
    late = waits & (F.col("last") - i > WAIT_BARS)
    since = F.when(late, F.least(F.col("last"), i + WAIT_BARS + 1)).otherwise(i)
    waiting = d.select(*out, F.when(waits & ~late, "awaiting_confirmation").when(late, "expired").otherwise(F.col("status")).alias("state"), since.cast("int").alias("since"))
    c = broken_rims(first, features, cfg).join(last, "symbol")
    old = F.col("last") - i > MAX_AGE
    state = F.when(F.col("bad").isNotNull(), "invalidated").when(old, "expired").when(i == F.col("last"), "new").otherwise("active")
    ended = F.coalesce("bad", F.when(old, F.least(F.col("last"), i + MAX_AGE + 1)), i)
    return waiting.unionByName(c.select(*out, state.alias("state"), ended.cast("int").alias("since")))


def rows(doubles: DataFrame, features: DataFrame) -> DataFrame:
    """Events of deduplicated doubles with the columns of signals.all_events, what links need (i1, i2, neckline, tol,
    confirmation, rim), own_strength, and anchored: the bar that their age counts from while nothing has moved it."""
    at = features.select("symbol", "bar_index", "bar_start", F.coalesce(F.col("volume_strength") >= 1, F.lit(False)).alias("loud"))
    waits = F.col("status") == "tentative"
    kind = F.concat_ws(":", F.lit("structural"), "pattern_id", "i2", F.floor(F.col("neckline") * 100 + 0.5))
    new = {"name": F.col("pattern_id"), "kind": kind, "zone": F.col("neckline"), "strong": F.lit(False), "max_age": F.when(waits, WAIT_BARS).otherwise(MAX_AGE), "anchored": F.when(waits, F.col("i2")).otherwise(F.col("bar_index")).cast("int"), "own_strength": F.col("strength")}
    new |= {c: F.lit(v) for c, v in WORTH.items()}
    return doubles.join(at, ["symbol", "bar_index"]).withColumns(new).drop("strength", "price", "p1", "p2", "members")


def starred(first: DataFrame, breaks: DataFrame) -> DataFrame:
    """Adds star: the bar of the break that a confirmed double is linked to, or null. Breaks of one side are further
    apart than the bars in which a link looks for them, so a double has one at most."""
    ids = [*SETUP, "status", "bar_index"]
    met = links(first.filter("status = 'confirmed'"), breaks).groupBy(*ids).agg(F.min("break_bar").cast("int").alias("star"))
    return first.join(met, ids, "left")


def states_of(first: DataFrame, features: DataFrame, cfg: PatternConfig = PatternConfig()) -> DataFrame:
    """symbol, bar_start, kind, state, since, last of rows that are the first of their group."""
    last = features.groupBy("symbol").agg(F.max("bar_index").cast("int").alias("last"))
    return states(first, features, cfg).join(first.select(*EVENT, *SETUP[1:], "status"), [*SETUP, "status"]).join(last, "symbol").select(*EVENT, "state", "since", "last")
