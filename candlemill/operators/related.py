"""All events of a symbol, doubles among them, and which of those that confirm each other counts.

A confirmed double and the break that confirms it say one thing. Where both could count, the break is left out. Of
several doubles with one break all count, unless the break outweighs them: then only the best of them does. A double has
one break at most, so what is related is a star around a break, which a window on (symbol, bias, bar of the break)
settles; no chain of links is followed.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import PatternConfig
from . import lifecycle, signals, structure
from .reuse import settled

#: Fixed value: why an event does not count that another one stands for.
LINKED = "linked confirmation duplicate"
DOUBLES = tuple(name for name, _, _ in structure.SIDES.values())
EXTRA = ["anchored", "star", "own_strength"]


class Gathered(NamedTuple):
    #: Events that group mates are counted from: all but undecided doubles.
    events: DataFrame
    #: First events of all groups but doubles.
    plain: DataFrame
    #: First events of the groups of doubles, with star: the bar of the break each is linked to.
    doubles: DataFrame

    @property
    def first(self) -> DataFrame:
        """First events of all groups."""
        kept = self.doubles.select(*self.plain.columns, *EXTRA)
        return self.plain.unionByName(kept, allowMissingColumns=True)


def gathered(features: DataFrame) -> Gathered:
    """Events of settled features, each table written once."""
    events = settled(signals.all_events(features))
    plain = settled(signals.primaries(events))
    doubles = settled(structure.rows(structure.deduplicated(structure.events(features)), features))
    breaks = plain.filter(F.col("pattern_id").isin(*lifecycle.BREAKS)).select("symbol", "pattern_id", "bar_index", F.col("zone").alias("level"))
    first = settled(structure.starred(structure.first_of_groups(doubles), breaks))
    mates = doubles.filter("status = 'confirmed'").select(*events.columns)
    return Gathered(events.unionByName(mates), plain, first)


def states(features: DataFrame, found: Gathered, cfg: PatternConfig = PatternConfig()) -> DataFrame:
    """symbol, bar_start, kind, state, since, last of the first events of all groups."""
    plain = lifecycle.states(features, found.plain, cfg).select(*structure.EVENT, "state", "since", "last")
    return plain.unionByName(structure.states_of(found.doubles, features, cfg))


def without_linked(rows: DataFrame) -> DataFrame:
    """Weighed rows, of which linked ones that another one stands for are left out. The heaviest comes first; equal ones by
    age, then a plain break, doubles, a strong break."""
    double, broke = F.col("pattern_id").isin(*DOUBLES), F.col("pattern_id").isin(*lifecycle.BREAKS)
    counted = F.col("reason").isNull() & (double | broke)
    e = rows.withColumns({"_star": F.coalesce("star", "bar_index"), "_double": double, "_counted": counted})
    star = Window.partitionBy("symbol", "bias", "_star")
    order = [(~F.col("_counted")).cast("int"), -F.abs("contribution"), F.col("age"), F.when(F.col("_double"), 1).when(F.col("strong"), 2).otherwise(0), F.col("kind")]
    e = e.withColumns({"_paired": F.bool_or(F.col("_counted") & F.col("_double")).over(star), "_led": F.first(F.col("_counted") & ~F.col("_double")).over(star.orderBy(*order)), "_place": F.row_number().over(Window.partitionBy("symbol", "bias", "_star", "_double").orderBy(*order))})
    out = F.col("_counted") & F.when(F.col("_double"), F.col("_led") & (F.col("_place") > 1)).otherwise(F.col("_paired"))
    return e.withColumns({"reason": F.when(out, LINKED).otherwise(F.col("reason")), **{c: F.when(out, 0.0).otherwise(F.col(c)) for c in ("contribution", "_volume")}}).drop("_star", "_double", "_counted", "_paired", "_led", "_place")
