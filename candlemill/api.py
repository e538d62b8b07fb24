"""What a user extends and starts from: detectors, providers, presets, one analysis of one file."""

from __future__ import annotations

import argparse
import json
import sys
import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import INTERVAL_SECONDS, PatternConfig
from .operators import assessment, detectors, features, ranking, related, score, signals, trend
from .operators.reuse import settled
from .sources.bars import read_bars

#: Period and interval of each preset.
PRESETS = {
    "1_DAY": ("1d", "15m"), "1_WEEK": ("5d", "15m"), "1_MONTH": ("1mo", "1h"), "3_MONTHS": ("3mo", "1d"),
    "6_MONTHS": ("6mo", "1d"), "1_YEAR": ("1y", "1d"), "5_YEARS": ("5y", "1wk"),
}
EVENT = ("symbol", "bar_start", "bar_index", "pattern_id", "bias")


class Provider(Protocol):
    """Bars of a symbol from anywhere: symbol, bar_start, open, high, low, close, volume."""

    def load(self, symbol: str, interval: str) -> DataFrame: ...


class Resolver(Protocol):
    """Symbols for a table of identifiers."""

    def resolve(self, identifiers: DataFrame) -> DataFrame: ...


@dataclass(frozen=True)
class FileProvider:
    """Bars of a .csv or .parquet file."""

    spark: SparkSession
    path: str

    def load(self, symbol: str, interval: str) -> DataFrame:
        bars = read_bars(self.spark, self.path)
        return bars if "symbol" in bars.columns else bars.select(F.lit(symbol).alias("symbol"), "*")


def with_retry(load: Callable[[], DataFrame], attempts: int = 3, pause: float = 0.5, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """Tries again after any error, with pauses that double; the last error is raised."""
    for k in range(1, attempts + 1):
        try:
            return load()
        except Exception:
            if k == attempts:
                raise
            sleep(pause * 2 ** (k - 1))
    raise ValueError("attempts is at least 1")


@dataclass(frozen=True)
class Detector:
    """A detector takes features and settings and returns rows of EVENT."""

    pattern_id: str
    detect: Callable[[DataFrame, PatternConfig], DataFrame]
    label: str = ""
    priority: int = 9
    base: int = 0


@dataclass(frozen=True)
class Registry:
    """Detectors in order. Registering gives a new registry; an id occurs once."""

    detectors: tuple[Detector, ...] = ()

    def register(self, *more: Detector) -> Registry:
        ids = [d.pattern_id for d in (*self.detectors, *more)]
        if len(set(ids)) < len(ids):
            raise ValueError("a pattern id is registered twice")
        return replace(self, detectors=(*self.detectors, *more))

    def detect(self, rows: DataFrame, cfg: PatternConfig = PatternConfig()) -> DataFrame:
        found = None
        for d in self.detectors:
            part = d.detect(rows, cfg).select(*EVENT)
            found = part if found is None else found.unionByName(part)
        if found is None:
            raise ValueError("no detector is registered")
        return found

    def details(self) -> list[dict]:
        return [{"pattern_id": d.pattern_id, "label": d.label or d.pattern_id.replace("_", " ").title(), "priority": d.priority, "base": d.base} for d in self.detectors]


def built_in() -> Registry:
    """A detector for each pattern. The candle patterns share one pass in the plan of all of them."""

    def candle(name: str):
        return lambda rows, cfg: detectors.bar_patterns(rows, cfg).filter(F.col("pattern_id") == name)

    def wick(name: str):
        return lambda rows, cfg: trend.rejections(rows).filter(F.col("pattern_id") == name)

    def broken(name: str):
        return lambda rows, cfg: detectors.breaks(rows, cfg).filter(F.col("pattern_id") == name)

    make = {"breakout": broken, "breakdown": broken, "bullish_pin_bar": wick, "hammer": wick, "shooting_star": wick}
    return Registry(tuple(Detector(k, make.get(k, candle)(k), "", priority, base) for k, (base, priority, _, _) in signals.WEIGHTS.items()))


def analyse(bars: DataFrame, interval: str = "1h", top: int = ranking.TOP) -> tuple[DataFrame, DataFrame]:
    """(assessment, top events) of every symbol at its last bar. A bias of too little confidence is Neutral."""
    if interval not in INTERVAL_SECONDS:
        raise ValueError(f"unknown interval {interval}")
    rows = settled(features.add_features(bars))
    found = related.gathered(rows)
    judged = settled(score.judged(rows, found.first, settled(related.states(rows, found)), interval))
    strengths = rows.select("symbol", "bar_index", ranking.strength().alias("strength"))
    sure = assessment.confidence(judged, found.events, settled(score.assess(judged, trend.broad(rows))), strengths)
    return assessment.gated(sure), ranking.top(judged, top)


def report(assessment: Iterable, events: Iterable) -> str:
    """The assessment of each symbol as text, with its first events."""
    of: dict[str, list] = {}
    for e in sorted(events, key=lambda r: (r["symbol"], r["rank"])):
        of.setdefault(e["symbol"], []).append(e)
    out = []
    for a in sorted(assessment, key=lambda r: r["symbol"]):
        out += [f"{a['symbol']}: {a['market_state']}, bias {a['bias']}, trend {a['trend']}", f"  bullish {a['bullish']:.2f}  bearish {a['bearish']:.2f}  volume {a['volume']:.2f}  net {a['net']:.2f}  conflict {a['conflict']:.2f}"]
        out += [f"  {e['rank']}. {e['name']} ({e['bias']}, {e['status']}, {e['state']}), {e['bar_start']}, {e['contribution']:+.2f}" + (f", {e['reason']}" if e["reason"] else "") for e in of.get(a["symbol"], [])]
    return "\n".join(out) + "\n"


def main(arguments: list[str] | None = None) -> int:
    """0: done; 2: wrong arguments; 3: bars that cannot be read; 8: output that cannot be written."""
    parser = argparse.ArgumentParser(prog="candlemill")
    command = parser.add_subparsers(dest="command", required=True)
    one = command.add_parser("analyze", help="state, bias and events of the bars in a file")
    one.add_argument("symbol")
    one.add_argument("--data-file", required=True)
    one.add_argument("--preset", choices=sorted(PRESETS))
    one.add_argument("--interval", choices=sorted(INTERVAL_SECONDS))
    one.add_argument("--top", type=int, default=ranking.TOP)
    one.add_argument("--format", choices=("text", "json"), default="text")
    one.add_argument("--output")
    asked = parser.parse_args(arguments)
    interval = asked.interval or (PRESETS[asked.preset][1] if asked.preset else "1h")
    spark = SparkSession.builder.getOrCreate()
    try:
        assessment, events = analyse(FileProvider(spark, asked.data_file).load(asked.symbol, interval), interval, asked.top)
        rows, first = [r.asDict() for r in assessment.collect()], [r.asDict() for r in events.collect()]
    except Exception as e:
        print(f"bars cannot be read: {e}", file=sys.stderr)
        return 3
    text = report(rows, first) if asked.format == "text" else json.dumps({"assessment": rows, "events": first}, indent=2, sort_keys=True, ensure_ascii=False, default=str) + "\n"
    if not asked.output:
        print(text, end="")
        return 0
    try:
        with open(asked.output, "w", encoding="utf-8") as f:
            f.write(text)
    except OSError as e:
        print(f"cannot write: {e}", file=sys.stderr)
        return 8
    return 0


if __name__ == "__main__":
    sys.exit(main())
