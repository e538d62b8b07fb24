"""First later bar that crosses a price: one pass over a symbol's bars in order, for any number of questions.

A forward join of questions with all bars after them would grow with the square of a symbol's history. Here bars
and questions stream together, sorted, through each partition; what a batch does not answer waits for the next one,
and within a batch each question takes a logarithmic number of vector steps.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIELDS = ("close", "high", "low", "pair_low", "pair_high")


def first_above(values: np.ndarray, start: np.ndarray, x: np.ndarray) -> np.ndarray:
    """For each question the first place from start on whose value is over x, or the length where none is."""
    levels = [values]
    while 2 ** len(levels) <= len(values):
        half, last = 2 ** (len(levels) - 1), levels[-1]
        levels.append(np.maximum(last[:-half], last[half:]))
    at = start.copy()
    for k in range(len(levels) - 1, -1, -1):
        fits = at + 2**k <= len(values)
        skip = np.zeros(len(at), bool)
        skip[fits] = levels[k][at[fits]] <= x[fits]
        at[skip] += 2**k
    return at


def _answer(run: pd.DataFrame, waiting: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Answered and still waiting questions after the rows of one symbol in one batch."""
    run = run.reset_index(drop=True)
    new = run[run.asks].assign(start=np.flatnonzero(run.asks) + 1)
    asked = pd.concat([waiting.assign(start=0), new], ignore_index=True) if len(waiting) else new.reset_index(drop=True)
    at = np.full(len(asked), len(run))
    for (field, over), part in asked.groupby(["field", "over"]):
        sign = 1.0 if over else -1.0
        values = np.where(run.asks | run[field].isna(), -np.inf, run[field] * sign)
        x = part.x.to_numpy() * sign
        at[part.index] = first_above(values, part.start.to_numpy(), np.where(part.closed.astype(bool), np.nextafter(x, -np.inf), x))
    hit = at < len(run)
    done = asked[hit].assign(at=run.bar_index.to_numpy()[at[hit]])
    return done, asked[~hit]


def first_beyond(bars: DataFrame, asks: DataFrame) -> DataFrame:
    """(symbol, ask, what, at) for each question that a later bar answers.

    ``asks``: symbol, ask (string), what (string), after (bar index), field (one of FIELDS), over (whether values over
    x are looked for, else under), x, closed (whether x itself counts). pair_low and pair_high are the smaller and larger of two closes in a row, so
    that a crossing by two closes is one question. Questions with a null are never answered.
    """
    from .features import by_time

    before = F.lag("close").over(by_time())
    none = [F.lit(None).cast(t).alias(c) for c, t in (("ask", "string"), ("what", "string"), ("field", "string"), ("over", "boolean"), ("x", "double"), ("closed", "boolean"))]
    rows = bars.withColumns({"pair_low": F.least("close", before), "pair_high": F.greatest("close", before)}).select("symbol", "bar_index", F.lit(False).alias("asks"), *FIELDS, *none)
    questions = asks.dropna().select("symbol", F.col("after").alias("bar_index"), F.lit(True).alias("asks"), *[F.lit(None).cast("double").alias(c) for c in FIELDS], "ask", "what", "field", "over", "x", "closed")
    both = rows.unionByName(questions).repartition("symbol").sortWithinPartitions("symbol", "bar_index", "asks")

    def fold(batches):
        symbol, waiting = None, pd.DataFrame()
        for arrow in batches:
            batch = arrow.to_pandas().astype(dict.fromkeys(("symbol", "ask", "what", "field"), object))
            names, found = batch.symbol.to_numpy(), []
            edges = np.flatnonzero(np.r_[True, names[1:] != names[:-1]]) if len(batch) else []
            for lo, hi in zip(edges, [*edges[1:], len(batch)]):
                if names[lo] != symbol:
                    symbol, waiting = names[lo], pd.DataFrame()
                done, waiting = _answer(batch.iloc[lo:hi], waiting)
                found.append(done)
            columns = [[x for d in found for x in d[c].tolist()] for c in ("symbol", "ask", "what", "at")]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.string(), pa.string(), pa.string(), pa.int32()))], ["symbol", "ask", "what", "at"])

    return both.mapInArrow(fold, "symbol string, ask string, what string, at int")
