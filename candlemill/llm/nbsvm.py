"""Quality classifier: naive Bayes support vectors.

A text is the set of its byte N-grams, hashed to 2^BITS numbers, and of its word-shape n-grams: runs of
SHAPE_N words, each told only by how it is written and whether it repeats the word before it. Each n-gram's indicator is scaled by the log ratio of its smoothed counts in the two
classes; a linear hinge-loss model is fitted to the scaled indicators by dual coordinate descent; its
weights are drawn towards their mean size. A logistic curve fitted to the training margins gives scores.

Training takes at most MAX_TRAIN labelled rows (the bound of what the driver holds, as n-gram numbers, no
texts): those with the smallest hash of id, label and text, however often an id repeats among the labels or
the documents. Every text is then scored whole, without any shuffle.

Null text: as empty. Empty texts get the score of the bias alone. Without rows of both classes the score
is the smoothed share of label 1 (a half if there are no labels). Labels other than 0 and 1 and null
labels are not used. Rows with several labels, and ids with several texts, count once for each; equal ones
once. Texts may be of any length. Extra columns stay; those named score or predicted are replaced. Empty
tables: no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import aside, carried, picked, schema_with

N, BITS, SHAPE_N = 3, 16, 4
SIZE = (1 << BITS) + 8**SHAPE_N
MAX_TRAIN = 6000
#: Penalty of the hinge loss, passes of the descent, trust in single weights against their mean size, smoothing of counts.
COST, PASSES, TRUST, SMOOTH = 1.0, 30, 0.9, 1.0
SEED = 7


def shapes(text: str) -> np.ndarray:
    """A class of 0 to 7 for each word: whether it repeats the word before it, and how it is written."""
    out, before = bytearray(), None
    for w in text.split():
        if w == before:
            out.append(1)
        elif w.islower():
            out.append(0 if w[-1].isalpha() else 2)
        elif w.isupper():
            out.append(3 if w[-1].isalpha() else 4)
        elif w[0].isupper():
            out.append(5 if w[-1].isalpha() else 6)
        else:
            out.append(7)
        before = w
    return np.frombuffer(bytes(out), np.uint8)


def features(text: str | None) -> np.ndarray:
    """Sorted distinct n-gram numbers of a text: those of its bytes, then from 2^BITS on those of its word shapes."""
    text = text or ""
    data = np.frombuffer(b"\x02" + text.encode() + b"\x03", np.uint8).astype(np.uint32)
    seen = np.zeros(SIZE, bool)
    if text and len(data) >= N:
        code = data[: len(data) - N + 1].copy()
        for i in range(1, N):
            code = code << np.uint32(8) | data[i : len(data) - N + 1 + i]
        seen[(code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)] = True
        kinds = shapes(text).astype(np.uint32)
        if len(kinds) >= SHAPE_N:
            code = kinds[: len(kinds) - SHAPE_N + 1].copy()
            for i in range(1, SHAPE_N):
                code = code << np.uint32(3) | kinds[i : len(kinds) - SHAPE_N + 1 + i]
            seen[(1 << BITS) + code] = True
    return np.flatnonzero(seen).astype(np.int32)


def scales(x: np.ndarray) -> np.ndarray:
    """Each kind of n-gram has the same weight in a text of any length."""
    n = int(np.searchsorted(x, 1 << BITS))
    return np.concatenate([np.full(n, 1 / np.sqrt(n + 1.0)), np.full(len(x) - n, 1 / np.sqrt(len(x) - n + 1.0))])


class Model:
    def __init__(self, weights: np.ndarray, bias: float, slope: float, offset: float):
        self.weights, self.bias, self.slope, self.offset = weights, bias, slope, offset

    def margin(self, x: np.ndarray) -> float:
        return float(self.weights[x] @ scales(x)) + self.bias

    def score(self, text: str | None) -> float:
        z = self.slope * self.margin(features(text)) + self.offset
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def fit(rows: list[tuple[np.ndarray, int]]) -> Model:
    """Log-count ratios, then dual coordinate descent for the L1-loss support vector machine."""
    y = np.array([1.0 if label == 1 else -1.0 for _, label in rows])
    positive, negative = int((y > 0).sum()), int((y < 0).sum())
    if not positive or not negative:
        share = (positive + 1) / (positive + negative + 2)
        return Model(np.zeros(SIZE), 0.0, 0.0, float(np.log(share / (1 - share))))
    counts = {s: np.full(SIZE, SMOOTH) for s in (1.0, -1.0)}
    for (x, _), s in zip(rows, y, strict=True):
        counts[s][x] += 1
    ratio = np.log(counts[1.0] / (positive + 2 * SMOOTH)) - np.log(counts[-1.0] / (negative + 2 * SMOOTH))
    w, bias, alpha = np.zeros(SIZE), 0.0, np.zeros(len(rows))
    limit = COST * len(y) / (2 * np.where(y > 0, positive, negative))
    scaled = [ratio[x] * scales(x) for x, _ in rows]
    square = [r @ r + 1.0 for r in scaled]
    order = np.random.default_rng(SEED)
    for _ in range(PASSES):
        moved = 0.0
        for i in order.permutation(len(rows)):
            x, r = rows[i][0], scaled[i]
            gradient = y[i] * (w[x] @ r + bias) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), limit[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[x] += step * r
                bias += step
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-4:
            break
    w = (1 - TRUST) * np.abs(w).mean() + TRUST * w
    return calibrated(Model(w * ratio, bias, 1.0, 0.0), rows, y)


def calibrated(model: Model, rows: list, y: np.ndarray) -> Model:
    """A logistic curve over the training margins, by Newton steps towards smoothed targets."""
    z = np.array([model.margin(x) for x, _ in rows])
    n = (y > 0).sum()
    target = np.where(y > 0, (n + 1) / (n + 2), 1 / (len(y) - n + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -500, 500)))
        g = np.array([((p - target) * z).sum() + 1e-3 * (a - 1), (p - target).sum() + 1e-3 * b])
        q = p * (1 - p)
        h = np.array([[(q * z * z).sum() + 1e-3, (q * z).sum()], [(q * z).sum(), q.sum() + 1e-3]])
        d = np.clip(np.linalg.solve(h, g), -2, 2)
        a, b = a - d[0], b - d[1]
        if np.abs(d).max() < 1e-9:
            break
    model.slope, model.offset = float(a), float(b)
    return model


def train(documents: DataFrame, labels: DataFrame, text: str = "text", doc: str = "doc_id", label: str = "quality", held_out_mod: int | None = 3) -> Model:
    """Fits on labelled rows, without those whose crc32(id) mod 3 is 1."""
    known = picked(labels, _id=doc, _y=label).withColumn("_y", F.col("_y").cast("int")).filter("_id IS NOT NULL AND _y IN (0, 1)")
    if held_out_mod:
        known = known.filter(F.crc32(F.col("_id").cast("string")) % held_out_mod != 1)
    # a bounded choice of ids first, then of the rows that have them: both are cut before anything is collected
    chosen = known.distinct().orderBy(F.xxhash64("_id"), "_id", "_y").limit(MAX_TRAIN)
    texts = picked(documents, _id=doc, _text=text).join(F.broadcast(chosen), "_id")
    texts = texts.withColumn("_h", F.xxhash64("_id", "_y", "_text"))
    # the largest of the smallest MAX_TRAIN hashes; texts are left where they are
    top = texts.select("_h").distinct().orderBy("_h").limit(MAX_TRAIN).agg(F.max("_h")).first()[0]
    bounded = texts.filter(F.col("_h") <= F.lit(top).cast("long"))

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("_h"), batch.column("_id").cast(pa.string()), batch.column("_y"), pa.array([features(t.as_py()).tobytes() for t in batch.column("_text")], pa.binary())], names=["h", "id", "y", "x"])

    # rows that repeat have one hash and meet before they are collected
    rows = bounded.mapInArrow(run, "h long, id string, y int, x binary").dropDuplicates(["h"]).collect()
    rows.sort(key=lambda r: (len(r.id), r.id, r.y, bytes(r.x)))
    return fit([(np.frombuffer(r.x, np.int32), r.y) for r in rows])


RESULTS = ("score", "predicted")


def score(documents: DataFrame, model: Model, text: str = "text", keep_text: bool = False) -> DataFrame:
    """Adds score and predicted to each row."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    rows, columns = aside(documents, text, RESULTS, keep_text)
    names = carried(rows, "_text")
    schema = schema_with(rows, names, "score double, predicted int")

    def run(batches):
        own = shared.value
        for batch in batches:
            values = [own.score(t.as_py()) for t in batch.column("_text")]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(values, pa.float64()), pa.array([int(v >= 0.5) for v in values], pa.int32())], names=schema.names)

    return rows.mapInArrow(run, schema).select(*columns, *RESULTS)


def op9_quality_nbsvm(spark, sf_dir: str) -> DataFrame:
    from .common import read

    documents = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(documents, read(spark, sf_dir, "labels"))
    out = score(documents, model)
    return out.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 3 == 1).alias("held_out"), "score", "predicted")
