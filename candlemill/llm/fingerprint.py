"""Document fingerprints by winnowing.

Rolling hashes of every K bytes; of each W consecutive hashes the minimum is chosen, the rightmost at
ties, and its position is kept. Any match of K + W - 1 bytes shares a chosen hash, wherever it stands.
A text of fewer than K bytes is one gram. The likeness of two fingerprints is the share of their
distinct hashes that both have (1 for two empty texts).

``passages`` uses the positions: from each hash that two texts share it grows the match around its places as
far as the bytes agree.

``edited_pairs`` puts each document beside the next one in descending order of doc_id: ranges of (doc_id, text
hash) hold neighbouring documents; the first document of each range is also sent to the range before it, so
that each range is streamed once and only the document read last is kept. Ids may be of any type with an order.

Null text: as empty, with an empty fingerprint. Documents with the same doc_id follow by their text's
hash; null doc_ids come last. One document alone is its own next one. Empty table: no rows. Long texts are
taken whole. Extra columns do not take part in ``edited_pairs`` and stay in ``winnowed``, save those with the
name of a result, which are replaced.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import aside, carried, gram_hashes, parallelism, picked, prepare, schema_with, window_min_positions

K, W = 12, 32


def winnow(text: str | None, k: int = K, w: int = W) -> tuple[np.ndarray, np.ndarray]:
    """Chosen hashes (32 bits) and their byte positions."""
    data = np.frombuffer((text or "").encode(), np.uint8)
    if not len(data):
        return np.empty(0, np.uint32), np.empty(0, np.int64)
    grams = gram_hashes(data.astype(np.uint64) + np.uint64(1), min(k, len(data)))
    at = window_min_positions(grams, w)
    return (grams[at] >> np.uint64(32)).astype(np.uint32), at


def encoded(hashes: np.ndarray) -> str:
    """The fingerprint as text: all chosen hashes in order."""
    return base64.b64encode(hashes.astype("<u4").tobytes()).decode()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    a, b = np.unique(a), np.unique(b)
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _agreeing(a: bytes, b: bytes) -> int:
    """Length of the common beginning."""
    n, step = 0, 64
    while a[n : n + step] == b[n : n + step] and n < min(len(a), len(b)):
        n = min(n + step, len(a), len(b))
        step *= 2
    rest = min(len(a), len(b), n + step) - n
    if rest <= 0:
        return n
    same = np.frombuffer(a, np.uint8, rest, n) == np.frombuffer(b, np.uint8, rest, n)
    return n + (rest if same.all() else int(same.argmin()))


def passages(a: str | None, b: str | None, own: tuple, other: tuple) -> list[tuple[int, int, int]]:
    """(place in a, place in b, bytes) of the matches around the first places of hashes that both texts chose.
    A passage of K + W - 1 bytes that occurs once in each text is always among them."""
    both, i, j = np.intersect1d(own[0], other[0], return_indices=True)
    if not len(both):
        return []
    x, y, out = (a or "").encode(), (b or "").encode(), []
    for p, q in sorted(zip(own[1][i].tolist(), other[1][j].tolist(), strict=True)):
        if any(s <= p < s + n and p - s == q - t for s, t, n in out[-4:]):
            continue
        left = _agreeing(x[:p][::-1], y[:q][::-1])
        size = left + _agreeing(x[p:], y[q:])
        if size:
            out.append((p - left, q - left, size))
    return out


def winnowed(documents: DataFrame, text: str = "text", k: int = K, w: int = W) -> DataFrame:
    """All columns but the text's, with hashes and positions of its fingerprint."""
    rows, columns = aside(documents, text, ("hashes", "positions"))
    names = carried(rows, "_text")
    schema = schema_with(rows, names, "hashes array<bigint>, positions array<bigint>")

    def run(batches):
        for batch in batches:
            prints = [winnow(t.as_py(), k, w) for t in batch.column("_text")]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array([p[0].astype(np.int64) for p in prints], pa.list_(pa.int64())), pa.array([p[1] for p in prints], pa.list_(pa.int64()))], names=schema.names)

    return rows.mapInArrow(run, schema).select(*columns, "hashes", "positions")


PAIR = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, positions array<int>, longest_next long"


def edited_pairs(documents: DataFrame, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of each document,
    with the byte positions of its fingerprint and the longest passage (bytes) known to be in the next one too."""
    spark = documents.sparkSession
    prepare(spark)
    n = parallelism(spark)
    # the complement of the hash: ascending order here is the wanted order backwards
    rows = picked(documents, doc_id=doc, text=text).withColumn("tie", F.bitwise_not(F.xxhash64("text")))
    narrow = rows.select("doc_id", "tie").repartitionByRange(n, F.col("doc_id").asc_nulls_first(), F.col("tie"))
    tops = narrow.groupBy(F.spark_partition_id().alias("_part")).agg(F.max(F.struct(F.col("doc_id").isNotNull().alias("a"), "doc_id", "tie")).alias("top"))
    # the last row of each range: one for each partition
    bounds = sorted([(r.top.a, r.top.doc_id if r.top.a else 0, r.top.tie) for r in tops.collect()])
    last = len(bounds) - 1

    @F.pandas_udf("struct<part int, guest int>")
    def place(ids: pd.Series, missing: pd.Series, ties: pd.Series) -> pd.DataFrame:
        at, guest = [], []
        for i, none, t in zip(ids.tolist(), missing.tolist(), ties.tolist(), strict=True):
            key = (False, 0, t) if none else (True, i, t)
            p = bisect_left(bounds, key)
            at.append(p)
            # the first document of a range, in descending order, follows the last one of the range above it
            guest.append(((p + 1) if p < last else 0) if bounds[p] == key else -1)
        return pd.DataFrame({"part": pd.Series(at, dtype="int32"), "guest": pd.Series(guest, dtype="int32")})

    # no null reaches pandas, which would make doubles of large ids
    some = F.coalesce("doc_id", F.lit(bounds[-1][1] if bounds else 0).cast(rows.schema["doc_id"].dataType))
    tagged = rows.withColumn("at", place(some, F.col("doc_id").isNull(), "tie"))
    both = F.array(F.struct(F.col("at.part").alias("part"), F.lit(False).alias("guest")), F.struct(F.col("at.guest").alias("part"), F.lit(True).alias("guest")))
    sent = tagged.select("doc_id", "text", "tie", F.inline(both)).filter("part >= 0")
    ordered = sent.repartitionById(max(1, len(bounds)), F.col("part")).sortWithinPartitions("part", "guest", F.col("doc_id").desc_nulls_last(), F.col("tie").desc())
    schema = schema_with(rows, ["doc_id"], PAIR)
    kind = to_arrow_type(schema["doc_id"].dataType)

    def run(batches):
        held = None
        done = set()
        for batch in batches:
            out = []
            for d, t, part, guest in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "part", "guest")), strict=True):
                if guest and part in done:
                    continue  # only the first guest is the next document of the range's last
                t = t or ""
                now = (d, t, part, winnow(t))
                if held is not None and held[2] == part:
                    out.append(_edited(held, now))
                held = None if guest else now
                if guest:
                    done.add(part)
            yield _batch(out, kind)

    return ordered.mapInArrow(run, schema)


def _edited(own, following) -> tuple:
    doc, text, _, chosen = own
    half = len(text) // 2
    edited = text[: len(text) - half] + following[1][:half] if half else text
    other = winnow(edited)[0]
    longest = max((size for *_, size in passages(text, following[1], chosen, following[3])), default=0)
    return doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), encoded(chosen[0]), encoded(other), likeness(chosen[0], other), likeness(chosen[0], following[3][0]), chosen[1], longest


def _batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    names = ["doc_id", *(x.split()[0] for x in PAIR.split(", "))]
    kinds = [kind, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.list_(pa.int32()), pa.int64()]
    columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)


def op6_winnow_fingerprints(spark, sf_dir: str) -> DataFrame:
    from .common import read

    return edited_pairs(read(spark, sf_dir, "documents"))
