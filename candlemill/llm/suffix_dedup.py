"""Removal of repeated 200-byte strings by blockwise suffix sorting.

A byte goes if a DEPTH-byte string that covers it also starts anywhere else, same document included.

Buckets. In each string of DEPTH bytes the K-gram with the smallest hash, the rightmost at ties, is its
anchor; neighbouring positions with the same anchor form a run. Equal strings have equal anchors at equal
offsets, so the suffixes that start in runs of one anchor are one bucket, and suffixes of different
buckets never match. Anchors that occur once are done with after one count; runs that have
the same bytes as another run repeat as a whole. Of each distinct run in a bucket one goes on.

Sorting. Buckets are sorted one block at a time. A suffix is compared by its first and last PERIOD bytes
and, between them, by the rank of the cover sample inside it: the strings of DEPTH - PERIOD bytes at every
PERIOD-th offset from the anchor, ranked once for the block. A difference cover gives any two suffixes a
common offset at which both are sampled; as suffixes of a bucket can only match at the same distance from
the anchor, a cover of one residue does. Ties of any length thus end after one rank, and a block holds
BLOCK_RUNS runs of a few hundred bytes. Neighbours that agree in all keys are equal strings.

Buckets with more than BUCKET_LIMIT distinct runs are not gathered: each of their positions becomes a row
with a 128-bit hash of its string, counted where it is (the rest of such a bucket is exact up to hashes).

Null and empty texts: nothing to remove. Long texts are taken whole. Rows are known by a hash of doc_id and text;
rows that repeat share it, so each loses what repeats within its own text or in other rows. Null doc_ids are like
others. Empty table: no rows. Extra columns are not returned.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gram_hashes, parallelism, picked, prepare

DEPTH, K, PERIOD = 200, 64, 24
BLOCK_RUNS, BUCKET_LIMIT = 2000, 4096


def anchors(hashes: np.ndarray, w: int) -> np.ndarray:
    """For each window of w hashes the place of its minimum, the rightmost at ties."""
    best, at, width, done, out = hashes, np.arange(len(hashes), dtype=np.int32), 1, 0, None
    while True:
        if w & width:
            if out is None:
                out, out_at = best, at
            else:
                m = min(len(out), len(best) - done)
                right = best[done : done + m] <= out[:m]
                out, out_at = np.where(right, best[done : done + m], out[:m]), np.where(right, at[done : done + m], out_at[:m])
            done += width
        if done == w:
            return out_at[: len(hashes) - w + 1]
        m = len(best) - width
        right = best[width:] <= best[:m]
        best, at = np.where(right, best[width:], best[:m]), np.where(right, at[width:], at[:m])
        width *= 2


def runs_of(data: bytes, depth: int, k: int):
    """Anchor hash, first position, length and offset of the anchor from the first position, of each run."""
    grams = gram_hashes(np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1), k)
    at = anchors(grams, depth - k + 1)
    new = np.ones(len(at), bool)
    new[1:] = at[1:] != at[:-1]
    starts = np.flatnonzero(new)
    return grams[at[starts]].view(np.int64), starts, np.diff(np.append(starts, len(at))), at[starts] - starts


def runs(keyed: DataFrame, depth: int = DEPTH, k: int = K) -> DataFrame:
    """(anchor, chunk, row, start, shape): chunk is a hash of a run's bytes, shape packs length and anchor offset."""

    def run(batches):
        for batch in batches:
            columns = [[], [], [], [], []]
            for key, t in zip(batch.column("_key").to_pylist(), batch.column("_text"), strict=True):
                data = (t.as_py() or "").encode()
                if len(data) < depth:
                    continue
                a, starts, sizes, offsets = runs_of(data, depth, k)
                columns[0].append(a)
                columns[1].append(np.array([xxhash.xxh3_64_intdigest(data[s : s + n + depth - 1]) for s, n in zip(starts.tolist(), sizes.tolist(), strict=True)], np.uint64).view(np.int64))
                columns[2].append(np.full(len(a), key, np.int64))
                columns[3].append(starts.astype(np.int32))
                columns[4].append((sizes * depth + offsets).astype(np.int32))
            if columns[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], names=["anchor", "chunk", "row", "start", "shape"])

    return keyed.mapInArrow(run, "anchor long, chunk long, row long, start int, shape int")


def sort_block(bucket: np.ndarray, chunks: list[bytes], sizes: np.ndarray, offsets: np.ndarray, depth: int = DEPTH, k: int = K, period: int = PERIOD) -> tuple[np.ndarray, np.ndarray]:
    """(index of run, offset in it) of the suffixes that match another one of their bucket in depth bytes."""
    m, w = len(chunks), depth - k + 1
    wide = w - 1 + depth + period
    grid = np.zeros((m, wide + (-wide) % 8), np.uint8)  # all runs of the block, their anchors in one column
    left = w - 1 - offsets
    for i, c in enumerate(chunks):
        grid[i, left[i] : left[i] + len(c)] = np.frombuffer(c, np.uint8)
    inner = depth - period
    # ranks of the cover sample, for the block once
    ranks = np.zeros((m, w // period + 2), np.int64)
    for j in range(ranks.shape[1]):
        part = grid[:, j * period : j * period + inner]
        if part.shape[1] == inner:
            ranks[:, j] = np.unique(np.ascontiguousarray(part).view(f"V{inner}").ravel(), return_inverse=True)[1].ravel()
    row = np.repeat(np.arange(m), sizes)
    inside = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    column = left[row] + inside
    sample = ranks[row, -(-column // period)]
    words = [bucket[row], column, sample]
    for at in (0, 8, 16, inner, inner + 8, inner + 16):
        piece = grid[row[:, None], column[:, None] + (at + np.arange(8))]
        words.append(np.ascontiguousarray(piece).view(np.int64).ravel())
    order = np.lexsort(words[::-1])
    same = np.ones(len(order) - 1, bool) if len(order) else np.empty(0, bool)
    for x in words:
        same &= x[order[1:]] == x[order[:-1]]
    hit = np.zeros(len(order), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    return row[hit], inside[hit]


def _joined(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending places as starts and lengths of unbroken stretches."""
    new = np.ones(len(places), bool)
    new[1:] = places[1:] != places[:-1] + 1
    starts = np.flatnonzero(new)
    return places[starts], np.diff(np.append(starts, len(places)))


def repeated(keyed: DataFrame, depth: int = DEPTH, k: int = K) -> DataFrame:
    """(row, start, size): positions start .. start + size - 1 begin strings that also start elsewhere."""
    n = parallelism(keyed.sparkSession)
    every = runs(keyed, depth, k)
    size = F.floor(F.col("shape") / depth).cast("int")
    # counts are added up before the shuffle, so a frequent anchor is one row from each task
    often = every.select("anchor").groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor")
    # what is left is a small part of all runs; each later step reads it from here
    alive = every.join(often, "anchor", "left_semi").checkpoint()
    kinds = alive.groupBy("anchor", "chunk").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("row", "start", "shape")).alias("one"))
    copied = alive.join(kinds.filter("copies > 1").select("anchor", "chunk"), ["anchor", "chunk"], "left_semi").select("row", "start", size.alias("size"))
    # one run of each kind, with its bucket's number of kinds; a kind alone in its bucket is done with
    wide = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")
    ones = kinds.select("anchor", "one.*").join(wide, "anchor")
    # a document's own runs are gathered, which its text bounds
    asked = ones.groupBy("row").agg(F.collect_list(F.struct("anchor", "start", "shape", (F.col("kinds") > BUCKET_LIMIT).alias("far"))).alias("asked"))
    texts = keyed.join(asked.withColumnRenamed("row", "_key"), "_key")

    def cut(far: bool):
        def run(batches):
            for batch in batches:
                out = [[], [], [], [], []]
                for key, t, asked in zip(batch.column("_key").to_pylist(), batch.column("_text"), batch.column("asked").to_pylist(), strict=True):
                    data = (t.as_py() or "").encode()
                    for x in asked:
                        if x["far"] != far:
                            continue
                        s, size, offset = x["start"], x["shape"] // depth, x["shape"] % depth
                        if far:
                            for p in range(s, s + size):
                                h = xxhash.xxh3_128_intdigest(data[p : p + depth])
                                for c, v in zip(out, ((h >> 64) - (1 << 63), key, p, (h & (1 << 64) - 1) - (1 << 63), None), strict=True):
                                    c.append(v)
                        else:
                            for c, v in zip(out, (x["anchor"], key, s, size * depth + offset, data[s : s + size + depth - 1]), strict=True):
                                c.append(v)
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["bucket", "row", "start", "more", "bytes"])

        return texts.mapInArrow(run, "bucket long, row long, start int, more long, bytes binary")

    def resolve(batches):
        held: list[tuple] = []

        def block(rows):
            bucket, keys, starts, more, chunks = zip(*rows, strict=True)
            more = np.array(more)
            i, inside = sort_block(np.array(bucket, np.int64), list(chunks), more // depth, more % depth, depth, k)
            keys, starts = np.array(keys, np.int64), np.array(starts, np.int64)
            # runs lie apart in this numbering, so stretches never join two of them
            places, sizes = _joined(i * (2 * depth) + inside)
            j = places // (2 * depth)
            return pa.RecordBatch.from_arrays([pa.array(keys[j]), pa.array((starts[j] + places % (2 * depth)).astype(np.int32)), pa.array(sizes.astype(np.int32))], names=["row", "start", "size"])

        for batch in batches:
            held += zip(*(batch.column(c).to_pylist() for c in ("bucket", "row", "start", "more", "bytes")), strict=True)
            if len(held) >= BLOCK_RUNS:
                cut_at = len(held)
                while cut_at and held[cut_at - 1][0] == held[-1][0]:
                    cut_at -= 1
                if cut_at:
                    yield block(held[:cut_at])
                    held = held[cut_at:]
        if held:
            yield block(held)

    schema = "row long, start int, size int"
    near = cut(False).repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(resolve, schema)
    places = cut(True)
    again = places.groupBy("bucket", "more").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    far = places.join(again.drop("n"), ["bucket", "more"], "left_semi").select("row", "start", F.lit(1).alias("size"))
    return copied.unionByName(near).unionByName(far)


def keys(documents: DataFrame, text: str = "text", doc: str = "doc_id") -> DataFrame:
    return picked(documents, doc_id=doc, _text=text).withColumn("_key", F.xxhash64("doc_id", "_text"))


def removed(documents: DataFrame, text: str = "text", doc: str = "doc_id", depth: int = DEPTH, k: int = K, with_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with_text, kept (bytes) of each document."""
    prepare(documents.sparkSession)
    keyed = keys(documents, text, doc)
    spans = repeated(keyed, depth, k).groupBy("row").agg(F.collect_list(F.struct("start", "size")).alias("spans"))
    joined = keyed.join(spans.withColumnRenamed("row", "_key"), "_key", "left")
    id_type = keyed.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            out = [[], [], [], [], []]
            for t, spans in zip(batch.column("_text"), batch.column("spans").to_pylist(), strict=True):
                data = (t.as_py() or "").encode()
                kept, lost, count, end = [], 0, 0, 0
                last = -1
                for s, size in sorted((x["start"], x["size"]) for x in spans or ()):
                    stop = s + size - 1 + depth
                    if s > last:
                        kept.append(data[end:s])
                        count += 1
                        lost += stop - s
                        end = last = stop
                    elif stop > last:
                        lost += stop - last
                        end = last = stop
                kept.append(data[end:])
                rest = b"".join(kept)
                for c, v in zip(out, (len(data), lost, count, hashlib.sha256(rest).hexdigest(), rest), strict=True):
                    c.append(v)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()][: 4 + with_text]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(out, kinds)]], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + with_text])

    return joined.mapInArrow(run, f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)


def op4_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    from .common import read

    return removed(read(spark, sf_dir, "documents"), with_text=False)
