"""Line dedup: range-partitioned line hashes, first occurrences streamed, keep bitmaps returned.

A line's key is the line stripped of blanks and U+0009 to U+000D and with A-Z lower-cased. Keys of at
least ``min_chars`` code points that occur in at least ``min_docs`` documents lose all their lines, save
those in the largest doc_id that holds the key. Rows (hash, doc_id, position) are range-partitioned by
hash and document and sorted, the largest document first, so that each key's first rows are those that
stay. A frequent key may span partitions: every partition tells the count and first document of its first
and last key (two rows for each partition), and a second pass streams the rows with those in hand. No key
is gathered in one place.

The hash of a key has 128 bits. Null and empty texts have one empty line, which stays. Rows that repeat a
doc_id count as one document, and each loses lines of its own text. Null doc_ids: such rows keep all their
lines and count for nothing. Ids that are no whole numbers are numbered in their order first. Long texts are split whole. Extra columns pass through ``apply_bitmaps``; those with
the name of a result are replaced by it.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import ASCII_LOWER, aside, carried, parallelism, picked, prepare, schema_with, settled, with_rank

BLANK = " \t\n\x0b\x0c\r"
MIN_CHARS, MIN_DOCS = 40, 5
ROW = np.dtype([("hi", "<i8"), ("lo", "<i8"), ("doc", "<i8")])


def line_hashes(documents: DataFrame, text: str = "text", doc: str = "doc_id", min_chars: int = MIN_CHARS) -> DataFrame:
    """(hi, lo, doc_id, row, position) of every line that is long enough; row: Spark's xxhash64 of the whole text."""
    kept = picked(documents, _doc=doc, _text=text).filter("_doc IS NOT NULL AND length(_text) > 0")

    def run(batches):
        for batch in batches:
            hi, lo, docs, rows, positions = [], [], [], [], []
            for d, t in zip(batch.column("_doc").to_pylist(), batch.column("_text"), strict=True):
                t = t.as_py()
                row = None
                for i, line in enumerate(t.split("\n")):
                    key = line.strip(BLANK)
                    if len(key) >= min_chars:
                        if row is None:
                            row = xxhash.xxh64_intdigest(t.encode(), 42)
                            row -= (row >> 63) << 64
                        h = xxhash.xxh3_128_intdigest(key.translate(ASCII_LOWER).encode())
                        hi.append((h >> 64) - (1 << 63))
                        lo.append((h & (1 << 64) - 1) - (1 << 63))
                        docs.append(d)
                        rows.append(row)
                        positions.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (hi, lo, docs, rows)] + [pa.array(positions, pa.int32())], names=["hi", "lo", "doc_id", "row", "position"])

    return kept.mapInArrow(run, "hi long, lo long, doc_id long, row long, position int")


def _groups(hi: np.ndarray, lo: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted rows: where each key starts, its number of distinct documents, its first document."""
    new_key = np.ones(len(hi), bool)
    new_key[1:] = (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])
    new_doc = new_key.copy()
    new_doc[1:] |= docs[1:] != docs[:-1]
    starts = np.flatnonzero(new_key)
    return starts, np.add.reduceat(new_doc.astype(np.int64), starts) if len(starts) else starts, docs[starts]


def dropped_lines(hashes: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, row, position) of the lines that go."""
    spark = hashes.sparkSession
    order = [F.col("hi"), F.col("lo"), F.col("doc_id").desc()]
    ranged = hashes.repartitionByRange(parallelism(spark), *order).sortWithinPartitions(*order, "position").checkpoint()

    def edges(batches):
        """The first and the last key of the partition with their documents: a running state, no rows kept."""
        first = last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            hi, lo, docs = (batch.column(c).to_numpy() for c in ("hi", "lo", "doc_id"))
            starts, counts, heads = _groups(hi, lo, docs)
            ends = np.append(starts[1:], len(hi)) - 1
            for k in {0, len(starts) - 1}:
                group = [int(hi[starts[k]]), int(lo[starts[k]]), int(counts[k]), int(heads[k]), int(docs[ends[k]])]
                if last is not None and last[:2] == group[:2] and k == 0:
                    last = [*last[:2], last[2] + group[2] - (last[4] == int(docs[0])), last[3], group[4]]
                    if first[:2] == last[:2]:
                        first = last
                else:
                    last = group
                    first = first or group
            # keys strictly inside a batch never matter here
        out = [] if first is None else [first[:4]] if first[:2] == last[:2] else [first[:4], last[:4]]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in (zip(*out) if out else [[]] * 4)], names=["hi", "lo", "n", "top"])

    # two rows for each partition at most; documents are never split between partitions, being range keys
    merged: dict[tuple[int, int], list[int]] = {}
    for r in ranged.mapInArrow(edges, "hi long, lo long, n long, top long").collect():
        x = merged.setdefault((r.hi, r.lo), [0, r.top])
        x[0] += r.n
        x[1] = max(x[1], r.top)
    shared = spark.sparkContext.broadcast(merged)

    def stream(batches):
        """Rows of a key arrive together; a key that ends a batch waits for the next one."""
        known = shared.value
        for table in _with_tail(batches):
            hi, lo, docs, rows, positions = table
            starts, counts, heads = _groups(hi, lo, docs)
            counts, heads = counts.copy(), heads.copy()
            for k in {0, len(starts) - 1} if len(starts) else ():
                if x := known.get((int(hi[starts[k]]), int(lo[starts[k]]))):
                    counts[k], heads[k] = x
            sizes = np.diff(np.append(starts, len(hi)))
            goes = np.repeat(counts >= min_docs, sizes) & (docs < np.repeat(heads, sizes))
            yield pa.RecordBatch.from_arrays([pa.array(docs[goes]), pa.array(rows[goes]), pa.array(positions[goes])], names=["doc_id", "row", "position"])

    def _with_tail(batches):
        """Batches cut at keys. A key longer than a batch is passed on in parts if its count is known already."""
        held, known = [], shared.value
        for batch in batches:
            part = [batch.column(c).to_numpy() for c in ("hi", "lo", "doc_id", "row", "position")]
            if not len(part[0]):
                continue
            hi, lo = part[:2]
            if held and hi[0] == hi[-1] == held[-1][0][-1] and lo[0] == lo[-1] == held[-1][1][-1]:
                held.append(part)  # still the same key
                continue
            if held:
                part, held = [np.concatenate(x) for x in zip(*held, part, strict=True)], []
            hi, lo = part[:2]
            if (int(hi[-1]), int(lo[-1])) in known:
                yield part
                continue
            cut = int(np.flatnonzero((hi != hi[-1]) | (lo != lo[-1]))[-1]) + 1 if (hi[0] != hi[-1] or lo[0] != lo[-1]) else 0
            held = [[x[cut:] for x in part]]
            if cut:
                yield [x[:cut] for x in part]
        if held:
            yield [np.concatenate(x) for x in zip(*held, strict=True)]

    return ranged.mapInArrow(stream, "doc_id long, row long, position int")


def keep_bitmaps(documents: DataFrame, text: str = "text", doc: str = "doc_id", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, row, keep) for the documents that lose lines: zlib of a bitmap with one bit for each line up
    to the last dropped one, 1 for kept lines; lines beyond it stay."""
    prepare(documents.sparkSession)
    rows = picked(documents, _doc=doc, _text=text)
    if not isinstance(rows.schema["_doc"].dataType, IntegralType):
        # ids of other types are numbered in their order
        ids = settled(with_rank(rows.select("_doc").filter("_doc IS NOT NULL").distinct(), ["_doc"], "_number"))
        found = keep_bitmaps(rows.join(ids, "_doc").select("_number", "_text"), "_text", "_number", min_chars, min_docs)
        return found.join(ids, F.col("doc_id") == F.col("_number")).select(F.col("_doc").alias("doc_id"), "row", "keep")
    dropped = dropped_lines(line_hashes(rows.withColumn("_doc", F.col("_doc").cast("long")), "_text", "_doc", min_chars), min_docs)

    def pack(positions):
        lost = np.array(sorted(set(positions)), np.int64)
        bits = np.ones((lost[-1] // 8 + 1) * 8, bool)  # whole bytes, filled up with kept lines
        bits[lost] = False
        return zlib.compress(np.packbits(bits).tobytes())

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array([pack(x) for x in batch.column("positions").to_pylist()], pa.binary())], names=["doc_id", "row", "keep"])

    # a document's own lines are gathered, which its text bounds
    return dropped.groupBy("doc_id", "row").agg(F.collect_set("position").alias("positions")).mapInArrow(run, "doc_id long, row long, keep binary")


def kept_lines(text: str, bitmap: bytes | None) -> tuple[list[str], int]:
    """The lines that stay and the number of all lines."""
    lines = text.split("\n")
    if bitmap is None:
        return lines, len(lines)
    bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8))
    return [x for i, x in enumerate(lines) if i >= len(bits) or bits[i]], len(lines)


RESULTS = ("n_lines", "n_dropped", "kept_sha256")


def apply_bitmaps(documents: DataFrame, bitmaps: DataFrame, text: str = "text", doc: str = "doc_id", digest: bool = False) -> DataFrame:
    """Documents with the text that is left; with digest n_lines, n_dropped and kept_sha256 instead, which replace
    columns of these names."""
    rows, columns = aside(documents, text, RESULTS if digest else (), _doc=doc)
    rows = rows.withColumn("_row", F.xxhash64("_text"))
    small = bitmaps.select(F.col("doc_id").alias("_doc"), F.col("row").alias("_row"), F.col("keep").alias("_bitmap"))
    # a doc_id may stand with several texts: each row meets its own text's bitmap, once at most
    joined = rows.join(small, ["_doc", "_row"], "left")
    names = carried(joined, "_text", "_doc", "_row", "_bitmap")
    schema = schema_with(joined, names, "n_lines long, n_dropped long, kept_sha256 string" if digest else "_left string")

    def run(batches):
        for batch in batches:
            texts, totals, lost, hashes = [], [], [], []
            for t, keep in zip(batch.column("_text"), batch.column("_bitmap").to_pylist(), strict=True):
                t = t.as_py()
                lines, n = kept_lines(t or "", keep)
                out = "\n".join(lines)
                if digest:
                    totals.append(n)
                    lost.append(n - len(lines))
                    hashes.append(hashlib.sha256(out.encode()).hexdigest())
                else:
                    texts.append(None if t is None else out)
            own = [batch.column(c) for c in names]
            if digest:
                own += [pa.array(totals, pa.int64()), pa.array(lost, pa.int64()), pa.array(hashes, pa.string())]
            else:
                own.append(pa.array(texts, pa.string()))
            yield pa.RecordBatch.from_arrays(own, names=schema.names)

    out = joined.mapInArrow(run, schema)
    if digest:
        return out.select(*columns, *RESULTS)
    place = documents.columns.index(text)
    return out.select(*columns[:place], F.col("_left").alias(text), *columns[place:])


def dedup(documents: DataFrame, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """Documents without the repeated lines; columns stay. Texts stay null where they were null."""
    return apply_bitmaps(documents, keep_bitmaps(documents, text, doc), text, doc)


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    from .common import read

    documents = read(spark, sf_dir, "documents").select("doc_id", "text")
    return apply_bitmaps(documents, keep_bitmaps(documents), digest=True)


SQL = r"""
WITH lines AS (
  SELECT doc_id, i, line, lower_key FROM (
    SELECT doc_id, generate_subscripts(parts, 1) AS i, unnest(parts) AS line,
           translate(trim(unnest(parts), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_key
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))),
hot AS (SELECT lower_key, max(doc_id) AS top FROM lines WHERE length(lower_key) >= 40 GROUP BY lower_key HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT l.*, h.top IS NOT NULL AND l.doc_id < h.top AS goes FROM lines l LEFT JOIN hot h USING (lower_key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE goes) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT goes), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
