"""Benchmark decontamination by winnowing.

Test items are numbered words; every 13 consecutive words of an item are a window (a shorter item is one
window). Both sides are reduced to fingerprints: the minimum hash of K-grams in each run of W K-grams,
where K + W - 1 = 13, so whatever shares 13 words shares a fingerprint. Training fingerprints are joined
with the test fingerprints, and each hit is extended over the windows around it, which are then compared
word by word: hashes only find places, they decide nothing. Items shorter than 13 words are found by
their whole hash.

The test set is taken in blocks of at most BLOCK_WORDS words (a proven bound for what is broadcast); each
block passes over all documents, and the results of the blocks are merged by document.

Null or empty text: no words, not contaminated. Items without words match nothing. Rows that repeat a
doc_id are judged each for itself, items that repeat count once. Long texts are taken whole. Empty tables: no
rows, or no hits. Extra columns of documents are kept by ``flag``; those with the name of a result are replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, WORD, aside, carried, gram_hashes, picked, prepare, schema_with, window_min_positions

WINDOW, K = 13, 7
W = WINDOW - K + 1
BLOCK_WORDS = 1_000_000
#: Word number of what the test set lacks; such a word is in no window.
NONE = -1


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(ASCII_LOWER))


class Block:
    """Windows and fingerprints of some test items."""

    def __init__(self, items: list[tuple[object, list[str]]]):
        self.vocabulary: dict[str, int] = {}
        number = self.vocabulary.setdefault
        kinds: dict[tuple[int, ...], int] = {}  # distinct windows
        holders: list[set] = []
        self.short: dict[int, dict[tuple[int, ...], int]] = {}
        for item, words in items:
            ids = [number(w, len(self.vocabulary)) for w in words]
            if not ids:
                continue
            size = min(WINDOW, len(ids))
            for i in range(len(ids) - size + 1):
                window = tuple(ids[i : i + size])
                kind = kinds.setdefault(window, len(kinds))
                if kind == len(holders):
                    holders.append(set())
                holders[kind].add(item)
                if size < WINDOW:
                    self.short.setdefault(size, {})[window] = kind
        self.holders = [sorted(map(str, h)) for h in holders]
        self.windows = kinds
        long = [w for w in kinds if len(w) == WINDOW]
        # the fingerprint of a window is the minimum of its W K-grams, the rightmost at ties
        if long:
            flat = np.array(long, np.int64).reshape(-1)
            grams = gram_hashes(flat + 2, K)
            starts = np.arange(len(long)) * WINDOW
            self.prints = np.unique(grams[starts[:, None] + np.arange(W)].min(axis=1))
        else:
            self.prints = np.empty(0, np.uint64)
        self.short_hashes = {n: np.unique(np.concatenate([gram_hashes(np.array(w, np.int64) + 2, n) for w in ws])) for n, ws in self.short.items()}

    def numbers(self, words: list[str]) -> np.ndarray:
        get = self.vocabulary.get
        return np.fromiter((get(w, NONE) for w in words), np.int64, len(words))

    def occurrences(self, ids: np.ndarray) -> list[tuple[int, int, int]]:
        """(place, length, kind) of every window that occurs in one sequence of word numbers."""
        found: list[tuple[int, int, int]] = []
        if len(ids) >= WINDOW and len(self.prints):
            places = self._hits(ids)
            if len(places):
                # a window that holds the K-gram at p starts at p - W + 1 .. p
                starts = np.unique((places[:, None] - np.arange(W)).ravel())
                starts = starts[(starts >= 0) & (starts <= len(ids) - WINDOW)]
                for s in starts.tolist():
                    kind = self.windows.get(tuple(ids[s : s + WINDOW].tolist()))
                    if kind is not None:
                        found.append((s, WINDOW, kind))
        for n, hashes in self.short_hashes.items():
            if len(ids) >= n:
                grams = gram_hashes(ids + 2, n)
                for s in np.flatnonzero(_member(grams, hashes)).tolist():
                    kind = self.short[n].get(tuple(ids[s : s + n].tolist()))
                    if kind is not None:
                        found.append((s, n, kind))
        return found

    def _hits(self, ids: np.ndarray) -> np.ndarray:
        """Places of the sequence's own fingerprints that are test fingerprints too."""
        grams = gram_hashes(ids + 2, K)
        chosen = window_min_positions(grams, W)
        return chosen[_member(grams[chosen], self.prints)]


def _member(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(x), bool)
    at = np.searchsorted(table, x)
    at[at == len(table)] = 0
    return table[at] == x


def _blocks(benchmark: DataFrame, item: str, text: str):
    """Test items in blocks of bounded size, streamed to the driver one partition at a time."""
    block, size = [], 0
    for row in picked(benchmark, item=item, text=text).toLocalIterator():
        words = words_of(row[1])
        if block and size + len(words) > BLOCK_WORDS:
            yield block
            block, size = [], 0
        block.append((row[0], words))
        size += len(words)
    yield block


def hits(rows: DataFrame, block: list, final: bool = False, keep_text: bool = False) -> DataFrame:
    """The columns but _text, with _n_words, _spans (maximal hit runs [start, end), flat) and _items of one
    block of test items; with final, what ``judged`` makes of them instead."""
    shared = rows.sparkSession.sparkContext.broadcast(Block(block))
    names = carried(rows, "_text")
    schema = schema_with(rows, names, ", ".join(f"{k} {v}" for k, v in VERDICT.items()) if final else "_n_words bigint, _spans array<int>, _items array<string>")

    def run(batches):
        test = shared.value
        for batch in batches:
            lists = [words_of(t.as_py()) for t in batch.column("_text")]
            spans, items = scan_batch(test, lists)
            columns, sizes = [batch.column(c) for c in names], [len(x) for x in lists]
            if final:
                columns += judged(sizes, spans, items)
            else:
                columns += [pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(run, schema)


VERDICT = {"n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items": "array<string>", "items_sha256": "string", "contaminated": "boolean"}


def judged(n_words: list[int], spans: list[list[int]], items: list[list[str]]) -> list[pa.Array]:
    """Columns of VERDICT; spans of several blocks may overlap."""
    hit = []
    for flat in spans:
        total, end = 0, 0
        for a, b in sorted(zip(flat[::2], flat[1::2], strict=True)):
            total += max(0, b - max(a, end))
            end = max(end, b)
        hit.append(total)
    return [
        pa.array(n_words, pa.int64()),
        pa.array(hit, pa.int64()),
        pa.array([len(x) for x in items], pa.int64()),
        pa.array(items, pa.list_(pa.string())),
        pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], pa.string()),
        pa.array([h > 0 and 20 * h >= n for h, n in zip(hit, n_words, strict=True)], pa.bool_()),
    ]


def scan_batch(block: Block, lists: list[list[str]]) -> tuple[list[list[int]], list[list[str]]]:
    """Hit spans and items of several documents. Fingerprints are taken over all of them at once."""
    gap = WINDOW
    sizes = np.array([len(x) for x in lists], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + gap)[:-1]]) if len(lists) else np.empty(0, np.int64)
    flat = np.full(int((sizes + gap).sum()), NONE, np.int64)
    for s, words in zip(starts.tolist(), lists, strict=True):
        flat[s : s + len(words)] = block.numbers(words)
    spans, items = [[] for _ in lists], [[] for _ in lists]
    near: set[int] = set()
    if len(block.prints) and len(flat) >= K:
        near.update((np.searchsorted(starts, block._hits(flat), "right") - 1).tolist())
    for n, hashes in block.short_hashes.items():
        if len(flat) >= n:
            near.update((np.searchsorted(starts, np.flatnonzero(_member(gram_hashes(flat + 2, n), hashes)), "right") - 1).tolist())
    for d in sorted(near):
        ids = flat[starts[d] : starts[d] + sizes[d]]
        found = sorted(block.occurrences(ids))
        runs: list[int] = []
        for s, n, _ in found:
            if runs and s <= runs[-1]:
                runs[-1] = max(runs[-1], s + n)
            else:
                runs += [s, s + n]
        spans[d] = runs
        items[d] = sorted({i for kind in {k for *_, k in found} for i in block.holders[kind]})
    return spans, items


def flag(documents: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", keep_text: bool = False) -> DataFrame:
    """One row for each document: its other columns (with keep_text the text too), n_words, n_hit, n_items, items,
    items_sha256, contaminated."""
    prepare(documents.sparkSession)
    rows, columns = aside(documents, text, tuple(VERDICT), keep_text)
    blocks = _blocks(benchmark, item, item_text)
    block, following = next(blocks), next(blocks, None)
    if following is None:
        return hits(rows, block, final=True).select(*columns, *VERDICT)
    # several blocks: only a row's number and its few hits are merged; the other columns meet them once at the end
    numbered = rows.withColumn("_row", F.monotonically_increasing_id()).checkpoint()
    narrow = numbered.select("_row", "_text")
    found = hits(narrow, block)
    while following is not None:
        # of the blocks after the first only documents with hits tell anything
        found, following = found.unionByName(hits(narrow, following).filter("size(_spans) > 0")), next(blocks, None)
    merged = found.groupBy("_row").agg(
        F.max("_n_words").alias("_n_words"),
        F.flatten(F.collect_list("_spans")).alias("_spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("_items")))).alias("_items"),
    )
    schema = schema_with(merged, ["_row"], ", ".join(f"{k} {v}" for k, v in VERDICT.items()))

    def finish(batches):
        for batch in batches:
            verdict = judged(*(batch.column(c).to_pylist() for c in ("_n_words", "_spans", "_items")))
            yield pa.RecordBatch.from_arrays([batch.column("_row"), *verdict], names=schema.names)

    return numbered.drop("_text").join(merged.mapInArrow(finish, schema), "_row").select(*columns, *VERDICT)


def op2_decontamination(spark, sf_dir: str) -> DataFrame:
    from .common import read

    documents = read(spark, sf_dir, "documents").select("doc_id", "text")
    return flag(documents, read(spark, sf_dir, "benchmark")).drop("items")
