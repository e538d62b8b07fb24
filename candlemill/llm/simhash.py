"""SimHash near-dedup with pigeonring filtering.

A fingerprint has 64 bits: each is set if it is set in more than half the hashes of a text's shingles.
Two fingerprints link if they differ in at most ``budget`` bits.

Candidates: the bits stand on a ring of SEGMENTS segments. If two fingerprints differ in at most T bits,
some segment starts a chain whose first l segments together differ in at most l*T/SEGMENTS bits, for every
l. With T = 2 and 16 segments the first seven segments of that chain are equal, and of the next eight at
most one differs, by one bit. So each fingerprint is listed under the seven segments from each start (28
bits); within a list, those meet that agree in seven of the next eight segments too, for each choice of the
one left out (56 bits); of these the chain's budgets are checked, and then all bits. As all but two segments
are fixed then, at most 256 fingerprints can meet in one such group, however long the list.

Distinct fingerprints are compared, so copies cost nothing. Lists are streamed, one at a time; a list longer
than LIST_ROWS is dealt over the cluster by its 56-bit groups first. No list is gathered whole.

Components: the smallest label spreads over links by hooking and pointer jumping, with a checkpoint in
each round; labels never pass through the driver.

Null text: as empty. Texts without words have fingerprint zero and link like any other; texts may be of any
length. Null doc_ids take part, but name no component: component_id is the smallest doc_id that is not null,
if there is one. Rows that repeat stand in the same component. Empty table: no rows. Extra columns are kept by
``dedup``, which decides by row: of each component the row with the smallest doc_id stays (null doc_ids come
last, then the text's hash decides), once if it repeats.

Wide fingerprints (``wide``) carry the same majority over more bits, and ``near_copies`` holds them against the
proportional budgets of texts with a given resemblance.
"""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, aside, carried, mix64, parallelism, picked, prepare, remove, schema_with, scratch, settled

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SHINGLE, SEED, BUDGET, BITS = 3, 42, 2, 64
SEGMENTS = 16
#: Rows of a list that one task takes at once; longer lists are dealt by their groups.
LIST_ROWS = 4096
#: Members of a group that can be distinct: all but two segments are fixed in it.
GROUP = 256


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    words = WORD.findall((text or "").translate(ASCII_LOWER))
    if not words:
        return 0
    if len(words) <= shingle:
        grams = [" ".join(words)]
    else:
        line, ends, at = " ".join(words), [], -1
        for w in words:
            at += len(w) + 1
            ends.append(at)
        starts = [0, *(e + 1 for e in ends)]
        grams = [line[a:b] for a, b in zip(starts, ends[shingle - 1 :], strict=False)]
    hashes = np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), np.uint64, len(grams))
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[i : i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def wide(hashes: np.ndarray, words: int) -> np.ndarray:
    """A fingerprint of ``words`` 64-bit words: bit by bit the majority over hashes, each mixed anew for each word."""
    ones = np.zeros(64 * words, np.int64)
    seeds = np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for i in range(0, len(hashes), 255):  # so many bits add up in a byte
        bits = np.unpackbits(mix64(hashes[i : i + 255, None] ^ seeds).view(np.uint8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)


def ring_filter(count: np.ndarray, budget: int) -> np.ndarray:
    """For rows of differing bits by segment: whether some segment starts a chain that keeps the proportional
    budgets all the way round. Only the chain that starts after the highest running excess can, and it does
    exactly if the excess is gone after one round."""
    excess = np.cumsum(count.astype(np.int64) * count.shape[1] - budget, axis=1)
    return excess[:, -1] <= 0


def fingerprints(documents: DataFrame, text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """All columns but the text's, and fp: the fingerprint as a signed long."""
    rows, columns = aside(documents, text, ("fp",))
    names = carried(rows, "_text")
    schema = schema_with(rows, names, "fp long")

    def run(batches):
        for batch in batches:
            values = np.array([fingerprint(t.as_py(), shingle) for t in batch.column("_text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(values)], names=schema.names)

    return rows.mapInArrow(run, schema).select(*columns, "fp")


def _rotated(x: np.ndarray, start: np.ndarray | int) -> np.ndarray:
    """The ring read from a segment on, highest bits first."""
    width = BITS // SEGMENTS
    s = (np.asarray(start) * width).astype(np.uint64)
    return np.where(s == 0, x, x << s | x >> (np.uint64(BITS) - np.where(s == 0, np.uint64(1), s)))


def within_chain(x: np.ndarray, start: np.ndarray, budget: int) -> np.ndarray:
    """Whether the differing bits x stay within the proportional budgets along the chain from start."""
    ring, width, ok = _rotated(x, start), BITS // SEGMENTS, np.ones(len(x), bool)
    for n in range(1, SEGMENTS + 1):
        ok &= np.bitwise_count(ring >> np.uint64(BITS - n * width)) <= n * budget // SEGMENTS
    return ok


def _masked(ring: np.ndarray, left_out: int, equal: int) -> np.ndarray:
    """The bits of a chain's head and of the segments after it, without the one left out and the last."""
    width = BITS // SEGMENTS
    mask = (1 << BITS) - 1
    for s in (equal + left_out, SEGMENTS - 1):
        mask &= ~(((1 << width) - 1) << (BITS - (s + 1) * width))
    return ring & np.uint64(mask)


def _group_pairs(keys: np.ndarray, values: np.ndarray, tags: np.ndarray, budget: int):
    """Pairs of values that agree in key and tag and in at most ``budget`` bits less than all, of sorted rows."""
    x = values.view(np.uint64)
    for d in range(1, min(GROUP, len(x))):
        same = np.flatnonzero((keys[d:] == keys[:-d]) & (tags[d:] == tags[:-d]))
        if not len(same):
            return
        differ = x[same] ^ x[same + d]
        good = within_chain(differ, keys[same] >> 40, budget)
        good &= np.bitwise_count(differ) <= budget
        same = same[good]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(values[same], values[same + d])), pa.array(np.maximum(values[same], values[same + d]))], names=["a", "b"])


def links(distinct: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(a, b), a < b, of distinct fingerprints (column fp): all pairs that differ in at most ``budget`` bits."""
    if not 0 < budget <= 2:
        raise ValueError("chains of 64 bits select too little beyond two bits; near_copies takes wide fingerprints")
    spark = distinct.sparkSession
    equal = (SEGMENTS - 1) // 2  # segments at the head of a chain without any difference
    width = BITS // SEGMENTS
    n = parallelism(spark)
    ring = lambda s: F.col("fp") if s == 0 else F.shiftleft("fp", s * width).bitwiseOR(F.shiftrightunsigned("fp", BITS - s * width))
    key = lambda s: F.shiftrightunsigned(ring(s), BITS - equal * width).bitwiseOR(F.lit(s).cast("long") * (1 << 40))
    listed = distinct.select("fp", F.explode(F.array(*[key(s) for s in range(SEGMENTS)])).alias("key"))
    sizes = listed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    # fingerprints that share no list are done with here
    shared = settled(listed.join(sizes, "key"))
    choices = SEGMENTS - 1 - equal  # which of the segments after the head may differ

    def grouped(keys, values):
        """Pairs of whole lists, for each choice by sorting."""
        turned = _rotated(values.view(np.uint64), keys >> 40)
        for v in range(choices):
            tags = _masked(turned, v, equal)
            order = np.lexsort((values, tags, keys))
            yield from _group_pairs(keys[order], values[order], tags[order], budget)

    def whole_lists(batches):
        held = None
        for batch in batches:
            part = [batch.column("key").to_numpy(), batch.column("fp").to_numpy()]
            if held is not None:
                part = [np.concatenate(x) for x in zip(held, part, strict=True)]
            if not len(part[0]):
                continue
            cut = int(np.searchsorted(part[0], part[0][-1]))  # the last list may go on
            held = [x[cut:] for x in part]
            yield from grouped(*[x[:cut] for x in part])
        if held is not None:
            yield from grouped(*held)

    def dealt_groups(batches):
        held = None
        for batch in batches:
            part = [batch.column(c).to_numpy() for c in ("key", "fp", "tag")]
            if held is not None:
                part = [np.concatenate(x) for x in zip(held, part, strict=True)]
            held = [x[-GROUP:] for x in part]
            yield from _group_pairs(part[0], part[1], part[2], budget)

    lists = shared.filter(F.col("size") <= LIST_ROWS).repartition(n, "key").sortWithinPartitions("key")
    near = lists.mapInArrow(whole_lists, "a long, b long")
    # longer lists: one row for each choice, so that groups of at most GROUP members are dealt on their own
    long_lists = shared.filter(F.col("size") > LIST_ROWS)
    start = F.shiftright("key", 40).cast("int")
    turned = reduce(lambda acc, s: acc.when(start == s, ring(s)), range(1, SEGMENTS), F.when(start == 0, ring(0)))
    masks = [int(_masked(np.array([(1 << BITS) - 1], np.uint64), v, equal).view(np.int64)[0]) for v in range(choices)]
    tags = [F.struct(F.lit(v).alias("v"), turned.bitwiseAND(F.lit(m).cast("long")).alias("tag")) for v, m in enumerate(masks)]
    spread = long_lists.select("key", "fp", F.inline(F.array(*tags)))
    apart = spread.repartition(n, "key", "v", "tag").sortWithinPartitions("key", "v", "tag", "fp").mapInArrow(dealt_groups, "a long, b long")
    return near.unionByName(apart).dropDuplicates()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the smallest node of its component.

    Each round every node hooks to its smallest neighbour; chains of hooks are halved until all point to
    their root; edges are then drawn between roots. Rounds grow with the logarithm of the component size. The tables
    of the rounds are deleted at the end.
    """
    spark = edges.sparkSession
    folder = scratch(spark, "components")
    edges = settled(edges.select("a", "b"), folder)
    nodes = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct()
    labels = nodes.withColumn("root", F.col("node"))
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = settled(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("up")), folder)
        while True:
            upper = hooks.select(F.col("node").alias("up"), F.col("up").alias("top"))
            jumped = settled(hooks.join(upper, "up", "left").select("node", F.coalesce("top", "up").alias("up"), (F.col("top") != F.col("up")).alias("moved")), folder)
            hooks = jumped.select("node", "up")
            if jumped.filter("moved").isEmpty():
                break
        to = hooks.select(F.col("node").alias("root"), F.col("up").alias("new_root"))
        labels = settled(labels.join(to, "root", "left").select("node", F.coalesce("new_root", "root").alias("root")), folder)
        ends = edges.join(hooks.select(F.col("node").alias("a"), F.col("up").alias("x")), "a").join(hooks.select(F.col("node").alias("b"), F.col("up").alias("y")), "b")
        edges = settled(ends.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).dropDuplicates(), folder)
    out = settled(labels)
    remove(spark, folder)
    return out


def row_marks(documents: DataFrame, text: str, doc: str) -> DataFrame:
    """Rows with the order in which a component's rows stand: first (null last, doc_id, hash of the text)."""
    return picked(documents, doc_id=doc, _text=text).select("doc_id", "_text", F.xxhash64("_text").alias("mark"))


def classes(documents: DataFrame, text: str = "text", doc: str = "doc_id", shingle: int = SHINGLE, budget: int = BUDGET) -> DataFrame:
    """(doc_id, mark, fp, component_id, keeper) for each row: component_id is the smallest doc_id of all linked rows,
    keeper the mark of the row that ``dedup`` keeps if this row's doc_id is component_id."""
    prepare(documents.sparkSession)
    marked = settled(fingerprints(row_marks(documents, text, doc), "_text", shingle))
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")
    known = settled(marked.groupBy("fp").agg(F.min(first).alias("first")))
    rooted = components(links(known.select("fp"), budget))
    return _named(marked, known, rooted)


def _named(marked: DataFrame, known: DataFrame, rooted: DataFrame) -> DataFrame:
    """Rows with their component's smallest doc_id and first row."""
    named = known.join(rooted.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = named.groupBy("root").agg(F.min("first").alias("low"))
    of_fp = named.join(lowest, "root").select("fp", F.col("low.doc_id").alias("component_id"), F.col("low.mark").alias("keeper"))
    return marked.select("doc_id", "mark", "fp").join(of_fp, "fp")


def first_rows(documents: DataFrame, named: DataFrame, text: str, doc: str) -> DataFrame:
    """All columns of the first row of each component, once where it repeats."""
    # a null doc_id as a value of its own, so that it joins
    own = lambda c: F.concat(F.when(F.col(c).isNull(), "").otherwise("="), F.coalesce(F.col(c).cast("string"), F.lit("")))
    keep = named.filter("doc_id <=> component_id AND mark = keeper").select(own("doc_id").alias("_id"), F.col("mark").alias("_mark")).distinct()
    rows, columns = aside(documents, text, (), True, _doc=doc)
    one = rows.withColumns({"_id": own("_doc"), "_mark": F.xxhash64("_text")}).join(keep, ["_id", "_mark"], "left_semi")
    return one.dropDuplicates(["_id", "_mark"]).select(*columns)


def dedup(documents: DataFrame, text: str = "text", doc: str = "doc_id", shingle: int = SHINGLE, budget: int = BUDGET) -> DataFrame:
    """One row of each component, all columns."""
    return first_rows(documents, classes(documents, text, doc, shingle, budget), text, doc)


def op5_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    from .common import read

    out = classes(read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
