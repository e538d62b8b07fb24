"""SimHash near-dedup of texts by resemblance: a Jaccard similarity of 0.8 or more between their 5-word shingles.

64 bits cannot tell such texts from others: texts of that similarity differ in 10 of them on the mean and in up to
18, chains of which select next to nothing. So fingerprints here have BITS bits, and the filter is the same: the
ring of segments, proportional budgets, then all bits. With angle a between the shingle sets as vectors, a bit
differs with chance a / pi, 0.152 at a similarity of 0.8 (0.188 for the smallest sets):

* more than FAR bits (FAR_SMALL for sets of fewer than FEWEST): no link. A linked pair differs in so many with a
  chance below 4e-7.
* at most NEAR bits and FEWEST shingles or more in both: a link. A pair that is no link differs in so few with a
  chance of 3e-7 at a similarity of just under 0.8, and ever less below.
* the rest is decided on the whole shingle sets, as far as the sure links leave the two apart. These pairs are made
  where the sets meet and are never listed.

Which texts are held against each other: texts of fewer than SMALL shingles are listed under their n - ceil(0.8 n) + 1
smallest hashes (linked ones share one of them: nothing is lost); texts of FEWEST or more under BANDS numbers made of
ROWS minima each (a linked pair shares none with a chance of (1 - 0.8 ** ROWS) ** BANDS, 3e-8). All pairs of
a list count, without listing them: first each member meets the list's smallest fingerprint; lists whose members are
one component then are done with, as links inside a component change nothing. In the others, members of the largest
component meet the rest, block by block.

Equal sets are one node, so copies cost nothing. Words and null texts are as in simhash.py: texts without words are
one node; texts of fewer words than a shingle are one shingle. Which rows stay, null doc_ids, rows that repeat and
extra columns: as in simhash.py. Long texts are taken whole. Empty table: no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, gram_hashes, prepare, schema_with, settled
from .simhash import WORD, _named, components, first_rows, ring_filter, row_marks, wide

SHINGLE, WORDS, SEGMENTS = 5, 64, 16
BITS = 64 * WORDS
NEAR, FAR, FAR_SMALL = 505, 735, 1000
FEWEST, SMALL = 64, 80
BANDS, ROWS = 24, 3
#: Members of a list, and others, that meet in one task.
BLOCK = 2048
#: Texts of one side whose whole sets meet in one task.
PART = 500
#: Odd factors of the minima: fixed, so that all runs agree.
FACTORS = np.random.default_rng(11).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """The distinct hashes of a text's shingles, ascending."""
    words = WORD.findall((text or "").translate(ASCII_LOWER))
    values = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))
    return np.unique(gram_hashes(values, max(1, min(SHINGLE, len(words)))))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two ascending sets have a Jaccard similarity of 0.8 or more."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * both >= 4 * (len(a) + len(b) - both)


def list_keys(s: np.ndarray) -> np.ndarray:
    """The lists of a set of shingle hashes."""
    n, out = len(s), []
    if n < SMALL:
        out.append(s[: n - (4 * n + 4) // 5 + 1])
    if n >= FEWEST:
        low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
        for i in range(0, n, 4096):
            low = np.minimum(low, (s[None, i : i + 4096] * FACTORS[:, None]).min(axis=1))
        bands = low.reshape(BANDS, ROWS)
        out.append(gram_hashes(np.concatenate([np.arange(BANDS, dtype=np.uint64)[:, None], bands], axis=1).ravel(), ROWS + 1)[:: ROWS + 1])
    return np.concatenate(out)


def sketches(marked: DataFrame) -> DataFrame:
    """(doc_id, mark, fp, n, bits, keys) of each row: fp names its set of n shingles."""
    schema = schema_with(marked, ["doc_id", "mark"], "fp binary, n long, bits binary, keys array<long>")

    def run(batches):
        for batch in batches:
            fps, sizes, bits, keys = [], [], [], []
            for t in batch.column("_text"):
                s = shingles(t.as_py())
                fps.append(xxhash.xxh3_128_digest(s.tobytes()))
                sizes.append(len(s))
                bits.append(wide(s, WORDS).tobytes())
                keys.append(list_keys(s).view(np.int64))
            columns = [pa.array(fps, pa.binary()), pa.array(sizes, pa.int64()), pa.array(bits, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), *columns], names=schema.names)

    return marked.mapInArrow(run, schema)


def _words(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, WORDS)


def _verdict(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs of fingerprints and sizes: the places of those that may link, and which of them do for sure."""
    at = np.flatnonzero(5 * np.minimum(n, m) >= 4 * np.maximum(n, m))
    count = np.bitwise_count(x[at] ^ y[at]).reshape(len(at), SEGMENTS, WORDS // SEGMENTS).sum(axis=2, dtype=np.int64)
    few = np.minimum(n, m)[at] < FEWEST
    fits = np.where(few, ring_filter(count, FAR_SMALL), ring_filter(count, FAR))
    return at[fits], (count[fits].sum(axis=1) <= NEAR) & ~few[fits]


def judged(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """(a, b, sure) of the pairs that the filter leaves."""
    side = lambda c: known.select(F.col("fp").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}"))
    whole = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "bits_a", "bits_b")

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                at, sure = _verdict(_words(batch.column("bits_a")), _words(batch.column("bits_b")), batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy())
                yield pa.RecordBatch.from_arrays([batch.column("a").take(pa.array(at)), batch.column("b").take(pa.array(at)), pa.array(sure, pa.bool_())], names=["a", "b", "sure"])

    return whole.mapInArrow(run, "a binary, b binary, sure boolean")


def _across(shared: DataFrame, known: DataFrame, rooted: DataFrame) -> DataFrame:
    """Of lists that hold several components: links (key, a, b) for sure, and the texts (key, a, null) of pairs in doubt."""
    at = shared.select("key", "fp").join(rooted.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    parts = at.groupBy("key", "root").agg(F.count(F.lit(1)).alias("size"))
    lists = parts.groupBy("key").agg(F.sum("size").alias("size"), F.max(F.struct("size", "root")).alias("main"), F.count(F.lit(1)).alias("roots")).filter("roots > 1")
    blocks = lambda c: F.ceil(c / BLOCK).cast("int")
    lists = lists.select("key", F.col("main.root").alias("main"), blocks(F.col("size")).alias("blocks"), blocks(F.col("size") - F.col("main.size")).alias("others"))
    members = at.join(lists, "key").join(known.select("fp", "n", "bits"), "fp")
    place = lambda c: F.pmod(F.xxhash64("fp", "key"), F.col(c)).cast("int")
    # every member stands in one block of its list; those outside the largest component meet all blocks
    columns = ("key", "i", "j", "asks", "fp", "n", "root", "bits")
    stand = members.withColumns({"i": place("blocks"), "j": F.explode(F.sequence(F.lit(0), F.col("others") - 1)), "asks": F.lit(False)}).select(*columns)
    ask = members.filter("root <> main").withColumns({"j": place("others"), "i": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)), "asks": F.lit(True)}).select(*columns)

    def compare(table: pa.Table) -> pa.Table:
        asks, n, fp = table.column("asks").to_numpy(), table.column("n").to_numpy(), np.array(table.column("fp").to_pylist(), object)
        root, bits = np.unique(np.array(table.column("root").to_pylist(), object), return_inverse=True)[1], _words(table.column("bits"))
        a, b, open_ones = [], [], np.zeros(len(n), bool)
        there = np.flatnonzero(~asks)
        for x in np.flatnonzero(asks):
            y = there[root[there] != root[x]]
            at, sure = _verdict(bits[y], np.broadcast_to(bits[x], (len(y), WORDS)), n[y], np.broadcast_to(n[x], len(y)))
            # one link to a component tells as much as all of them
            linked = y[at[sure]]
            linked = linked[np.unique(root[linked], return_index=True)[1]]
            a += [fp[x]] * len(linked)
            b += fp[linked].tolist()
            doubt = y[at[~sure]]
            doubt = doubt[~np.isin(root[doubt], root[linked])]
            open_ones[doubt] = True
            open_ones[x] |= len(doubt) > 0
        rest = np.unique(fp[open_ones]).tolist()
        return pa.table({"key": pa.array([table.column("key")[0].as_py()] * (len(a) + len(rest)), pa.int64()), "a": pa.array(a + rest, pa.binary()), "b": pa.array(b + [None] * len(rest), pa.binary())})

    return stand.unionByName(ask).groupBy("key", "i", "j").applyInArrow(compare, "key long, a binary, b binary")


def _in_doubt(asked: DataFrame, documents: DataFrame, known: DataFrame, rooted: DataFrame) -> DataFrame:
    """(a, b): links between different components among the texts (key, fp) of lists in doubt, by their whole sets.

    Pairs are made and decided where the sets are; only links that join two components leave. A pair in several lists
    is decided in the one with the smallest key."""
    at = asked.join(rooted.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lists = at.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("root").alias("low"), F.max("root").alias("top")).filter("low < top")
    members = settled(at.join(lists.select("key", F.ceil(F.col("size") / PART).cast("int").alias("parts")), "key"))
    whole = members.join(known.select("fp", "n", "bits", "keys"), "fp").join(whole_sets(members.select("fp").distinct(), documents, known), "fp")
    dealt = whole.withColumn("own", F.pmod(F.xxhash64("fp", "key"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("parts", "other")

    def compare(table: pa.Table) -> pa.Table:
        key, i, j = (table.column(c)[0].as_py() for c in ("key", "i", "j"))
        own, n, bits = table.column("own").to_numpy(), table.column("n").to_numpy(), _words(table.column("bits"))
        root = np.unique(np.array(table.column("root").to_pylist(), object), return_inverse=True)[1]
        fp, sets, keys = table.column("fp").to_pylist(), table.column("set").to_pylist(), table.column("keys").to_pylist()
        top = np.arange(len(n))  # components by number, joined as links are found
        a, b = [], []
        for x in np.flatnonzero(own == i):
            y = np.flatnonzero(own == j)
            y = y[(top[root[y]] != top[root[x]]) & ((y > x) if i == j else True)]
            may, _ = _verdict(bits[y], np.broadcast_to(bits[x], (len(y), WORDS)), n[y], np.broadcast_to(n[x], len(y)))
            for z in y[may].tolist():
                if top[root[z]] != top[root[x]] and min(set(keys[x]) & set(keys[z])) == key and similar(np.frombuffer(sets[x], np.uint64), np.frombuffer(sets[z], np.uint64)):
                    top[top == top[root[z]]] = top[root[x]]
                    a.append(fp[x])
                    b.append(fp[z])
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return dealt.groupBy("key", "i", "j").applyInArrow(compare, "a binary, b binary")


def whole_sets(nodes: DataFrame, documents: DataFrame, known: DataFrame) -> DataFrame:
    """(fp, set) of some nodes (column fp): their shingle hashes, from the text of the row that comes first."""
    own = lambda c: F.concat(F.when(F.col(c).isNull(), "").otherwise("="), F.coalesce(F.col(c).cast("string"), F.lit("")))
    asked = nodes.join(known.select("fp", "first"), "fp").select("fp", own("first.doc_id").alias("id"), F.col("first.mark").alias("mark"))
    texts = documents.withColumn("id", own("doc_id")).join(asked, ["id", "mark"]).select("fp", "id", "mark", "_text").dropDuplicates(["id", "mark"])

    def cut(batches):
        for batch in batches:
            sets = [shingles(t.as_py()) for t in batch.column("_text")]
            yield pa.RecordBatch.from_arrays([batch.column("fp"), pa.array([s.tobytes() for s in sets], pa.binary())], names=["fp", "set"])

    return texts.mapInArrow(cut, "fp binary, set binary")


def verified(pairs: DataFrame, documents: DataFrame, known: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole shingle sets are similar. documents: row_marks of all rows.

    Nodes stand in parts of PART on the mean; the pairs of two parts meet their sets in one task, to which each set
    goes once, however many pairs it is in."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
    parts = max(1, -(-nodes.count() // PART))
    part = lambda c: F.pmod(F.xxhash64(c), F.lit(parts)).cast("int")
    dealt = pairs.select("a", "b", F.least(part("a"), part("b")).alias("i"), F.greatest(part("a"), part("b")).alias("j"))
    sets = whole_sets(nodes, documents, known)
    wanted = dealt.select("i", "j", F.explode(F.array("a", "b")).alias("fp")).distinct()
    sent = wanted.join(sets, "fp").select(F.col("i").alias("part_i"), F.col("j").alias("part_j"), "fp", "set")

    def check(meeting: pa.Table, held: pa.Table) -> pa.Table:
        of = dict(zip(held.column("fp").to_pylist(), (np.frombuffer(x, np.uint64) for x in held.column("set").to_pylist()), strict=True))
        a, b = meeting.column("a"), meeting.column("b")
        good = pa.array([similar(of[x], of[y]) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.bool_())
        return pa.table({"a": a.filter(good), "b": b.filter(good)})

    return dealt.groupBy("i", "j").cogroup(sent.groupBy("part_i", "part_j")).applyInArrow(check, "a binary, b binary")


def classes(documents: DataFrame, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """(doc_id, mark, fp, component_id, keeper) for each row, as in simhash.classes."""
    prepare(documents.sparkSession)
    rows = row_marks(documents, text, doc)
    marked = settled(sketches(rows))
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")
    # rows of one fp agree in n, bits and keys
    known = settled(marked.groupBy("fp").agg(F.min(first).alias("first"), *[F.first(c).alias(c) for c in ("n", "bits", "keys")]))
    listed = known.select("fp", F.explode("keys").alias("key"))
    sizes = listed.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("fp").alias("head")).filter("size > 1")
    shared = settled(listed.join(sizes.drop("size"), "key"))
    star = shared.filter("fp <> head").select(F.col("head").alias("a"), F.col("fp").alias("b")).distinct()
    hubs = settled(judged(star, known))
    links = hubs.filter("sure").select("a", "b").unionByName(settled(verified(hubs.filter("NOT sure").select("a", "b"), rows, known)))
    found = settled(_across(shared, known, components(links)))
    links = links.unionByName(found.filter("b IS NOT NULL").select("a", "b"))
    rooted = components(links)
    more = settled(_in_doubt(found.filter("b IS NULL").select("key", F.col("a").alias("fp")).distinct(), rows, known, rooted))
    if not more.isEmpty():
        rooted = components(links.unionByName(more))
    return _named(marked, known.select("fp", "first"), rooted)


def dedup(documents: DataFrame, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """One row of each component, all columns."""
    return first_rows(documents, classes(documents, text, doc), text, doc)
