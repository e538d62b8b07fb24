"""Hard negatives by dual-tree search over anchors and candidates, exact.

Two trees of splits, one over the anchors and one over all rows, are fitted on at most SAMPLE rows each (a documented
bound; those of the smallest hash of their id): nodes are halved along the line between two far points until there
are leaves enough for the rows, LEAVES at most. Every row goes to a leaf, and a leaf's rows are dealt into blocks
by the hash of their id, so a vector that many rows have fills many blocks. Leaves and the nodes above them are balls
around the sample's centres that hold all their blocks.

A pair of nodes has an interval that holds all inner products between their rows: that of the centres, give or take
the radii times the lengths. Each anchor leaf first meets the candidate leaf nearest to it, which gives its anchors
scores to beat. Then pairs of nodes are followed down both trees; a pair is dropped, for all anchors under it at
once, where its interval shows that no row can be among the first positives (or, for negatives, in a band of scores
in which some anchor still has room). Blocks of the leaf pairs that are left are judged in the same way, and those left
are scored exactly by matrix products in their tasks, which keep the first few of each anchor; these meet at their
anchor.

Values are whole numbers: a component x is floor(x * 256), held between -2^26 and 2^26. Sums are exact: products of
doubles where they stay under 2^53, of 64-bit numbers otherwise. Rows with a null id, label or vector, or a null or
non-finite component, take no part. Where several rows have one id, the one with the smallest label, then vector,
stays. Vectors of other lengths: missing components count as zero. Ties: the smaller id. Anchors without positives or
without negatives in the band: no rows. Empty table: no rows. Extra columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import picked, prepare, settled

SCALE, LIMIT = 256.0, 1 << 26
SAMPLE, LEAVES = 4096, 256
#: Rows of a block, and of an anchors' block, with vectors of 64 components or fewer.
BLOCK, ANCHOR_BLOCK = 1024, 256
#: Positives of an anchor, negatives of a positive, and the band of their scores in hundredths of the positive's.
POSITIVES, NEGATIVES, LOW, HIGH = 5, 3, 50, 95
PACKED = "block long, leaf int, n int, ids binary, labels binary, vectors binary, centre array<double>, radius double"


def matrix(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, np.int32).reshape(n, -1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers."""
    top = lambda x: max(1.0, float(np.abs(x.astype(np.float64)).max(initial=0)))
    if top(a) * top(b) * max(a.shape[1], 1) < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


class Tree:
    """Nodes in a list, children after their parents: (normal, offset, left, right), or None for a leaf. Each has the
    centre of its sample; radii are measured later, on all rows."""

    def __init__(self, nodes: list, centres: list[np.ndarray]):
        self.nodes, self.centres = nodes, centres
        self.radii = np.full(len(nodes), -np.inf)

    def place(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        out, todo = np.zeros(len(x), np.int32), [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if self.nodes[node] is None:
                out[rows] = node
            else:
                normal, offset, left, right = self.nodes[node]
                side = x[rows] @ normal > offset
                todo += [(left, rows[~side]), (right, rows[side])]
        return out

    @classmethod
    def fit(cls, x: np.ndarray, leaves: int) -> Tree:
        nodes, centres = [None], [x.mean(0) if len(x) else np.zeros(x.shape[1])]
        largest, n_leaves = [(0, x)], 1
        while largest and n_leaves < leaves:
            largest.sort(key=lambda t: len(t[1]))
            at, rows = largest.pop()
            if len(rows) < 8:
                break
            far = rows[np.argmax(((rows - rows[0]) ** 2).sum(1))]
            normal = rows[np.argmax(((rows - far) ** 2).sum(1))] - far
            side = rows @ normal
            cut = float(np.median(side))
            if not (side > cut).any():
                cut = float(side.mean())
            if not (side > cut).any():  # all rows are alike
                continue
            nodes[at] = (normal, cut, len(nodes), len(nodes) + 1)
            for half in (rows[side <= cut], rows[side > cut]):
                largest.append((len(nodes), half))
                nodes.append(None)
                centres.append(half.mean(0))
            n_leaves += 1
        return cls(nodes, centres)

    def measure(self, leaf_radii: dict[int, float]) -> None:
        for i in reversed(range(len(self.nodes))):
            if self.nodes[i] is None:
                self.radii[i] = leaf_radii.get(i, -np.inf)
            else:
                for j in self.nodes[i][2:]:
                    if self.radii[j] > -np.inf:
                        self.radii[i] = max(self.radii[i], self.radii[j] + np.linalg.norm(self.centres[i] - self.centres[j]) + 1e-6)

    def raised(self, by_leaf: dict[int, float], pick) -> list[float | None]:
        """A value for each node from those of its leaves; None where no leaf has one."""
        out: list[float | None] = [by_leaf.get(i) if k is None else None for i, k in enumerate(self.nodes)]
        for i in reversed(range(len(self.nodes))):
            if self.nodes[i] is not None:
                below = [out[j] for j in self.nodes[i][2:] if out[j] is not None]
                out[i] = pick(below) if below else None
        return out


def leaf_pairs(anchors: Tree, rows: Tree, least: dict[int, float], most: dict[int, float]) -> list[tuple[int, int]]:
    """Leaves that must meet, by following pairs of nodes down both trees. least, most: scores that can matter to an anchor leaf."""
    low, high = anchors.raised(least, min), anchors.raised(most, max)
    out, todo = [], [(0, 0)]
    while todo:
        a, c = todo.pop()
        if anchors.radii[a] == -np.inf or rows.radii[c] == -np.inf or low[a] is None:
            continue
        x, y = anchors.centres[a], rows.centres[c]
        middle = float(x @ y)
        spread = (anchors.radii[a] * (np.linalg.norm(y) + rows.radii[c]) + rows.radii[c] * np.linalg.norm(x)) * (1 + 1e-9) + 1.0
        if middle + spread < low[a] or middle - spread > high[a]:
            continue
        if anchors.nodes[a] is None and rows.nodes[c] is None:
            out.append((a, c))
        elif rows.nodes[c] is None or anchors.nodes[a] is not None and anchors.radii[a] >= rows.radii[c]:
            todo += [(j, c) for j in anchors.nodes[a][2:]]
        else:
            todo += [(a, j) for j in rows.nodes[c][2:]]
    return out


def nearest_leaves(anchors: Tree, rows: Tree) -> list[tuple[int, int]]:
    """For each anchor leaf that has rows, the nearest leaf of rows."""
    own = [i for i, k in enumerate(anchors.nodes) if k is None and anchors.radii[i] > -np.inf]
    others = [i for i, k in enumerate(rows.nodes) if k is None and rows.radii[i] > -np.inf]
    return [(a, min(others, key=lambda c: float(((anchors.centres[a] - rows.centres[c]) ** 2).sum()))) for a in own] if others else []


def whole(rows: DataFrame) -> DataFrame:
    """Rows that take part, with whole components: id, label, v."""
    clean = rows.filter("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL").filter(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    units = F.transform("v", lambda x: F.greatest(F.lit(-float(LIMIT)), F.least(F.lit(float(LIMIT)), F.floor(x * SCALE).cast("double"))).cast("int"))
    least = clean.select(F.col("id").cast("long").alias("id"), F.struct(F.col("label").cast("int").alias("label"), units.alias("v")).alias("row")).groupBy("id").agg(F.min("row").alias("row"))
    return least.select("id", "row.label", "row.v")


def fitted(rows: DataFrame, dims: int, block: int) -> Tree:
    total = rows.count()
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").collect()
    return Tree.fit(padded([r.v for r in sample], dims).astype(np.float64), min(LEAVES, max(1, total // block)))


def padded(vectors: list, dims: int) -> np.ndarray:
    x = np.zeros((len(vectors), dims), np.int32)
    for i, v in enumerate(vectors):
        x[i, : len(v)] = v
    return x


def packed(rows: DataFrame, tree: Tree, dims: int, block: int) -> DataFrame:
    """Blocks of rows of one leaf each, a row for each block; the tree's balls then hold them."""
    shared = rows.sparkSession.sparkContext.broadcast(tree)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(leaf=shared.value.place(padded(list(batch["v"]), dims).astype(np.float64)))

    placed = settled(rows.mapInPandas(place, "id long, label int, v array<int>, leaf int"))
    # one row for each leaf
    sizes = placed.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / block).alias("parts"))
    dealt = placed.join(F.broadcast(sizes), "leaf").withColumn("block", F.col("leaf") * F.lit(1 << 32) + F.pmod(F.xxhash64("id"), "parts"))

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        x = padded(list(group["v"]), dims)
        centre = x.mean(0)
        # a little wider than the rounding of the sums
        radius = float(np.sqrt(((x - centre) ** 2).sum(1).max(initial=0))) * (1 + 1e-9) + 1e-6
        ids, labels = group["id"].to_numpy(np.int64), group["label"].to_numpy(np.int32)
        return pd.DataFrame({"block": [group["block"].iloc[0]], "leaf": [group["leaf"].iloc[0]], "n": [len(x)], "ids": [ids.tobytes()], "labels": [labels.tobytes()], "vectors": [x.tobytes()], "centre": [centre], "radius": [radius]})

    blocks = settled(dealt.groupBy("block").applyInPandas(pack, PACKED))
    centres = rows.sparkSession.createDataFrame([(i, c.tolist()) for i, c in enumerate(tree.centres)], "leaf int, node array<double>")
    away = F.sqrt(F.aggregate(F.zip_with("centre", "node", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    held = blocks.join(F.broadcast(centres), "leaf").groupBy("leaf").agg(F.max((away + F.col("radius")) * (1 + 1e-9) + 1e-6).alias("r"))
    tree.measure({r.leaf: r.r for r in held.collect()})
    return blocks


def bounds(pairs: DataFrame) -> DataFrame:
    """low and high: between them lie all inner products of an anchor block's rows and a candidate block's."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x * y, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)
    size = lambda c: F.sqrt(dot(c, c))
    middle = dot("a_centre", "centre")
    spread = (F.col("a_radius") * (size(F.col("centre")) + F.col("radius")) + F.col("radius") * size(F.col("a_centre"))) * (1 + 1e-9) + 1.0
    return pairs.withColumn("low", middle - spread).withColumn("high", middle + spread)


def first_positives(scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k allowed rows: higher scores first, ties by smaller id."""
    at = np.flatnonzero(allowed)
    if len(at) > k:
        worst = np.partition(scores[at], len(at) - k)[len(at) - k]
        at = at[scores[at] >= worst]
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def best_positives(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The first positives of each anchor within each pair of blocks."""
    for batch in batches:
        for r in batch.itertuples():
            a, c = matrix(r.a_vectors, r.a_n), matrix(r.vectors, r.n)
            a_ids, ids, a_labels, labels = np.frombuffer(r.a_ids, np.int64), np.frombuffer(r.ids, np.int64), np.frombuffer(r.a_labels, np.int32), np.frombuffer(r.labels, np.int32)
            scores, out = products(a, c), []
            for i in range(len(a)):
                at = first_positives(scores[i], (labels == a_labels[i]) & (ids != a_ids[i]), ids, POSITIVES)
                out.append((np.full(len(at), a_ids[i]), ids[at], scores[i][at]))
            yield pd.DataFrame({"a_block": r.a_block, **dict(zip(("anchor_id", "positive_id", "positive_score"), map(np.concatenate, zip(*out, strict=True)), strict=True))})


def best_negatives(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The first negatives of each anchor and positive within each pair of blocks; wanted: anchor, positive, lowest, highest score."""
    for batch in batches:
        for r in batch.itertuples():
            a, c = matrix(r.a_vectors, r.a_n), matrix(r.vectors, r.n)
            a_ids, ids, a_labels, labels = np.frombuffer(r.a_ids, np.int64), np.frombuffer(r.ids, np.int64), np.frombuffer(r.a_labels, np.int32), np.frombuffer(r.labels, np.int32)
            row = {x: i for i, x in enumerate(a_ids.tolist())}
            scores, out = products(a, c), []
            for w in r.wanted:
                i = row[w["anchor_id"]]
                s = scores[i]
                at = first_positives(s, (labels != a_labels[i]) & (s >= w["least"]) & (s <= w["most"]), ids, NEGATIVES)
                out.append((np.full(len(at), w["anchor_id"]), np.full(len(at), w["positive_id"]), np.full(len(at), w["positive_score"]), ids[at], s[at]))
            names = ("anchor_id", "positive_id", "positive_score", "negative_id", "negative_score")
            yield pd.DataFrame({"a_block": r.a_block, **dict(zip(names, map(np.concatenate, zip(*out, strict=True)), strict=True))})


def first(rows: DataFrame, keys: list[str], score: str, tie: str, k: int, rank: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(score).desc(), tie))
    return rows.withColumn(rank, place).filter(F.col(rank) <= k)


def tightest(found: DataFrame, keys: list[str], score: str, k: int) -> DataFrame:
    """The k-th score of each key that has k."""
    return found.groupBy(*keys).agg(F.when(F.count(F.lit(1)) >= k, F.min(score)).alias("kth"))


class Search:
    """Blocks of anchors and of all rows, and exact scores of those pairs that the bounds leave."""

    def __init__(self, rows: DataFrame, anchors: DataFrame, dims: int):
        self.spark = rows.sparkSession
        # blocks of longer vectors have fewer rows: their bytes stay about the same
        size, anchor_size = (max(16, min(n, n * 64 // dims)) for n in (BLOCK, ANCHOR_BLOCK))
        self.row_tree, self.anchor_tree = fitted(rows, dims, size), fitted(anchors, dims, anchor_size)
        self.rows = packed(rows, self.row_tree, dims, size)
        blocks = packed(anchors, self.anchor_tree, dims, anchor_size)
        self.anchors = blocks.select(*[F.col(c).alias(f"a_{c}") for c in blocks.columns])
        self.seeds = nearest_leaves(self.anchor_tree, self.row_tree)

    def pairs(self, leaves: list[tuple[int, int]], limits: DataFrame) -> DataFrame:
        """Blocks that must meet, of some pairs of leaves (LEAVES of either tree at most). limits: a_block, least, most."""
        chosen = self.spark.createDataFrame(leaves, "a_leaf int, leaf int")
        a = self.anchors.select("a_block", "a_leaf", "a_centre", "a_radius").join(limits, "a_block").join(F.broadcast(chosen), "a_leaf")
        both = bounds(a.join(self.rows.select("block", "leaf", "centre", "radius"), "leaf"))
        return both.filter("high >= least AND low <= most").select("a_block", "block")

    def scored(self, pairs: DataFrame, best, schema: str, wanted: DataFrame | None = None) -> DataFrame:
        a = self.anchors.drop("a_leaf", "a_centre", "a_radius")
        met = pairs.join(a if wanted is None else a.join(wanted, "a_block"), "a_block").join(self.rows.drop("leaf", "centre", "radius"), "block")
        return met.mapInPandas(best, schema)

    def rest(self, limits: DataFrame) -> list[tuple[int, int]]:
        """Pairs of leaves that must still meet, by the limits of their anchors' blocks."""
        by_leaf = limits.join(self.anchors.select("a_block", "a_leaf"), "a_block").groupBy("a_leaf").agg(F.min("least").alias("least"), F.max("most").alias("most")).collect()
        left = leaf_pairs(self.anchor_tree, self.row_tree, {r.a_leaf: r.least for r in by_leaf}, {r.a_leaf: r.most for r in by_leaf})
        return sorted(set(left) - set(self.seeds))


POSITIVE = "a_block long, anchor_id long, positive_id long, positive_score long"
NEGATIVE = "a_block long, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def positives(search: Search) -> DataFrame:
    """The first positives of each anchor."""
    everything = search.anchors.select("a_block", F.lit(float("-inf")).alias("least"), F.lit(float("inf")).alias("most"))
    near = settled(first(search.scored(search.pairs(search.seeds, everything), best_positives, POSITIVE), ["anchor_id"], "positive_score", "positive_id", POSITIVES, "place").drop("place"))
    # an anchors' block needs what could beat the last positive of any of its anchors; all, if one has too few
    full = tightest(near, ["a_block", "anchor_id"], "positive_score", POSITIVES).filter("kth IS NOT NULL").groupBy("a_block").agg(F.count(F.lit(1)).alias("full"), F.min("kth").alias("kth"))
    least = F.when(F.col("full") == F.col("a_n"), F.col("kth").cast("double")).otherwise(float("-inf"))
    limits = settled(search.anchors.select("a_block", "a_n").join(full, "a_block", "left").select("a_block", least.alias("least"), F.lit(float("inf")).alias("most")))
    far = search.scored(search.pairs(search.rest(limits), limits), best_positives, POSITIVE)
    return settled(first(near.unionByName(far), ["anchor_id"], "positive_score", "positive_id", POSITIVES, "place").drop("place"))


def negatives(search: Search, found: DataFrame) -> DataFrame:
    """The first negatives of each anchor and positive, in the band of scores that the positive's gives."""
    keys = ["a_block", "anchor_id", "positive_id", "positive_score"]
    # least and greatest whole numbers n with LOW p <= 100 n <= HIGH p
    floor = lambda x: F.expr(f"({x} - pmod({x}, 100L)) DIV 100")
    band = found.withColumn("most", floor(f"({HIGH} * positive_score)")).withColumn("least", -floor(f"(-{LOW} * positive_score)")).filter("least <= most")
    ask = lambda d: d.groupBy("a_block").agg(F.collect_list(F.struct("anchor_id", "positive_id", "positive_score", "least", "most")).alias("wanted"))
    limit = lambda d: d.groupBy("a_block").agg(F.min("least").cast("double").alias("least"), F.max("most").cast("double").alias("most"))
    kept = lambda d: first(d, ["anchor_id", "positive_id"], "negative_score", "negative_id", NEGATIVES, "rank")
    near = settled(kept(search.scored(search.pairs(search.seeds, limit(band)), best_negatives, NEGATIVE, ask(band))).drop("rank"))
    beaten = tightest(near, keys, "negative_score", NEGATIVES)
    tighter = settled(band.join(beaten, keys, "left").withColumn("least", F.greatest("least", F.coalesce("kth", "least"))).drop("kth"))
    limits = limit(tighter)
    far = search.scored(search.pairs(search.rest(limits), limits), best_negatives, NEGATIVE, ask(tighter))
    return kept(near.unionByName(far))


def mine(rows: DataFrame, every: int = 50, vec: str = "embedding", doc: str = "vec_id", label: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, of anchors whose id is divisible by ``every``."""
    prepare(rows.sparkSession)
    own = settled(whole(picked(rows, id=doc, label=label, v=vec)))
    dims = own.agg(F.max(F.size("v"))).first()[0] or 0
    anchors = own.filter(F.col("id") % every == 0)
    if not dims or anchors.isEmpty():
        return rows.sparkSession.createDataFrame([], RESULT)
    search = Search(own, anchors, dims)
    return negatives(search, positives(search)).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    from .common import read

    rows = read(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.select("vec_id", label.alias("label"), "embedding"))


SQL = """
WITH e AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT a.id AS anchor_id, a.label = c.label AS same, c.id, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
  FROM e a JOIN e c ON a.id % 50 = 0 AND a.id <> c.id
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
), n AS (
  SELECT p.*, s.id AS negative_id, s.score AS negative_score, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
