"""Toxicity by noisy-channel deobfuscation: words are restored first, then scored.

Language model: words of all documents are counted (one row for each word and task is shuffled), and their counts
make those of all runs of ORDER letters between word borders, over an alphabet of 32 signs (letters without their
accents, the border, all others as one). The table has at most 2^20 entries whatever the corpus holds, so it is
small enough to be broadcast, and every document adds to it.

Channel: a token that may hide a word becomes a lattice. Digits and symbols stand for letters they look like, for
themselves, or at a word's ends for nothing; a star stands for any letter; marks between letters are borders or
nothing; runs of one letter are one or two of it or as written, and a doubled letter that the language model expects
is taken as it is; three or more letters each alone between spaces or marks are joined or not.
Viterbi decoding over the last three letters finds the cheapest reading under channel costs and the language model.
Tokens that can be read in one way alone are taken as they are. Each task decodes a token once and keeps the
reading in a table of at most MEMO tokens, which only saves time.

Score: the share of a text's restored words that are a known word or begin with a known prefix, for the FEATURES
that tell the labels apart best, in a logistic model. It is fitted on at most MAX_TRAIN labelled rows (the bound of
what the driver holds: their feature values, no texts), those of the smallest hash of id, label and text.

Null text: as empty. Empty texts get the score of the bias alone. Without rows of both classes the score is the
smoothed share of label 1 (a half if there are no labels). Labels other than 0 and 1 and null labels are not used.
Rows with several labels, and ids with several texts, count once for each; equal ones once. Texts and tokens may
be of any length. Extra columns stay; those named score or predicted are replaced. Empty tables: no rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import aside, carried, parallelism, picked, prepare, schema_with, settled

ORDER, SIGNS = 4, 32
MAX_TRAIN, FEATURES, PREFIXES = 6000, 1000, (3, 4, 5, 6)
THRESHOLD, MEMO = 0.3, 1 << 18
#: Letters that digits and symbols look like.
LOOKS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¢": "c"}
#: Letters of other scripts that look like Latin ones.
TWINS = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ѕ": "s", "ԁ": "d", "к": "k", "м": "m", "т": "t", "ο": "o", "α": "a", "ι": "i", "ν": "v"}
MARKS, WILD = ".-_~^'", "*#"
HIDDEN = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
#: Costs in nats: a look-alike, a sign as itself, a sign as nothing inside a word, a star as a letter, a mark as a
#: border or as nothing, a border between single letters, a run of letters not as expected.
LOOK, ITSELF, NOTHING, STAR, BORDER, JOINT, SINGLE, LESS = 1.0, 5.0, 3.0, 3.3, 0.5, 1.5, 0.8, 4.0
EDGES = re.compile(r"^[^\w@$!|+(<€£¢*#]+|[^\w@$|+<€£¢*#]+$")
LETTERS = re.compile(r"[^\W\d_]+")
STOPS = ".,;:?\"/()[]{}%&"
PAIR, TRIPLE = re.compile(r"([^\W\d_])\1"), re.compile(r"([^\W\d_])\1\1")
#: Single signs with the same mark between all of them.
MARKED = re.compile(r"[^\W_]([.\-_~^'])[^\W_](?:\1[^\W_])+")
#: Pieces of a token that are read together.
PIECE = re.compile(r"[\w@$!|+(<€£¢*#.\-~^']+")


def folded(c: str) -> str:
    """A letter as one of the alphabet's signs: a to z, or { for all others."""
    base = unicodedata.normalize("NFD", c)[0]
    return base if "a" <= base <= "z" else "{"


class Fold(dict):
    def __missing__(self, code: int) -> str:
        self[code] = found = folded(chr(code))
        return found


FOLD = Fold({i: chr(i) for i in range(ord("a"), ord("z") + 1)})


def plain(text: str | None) -> str:
    """Lower case, forms of a letter as the letter itself, no signs without width."""
    text = text or ""
    if not text.isascii():
        for c in HIDDEN:
            text = text.replace(c, "")
        text = unicodedata.normalize("NFKC", text)
    return text.lower()


def sign(c: str) -> int:
    return ord(FOLD[ord(c)]) & 31


def gram_counts(words: list[str], counts: np.ndarray) -> np.ndarray:
    """Counts of all runs of ORDER signs that end in a letter of a word or in its final border."""
    pad = "`" * (ORDER - 1)
    data = np.frombuffer("".join(f"{pad}{w.translate(FOLD)}`" for w in words).encode("ascii"), np.uint8).astype(np.int64) & 31
    sizes = np.fromiter((len(w) for w in words), np.int64, len(words)) + ORDER
    weights = np.repeat(counts.astype(np.float64), sizes)
    begins = np.cumsum(sizes) - sizes
    for i in range(ORDER - 1):
        weights[begins + i] = 0
    code = np.zeros(len(data), np.int64)
    for i in range(ORDER):
        code[ORDER - 1 :] = code[ORDER - 1 :] << 5 | data[i : len(data) - ORDER + 1 + i]
    return np.bincount(code[weights > 0], weights[weights > 0], SIGNS**ORDER)


def log_costs(counts: np.ndarray) -> np.ndarray:
    """Costs of a sign after the three before it: counts of runs, each order drawn towards the next shorter one."""
    by_order = [counts.reshape(SIGNS, SIGNS, SIGNS, SIGNS)]
    for _ in range(ORDER - 1):
        by_order.append(by_order[-1].sum(axis=0))
    p = np.full(SIGNS, 1 / 28)
    for c in reversed(by_order):
        kinds = (c > 0).sum(axis=-1, keepdims=True) + 1
        p = (c + kinds * p) / (c.sum(axis=-1, keepdims=True) + kinds)
    return -np.log(p).astype(np.float32).ravel()


def language_model(documents: DataFrame, text: str = "text") -> np.ndarray:
    """Costs from the words of all documents: words of letters alone, folded to lower case, with their counts."""
    words = picked(documents, _text=text).select(F.explode(F.split(F.lower("_text"), r"[^\p{L}\p{N}@$!|+*#'\-]+")).alias("word"))
    counted = words.filter(F.col("word").rlike(r"^\p{L}{2,}$")).groupBy("word").count()

    def run(batches):
        total = np.zeros(SIGNS**ORDER)
        for batch in batches:
            # letters of which lower case has two code points and such are left to the fold
            total += gram_counts([w.lower() for w in batch.column("word").to_pylist()], batch.column("count").to_numpy(zero_copy_only=False))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["gram", "n"])

    counts = np.zeros(SIGNS**ORDER)
    # at most SIGNS ** ORDER rows
    for r in counted.mapInArrow(run, "gram int, n double").groupBy("gram").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r.gram] = r.n
    return log_costs(counts)


class Restorer:
    """Reads tokens as words. costs: of a sign after three others."""

    def __init__(self, costs: np.ndarray):
        self.costs = costs
        self.memo: dict[str, tuple[str, ...]] = {}

    def __reduce__(self):
        return Restorer, (self.costs,)

    def best(self, lattice: list[list[tuple[float, str]]]) -> str:
        """The cheapest reading of steps, each of which has (cost, what it emits); "" is nothing, a space a border."""
        costs, states = self.costs, {0: (0.0, None)}
        for step in [*lattice, [(0.0, " ")]]:
            new: dict[int, tuple[float, tuple | None]] = {}
            for state, (so_far, path) in states.items():
                for cost, emits in step:
                    total, to, tail = so_far + cost, state, path
                    for c in emits:
                        s = sign(c) if c.isalpha() else 0
                        if s or to & 31:  # borders after borders say nothing
                            total += float(costs[(to & 32767) << 5 | s])
                        # a word starts afresh
                        to = (to << 5 | s) & 32767 if s else 0
                        tail = (tail, c)
                    if to not in new or total < new[to][0]:
                        new[to] = (total, tail)
            states = new
        out, path = [], min(states.values(), key=lambda x: x[0])[1]
        while path is not None:
            path, c = path
            out.append(c)
        return "".join(reversed(out))

    def lattice(self, piece: str) -> list[list[tuple[float, str]]]:
        steps, i, n = [], 0, len(piece)
        while i < n:
            c, j = piece[i], i + 1
            while j < n and piece[j] == c:
                j += 1
            run, edge = j - i, i == 0 or j == n
            if c == " ":
                steps.append([(0.0, ""), (SINGLE, " ")])
            elif c.isalpha():
                own = TWINS.get(c, c)
                readings = [(0.0 if run < 3 else LESS, own * run)]
                if run > 1:
                    readings.append((LESS if run == 2 else 0.0, own))
                if run > 2:
                    readings.append((0.0, own * 2))
                if own != c:
                    readings.append((LOOK, c * run))
                steps.append(readings)
            elif c in LOOKS:
                nothing = [(0.0 if edge else NOTHING, " " if edge else "")] if not c.isdigit() else []
                for _ in range(min(run, 2)):
                    steps.append([(LOOK, x) for x in LOOKS[c]] + [(ITSELF, " ")] + nothing)
                for _ in range(run - 2):
                    steps.append([(LOOK, x) for x in LOOKS[c]] + [(ITSELF, " "), (LOOK, "")] + nothing)
            elif c in WILD:
                # at most two letters of a word are hidden so; longer runs, and those at its ends, are borders
                if edge or run > 2:
                    steps.append([(0.0, " ")])
                else:
                    steps += [[(STAR, chr(x)) for x in range(ord("a"), ord("z") + 1)] + [(NOTHING, "")]] * run
            else:
                steps.append([(BORDER, " "), (JOINT, "")])
            i = j
        return steps

    def words(self, token: str) -> tuple[str, ...]:
        """The words that a token (without white space, in lower case) hides, or is."""
        found = self.memo.get(token)
        if found is None:
            found = self.read(token)
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[token] = found
        return found

    def expected(self, word: str) -> bool:
        """Whether each doubled letter costs no more than the channel takes for reading it as one."""
        for m in PAIR.finditer(word):
            at = m.end() - 1
            code = 0
            for c in word[max(0, at - 3) : at + 1]:
                code = code << 5 | ord(FOLD[ord(c)]) & 31
            if self.costs[code] > LESS:
                return False
        return True

    def as_written(self, word: str) -> bool:
        """Letters alone, none three times in a row nor doubled against expectation, of one script."""
        if not word.isalpha() or PAIR.search(word) and (TRIPLE.search(word) or not self.expected(word)):
            return False
        return word.isascii() or not any(c in TWINS for c in word) or not any("a" <= c <= "z" for c in word)

    def read(self, token: str) -> tuple[str, ...]:
        core = token.strip(STOPS)
        if self.as_written(core):
            return (core,)
        core, out = EDGES.sub("", core), []
        for piece in PIECE.findall(core):
            if self.as_written(piece):
                out.append(piece)
            elif LETTERS.search(piece):
                piece = re.sub(r"[.\-_~^']", " ", piece) if MARKED.fullmatch(piece) else piece
                out += LETTERS.findall(self.best(self.lattice(piece)))
        return tuple(out)

    def joined(self, singles: list[str]) -> tuple[str, ...]:
        """Words of a run of single letters between spaces."""
        return tuple(LETTERS.findall(self.best(self.lattice(" ".join(singles)))))

    def tokens(self, text: str | None) -> Counter:
        """Tokens of a text and how often each occurs; runs of single letters that are joined stand as tuples of words."""
        tokens, runs = plain(text).split(), []
        single = [i for i, t in enumerate(tokens) if len(t) == 1]
        at = 0
        # runs of three or more tokens of one sign each
        while at < len(single):
            end = at + 1
            while end < len(single) and single[end] == single[end - 1] + 1:
                end += 1
            if end - at >= 3:
                i, j = single[at], single[end - 1] + 1
                runs.append(self.joined(tokens[i:j]))
                tokens[i:j] = [""] * (j - i)
            at = end
        counts = Counter(tokens)
        counts.pop("", None)
        counts.update(runs)
        return counts

    def counted(self, text: str | None) -> Counter:
        """Restored words of a text and how often each occurs."""
        out: Counter = Counter()
        for token, times in self.tokens(text).items():
            for w in self.words(token) if type(token) is str else token:
                out[w] += times
        return out

    def restored(self, text: str | None) -> str:
        """The text in lower case with what its tokens hide; white space as it was, but in joined runs."""
        text = re.sub(r"(?<!\S)\S(?:\s\S){2,}(?!\S)", lambda m: " ".join(self.joined(m[0].split())), plain(text))
        return re.sub(r"\S+", lambda m: " ".join(self.words(m[0])), text)


def features(word: str) -> list[str]:
    """A word itself and its beginnings."""
    return [f"={word}", *[f"^{word[:k]}" for k in PREFIXES if len(word) >= k]]


def strength(count: np.ndarray, n: int) -> np.ndarray:
    """How strongly a feature is in a text: grows with its share of the words, and is near 1 from some hundredths on."""
    return 1 - np.exp(-60.0 * count / max(n, 1))


class Model:
    def __init__(self, names: list[str], weights: np.ndarray, bias: float):
        self.index, self.weights, self.bias = {x: i for i, x in enumerate(names)}, weights, bias
        # no other word has a feature
        self.begins = {x[1:4] for x in names}

    def values(self, text: str | None, restorer: Restorer, memo: dict) -> tuple[np.ndarray, np.ndarray]:
        """Indexes and strengths of the features of a text. memo: words and features of tokens met before."""
        counts, n, got = restorer.tokens(text), 0, {}
        known, index, begins = memo.get, self.index, self.begins
        for token, times in counts.items():
            own = known(token)
            if own is None:
                words = restorer.read(token) if type(token) is str else token
                if len(memo) >= MEMO:
                    memo.clear()
                own = memo[token] = (len(words), tuple(index[x] for w in words if w[:3] in begins for x in features(w) if x in index))
            n += times * own[0]
            for i in own[1]:
                got[i] = got.get(i, 0) + times
        at = np.array(sorted(got), np.int64)
        return at, strength(np.array([got[i] for i in at], float), n)

    def score(self, text: str | None, restorer: Restorer, memo: dict) -> float:
        at, x = self.values(text, restorer, memo)
        return float(1 / (1 + np.exp(-np.clip(self.weights[at] @ x + self.bias, -500, 500))))


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 0.3, steps: int = 400) -> tuple[np.ndarray, float]:
    """Logistic weights by accelerated gradient steps; the bias is not drawn to zero."""
    n = len(y)
    w, b = np.zeros(x.shape[1]), 0.0
    last_w, last_b = w, b
    rate = 1 / (0.25 * (np.linalg.norm(x, 2) ** 2 / n + 1) + penalty / n)
    for k in range(steps):
        m = k / (k + 3)
        vw, vb = w + m * (w - last_w), b + m * (b - last_b)
        p = 1 / (1 + np.exp(-np.clip(x @ vw + vb, -500, 500)))
        last_w, last_b = w, b
        w, b = vw - rate * (x.T @ (p - y) / n + penalty / n * vw), vb - rate * (p - y).mean()
    return w, float(b)


def train(documents: DataFrame, labels: DataFrame, restorer: Restorer, text: str = "text", doc: str = "doc_id", label: str = "toxic", held_out: tuple[int, int] | None = (4, 2)) -> Model:
    """Fits on labelled rows, without those whose crc32(id) mod 4 is 2."""
    prepare(documents.sparkSession)
    known = picked(labels, _id=doc, _y=label).withColumn("_y", F.col("_y").cast("int")).filter("_id IS NOT NULL AND _y IN (0, 1)")
    if held_out:
        known = known.filter(F.crc32(F.col("_id").cast("string")) % held_out[0] != held_out[1])
    # a bounded choice of ids, then of the rows that have them
    chosen = known.distinct().orderBy(F.xxhash64("_id"), "_id", "_y").limit(MAX_TRAIN)
    texts = picked(documents, _id=doc, _text=text).join(F.broadcast(chosen), "_id").withColumn("_h", F.xxhash64("_id", "_y", "_text"))
    bounded = settled(texts.select("_h", "_y", "_text").dropDuplicates(["_h"]).orderBy("_h").limit(MAX_TRAIN).repartition(parallelism(documents.sparkSession), "_h"))
    shared = documents.sparkSession.sparkContext.broadcast(restorer)

    def sums(batches):
        # strengths by feature and class of what this task reads
        total: dict[str, list] = {}
        for batch in batches:
            for y, t in zip(batch.column("_y").to_pylist(), batch.column("_text").to_pylist(), strict=True):
                words = shared.value.counted(t)
                own: Counter = Counter()
                for w, n in words.items():
                    for f in features(w):
                        own[f] += n
                for f, x in zip(own, strength(np.array(list(own.values()), float), words.total()).tolist(), strict=True):
                    row = total.setdefault(f, [0.0, 0.0, 0])
                    row[y] += x
                    row[2] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), *[pa.array([r[k] for r in total.values()], kind) for k, kind in enumerate((pa.float64(), pa.float64(), pa.int64()))]], names=["f", "s0", "s1", "texts"])

    sizes = {r._y: r.n for r in bounded.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        share = (sizes.get(1, 0) + 1) / (sum(sizes.values()) + 2)
        return Model([], np.zeros(0), float(np.log(share / (1 - share))))
    found = bounded.mapInArrow(sums, "f string, s0 double, s1 double, texts long").groupBy("f").agg(F.sum("s0").alias("s0"), F.sum("s1").alias("s1"), F.sum("texts").alias("texts")).filter("texts >= 3")
    # how far the shares of texts of each class that hold a feature strongly lie apart
    p1, p0 = (F.round("s1", 6) + 0.1) / (sizes[1] + 0.2), (F.round("s0", 6) + 0.1) / (sizes[0] + 0.2)
    apart = F.round(F.abs((p1 - p0) * F.log(p1 / p0)), 9)
    names = sorted(r.f for r in found.orderBy(apart.desc(), "f").limit(FEATURES).collect())
    model = Model(names, np.zeros(len(names)), 0.0)
    both = documents.sparkSession.sparkContext.broadcast((restorer, model))

    def vectors(batches):
        own, judge = both.value
        memo: dict = {}
        for batch in batches:
            got = [judge.values(t, own, memo) for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_h"), batch.column("_y"), pa.array([g[0].tolist() for g in got], pa.list_(pa.int32())), pa.array([g[1].tolist() for g in got], pa.list_(pa.float64()))], names=["h", "y", "at", "x"])

    # at most MAX_TRAIN rows of FEATURES values
    rows = sorted(bounded.mapInArrow(vectors, "h long, y int, at array<int>, x array<double>").collect())
    matrix = np.zeros((len(rows), len(names)))
    for i, r in enumerate(rows):
        matrix[i, r["at"]] = r.x
    model.weights, model.bias = fit(matrix, np.array([r.y for r in rows], float))
    return model


RESULTS = ("score", "predicted")


def score(documents: DataFrame, restorer: Restorer, model: Model, text: str = "text", keep_text: bool = False) -> DataFrame:
    """Adds score and predicted to each row."""
    prepare(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast((restorer, model))
    rows, columns = aside(documents, text, RESULTS, keep_text)
    names = carried(rows, "_text")
    schema = schema_with(rows, names, "score double, predicted int")

    def run(batches):
        own, judge = shared.value
        memo: dict = {}
        for batch in batches:
            values = [judge.score(t, own, memo) for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(values, pa.float64()), pa.array([int(v >= THRESHOLD) for v in values], pa.int32())], names=schema.names)

    return rows.mapInArrow(run, schema).select(*columns, *RESULTS)


def restore(documents: DataFrame, restorer: Restorer, text: str = "text") -> DataFrame:
    """Replaces the text by its restored form; null stays null."""
    prepare(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(restorer)
    rows, columns = aside(documents, text, ("restored",), True)
    names = carried(rows, "_text")
    schema = schema_with(rows, names, "restored string")

    def run(batches):
        for batch in batches:
            values = [None if t is None else shared.value.restored(t) for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(values, pa.string())], names=schema.names)

    return rows.mapInArrow(run, schema).select(*columns, "restored")


def op13_toxicity(spark, sf_dir: str) -> DataFrame:
    from .common import read

    documents = read(spark, sf_dir, "documents").select("doc_id", "text")
    restorer = Restorer(language_model(documents))
    model = train(documents, read(spark, sf_dir, "labels"), restorer)
    out = score(documents, restorer, model)
    return out.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 4 == 2).alias("held_out"), "score", "predicted")
