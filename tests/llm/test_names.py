"""Columns of any name beside the text: results stay the same, and columns that no result replaces stay."""

import pytest

pytest.importorskip("candlemill.llm")
public_tokenizers = pytest.importorskip("public_tokenizers")
from candlemill.llm import byte_bpe, common, decontaminate, fingerprint, hilbert_shards, license_scan, line_dedup, nbsvm, near_copies, simhash, suffix_dedup  # noqa: E402

from test_exact import corpus  # noqa: E402

NAMES = ("_text", "_doc", "_row", "_norm", "_verdict", "Text", "score.x", "DOC_ID", "_aside_0", "_0", "_key", "fp", "mark", "tie", "part", "_h", "Score", "N_words", "n_lines", "kept_sha256", "labels", "hashes", "a b", "`x`"[1:-1])


@pytest.fixture(scope="module")
def both(spark):
    common.prepare(spark)
    rows = [(i, t) for i, t, _ in corpus(25)]
    plain = spark.createDataFrame(rows, "doc_id long, text string")
    odd = spark.createDataFrame([(*["extra"] * len(NAMES), i, t) for i, t in rows], ", ".join(f"`{c}` string" for c in NAMES) + ", doc_id long, text string")
    return plain, odd


BPE = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
OPERATORS = {
    "shards": (hilbert_shards.shard, ("doc_id", "shard", "slot"), False),
    "flag": (lambda d: decontaminate.flag(d, d.sparkSession.createDataFrame([(1, "quick brown fox")], "item_id long, text string")), ("doc_id", *decontaminate.VERDICT), True),
    "encode": (lambda d: byte_bpe.encode(d, *BPE, as_ids=False), ("doc_id", "n_tokens", "ids_sha256"), True),
    "removed": (suffix_dedup.removed, ("doc_id", "n_removed", "kept_sha256"), False),
    "classes": (simhash.classes, ("doc_id", "fp", "component_id"), False),
    "prints": (simhash.fingerprints, ("doc_id", "fp"), True),
    "dedup": (simhash.dedup, ("doc_id", "text"), True),
    "near": (near_copies.dedup, ("doc_id", "text"), True),
    "pairs": (fingerprint.edited_pairs, ("doc_id", "edited_sha256", "near_next"), False),
    "winnowed": (fingerprint.winnowed, ("doc_id", "hashes", "positions"), True),
    "lines": (line_dedup.dedup, ("doc_id", "text"), True),
    "digests": (lambda d: line_dedup.apply_bitmaps(d, line_dedup.keep_bitmaps(d), digest=True), ("doc_id", *line_dedup.RESULTS), True),
    "score": (lambda d: nbsvm.score(d, nbsvm.train(d, d.sparkSession.createDataFrame([(i, i % 2) for i in range(25)], "doc_id long, quality int"))), ("doc_id", *nbsvm.RESULTS), True),
    "scan": (license_scan.scan, ("doc_id", *license_scan.RESULTS), True),
}


def rows_of(df, wanted):
    at = [df.columns.index(c) for c in wanted]
    return sorted(str([r[k] for k in at]) for r in df.collect())


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_names(both, name):
    operator, wanted, keeps = OPERATORS[name]
    plain, odd = (operator(d) for d in both)
    assert rows_of(plain, wanted) == rows_of(odd, wanted)
    if keeps:
        results = {c.lower() for c in wanted} - {"doc_id", "text"}
        assert [c for c in odd.columns if c in NAMES and c.lower() not in results] == [c for c in NAMES if c.lower() not in results]
        at = [odd.columns.index(c) for c in NAMES if c.lower() not in results]
        assert {r[k] for r in odd.collect() for k in at} == {"extra"}


def test_repeated_rows_stay_once(spark):
    rows = [(1, "a b c d e f g h"), (1, "a b c d e f g h"), (5, "a b c d e f g h"), (5, "unlike the others in every word"), (None, "nobody knows the number of this"), (None, "nobody knows the number of this")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for module in (simhash, near_copies):
        got = sorted(((r.doc_id or 0), r.text) for r in module.dedup(docs).collect())
        assert got == [(0, rows[4][1]), (1, rows[0][1]), (5, rows[3][1])]


def test_fingerprints_of_any_ids_over_many_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "300")
    try:
        for kind, make in (("string", lambda i: f"id-{i:04d}"), ("long", lambda i: i + (1 << 60)), ("date", None)):
            ids = [make(i) for i in range(40)] if make else [__import__("datetime").date(2020, 1, 1 + i % 28).replace(month=1 + i // 28) for i in range(40)]
            texts = [f"text number {i} " * (1 + i % 3) for i in range(40)]
            rows = [*zip(ids, texts), (None, "last"), (None, None)]
            got = fingerprint.edited_pairs(spark.createDataFrame(rows, f"doc_id {kind}, text string").repartition(5)).collect()
            assert len(got) == len(rows)
            order = sorted(range(40), key=lambda k: ids[k], reverse=True)
            after = {ids[a]: texts[b] for a, b in zip(order, order[1:])}
            for r in got:
                if r.doc_id in after:
                    own = texts[ids.index(r.doc_id)]
                    assert r.near_next == fingerprint.likeness(fingerprint.winnow(own)[0], fingerprint.winnow(after[r.doc_id])[0])
                    assert r.positions == fingerprint.winnow(own)[1].tolist()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_passages_meet_the_guarantee():
    import random

    rng = random.Random(1)
    for _ in range(200):
        a, b, shared = ("".join(rng.choice("abcdefgh é") for _ in range(rng.randint(0, 200))) for _ in range(3))
        shared = shared + "".join(rng.choice("0123456789") for _ in range(50))
        x, y = a + shared + b, b + "|" + shared + a
        spans = fingerprint.passages(x, y, fingerprint.winnow(x), fingerprint.winnow(y))
        assert all(x.encode()[p : p + n] == y.encode()[q : q + n] for p, q, n in spans)
        assert max(n for *_, n in spans) >= len(shared.encode())


def test_lines_of_text_ids(spark, monkeypatch):
    line = "one line that is surely longer than forty characters"
    rows = [(str(k), f"{line}\nown {k}") for k in (1, 20, 3, 100, 9, 7)] + [("9", f"{line}\nanother text of nine"), (None, f"{line}\nnobody's")]
    out = line_dedup.dedup(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert {(r.doc_id, r.text) for r in out} == {(d, t if d in ("9", None) else t.split("\n")[1]) for d, t in rows}
    digits = line_dedup.dedup(spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows)], "doc_id short, text string")).collect()
    assert sum(line in r.text for r in digits) == 1


def test_one_line_in_many_batches(spark):
    line = "the same line that stands in every one of the documents"
    frame = spark.range(3000).selectExpr("id AS doc_id", f"concat('{line}', char(10), id) AS text").repartition(3)
    out = line_dedup.dedup(frame).collect()
    assert sorted(r.doc_id for r in out if line in r.text) == [2999] and len(out) == 3000
