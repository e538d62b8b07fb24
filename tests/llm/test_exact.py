"""The text operators against brute force on small fixtures, with the odd rows that each must stand."""

import hashlib
import random
import zlib

import numpy as np
import pytest

pytest.importorskip("candlemill.llm")
from candlemill.llm import byte_bpe, common, decontaminate, fingerprint, hilbert_shards, html_text, license_scan, line_dedup, nbsvm, simhash, suffix_dedup  # noqa: E402

WORDS = "The quick brown fox jumps over lazy dogs and every café naïve Straße 42 times cc by".split()


def corpus(n=60, seed=5):
    r = random.Random(seed)
    passage = " ".join(r.choice(WORDS) + str(r.randint(0, 99)) for _ in range(60))
    line = "A line that many documents of this fixture share, word for word!"
    rows = [(1000, None, "extra"), (1001, "", "extra"), (1002, "  \n\t\n ", "extra"), (1003, "x" * 5000, "extra"), (1004, "x" * 5000, "extra")]
    for i in range(n):
        text = " ".join(r.choice(WORDS) for _ in range(r.randint(1, 120)))
        if i % 4 == 0:
            text += " " + passage + " " + str(i)
        if i % 3 == 0:
            text = line.upper() * (i % 2) + "\n" * (i % 2) + text + "\n " + line + " \n"
        rows.append((i, text, "keep"))
    rows.append((n, rows[7][1], "keep"))
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    common.prepare(spark)
    return spark.createDataFrame(corpus(), "doc_id long, text string, keep string").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, keep string")


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_hilbert_curve_visits_neighbours(spark):
    from pyspark.sql import functions as F

    cells = spark.range(512).selectExpr("id & 7 a", "(id >> 3) & 7 b", "(id >> 6) & 7 c")
    got = cells.withColumn("h", hilbert_shards.hilbert_index([F.col(x) for x in "abc"], 3)).toPandas().sort_values("h")
    assert got.h.tolist() == list(range(512))
    assert (np.abs(np.diff(got[list("abc")].to_numpy(), axis=0)).sum(axis=1) == 1).all()


def test_shards(docs, empty):
    rows = hilbert_shards.shard(docs.withColumnRenamed("keep", "source"), 7).collect()
    sizes = {}
    for r in rows:
        sizes.setdefault(r.shard, []).append(r.slot)
    assert len(rows) == len(corpus()) and max(map(len, sizes.values())) - min(map(len, sizes.values())) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in sizes.values())
    text = {i: t for i, t, _ in corpus()}
    assert all(r.text_crc32 == zlib.crc32((text[r.doc_id] or "").encode()) and r.size == len((text[r.doc_id] or "").encode()) + 8 for r in rows)
    assert hilbert_shards.shard(empty, 7).collect() == []
    assert len(hilbert_shards.shard(docs.limit(3), 24).collect()) == 3


@pytest.mark.parametrize("block_words", [10**6, 30])
def test_decontamination(spark, docs, monkeypatch, block_words):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block_words)
    source = [t for i, t, _ in corpus() if i in (4, 8, 11)]
    items = [(1, " ".join(source[0].split()[-40:])), (2, source[1]), (3, "quick brown"), (4, None), (5, "..."), (6, source[2][:300]), (7, source[2][:300])]
    got = by_id(decontaminate.flag(docs, spark.createDataFrame(items, "item_id long, text string")))
    windows = {}
    for item, text in items:
        w = decontaminate.words_of(text)
        n = min(13, len(w))
        for k in range(len(w) - n + 1) if n else ():
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(item))
    for i, text, keep in corpus():
        w = decontaminate.words_of(text)
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if s := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= s
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items, r.keep) == (len(w), len(hit), len(found), keep)
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        assert r.contaminated == (len(hit) > 0 and 20 * len(hit) >= len(w))


def test_byte_bpe(docs, empty):
    tiktoken = pytest.importorskip("tiktoken")
    public_tokenizers = pytest.importorskip("public_tokenizers")
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    own = byte_bpe.codec(path, public_tokenizers.PATTERN)
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.transducer.ranks, special_tokens={})
    r = random.Random(2)
    texts = [t or "" for _, t, _ in corpus()] + ["-" * 3000, " " * 3000, "=+" * 700, "日本語² x", "<|endoftext|>"]
    texts += ["".join(r.choice("thein \n-é日😀\x1c0?") for _ in range(300)) for _ in range(150)]
    for t in texts:
        ids = np.frombuffer(own.encode(t), "<u4").tolist()
        assert ids == theirs.encode_ordinary(t)
        assert own.decode_text(ids) == t
    left, right = list(own.transducer.words)[300:900:7], list(own.transducer.words)[260:900:11]
    for a in left:
        for b in right:
            parts = own.transducer.merged(own.transducer.words[a] + own.transducer.words[b])
            assert own.transducer.may_follow(a, b) == (parts == [own.transducer.words[a], own.transducer.words[b]])
    got = by_id(byte_bpe.encode(docs, path, public_tokenizers.PATTERN, round_trip=True))
    assert all(got[i].ids == theirs.encode_ordinary(t or "") and got[i].decoded == (t or "") and got[i].keep == k for i, t, k in corpus())
    assert byte_bpe.encode(empty, path, public_tokenizers.PATTERN).collect() == []


@pytest.mark.parametrize("limit", [4096, 1])
def test_suffix_dedup(docs, empty, monkeypatch, limit):
    monkeypatch.setattr(suffix_dedup, "BUCKET_LIMIT", limit)
    got = by_id(suffix_dedup.removed(docs))
    data = {i: (t or "").encode() for i, t, _ in corpus()}
    seen = {}
    for b in data.values():
        for p in range(len(b) - 199):
            seen[b[p : p + 200]] = seen.get(b[p : p + 200], 0) + 1
    for i, b in data.items():
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 199):
            if seen[b[p : p + 200]] > 1:
                gone[p : p + 200] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        assert (got[i].n_bytes, got[i].n_removed, bytes(got[i].kept)) == (len(b), int(gone.sum()), kept)
        assert got[i].n_spans == int((gone & ~np.concatenate([[False], gone])[: len(b)]).sum())
    assert suffix_dedup.removed(empty).collect() == []


@pytest.mark.parametrize("limit", [24, 1])
def test_simhash(spark, docs, empty, monkeypatch, limit):
    monkeypatch.setattr(simhash, "LIST_ROWS", limit)
    got = by_id(simhash.classes(docs))
    fps = {i: simhash.fingerprint(t) for i, t, _ in corpus()}
    low = {i: i for i in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if (fps[a] ^ fps[b]).bit_count() <= 2 and low[b] < low[a]:
                    low[a], changed = low[b], True
    assert {i: r.component_id for i, r in got.items()} == low
    assert {r.doc_id for r in simhash.dedup(docs).collect()} == set(low.values())
    assert simhash.dedup(docs).columns == docs.columns and simhash.classes(empty).collect() == []


def test_simhash_chains(spark):
    """A chain of neighbours is one component, however far its ends are apart."""
    values, x = [], 0
    for i in range(40):
        values.append(x - (1 << 64) if x >= 1 << 63 else x)
        x ^= 3 << (2 * (i % 32))
    edges = simhash.links(spark.createDataFrame([(v,) for v in dict.fromkeys(values)], "fp long"))
    assert simhash.components(edges).select("root").distinct().count() == 1


def test_fingerprints(docs, empty):
    got = by_id(fingerprint.edited_pairs(docs))
    rows = sorted(((i, t or "") for i, t, _ in corpus()), reverse=True)
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half] if half else t
        a, b, c = (fingerprint.winnow(x)[0] for x in (t, edited, nxt))
        r = got[i]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.near_edited, r.near_next) == (len(t), hashlib.sha256(edited.encode()).hexdigest(), fingerprint.encoded(a), fingerprint.likeness(a, b), fingerprint.likeness(a, c))
    assert fingerprint.edited_pairs(empty).collect() == []
    assert len(fingerprint.edited_pairs(docs.filter("doc_id = 3")).collect()) == 1


def test_winnowing_guarantee():
    r = random.Random(9)
    for _ in range(50):
        shared = "".join(r.choice("abcdefgh ") for _ in range(fingerprint.K + fingerprint.W - 1))
        a, b = ("".join(r.choice("ijklmnop ") for _ in range(r.randint(0, 200))) + shared + "".join(r.choice("qrstuv ") for _ in range(50)) for _ in range(2))
        assert set(fingerprint.winnow(a)[0]) & set(fingerprint.winnow(b)[0])


def test_line_dedup(docs, empty):
    got = by_id(line_dedup.apply_bitmaps(docs.select("doc_id", "text"), line_dedup.keep_bitmaps(docs), digest=True))
    holders = {}
    key = lambda x: x.strip(line_dedup.BLANK).translate(common.ASCII_LOWER)
    for i, t, _ in corpus():
        for line in (t or "").split("\n"):
            if len(key(line)) >= 40:
                holders.setdefault(key(line), set()).add(i)
    for i, t, _ in corpus():
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(holders.get(key(x), ())) >= 5 and max(holders[key(x)]) != i)]
        assert (got[i].n_lines, got[i].n_dropped, got[i].kept_sha256) == (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    assert sum(r.n_dropped for r in got.values()) > 10
    out = line_dedup.dedup(docs)
    assert out.columns == docs.columns and by_id(out)[1000].text is None and line_dedup.dedup(empty).collect() == []


def test_html(spark):
    page = "<html><head><title>t</title></head><body><nav>menu</nav><div class='ad'>buy</div><article><h1>A &amp; B</h1><p>one\n two<br>three<p>four<div class=comments>no</div></article><footer>f</footer>"
    assert html_text.page_lines(page) == (["A & B", "one two three", "four"], True)
    assert html_text.page_lines(None) == html_text.page_lines("") == ([], False)
    assert html_text.page_lines("<p>a</p><script>x<p>y</script><!-- <p>z --><p>b &lt;c&gt; <b")[0] == ["a", "b <c>"]
    pages = [(1, "http://h.org/a/1", "<p>Top bar</p><p>first text</p><p>Bottom</p>"), (2, "http://h.org/a/2", "<p>Top bar</p><p>second text</p><p>Bottom</p>"), (3, None, "<p>alone</p>"), (4, "http://h.org/a/3", page), (5, "http://k.org/", None)]
    got = {r.page_id: r for r in html_text.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert {i: r.text for i, r in got.items()} == {1: "first text", 2: "second text", 3: "alone", 4: "A & B\none two three\nfour", 5: ""}
    assert got[1].n_chars == 10
    assert html_text.common_lines([1, 2, 3, 4], [2, 9, 4, 1]) == [1, 3]


def test_classifier(spark, docs, empty):
    r = random.Random(4)
    rows = [(i, " ".join(r.choice(WORDS).lower() for _ in range(40)) if i % 3 else " ".join(r.choice(WORDS).upper() + "!!" for _ in range(40)), int(i % 3 > 0)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = nbsvm.train(df.select("doc_id", "text"), df.select("doc_id", "quality"))
    got = by_id(nbsvm.score(df, model))
    held = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([got[i].predicted == got[i].quality for i in held]) > 0.97
    assert all(0 <= x.score <= 1 for x in by_id(nbsvm.score(docs, model)).values())
    blank = nbsvm.train(df.select("doc_id", "text"), df.select("doc_id", "quality").limit(0))
    assert {x.score for x in nbsvm.score(docs, blank).collect()} == {0.5} and nbsvm.score(empty, model).collect() == []


def test_license_scan(spark, empty):
    assert len(license_scan.rules()) > 300
    texts = {
        1: "Licensed under the Apache License, Version 2.0.\nAll rights\nreserved CC-BY x cc by",
        2: "This work is licensed under the GNU General Public License, version 3. GNU General Public License",
        3: None,
        4: "nothing here",
        5: "SPDX-License-Identifier: MIT",
        6: "cc by nc sa 4.0",
    }
    got = by_id(license_scan.scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string")))
    assert (got[1].n_words, got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels) == (16, 3, 8, 14, "cc-by,reserved")
    assert got[1].labels == "apache-2.0,cc-by,reserved"
    assert got[2].labels == "gpl,gpl-3" and got[2].n_base == 2 and got[2].last_word == 13
    assert (got[3].n_words, got[3].n_base, got[3].labels, got[3].score, got[3].first_word) == (0, 0, "", 0.0, None)
    assert got[4].labels == "" and got[5].labels == "mit" and got[5].score == 1.0
    assert got[6].labels == "cc-by,cc-by-nc-sa-4.0"
    assert license_scan.scan(empty).collect() == []
