"""The pipeline against a plain version of all its stages, and every stage and operator on odd rows."""

import hashlib

import pytest

pytest.importorskip("candlemill.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")
public_tokenizers = pytest.importorskip("public_tokenizers")
from candlemill.llm import byte_bpe, common, decontaminate, fingerprint, hilbert_shards, license_scan, line_dedup, nbsvm, simhash, suffix_dedup  # noqa: E402

from test_exact import corpus  # noqa: E402


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents of both kinds, with labels on most, near copies, a shared line and benchmark passages."""
    common.prepare(spark)
    rows = [(i, t, "de" if i % 2 else None, f"s{i % 3}", len(t or "")) for i, t, _ in corpus(90)]
    junk = [(2000 + i, "BUY NOW!!! " * (3 + i % 5) + f"CLICK {i}!!!", None, "s0", 0) for i in range(40)]
    top = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows + junk, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{top}/documents.parquet")
    labels = [(i, 1, 0) for i, _, _, _, _ in rows if i % 7] + [(i, 0, 0) for i, *_ in junk if i % 5]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    passage = " ".join(next(t for i, t, _ in corpus(90) if i == 4).split()[-30:])
    spark.createDataFrame([(1, passage), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    return str(top)


def plain_lines(texts):
    holders = {}
    key = lambda x: x.strip(line_dedup.BLANK).translate(common.ASCII_LOWER)
    for i, t in texts.items():
        for line in (t or "").split("\n"):
            if len(key(line)) >= 40:
                holders.setdefault(key(line), set()).add(i)
    drop = lambda x, i: len(holders.get(key(x), ())) >= 5 and max(holders[key(x)]) != i
    return {i: t if t is None else "\n".join(x for x in t.split("\n") if not drop(x, i)) for i, t in texts.items()}


def plain_copies(texts):
    """The texts whose doc_id is the smallest of those reachable over fingerprints two bits apart at most."""
    fps, low = {i: simhash.fingerprint(t) for i, t in texts.items()}, {i: i for i in texts}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if (fps[a] ^ fps[b]).bit_count() <= 2 and low[b] < low[a]:
                    low[a], changed = low[b], True
    return {i: t for i, t in texts.items() if low[i] == i}


def plain_contamination(texts, items):
    windows = set()
    for item in items:
        w = decontaminate.words_of(item)
        windows |= {tuple(w[k : k + min(13, len(w))]) for k in range(max(0, len(w) - 13) + 1)} if w else set()
    kept = {}
    for i, t in texts.items():
        w, hit = decontaminate.words_of(t), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
        if not hit or 20 * len(hit) < len(w):
            kept[i] = t
    return kept


def test_pipeline(spark, folder):
    tiktoken = pytest.importorskip("tiktoken")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    first = corpus_pipeline.quality(spark, docs, folder)
    assert first.columns == docs.columns
    kept = {r.doc_id: r.text for r in first.collect()}
    scores = {r.doc_id: r.predicted for r in nbsvm.score(docs, nbsvm.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))).collect()}
    assert set(kept) == {i for i, p in scores.items() if p == 1} and not any(2000 <= i < 2040 for i in kept)
    steps = [kept, plain_lines(kept)]
    steps.append(plain_copies(steps[-1]))
    items = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    steps.append(plain_contamination(steps[-1], items))
    assert len({len(x) for x in steps[1:]}) == 3 and steps[1] != steps[0], "each stage has something to do"
    own = byte_bpe.codec(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.transducer.ranks, special_tokens={})
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert set(got) == set(steps[-1])
    for i, t in steps[-1].items():
        ids = theirs.encode_ordinary(t or "")
        packed = b"".join(x.to_bytes(4, "little") for x in ids)
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())


#: Columns that operators might use for themselves.
CLASHES = ("key", "rank", "fp", "n_words", "score", "shard", "hash", "word", "line", "pos", "block", "ids", "position", "component_id", "labels", "kept", "size", "label", "root", "n")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, blanks, repeated texts and a long one, with many more columns, nulls among them."""
    texts = [None, None, "", " \n\n\t", "same text here", "same text here", "word " * 40000, "\n" * 3000, "cc by", "é" * 700, "\x00\x1f odd   marks"]
    rows = [(i, t, *[None if i % 2 else "x"] * len(CLASHES)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in CLASHES))


def test_clashing_columns(spark, odd):
    common.prepare(spark)
    plain, n = odd.select("doc_id", "text"), odd.count()
    bpe = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    items = spark.createDataFrame([(1, "odd marks", "x"), (1, "odd marks", None), (None, "same text here", None)], "item_id long, text string, n_words string")
    model = nbsvm.train(plain, spark.createDataFrame([(4, 1), (8, 0), (8, None), (None, 1)], "doc_id long, quality int"))
    for run in (
        lambda d: hilbert_shards.shard(d, 5),
        lambda d: decontaminate.flag(d, items),
        lambda d: byte_bpe.encode(d, *bpe),
        suffix_dedup.removed,
        simhash.classes,
        fingerprint.edited_pairs,
        line_dedup.dedup,
        lambda d: nbsvm.score(d, model),
        license_scan.scan,
    ):
        a, b = run(plain), run(odd)
        own = [c for c in a.columns if c not in CLASHES]
        assert b.count() == n
        assert sorted(map(repr, a.select(own).collect())) == sorted(map(repr, b.select(own).collect()))


def test_stages_keep_columns_and_stand_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").filter("doc_id < 12 OR doc_id >= 1000").selectExpr("*", "'x' AS score", "CAST(NULL AS STRING) AS n_words")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert name == "tokens" or out.columns == docs.columns and {(r.score, r.n_words) for r in out.collect()} == {("x", None)}
        assert name in ("quality", "near_copies", "contamination") or out.count() == docs.count()
        assert stage(spark, docs.limit(0), folder).count() == 0
