"""Near copies of the pipeline against brute force over 5-word shingles."""

import random

import pytest

pytest.importorskip("candlemill.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")
from candlemill.llm import common, near_copies, simhash  # noqa: E402


def grams(text):
    words = simhash.WORD.findall((text or "").translate(common.ASCII_LOWER))
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def jaccard(a, b):
    a, b = grams(a), grams(b)
    return len(a & b) / len(a | b)


def brute(texts):
    low, ids = {i: i for i in texts}, sorted(texts)
    links = [(a, b) for a in ids for b in ids if a < b and jaccard(texts[a], texts[b]) >= 0.8]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            x = min(low[a], low[b])
            changed |= low[a] != x or low[b] != x
            low[a] = low[b] = x
    return {i for i in texts if low[i] == i}


def edited(rng, words, share):
    """A text of the same words with edits over about that share of its shingles."""
    out = list(words)
    for _ in range(max(1, round(len(words) * share / 5))):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return " ".join(out)


@pytest.mark.parametrize("long_lists", [False, True])
def test_pairs_beyond_two_bits(spark, long_lists, monkeypatch):
    if long_lists:  # lists this small take the way of long lists, in several blocks
        monkeypatch.setattr(near_copies, "BLOCK", 4)
        monkeypatch.setattr(near_copies, "PART", 3)
    rng = random.Random(5)
    texts = {}
    for n in (3, 7, 30, 120, 600):
        for _ in range(4):
            base = [f"w{rng.randrange(4000)}" for _ in range(n)]
            for share in (0, 0.03, 0.05, 0.08, 0.08, 0.11, 0.15, 0.3):
                texts[len(texts)] = edited(rng, base, share)
    texts |= {len(texts): None, len(texts) + 1: "", len(texts) + 2: " \n ", len(texts) + 3: texts[0].upper()}
    far = [(a, b) for a in texts for b in texts if a < b and jaccard(texts[a], texts[b]) >= 0.8 and (simhash.fingerprint(texts[a]) ^ simhash.fingerprint(texts[b])).bit_count() > 2]
    assert len(far) > 10, "pairs that op5's fingerprints do not link"
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    assert {r.doc_id for r in corpus_pipeline.near_copies(spark, docs, "").collect()} == brute(texts)
