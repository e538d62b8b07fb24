"""Toxicity: restored words, the decoder against all readings, held-out accuracy, odd rows."""

import itertools
import random

import numpy as np
import pytest

pytest.importorskip("candlemill.llm")
from candlemill.llm import toxicity  # noqa: E402

RUDE = ("idiot", "clown", "scum", "moron", "stupid", "trash")
MILD = ("the river runs past a mill and under old stone bridges toward open water while birds keep low over fields "
        "morning light comes slowly through tall windows onto wooden tables where letters wait unread").split()  # fmt: skip


def corpus(n=400):
    draw = random.Random(3)
    rows = []
    for i in range(n):
        words = [draw.choice(MILD) for _ in range(draw.randint(10, 60))]
        toxic = i % 4 == 0
        for _ in range(2 if toxic else 0):
            words.insert(draw.randrange(len(words)), draw.choice(RUDE))
        rows.append((i, " ".join(words).capitalize() + ".", int(toxic)))
    return rows


@pytest.fixture(scope="module")
def tables(spark):
    rows = corpus()
    return spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string"), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")


@pytest.fixture(scope="module")
def restorer(tables):
    return toxicity.Restorer(toxicity.language_model(tables[0]))


def hidden(w):
    return [w.translate(str.maketrans("oiesat", "013547")), " ".join(w), ".".join(w), w[0] + w[1] * 4 + w[2:], w.upper() + "!!!", w[:3] + "-" + w[3:], w.translate(str.maketrans("sia", "$!@")), "_".join(w).upper(), w[:2] + "​" + w[2:], w[:-2] + "*" + w[-1]]


def test_words_are_restored(restorer):
    for w in RUDE:
        found = ["".join(restorer.counted(x)) for x in hidden(w)]
        assert found == [w] * len(found), (w, found)
        assert restorer.restored(f"The  {hidden(w)[0]}\nruns") == f"the  {w}\nruns"
    for i, text, _ in corpus(60):
        assert sum(restorer.counted(text).values()) == len(text.split())


def test_counts_of_the_language_model(spark, tables):
    words = " ".join(t.lower().strip(".") for _, t, _ in corpus()).split()
    plain = np.zeros(toxicity.SIGNS**4)
    for w in words:
        if len(w) > 1:
            signs = [0, 0, 0, *[toxicity.sign(c) for c in w], 0]
            for k in range(3, len(signs)):
                a, b, c, d = signs[k - 3 : k + 1]
                plain[((a * 32 + b) * 32 + c) * 32 + d] += 1
    assert np.allclose(toxicity.language_model(tables[0]), toxicity.log_costs(plain))


def test_best_is_the_cheapest_of_all_readings(restorer):
    for piece in ("m0r0n", "5tup1d", "sc-um", "tr@$h", "cloown", "id1", "a b c"):
        lattice = restorer.lattice(piece)

        def cost(path):
            total, signs = sum(c for c, _ in path), [0, 0, 0]
            for x in "".join(e for _, e in path) + " ":
                s = toxicity.sign(x) if x.isalpha() else 0
                if s or signs[-1]:
                    a, b, c = signs[-3:]
                    total += float(restorer.costs[((a * 32 + b) * 32 + c) * 32 + s])
                signs = [0, 0, 0] if not s else [*signs, s]
            return total

        best = min(itertools.product(*lattice), key=cost)
        assert abs(cost(best) - min(cost(p) for p in itertools.product(*lattice) if "".join(e for _, e in p) + " " == restorer.best(lattice))) < 1e-3


def test_held_out_accuracy_and_hidden_words(spark, tables, restorer):
    documents, labels = tables
    model = toxicity.train(documents, labels, restorer)
    got = {r.doc_id: r for r in toxicity.score(documents, restorer, model).collect()}
    right = [int(got[i].predicted == y) for i, _, y in corpus()]
    assert len(got) == 400 and np.mean(right) >= 0.99
    more = [(1000 + k, " ".join([*MILD[:12], x, *MILD[12:20], x, *MILD[20:]])) for k, x in enumerate(x for w in RUDE for x in hidden(w))]
    caught = toxicity.score(spark.createDataFrame(more, "doc_id long, text string"), restorer, model).collect()
    assert np.mean([r.predicted for r in caught]) >= 0.95


def test_odd_rows(spark, restorer, tables):
    documents, labels = tables
    odd = [(None, "no id"), (1, None), (1, None), (2, ""), (3, "a " * 50000), (4, "x" * 100000 + "1"), (5, "*" * 5000), (6, "9a" * 3000), (7, "идиот ёж idiоt"), (8, "😀 $$$ !!! ..."), (9, "a.b.c.d " * 100)]
    frame = spark.createDataFrame([(*r, "kept") for r in odd], "doc_id long, text string, `Score` string").withColumnRenamed("Score", "SCORE")
    model = toxicity.train(documents, spark.createDataFrame([(1, 5), (None, 1), (2, None)], "doc_id long, toxic int"), restorer)
    out = toxicity.score(frame, restorer, model)
    assert out.columns == ["doc_id", "score", "predicted"] and {r.score for r in out.collect()} == {0.5}
    full = toxicity.train(documents.unionByName(spark.createDataFrame(odd, "doc_id long, text string")), labels, restorer)
    got = toxicity.score(frame, restorer, full).collect()
    assert len(got) == len(odd) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(frame.limit(0), restorer, full).count() == 0
    assert np.isfinite(toxicity.language_model(documents.limit(0))).all()
    back = {(r.doc_id, r.text): r.restored for r in toxicity.restore(spark.createDataFrame(odd, "doc_id long, text string"), restorer).collect()}
    assert back[(1, None)] is None and back[(2, "")] == ""
