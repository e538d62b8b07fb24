"""Fill-in-middle against a plain version on whole texts, and on odd rows."""

import hashlib
import re

import pytest

pytest.importorskip("candlemill.llm")
from candlemill.llm import fill_middle  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402


def plain(doc, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text, re.S)
    h = hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 20:
        return doc, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts():
    odd = [None, "", " ", "a", "7", "<P>", "a<S>b", "no < marks > here", "\n\n", "é", "😀 a😀b", "Straße über\r\nalles\x00x", "<", "x" * 5000, "ab1 " * 4000, ("q" * 2047 + " ") * 5, ("w" * 9000 + "-") * 3, "ü" * 2048 + "a" * 3000, "a.b " * 40000 + "ends"]
    out = [(i, t) for i, t in enumerate(odd * 4)]
    return [*out, (None, "words of no document"), (3, "one id, another text"), (3, "one id, another text"), (-7, "below zero")]


def test_against_plain_version(spark):
    rows = texts() + [(1, "the same row many times over")] * 30
    out = fill_middle.transform(spark.createDataFrame(rows, "doc_id long, text string"))
    got = out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str(plain(*r)) for r in rows)
    back = out.select("doc_id", "text", fill_middle.restore(F.col("output"), F.col("form")).alias("back")).collect()
    assert all(r.back == (r.text or "") for r in back)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_names_types_and_empty(spark):
    names = ("_text", "_k1", "piece", "N", "Form", "end", "unit", "a.b")
    rows = [(*["extra"] * len(names), f"id-{i}", t) for i, t in texts() if t is None or len(t) < 100]
    schema = ", ".join(f"`{c}` string" for c in names) + ", doc_id string, text string"
    out = fill_middle.transform(spark.createDataFrame(rows, schema))
    at = [out.columns.index(c) for c in ("doc_id", *fill_middle.RESULTS)]
    assert sorted(str(tuple(r[k] for k in at)) for r in out.collect()) == sorted(str(plain(*r[-2:])) for r in rows)
    assert out.columns == ["_text", "_k1", "piece", "end", "unit", "a.b", "doc_id", "text", *fill_middle.RESULTS]
    empty = fill_middle.transform(spark.createDataFrame([], schema))
    assert empty.count() == 0 and empty.columns == out.columns
