"""Line dedup where a doc_id repeats with different texts."""

import pytest

pytest.importorskip("candlemill.llm")
from candlemill.llm import common, line_dedup  # noqa: E402


def test_each_row_meets_its_own_bitmap(spark):
    common.prepare(spark)
    a, b = "a line that is long enough to count, and is repeated", "another line that is long enough, repeated as well"
    rows = [(1, f"first\n{a}"), (1, f"{b}\nsecond\n{a}"), (1, "third"), (1, None)] + [(i, f"{a}\n{b}") for i in range(2, 8)]
    out = line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted((r.doc_id, r.text or "") for r in out.collect())
    assert got == sorted([(1, "first"), (1, "second"), (1, "third"), (1, "")] + [(i, "") for i in range(2, 7)] + [(7, f"{a}\n{b}")])
