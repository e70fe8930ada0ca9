import hashlib
import re

import numpy as np
import pytest
from corpora import corpus, frame
from pyspark.sql import functions as F

from fraudlens.llm.infill import SkipList, fill_in_middle, infill, restored, unit_widths

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
MARKS = ("<P>", "<S>", "<M>")


def plain_form(doc_id, text):
    """The definition, without a skip list."""
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i:8 * i + 8], 16) for i in range(4))
    n = len(units)
    if not text or any(m in text for m in MARKS) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_units_are_those_of_the_pattern():
    for text in ("", " ", "a", " a", "a ", "  a\t b\n", "naïve 漢字 🙂  x", " a   b", "a\x1cb\x85 c", "x" * 5000, " \n" * 3000):
        assert unit_widths(text).tolist() == [len(u) for u in UNIT.findall(text)]


@pytest.mark.parametrize("n", [0, 1, 2, 5, 17, 300, 20_000])
def test_skip_list_finds_every_rank(n):
    widths = np.random.default_rng(n).integers(1, 40, n)
    total = np.concatenate(([0], np.cumsum(widths)))
    cuts = SkipList(widths, 42)
    for rank in {0, n, n // 2, n // 3, min(n, 1), max(0, n - 1), *range(0, n, max(1, n // 50))}:
        assert cuts.code_points(rank) == total[rank]
    for (units, points, down), (below, wide, _) in zip(cuts.lanes[1:], cuts.lanes):
        assert units.sum() == n and points.sum() == total[-1] and down[0] == 0 and len(units) == len(down) <= len(below)


def test_search_visits_few_nodes():
    cuts = SkipList(np.full(1 << 18, 3), 42)
    assert cuts.code_points(200_001) == 600_003
    assert len(cuts.lanes) <= 14


def test_equal_to_the_definition_and_restored(spark):
    rows = corpus() + [(500 + i, f"a <P> b {i}", None, None) for i in range(8)] + [(600 + i, f"<a <b{i}< S><< <M x\r\n  ", None, None) for i in range(40)] \
        + [(700, "y " * 200_000, None, None)]
    docs = frame(spark, rows, extra=("n", "passed", "__x"))
    got = fill_in_middle(docs).withColumn("back", restored(F.col("output"), F.col("form"))).collect()
    assert len(got) == len(rows)
    key = lambda r: (str(r[0]), str(r[1]))
    for r, (i, t, *_) in zip(sorted(got, key=lambda r: key((r.doc_id, r.text))), sorted(rows, key=key)):
        assert (r.n_units, r.form, r.prefix_chars, r.middle_chars, r.output) == plain_form(i, t)
        assert r.back == (t or "") and r.n == "clash"
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_no_rows_clashes_and_markers(spark):
    docs = frame(spark, [])
    assert fill_in_middle(docs).count() == 0
    with pytest.raises(ValueError):
        fill_in_middle(docs.withColumn("Form", F.lit(1)))
    for bad in (("<P>", "<P>", "<M>"), ("a", "ab", "c"), ("", "b", "c"), ("<<", "x", "y")):
        with pytest.raises(ValueError):
            fill_in_middle(docs, markers=bad)
    got = infill(1, "one two three", 42, 100, 0, ("[p", "{s", "(m"))
    assert got[1] == "psm" and got[4].startswith("[p")
