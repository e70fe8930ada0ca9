import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from corpora import corpus, frame

from fraudlens.llm import collocations as C

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(text):
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER))]


def plain(rows, longest=5, least=3, percent=100, top=2000):
    """(lang, rank, phrase, a, l, r, n, score) by the definition."""
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, _ in rows:
        for words in pieces(text):
            n[lang or "und"] += len(words)
            for m in range(1, longest + 1):
                f[lang or "und"].update(tuple(words[i:i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, own in f.items():
        many = {p: c for p, c in own.items() if len(p) > 1 and c >= least}
        inside = defaultdict(int)
        for p, c in many.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    inside[p[i:i + m]] = max(inside[p[i:i + m]], c)
        told = []
        for p, a in many.items():
            if 100 * inside[p] >= percent * a and p in inside and inside[p]:
                continue
            score, k = min((1000 * a * n[lang] // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
            told.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(told)[:top])]
    return sorted(out)


def told(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


def phrases(seed, n, vocabulary):
    r = random.Random(seed)
    fixed = ["New York City", "to be, or not to be", "a.b c", "x x x x x x x", "naïve café 漢字", "state of the art"]
    return " ".join(r.choice(fixed) if r.random() < 0.2 else f"w{int(r.random() ** 3 * vocabulary)}" + r.choice(["", "", "", ".", "\n", "\t", " ", "!?"]) for _ in range(n))


ROWS = corpus() + [(1000 + i, phrases(i, 60, 30), ["en", "de", None][i % 3], "s") for i in range(120)] \
    + [(2000, phrases(5, 9000, 40), "en", "s"), (2001, "hot words here again " * 3000, "en", "s"), (2002, "\n.,;" * 500, "zz", "s"), (2003, "\x1c\x85 a\x1cb a\x1cb\x0b a\x1cb", "u", "s")]


def test_equal_to_the_definition(spark):
    docs = frame(spark, ROWS, extra=("phrase", "f", "m", "h"))
    assert told(C.top_collocations(docs, least=3)) == plain(ROWS)


def test_top_percent_and_longest(spark):
    docs = frame(spark, ROWS)
    assert told(C.top_collocations(docs, top=7, longest=3, least=4, percent=60)) == plain(ROWS, 3, 4, 60, 7)


def test_small_groups_use_longer_prefixes_and_long_texts_are_cut(spark, monkeypatch):
    monkeypatch.setattr(C, "GROUP", 40)
    monkeypatch.setattr(C, "SETTLE", 3000)
    used = []
    build = C.Prefixes.__init__

    def watch(self, *args):
        build(self, *args)
        used.append(self)
    monkeypatch.setattr(C.Prefixes, "__init__", watch)
    docs = frame(spark, ROWS).repartition(5)
    assert told(C.top_collocations(docs, least=3)) == plain(ROWS)
    assert used[0].n > 100 and (used[0].group[:3] >= 0).any(axis=1).all()  # prefixes of one, two and three words


def test_stretches_of_a_long_text_have_each_suffix_once():
    text = phrases(3, 4000, 50).encode()
    own = C.Block([(list(t), n) for t, n in C._cuts(text, 5)])
    old, C.SETTLE = C.SETTLE, 700
    try:
        cut = C.Block([(list(t), n) for t, n in C._cuts(text, 5)])
    finally:
        C.SETTLE = old

    def suffixes(b):
        rows, n = b.suffixes(b.lengths(np.ones(len(b.words), dtype=bool), 5), 1, 5)
        return sorted((tuple(b.words[w] for w in r if w >= 0), c) for r, c in zip(rows.tolist(), n.tolist()))
    assert suffixes(own) == suffixes(cut) and len(cut.at) > len(own.at)


def test_blocks_are_read_as_written():
    rows = np.array([[3, 1, -1], [3, 1, 2], [7, 7, 7]], dtype=np.int32)
    words = [f"w{i}".encode() for i in range(9)]
    for own in (rows, rows[1:]):
        block = dict(zip((c.split()[0] for c in C._BLOCK.split(", ")), C.packed(own, np.arange(len(own)) + 1, words, "en", 4, 1)))
        back, n, names = C.unpacked(block, 3)
        assert n.tolist() == list(range(1, len(own) + 1))
        assert [[names[w] if w >= 0 else None for w in r] for r in back.tolist()] == [[words[w] if w >= 0 else None for w in r] for r in own.tolist()]


@pytest.mark.parametrize("scale", [1, 10 ** 12])
def test_scores_are_exact(spark, scale, monkeypatch):
    rows = [("en", "a", 1, 3 * scale), ("en", "b", 1, 7 * scale), ("en", "a b", 2, 2 * scale + 1), ("en", "b a", 2, 3 * scale)]
    counted = spark.createDataFrame(rows, "lang string, phrase string, m int, f bigint")
    totals = spark.createDataFrame([("en", 10 * scale + 3)], "lang string, n bigint")
    monkeypatch.setattr(C, "phrase_counts", lambda *args: (counted, totals))
    got = {r.phrase: r.score for r in C.collocations(None).collect()}
    assert got == {p: 1000 * a * (10 * scale + 3) // (21 * scale * scale) for p, a in (("a b", 2 * scale + 1), ("b a", 3 * scale))}


def test_no_rows(spark):
    assert C.top_collocations(frame(spark, [])).count() == 0
    assert C.top_collocations(frame(spark, [(1, None, None, None), (2, "", "en", None), (3, "one", "en", None)]), least=1).count() == 0
