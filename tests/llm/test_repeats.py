"""Removal of repeated passages against a direct search for windows."""

from corpora import WORD, corpus, frame, words

from fraudlens.llm import repeats as R


def plain(rows, window=13):
    last = (1 << 63) - 1
    texts = [WORD.findall(t or "") for _, t, *_ in rows]
    least = {}
    for (i, *_), w in zip(rows, texts):
        for k in range(len(w) - window + 1):
            key = tuple(w[k:k + window])
            least[key] = min(least.get(key, last), last if i is None else i)
    out = []
    for (i, *_), w in zip(rows, texts):
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if least[tuple(w[k:k + window])] < (last if i is None else i):
                gone[k:k + window] = [True] * window
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def agree(spark, rows, **extra):
    got = R.without_repeats(frame(spark, rows, **extra)).collect()

    def key(x):
        return tuple((v is None, v) for v in x)
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=key) == sorted(plain(rows), key=key)
    assert all(sum(s["to"] - s["from"] for s in r.repeats) == r.n_removed for r in got)


def test_edges(spark):
    agree(spark, corpus(), extra=["id", "marks", "kept_words"])
    assert R.without_repeats(frame(spark, corpus()).limit(0)).count() == 0


def test_split_prefixes_and_many_settlings(spark, monkeypatch):
    """Every text settled alone and small groups: all repeats meet in the groups."""
    shared = words(60, 3)
    rows = [(i, " ".join(words(i % 9, i) + shared[i % 5:40 + i % 20] + ["the"] * (i % 40) + words(15, 50 + i)), "en", "s") for i in range(60)]
    monkeypatch.setattr(R, "SETTLE", 1)
    monkeypatch.setattr(R, "GROUP", 50)
    agree(spark, rows)


def test_groups_cover_every_bucket():
    import numpy as np
    counts = np.zeros(4096, dtype=np.int64)
    counts[[3, 5, 9]] = 10_000_000, 10, 500_000
    g = R.Groups(counts, 4)
    names = np.arange(100_000, dtype=np.uint64)
    hot = np.bincount(g.of(np.full(100_000, 3), names), minlength=g.n)
    assert g.n == 6 and (hot > 0).sum() >= g.n - 1
    assert len(set(g.of(np.full(100, 5), names[:100]).tolist())) == 1


def thue_morse(a, b, letters=1024):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(letters))


def test_words_that_weak_hashes_confuse(spark):
    """Words of 1,024 letters in the Thue-Morse pattern and its complement."""
    tail = words(12, 4)
    rows = [(1, " ".join([thue_morse("a", "b"), *tail]), "en", "s"), (2, " ".join([thue_morse("b", "a"), *tail]), "en", "s"),
            (3, " ".join([thue_morse("a", "b", 64), *tail]), "en", "s"), (4, " ".join([thue_morse("b", "a", 64), *tail]), "en", "s"),
            (5, " ".join([thue_morse("x", "yy")] * 20), "en", "s"), (6, " ".join([thue_morse("yy", "x")] * 20), "en", "s")]
    agree(spark, rows)


def test_names_follow_words_and_their_order():
    import numpy as np

    from fraudlens.llm._words import Words
    for k in (1, 2, 3, 5, 8, 13):
        for family in (0, 1):
            one, two = (Words([t.encode()]).windows(k, family) for t in (" ".join(words(300, 5, 9)), "q  " + "\n".join(words(300, 5, 9))))
            own = [tuple(words(300, 5, 9)[i:i + k]) for i in range(301 - k)]
            assert (one[1] == two[1][1:]).all()
            assert len(set(own)) == len(np.unique(one[1])) and len(set(zip(own, one[1].tolist()))) == len(set(own))
    long = ["x" * n for n in range(1, 200)] + ["x" * n + "y" for n in range(200)]
    assert len(np.unique(Words([" ".join(long).encode()]).hash)) == len(set(long))
    assert (Words([b"ABC Def"], lower=True).hash == Words([b"abc def"]).hash).all()
