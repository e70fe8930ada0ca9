"""The inverted join against all pairs of sets, on fixtures with families and edges."""

import random

from corpora import WORD, corpus, frame, words

from fraudlens.llm import near_duplicates as N


def plain_set(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i:i + 2]) for i in range(max(len(w) - 1, 1))} if w else set()


def plain_components(rows):
    sets = [plain_set(t) for _, t, *_ in rows]
    of = list(range(len(rows)))

    def find(x):
        while of[x] != x:
            x = of[x]
        return x
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                of[find(i)] = find(j)
    groups = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            groups[find(i)] = min(groups.get(find(i), r[0]), r[0])
    return [(r[0], len(s), groups.get(find(i)) if s else r[0]) for i, (r, s) in enumerate(zip(rows, sets))]


def agree(spark, rows, **extra):
    got = N.near_duplicates(frame(spark, rows, **extra)).collect()

    def key(x):
        return tuple((v is None, v) for v in x)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=key) == sorted(plain_components(rows), key=key)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_edges_and_families(spark):
    agree(spark, corpus(), extra=["node", "tag", "list", "signature"])
    assert N.near_duplicates(frame(spark, corpus()).limit(0)).count() == 0


def test_a_large_family_with_chains(spark, monkeypatch):
    """Copies that drift apart: links chain, and hubs alone do not find them all."""
    monkeypatch.setattr(N, "HUBS", 1)
    monkeypatch.setattr(N, "BLOCK", 16)
    r, own, rows = random.Random(1), words(90, 5, 5000), []
    for i in range(120):
        rows.append((1000 - 3 * i, " ".join(own), "en", "s"))
        own = list(own) if i % 7 else list(own[:80]) + words(10, 900 + i, 5000)
        for _ in range(r.randrange(4)):
            own[r.randrange(len(own))] = f"y{r.randrange(10**6)}"
    agree(spark, rows)


def test_dedup_keeps_one_row_a_class(spark):
    rows = corpus() + [(None, "another text without an id", "en", "s1"), (None, "another text without an id", "en", "s2")]
    got = N.without_near_duplicates(frame(spark, rows)).collect()
    want = {c for _, n, c in plain_components(rows) if n} - {None}
    some = [r for r in got if plain_set(r.text)]
    # 81 names two unlike texts: two classes
    assert sorted(r.doc_id for r in some if r.doc_id is not None) == sorted([*want, 81])
    assert sorted(r.text for r in some if r.doc_id is None) == ["a text without an id", "another text without an id"]
    assert len(got) - len(some) == sum(1 for r in rows if not plain_set(r[1]))


def test_words_that_weak_hashes_confuse(spark):
    """One-word texts of 1,024 letters in the Thue-Morse pattern and its complement."""
    def text(a, b):
        return "".join(b if bin(i).count("1") % 2 else a for i in range(1024))
    agree(spark, [(i, t, "en", "s") for i, t in enumerate((text("a", "b"), text("b", "a"), text("c", "d"), text("d", "c"), text("A", "B")))])


def alike(n, differ, seed=2):
    """n texts of 100 words, each with ``differ`` words of its own at random places."""
    r, base, rows = random.Random(seed), words(100, seed, 9000), []
    for i in range(n):
        own = list(base)
        for k in r.sample(range(100), differ):
            own[k] = f"z{i}_{k}"
        rows.append((i, " ".join(own), "en", "s"))
    return rows


def test_rows_between_stages_do_not_grow_with_the_pairs_of_a_group(spark, monkeypatch):
    """Groups near 0.71 that stay apart, of growing size: rows of pairs and of their ends."""
    seen = []
    own = N.pairs

    def watch(*args):
        found = N.materialize(own(*args), "near-pairs")
        seen.append((found.count(), N._ends(found).count()))
        return found
    monkeypatch.setattr(N, "pairs", watch)
    got = {}
    for n in (60, 240):
        seen.clear()
        agree(spark, alike(n, 4))
        got[n] = [sum(x) for x in zip(*seen)]
    assert got[240][0] <= 6 * got[60][0] and got[240][1] <= 6 * max(got[60][1], 60)  # 16 times the pairs


def test_pairs_of_two_open_nodes_are_counted_once(spark):
    docs = frame(spark, alike(40, 1)).select("doc_id", "text", N.text_tag())
    nodes = N.signatures(docs, 2).filter("n_shingles > 0").cache()
    near = N.postings(nodes).withColumn("component", N.F.col("node")).withColumn("open", N.F.lit(True))
    found = [(r.node, o) for r in N.pairs(near, nodes, 8, 80).filter("node IS NOT NULL").collect() for o in r.others]
    assert len(found) == len(set(found)) == len({frozenset(p) for p in found}) > 40 * 39 // 4
