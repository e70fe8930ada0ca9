"""Graph operators on planted graphs."""

from pyspark.sql import functions as F

from fraudlens.operators import graph as G


def planted(spark):
    # two dense blocks joined by one light edge
    rows = []
    for c in range(4):
        for m in range(3):
            rows.append((f"a{c}", f"A{m}", 5))
            rows.append((f"b{c}", f"B{m}", 5))
    rows.append(("a0", "B0", 1))
    df = spark.createDataFrame(rows, "card_id string, merchant_id string, weight long")
    return df.select(F.concat(F.lit("card_"), "card_id").alias("src"),
                     F.concat(F.lit("merchant_"), "merchant_id").alias("dst"), "card_id", "merchant_id", "weight")


def test_label_propagation_recovers_planted_blocks(spark):
    comm = {r.node: r.community_id for r in G.label_propagation(planted(spark)).collect()}
    a = {comm[f"card_a{i}"] for i in range(4)} | {comm[f"merchant_A{i}"] for i in range(3)}
    b = {comm[f"card_b{i}"] for i in range(4)} | {comm[f"merchant_B{i}"] for i in range(3)}
    assert len(a) == 1 and len(b) == 1 and a != b


def test_modularity_of_planted_partition_is_positive(spark):
    e = planted(spark)
    comm = G.label_propagation(e)
    q = G.modularity(e, comm).first().modularity
    one = comm.withColumn("community_id", F.lit("x"))
    assert q > 0.4 and abs(G.modularity(e, one).first().modularity) < 1e-9


def test_connected_components(spark):
    e = planted(spark).filter(~((F.col("card_id") == "a0") & (F.col("merchant_id") == "B0")))
    comp = {r.node: r.component for r in G.connected_components(e).collect()}
    assert len(set(comp.values())) == 2
    assert comp["card_a1"] == comp["merchant_A2"] != comp["card_b0"]


def test_induced_edges_and_sample(spark):
    e = planted(spark)
    comm = G.label_propagation(e)
    cid = comm.filter("node = 'card_a0'").first().community_id
    members = comm.filter(F.col("community_id") == cid)
    sub = G.induced_edges(e, members).collect()
    assert len(sub) == 12 and all(r.src.startswith("card_a") for r in sub)
    sample = G.display_sample(e, comm, cid, max_cards=2, max_merchants=2).collect()
    assert len({r.src for r in sample}) <= 2 and len({r.dst for r in sample}) <= 2


def test_components_on_long_chain(spark):
    # a path of 120 nodes alternating card / merchant: diameter 119
    rows = []
    for i in range(60):
        rows.append((f"card_{i:03d}", f"merchant_{i:03d}", 1))
        if i + 1 < 60:
            rows.append((f"card_{i + 1:03d}", f"merchant_{i:03d}", 1))
    e = spark.createDataFrame(rows, "src string, dst string, weight long")
    comp = G.connected_components(e).collect()
    assert len(comp) == 120 and {r.component for r in comp} == {"card_000"}


def blocks(spark, groups=4, cards=6, merchants=3):
    """Dense blocks in a ring, each joined to the next by one light edge."""
    rows = [(f"card_{g}_{c}", f"merchant_{g}_{m}", 4) for g in range(groups) for c in range(cards) for m in range(merchants)]
    rows += [(f"card_{g}_0", f"merchant_{(g + 1) % groups}_0", 1) for g in range(groups)]
    return rows, spark.createDataFrame(rows, "src string, dst string, weight long")


def score(rows, label, resolution=1.0):
    """Modularity by its definition."""
    m = sum(w for *_, w in rows)
    inner, total = {}, {}
    for s, d, w in rows:
        for n in (s, d):
            total[label[n]] = total.get(label[n], 0) + w
        if label[s] == label[d]:
            inner[label[s]] = inner.get(label[s], 0) + w
    return sum(inner.get(c, 0) / m - resolution * (t / (2 * m)) ** 2 for c, t in total.items())


def test_communities_find_planted_blocks(spark):
    rows, e = blocks(spark)
    label = {r.node: r.community_id for r in G.modularity_communities(e).collect()}
    found = {}
    for n, c in label.items():
        found.setdefault(c, set()).add(n.split("_")[1])
    assert len(found) == 4 and all(len(g) == 1 for g in found.values())
    assert all(c == min(n for n in label if label[n] == c) for c in found)


def test_communities_of_random_graph_merge_no_further(spark):
    import random

    rng = random.Random(5)
    pairs = {(f"card_{rng.randrange(40)}", f"merchant_{rng.randrange(15) if rng.random() < .6 else 0}") for _ in range(200)}
    rows = sorted((s, d, rng.randint(1, 5)) for s, d in pairs)  # merchant_0 is a hub
    e = spark.createDataFrame(rows, "src string, dst string, weight long")
    out = G.modularity_communities(e)
    label = {r.node: r.community_id for r in out.collect()}
    q = score(rows, label)
    assert abs(q - G.modularity(e, out).first().modularity) < 1e-8
    assert q > score(rows, {n: n for n in label}) and q > 0.1
    groups = sorted(set(label.values()))
    for i, x in enumerate(groups):  # the last level made no move: no two communities gain by merging
        for y in groups[i + 1:]:
            assert score(rows, {n: x if c == y else c for n, c in label.items()}) <= q + 1e-9
    assert label == {r.node: r.community_id for r in G.modularity_communities(e).collect()}


def test_settled_level_has_no_gaining_move(spark):
    rows, e = blocks(spark, groups=3, cards=4, merchants=2)
    rows.append(("card_0_0", "merchant_1_1", 3))
    both = rows + [(d, s, w) for s, d, w in rows]
    adjacent = spark.createDataFrame(both, "u string, v string, w long")
    degree = adjacent.groupBy(F.col("u").alias("node")).agg(F.sum("w").cast("double").alias("k"))
    state, moved = G._settled(adjacent, degree, F.lit(float(sum(w for *_, w in both))), 1.0)
    got = state.collect()
    label = {r.node: r.label for r in got}
    assert moved
    for r in got:  # totals are carried on; no node gains at a neighbour's community
        assert r.total == sum(x.k for x in got if x.label == r.label)
        for c in {label[v] for u, v, _ in both if u == r.node}:
            assert score(rows, {**label, r.node: c}) <= score(rows, label) + 1e-9


def test_communities_of_empty_and_single_edge(spark):
    e = spark.createDataFrame([("card_1", "merchant_1", 2)], "src string, dst string, weight long")
    assert G.modularity_communities(e.limit(0)).count() == 0
    assert {tuple(r) for r in G.modularity_communities(e).collect()} == {
        ("card_1", "card", "card_1"), ("merchant_1", "merchant", "card_1")}


def test_shared_stage_is_built_once_until_a_file_changes(spark, tmp_path):
    from fraudlens.sources import files

    path, built = str(tmp_path / "in"), []

    def build():
        built.append(1)
        return spark.read.parquet(path).agg(F.sum("id").alias("s"))

    def get(*params):
        return files.shared_stage(spark, "probe", [path], params, build).first().s
    spark.range(4).write.parquet(path)
    assert [get(), get(), len(built)] == [6, 6, 1]
    assert get("other") == 6 and len(built) == 2
    spark.range(4, 6).write.mode("append").parquet(path)
    assert get() == 15 and len(built) == 3


def test_community_rounds_carry_no_keys(spark, monkeypatch):
    """The tables that every round reads and writes hold node numbers, not texts, and an
    edge without a key at one end counts as weight only."""
    rows, _ = blocks(spark, groups=2)
    e = spark.createDataFrame(rows + [(None, "merchant_0_0", 2)], "src string, dst string, weight long")
    seen, settled = [], G._settled

    def spy(adjacent, degree, *rest):
        seen.append([t for df in (adjacent, degree) for _, t in df.dtypes])
        return settled(adjacent, degree, *rest)
    monkeypatch.setattr(G, "_settled", spy)
    out = G.modularity_communities(e).collect()
    assert seen and not any("string" in types for types in seen)
    assert len(out) == 18 and len({r.community_id for r in out}) == 2 and {r.node_type for r in out} == {"card", "merchant"}


def test_rounds_shuffle_no_edges(spark, monkeypatch):
    """Votes are summed where the edges lie: the best moves of a round of the first level need no shuffle."""
    _, e = blocks(spark, groups=2, cards=40, merchants=20)
    plans, best = [], G._best_moves

    def spy(adjacent, *rest):
        out = best(adjacent, *rest)
        plans.append((adjacent, out._jdf.queryExecution().executedPlan().toString()))
        return out
    monkeypatch.setattr(G, "_best_moves", spy)
    assert G.modularity_communities(e).count() == 120
    first = [p for adjacent, p in plans if adjacent is plans[0][0]]
    assert len(first) > 1 and not any("ENSURE_REQUIREMENTS" in p for p in first)


def test_hubs_get_the_same_communities(spark, monkeypatch):
    """Nodes whose votes are summed map-side and nodes whose edges are held together move alike."""
    rows, e = blocks(spark)
    rows += [("card_hub", f"merchant_{g}_{m}", 1 + g) for g in range(4) for m in range(3)]
    e = spark.createDataFrame(rows, "src string, dst string, weight long")

    def found(most, monkeypatch=monkeypatch):
        monkeypatch.setattr(G, "HUB_ROWS", most)
        return sorted(tuple(r) for r in G.modularity_communities(e).collect())
    assert len(found(1_000_000)) == 37
    assert found(1_000_000) == found(6) == found(0)


def tangled(spark, cards=30, merchants=12, edges=160):
    """A graph whose communities take many rounds."""
    import random

    rng = random.Random(11)
    rows = sorted({(f"card_{rng.randrange(cards)}", f"merchant_{rng.randrange(merchants)}", 1 + rng.randrange(3)) for _ in range(edges)})
    return spark.createDataFrame(rows, "src string, dst string, weight long")


def test_rounds_of_few_moves_write_no_tables(spark, monkeypatch):
    """A round whose moves fit the driver writes nothing; four tables a round before."""
    writes, rounds, best, written = [], [], G._best_moves, G._checkpoint
    monkeypatch.setattr(G, "_checkpoint", lambda df: writes.append(1) or written(df))
    monkeypatch.setattr(G, "_best_moves", lambda *a: rounds.append(1) or best(*a))
    assert G.modularity_communities(tangled(spark)).count() == 42
    assert len(rounds) > 5 and len(writes) < 2 * len(rounds)


def test_every_way_of_a_round_gives_the_same_communities(spark, monkeypatch):
    """Moves settled on the driver or by joins, votes summed anew or kept, few or many
    changes at once."""
    e = tangled(spark)

    def found(moves, kept, share=8):
        for name, value in (("MOVES_AT_ONCE", moves), ("KEPT_EDGES", kept), ("KEPT_SHARE", share)):
            monkeypatch.setattr(G, name, value, raising=False)
        return sorted(tuple(r) for r in G.modularity_communities(e).collect())
    joined = found(0, 10 ** 9)
    used, best = [], G._Kept.best
    monkeypatch.setattr(G._Kept, "best", lambda *a: used.append(1) or best(*a))
    assert len(joined) == 42 and found(200_000, 10 ** 9) == joined and not used
    assert found(200_000, 0, 1) == joined and used
    assert found(20, 0, 1) == joined
