"""The Merkle audit against a direct comparison of the manifests."""

import random

from pyspark.sql import functions as F

from fraudlens.llm import fixity as M


def pages(spark, n=300):
    rows = [(i, f"http://h{i % 5}/p{i}", f"<html>é page {i} {'x' * (i % 50)}</html>", "clash") for i in range(n)]
    rows += [(None, None, None, "clash"), (7, "http://h2/p7", "<html>é page 7 xxxxxxx</html>", "clash"), (n, "", "", "clash"), (n + 1, None, "y" * 100_000, "clash")]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string, sha256 string")


def test_audit_finds_exactly_the_differences(spark):
    own = M.records(pages(spark), archive_records=40).cache()
    rows = own.collect()
    r = random.Random(1)
    kept = [x for x in rows if r.random() > 0.05]
    other = [(*x[:5], "0" * 64) if r.random() < 0.05 else tuple(x) for x in kept]
    other += [(a, 500 + a, 9000 + a, 10 ** 6, 10, "f" * 64) for a in (0, 3)] + [(900, 0, 9999, 0, 10, "e" * 64)]
    replica = spark.createDataFrame(other, own.schema)
    a, b = {x[:2]: x for x in map(tuple, rows)}, {x[:2]: x for x in other}
    want = set()
    for k in set(a) | set(b):
        if k not in b:
            want.add(("missing", *k, a[k][3], a[k][5], None))
        elif k not in a:
            want.add(("extra", *k, b[k][3], None, b[k][5]))
        elif a[k][5] != b[k][5]:
            want.add(("changed", *k, a[k][3], a[k][5], b[k][5]))
    got = {(x.status, x.archive, x.seq, x.offset, x.expected_sha256, x.found_sha256) for x in M.audit(own, replica).collect()}
    assert got == want and len(want) > 10


def test_offsets_and_edges(spark):
    own = M.records(pages(spark), archive_records=40)
    text = pages(spark).select(F.sum(F.octet_length(M.warc_record(F.col("url"), F.col("html")))).alias("n")).first().n
    got = own.groupBy("archive").agg(F.max(F.col("offset") + F.col("length")).alias("e"), F.sum("length").alias("s"), F.count("seq").alias("n"), F.max("seq").alias("m")).collect()
    assert sum(x.s for x in got) == text and all(x.e == x.s and x.n == x.m + 1 for x in got)
    assert M.audit(own, own).count() == 0
    none = own.limit(0)
    assert M.audit(none, none).count() == 0
    assert {x.status for x in M.audit(own, none).collect()} == {"missing"} and M.audit(own, none).count() == 304
    assert {x.status for x in M.audit(none, own).collect()} == {"extra"}
    assert M.records(pages(spark).limit(0)).count() == 0


def test_equal_branches_are_not_descended(spark):
    own = M.records(pages(spark), archive_records=40)
    within, levels = M.depth(own)
    nodes = M.tree(own, within, levels)
    assert nodes[-1].count() == 1 and levels >= 2
    assert all(x.count() <= y.count() for x, y in zip(nodes[1:], nodes))


def test_records_at_wrong_offsets_differ(spark):
    """Bytes inserted between records: the hashes are the same, the places are not."""
    own = M.records(pages(spark), archive_records=40).cache()
    late = (F.col("archive") == 1) & (F.col("seq") >= 5)
    got = M.audit(own, own.withColumn("offset", F.when(late, F.col("offset") + 3).otherwise(F.col("offset")))).collect()
    assert {x.status for x in got} == {"moved"}
    assert sorted((x.archive, x.seq) for x in got) == sorted((x.archive, x.seq) for x in own.filter(late).select("archive", "seq").collect())


def test_a_lost_record_does_not_change_the_others(spark):
    """Manifests made independently of each other, the replica's from fewer pages."""
    n = M.archive_count(pages(spark), 40)
    gone = (20, 41, 150)
    own = M.records(pages(spark), archives=n).cache()
    found = M.records(pages(spark).filter(~F.coalesce(F.col("page_id").isin(*gone), F.lit(False))), archives=n).cache()
    got = M.audit(own, found).collect()
    assert sorted(x.page_id for x in got if x.status == "missing") == list(gone)
    assert {x.status for x in got} == {"missing", "moved"}
    at = {(x.page_id, x.seq): x.offset for x in own.collect()}
    first = {}
    for x in own.collect():
        if x.page_id in gone:
            first[x.archive] = min(first.get(x.archive, x.seq), x.seq)
    late = {(x.page_id, x.seq) for x in own.collect() if x.seq > first.get(x.archive, 10 ** 9) and x.page_id not in gone}
    assert {(x.page_id, x.seq) for x in got if x.status == "moved"} == late and all(x.offset == at[x.page_id, x.seq] for x in got)


def test_a_rotten_replica_keeps_the_order_it_was_written_in(spark):
    rows = [(1, "u", f"<p>{i} eel</p>", "") for i in range(8)] + [(2, "u", "eel", "")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, sha256 string")
    own = M.records(df).cache()
    got = M.audit(own, M.records(df, found=F.translate("html", "e", "3"))).collect()
    assert len(got) == 9 and {x.status for x in got} == {"changed"} and [x.seq for x in sorted(got, key=lambda x: x.seq)] == list(range(9))
