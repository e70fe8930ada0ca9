"""WARC fixity audit with Merkle trees.

Records lie in archives, one after another.  A record's place in all archives is a
number: the archive's number times a power of ``FANOUT`` and its number within.  The
leaves of a replica's tree are the hashes of page id, offset, length and record hash
at their places; a node of the next level covers the ordered range of ``FANOUT``
places below it and hashes their numbers and hashes.  Two replicas agree if their
roots do.  Where they differ, the audit compares the children of differing nodes
only, level by level.  The records of the differing leaves are then matched by
archive and page id, first those of one hash, the others in their order, so that a
lost record does not make those behind it 'changed': they are 'moved' if their bytes
moved up, and equal if its bytes are left as a hole.  A record that took another's
place differs in both places, so both of its sides are among those leaves.

A node gathers at most FANOUT children, archives hold about ``archive_records``
records, and a level's nodes are spread by their numbers, so no task or message
grows with the table.

Defined cases: null and empty urls and bodies are empty strings; null page ids stand
first in their archive; repeated rows are records of their own; an empty replica
lacks every record; two empty ones agree (no rows); extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fraudlens.llm._tables import materialize

FANOUT = 16


def warc_record(url: Column, body: Column, date: str = "2024-01-01T00:00:00Z") -> Column:
    """The text of a WARC response record."""
    body = F.coalesce(body, F.lit(""))
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
                    F.lit(f"\r\nWARC-Date: {date}\r\nContent-Type: text/html\r\nContent-Length: "),
                    F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(head, body, F.lit("\r\n\r\n"))


def archive_count(pages: DataFrame, archive_records: int = 1000) -> int:
    """The number of archives that a table fills."""
    return max(1, -(-pages.count() // archive_records))


def records(pages: DataFrame, archive_records: int = 1000, archives: int | None = None, found: Column | None = None) -> DataFrame:
    """The manifest of the archives of (page_id, url, html): archive, seq, page_id,
    offset, length and sha256 of every record.  ``archives``: their number; a replica
    has that of the original, however many records it still has.  ``found``: the body
    that a replica holds where the original has html; the order is that in which the
    original was written, lengths and hashes are those of the found body."""
    archives = archives or archive_count(pages, archive_records)
    text = warc_record(F.col("url").cast("string"), F.col("html").cast("string"))
    held = text if found is None else warc_record(F.col("url").cast("string"), found.cast("string"))
    digit = F.conv(F.substring(F.md5(F.coalesce(F.col("page_id").cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10)
    own = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.pmod(digit.cast("bigint"), F.lit(archives)).alias("archive"),
                       F.octet_length(held).cast("bigint").alias("length"), F.sha2(held.cast("binary"), 256).alias("sha256"),
                       F.sha2(text.cast("binary"), 256).alias("written"))
    order = Window.partitionBy("archive").orderBy(F.asc_nulls_first("page_id"), "written")
    return own.select("archive", (F.row_number().over(order) - 1).cast("bigint").alias("seq"), "page_id",
                      (F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length")).alias("offset"), "length", "sha256")


def depth(*manifests: DataFrame) -> tuple[int, int]:
    """(levels within an archive, levels in all) that hold every place of the manifests."""
    top = [m.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("s"), F.coalesce(F.max("archive"), F.lit(0)).alias("a")).first() for m in manifests]

    def levels(n: int) -> int:
        k = 0
        while FANOUT ** k <= n:
            k += 1
        return k
    within = levels(max(t.s for t in top))
    return within, within + levels(max(t.a for t in top))


def tree(manifest: DataFrame, within: int, levels: int) -> list[DataFrame]:
    """The nodes (place, digest) of each level; level 0 has the records."""
    place = F.col("archive") * F.lit(FANOUT ** within) + F.col("seq")
    leaf = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in ("page_id", "offset", "length", "sha256")])
    out = [materialize(manifest.withColumn("place", place).withColumn("digest", F.sha2(leaf.cast("binary"), 256)), "fixity-level")]
    for _ in range(levels):
        below = out[-1].select("place", "digest")
        children = F.sort_array(F.collect_list(F.struct("place", "digest")))  # at most FANOUT
        node = below.groupBy(F.floor(F.col("place") / FANOUT).cast("bigint").alias("up")).agg(children.alias("c"))
        text = F.array_join(F.transform("c", lambda x: F.concat_ws(":", x["place"].cast("string"), x["digest"])), ";")
        out.append(materialize(node.select(F.col("up").alias("place"), F.sha2(text.cast("binary"), 256).alias("digest")), "fixity-level"))
    return out


def _matched(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """The full join of records (columns a_*, b_*) by null-safe ``keys``, the records of
    one key in the order of their places."""
    def numbered(t: DataFrame, p: str) -> DataFrame:
        order = Window.partitionBy(*[p + k for k in keys]).orderBy(p + "place")
        return t.withColumn(p + "n", F.row_number().over(order))
    on = [F.col("a_" + k).eqNullSafe(F.col("b_" + k)) for k in (*keys, "n")]
    return numbered(a, "a_").join(numbered(b, "b_"), on, "full").drop("a_n", "b_n")


def audit(expected: DataFrame, found: DataFrame) -> DataFrame:
    """The records in which two manifests differ: status (changed: another hash; moved:
    the same at another offset; missing; extra), page_id, archive, seq, offset, length
    (of the expected record, of the found one if it is extra), expected_sha256 and
    found_sha256."""
    within, levels = depth(expected, found)
    one, two = tree(expected, within, levels), tree(found, within, levels)
    differing = None  # places of the level above
    for level in range(levels, -1, -1):
        a, b = ((t[level] if differing is None else
                 t[level].withColumn("up", F.floor(F.col("place") / FANOUT).cast("bigint")).join(differing, "up", "left_semi").drop("up"))
                for t in (one, two))
        a, b = (t.select([F.col(c).alias(p + c) for c in t.columns]) for t, p in ((a, "a_"), (b, "b_")))
        both = a.join(b, F.col("a_place") == F.col("b_place"), "full").filter(~F.col("a_digest").eqNullSafe(F.col("b_digest")))
        both = materialize(both, "fixity-differing")
        if level:
            differing = both.select(F.coalesce("a_place", "b_place").alias("up"))
    left, right = ([c for c in both.columns if c.startswith(p)] for p in ("a_", "b_"))
    same = materialize(_matched(both.filter("a_place IS NOT NULL").select(left), both.filter("b_place IS NOT NULL").select(right),
                                ["archive", "page_id", "sha256"]), "fixity-matched")
    rest = _matched(same.filter("b_place IS NULL").select(left), same.filter("a_place IS NULL").select(right), ["archive", "page_id"])
    told = same.filter("a_place IS NOT NULL AND b_place IS NOT NULL AND (a_offset <> b_offset OR a_length <> b_length)").unionByName(rest)
    status = (F.when(F.col("a_place").isNull(), "extra").when(F.col("b_place").isNull(), "missing")
              .when(F.col("a_sha256") == F.col("b_sha256"), "moved").otherwise("changed"))
    fields = [F.when(F.col("a_place").isNotNull(), F.col(f"a_{c}")).otherwise(F.col(f"b_{c}")).alias(c)
              for c in ("page_id", "archive", "seq", "offset", "length")]
    return told.select(status.alias("status"), *fields, F.col("a_sha256").alias("expected_sha256"), F.col("b_sha256").alias("found_sha256"))
