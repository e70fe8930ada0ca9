"""The queries of the operators, over whole tables with production parameters."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fraudlens.llm._tables import documents, read, ship

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return fn(spark, sf_dir)
        QUERIES[name] = run
        if sql:
            ORACLE[name] = sql
        return run
    return add


@query("op1_quality_discriminant")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document by the regularised quadratic discriminant."""
    from fraudlens.llm.quality import quality_scores
    return quality_scores(documents(spark, sf_dir), read(spark, sf_dir, "labels")) \
        .select("doc_id", "held_out", "score", "predicted")


@query("op6_language_ppm")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by prediction by partial matching."""
    from fraudlens.llm.language import language_predictions
    return language_predictions(documents(spark, sf_dir))


def _vocabulary(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@query("op9_token_counts")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count of every document by the two-tier lookup."""
    from fraudlens.llm.token_counts import token_counts
    return token_counts(documents(spark, sf_dir), _vocabulary("byte_bpe_50k.json"))


@query("op10_bpe_segment_tree")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded by the segment tree and decoded again."""
    from fraudlens.llm.bpe import encode
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    told = encode(docs, _vocabulary("byte_bpe_50k.json"), decoded="decoded")
    return told.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
                       F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"),
                       F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query("op8_source_mix")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that the mix takes."""
    from fraudlens.llm.mixing import mixed_documents
    return mixed_documents(documents(spark, sf_dir))


@query("op4_order_minhash")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order MinHash of every document and of its edited text."""
    from fraudlens.llm.fingerprints import as_text, document_fingerprints
    return document_fingerprints(documents(spark, sf_dir)).select(
        "doc_id", "n_chars", F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("fingerprint")).alias("fingerprint"), as_text(F.col("edited_fingerprint")).alias("edited_fingerprint"),
        "near_edited", "near_next")


@query("op7_vantage_point_search", r"""
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
             AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
d AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, sqrt(list_sum(list_transform(list_zip(q.e, c.e),
             lambda x: (x[1] - x[2]) * (x[1] - x[2])))) AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank, vec_id, score
FROM d QUALIFY rank <= 10
""")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest vectors of every vector whose id is divisible by 100."""
    from fraudlens.llm.neighbours import nearest
    rows = read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return nearest(rows, rows.filter(F.col("vec_id") % 100 == 0))


OP3_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) = 1 THEN ws[1] ELSE ws[i] || ' ' || ws[i + 1] END AS s
       FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws), 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
l AS (SELECT x, y FROM (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS hits FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2)
      JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * hits >= 80 * (nx.n + ny.n - hits)),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.y FROM reach r JOIN l ON l.x = r.other),
c AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT c.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, c.doc_id = c.component_id AS kept FROM c LEFT JOIN n ON n.doc_id = c.doc_id
"""


@query("op3_minhash_join", OP3_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of the documents by the signature-coordinate inverted join."""
    from fraudlens.llm.near_duplicates import near_duplicates
    return near_duplicates(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id", "kept")


OP5_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
x AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)),
f AS (SELECT k, min(doc_id) AS d FROM x GROUP BY k),
h AS (SELECT DISTINCT doc_id, pos FROM (SELECT x.doc_id, unnest(range(i, i + 13)) AS pos FROM x JOIN f ON f.k = x.k WHERE x.doc_id > f.d)),
p AS (SELECT doc_id, pos, ws[pos] AS word FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS pos FROM w)),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS kept, count(*) AS c FROM p ANTI JOIN h USING (doc_id, pos) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(c, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON k.doc_id = w.doc_id
"""


@query("op5_suffix_tree_repeats", OP5_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages that an earlier document has."""
    from fraudlens.llm.repeats import without_repeats
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return without_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH n AS (SELECT greatest(1, CAST(ceil(count(*) / 1000.0) AS BIGINT)) AS archives FROM pages),
p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS body,
             CASE WHEN page_id % 97 = 5 THEN translate(coalesce(html, ''), 'e', '3') ELSE coalesce(html, '') END AS rotten FROM pages),
r AS (SELECT page_id, url, body, rotten,
             'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10)
             || 'WARC-Date: 2024-01-01T00:00:00Z' || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' AS head,
             chr(13) || chr(10) || chr(13) || chr(10) AS gap FROM p),
t AS (SELECT page_id, head || strlen(body) || gap || body || gap AS own, head || strlen(rotten) || gap || rotten || gap AS other,
             CAST('0x' || substr(md5(coalesce(CAST(page_id AS VARCHAR), '')), 1, 8) AS BIGINT) % (SELECT archives FROM n) AS archive FROM r),
m AS (SELECT page_id, archive, CAST(strlen(own) AS BIGINT) AS length, sha256(own) AS expected_sha256, sha256(other) AS other_sha256 FROM t),
o AS (SELECT *, CAST(row_number() OVER w - 1 AS BIGINT) AS seq, CAST(sum(length) OVER w - length AS BIGINT) AS "offset" FROM m
      WINDOW w AS (PARTITION BY archive ORDER BY page_id NULLS FIRST, expected_sha256 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT CASE WHEN page_id % 101 = 7 THEN 'missing' ELSE 'changed' END AS status, page_id, archive, seq, "offset", length, expected_sha256,
       CASE WHEN page_id % 101 = 7 THEN NULL ELSE other_sha256 END AS found_sha256
FROM o WHERE page_id % 101 = 7 OR expected_sha256 <> other_sha256
"""


@query("op2_merkle_fixity", OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit of the archives of all pages against a replica in which some bodies have
    rotted (page_id % 97 = 5) and some records are lost (page_id % 101 = 7), the others
    being where they were.  Every record of the replica is made and hashed from its own
    body."""
    from fraudlens.llm._tables import materialize
    from fraudlens.llm.fixity import archive_count, audit, records
    pages = read(spark, sf_dir, "pages")
    archives = archive_count(pages)
    own = materialize(records(pages, archives=archives), "fixity-manifest")
    body = F.when(F.col("page_id") % 97 == 5, F.translate("html", "e", "3")).otherwise(F.col("html"))
    replica = records(pages, archives=archives, found=body).filter("page_id IS NULL OR page_id % 101 <> 7")
    return audit(own, materialize(replica, "fixity-replica"))


OP13_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
             CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
             CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM t),
c AS (SELECT *, CAST(len(units) AS BIGINT) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
                  WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT doc_id, n, form, text, array_to_string(units[1:a], '') AS x, array_to_string(units[a + 1:b], '') AS y, array_to_string(units[b + 1:], '') AS z FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(x) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(y) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y ELSE '<S>' || z || '<P>' || x || '<M>' || y END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""


@query("op13_skip_list_infill", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut by the skip list, reordered, and restored from the output."""
    from fraudlens.llm.infill import fill_in_middle, restored
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return fill_in_middle(docs).select(
        "doc_id", F.col("n_units").alias("n"), "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"))


OP12_SQL = r"""
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""


@query("op12_digest_tree_merge", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts by the tree-merge of sorted digest runs; the largest id stays."""
    from fraudlens.llm.exact_duplicates import exact_duplicates
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return exact_duplicates(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, 'und') AS lang,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^.,;:!?\x0A-\x0D]+') AS pieces FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM (SELECT lang, unnest(pieces) AS piece FROM d)),
t AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM p GROUP BY lang),
f AS (SELECT lang, m, array_to_string(ws[i:i + m - 1], ' ') AS phrase, count(*) AS f
      FROM (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM p, (SELECT unnest(range(1, 6)) AS m) WHERE len(ws) >= m) GROUP BY ALL HAVING count(*) >= 100),
w AS (SELECT *, string_split(phrase, ' ') AS ws FROM f),
o AS (SELECT lang, phrase, max(f) AS over_f FROM (SELECT lang, f, array_to_string(ws[i:i + k - 1], ' ') AS phrase
      FROM (SELECT lang, f, ws, k, unnest(range(1, m - k + 2)) AS i FROM w, (SELECT unnest(range(2, 5)) AS k) WHERE m > k)) GROUP BY ALL),
c AS (SELECT w.lang, w.phrase, w.m, w.ws, w.f AS a FROM w LEFT JOIN o ON o.lang = w.lang AND o.phrase = w.phrase WHERE w.m > 1 AND (over_f IS NULL OR 100 * over_f < 100 * w.f)),
s AS (SELECT c.lang, c.phrase, c.k, c.a, x.f AS l, y.f AS r, t.n, 1000 * CAST(c.a AS HUGEINT) * t.n // (CAST(x.f AS HUGEINT) * y.f) AS score
      FROM (SELECT *, array_to_string(ws[1:k], ' ') AS x, array_to_string(ws[k + 1:m], ' ') AS y FROM (SELECT *, unnest(range(1, m)) AS k FROM c)) c
      JOIN f x ON x.lang = c.lang AND x.phrase = c.x JOIN f y ON y.lang = c.lang AND y.phrase = c.y JOIN t ON t.lang = c.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS BIGINT) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM b QUALIFY rank <= 2000
"""


@query("op11_vertical_collocations", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 phrase collocations of each language, from depth-truncated suffix subtrees."""
    from fraudlens.llm.collocations import top_collocations
    return top_collocations(documents(spark, sf_dir)).select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
