"""The thin queries opN_ over the test tables, and SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, read_table, spread


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import hexed, near_duplicates

    prepare(spark)
    return near_duplicates(spread(read_table(spark, sf_dir, "documents"))).select("doc_id", hexed(F.col("fp")).alias("fingerprint"), "component_id")


def held_out(modulus: int, *rest: int):
    """Whether crc32(doc_id as text) modulo `modulus` is among rest; false for a null doc_id."""
    return F.coalesce((F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus).isin(*rest), F.lit(False))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit, score

    docs = spread(read_table(spark, sf_dir, "documents"))
    out = held_out(5, 0)
    model = fit(docs, read_table(spark, sf_dir, "labels").where(~out))
    return score(docs.select("doc_id", "text", out.alias("held_out")), model).select("doc_id", "held_out", "score", "predicted")


def op3_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm import score

    return score(read_table(spark, sf_dir, "documents"), held_out(10, 0))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    prepare(spark)
    return round_trip(read_table(spark, sf_dir, "pages"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import score

    out = held_out(3, 1)
    scored = score(spread(read_table(spark, sf_dir, "documents")), read_table(spark, sf_dir, "labels").where(~out))
    return scored.select("doc_id", out.alias("held_out"), "score", "predicted")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import decontaminate

    return decontaminate(spread(read_table(spark, sf_dir, "documents")), read_table(spark, sf_dir, "benchmark"))


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import remove_repeats

    return remove_repeats(read_table(spark, sf_dir, "documents"), texts=False)


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import quantised, top_k

    prepare(spark)
    return top_k(quantised(read_table(spark, sf_dir, "embeddings")), F.col("vec_id") % 100 == 0)


def op9_urlrules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urlrules import match

    return match(read_table(spark, sf_dir, "pages"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack

    prepare(spark)
    return pack(spread(read_table(spark, sf_dir, "documents")), str(public_tokenizers.path("byte_bpe_50k.json")))


QUERIES = {f.__name__: f for f in (op1_simhash, op2_toxicity, op3_lm, op4_warc, op5_quality, op6_decontaminate, op7_substrings, op8_topk, op9_urlrules, op10_packing)}

ORACLE_SQL = {
    "op4_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
        d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha256(b) AS payload_digest FROM p),
        f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY 1)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
          CASE WHEN first <> page_id THEN first END AS refers_to
        FROM d LEFT JOIN f USING (payload_digest)""",
    "op7_substrings": """
        WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
        g AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS win FROM w, unnest(range(1, len(ws) - 11)) AS t(i) WHERE len(ws) >= 13),
        f AS (SELECT win, min(doc_id) AS first FROM g GROUP BY win),
        c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM g JOIN f USING (win) WHERE first < doc_id),
        e AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
        k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM e ANTI JOIN c USING (doc_id, p) GROUP BY doc_id)
        SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)""",
    "op8_topk": """
        WITH v AS (SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
          WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([q.v[i] * c.v[i] FOR i IN range(1, len(q.v) + 1)]) AS BIGINT) AS score
          FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v)),
        r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op9_urlrules": """
        WITH a AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
        b AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
          regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
        rules(rverdict, rhost, rpath) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
        m AS (SELECT page_id, max_by(struct_pack(r := rhost || rpath, v := rverdict), len(rhost || rpath) * 1000 + len(rhost)) AS best FROM b JOIN rules
          ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
        SELECT page_id, host, path, best.r AS rule, coalesce(best.v, 'allow') AS verdict FROM b LEFT JOIN m USING (page_id)""",
}
