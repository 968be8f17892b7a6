"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, vocabulary


def _rest(divisor: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(divisor))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit, score

    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = fit(docs, labels.filter(_rest(4) != 2))
    scored = score(docs, model)
    return scored.select("doc_id", (_rest(4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import round_trip

    return round_trip(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import fit, predict

    docs, path = read(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model")
    model = fit(docs.filter(_rest(3) != 1), path)
    return predict(docs, path, model).select("doc_id", (_rest(3) == 1).alias("held_out"), "lang_pred", "score")


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .content import fit, main_text

    pages = read(spark, sf_dir, "pages")
    return main_text(pages, fit(pages)).withColumn("n_chars", F.length("text").cast("long"))


def op5_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import links

    return links(read(spark, sf_dir, "embeddings"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ppm import score

    scored = score(read(spark, sf_dir, "documents"), _rest(5) != 1)
    return scored.select("doc_id", (_rest(5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op9_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import captures, resolve

    found = resolve(captures(read(spark, sf_dir, "pages")))
    pairs = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    seconds = F.unix_timestamp("date"), F.unix_timestamp("response_date")
    return found.select("record_id", "url_key", seconds[0].alias("seconds"), "response_id", seconds[1].alias("response_seconds"), "outcome", F.array_join(pairs, "; ").alias("merged"))


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bitslice import top_k

    return top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


QUERIES = {q.__name__: q for q in (op1_toxicity, op2_byte_bpe, op3_language, op4_main_text, op5_vectors, op6_simhash, op7_ppm, op8_packing, op9_revisits, op10_top_k)}

_FINE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0"

SQL: dict[str, str] = {
    "op5_vectors": f"""
        WITH RECURSIVE u AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
            WHERE {_FINE} AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), l AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b
            ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.95
        ), r(a, b) AS (
            SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
        ), c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
        n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
        SELECT e.vec_id, coalesce(n.n_links, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
        FROM embeddings e JOIN c ON c.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id""",
    "op9_revisits": """
        WITH b AS (
            SELECT page_id AS p, 'md5:' || md5(coalesce(html, '')) AS digest, regexp_replace(trim(url, ' '), '#.*$', '') AS u
            FROM pages WHERE page_id IS NOT NULL
        ), k AS (
            SELECT p, digest, u, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme,
                lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host,
                regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*:([0-9]+)(?:[/?#]|$)', 1) AS port,
                regexp_replace(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', '') AS rest
            FROM b
        ), c AS (
            SELECT p, digest, CASE WHEN u = '' THEN NULL WHEN scheme = '' THEN u ELSE
                scheme || '://' || regexp_replace(host, '[.]$', '')
                || CASE WHEN (scheme = 'http' AND port = '80') OR (scheme = 'https' AND port = '443') OR port = '' THEN '' ELSE ':' || port END
                || CASE WHEN split_part(rest, '?', 1) = '' THEN '/' ELSE split_part(rest, '?', 1) END
                || CASE WHEN regexp_extract(rest, '^[^?]*[?](.*)$', 1) = '' THEN '' ELSE '?' || array_to_string(
                    list_sort(list_filter(string_split(regexp_extract(rest, '^[^?]*[?](.*)$', 1), '&'), lambda x: x <> '')), '&') END
                END AS url_key
            FROM k
        ), v AS (
            SELECT p, url_key, digest, visit, p * 4 + visit AS record_id, (((p % 5) + 5) % 5) + visit AS day,
                1704067200 + ((((p % 5) + 5) % 5) + visit) * 86400 + ((p % 86400) + 86400) % 86400 AS seconds,
                CASE WHEN p % 7 = 0 THEN NULL WHEN visit > 0 AND (p + visit) % 11 = 0 THEN '"other"' ELSE 'W/"' || digest || '"' END AS etag
            FROM c, (SELECT unnest([0, 1, 2, 3]) AS visit)
        ), m AS (
            SELECT r.*, f.record_id AS response_id, f.seconds AS response_seconds, f.etag AS old_etag, f.visit AS old_visit
            FROM v r LEFT JOIN v f ON f.visit = 0 AND f.url_key = r.url_key AND f.seconds < r.seconds WHERE r.visit > 0
            QUALIFY row_number() OVER (PARTITION BY r.record_id ORDER BY f.seconds DESC NULLS LAST, f.record_id DESC) = 1
        ), o AS (
            SELECT *, CASE WHEN response_id IS NULL THEN 'orphan' WHEN etag IS NULL OR old_etag IS NULL THEN 'unverified'
                WHEN regexp_replace(etag, '^[Ww]/', '') = regexp_replace(old_etag, '^[Ww]/', '') THEN 'resolved' ELSE 'mismatch' END AS outcome
            FROM m
        )
        SELECT record_id, url_key, seconds, response_id, response_seconds, outcome,
            CASE WHEN outcome IN ('resolved', 'unverified') THEN 'cache-control=max-age=' || visit || '; content-length=' || old_visit || '; date=' || day
                || CASE WHEN coalesce(etag, old_etag) IS NULL THEN '' ELSE '; etag=' || coalesce(etag, old_etag) END END AS merged
        FROM o""",
    "op10_top_k": f"""
        WITH e AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings WHERE vec_id IS NOT NULL AND {_FINE}
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id,
                CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
            FROM e q JOIN e c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
        )
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
        FROM s QUALIFY rank <= 10""",
}
