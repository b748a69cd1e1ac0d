"""The registered queries of these operators, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicebox.llm import common, decontam, histsort, linededup, mpegts, packing, secretscan, simhash, tokencount, toxicity, warczip


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return common.spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_credential_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.credential_links(table(spark, sf_dir, "documents"))


def op2_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histsort.histogram_sort(table(spark, sf_dir, "documents"), histsort.hash_key("doc_id"))


def op3_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    share = F.col("hit_words") / F.col("n_words")
    return found.select("doc_id", "n_words", "hit_words", "n_spans", "n_items", F.when(share >= decontam.DROP_SHARE, "drop").otherwise("cut").alias("action"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_transport_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mpegts.demultiplex(mpegts.page_streams(table(spark, sf_dir, "pages")), "page_id", "ts")
    return found.withColumn("payload", F.decode("payload", "UTF-8")).withColumnRenamed("id", "page_id")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxic_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_line_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_keep_bitmaps(table(spark, sf_dir, "documents")).drop("digest")


def op8_near_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents")).select("doc_id", "keeper_id")


def op9_packaged_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warczip.read_packages(warczip.write_packages(table(spark, sf_dir, "pages")))
    return records.select(F.regexp_extract("record_id", r"urn:page:(\d+)", 1).cast("bigint").alias("page_id"), "url", "status", "mime", F.decode("payload", "UTF-8").alias("html"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_credential_links, op2_histogram_sort, op3_pack, op4_contamination, op5_transport_streams, op6_toxicity, op7_line_bitmaps, op8_near_groups, op9_packaged_archives, op10_token_counts, op4_decontaminate)
    return {f.__name__: f for f in own}


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_GIVEN = r"""["']?[ \t]*[=:][ \t]*["']?"""
#: The parts of credentials, spelt apart from the operator.
_PARTS = {
    "strong": "|".join([r"-----BEGIN [ A-Z]*PRIVATE KEY-----", r"gh[oprsu]_[0-9A-Za-z]{36}", r"xox[abprs]-[-0-9A-Za-z]{10,}", r"sk_live_[0-9A-Za-z]{16,}", r"eyJ[-0-9A-Z_a-z]{10,}\.eyJ[-0-9A-Z_a-z]{10,}\.[-0-9A-Z_a-z]{10,}"]),
    "weak": f"(?i:token|secret|secret_access_key|password|passwd|pwd|api_key|apikey){_GIVEN}[-+./0-9=A-Z_a-z]{{8,}}",
    "id": rf"\bAKIA[0-9A-Z]{{16}}\b|(?i:client_id|access_key_id|username|user|account|login){_GIVEN}[-.0-9@A-Z_a-z]{{3,}}|[0-9A-Za-z][-%+.0-9A-Z_a-z]*@[-.0-9A-Za-z]+\.[A-Za-z]{{2,}}",
    "endpoint": r"""(?i:https|http|ftp|ssh|amqp|redis|mongodb|mysql|postgresql|postgres)://[^\s"'<>]+|\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b|\b(?i:host|server|endpoint)[ \t]*[=:][ \t]*["']?[-0-9A-Za-z]+(?:\.[-0-9A-Za-z]+)+""",
}


def _parts_sql() -> str:
    """One SELECT per kind of part: positions are sums of the pieces between the matches and of the matches."""
    total = "coalesce(list_sum(list_transform({}, lambda x: length(x))), 0)"
    return " UNION ALL ".join(
        f"""SELECT doc_id, text, scope, '{kind}' AS kind, {total.format("pieces[1:i]")} + {total.format("hits[1:i-1]")} AS a,
            {total.format("pieces[1:i]")} + {total.format("hits[1:i]")} AS b, hits[i] AS value
        FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM (
            SELECT doc_id, text, scope, regexp_extract_all(body, {_sql_text(p)}) AS hits, string_split_regex(body, {_sql_text(p)}) AS pieces FROM scopes))"""
        for kind, p in _PARTS.items()
    )


def oracle_sql() -> dict[str, str]:
    n = decontam.NGRAM
    secret = _sql_text(f"{_PARTS['strong']}|{_PARTS['weak']}")
    words = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"
    hits = f"""
            WITH d AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL),
            dw AS (SELECT doc_id, text, {words} AS ws FROM d),
            bw AS (SELECT row_number() OVER () AS item, {words} AS ws FROM benchmark WHERE text IS NOT NULL),
            grams AS (SELECT DISTINCT item, size, array_to_string(ws[j:j + size - 1], ' ') AS gram FROM
              (SELECT item, ws, least(len(ws), {n}) AS size, unnest(range(1, len(ws) - least(len(ws), {n}) + 2)) AS j FROM bw WHERE len(ws) > 0)),
            windows AS (SELECT doc_id, text, size, j, array_to_string(ws[j:j + size - 1], ' ') AS gram FROM
              (SELECT doc_id, text, ws, size, unnest(range(1, len(ws) - size + 2)) AS j FROM dw, (SELECT DISTINCT size FROM grams) WHERE len(ws) >= size)),
            hits AS (SELECT doc_id, text, w.size, j, item FROM windows w JOIN grams USING (size, gram)),
            places AS (SELECT DISTINCT doc_id, text, unnest(range(j, j + size)) AS p FROM hits)"""
    return {
        "op1_credential_links": f"""
            WITH docs AS (SELECT DISTINCT doc_id, text FROM documents WHERE regexp_matches(text, {secret})),
            split AS (SELECT doc_id, text, string_split_regex(text, '\n[ \t\r]*\n') AS s FROM docs),
            scopes AS (SELECT doc_id, text, unnest(range(len(s))) AS scope, unnest(s) AS body FROM split),
            parts AS ({_parts_sql()}),
            linked AS (SELECT h.doc_id, h.text, h.scope, h.a, h.b, h.kind, h.value,
                count(DISTINCT CASE WHEN p.kind = 'id' THEN p.a || ':' || p.b END) AS n_ids,
                count(DISTINCT CASE WHEN p.kind = 'endpoint' THEN p.a || ':' || p.b END) AS n_endpoints,
                min(CASE WHEN p.a > h.b THEN p.a - h.b WHEN p.b < h.a THEN h.a - p.b WHEN p.a IS NOT NULL THEN 0 END) AS distance
              FROM parts h LEFT JOIN parts p ON p.kind IN ('id', 'endpoint') AND p.text = h.text AND p.doc_id IS NOT DISTINCT FROM h.doc_id AND p.scope = h.scope
              WHERE h.kind IN ('strong', 'weak') GROUP BY ALL)
            SELECT doc_id, CAST(scope AS INTEGER) AS scope, CAST(a AS INTEGER) AS secret_start, CAST(b AS INTEGER) AS secret_end, kind AS strength,
              CAST(n_ids AS INTEGER) AS n_ids, CAST(n_endpoints AS INTEGER) AS n_endpoints, CAST(distance AS INTEGER) AS distance,
              CASE WHEN n_ids > 0 THEN 'id+' ELSE '' END || 'secret' || CASE WHEN n_endpoints > 0 THEN '+endpoint' ELSE '' END AS link,
              sha256(value) AS secret_sha256
            FROM linked WHERE kind = 'strong' OR n_ids > 0 OR n_endpoints > 0""",
        "op2_histogram_sort": f"""
            WITH keyed AS (SELECT *, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS shard_key,
                coalesce(strlen(text), 0) + 1 AS w FROM documents),
            below AS (SELECT shard_key, coalesce(sum(sum(w)) OVER (ORDER BY shard_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
              FROM keyed GROUP BY shard_key)
            SELECT doc_id, text, lang, source, n_chars, shard_key,
              CAST((SELECT count(*) FROM range(1, {histsort.SHARDS}) t(i) WHERE i * (SELECT sum(w) FROM keyed) <= before * {histsort.SHARDS}) AS INTEGER) AS shard
            FROM keyed JOIN below USING (shard_key)""",
        "op4_contamination": f"""{hits},
            runs AS (SELECT doc_id, text, count(*) AS hit_words,
                count(*) FILTER (WHERE before IS NULL OR before < p - 1) AS n_spans
              FROM (SELECT *, lag(p) OVER (PARTITION BY doc_id, text ORDER BY p) AS before FROM places) GROUP BY ALL),
            items AS (SELECT doc_id, text, count(DISTINCT item) AS n_items FROM hits GROUP BY ALL)
            SELECT r.doc_id, CAST(len(ws) AS INTEGER) AS n_words, CAST(hit_words AS INTEGER) AS hit_words, CAST(n_spans AS INTEGER) AS n_spans,
              CAST(n_items AS INTEGER) AS n_items, CASE WHEN hit_words::DOUBLE / len(ws) >= {decontam.DROP_SHARE} THEN 'drop' ELSE 'cut' END AS action
            FROM runs r JOIN items i ON i.text = r.text AND i.doc_id IS NOT DISTINCT FROM r.doc_id
              JOIN dw ON dw.text = r.text AND dw.doc_id IS NOT DISTINCT FROM r.doc_id""",
        # Each word with what stands before it; both go within a run of places, what stands before a run's first word stays.
        "op4_decontaminate": hits + rf""",
            marked AS (SELECT doc_id, text, list(p) AS ps FROM places GROUP BY doc_id, text),
            pieces AS (SELECT d.*, ps, regexp_extract_all(d.text, '[\p{{L}}\p{{N}}_]+') AS w, string_split_regex(d.text, '[\p{{L}}\p{{N}}_]+') AS g FROM documents d LEFT JOIN marked m ON m.text = d.text AND m.doc_id IS NOT DISTINCT FROM d.doc_id),
            cut AS (SELECT doc_id, lang, source, n_chars, ps, len(w) AS n, CASE WHEN ps IS NULL THEN text ELSE
                array_to_string(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN list_contains(ps, i) AND list_contains(ps, i - 1) THEN '' ELSE g[i] END || CASE WHEN list_contains(ps, i) THEN '' ELSE w[i] END), '') || g[len(w) + 1] END AS text FROM pieces)
            SELECT doc_id, text, lang, source, CAST(length(text) AS BIGINT) AS n_chars FROM cut WHERE ps IS NULL OR len(ps)::DOUBLE / n < {decontam.DROP_SHARE}""",
        "op5_transport_streams": f"""
            WITH units AS (
              SELECT page_id, 257 AS pid, 27 AS stream_type, 224 AS stream_id, unnest(range(0, (length(html) + {mpegts.UNIT_CHARS - 1}) // {mpegts.UNIT_CHARS})) AS i, html AS body FROM pages WHERE html <> ''
              UNION ALL SELECT page_id, 258, 6, 189, 0, url FROM pages WHERE url <> '')
            SELECT page_id, 1 AS program, pid, stream_type, CAST(i AS INTEGER) AS pes_index, stream_id,
              CAST(90000 + 3600 * (i + 1) AS BIGINT) AS pts, CAST(90000 + 3600 * (i + CASE WHEN pid = 257 THEN 0 ELSE 1 END) AS BIGINT) AS dts,
              pid = 257 AND i % 8 = 0 AS random_access, false AS discontinuity, true AS complete,
              CASE WHEN pid = 257 THEN substr(body, CAST(i * {mpegts.UNIT_CHARS} + 1 AS BIGINT), {mpegts.UNIT_CHARS}) ELSE body END AS payload
            FROM units""",
        "op7_line_bitmaps": r"""
            WITH d AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL),
            lines AS (SELECT doc_id, text, unnest(range(len(s))) AS pos, regexp_replace(unnest(s), '^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$', '', 'g') AS line
              FROM (SELECT doc_id, text, string_split(text, chr(10)) AS s FROM d)),
            marked AS (SELECT doc_id, text, pos, line = '' OR row_number() OVER (PARTITION BY line ORDER BY doc_id NULLS FIRST, text, pos) = 1 AS keep FROM lines),
            islands AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, text, keep ORDER BY pos) AS island FROM marked),
            runs AS (SELECT doc_id, text, keep, min(pos) AS first_pos, count(*) AS n FROM islands GROUP BY doc_id, text, keep, island)
            SELECT doc_id, CAST(sum(n) AS INTEGER) AS n_lines, CAST(coalesce(sum(n) FILTER (WHERE keep), 0) AS INTEGER) AS n_kept,
              CASE WHEN arg_min(keep, first_pos) THEN '' ELSE '0,' END || string_agg(CAST(n AS VARCHAR), ',' ORDER BY first_pos) AS keep_runs
            FROM runs GROUP BY doc_id, text""",
        "op9_packaged_archives": "SELECT page_id, url, 200 AS status, 'text/html' AS mime, html FROM pages WHERE url IS NOT NULL AND html IS NOT NULL",
    }
