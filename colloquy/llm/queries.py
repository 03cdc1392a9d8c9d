"""The registered queries of this subpackage and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers as tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm import (
    bpe, media, mixing, ngramjoin, passages, quality, resampling, simhash, tokencounts, tokenfiles, urlrules, vectorcodes, warc,
)

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_quality_rules")
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.apply_rules(docs, quality.train(docs, table(spark, sf_dir, "labels")))


@query("op2_media_columns")
def media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature",
        "width", "height", "bit_depth",
    )


@query(
    "op3_source_mix",
    r"""
    WITH d AS (
      SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens,
        md5(coalesce(CAST(doc_id AS VARCHAR), '-')) AS doc_key
      FROM documents
    ), s AS (
      SELECT source, sum(n_tokens) AS tokens, max(sum(n_tokens)) OVER () AS most,
        list_sum(list_transform(range(12), lambda i: CASE WHEN count(*) > 1024 * pow(16, i) THEN 1 ELSE 0 END)) AS digits
      FROM d GROUP BY source
    ), grid AS (
      SELECT k FROM range(4097) g(k) JOIN s ON s.tokens > 0
      GROUP BY k HAVING max(pow(s.most / s.tokens, 1 - k / 4096.0::DOUBLE)) <= 1.5 OR k = 4096
    ), q AS (
      SELECT source, digits, tokens,
        CASE WHEN tokens > 0 THEN CAST(floor(tokens * pow(most / tokens, 1 - (SELECT min(k) FROM grid) / 4096.0::DOUBLE) + 0.5) AS BIGINT) END AS quota
      FROM s
    ), p AS (
      SELECT source, CAST(digits AS INTEGER) AS digits, CASE WHEN tokens > 0 THEN quota // tokens ELSE 1 END AS whole,
        CASE WHEN tokens > 0 THEN quota % tokens ELSE 0 END AS rest
      FROM q
    ), u AS (
      SELECT d.*, left(doc_key, digits) AS block, whole, rest, unnest(range(CAST(whole + 1 AS BIGINT))) AS epoch
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source
    ), k AS (
      SELECT *, md5('mix:' || epoch || ':' || coalesce(source, '-') || ':' || block) AS pass_key FROM u
    ), r AS (
      SELECT *, sum(n_tokens) OVER (PARTITION BY source, epoch ORDER BY pass_key, doc_key RANGE UNBOUNDED PRECEDING) AS upto FROM k
    )
    SELECT doc_id, source, CAST(n_tokens AS BIGINT) AS n_tokens, CAST(epoch AS INTEGER) AS epoch, block, pass_key
    FROM r WHERE epoch < whole OR rest > 0 AND upto <= rest
    """,
)
def source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents")).select("doc_id", "source", "n_tokens", "epoch", "block", "pass_key")


# --- fixed values: the URL list, (host, path, verdict) --------------------------
URL_LIST = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]


@query(
    "op4_url_rules",
    r"""
    WITH u AS (
      SELECT page_id, coalesce(url, '') AS url,
        translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
      FROM pages
    ), t AS (
      SELECT page_id, host, path, list_sort(list_distinct(
        ['h:' || x for x in string_split(host, '.') if x <> '']
        || ['p:' || x for x in string_split(regexp_replace(path, '[0-9]+', '0', 'g'), '/') if x <> '']
        || ['q:' || regexp_extract(x, '^([^=]*)', 1) for x in string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&')
            if regexp_extract(x, '^([^=]*)', 1) <> '']
        || ['f:' || x for x in [regexp_extract(url, '#(.*)', 1)] if x <> ''])) AS tokens,
        regexp_extract(path, '/([0-9]+)', 1) AS number
      FROM u
    ), l AS (
      SELECT CAST(doc_id AS VARCHAR) AS number, bool_or(coalesce(quality = 0 OR toxic = 1, false)) AS blocked
      FROM labels WHERE doc_id IS NOT NULL GROUP BY 1
    ), b AS (
      SELECT row_number() OVER () AS row_no, tokens, blocked FROM t JOIN l USING (number)
    ), e AS (
      SELECT row_no, blocked, unnest(tokens) AS token FROM b
    ), c AS (
      SELECT [token] AS items, blocked FROM e
      UNION ALL SELECT [x.token, y.token], x.blocked FROM e x JOIN e y USING (row_no) WHERE x.token < y.token
      UNION ALL SELECT [x.token, y.token, z.token], x.blocked
        FROM e x JOIN e y USING (row_no) JOIN e z USING (row_no) WHERE x.token < y.token AND y.token < z.token
    ), m AS (
      SELECT items FROM c GROUP BY items
      HAVING count(*) FILTER (blocked) >= greatest(10, (SELECT ceil(0.0005::DOUBLE * count(*)) FROM b))
        AND count(*) FILTER (blocked)::DOUBLE / count(*) >= 0.6::DOUBLE
    ), h AS (
      SELECT DISTINCT tokens FROM (SELECT DISTINCT tokens FROM t) JOIN m ON list_has_all(tokens, items)
    )
    SELECT page_id, host, path,
      CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
        WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
        WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
        WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule,
      CASE rule WHEN 'example.net/en/' THEN 'allow' WHEN 'example.com/de/' THEN 'block' WHEN 'org/fr/' THEN 'allow'
        WHEN 'net/' THEN 'block' ELSE CASE WHEN h.tokens IS NULL THEN 'allow' ELSE 'block' END END AS verdict
    FROM t LEFT JOIN h ON t.tokens = h.tokens
    """,
)
def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    rules = urlrules.mine_rules(urlrules.labelled_urls(pages, table(spark, sf_dir, "labels")))
    return urlrules.judge_urls(pages, rules, URL_LIST)


@query("op5_token_files")
def token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = tokenfiles.stored_tokens(table(spark, sf_dir, "documents"), tokenizers.path("word_bpe_49k.json"))
    return stored.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op6_byte_bpe")
def byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_documents(
        table(spark, sf_dir, "documents"), tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN, decode=True
    )
    return coded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


@query("op8_repeated_passages")
def repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = passages.remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op9_token_counts")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.count_tokens(table(spark, sf_dir, "documents"), tokenizers.path("byte_bpe_50k.json"))


@query(
    "op7_warc_revisits",
    """
    WITH p AS (
      SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
    ), r AS (
      SELECT *, row_number() OVER (PARTITION BY payload_digest ORDER BY page_id DESC NULLS LAST) AS place,
        max(page_id) OVER (PARTITION BY payload_digest) AS last_id
      FROM p
    )
    SELECT page_id, payload_bytes, payload_digest,
      CASE WHEN payload_bytes >= 1000 AND place > 1 THEN 'revisit' ELSE 'response' END AS record_type,
      CASE WHEN payload_bytes >= 1000 AND place > 1 THEN last_id END AS refers_to
    FROM r
    """,
)
def warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.deduplicated(table(spark, sf_dir, "pages")).withColumnRenamed("row_id", "page_id")


@query("op10_simhash")
def simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op11_importance_resampling")
def importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resampling.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def _round_sql(books: str) -> str:
    """Each part's nearest entry of the codebook table `books`."""
    return f"""
      SELECT row_no, p, min(distance) AS distance, arg_min(e, distance * 64 + e) AS e FROM (
        SELECT v.row_no, v.p, b.e, list_sum(list_transform(range(1, len(v.x) + 1), lambda i: (v.x[i] - b.x[i]) * (v.x[i] - b.x[i])))::BIGINT AS distance
        FROM v JOIN {books} b ON v.p = b.p) GROUP BY row_no, p"""


def _moved_sql(books: str, assigned: str) -> str:
    """The codebook after a round: floored means of the parts assigned to each entry."""
    return f"""
      SELECT b.p, b.e, CASE WHEN n.x IS NULL THEN b.x ELSE n.x END AS x FROM {books} b LEFT JOIN (
        SELECT p, e, list(x ORDER BY i) AS x FROM (
          SELECT p, e, i, ((s - ((s % n) + n) % n) // n)::BIGINT AS x FROM (
            SELECT p, e, i, sum(c)::BIGINT AS s, count(*) AS n
            FROM (SELECT a.p, a.e, unnest(v.x) AS c, unnest(range(len(v.x))) AS i FROM {assigned} a JOIN v ON a.row_no = v.row_no AND a.p = v.p)
            GROUP BY p, e, i)) GROUP BY p, e) n ON b.p = n.p AND b.e = n.e"""


@query(
    "op12_vector_codes",
    f"""
    WITH f AS (
      SELECT row_number() OVER (ORDER BY vec_id, embedding) AS row_no, vec_id, label,
        list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS w
      FROM embeddings
      WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))
    ), v AS (
      SELECT row_no, p, w[p * (len(w) // 16) + 1 : (p + 1) * (len(w) // 16)] AS x FROM f, range(16) r(p)
    ), b0 AS (
      SELECT p, row_no - 1 AS e, x FROM v WHERE row_no <= 64
    ), a0 AS MATERIALIZED ({_round_sql("b0")}
    ), b1 AS MATERIALIZED ({_moved_sql("b0", "a0")}
    ), a1 AS MATERIALIZED ({_round_sql("b1")}
    ), b2 AS MATERIALIZED ({_moved_sql("b1", "a1")}
    ), a2 AS MATERIALIZED ({_round_sql("b2")}
    ), c AS (
      SELECT f.vec_id, f.label, a.code, a.error FROM f JOIN (
        SELECT row_no, string_agg(format('{{:02x}}', e), '' ORDER BY p) AS code, sum(distance)::BIGINT AS error FROM a2 GROUP BY row_no
      ) a USING (row_no)
    )
    SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
      (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) FROM b2) AS codebooks_sha256
    FROM c
    """,
)
def vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcodes.compressed(table(spark, sf_dir, "embeddings")).select(
        "vec_id", "code", "error", "label_error", "codebooks_sha256"
    )


@query(
    "op13_ngram_join",
    r"""
    WITH RECURSIVE d AS (
      SELECT row_number() OVER () AS row_no, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
      FROM documents
    ), g AS (
      SELECT row_no, doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) END AS s
      FROM d
    ), e AS (
      SELECT row_no, len(s) AS n, unnest(s) AS x FROM g
    ), p AS (
      SELECT a.row_no AS a, b.row_no AS b FROM e a JOIN e b ON a.x = b.x AND a.row_no < b.row_no
      GROUP BY a.row_no, b.row_no, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
    ), l AS (
      SELECT a, b FROM p UNION ALL SELECT b, a FROM p
    ), t AS (
      SELECT row_no, row_no AS other FROM g UNION SELECT l.b, t.other FROM t JOIN l ON t.row_no = l.a
    ), c AS (
      SELECT t.row_no, min(o.doc_id) AS component_id FROM t JOIN g o ON t.other = o.row_no GROUP BY t.row_no
    )
    SELECT doc_id, len(s) AS n_shingles, component_id FROM g JOIN c USING (row_no)
    """,
)
def ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.similar_documents(table(spark, sf_dir, "documents"))
