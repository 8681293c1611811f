"""The registered queries of this package and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repoweave.llm import (
    exact_dedup, hyperplane_tree, merge_replay, mixing, packing, periodic_runs, personal_data, quality, simhash,
    suffix_tree, token_codes, token_counts, url_lists,
)
from repoweave.llm.common import BLANK


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.pack(_table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=1)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "source"
    )


def op2_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_token_codes(spark: SparkSession, folder: str) -> DataFrame:
    documents = token_codes.encode_documents(
        _table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2
    )
    return documents.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


#: First second of the year in which pages are taken to be fetched and lists to be dated.
YEAR = 1_704_067_200
DAY = 86_400


def _captures(pages: DataFrame) -> DataFrame:
    """Pages with a fetch time in the year, which follows from page_id."""
    day, second = F.col("page_id") * 7919 % 365, F.col("page_id") * 104_729 % DAY
    return pages.select("page_id", "url", (YEAR + day * DAY + second).alias("fetched_at"))


def _list_events(pages: DataFrame) -> DataFrame:
    """Dated list entries for the hosts of the pages and the domains above them, by a hash of the name."""
    host = url_lists.host_of(F.col("url"))
    names = pages.select(F.explode(url_lists.domains_of(host)).alias("domain")).where("domain like '%.%'").distinct()
    names = names.withColumn("h", mixing.hashed(F.col("domain"), "list"))
    day = F.col("h") % 300

    def dated(list_name: str, action: str, after: int, where: str) -> DataFrame:
        at = YEAR + (day + after) * DAY
        return names.where(where).select(F.lit(list_name).alias("list"), "domain", at.alias("at"), F.lit(action).alias("action"))

    return (
        dated("block", "add", 0, "h % 3 = 0")
        .unionByName(dated("block", "remove", 45, "h % 6 = 0"))
        .unionByName(dated("block", "add", 80, "h % 12 = 0"))
        .unionByName(dated("allow", "add", -20, "h % 5 = 1"))
        .unionByName(dated("allow", "remove", 100, "h % 10 = 1"))
    )


def op4_url_lists(spark: SparkSession, folder: str) -> DataFrame:
    pages = _table(spark, folder, "pages")
    return url_lists.filter_captures(_captures(pages), _list_events(pages))


def op5_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    _, decided = exact_dedup.find_duplicates(_table(spark, folder, "documents"))
    return decided.drop("_row")


def op6_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judge(_table(spark, folder, "documents"))


def op7_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, folder, "documents"))


def op8_mixing(spark: SparkSession, folder: str) -> DataFrame:
    plan = mixing.plan_mix(mixing.measure(_table(spark, folder, "documents")))
    return plan.select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies"
    )


def op9_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return personal_data.find_personal_data(_table(spark, folder, "documents")).select(
        "doc_id", *[F.col(f"n_{kind}") for kind in personal_data.BASE_KINDS],
        F.lower(F.sha2(personal_data.span_text(F.filter("spans", lambda s: s["base"])), 256)).alias("base_sha256"),
        personal_data.span_text(F.col("spans")).alias("spans"),
    )


def op10_suffix_tree(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_tree.score_documents(_table(spark, folder, "documents"))


def planted(text: Column, doc_id: Column) -> Column:
    """The text with periodic words from some place on, where a hash of doc_id asks for it.

    A null doc_id and a text without words are left as they are.
    """
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)

    def altered(words: Column) -> Column:
        n = F.size(words)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        again = F.flatten(F.array_repeat(F.slice(words, a + 1, p), (4 + g % 8).cast("int")))
        both = F.concat(F.slice(words, F.lit(1), a), F.slice(again, F.lit(1), n - a))
        return F.when(n > 0, F.array_join(both, " ")).otherwise(text)

    # An array of one list binds the list of words to a name, so it is made once.
    words = F.filter(F.split(F.coalesce(text, F.lit("")), BLANK), lambda w: w != "")
    return F.when(h % 10 == 0, F.transform(F.array(words), altered)[0]).otherwise(text)


def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    found = periodic_runs.find_runs(docs.select("doc_id", planted(F.col("text"), F.col("doc_id")).alias("text")))
    best = lambda name: F.get(name, F.col("best").cast("int"))
    lines = F.transform(
        F.arrays_zip("starts", "lengths", "periods"),
        lambda r: F.concat_ws(",", r["starts"], r["lengths"], r["periods"]),
    )
    text = F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), "")
    return found.select(
        "doc_id", F.size("starts").cast("bigint").alias("n_runs"), best("starts").alias("start"),
        best("lengths").alias("length"), best("periods").alias("period"),
        F.expr("1000 * lengths[cast(best as int)] div periods[cast(best as int)]").alias("exponent_milli"),
        F.sha2(text, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_merge_replay(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = merge_replay.encode(_table(spark, folder, "documents"), path, public_tokenizers.PATTERN)
    return merge_replay.decode(encoded, path).select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op13_hyperplane_tree(spark: SparkSession, folder: str) -> DataFrame:
    vectors = _table(spark, folder, "embeddings")
    label = F.col("label").cast("bigint")
    label = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return hyperplane_tree.mine(vectors.withColumn("label", label), F.col("vec_id") % 50 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_packing, op2_token_counts, op3_token_codes, op4_url_lists, op5_exact_dedup, op6_quality_rules,
        op7_simhash, op8_mixing, op9_personal_data, op10_suffix_tree, op11_periodic_runs, op12_merge_replay,
        op13_hyperplane_tree,
    )
}

_OP4 = r"""
WITH captures AS (
  SELECT page_id, url, 1704067200 + page_id * 7919 % 365 * 86400 + page_id * 104729 % 86400 AS fetched_at,
         rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1)), '.') AS found
  FROM pages),
hosts AS (SELECT *, CASE WHEN found <> '' AND length(found) <= 253 THEN found END AS host FROM captures),
parts AS (SELECT DISTINCT host, string_split(host, '.') AS p FROM hosts WHERE host IS NOT NULL),
covered AS (
  SELECT host, array_to_string(p[i:], '.') AS domain FROM (SELECT host, p, unnest(range(1, len(p) + 1)) AS i FROM parts)),
names AS (
  SELECT domain, ('0x' || substr(sha256('list' || domain), 1, 7))::BIGINT AS h
  FROM (SELECT DISTINCT domain FROM covered WHERE domain LIKE '%.%')),
events AS (
  SELECT 'block' AS list, domain, h % 300 AS day, false AS off FROM names WHERE h % 3 = 0
  UNION ALL SELECT 'block', domain, h % 300 + 45, true FROM names WHERE h % 6 = 0
  UNION ALL SELECT 'block', domain, h % 300 + 80, false FROM names WHERE h % 12 = 0
  UNION ALL SELECT 'allow', domain, h % 300 - 20, false FROM names WHERE h % 5 = 1
  UNION ALL SELECT 'allow', domain, h % 300 + 100, true FROM names WHERE h % 10 = 1),
spans AS (
  SELECT list, domain, off, 1704067200 + day * 86400 AS start,
         lead(1704067200 + day * 86400) OVER (PARTITION BY list, domain ORDER BY day) AS stop
  FROM events),
hits AS (
  SELECT h.page_id, h.url, s.list, s.domain,
         row_number() OVER (PARTITION BY h.page_id ORDER BY length(s.domain) DESC, s.list) AS nth
  FROM hosts h JOIN covered c ON h.host = c.host JOIN spans s ON c.domain = s.domain
  WHERE NOT s.off AND h.fetched_at >= s.start AND (s.stop IS NULL OR h.fetched_at < s.stop))
SELECT h.page_id, h.url, h.host, h.fetched_at, x.list, x.domain, coalesce(x.list = 'allow', true) AS kept
FROM hosts h LEFT JOIN (SELECT * FROM hits WHERE nth = 1) x ON h.page_id = x.page_id
"""

_OP5 = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
r AS (
  SELECT doc_id, norm, count(*) OVER (PARTITION BY norm) AS group_size,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(text) DESC, doc_id) AS keep_id FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM r
"""

_OP8 = r"""
WITH sized AS (
  SELECT doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
s1 AS (
  SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1]::DOUBLE AS weight,
         2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * (sum(source_size) OVER ())::BIGINT AS total FROM s0),
s2 AS (
  SELECT *, row_number() OVER f AS nth,
         (total - coalesce(sum(cap) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (f ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM s1 WINDOW f AS (ORDER BY cap / weight, source IS NULL, source)),
s3 AS (SELECT *, arg_min(level, nth) FILTER (level * weight <= cap) OVER () AS water FROM s2),
s4 AS (SELECT *, least(cap, coalesce(water * weight, cap)) AS target FROM s3),
s5 AS (
  SELECT *, CASE WHEN source_size > 0 THEN round(target / source_size * 1073741824)::BIGINT ELSE 0 END AS step,
         ('0x' || substr(sha256('mix' || coalesce(source, '')), 1, 7))::BIGINT * 4 AS off FROM s4),
d AS (
  SELECT *, row_number() OVER (
           PARTITION BY source ORDER BY size, ('0x' || substr(sha256('mix' || coalesce(doc_id::VARCHAR, '')), 1, 7))::BIGINT, doc_id
         ) AS i FROM sized),
c AS (
  SELECT d.doc_id, d.size, s5.source_size, s5.target, d.source,
         ((off + i * step) >> 30) - ((off + (i - 1) * step) >> 30) AS copies
  FROM d JOIN s5 ON d.source IS NOT DISTINCT FROM s5.source)
SELECT doc_id, size, source_size, target, copies * size AS taken, source, copies FROM c
"""

_OP13 = r"""
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label::BIGINT END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, r.label = a.label AS same, list_inner_product(a.v, r.v)::BIGINT AS score
  FROM rows a JOIN rows r ON a.vec_id % 50 = 0 AND r.vec_id <> a.vec_id),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
negatives AS (
  SELECT p.anchor_id, p.positive_id, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank
  FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT s.same
   AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= 3
"""

#: SQL over whole tables; the other queries are tested against brute force.
ORACLES: dict[str, str] = {"op4_url_lists": _OP4, "op5_exact_dedup": _OP5, "op8_mixing": _OP8, "op13_hyperplane_tree": _OP13}
