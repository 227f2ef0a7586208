"""The ``opN_*`` queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import TOKEN_RE, WORD_RE

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
OVER_LIMIT = 1024


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import decontaminate

    out = decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return out.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), (F.col("n_items") >= 2).alias("contaminated"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import Rule, filter_urls

    rules = [Rule("com", "/en/", "block"), Rule("example.com", "/en/7", "allow"), Rule("net", "/de/", "allow"), Rule("example.net", "/de/8", "block"), Rule("org", "/es/", "block")]
    return filter_urls(_table(spark, sf_dir, "pages"), rules)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    out = token_counts(_table(spark, sf_dir, "documents"), tokenizer_path())
    return out.withColumn("over_limit", F.col("n_tokens") > OVER_LIMIT)


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan_licenses

    found = scan_licenses(_table(spark, sf_dir, "documents"))
    starts = F.transform("base", lambda d: d["first"])
    return found.select("doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(_table(spark, sf_dir, "documents"), tokenizer_path(), END_ID)


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neighbours import nearest

    return nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import crc_of_id
    from .lm_scoring import lm_scores

    return lm_scores(_table(spark, sf_dir, "documents"), crc_of_id() % 10 == 0)


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), percent=85)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import crc_of_id
    from .language_id import predict, train

    docs = _table(spark, sf_dir, "documents")
    held_out = (crc_of_id() % 4 == 2).alias("held_out")
    return predict(docs, train(docs.where(~held_out)), ("doc_id", held_out))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_decontaminate, op2_url_filter, op3_token_counts, op4_licenses, op5_mixing, op6_token_files, op7_nearest, op8_lm_scoring, op9_near_duplicates, op10_language_id)}

#: The mix without histogram and plan: one sort a source.
OP5_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), tilted AS (
  SELECT *, CAST(floor(CAST(1000 * size AS DOUBLE) / (size + 400)) AS BIGINT) AS tilt FROM sized
), src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(sum(size * tilt) AS BIGINT) AS tilt FROM tilted GROUP BY source
), weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM src
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY CAST(3 * source_size AS DOUBLE) / w, source NULLS LAST) AS place,
    CAST(sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (ORDER BY CAST(3 * source_size AS DOUBLE) / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
    / CAST(sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY CAST(3 * source_size AS DOUBLE) / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS scale
  FROM weighed
), level AS (
  SELECT min(place) AS place, arg_min(scale, place) AS scale FROM ranked WHERE 3 * source_size >= w * scale
), aimed AS (
  SELECT r.source, source_size, r.place < l.place AS capped, CASE WHEN r.place < l.place THEN CAST(3 * source_size AS DOUBLE) ELSE w * l.scale END AS target,
    CASE WHEN source_size > 0 THEN CAST(tilt AS DOUBLE) / source_size ELSE 0 END AS mean_tilt FROM ranked r, level l
), split AS (
  SELECT *, CASE WHEN capped THEN 3 WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS certain FROM aimed
), part AS (
  SELECT *, CASE WHEN capped OR source_size = 0 THEN 0.0 ELSE target / source_size - certain END AS f, target - certain * source_size AS rest FROM split
), keyed AS (
  SELECT d.doc_id, d.size, p.*, d.tilt,
    (CAST(CAST('0x' || substr(md5('mix-1|' || coalesce(CAST(d.doc_id AS VARCHAR), '') || '|' || d.size), 1, 12) AS BIGINT) AS DOUBLE) + 0.5) / 281474976710656.0 AS u
  FROM tilted d JOIN part p ON d.source IS NOT DISTINCT FROM p.source
), chance AS (
  SELECT *, f + f * (1 - f) * (tilt - mean_tilt) / 1000 AS p FROM keyed
), ordered AS (
  SELECT *, CASE WHEN f > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS q FROM chance
), summed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY q, CAST(doc_id AS VARCHAR), size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ordered
), drawn AS (
  SELECT *, certain + CASE WHEN f > 0 AND size > 0 AND 2 * before + size <= 2 * rest THEN 1 ELSE 0 END AS c FROM summed
)
SELECT doc_id, size, source_size, target, CAST(c * size AS BIGINT) AS taken, CAST(c AS BIGINT) AS copies FROM drawn
"""

WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{}')"

#: Windows of both sides, joined.
OP1_SQL = f"""
WITH d AS (SELECT doc_id, {WORDS_SQL.format(WORD_RE)} AS w FROM documents),
i AS (SELECT item_id, {WORDS_SQL.format(WORD_RE)} AS w FROM benchmark WHERE item_id IS NOT NULL),
own AS (SELECT CAST(item_id AS VARCHAR) AS item_id, w, least(8, len(w)) AS n, unnest(range(1, len(w) - least(8, len(w)) + 2)) AS s FROM i WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, s, s + n - 1), ' ') AS text FROM own),
lengths AS (SELECT DISTINCT n FROM windows),
places AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, lengths WHERE len(w) >= n),
found AS (SELECT p.doc_id, p.s, p.n, v.item_id FROM (SELECT doc_id, n, s, array_to_string(list_slice(w, s, s + n - 1), ' ') AS text FROM places) p JOIN windows v ON p.n = v.n AND p.text = v.text),
hit AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS place FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN hit ON hit.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id
"""

#: All pairs of texts with a common shingle, and reachability.
OP9_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS_SQL.format(TOKEN_RE)} AS w FROM documents),
places AS (SELECT doc_id, w, least(5, len(w)) AS n, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS s FROM d WHERE len(w) > 0),
shingles AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, s, s + n - 1), ' ') AS text, n FROM places),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM shingles a JOIN shingles b ON a.text = b.text AND a.n = b.n AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT x, y FROM pairs JOIN sizes s ON s.doc_id = x JOIN sizes t ON t.doc_id = y WHERE 100 * common >= 85 * (s.n + t.n - common)),
reached AS (SELECT DISTINCT x AS a, x AS b FROM links UNION SELECT a, y FROM reached JOIN links ON x = b),
least_id AS (SELECT a, min(b) AS component_id FROM reached GROUP BY a)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id, coalesce(component_id, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN least_id l ON l.a = d.doc_id
"""

ORACLE_SQL: dict[str, str] = {"op1_decontaminate": OP1_SQL, "op5_mixing": OP5_SQL, "op9_near_duplicates": OP9_SQL}
