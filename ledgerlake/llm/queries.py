"""Queries of this subpackage and their SQL; thin, they only shape what the operators return."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ._spark import table
from .langid import label_languages
from .line_dedup import dedup_lines
from .near_dedup import near_duplicates
from .neighbours import nearest
from .packing import pack
from .passages import repeats
from .pieces import encode_texts
from .sampling import resample
from .tiff import store_texts
from .url_filter import judge


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=3, num=85, den=100)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_languages(table(spark, sf_dir, "documents"))


RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), RULES)


def op4_media_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_texts(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good"))
    return resample(table(spark, sf_dir, "documents"), labels)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document that keeps a line with words, or has had none."""
    kept = dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_near_dedup, op2_best_fit_packing, op3_sentencepiece, op4_media_tiff, op5_nearest, op6_language_id, op7_url_filter, op8_substring_dedup, op9_quality, op10_line_dedup, pipeline)}
SQL: dict[str, str] = {
    "op10_line_dedup": r"""WITH t AS (SELECT doc_id, pos - 1 AS line_no, line, list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL)),
l AS (SELECT * FROM t WHERE len(w) > 0),
u AS (SELECT line, min({'d': doc_id, 'n': line_no}) AS o, any_value(w) AS w FROM l GROUP BY line),
v AS (SELECT o, i, CASE WHEN i = 0 THEN w ELSE list_concat(w[:i - 1], w[i + 1:]) END AS x FROM (SELECT o, w, unnest(range(0, len(w) + 1)) AS i FROM u WHERE len(w) >= 8)),
s AS (SELECT x, i, min(o) AS m FROM v GROUP BY x, i),
h AS (SELECT x, min(m) AS f, min(CASE WHEN i = 0 THEN m END) AS z FROM s GROUP BY x),
n AS (SELECT DISTINCT v.o FROM v JOIN s ON v.x = s.x AND v.i = s.i JOIN h ON v.x = h.x WHERE s.m < v.o OR h.z < v.o OR (v.i = 0 AND h.f < v.o)),
g AS (SELECT l.doc_id, l.line_no, (u.o <> {'d': l.doc_id, 'n': l.line_no} OR u.o IN (SELECT o FROM n)) AS gone FROM l JOIN u ON l.line = u.line),
k AS (SELECT t.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE NOT gone) AS left_over, coalesce(string_agg(t.line, chr(10) ORDER BY t.line_no) FILTER (WHERE NOT coalesce(gone, false)), '') AS x FROM t LEFT JOIN g ON t.doc_id = g.doc_id AND t.line_no = g.line_no GROUP BY t.doc_id)
SELECT doc_id, n_lines, n_removed, sha256(x) AS text_sha256 FROM k WHERE n_removed = 0 OR left_over > 0
UNION ALL SELECT doc_id, 0, 0, NULL FROM documents WHERE text IS NULL""",
}
