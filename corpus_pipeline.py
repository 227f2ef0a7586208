"""A training corpus from the documents table: five stages, each on what the one before kept.

Documents pass unchanged, with their own columns, until the last stage writes their tokens. Extra columns pass too; where
one is named like a stage's result, the stage's rows still hold the document's own values.

Edge cases. An empty table passes every stage. Null or empty texts have no language and go in the first stage. The
second stage decides by row: documents without an id and rows that share one are told apart by their shingles, and one row
stays of each component.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sortilex.llm.common import crc_of_id, materialize, remove, temporary
from sortilex.llm.decontaminate import WINDOW, decontaminate
from sortilex.llm.language_id import NO_LANGUAGE, predict, train
from sortilex.llm.mixing import mix, repeat_copies
from sortilex.llm.near_dup import BROADCAST_ROWS, add_class, near_duplicates
from sortilex.llm.packing import pack
from sortilex.llm.queries import END_ID, tokenizer_path

#: A text with so many letters that is less similar than this to every language's profile is in none of them; shorter
#: texts have too few trigrams to tell, and stay.
LEAST_LETTERS, LEAST_SCORE = 60, 0.1
#: Near duplicates share at least this percentage of their shingles.
SIMILAR = 80


def _marked(docs: DataFrame) -> DataFrame:
    """The documents under names that no stage's results have."""
    return docs.toDF(*(c if c in ("doc_id", "text", "lang", "source") else f"__own_{c}" for c in docs.columns))


def _plain(docs: DataFrame, columns: list[str]) -> DataFrame:
    return docs.select(*(F.col(c if c in ("doc_id", "text", "lang", "source") else f"__own_{c}").alias(c) for c in columns))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the labels teach; texts without letters, and long ones like none of them, go."""
    own = _marked(docs)
    labelled = predict(own, train(own.where(crc_of_id() % 4 != 2)), tuple(own.columns))
    foreign = (F.col("score") < LEAST_SCORE) & (F.regexp_count("text", F.lit(r"\p{L}")) >= LEAST_LETTERS)
    return _plain(labelled.where((F.col("lang_pred") != NO_LANGUAGE) & ~foreign), docs.columns)


def near_dup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, with the smallest id, of each group of near duplicates."""
    small = lambda df: F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
    rows = materialize(near_duplicates(docs, SIMILAR, with_class=True).select("doc_id", "cls", "root"), "pipeline-classes", small=True)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "cls"))
    best = materialize(rows.where("cls is not null").groupBy("root").agg(first.alias("w")).select("w.doc_id", "w.cls"), "pipeline-best", small=True)
    ids = rows.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"), F.first("cls").alias("cls"))
    shared = materialize(ids.where("n > 1").select("doc_id"), "pipeline-shared", small=True)
    gone = ids.where("n = 1 and cls is not null").join(best, ["doc_id", "cls"], "left_anti").select("doc_id")
    gone = materialize(gone.unionByName(shared), "pipeline-dropped", small=True)
    clear = docs.where("doc_id is not null").join(small(gone), "doc_id", "left_anti").select(*docs.columns)
    if shared.isEmpty() and rows.where("doc_id is null").isEmpty():
        return clear
    # Rows that an id doesn't tell apart: by their class, made anew.
    unclear = docs.where("doc_id is null").unionByName(docs.join(small(shared), "doc_id", "left_semi").select(*docs.columns))
    unclear = add_class(unclear, "__cls")
    won = unclear.join(best.toDF("__id", "__best"), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__cls") == F.col("__best")), "left_semi").dropDuplicates(["doc_id", "__cls"])
    return clear.unionByName(won.unionByName(unclear.where("__cls is null")).select(*docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage: none of a window's full length, and not two items' shorter ones."""
    own = _marked(docs)
    found = decontaminate(own, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), tuple(own.columns))
    leaked = (F.col("n_items") >= 2) | F.exists("hits", lambda h: h["last"] - h["first"] + 1 >= WINDOW)
    return _plain(found.where(~leaked), docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    own = _marked(docs)
    return _plain(repeat_copies(mix(own, tuple(own.columns))), docs.columns)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token files and gives what they hold: doc_id, start, n_tokens and ids_crc32."""
    return pack(docs, tokenizer_path(), END_ID)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_dup", near_dup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_files", token_files),
]

#: Hash functions, trained profiles and the tokenizer are beyond SQL; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each stage's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before = docs
        with temporary(spark):  # what the stage made on the way goes
            docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}", outlive=True)
        if name != STAGES[0][0]:
            remove(spark, sorted({f.rpartition("/")[0] for f in before.inputFiles()}))
    return STAGES[-1][1](spark, docs, sf_dir)
