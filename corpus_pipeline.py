"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again as the next one's input.

Counted with tidemark.llm. Every stage but the last returns the columns of documents; extra columns of its input stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe
from tidemark.llm.common import as_row, cut, from_row, shared_path, small, table
from tidemark.llm.decontaminate import contamination
from tidemark.llm.line_dedup import dedup_rows, rows_of
from tidemark.llm.near_dup import near_rows
from tidemark.llm.quality import kept_rows

#: A line of so many words is a repeated passage by itself.
LONG_LINE = 51


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and are no outlier of their language and source."""
    return kept_rows(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs, and of single lines of over 50 words, go; a document without any line left goes, one that had none stays."""
    out = dedup_rows(rows_of(docs, "doc_id", "text"), long_words=LONG_LINE)
    emptied = (F.col("n_removed") > 0) & (F.col("n_removed") == F.col("n_lines"))
    changed = {"text": F.col("text"), "n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)}
    now = [F.when(F.col("n_removed") > 0, changed[c]).otherwise(r).alias(c) if c in changed else r for c, r in zip(docs.columns, from_row(docs, "row"), strict=True)]
    return out.where(~emptied).select(*now)


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id and text's mark (xxhash64) are in gone (id, mark); null ids stay."""
    gone = small(cut(gone.select(F.col("id").alias("gone"), F.col("mark").alias("gone_mark")).distinct()))
    rows = docs.select(as_row(docs).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("mark"))
    same = (F.col("id") == F.col("gone")) & (F.col("mark") == F.col("gone_mark"))
    return rows.join(gone, same, "left_anti").select(*from_row(docs, "row"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with five-word shingles of similarity 0.8 or more stays: that of the least id.

    Rows go one by one: another text under the id of a copy stays. An id that is no number fails the run.
    """
    return _without(docs, near_rows(docs, words=5, num=80, den=100).where("id <> component_id"))


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of ten words of a benchmark item go."""
    rows = docs.select(as_row(docs).alias("row"), "text")
    return contamination(rows, table(spark, sf_dir, "benchmark"), doc="row").where(~F.col("contaminated")).select(*from_row(docs, "row"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids): the ids of each whole text; their decoding is checked against the text."""
    import public_tokenizers as P

    ranks = bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    ids = bpe.encode(docs.select("doc_id", "lang", "source", digest.alias("digest"), "text"), ranks, P.PATTERN, decoded="decoded")
    back = F.sha2("decoded", 256) == F.col("digest")
    whole = F.when(back, F.col("ids")).otherwise(F.raise_error(F.lit("ids do not decode to their text")).cast("array<int>"))
    return ids.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), whole.alias("ids"))


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("near_dedup", near_copies),
    ("decontamination", benchmark_free),
    ("byte_bpe", tokens),
]

#: The outlier verdicts, similarity and merges have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over sf_dir's documents; every stage's result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
