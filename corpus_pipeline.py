"""Training-data pipeline over ``documents``: toxicity, line dedup, SimHash near-dedup, benchmark decontamination, packing.

Each stage takes what its predecessor kept. All but the last return the columns of documents (n_chars follows a text that
changed); the last returns the packed pieces. Between stages the rows are written as Parquet to the shared folder.
Defined cases are those of the operators; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm._frames import free_name, stash
from ledgerline.llm.decontaminate import remove_contamination
from ledgerline.llm.line_dedup import remove_repeated_lines
from ledgerline.llm.packing import pack, token_pieces
from ledgerline.llm.queries import table, tokenizer_path
from ledgerline.llm.simhash import drop_near_duplicates
from ledgerline.llm.toxicity import drop_toxic


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def _with_text(docs: DataFrame, text) -> DataFrame:
    """``docs`` with ``text`` as the text; n_chars is counted anew where the text changed."""
    old, new = free_name(docs, "_old"), free_name(docs, "_new")
    changed = docs.withColumns({old: F.col("text"), new: text})
    size = F.when(F.col(old).eqNullSafe(F.col(new)), F.col("n_chars")).otherwise(F.char_length(new)) if "n_chars" in docs.columns else None
    return changed.withColumns({"text": F.col(new)} | ({"n_chars": size} if size is not None else {}))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled examples call toxic go."""
    return drop_toxic(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of runs of lines go from the texts."""
    out = free_name(docs, "_lines")
    return _with_text(remove_repeated_lines(docs, out=out), F.col(f"{out}.kept_text")).select(_columns(docs))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the least id."""
    return drop_near_duplicates(docs, shingle=3, max_bits=2)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words inside benchmark windows go from the texts; documents that consist of them by more than half go whole."""
    old = free_name(docs, "_before")
    clean = remove_contamination(docs.withColumn(old, F.col("text")), table(spark, sf_dir, "benchmark"))
    size = F.when(F.col(old).eqNullSafe(F.col("text")), F.col("n_chars")).otherwise(F.char_length("text"))
    return clean.withColumn("n_chars", size).select(_columns(docs)) if "n_chars" in docs.columns else clean.drop(old)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining texts, tokenised and packed into sequences of at most 2048 tokens."""
    pieces = token_pieces(docs, tokenizer_path())
    return pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: Tokenizer ids, SimHash and the classifier have no SQL form; tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir))
    return docs
