"""From raw documents to packed training sequences, as stages of one table each.

Toxic documents go, one document of each near-duplicate group stays, documents that hold a passage of the benchmark
go, secrets are cut out of what is left, and the rest is packed. A stage gets what the one before it kept, and all but
the last return the columns of documents. Each stage writes its result as Parquet, which the next one reads.

Every stage takes an empty table, and columns of any other names, of which those of documents are found by exact name first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spotloom.llm import decontaminate, frames, neardup, packing, secrets, toxicity
from spotloom.llm.registry import tokenizer_path

#: A document whose score reaches this is rejected.
TOXIC_FROM = 0.3
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _columns(docs: DataFrame) -> DataFrame:
    return frames.pick(docs, **{c: c for c in COLUMNS})


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score under TOXIC_FROM by a model of the labels at hand. Rows of equal texts go or stay together; a null text
    is scored as one without terms; null ids teach nothing but are judged."""
    docs = _columns(docs)
    labels = frames.table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(frames.crc_mod(F.col("doc_id"), 4) != 2))
    return toxicity.keep_below(docs, model, TOXIC_FROM)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of the smallest id of each group, one where it repeats. Texts without words (also null ones) are linked with
    none, and rows with a null id all stay."""
    return neardup.keep_one_of_each(_columns(docs))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in which no window of the benchmark occurs, each by its own text; null texts have no words and stay."""
    return decontaminate.keep_clean(_columns(docs), frames.table(spark, sf_dir, "benchmark"))


def cut_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with the secrets in their texts replaced; null texts stay null."""
    return secrets.redact_columns(_columns(docs)).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each row; a null or empty text is the end id alone."""
    return packing.pack(docs, tokenizer=tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("near-duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", cut_secrets),
    ("packing", pack),
]

#: No SQL can express the classifier, the tokenizer or the packing; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over documents. Tables of stages and operators go when the next stage is written."""
    scratch = frames.Scratch(spark)
    docs = frames.table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        with frames.tidy():
            docs = scratch.keep(stage(spark, docs, sf_dir), f"{i}-{name}")
        if i:
            scratch.drop(f"{i - 1}-{STAGES[i - 1][0]}")
    return docs
