"""From raw documents to packed training sequences, in five stages."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from depotwise.llm import decontamination, near_dedup, packing, suffix_dedup, toxicity
from depotwise.llm.common import table
from depotwise.session import materialise

# A batch between Spark and a worker has up to 10,000 rows by Spark's own rule: 20 MB of texts and 50 MB of shingle sets, which
# take memory several times over on both sides (buffers that grow by doubling, the message, its copy). No row depends on batches.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold, by a model of the labelled ones among them.

    Null and empty texts score like texts without matches, and stay unless the labels say that such texts are
    toxic. Repeated rows are judged alike. Without labels the weights are prior ones. Other columns than those of documents go."""
    docs = docs.select(*COLUMNS)
    return toxicity.without_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate component, and those without an id.

    Null and empty texts are near nothing and stay. Rows that share an id are one document: they stay or go together,
    so equal rows of an id that stays all stay."""
    docs = docs.select(*COLUMNS)
    copies = near_dedup.near_duplicates(docs).rows.where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(copies, "doc_id", "left_anti")


def without_cut_characters(raw: Column) -> Column:
    """A text of UTF-8 bytes without bytes that are no whole character. Replacement characters that the text itself
    has are set aside meanwhile, by two code points that are no characters."""
    aside = F.replace(F.replace(raw, F.lit("\ufdd0"), F.lit("\ufdd0\ufdd1")), F.lit("\ufffd"), F.lit("\ufdd0\ufdd2"))
    valid = F.replace(F.make_valid_utf8(aside), F.lit("\ufffd"), F.lit(""))
    return F.replace(F.replace(valid, F.lit("\ufdd0\ufdd2"), F.lit("\ufffd")), F.lit("\ufdd0\ufdd1"), F.lit("\ufdd0"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without strings that occur earlier; what is left of a cut character goes too.

    Null texts become empty ones; a text of which nothing is left stays as an empty one. Of equal texts the
    smallest doc_id keeps its strings. `n_chars` counts what is left."""
    kept = suffix_dedup.deduplicated(docs.select(*COLUMNS), keep=("lang", "source"))
    raw = F.col("kept").cast("string")
    whole = F.when(F.is_valid_utf8(raw), raw).otherwise(without_cut_characters(raw))
    return kept.select("doc_id", whole.alias("text"), "carried.lang", "carried.source").select(
        "doc_id", "text", "lang", "source", F.length("text").cast("bigint").alias("n_chars")
    )


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item. Null and empty texts hold none and stay, repeated rows too; without
    benchmark items all stay."""
    return decontamination.uncontaminated(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all documents' pieces in sequences of 2048 tokens; a null or empty text is one token, and each row
    of a repeated id has pieces of its own."""
    return packing.pack(docs)


def in_small_batches(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The stage in a session that bounds its batches by bytes, by BATCH_BYTES if it has no bound of its own. The setting stays:
    rows of a stage are made when they are read."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if spark.conf.get(BATCH_SETTING, None) is None:
            spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))
        return stage(spark, docs, sf_dir)

    return run


STAGES = [
    ("toxicity", in_small_batches(drop_toxic)),
    ("near_duplicates", in_small_batches(drop_near_duplicates)),
    ("suffix_duplicates", in_small_batches(cut_repeats)),
    ("decontamination", in_small_batches(drop_leaks)),
    ("packing", in_small_batches(pack)),
]

# Models, alignments and suffix orders have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each writes to the shared folder what the next one reads."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
