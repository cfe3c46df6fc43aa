"""A training corpus in five stages, from documents to token ids.

Each stage takes (spark, docs, sf_dir) and returns what it keeps; all but the
last return the columns of documents. n_chars follows a changed text. Other
columns, whatever their names, come back as they were.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontam, dedup, secrets, toxicity
from tidemark.llm.common import materialize, release, small_batches, table
from tidemark.llm.queries import tokenizer_path

REST = "_rest"


def _packed(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, text, and all other columns in one: no operator's column can meet one of theirs."""
    small_batches(spark)
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(F.lit(0).alias("_"), *rest).alias(REST))


def _unpacked(packed: DataFrame, columns: list[str], text: str = "text", before: str = "text") -> DataFrame:
    """The given columns, with another column's text; n_chars follows where it differs from the one before."""
    own = {"doc_id": F.col("doc_id"), "text": F.col(text)}
    if "n_chars" in columns and text != before:
        kept = F.col(f"{REST}.n_chars")
        own["n_chars"] = F.when(F.col(text).eqNullSafe(F.col(before)), kept).otherwise(F.length(text).cast("long"))
    return packed.select(*((own[c] if c in own else F.col(f"{REST}.`{c}`")).alias(c) for c in columns))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, trained on the labels of these documents, doesn't reject."""
    own = _packed(spark, docs)
    model = toxicity.train(own, table(spark, sf_dir, "labels"))
    return _unpacked(toxicity.score(own, model, real=False).where("predicted = 0"), docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8."""
    return _unpacked(dedup.drop_near_duplicates(_packed(spark, docs)), docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of test items are cut out of the texts; documents that mostly consist of them go."""
    found = decontam.decontaminate(_packed(spark, docs), table(spark, sf_dir, "benchmark"))
    return _unpacked(found.where("stays"), docs.columns, "clean_text")


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark."""
    own = _packed(spark, docs)
    scanned = secrets.scan(own.withColumn("clean", F.col("text")), secrets.train(own), text_col="clean")
    return _unpacked(secrets.redact(scanned, text_col="clean"), docs.columns, "clean")


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit) of every text, with their number and digests."""
    small_batches(spark)
    return bpe.encode(docs, tokenizer_path("word_bpe_49k.json"), keep=["doc_id"], real=False, packed=True)


STAGES = [
    ("toxicity", toxicity_stage),
    ("minhash_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("secret_scans", secret_stage),
    ("bpe", tokens_stage),
]

#: A trained model rejects documents in the first stage, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each but the last written and read again."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            release(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
