"""The corpus pipeline: toxic texts go, one of each group of near copies stays, secrets are masked, sources are mixed, texts become tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it
kept; between stages the rows are a Parquet table in the shared folder, which is
deleted as soon as the next one is there.

Nulls in any column, empty texts and texts of any length go through: a null text is no
near copy, holds no secret, has size 0 and no tokens; a null id is kept and is
the last choice of its group; null is a source of its own.  Rows that are equal in
all columns count as one where one of a group stays; rows that share only an id are rows
of their own throughout, and which of them stays follows from their contents.  Columns
besides those of documents are left behind, whatever their names.  An empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isopycna.llm import bpe, jaccard, mixing, secrets, toxicity
from isopycna.llm.common import documents, forget, kept

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from the labels of ``sf_dir``, does not predict to be toxic."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model, COLUMNS).where(F.col("toxicity") < toxicity.THRESHOLD).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs.select(*COLUMNS))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with secrets masked; ``n_chars`` follows where the text has changed."""
    masked = secrets.redact(docs.select(*COLUMNS, F.col("text").alias("_before")))
    same = F.col("text").eqNullSafe(F.col("_before"))
    return masked.withColumn("n_chars", F.when(same, F.col("n_chars")).otherwise(F.length("text"))).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: documents as often as it takes them."""
    return mixing.mixed(docs.select(*COLUMNS))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = bpe.encode(docs.select("doc_id", "source", "text"), public_tokenizers.path("word_bpe_49k.json"), keep=("doc_id", "source"))
    return out.select(
        "doc_id", "source", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("near copies", drop_near_copies),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("tokens", tokenize),
]

#: The classifier of the first stage is trained, which SQL cannot express; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = documents(spark, sf_dir), []
    for _, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir))
        forget(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
