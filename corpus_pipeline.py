"""A corpus made ready for training: rejected, deduplicated, cleaned of secrets and packed.

Each stage takes what its predecessor kept. All but the last return the columns of
``documents``; the last returns one row per piece of a bin.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from local_session import with_folder
from tilerank.llm import minhash, packing, quality, secret_scan, toxicity
from tilerank.llm.queries import read
from tilerank.sources.workspace import scratch_path, stored, workspace


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the fixed and the learned rules."""
    return quality.filter_documents(docs, quality.fit_rules(docs, read(spark, sf_dir, "labels")))


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not scored as toxic."""
    return toxicity.filter_documents(docs, toxicity.fit_toxicity(docs, read(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest doc_id. Texts
    are linked if their sets of 5-word shingles are alike at 0.8 or more."""
    return minhash.drop_near_duplicates(docs, percent=80)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced and ``n_chars`` counted anew."""
    return secret_scan.with_length(secret_scan.redact(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of text for training, as pieces."""
    return packing.pack(docs, with_text=True)


STAGES = [
    ("quality_rules", with_folder(quality_rules)),
    ("toxicity", with_folder(toxicity_filter)),
    ("minhash_near_dedup", with_folder(near_dedup)),
    ("secret_scans", with_folder(secret_scans)),
    ("best_fit_packing", with_folder(best_fit_packing)),
]

# Learned verdicts and packing have no SQL form; tests hold near-duplicates against brute force
# and run() against the stages by hand.
ORACLE_SQL = None


@with_folder
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. What they wrote on the way goes when the bins are
    written; the bins themselves stay in the shared folder."""
    docs = read(spark, sf_dir, "documents")
    bins = scratch_path(spark, "bins")
    with workspace(spark):
        for name, stage in STAGES[:-1]:
            docs = stored(stage(spark, docs, sf_dir), name)
        packed = STAGES[-1][1](spark, docs, sf_dir)
        packed.write.parquet(bins)
    return spark.read.schema(packed.schema).parquet(bins)
