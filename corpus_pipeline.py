"""The corpus pipeline: documents in, shards of token ids out.

Each stage works on all that the one before it kept, which is written as Parquet and read again between them. All but
the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import decontaminate, langid, minhash, mixing, wavelet
from quillon.llm._cluster import Scratch, shared_dir, written
from quillon.llm.queries import table, tokenizer_path

#: Target weights of the mixing stage; children that are not named weigh 1. Nine tenths of the tokens are taken, once.
MIX = {"weights": {"lang": {"en": 4, "de": 2, "fr": 2, "es": 2}}, "budget": (9, 10), "max_epochs": 1, "seed": 7}
END_ID = 2


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from all rows with a language; texts without letters and texts unlike any language go."""
    return langid.keep_known(docs, langid.learn(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five words, a similarity of 0.8 or more."""
    return minhash.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each leaf of the tree of sources gives the prefix that its budget allows."""
    return mixing.mixed(docs, **MIX)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shards of wavelet matrices, which outlive the session; per document, read back: doc_id, start, n_tokens, ids_crc32."""
    folder = f"{shards_root(spark)}/{uuid.uuid4().hex}"
    return wavelet.token_files(docs, tokenizer_path(), end_id=END_ID, folder=folder).select("doc_id", "start", "n_tokens", "ids_crc32")


def shards_root(spark: SparkSession) -> str:
    """Where each run's shards are: a folder a run, in spark.quillon.shards or, where that is unset, in the shared folder."""
    return (spark.conf.get("spark.quillon.shards", None) or f"{shared_dir(spark)}/quillon-shards").rstrip("/")


def shard_folders(spark: SparkSession) -> list[str]:
    """The folders of the runs' shards, the latest last; wavelet.read_shards() and wavelet.documents() read them."""
    root = spark._jvm.org.apache.hadoop.fs.Path(shards_root(spark))
    store = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = store.listStatus(root) if store.exists(root) else []
    return [x.getPath().toString() for x in sorted(found, key=lambda x: x.getModificationTime())]


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mix), ("token_ids", token_ids)]

#: SQL cannot express the language models, the alignments and the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to the documents of sf_dir. What a stage leaves behind goes once its result is written."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        before = docs
        with written(spark):
            docs = scratch.table(stage(spark, docs, sf_dir), name)
        if k:
            scratch.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
