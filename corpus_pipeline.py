"""A corpus pipeline: five of the training-data operators, one after the other."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm import exact_dedup, mixing, packing, quality_rules, shingles, simhash
from driftline.llm._common import removed, shared_folder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the others lose the lines that most of a host repeats."""
    return quality_rules.cleaned(docs, quality_rules.quality_rules(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest doc_id stays."""
    return exact_dedup.deduplicated(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with close fingerprints are linked, and those that share 0.8 of their five-word shingles; of all that links reach the one with the smallest doc_id stays."""
    return shingles.deduplicated(docs, links=simhash.fingerprint_links(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source's documents as often as its share takes them."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequences' contents, a row for each piece of a document with its ids; ``packing.sequences`` joins them."""
    cut = packing.pieces(docs).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "ids")
    return packing.pack(cut)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("exact_dedup", exact),
    ("simhash_near_dedup", near),
    ("mixing", mix),
    ("packing", pack),
]

#: SQL can't express the fingerprints, the mix and the packing.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again.

    A stage's table goes when the next one is written, the last when the driver's Python ends.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    atexit.register(removed, spark, folder)
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if k:
            removed(spark, f"{folder}/{STAGES[k - 1][0]}")
    return docs
