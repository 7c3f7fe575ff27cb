"""The training-data pipeline: each stage works on all documents that its predecessor kept.

1. toxicity: documents that the classifier rejects go.
2. near_dedup: of each SimHash group the document with the smallest id stays.
3. secrets: every secret span in a text is replaced by a mark.
4. mixing: documents are repeated or left out as the source mix takes them,
   and stand in the order of the training stream, each pass at its own place.
5. packing: the documents are packed into sequences along that stream.

All stages but the last return the columns of ``documents``.

Defined cases, for every stage: null and empty texts are kept and count as
empty (as near-duplicates they are one group, and the mix takes no text
without a word); null ids are kept and never equal each other in near-duplicate
removal; null sources are a source of their own; repeated rows are
near-duplicates of each other; very long texts are read whole; an empty table
gives an empty result; further columns are carried along, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm import langid, mixing, packing, secrets, simhash, toxicity
from millrace.llm.columns import free_name
from millrace.scratch import drop_path, new_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

REJECT_FROM = 0.5
#: Bytes of the tokenizer's memo in a Python worker, which the other stages' workers share memory with.
MEMO_BYTES = 1 << 26


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = toxicity.training_rows(docs, labels, trained=~langid.held_out(F.col("doc_id"), 5, 0))
    scored = toxicity.score(docs, toxicity.fit(rows), carry=True)
    return scored.where(F.col(toxicity.score_name(docs)) < REJECT_FROM).drop(toxicity.score_name(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs, simhash.near_duplicates(docs))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = secrets.fit(secrets.labelled_samples(docs))
    return secrets.redacted(docs, model)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.stream(docs, mixing.mix(docs))


def in_file_order(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with its rows numbered from 0 under ``name``, file after file; as its partitions have them where it was not read from files."""
    at, file, rows = (free_name(n, [*docs.columns, name]) for n in ("at", "file", "rows"))
    try:
        placed = docs.select("*", F.col("_metadata.file_name").alias(file), F.col("_metadata.row_index").alias(at))
    except AnalysisException:
        return docs.select("*", F.monotonically_increasing_id().alias(name))
    # A row a file: what the files before it hold.
    sizes = placed.groupBy(file).agg(F.count("*").alias(rows))
    starts = sizes.select(F.col(file).alias(f"{file}_of"), F.coalesce(F.sum(rows).over(Window.orderBy(file).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(rows))
    joined = placed.join(F.broadcast(starts), F.col(file) == F.col(f"{file}_of"))
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], (F.col(rows) + F.col(at)).alias(name))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    place = free_name("place", docs.columns)
    return packing.pack_documents(in_file_order(docs, place), public_tokenizers.path("word_bpe_49k.json"), place_col=place, memo_bytes=MEMO_BYTES)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_dedup", near_dedup),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: Tokenizers and learned models have no SQL; tests hold every stage against a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again; a stage's table goes once the next one's is whole."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = new_path(spark, f"stage-{name}")
            docs.write.parquet(path)
            if before:
                drop_path(spark, before)
            docs, before = spark.read.parquet(path), path
    return docs
