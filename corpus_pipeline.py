"""From raw documents to token tables: five stages, each written and read again by the caller."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wayfare.llm import classify, decontaminate, mixing, simhash, sstable
from wayfare.llm.storage import Scratch

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: SimHash, tokens and a fitted model are beyond SQL; the stages are tested one by one.
ORACLE_SQL = None
#: A document goes if it is likelier than this to have the lowest grade.
LEAST_QUALITY = 0.5
END_ID = 2


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of more than the lowest grade, by ordinal regression.  Null and empty texts are graded like any other; without labels all stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return classify.select_quality(docs, classify.fit_quality(docs, labels), LEAST_QUALITY)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies.  Texts without words are copies of one another; repeated rows and rows without an id are documents like any other."""
    return simhash.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages.  Null and empty texts hold none; without items all stay."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks for, at most twice.  A null source is a source; one without any words gives no rows."""
    return mixing.mix(docs)


def token_tables(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token tables of the mix; what is returned is read back from them, a row for each copy.  Texts without words are their tokens, if any, and the end id."""
    import public_tokenizers

    scratch = Scratch(spark, "tokens")
    manifest = sstable.write_shards(docs, str(public_tokenizers.path("byte_bpe_50k.json")), END_ID, scratch)
    return sstable.read_digests(manifest)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", source_mix),
    ("token-ID / binary output", token_tables),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; each stage's result is a table in the shared folder.  Further columns, whatever their names, pass through; no documents give no rows."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)
