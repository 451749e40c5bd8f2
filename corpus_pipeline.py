"""A corpus from raw documents to token files, stage by stage.

Each stage takes all documents that its predecessor kept, and its result is written as Parquet and
read again as the next one's input.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kernelloom.llm import decontam, mixing, neardup, quality, ransfile
from kernelloom.llm.queries import table, tokenizer_path
from kernelloom.llm.shared import Scratch, free_names

#: Documents below this quality score are rejected.
LEAST_QUALITY = 0.3


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it never learns the held-out labels.

    Null and empty texts are scored like any other; repeated rows share their score; an empty table stays
    empty; a column of any name stays as it is."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"), ~quality.held_out())
    (own,) = free_names(docs, "quality_score")
    return quality.score(docs, model, out=own).where(F.col(own) >= LEAST_QUALITY).drop(own)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the smallest id.

    Rows that share an id count by their own texts; of several such texts that head one group, that of the
    least hash stays, and of rows that agree in id and text that of the least remaining columns, written
    as JSON.  Rows without an id, and rows without a word, all stay."""
    stay_id, stay_key, key, every, own, row = free_names(docs, "stay_id", "stay_key", "text_key", "every", "own", "row")
    marks = neardup.near_duplicates(docs).where("doc_id is not null and kept")
    heads = marks.where("group is not null").groupBy("group").agg(F.min(F.struct("doc_id", "text_key")).alias("h")).select("h.doc_id", "h.text_key", F.lit(False).alias("every"))
    stay = heads.unionByName(marks.where("group is null").select("doc_id", "text_key", F.lit(True).alias("every")).distinct()).toDF(stay_id, stay_key, every)
    keyed = docs.withColumn(key, F.xxhash64(F.col("text").cast("string")))
    joined = keyed.join(stay, (F.col("doc_id").cast("long") == F.col(stay_id)) & (F.col(key) == F.col(stay_key)))
    joined = joined.withColumn(own, F.when(F.col(every), F.monotonically_increasing_id()))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rest = F.to_json(F.struct(F.lit(0).alias(own), *[c for c, n in zip(columns, docs.columns) if n not in ("doc_id", "text")]))
    one = joined.groupBy(stay_id, stay_key, own).agg(F.min_by(F.struct(*columns), rest).alias(row))
    return one.select(f"{row}.*").unionByName(docs.where("doc_id is null"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items.

    Null and empty texts hold none and stay, as do rows without an id; of rows that share an id all go if
    one holds an item; repeated rows share their fate; without benchmark items all stay."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them.

    Null and empty texts have no words, so the mix takes none of them; a null source is a source of its
    own; equal rows are taken each by itself; an empty table stays empty."""
    return mixing.mix_sources(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, written and read back: doc_id, start, n_tokens, ids_crc32, shard.

    Null and empty texts have the end id only; null ids come first; repeated rows are written as often
    as they come; an empty table gives no rows."""
    return ransfile.token_file_index(docs, tokenizer_path())


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
    ("token_output", token_output),
]

#: SQL can express neither the classifier nor the tokenizer; tests/llm/test_pipeline.py compares every stage
#: and the whole run with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return docs
