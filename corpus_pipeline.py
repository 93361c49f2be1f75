"""The corpus pipeline: quality, line dedup, near-dedup, source mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
keep the columns of documents.  Decisions meet their rows by id and 128 bits of
the text (near-duplicates) or of all columns (mix), so rows without an id or with
a shared one are told apart, and rows that repeat both are one document.  Every
stage takes null ids, texts, languages and sources and empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgrid import lineage
from loamgrid.llm import common, line_dedup, mixing, packing, quality_classifier, queries, simhash_dedup

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _only(docs: DataFrame, key: Column, chosen: DataFrame) -> DataFrame:
    """Of the rows of docs whose id and ``key`` are in chosen (doc_id, key) one each; one shuffle of texts."""
    own = {"__none": F.col("doc_id").isNull(), "__id": F.coalesce("doc_id", F.lit(0)), "__a": F.col("__key.a"), "__b": F.col("__key.b")}
    wanted = chosen.withColumnRenamed("key", "__key").withColumns(own).select(*own).hint("merge")
    rows = docs.withColumn("__key", key).withColumns(own)
    return rows.join(wanted, list(own), "left_semi").dropDuplicates(list(own)).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts as good.

    One pass over the texts writes them with their features.  A null or empty
    text is scored like any other, a null id too; nothing is dropped where there
    is nothing to learn from.
    """
    table = common.written(quality_classifier.feature_table(docs, carry=COLUMNS))
    model = quality_classifier.train(table.select(F.col("__id").alias("doc_id"), "x"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_classifier.keep_good(table, model, list(COLUMNS))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later occurrences of three-line windows; every document stays, with its new length; a null text becomes empty."""
    out = line_dedup.line_dedup(docs, carry=("lang", "source"))
    return out.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.char_length("kept_text").cast("long").alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the first by id, those without an id last."""
    groups = simhash_dedup.simhash_dedup(docs)
    return _only(docs, common.text_key(F.coalesce("text", F.lit(""))), groups.filter("kept").select("doc_id", "key"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Nine tenths of the tokens, dealt by the target weights; no document twice."""
    key = common.text_key(*map(F.col, COLUMNS))
    chosen = mixing.mix_sources(docs.withColumn("key", key), queries.domain_of(F.col("source")), queries.MIX_WEIGHTS, percent=90, most_epochs=1, carry=("key",))
    return _only(docs, key, chosen.filter("copies > 0").select("doc_id", "key"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, each at its place in a sequence; a null or empty text is its separator, a null id stays."""
    return packing.pack_sequences(docs, *queries.tokenizer_files())


STAGES = [("quality classifier", quality), ("line dedup", lines), ("SimHash near-dedup", near_duplicates), ("source mixing", mix), ("best-fit packing", pack)]
#: The classifier and the tokenizer have no SQL form; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written, and what it read and wrote on the way is deleted then."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        with lineage.scope():
            table = lineage.Table(stage(spark, docs, sf_dir))
            docs = table.keep()
        if before is not None:
            before.drop()
        before = table
    return STAGES[-1][1](spark, docs, sf_dir)
