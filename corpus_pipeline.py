"""A training corpus from `documents`: quality rules, near duplicates, personal data, source mixing, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns the rows that the next one reads.
All but the last return the columns of docs, whatever they are besides doc_id, text, lang and source. No stage reads
part of its input only, and each is judged on what its predecessor kept.

Nulls and repeats: a null text has no words and fails the quality rules; a null lang or source is a stratum or source of
its own; rows with a null doc_id are never dropped as near duplicates, for nothing else can name them; of rows that share
a doc_id and a text and survive, one stays. Empty tables pass through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenseek.llm.jaccard_join import jaccard_classes
from lumenseek.llm.mixing import mix_sources
from lumenseek.llm.packing import pack_documents
from lumenseek.llm.pii import pseudonymise
from lumenseek.llm.quality_rules import judge_documents
from lumenseek.llm.queries import PII_KEY, tokenizer_path
from lumenseek.llm.scratch import stored

#: No source is read more than this many times as often as the least read one, which is read once.
MAX_REPEATS = 2.0

#: SQL cannot tokenise, so the rows of run() have none; tests compare each stage's rows with what it should keep.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a base rule or lie above a risk-controlled cutoff go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return judge_documents(docs, labels).where("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by a word 5-shingle similarity of 0.8 or more, that of the smallest id stays."""
    classes = jaccard_classes(docs, shingle=5, percent=80)
    stays = classes.where("doc_id = component_id").select(F.col("doc_id").alias("_id")).distinct()
    rows = docs.select("doc_id", F.struct("*").alias("_row"))
    named = rows.where("doc_id IS NOT NULL").join(stays, F.col("doc_id") == F.col("_id"), "left_semi")
    # rows that share an id are one document if they share a text
    text = F.sha2(F.coalesce(F.col("_row.text").cast("string"), F.lit("")), 256)
    first = F.row_number().over(W.partitionBy("doc_id", text).orderBy(F.lit(0)))
    named = named.withColumn("_n", first).where("_n = 1")
    return named.select("_row.*").unionByName(rows.where("doc_id IS NULL").select("_row.*"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets become pseudonyms of the same format."""
    return pseudonymise(docs, PII_KEY)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; those of small sources are read up to MAX_REPEATS times."""
    return mix_sources(docs, max_repeats=MAX_REPEATS, keep_all=True).select("row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens in as few sequences as best fit finds."""
    return pack_documents(docs, str(tokenizer_path()), capacity=4096, end_id=1, carry={"ids_crc32": F.crc32("ids")})


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("pii", pii),
    ("source_mixing", source_mixing),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents one after another, each stage's rows written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
