"""A training corpus from documents: language ID, toxicity, near-dedup, mixing by source, packing.

Each stage takes (spark, docs, sf_dir) and returns what it keeps, with the columns of documents; the last returns the
packed pieces. Between stages the rows are written as Parquet to the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import op1_minhash, op2_langid, op5_pack, op7_mix, op8_toxicity
from tidemill.llm.common import stash, table, without


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that a model accepts."""
    found = op2_langid.identify_languages(docs, op2_langid.trained(spark, sf_dir))
    return found.filter(found["lang_pred"] != op2_langid.UNKNOWN).select(*docs.columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic."""
    return op8_toxicity.score_texts(docs, op8_toxicity.trained(spark, sf_dir)).filter("predicted = 0").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, 80 per cent), that of the smallest doc_id.

    Where rows repeat a doc_id, each text of it is a document of its own; of rows that repeat doc_id and text, one stays, the
    same in every run. Rows without a doc_id all stay.
    """
    known = docs.filter("doc_id IS NOT NULL")
    if known.groupBy("doc_id").count().filter("count > 1").isEmpty():
        classes = stash(op1_minhash.minhash_dedup(docs), "classes")
        return without(docs, classes.filter("NOT kept").select("doc_id"), "doc_id")
    # every (doc_id, text) gets a number of its own, in the order of doc_id
    marked = known.withColumn("_print", F.coalesce(F.sha2("text", 256), F.lit("")))
    numbers = stash(marked.select("doc_id", "_print").distinct().repartitionByRange("doc_id", "_print").sortWithinPartitions("doc_id", "_print").withColumn("_number", F.monotonically_increasing_id()), "numbers")
    one = F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns))
    apart = stash(marked.join(numbers, ["doc_id", "_print"]).groupBy("_number").agg(one.alias("_row")).select("_row.*", "_number"), "texts")
    classes = stash(op1_minhash.minhash_dedup(apart.select(F.col("_number").alias("doc_id"), "text")), "classes")
    kept = without(apart, classes.filter("NOT kept").select(F.col("doc_id").alias("_number")), "_number")
    return kept.select(*docs.columns).union(docs.filter("doc_id IS NULL"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's weight asks: every one at least once, none more than twice; rows lie block by block, in the order of their places.

    Places are worked out without the texts, which then go to their blocks at once.
    """
    return op7_mix.lay_out(docs, op7_mix.MAX_REPEATS, F.sha2("text", 256))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens with their place in a sequence, packed in groups as the mixture's rows come."""
    return op5_pack.pack_documents(docs)


STAGES = [("language ID", language), ("toxicity", toxicity), ("near-dedup", near_dedup), ("mixing", mix), ("packing", packing)]
#: The stages learn, hash and search, which SQL can't express; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
