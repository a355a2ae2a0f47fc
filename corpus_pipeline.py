"""A corpus pipeline of four stages: language ID, quality rules, n-gram Jaccard join, best-fit packing.

Each stage takes (spark, docs, sf_dir) and returns a table; `run` writes it as Parquet in the shared folder and reads
it back as the next stage's documents. The first three keep the columns of documents, whatever they are; the last one
returns the packed pieces.

Rows: decisions are taken for each row, known by a hash of its id and text, so that rows of one id with unlike texts are
judged apart. Rows alike in id and text share a decision; the join keeps one of them. Rows without an id are judged like
all others. Of the rows that the join links the one with the smallest id stays, nulls coming first; rows without a word
are linked with nothing and stay. An empty table gives empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.llm import common, language_id, ngram_join, packing, quality
from recollect.llm.queries import tokenizer_path

#: The boundary of one language's machine: a text that no machine claims is in none of the languages learned. With one
#: language left out of training at sf0.1 (every second row), 1.6 to 1.9 % of its texts of 50 words and more stayed
#: (41 % of the Spanish ones), and all such texts of the languages learned.
LEAST_SCORE = 0.5


def _key() -> Column:
    return F.xxhash64("doc_id", "text")


def _keyed(docs: DataFrame) -> DataFrame:
    """The rows' keys as ids, with what the operators read."""
    return docs.select(_key().alias("doc_id"), "text", "lang")


def _keep(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """Rows of docs for whose key a decision (doc_id, ok) is true."""
    name = "_key"
    while name in docs.columns:
        name += "_"
    kept = decisions.filter("ok").select(F.col("doc_id").alias(name))
    return docs.withColumn(name, _key()).join(kept, name, "left_semi").select(docs.columns)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that one of the learned languages claims; texts without a letter go as well. Where no row has a language
    to learn, only these go."""
    model = language_id.fit(docs, F.lit(True))
    if model is None:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    found = language_id.predict(_keyed(docs), model)
    return _keep(docs, found.select("doc_id", ((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= LEAST_SCORE)).alias("ok")))


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that pass the base rules and are like the language references."""
    return _keep(docs, quality.judge(_keyed(docs)).select("doc_id", F.col("kept").alias("ok")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 over shingles of five words: that of the smallest id."""
    classes = ngram_join.near_duplicates(_keyed(docs)).select(F.col("doc_id").alias("key"), "component_id", "n_shingles")
    ids = docs.select("doc_id", _key().alias("key"))
    groups = ids.join(classes.distinct(), "key").groupBy("component_id").agg(F.min(F.struct("doc_id", "key")).alias("first"), F.max("n_shingles").alias("n"))
    kept = _keep(docs, groups.select(F.col("first.key").alias("doc_id"), F.lit(True).alias("ok")))
    # Rows alike in id and text: one of those with a word stays.
    has_word = F.coalesce(F.col("text"), F.lit("")).rlike(common.WORD)
    return kept.filter(has_word).dropDuplicates(["doc_id", "text"]).unionByName(kept.filter(~has_word))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens, placed in sequences."""
    return packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"), end_id=0, capacity=2048, special_in_text=True)


STAGES = [
    ("language_id", identify_language),
    ("quality_rules", apply_quality_rules),
    ("ngram_jaccard", drop_near_duplicates),
    ("best_fit_packing", pack_sequences),
]

#: SQL cannot express the kernel machine, the packing or the tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents that the stages keep."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = common.scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
