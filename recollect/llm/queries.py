"""Queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .oracles import ORACLE_SQL  # noqa: F401


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import language_id

    docs = common.table(spark, sf_dir, "documents")
    held_out = common.is_held_out(3, 1)
    model = language_id.fit(docs, ~held_out)
    return language_id.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_dedup import near_duplicates

    return near_duplicates(common.table(spark, sf_dir, "embeddings"), threshold=0.95)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sentencepieces import encode_documents

    return encode_documents(common.table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), digests_only=True)


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import extract_pages

    return extract_pages(common.table(spark, sf_dir, "pages"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import near_duplicates

    return near_duplicates(common.table(spark, sf_dir, "documents"), words=4, num=85, den=100)


def op6_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    return quality.judge(common.table(spark, sf_dir, "documents")).drop("char_distance", "word_distance")


def op7_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import token_orc

    path = common.scratch_path(spark, "tokens-orc")
    token_orc.write(common.table(spark, sf_dir, "documents"), path, tokenizer_path("byte_bpe_50k.json"), end_id=2, special_in_text=True)
    return token_orc.positions(token_orc.read(spark, path))


def op8_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import warc_revisits

    found = warc_revisits.resolve(warc_revisits.crawl_of(common.table(spark, sf_dir, "pages")))
    headers = F.col("headers")
    return found.select("record_id", "canonical_url", "outcome", "response_id", headers["cache-control"].alias("cache_control"), headers["content-length"].alias("content_length"), F.when(headers.isNotNull(), F.size(headers)).alias("n_headers"), F.md5("payload").alias("payload_md5"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_score import score_documents

    held_out = common.is_held_out(7, 2)
    found = score_documents(common.table(spark, sf_dir, "documents"), ~held_out)
    bits = (-F.col("score") * 3.321928094887362 / F.col("n_bytes")).alias("bits_per_byte")
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", bits)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(common.table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=0, capacity=2048, special_in_text=True)


QUERIES = {f.__name__: f for f in (op1_language_id, op2_embedding_dedup, op3_sentencepiece, op4_html_extraction, op5_ngram_jaccard, op6_quality_divergence, op7_token_orc, op8_warc_revisits, op9_lm_scoring, op10_best_fit_packing)}

