"""Search in chunks: exact vectors, BM25, rare shared words, matching lines, and walks over both kinds of links.

Chunks are rows (idx, raw); idx is unique. Queries are rows (query_id, ...). Null texts have no words, rows without a
vector are not found, vectors of other lengths score 0. Ties are settled by the smaller id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import compound_tokens, dot, fnv1a, folded_tokens, idf, is_usable, lines_of, truncate_to_bytes, truncate_to_tokens, wide_chars, word_tokens
from ..sources.shared import checkpoint

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def top_k(scored: DataFrame, k: int, group: str, key: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("score"), key))
    return scored.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= k)


def nearest(queries: DataFrame, vectors: DataFrame, k: int, scope: str | None = None) -> DataFrame:
    """query_id, vec_id, score, rank: each query's k vectors of the largest cosine, clamped to 0..1.

    Queries are a stated set, compared with all vectors, or with those that are equal in the scope column. Norms are taken once for each vector.
    """
    within = [scope] if scope else []
    q = queries.select("query_id", *within, F.col("embedding").alias("q"), F.sqrt(dot(F.col("embedding"), F.col("embedding"))).alias("qn"))
    v = vectors.filter("embedding IS NOT NULL").select("vec_id", *within, F.col("embedding").alias("v"), F.sqrt(dot(F.col("embedding"), F.col("embedding"))).alias("vn"))
    cos = F.when((F.size("q") == F.size("v")) & (F.col("qn") * F.col("vn") > 0), dot(F.col("q"), F.col("v")) / (F.col("qn") * F.col("vn"))).otherwise(0.0)
    scored = v.join(q, scope if scope else F.lit(True)).select("query_id", "vec_id", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), cos)), 6).alias("score"))
    return top_k(scored, k, "query_id", "vec_id")


def term_counts(chunks: DataFrame, tokens: Column) -> DataFrame:
    """idx, term, f, length: how often each term is in each chunk, and the chunk's number of terms."""
    rows = chunks.select("idx", tokens.alias("t")).select("idx", F.size("t").alias("length"), F.explode("t").alias("term"))
    return rows.groupBy("idx", "term").agg(F.count(F.lit(1)).alias("f"), F.first("length").cast("long").alias("length"))


def document_frequencies(counts: DataFrame) -> DataFrame:
    return counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def postings(counts: DataFrame) -> DataFrame:
    return counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.array_sort(F.collect_set("idx")).alias("chunks"))


def bm25(chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, idx, score, rank: the best chunks for the words of each query (query_id, text).

    Only terms of queries are counted: the semi-join drops the others before the first shuffle.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct(folded_tokens("text"))).alias("term"))
    words = chunks.select("idx", folded_tokens("raw").alias("t"))
    size = words.agg(F.count(F.lit(1)).alias("n"), F.avg(F.coalesce(F.size("t"), F.lit(0))).alias("avg_length"))
    rows = words.select("idx", F.size("t").alias("length"), F.explode("t").alias("term")).join(asked.select("term").distinct(), "term", "left_semi")
    counts = rows.groupBy("idx", "term").agg(F.count(F.lit(1)).alias("f"), F.first("length").alias("length"))
    df = document_frequencies(counts)
    weight = F.greatest(F.lit(LEAST_IDF), F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    part = weight * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("length") / F.col("avg_length")))
    # One row of corpus totals: its size is fixed.
    scored = counts.join(df, "term").crossJoin(F.broadcast(size)).select("idx", "term", part.alias("part"))
    sums = scored.join(asked, "term").groupBy("query_id", "idx").agg(F.round(F.sum("part"), 6).alias("score"))
    return top_k(sums.filter("score > 0"), k, "query_id", "idx")


def rare_word_scores(chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, idx, score, rank by the summed weights of usable query words in a chunk."""
    asked = queries.select("query_id", F.explode(compound_tokens("text")).alias("term")).filter(is_usable("term"))
    n = chunks.agg(F.count(F.lit(1)).alias("n"))
    held = chunks.select("idx", F.explode(compound_tokens("raw")).alias("term")).join(asked.select("term").distinct(), "term", "left_semi")
    weights = document_frequencies(held).crossJoin(F.broadcast(n)).select("term", idf(F.col("n"), F.col("df")).alias("w"))
    sums = held.join(weights, "term").join(asked, "term").groupBy("query_id", "idx").agg(F.round(F.sum("w"), 6).alias("score"))
    return top_k(sums, k, "query_id", "idx")


def chunk_lines(chunks: DataFrame, *keep: str) -> DataFrame:
    return chunks.select("idx", *keep, F.posexplode(lines_of("raw")).alias("line_no", "line"))


def with_context(lines: DataFrame, hit: Column) -> DataFrame:
    """idx, line_no, line, gap: lines that hit, each with the line after it; gap marks a jump."""
    order = Window.partitionBy("idx").orderBy("line_no")
    kept = lines.withColumn("hit", hit).withColumn("keep", F.col("hit") | F.coalesce(F.lag("hit").over(order), F.lit(False))).filter("keep")
    jump = F.coalesce(F.col("line_no") - F.lag("line_no").over(order) > 1, F.lit(False))
    return kept.select("idx", F.col("line_no").cast("long").alias("line_no"), "line", jump.alias("gap"))


def matching_lines(chunks: DataFrame, terms: list[str]) -> DataFrame:
    """Lines with a term in any case, each with the line after it."""
    hit = F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(F.lower("line"), t)) if terms else F.lit(False)
    return with_context(chunk_lines(chunks), hit)


def query_terms(query: Column | str) -> Column:
    """A query's words worth looking for."""
    return F.filter(F.array_distinct(word_tokens(query)), is_usable)


def within_tokens(lines: DataFrame, max_tokens: int) -> DataFrame:
    """idx, found: the lines joined, marks at gaps, stopping after the line that goes over the budget."""
    rows = lines.withColumn("piece", F.concat(F.when(F.col("gap"), F.lit("…\n")).otherwise(F.lit("")), "line", F.lit("\n")))
    before = Window.partitionBy("idx").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    wide = F.coalesce(F.sum(wide_chars("piece")).over(before), F.lit(0))
    chars = F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0))
    kept = rows.withColumn("est", wide + F.ceil((chars - wide) / 4)).filter(F.col("est") <= max_tokens)
    joined = kept.groupBy("idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "piece"))), lambda x: x["piece"]), "").alias("found"))
    return joined.select("idx", truncate_to_tokens(F.regexp_replace("found", r"\s+$", ""), max_tokens).alias("found"))


def grep(chunks: DataFrame, terms: list[str], max_tokens: int) -> DataFrame:
    return within_tokens(matching_lines(chunks, terms), max_tokens)


def grep_query(chunks: DataFrame, max_tokens: int) -> DataFrame:
    """idx, found: lines that hold a usable word of the chunk's own query (idx, raw, query) in any case."""
    lines = chunk_lines(chunks.withColumn("terms", query_terms("query")), "terms")
    return within_tokens(with_context(lines, F.exists("terms", lambda t: F.contains(F.lower("line"), t))), max_tokens)


def grep_prefix(chunks: DataFrame, max_tokens: int) -> DataFrame:
    """Like grep_query, but a usable word of the query has to begin a word of the line; both are folded."""
    lines = chunk_lines(chunks.withColumn("terms", F.filter(F.array_distinct(folded_tokens("query")), is_usable)), "terms")
    told = lines.filter(F.size("terms") > 0).withColumn("words", folded_tokens("line"))
    return within_tokens(with_context(told, F.exists("words", lambda w: F.exists("terms", lambda t: F.startswith(w, t)))), max_tokens)


def snippets(lines: DataFrame, words: Column, wanted: Column, group: list[str], max_tokens: int) -> DataFrame:
    """group, snippet: the lines (line_no, line) that hold a wanted word as a word of theirs, joined and cut by bytes."""
    hit = lines.filter(F.arrays_overlap(words, wanted))
    joined = hit.groupBy(*group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("joined"))
    return joined.select(*group, truncate_to_bytes("joined", 4 * max_tokens).alias("snippet")).filter("snippet <> ''")


def follow_terms(terms: DataFrame, seeds: DataFrame, max_df: int, hops: int) -> DataFrame:
    """idx, depth: chunks reached from the seeds over terms held by at most max_df chunks, by rounds of joins.

    terms: rows (idx, term), distinct. Common terms are dropped first, so a term joins max_df chunks at the most.
    """
    rare = document_frequencies(terms).filter(F.col("df").between(2, max_df)).select("term")
    links = terms.join(rare, "term")
    reached = seeds.select("idx", F.lit(0).alias("depth"))
    for hop in range(1, hops + 1):
        bridge = reached.filter(F.col("depth") == hop - 1).join(links, "idx").select("term").distinct()
        fresh = links.join(bridge, "term").select("idx").distinct().join(reached.select("idx"), "idx", "left_anti")
        reached = checkpoint(reached.unionByName(fresh.select("idx", F.lit(hop).alias("depth"))))
    return reached


def hashed_bag(rows: DataFrame, tokens: Column, key: str, dim: int = 256) -> DataFrame:
    """key, bucket, value: the words' counts by hash bucket, over the norm of all; a sparse vector of length 1."""
    words = rows.select(key, F.explode(tokens).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("f"))
    bucket = F.pmod(fnv1a("term"), F.lit(dim))  # dim divides 2**64, so the sign does no harm
    counts = words.groupBy(key, bucket.alias("bucket")).agg(F.sum("f").alias("n"))
    norm = F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy(key)))
    return counts.select(key, "bucket", (F.col("n") / norm).alias("value"))
