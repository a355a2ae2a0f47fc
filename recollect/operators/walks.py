"""Walks over the chunks of a request, along rare words and along vectors.

Chunks are rows (scope, idx, raw): idx orders the chunks of a scope, which holds one request's chunks and so is bounded
by the size of a request (16 MiB). Queries are rows (scope, query), one for each scope. Scopes are independent of each
other. Null texts have no words.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import compound_tokens, cosine, folded_tokens, is_usable, lines_of
from ..sources.shared import checkpoint
from .retrieval import B, K1, LEAST_IDF, snippets

FOLLOWED = 8  # a snippet's words that are followed
SNIPPET_TOKENS = 64


def _word_lines(chunks: DataFrame, words: Callable[[str], Column]) -> DataFrame:
    return chunks.select("scope", "idx", F.posexplode(lines_of("raw")).alias("line_no", "line")).withColumn("words", words("line"))


def follow_rare_words(chunks: DataFrame, queries: DataFrame, max_df_frac: float, hops: int, max_chunks: int, snippet_tokens: int = SNIPPET_TOKENS) -> DataFrame:
    """scope, rank, idx, depth, snippet: the chunks that share a rare word with the query, then those that share one with
    what was read, hop by hop, in the order in which they are found, until there are max_chunks.

    A word is rare if at most so many chunks of the scope hold it: the share max_df_frac of them, and two at least. In a
    hop words are taken in their order and the chunks of a word in theirs, so a chunk belongs to its smallest word: a
    hop is one aggregation for all scopes at once.
    """
    lines = checkpoint(_word_lines(chunks, compound_tokens))
    held = lines.select("scope", "idx", F.explode("words").alias("term")).filter(is_usable("term")).distinct()
    limit = chunks.groupBy("scope").agg(F.greatest(F.lit(2), F.ceil(F.lit(max_df_frac).cast("float") * F.count(F.lit(1)).cast("float"))).alias("limit"))
    # Words no more than `limit` chunks of the scope hold, and who holds them.
    rare = held.groupBy("scope", "term").agg(F.count(F.lit(1)).alias("df")).join(limit, "scope").filter("df <= limit").select("scope", "term")
    postings = checkpoint(held.join(rare, ["scope", "term"]))
    rare = postings.select("scope", "term").distinct()

    def read(found: DataFrame) -> DataFrame:
        """Found rows (scope, idx, wanted, ...) with their snippets."""
        joined = lines.join(found.select("scope", "idx", "wanted"), ["scope", "idx"])
        return found.drop("wanted").join(snippets(joined, F.col("words"), F.col("wanted"), ["scope", "idx"], snippet_tokens), ["scope", "idx"])

    asked = queries.select("scope", F.explode(compound_tokens("query")).alias("term")).distinct().join(rare, ["scope", "term"])
    seeds = postings.join(asked, ["scope", "term"]).groupBy("scope", "idx").agg(F.collect_set("term").alias("wanted"))
    in_order = Window.partitionBy("scope").orderBy("idx")
    path = checkpoint(read(seeds.withColumn("rank", F.row_number().over(in_order).cast("long")).filter(F.col("rank") <= max_chunks).withColumn("depth", F.lit(0))))
    followed = None
    for hop in range(1, hops + 1):
        last = path.filter(F.col("depth") == hop - 1)
        frontier = last.select("scope", F.explode(compound_tokens("snippet")).alias("term")).distinct().join(rare, ["scope", "term"])
        if followed is not None:
            frontier = frontier.join(followed, ["scope", "term"], "left_anti")
        frontier = checkpoint(frontier)
        followed = frontier if followed is None else followed.unionByName(frontier)
        fresh = postings.join(frontier, ["scope", "term"]).join(path.select("scope", "idx"), ["scope", "idx"], "left_anti")
        claimed = fresh.groupBy("scope", "idx").agg(F.min("term").alias("term"))
        before = path.groupBy("scope").agg(F.max("rank").alias("before"))
        nth = F.row_number().over(Window.partitionBy("scope").orderBy("term", "idx"))
        placed = claimed.join(before, "scope").withColumn("rank", F.col("before") + nth).filter(F.col("rank") <= max_chunks)
        path = path.unionByName(checkpoint(read(placed.select("scope", "idx", F.array("term").alias("wanted"), "rank", F.lit(hop).alias("depth")))))
    return path.select("scope", "rank", "idx", "depth", "snippet")


def _idf(df: int, n: int) -> float:
    return math.log(1 + n / max(df, 1))


def best_first(chunks: DataFrame, queries: DataFrame, hops: int, max_chunks: int, folded: bool = True, snippet_tokens: int = SNIPPET_TOKENS) -> DataFrame:
    """scope, rank, idx, depth, snippet: a walk that always reads the best chunk known.

    Known are first the chunks that share a word with the query, by BM25 (folded words) or by the summed weights of the
    shared words (compound words, or if BM25 finds nothing); then, after each chunk read, those that hold one of the
    heaviest words of what was read, by that word's weight. Ties go to the smaller idx. The walk is a loop over a scope's
    own words, one task a scope at a time.
    """
    words = folded_tokens if folded else compound_tokens
    told = _word_lines(chunks, words).join(queries.select("scope", words("query").alias("asked")), "scope")

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        from collections import Counter

        rows = rows.sort_values(["idx", "line_no"])
        asked = sorted({w for w in rows["asked"].iloc[0] if _usable(w)})
        held: dict[int, Counter[str]] = {}
        lines: dict[int, list[tuple[str, set[str]]]] = {}
        for idx, line, found in zip(rows["idx"], rows["line"], rows["words"], strict=True):
            held.setdefault(idx, Counter()).update(found)
            lines.setdefault(idx, []).append((line, set(found)))
        n = len(held)
        postings: dict[str, list[int]] = {}
        for idx, found in held.items():
            for w in found:
                postings.setdefault(w, []).append(idx)

        def weight(w: str) -> float:
            return _idf(len(postings.get(w, ())) or n, n)

        def bm25(idx: int) -> float:
            size = sum(held[idx].values())
            mean = sum(sum(h.values()) for h in held.values()) / n
            total = 0.0
            for w in asked:
                if f := held[idx][w]:
                    df = len(postings[w])
                    total += max(LEAST_IDF, math.log((n - df + 0.5) / (df + 0.5))) * f * (K1 + 1) / (f + K1 * (1 - B + B * size / mean))
            return total

        hit = {idx: [w for w in asked if w in found] for idx, found in held.items()}
        known = [(bm25(idx) if folded else sum(map(weight, ws)), idx, ws, 0) for idx, ws in hit.items() if ws]
        seen: set[int] = set()
        path = []
        while len(path) < max_chunks and (left := [(-score, idx, at) for at, (score, idx, _, _) in enumerate(known) if idx not in seen]):
            at = min(left)[2]
            score, idx, wanted, depth = known[at]
            known[at] = known[-1]  # the last one takes its place, which decides between equals later
            known.pop()
            seen.add(idx)
            snippet = "\n".join(line for line, found in lines[idx] if found.intersection(wanted)).encode()[: 4 * snippet_tokens].decode(errors="ignore")
            if not snippet:
                continue
            path.append((rows["scope"].iloc[0], len(path) + 1, idx, depth, snippet))
            if depth < hops:
                read = {w for w in _tokens(snippet, folded) if _usable(w)}
                for score, w in sorted((-weight(w), w) for w in read)[:FOLLOWED]:
                    known += [(-score, j, [w], depth + 1) for j in postings.get(w, ()) if j not in seen]
        return pd.DataFrame(path, columns=["scope", "rank", "idx", "depth", "snippet"])

    return told.groupBy("scope").applyInPandas(walk, "scope long, rank long, idx long, depth int, snippet string")


def _usable(word: str) -> bool:
    from ..functions.text import STOPWORDS

    return len(word.encode()) >= 2 and word not in STOPWORDS


def _tokens(text: str, folded: bool) -> list[str]:
    """The words of a short text, as the column functions find them."""
    import unicodedata

    import regex

    if folded:
        return regex.findall(r"[\p{L}\p{N}\p{Co}]+", regex.sub(r"\p{Mn}+", "", unicodedata.normalize("NFD", text)).lower())
    units = [u.strip("_./-").lower() for u in regex.findall(r"[\p{Alphabetic}\p{N}_./-]+", text)]
    return [w for u in units for w in (u, *regex.split(r"[_./-]+", u)) if w]


def follow_vectors(vectors: DataFrame, queries: DataFrame, top_k: int, fanout: int, hops: int, max_chunks: int, min_score: float = 0.0, min_similarity: float = 0.15) -> DataFrame:
    """scope, rank, idx, depth: the chunks nearest to the query's vector, then their nearest neighbours, hop by hop.

    Vectors are rows (scope, idx, embedding), queries rows (scope, embedding). A chunk's neighbours are its best fanout + 1
    in the scope, itself among them, known or not. Only the number of chunks found by hops is bounded by max_chunks.
    """
    rows = vectors.filter("embedding IS NOT NULL")
    score = F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), cosine(F.col("q"), F.col("embedding")))), 6)
    nearest = Window.partitionBy("scope", "of").orderBy(F.desc("score"), "idx")

    def best(asked: DataFrame, k: int, least: float) -> DataFrame:
        """The k best of the scope for each asked vector (scope, of, q), less those under the least score."""
        scored = rows.join(asked, "scope").select("scope", "of", "idx", score.alias("score"))
        return scored.withColumn("nth", F.row_number().over(nearest)).filter((F.col("nth") <= k) & (F.col("score") >= least))

    anchors = best(queries.select("scope", F.lit(0).cast("long").alias("of"), F.col("embedding").alias("q")), top_k, min_score)
    path = anchors.select("scope", F.row_number().over(Window.partitionBy("scope").orderBy("nth")).cast("long").alias("rank"), "idx", F.lit(0).alias("depth"))
    for hop in range(1, hops + 1):
        last = path.filter(F.col("depth") == hop - 1).select("scope", "idx", F.col("rank").alias("of"))
        asked = rows.join(last, ["scope", "idx"]).select("scope", "of", F.col("embedding").alias("q"))
        fresh = best(asked, fanout + 1, min_similarity).join(path.select("scope", "idx"), ["scope", "idx"], "left_anti")
        first = fresh.groupBy("scope", "idx").agg(F.min(F.struct("of", "nth")).alias("found"))
        before = path.groupBy("scope").agg(F.max("rank").alias("before"))
        nth = F.row_number().over(Window.partitionBy("scope").orderBy("found"))
        placed = first.join(before, "scope").withColumn("rank", F.col("before") + nth).filter(F.col("rank") <= max_chunks)
        path = checkpoint(path.unionByName(placed.select("scope", "rank", "idx", F.lit(hop).alias("depth"))))
    return path
