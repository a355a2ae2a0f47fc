"""Quality rules by divergence from language references, with DataFrame functions only.

Each document gets two histograms: of its characters by class, and of its words over a language's common words (all
other words are one more bin). References are the mean histograms of all documents of a language that pass the base
rules. A document is kept if it passes the base rules and, for at least one language, both Jensen-Shannon distances
(roots of the divergence in bits) are within their limits; the histogram of common words is compared only from
`min_words` words on, and its limit has `slack` over the number of words added, as that of a short text is mostly chance. Languages are those of the `lang` column; rows whose
language is null or has no list of common words belong to the reference of the empty name, which has no common words.

Rows: null and empty texts have no words and fail the base rules; white space is ASCII white space; repeated rows are
judged alike; an empty table gives an empty result; only doc_id, text and lang are read. Two words, and two windows of
three words, are the same if their 64-bit hashes are.
"""

from __future__ import annotations

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, checkpoint

# Common words of each language.
COMMON = {
    "en": ["the", "of", "and", "to", "a", "in", "is", "that", "for", "it", "with", "as", "on", "be", "was", "are"],
    "fr": ["le", "la", "de", "et", "les", "des", "en", "un", "une", "que", "qui", "du", "par", "pour", "dans", "sur"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "por", "un", "para", "con", "no"],
}
#: Character classes: what a class removes from the text is what it counts; the rest is the last class.
CLASSES = {"lower": "[a-z]+", "upper": r"\p{Lu}+", "letter": r"[\p{L}&&[^a-z\p{Lu}]]+", "digit": "[0-9]+", "space": f"{SPACE}+", "stop": "[.,;:?'\"()-]+"}
WORDS = sorted({w for words in COMMON.values() for w in words})
#: What xxhash64() gives for them: XXH64 with seed 42, as a signed integer.
HASHES = [int.from_bytes(xxhash.xxh64_digest(w.encode(), seed=42), "big", signed=True) for w in WORDS]


def features(docs: DataFrame) -> DataFrame:
    """Base columns, counts of characters by class and counts of common words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.when(F.col("lang").isin(list(COMMON)), F.col("lang")).otherwise("").alias("lang"), text.alias("text"))
    # Lower-case letters and white space, most of a text, are taken off first; the other classes are counted in the rest.
    rows = rows.withColumn("bare", F.regexp_replace("text", CLASSES["lower"], ""))
    rows = rows.withColumn("rest", F.regexp_replace("bare", CLASSES["space"], ""))
    rows = rows.select(
        "doc_id",
        "lang",
        F.transform(F.array_remove(F.split("text", r"\s+"), ""), lambda x: F.xxhash64(x)).alias("w"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(rf"[^\x20\x09-\x0D]")).alias("lines"),
        F.length("text").alias("n_chars"),
        F.length("rest").alias("n_rest"),
        (F.length("text") - F.length("bare")).alias("c_lower"),
        (F.length("bare") - F.length("rest")).alias("c_space"),
        (F.length("rest") - F.length(F.regexp_replace("rest", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        *((F.length("rest") - F.length(F.regexp_replace("rest", p, ""))).alias(f"c_{k}") for k, p in CLASSES.items() if k not in ("lower", "space")),
    )
    rows = rows.select(
        "doc_id",
        "lang",
        F.size("w").cast("long").alias("n_words"),
        (F.col("c_lower") + F.col("n_rest")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr("CASE WHEN size(w) < 3 THEN array() ELSE transform(slice(w, 1, size(w) - 2), (x, i) -> xxhash64(x, get(w, i + 1), get(w, i + 2))) END").alias("h"),
        F.array(*(F.col(f"c_{k}").cast("double") for k in CLASSES), (F.col("n_chars") - sum(F.col(f"c_{k}") for k in CLASSES)).cast("double")).alias("chars"),
        F.filter("w", lambda x: x.isin(HASHES)).alias("known"),
    )
    repeated = "CASE WHEN size(array_distinct(h)) = size(h) THEN array() ELSE sort_array(transform(h, (x, i) -> struct(x AS h, i AS p))) END"
    rows = rows.withColumn("s", F.expr(repeated)).drop("h")
    places = "sort_array(transform(filter(s, (x, i) -> coalesce(x.h = get(s, i - 1).h, false) OR coalesce(x.h = get(s, i + 1).h, false)), x -> x.p))"
    rows = rows.withColumn("places", F.expr(places)).drop("s")
    covered = "aggregate(places, struct(0 AS n, -3 AS last), (a, p) -> struct(a.n + least(3, p - a.last) AS n, p AS last), a -> cast(a.n AS bigint))"
    counts = F.array(*((F.size("known") - F.size(F.array_remove("known", F.lit(h)))).cast("double") for h in HASHES))
    return rows.select("doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.expr(covered).alias("n_repeat_words"), "chars", counts.alias("commons"))


def _bins(language: str) -> str:
    """The histogram over a language's words, and other words, as shares of the words."""
    own = [f"get(commons, {WORDS.index(w)})" for w in COMMON.get(language, [])]
    return f"transform(array({', '.join([*own, ' - '.join(['n_words', *own])])}), x -> x / n_words)"


def _distance(p: str, q: str) -> str:
    term = "CASE WHEN {0} > 0 THEN {0} * log2(2 * {0} / (p + q)) ELSE 0D END"
    return f"sqrt(greatest(0D, aggregate(zip_with({p}, {q}, (p, q) -> 0.5D * ({term.format('p')} + {term.format('q')})), 0D, (a, x) -> a + x)))"


def judge(docs: DataFrame, char_limit: float = 0.23, word_limit: float = 0.25, slack: float = 1.5, min_words: int = 50) -> DataFrame:
    """doc_id, the base columns, the smallest distances, base_failed and kept."""
    rows = checkpoint(features(docs).withColumn("base_failed", F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")))
    languages = [*COMMON, ""]
    shares = rows.filter(~F.col("base_failed")).withColumn("c", F.expr("transform(chars, x -> x / aggregate(chars, 0D, (a, y) -> a + y))"))
    bins = F.expr("CASE lang " + " ".join(f"WHEN '{k}' THEN {_bins(k)}" for k in languages) + " END")
    shares = shares.withColumn("b", bins)
    n_chars, n_bins = len(CLASSES) + 1, max(map(len, COMMON.values())) + 1
    means = shares.groupBy("lang").agg(F.array(*(F.avg(F.get("c", F.lit(i))) for i in range(n_chars))).alias("ref_c"), F.array(*(F.avg(F.get("b", F.lit(i))) for i in range(n_bins))).alias("ref_b"))
    # One row with the references of the languages above: its size is fixed.
    refs = means.agg(F.map_from_entries(F.collect_list(F.struct("lang", F.struct("ref_c", "ref_b")))).alias("refs"))
    rows = rows.crossJoin(F.broadcast(refs)).withColumn("c", F.expr("transform(chars, x -> x / greatest(1D, aggregate(chars, 0D, (a, y) -> a + y)))"))
    tried = []
    for k in languages:
        words = _distance(_bins(k), f"slice(refs['{k}'].ref_b, 1, {len(COMMON.get(k, [])) + 1})")
        tried.append(f"struct({_distance('c', f"refs['{k}'].ref_c")} AS jc, CASE WHEN n_words < {min_words} THEN 0D ELSE {words} END AS jw, refs['{k}'] IS NOT NULL AND (lang = '' OR '{k}' <> '') AS told)")
    rows = rows.withColumn("tried", F.expr(f"CASE WHEN base_failed THEN array() ELSE filter(array({', '.join(tried)}), x -> x.told) END"))
    best = f"array_min(transform(tried, x -> struct(greatest(x.jc / {char_limit}, x.jw / ({word_limit} + {slack} / n_words)) AS worst, x.jc AS jc, x.jw AS jw)))"
    rows = rows.withColumn("best", F.expr(best))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.coalesce(F.col("best.worst") <= 1, F.lit(False))).alias("kept"), F.col("best.jc").alias("char_distance"), F.col("best.jw").alias("word_distance"))
