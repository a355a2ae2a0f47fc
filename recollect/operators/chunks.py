"""Chunks of texts, and the content-addressed store of chunks.

A store is a table (content_hash, raw, summary, ts, hits, last_used, wall_ts); calls are rows (seq, raw), seq being the
logical clock, distinct and increasing. Null texts are blank and give no chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions.text import LINES, content_hash, is_blank, trimmed

DAY = 86400


def positions(rows: DataFrame, group: str, order: str) -> DataFrame:
    """group, order and pos, the place from 1 of each row in its group, for an order without repeats.

    Only keys are moved: they are sorted by range into parts, numbered within each part, and moved on by the rows of
    their group in the parts before, of which there is one number for each part and group. A group of any size is thus
    dealt over all parts.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = rows.select(group, order).repartitionByRange(n, group, order).sortWithinPartitions(group, order)
    parts = keys.withColumn("_part", F.spark_partition_id())
    local = parts.withColumn("_nth", F.row_number().over(Window.partitionBy(group, "_part").orderBy(order)).cast("long"))
    sizes = local.groupBy(F.col(group).alias("_group"), "_part").agg(F.max("_nth").alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumnRenamed("_part", "_at")
    joined = local.join(before, local[group].eqNullSafe(before["_group"]) & (local["_part"] == before["_at"]))
    return joined.select(group, order, (F.col("_nth") + F.col("before")).alias("pos"))


def split_texts(rows: DataFrame, target: int, group: str, order: str) -> DataFrame:
    """Chunks of each group's non-blank texts: pos, sub (null where whole), positional_id, content_hash, raw."""
    told = rows.filter(~is_blank("text")).select(group, order, "text")
    numbers = positions(told, group, order).withColumnsRenamed({group: "_group", order: "_order"})
    placed = told.join(numbers, told[group].eqNullSafe(numbers["_group"]) & (told[order] == numbers["_order"]))
    parts = placed.select(group, "pos", line_pieces("text", max(1, target)).alias("parts"))
    cut = parts.select(group, "pos", F.size("parts").alias("n"), F.posexplode("parts").alias("at", "raw"))
    sub = F.when(F.col("n") > 1, F.col("at") + 1)
    name = F.concat_ws(".", F.col("pos").cast("string"), sub.cast("string"))
    return cut.select(group, "pos", sub.cast("long").alias("sub"), name.alias("positional_id"), content_hash("raw").alias("content_hash"), "raw")


@F.pandas_udf(ArrayType(StringType()))
def _pieces(text, target):  # noqa: ANN001, ANN202
    import re

    import pandas as pd

    lines_of = re.compile(LINES).findall
    wide = re.compile("[　-ヿ㐀-䶿一-鿿가-힯豈-﫿＀-￯]")

    def of(t: str | None, limit: int) -> list[str] | None:
        if t is None:
            return None
        w = len(wide.findall(t))
        if w + -(-(len(t) - w) // 4) <= limit:
            return [t]
        out, cur, cw, co = [], [], 0, 0
        for line in lines_of(t):
            lw = len(wide.findall(line))
            lo = len(line) - lw
            if cur and cw + lw + -(-(co + lo) // 4) > limit:
                out.append("".join(cur))
                cur, cw, co = [], 0, 0
            cur.append(line)
            cw, co = cw + lw, co + lo
        return [*out, "".join(cur)]

    return pd.Series([of(t, n) for t, n in zip(text, target, strict=True)])


def line_pieces(text: Column | str, target: int) -> Column:
    """The text cut between lines, as few pieces as a greedy walk gives; a longer line is a piece of its own.

    The walk is a loop over lines, linear in the text; as a fold of arrays it would be quadratic, hence Arrow.
    """
    return _pieces(text, F.lit(target))


def upsert(calls: DataFrame) -> DataFrame:
    """The store after calls (seq, raw) on an empty store without a limit, as one aggregation."""
    named = calls.withColumn("content_hash", content_hash("raw"))
    return named.groupBy("content_hash").agg(F.min_by("raw", "seq").alias("raw"), F.lit("").alias("summary"), F.min("seq").alias("ts"), (F.count(F.lit(1)) - 1).alias("hits"), F.max("seq").alias("last_used"), F.min("wall_ts").alias("wall_ts") if "wall_ts" in calls.columns else F.lit(None).cast("long").alias("wall_ts"))


def merge(store: DataFrame, calls: DataFrame) -> DataFrame:
    """The store after further calls; known chunks keep their text, summary and birth."""
    new = upsert(calls).select("content_hash", *(F.col(c).alias(f"_{c}") for c in ("raw", "summary", "ts", "hits", "last_used", "wall_ts")))
    both = store.join(new, "content_hash", "full")
    known = F.col("ts").isNotNull()
    return both.select(
        "content_hash",
        F.coalesce("raw", "_raw").alias("raw"),
        F.coalesce("summary", "_summary").alias("summary"),
        F.coalesce("ts", "_ts").alias("ts"),
        F.when(known, F.col("hits") + F.coalesce(F.col("_hits") + 1, F.lit(0))).otherwise(F.col("_hits")).alias("hits"),
        F.greatest("last_used", "_last_used").alias("last_used"),
        F.when(known, F.col("wall_ts")).otherwise(F.col("_wall_ts")).alias("wall_ts"),
    )


def write_summaries(store: DataFrame, summaries: DataFrame) -> DataFrame:
    new = summaries.select("content_hash", F.col("summary").alias("_new"))
    return store.join(new, "content_hash", "left").withColumn("summary", F.coalesce("_new", "summary")).drop("_new")


def lookup(chunks: DataFrame, store: DataFrame) -> DataFrame:
    """Chunks with hit (known to the store) and the stored summary."""
    known = store.select("content_hash", F.col("summary"), F.lit(True).alias("_hit"))
    return chunks.join(known, "content_hash", "left").withColumn("hit", F.coalesce("_hit", F.lit(False))).drop("_hit")


def evict(store: DataFrame, target: int, guard: int = 4096, buckets: int = 1024) -> DataFrame:
    """What is left after dropping the least recently used down to the target, sparing those used within the guard.

    The last victim's clock is found by counting rows in equal spans of the clock, span within span; only these counts
    go to the driver. Rows of that one clock value are ranked by hash.
    """
    sums = store.agg(F.count(F.lit(1)).alias("n"), F.max(F.greatest("ts", "last_used")).alias("clock"), F.min("last_used").alias("low")).first()
    excess = sums["n"] - target
    if excess <= 0:
        return store
    low, high = sums["low"], max(0, sums["clock"] - guard)  # victims are used from low on and before high
    old = store.select("content_hash", "last_used").filter(F.col("last_used") < high)
    while high - low > 1:
        step = -(-(high - low) // buckets)
        span = F.floor((F.col("last_used") - low) / step)
        counts = old.filter((F.col("last_used") >= low) & (F.col("last_used") < high)).groupBy(span.alias("b")).agg(F.count(F.lit(1)).alias("n")).orderBy("b").collect()
        whole = False
        for r in counts:
            if r["n"] > excess:
                low, high, whole = low + r["b"] * step, min(high, low + (r["b"] + 1) * step), True
                break
            excess -= r["n"]
        if not whole:
            return store.filter(F.col("last_used") >= high)
    if excess <= 0:
        return store.filter(F.col("last_used") >= low)
    last = old.filter(F.col("last_used") == low).orderBy("content_hash").limit(excess).select("content_hash")
    return store.filter(F.col("last_used") >= low).join(last, "content_hash", "left_anti")


def expire(store: DataFrame, days: int, now: int) -> DataFrame:
    """What is left after dropping chunks older than so many days; 0 drops nothing, and no age is no old age."""
    if days == 0:
        return store
    return store.filter(F.col("wall_ts").isNull() | (F.col("wall_ts") >= now - days * DAY))


def prune(store: DataFrame, cap: int, days: int, now: int, guard: int = 4096) -> DataFrame:
    return evict(expire(store, days, now), max(1, cap * 9 // 10) if cap else 0, guard)


def call_counts(store: DataFrame, calls: DataFrame) -> DataFrame:
    """One row: calls that find their chunk known, calls that make one, and those that find another text under its hash."""
    new = upsert(calls).select("content_hash", F.col("raw").alias("_raw"), F.col("hits").alias("_again"))
    both = new.join(store.select("content_hash", "raw"), "content_hash", "left")
    known = F.col("raw").isNotNull()
    counts = both.select(F.when(known, F.col("_again") + 1).otherwise(F.col("_again")).alias("hit"), (~known).cast("long").alias("miss"), (known & (F.col("raw") != F.col("_raw"))).cast("long").alias("other"))
    return counts.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(name) for c, name in (("hit", "hits"), ("miss", "misses"), ("other", "hash_collisions"))))


def merge_capped(store: DataFrame, calls: DataFrame, cap: int, guard: int = 4096) -> DataFrame:
    """The store after a batch of calls, shrunk to nine tenths of the cap where it went over; the batch is the unit of eviction."""
    merged = merge(store, calls)
    over = merged.agg(F.count(F.lit(1))).first()[0] > cap
    return evict(merged, max(1, cap * 9 // 10), guard) if over else merged


def undigested(chunks: DataFrame, store: DataFrame) -> DataFrame:
    """Each chunk text without a summary in the store, once: what a digest has to be asked for."""
    known = store.filter(~is_blank("summary")).select("content_hash")
    return chunks.dropDuplicates(["content_hash"]).join(known, "content_hash", "left_anti").select("content_hash", "raw")


def token_counts(texts: DataFrame, known: DataFrame, count: Column) -> DataFrame:
    """content_hash and tokens of each distinct text that the cache (content_hash, tokens) lacks; blank texts have none."""
    new = texts.filter(~is_blank("text")).select("text", content_hash("text").alias("content_hash")).dropDuplicates(["content_hash"])
    return new.join(known.select("content_hash"), "content_hash", "left_anti").select("content_hash", count.alias("tokens"))


def reconcile(store: DataFrame, dim: int, embed: Column) -> DataFrame:
    """The store with vectors of one length: where a row's vector is missing or of another length, it is made anew."""
    stale = F.col("embedding").isNull() | (F.size("embedding") != dim)
    return store.withColumn("embedding", F.when(stale, embed).otherwise(F.col("embedding")))


def latest_positions(chunks: DataFrame, group: str) -> DataFrame:
    """group, content_hash, positional_id: of chunks with one text, the last."""
    order = F.struct("pos", F.coalesce("sub", F.lit(0)))
    return chunks.groupBy(group, "content_hash").agg(F.max_by("positional_id", order).alias("positional_id"))


def recall(asked: DataFrame, externalized: DataFrame, chunks: DataFrame, store: DataFrame, group: str, limit: int = 8000) -> DataFrame:
    """Asked rows (group, id, part) with content: an externalized text by its id, or else a chunk by its position."""
    outside = externalized.select(group, "id", F.col("full_text").alias("_full"))
    inside = chunks.select(group, F.col("positional_id").alias("id"), "content_hash", F.col("raw").alias("_raw"))
    digests = store.select("content_hash", F.col("summary").alias("_summary"))
    rows = asked.join(outside, [group, "id"], "left").join(inside, [group, "id"], "left").join(digests, "content_hash", "left")
    found = F.coalesce("_full", chunk_part(F.col("_raw"), F.coalesce("_summary", F.lit("")), F.col("part")))
    return rows.select(group, "id", "part", F.coalesce(F.substring(found, 1, limit), F.lit("(no such chunk)")).alias("content"))


def chunk_part(raw: Column, summary: Column, part: Column) -> Column:
    told = F.lower(trimmed(F.coalesce(part, F.lit(""))))
    both = F.concat(F.lit("[summary] "), summary, F.lit("\n[raw] "), raw)
    return F.when(told == "summary", F.when(raw.isNotNull(), summary)).when(told == "both", both).otherwise(raw)
