"""Near-duplicate documents by an exact Jaccard join on word shingles, with rare-first prefix filtering.

1. Each document becomes the set of 64-bit hashes of its shingles. Documents of one set (by a hash of 64 bits) are one
   vertex. Shingle frequencies over the whole corpus go into a sketch of fixed size (one
   count for each hash bucket), which orders shingles from rare to common; ties are ordered by hash. Any order gives the
   same result; this one keeps passages that many documents share out of the prefixes.
2. Two sets that reach the threshold share a shingle within their prefixes, the first n - ceil(t n) + 1 shingles in that
   order. Prefix shingles that one set alone has are dropped after counting.
3. Shingles of up to `common` sets give pairs, passed through length filter, positional filter and suffix filter (sizes
   of the sets by hash range bound their difference from below). Each pair left is verified once, on the whole sets.
   Shingles of more sets give no pairs: their sets, in chunks, meet within tasks, which count all overlaps by matrix
   products and return a spanning forest of the links only. Sets first meet within chunks, which differ from shingle to
   shingle; chunks of a shingle meet each other only if its sets are in several classes after that, so that the copies of
   a template, who share many shingles, meet a few times each and not all of them for every shingle.
4. Links are contracted to components, each named by the smallest document of its sets.

Shuffle files and tables of a step are let go before the next one, so that disks hold one step's at a time.

Rows: null texts and texts without words have an empty set and link with nothing; nor do rows with a null id, whose
component is null. Repeated ids and texts are allowed: each row has the component of its own text. Words are split at
ASCII white space only and A-Z are lower-cased. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, checkpoint, release
from .graph import components

SKETCH_BITS, SKETCH_BLOCKS = 20, 64
RANGES = 16


class Shingler:
    """The sorted distinct shingle hashes of a text."""

    WORDS_KEPT = 400_000  # hashes remembered; a cache

    def __init__(self, words: int):
        self.words = words
        self.known: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        tokens = text.encode().lower().split() if text else []
        if not tokens:
            return np.zeros(0, np.uint64)
        known = self.known
        got = list(map(known.get, tokens))
        if None in got:
            if len(known) > self.WORDS_KEPT:
                known.clear()
            for w in {w for w, h in zip(tokens, got, strict=True) if h is None}:
                known[w] = xxhash.xxh3_64_intdigest(w)
            got = [xxhash.xxh3_64_intdigest(w) if h is None else h for w, h in zip(tokens, got, strict=True)]
        h = np.array(got, np.uint64)
        k = min(self.words, len(h))
        mixed = np.full(len(h) - k + 1, k, np.uint64)
        for i in range(k):
            mixed = (mixed ^ h[i : len(h) - k + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0xD6E8FEB86659FD93)
        return np.unique(mixed ^ (mixed >> np.uint64(32)))


def _vertex(shingles: np.ndarray) -> int:
    """A number of 64 bits for a set; sets of one number are one vertex."""
    return int.from_bytes(xxhash.xxh3_64_digest(shingles.tobytes()), "little", signed=True)


def _bucket(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _read(words: int):
    """First pass: a row for each document, and the part's sketch in blocks."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, sketch = Shingler(words), np.zeros(1 << SKETCH_BITS, np.int32)
        names = ["doc_id", "n", "v", "ranges", "block", "counts"]
        for keys, texts in batches(parts, "doc_id", "text"):
            counts, vertices, ranges = [], [], []
            for text in texts:
                s = of(text)
                counts.append(len(s))
                vertices.append(_vertex(s) if len(s) else None)
                ranges.append(_ranges(s))
                np.add.at(sketch, _bucket(s), 1)
            n = len(keys)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(counts, pa.int64()), pa.array(vertices, pa.int64()), pa.array(ranges, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=names)
        if sketch.any():
            blocks = [zlib.compress(b.tobytes(), 1) for b in sketch.reshape(SKETCH_BLOCKS, -1)]
            n = len(blocks)
            yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.array(range(n), pa.int32()), pa.array(blocks, pa.binary())], names=names)

    return run


def _ranges(shingles: np.ndarray) -> bytes:
    """How many shingles fall into each sixteenth of the hash range, as 32-bit integers."""
    return np.bincount((shingles >> np.uint64(60)).astype(np.int64), minlength=RANGES).astype("<i4").tobytes()


def _add_blocks(batch_iterator: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up the sketch blocks of one partition, one by one."""
    total: dict[int, np.ndarray] = {}
    for blocks, counts in batches(batch_iterator, "block", "counts"):
        for b, raw in zip(blocks, counts, strict=True):
            own = np.frombuffer(zlib.decompress(raw), np.int32).astype(np.int64)
            total[b] = total[b] + own if b in total else own
    yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.int32()), pa.array([zlib.compress(c.tobytes(), 1) for c in total.values()], pa.binary())], names=["block", "counts"])


def _prefixes(words: int, num: int, den: int, packed: bytes):
    """Second pass: the prefix shingles of each set that the part has not had before."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, had = Shingler(words), set()
        sketch = np.frombuffer(zlib.decompress(packed), np.int64)
        for (texts,) in batches(parts, "text"):
            tokens, vertices, sizes, places = [], [], [], []
            for text in texts:
                s = of(text)
                if not len(s) or (v := _vertex(s)) in had:
                    continue
                had.add(v)
                n = len(s)
                p = n + (-n * num) // den + 1
                order = np.lexsort((s, sketch[_bucket(s)]))[:p]
                tokens.append(s[order].view(np.int64))
                vertices.append(np.full(p, v))
                sizes.append(np.full(p, n, np.int32))
                places.append(np.arange(p, dtype=np.int32))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (tokens, vertices, sizes, places)], names=["token", "v", "n", "pos"])

    return run


def _suffix_filter(num: int, den: int):
    """Pairs whose sets may reach the threshold: what their sizes by hash range differ in, no overlap can make good."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<i4").reshape(-1, RANGES).astype(np.int64) for i in (2, 3))
            both = x.sum(1) + y.sum(1)
            need = -(-num * both // (num + den))
            keep = np.abs(x - y).sum(1) <= both - 2 * need
            yield batch.select([0, 1]).filter(pa.array(keep))

    return run


def _sets(words: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Shingler(words)
        for vertices, texts in batches(parts, "v", "text"):
            found = [(v, s) for v, t in zip(vertices, texts, strict=True) if len(s := of(t)) and _vertex(s) == v]
            for lo in range(0, len(found), 256):
                some = found[lo : lo + 256]
                offsets = np.concatenate([[0], np.cumsum([len(s) for _, s in some])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([s for _, s in some]).view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array([v for v, _ in some], pa.int64()), lists], names=["v", "set"])

    return run


def _verify(num: int, den: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            keep = []
            sets = [(c.offsets.to_numpy(), c.values.to_numpy().view(np.uint64)) for c in (batch.column(2), batch.column(3))]
            for i in range(batch.num_rows):
                x, y = (values[offsets[i] : offsets[i + 1]] for offsets, values in sets)
                at = np.searchsorted(x, y)
                both = int((x[np.minimum(at, len(x) - 1)] == y).sum())
                if den * both >= num * (len(x) + len(y) - both):
                    keep.append(i)
            yield batch.select([0, 1]).take(pa.array(keep, pa.int64()))

    return run


def _meet(num: int, den: int):
    """Links between the sets of a common shingle that one task holds, as a spanning forest."""

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        ids, chunk = group["v"].to_numpy(), group["chunk"].to_numpy()
        lists = group["set"].combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy())
        values, column, times = np.unique(lists.flatten().to_numpy(), return_inverse=True, return_counts=True)
        shared = np.cumsum(times > 1) - 1
        row = np.repeat(np.arange(len(ids)), sizes)
        kept = times[column] > 1
        row, column = row[kept], shared[column[kept]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        both = np.zeros((len(ids), len(ids)), np.float32)
        width = 2048
        for lo in range(0, int(column[-1]) + 1 if len(column) else 0, width):
            a, b = np.searchsorted(column, [lo, lo + width])
            there = np.zeros((len(ids), width), np.float32)
            there[row[a:b], column[a:b] - lo] = 1
            both += there @ there.T
        both = both.astype(np.int64)
        linked = den * both >= num * (sizes[:, None] + sizes[None, :] - both)
        if chunk.min() != chunk.max():
            linked &= chunk[:, None] != chunk[None, :]
        np.fill_diagonal(linked, True)
        label = ids.copy()
        far = np.iinfo(np.int64).max
        while True:
            new = np.where(linked, label[None, :], far).min(1)
            if (new == label).all():
                break
            label = new
        told = label != ids
        return pa.table({"a": ids[told], "b": label[told]})

    return run


def _of(sets: DataFrame, rows: DataFrame, most: int = 100_000) -> DataFrame:
    """Rows (v, ...) with their sets. Sets of few vertices are picked where they lie, by a broadcast of the vertices'
    numbers; of more than `most`, they are joined with all of the sets."""
    wanted = checkpoint(rows.select("v").distinct())
    if wanted.count() <= most:
        sets = sets.join(F.broadcast(wanted), "v", "left_semi")
    return rows.join(sets, "v")


def near_duplicates(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, common: int = 64, chunk: int = 512) -> DataFrame:
    """doc_id, n_shingles and component_id of each row; two sets link if den * intersection >= num * union."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text")
    read = checkpoint(rows.mapInArrow(_read(words), "doc_id long, n long, v long, ranges binary, block int, counts binary"))
    told = read.filter("block IS NULL")
    blocks = read.filter("block IS NOT NULL").select("block", "counts").repartition(SKETCH_BLOCKS, "block").mapInArrow(_add_blocks, "block int, counts binary")
    sketch = np.zeros((SKETCH_BLOCKS, (1 << SKETCH_BITS) // SKETCH_BLOCKS), np.int64)
    for r in blocks.collect():  # of fixed size
        sketch[r["block"]] = np.frombuffer(zlib.decompress(r["counts"]), np.int64)
    packed = zlib.compress(sketch.tobytes(), 1)
    # A vertex for each set, and a document that has it.
    sets_of = checkpoint(told.filter("n > 0 AND doc_id IS NOT NULL").groupBy("v").agg(F.min("doc_id").alias("rep"), F.first("ranges").alias("ranges")))
    # Neither is ever null; said here, both uses of the table have one plan, so that it is made and shuffled once.
    found = rows.filter("doc_id IS NOT NULL").select("text").mapInArrow(_prefixes(words, num, den, packed), "token long, v long, n int, pos int").filter("token IS NOT NULL AND v IS NOT NULL").repartition("token").dropDuplicates(["token", "v", "n", "pos"])
    alive = checkpoint(found.join(found.groupBy("token").agg(F.count(F.lit(1)).alias("cnt")).filter("cnt > 1"), "token"))
    del found, blocks
    release(spark)

    rare = alive.filter(F.col("cnt") <= common)
    a, b = (rare.select("token", *(F.col(c).alias(f"{c}_{side}") for c in ("v", "n", "pos"))) for side in "ab")
    need = f"cast(ceil({num} * (n_a + n_b) / {num + den}) AS int)"
    pairs = (
        a.join(b, "token")
        .filter("v_a < v_b")
        .filter(f"{den} * least(n_a, n_b) >= {num} * greatest(n_a, n_b)")
        .filter(f"1 + least(n_a - pos_a - 1, n_b - pos_b - 1) >= {need}")
        .select("v_a", "v_b")
        .distinct()
    )
    for side in "ab":
        pairs = pairs.join(sets_of.select(F.col("v").alias(f"v_{side}"), F.col("ranges").alias(f"ranges_{side}")), f"v_{side}")
    pairs = checkpoint(pairs.select("v_a", "v_b", "ranges_a", "ranges_b").mapInArrow(_suffix_filter(num, den), "v_a long, v_b long"))
    hot = checkpoint(alive.filter(F.col("cnt") > common).select("token", "v", "cnt"))
    del alive, rare, a, b
    release(spark)

    needed = pairs.select(F.col("v_a").alias("v")).unionByName(pairs.select(F.col("v_b").alias("v"))).unionByName(hot.select("v")).distinct()
    wanted = needed.join(sets_of.select("v", "rep"), "v").withColumnRenamed("rep", "doc_id")
    sets = checkpoint(rows.join(wanted, "doc_id").select("v", "text").mapInArrow(_sets(words), "v long, set array<long>").dropDuplicates(["v"]))
    del needed, wanted
    release(spark)

    with_sets = pairs
    for side in "ab":
        with_sets = with_sets.join(sets.select(F.col("v").alias(f"v_{side}"), F.col("set").alias(f"set_{side}")), f"v_{side}")
    links = checkpoint(with_sets.select(F.col("v_a").alias("a"), F.col("v_b").alias("b"), "set_a", "set_b").mapInArrow(_verify(num, den), "a long, b long"))
    del with_sets, pairs
    release(spark)
    # The sets of a common shingle meet in chunks, drawn anew for each shingle.
    parts = hot.withColumn("parts", F.ceil(F.col("cnt") / chunk).cast("int")).withColumn("chunk", F.pmod(F.xxhash64("v", "token"), F.col("parts")).cast("int"))
    within = parts.select("token", "v", "chunk", F.col("chunk").alias("s"), F.col("chunk").alias("t"))
    meeting = checkpoint(_of(sets, within).groupBy("token", "s", "t").applyInArrow(_meet(num, den), "a long, b long"))
    joined = components(links.unionByName(meeting))
    many = checkpoint(parts.filter("parts > 1"))
    if not many.isEmpty():
        # Chunks of one shingle meet each other, a task for each pair of them, but only where its sets are not one class yet.
        label = many.join(joined, "v", "left").withColumn("label", F.coalesce("component", "v"))
        open_tokens = label.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("token")
        left = many.join(open_tokens, "token")
        dealt = left.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).filter("other <> chunk").select("token", "v", "chunk", F.least("chunk", "other").alias("s"), F.greatest("chunk", "other").alias("t"))
        across = checkpoint(_of(sets, dealt).groupBy("token", "s", "t").applyInArrow(_meet(num, den), "a long, b long"))
        if not across.isEmpty():
            joined = components(across.unionByName(joined.select(F.col("v").alias("a"), F.col("component").alias("b"))))
        del label, left, dealt, across
    del parts, within, meeting, many, sets, hot
    release(spark)

    # A class is named by the smallest document of its sets.
    member = sets_of.select("v", "rep").join(joined, "v")
    named = member.join(member.groupBy("component").agg(F.min("rep").alias("class")), "component").select("v", "class")
    classes = sets_of.select("v", "rep").join(named, "v", "left").select("v", F.coalesce("class", "rep").alias("class"))
    out = told.join(classes, "v", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("class", "doc_id")).alias("component_id"))
