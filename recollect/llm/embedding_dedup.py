"""Near-duplicate vectors by a subspace pigeonhole join.

Unit vectors with cosine c or more have a squared distance of at most 2 - 2c. A rotation (random signs, then a Hadamard
transform) spreads it evenly over the coordinates, which are cut into blocks: if two vectors are that near, then in one
block at least their squared distance is at most the block's share, in proportion to its width, of that budget. Each
block is range-joined by itself: a grid over the block's first coordinates, with cells as wide as the block's radius,
brings together vectors of the same and of neighbouring cells. What is within the block's budget is a candidate; the
cosine of candidates is computed in double precision from the vectors as given. A pair counts in the first block that
finds it, so no pair is ever written: a task returns, for each vector, its number of links there and the smallest
vector its links connect it with.

Grids get finer (more coordinates) as the table grows. Cells beyond `chunk` rows are cut into chunks, each pair of
chunks being a task of its own, so that no task holds more than two chunks. Equal vectors are one vector with a weight.

Rows: vectors that are null, empty, zero or hold null or non-finite components link with nothing, as do vectors of
different lengths with each other; each is its own component. Components are numbered in the type they come in, floats
or doubles, and compared in doubles. Rows of one id with unlike vectors are vectors of their own; a vector without an id
counts for none of the others. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint
from .graph import components

WIDTH = 8


def rotate(units: np.ndarray) -> np.ndarray:
    """Random signs and a normalised Hadamard transform, row by row with the same operations for any batch."""
    n, d = units.shape
    size = 1 << max(0, d - 1).bit_length()
    out = np.zeros((n, size))
    out[:, :d] = units * np.where(np.random.default_rng(d).random(d) < 0.5, -1.0, 1.0)
    half = 1
    while half < size:
        parts = out.reshape(n, size // (2 * half), 2, half)
        out = np.stack([parts[:, :, 0] + parts[:, :, 1], parts[:, :, 0] - parts[:, :, 1]], axis=2).reshape(n, size)
        half *= 2
    return out / math.sqrt(size)


def units_of(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    v /= np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


class Blocks:
    """Where the blocks of vectors of one length lie, and their radii."""

    def __init__(self, d: int, threshold: float, dims: int):
        self.size = 1 << max(0, d - 1).bit_length()
        self.bounds = [(lo, min(lo + WIDTH, self.size)) for lo in range(0, self.size, WIDTH)]
        self.budget = [(2 - 2 * threshold) * (hi - lo) / self.size + 1e-9 for lo, hi in self.bounds]
        self.dims = [min(dims, hi - lo) for lo, hi in self.bounds]

    def cells(self, rotated: np.ndarray, b: int) -> np.ndarray:
        lo = self.bounds[b][0]
        return np.floor(rotated[:, lo : lo + self.dims[b]] / math.sqrt(self.budget[b])).astype(np.int32)


def _ahead(dims: int) -> list[tuple[int, ...]]:
    """Steps to the neighbouring cells that come after a cell."""
    steps: list[tuple[int, ...]] = [()]
    for _ in range(dims):
        steps = [(*s, x) for s in steps for x in (-1, 0, 1)]
    return [s for s in steps if s > (0,) * dims]


def _name(d: int, b: int, cell: tuple[int, ...]) -> bytes:
    return struct.pack(f"<hh{len(cell)}h", d, b, *cell)


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, ids and vectors of a batch, by length."""
    keys = batch.column(0).to_numpy(zero_copy_only=False)
    lists = batch.column(1)
    sizes = np.diff(lists.offsets.to_numpy())
    values = lists.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        yield int(d), keys[rows], values[starts[rows, None] + np.arange(d)]


def _count_cells(threshold: float, dims: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            out: dict[bytes, int] = {}
            for d, _, vectors in _groups(batch):
                blocks, rotated = Blocks(d, threshold, dims), rotate(units_of(vectors))
                for b in range(len(blocks.bounds)):
                    for cell, n in zip(*np.unique(blocks.cells(rotated, b), axis=0, return_counts=True), strict=True):
                        out[key] = out.get(key := _name(d, b, tuple(map(int, cell))), 0) + int(n)
            yield pa.RecordBatch.from_arrays([pa.array(out.keys(), pa.binary()), pa.array(out.values(), pa.int64())], names=["cell", "n"])

    return run


def _deal(threshold: float, dims: int, chunks: dict[bytes, int], kind: str):
    """Sends each vector to the tasks in which it meets its cell and the neighbouring cells."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            weight = dict(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True))
            for d, keys, vectors in _groups(batch):
                blocks, rotated = Blocks(d, threshold, dims), rotate(units_of(vectors))
                mixed = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
                weights = np.array([weight[k] for k in keys.tolist()])
                for b in range(len(blocks.bounds)):
                    tasks: list[bytes] = []
                    rows: list[int] = []
                    left: list[bool] = []
                    cells = blocks.cells(rotated, b)
                    steps = _ahead(cells.shape[1])
                    for i, cell in enumerate(map(tuple, cells.tolist())):
                        name = _name(d, b, cell)
                        n = chunks.get(name, 1)
                        own = int(mixed[i]) % n
                        for t in range(n):
                            s, e = (own, t) if own <= t else (t, own)
                            tasks.append(name + name + struct.pack("<ii", s, e))
                            left.append(own == s)
                        rows += [i] * n
                        for step in steps:
                            for sign in (1, -1):
                                other = _name(d, b, tuple(c + sign * x for c, x in zip(cell, step, strict=True)))
                                m = chunks.get(other, 1)
                                for t in range(m):
                                    tasks.append(name + other + struct.pack("<ii", own, t) if sign == 1 else other + name + struct.pack("<ii", t, own))
                                left += [sign == 1] * m
                                rows += [i] * m
                    for lo in range(0, len(rows), 4096):
                        some = np.array(rows[lo : lo + 4096])
                        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * d), pa.array(vectors[some].reshape(-1).astype(kind)))
                        yield pa.RecordBatch.from_arrays([pa.array(tasks[lo : lo + 4096], pa.binary()), pa.array(np.full(len(some), b, np.int32)), pa.array(left[lo : lo + 4096]), pa.array(keys[some]), pa.array(weights[some], pa.int64()), lists], names=["task", "block", "is_left", "rep", "w", "v"])

    return run


def _meet(threshold: float, dims: int, tile: int = 1024):
    """Links within one task: for each vector, the weight of what it links with and a vector it is connected with."""

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        b = group["block"][0].as_py()
        keys, weights, is_left = (group[c].to_numpy() for c in ("rep", "w", "is_left"))
        vectors = group["v"].combine_chunks().flatten().to_numpy().reshape(len(keys), -1)
        task = group["task"][0].as_py()
        same = task[: (len(task) - 8) // 2] == task[(len(task) - 8) // 2 : -8] and task[-8:-4] == task[-4:]
        units = units_of(vectors)
        blocks = Blocks(vectors.shape[1], threshold, dims)
        rotated = rotate(units)
        lo, hi = blocks.bounds[b]
        own = rotated[:, lo:hi].astype(np.float32)
        norms = (own * own).sum(1)
        links, root = np.zeros(len(keys), np.int64), np.arange(len(keys))
        order = np.argsort(own[:, 0], kind="stable")
        lefts = order if same else order[is_left[order]]
        rights = order if same else order[~is_left[order]]
        radius = math.sqrt(blocks.budget[b]) + 1e-6

        def distance(p: np.ndarray, q: np.ndarray, k: int) -> np.ndarray:
            total = np.zeros(len(p))
            for c in range(*blocks.bounds[k]):
                gap = rotated[p, c] - rotated[q, c]
                total += gap * gap
            return total

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for at in range(0, len(lefts), tile):
            x = lefts[at : at + tile]
            first = np.searchsorted(own[rights, 0], own[x[0], 0] - radius)
            last = np.searchsorted(own[rights, 0], own[x[-1], 0] + radius, side="right")
            for to in range(max(first, at if same else 0), last, tile):
                y = rights[to : min(to + tile, last)]
                near = norms[x, None] + norms[y] - 2 * (own[x] @ own[y].T) <= blocks.budget[b] + 1e-5
                i, j = np.nonzero(near)
                if same:
                    up = i + at < j + to
                    i, j = i[up], j[up]
                # Candidates in bounded portions: the first block within whose budget they are, then the exact cosine.
                for k in range(0, len(i), 1 << 17):
                    p, q = x[i[k : k + (1 << 17)]], y[j[k : k + (1 << 17)]]
                    here = distance(p, q, b) <= blocks.budget[b]
                    p, q = p[here], q[here]
                    for earlier in range(b):
                        other = distance(p, q, earlier) > blocks.budget[earlier]
                        p, q = p[other], q[other]
                    linked = np.einsum("ij,ij->i", units[p], units[q]) >= threshold
                    p, q = p[linked], q[linked]
                    links += np.bincount(p, weights[q], len(keys)).astype(np.int64) + np.bincount(q, weights[p], len(keys)).astype(np.int64)
                    while len(p):  # joins the trees of linked vectors; a pair in one tree is done
                        rp, rq = root[p], root[q]
                        apart = rp != rq
                        if not apart.any():
                            break
                        p, q, rp, rq = p[apart], q[apart], rp[apart], rq[apart]
                        np.minimum.at(root, np.maximum(rp, rq), np.minimum(rp, rq))
                        while (root[root] != root).any():
                            root[:] = root[root]
        told = np.flatnonzero(links)
        return pa.table({"rep": keys[told], "links": links[told], "root": keys[root[told]]})

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, chunk: int = 32_768) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row."""
    good = F.expr("embedding IS NOT NULL AND size(embedding) > 0 AND NOT exists(embedding, x -> x IS NULL OR isnan(x) OR abs(x) = float('infinity')) AND exists(embedding, x -> x <> 0)")
    kind = "float" if vectors.schema["embedding"].dataType.elementType.simpleString() == "float" else "double"
    rows = vectors.select("vec_id", F.when(good, F.col("embedding")).cast(f"array<{kind}>").alias("embedding"))
    reps = checkpoint(rows.filter("embedding IS NOT NULL AND vec_id IS NOT NULL").groupBy("embedding").agg(F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("w")).select(F.monotonically_increasing_id().alias("rep"), "embedding", "w", "low"))
    n = reps.count()
    # Each further coordinate leaves about a quarter of the rows to a cell.
    dims = max(1, min(WIDTH, math.ceil(math.log(max(1, n / (4 * chunk)), 4))))
    cells = reps.select("rep", "embedding").mapInArrow(_count_cells(threshold, dims), "cell binary, n long").groupBy("cell").agg(F.sum("n").alias("n")).filter(F.col("n") > chunk)
    chunks = {bytes(r["cell"]): -(-r["n"] // chunk) for r in cells.collect()}  # at most rows * blocks / chunk of them
    dealt = reps.select("rep", "embedding", "w").mapInArrow(_deal(threshold, dims, chunks, {"float": "float32", "double": "float64"}[kind]), f"task binary, block int, is_left boolean, rep long, w long, v array<{kind}>")
    found = checkpoint(dealt.groupBy("task").applyInArrow(_meet(threshold, dims), "rep long, links long, root long"))
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    classes = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    # A class is named by the smallest id of its vectors.
    member = reps.select("rep", "low").join(classes.withColumnRenamed("v", "rep"), "rep", "left").select("rep", "low", F.coalesce("component", "rep").alias("class"))
    named = member.join(member.groupBy("class").agg(F.min("low").alias("c")), "class").select("rep", "c")
    table = reps.join(counts, "rep", "left").join(named, "rep")
    told = table.select("embedding", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n"), "c")
    out = rows.join(told, "embedding", "left")
    component = F.coalesce("c", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
