"""Document scores under a language model by online logistic context mixing, beside a word-frequency baseline.

A document is its words (lower-cased A-Z) and an end. Each token is coded by binary decisions along a prefix code: the
commonest words have paths of their own, any other word takes the path of an escape, one decision for "seen in training",
and 16 decisions for the leading bits of its hash; its count among the words with those bits settles the rest. A word that
training never had is spelled, letter by letter, by the two letters before.

Three predictors with hashed contexts give a probability for each decision: no context, the word before, the two words
before. A predictor's estimate is the counts of both outcomes among the tokens that followed the context, and the first
predictor's probability as so many counts more. A logistic mixer, whose weights are gated by how sure the predictors with
a context are, combines them, and an adaptive map from mixed to observed probability refines the result. Mixer and map belong to the document: they
start from common values and learn online, sixteen tokens by sixteen tokens, from what has been coded, so that a document
costs what a decoder could follow. The sum of the decisions' logarithms is the document's log10 probability; divided
by its bytes it gives bits per byte.

The statistics are those of all training texts, and no table of contexts is in one place: documents are dealt to blocks
of bounded size; each block tells its distinct (context, token) pairs and their counts to the parts of the statistics,
which are dealt by context; each part adds up and answers each block for the pairs it told. Blocks and parts grow in
number with the texts, not in size. Contexts are hashes with 25 bits within a part: a part holds about a million contexts,
of which some three in a hundred share their hash with another. Words are their 64-bit hashes; words of one hash are one.

The baseline adds one to the count of each token. What goes to every worker is of fixed size: the hashes and counts of
the commonest words (`common` at the most), 65,536 sums, and the counts of three letters in a row, of which there are no
more than 2^24.

Rows: null text is the empty text, a document of the end token alone; a null id counts as the empty text when documents
are dealt to training; repeated rows are scored each by itself; if nothing is for training, counts are zero and the
predictors know nothing. An empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches, checkpoint, partitions_for, release

#: Bits of a word's hash that are coded as decisions, of a token's number, of a context within a part, and of a code.
RARE_BITS, ID_BITS, CONTEXT_BITS, CODE_BITS = 16, 18, 25, 56
RARE = 1 << RARE_BITS
#: Log-odds are told in whole steps of one over this, and lie within 10 of zero.
SCALE = 12.7
#: Steps that a difference of 1.7 from the first predictor's log-odds is told in.
FINE = 6.0
#: Counts that the first predictor's probability stands for, beside a context of one word and of two.
PRIOR = (3.0, 0.5)
#: Counts that make a context of one word, and of two, worth hearing; where a node has fewer, the first predictor's stand.
ENOUGH = (6, 1)
#: No decision is held more certain than these log-odds; buckets of a half each.
#: Mixer and map learn after so many tokens, from a text's beginning to its end.
WINDOW = 16
#: Weights of the predictors at a text's beginning, by gate: how sure one word before is, then how sure two words before are.
SURE = (1.0, 3.0)
GATES = (len(SURE) + 1) ** 2
START_WEIGHTS = np.tile(np.array([[0.35, 0.35, 0.3]], np.float32), (GATES, 1))
MOST, BUCKETS = 7.99, 16
LETTER_PRIOR = 4.0


SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
_STEP = 0x9E3779B97F4A7C15


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number, and of its inverse, modulo 2^64."""
    out = []
    for x in (_STEP, pow(_STEP, -1, 1 << 64)):
        p = np.full(n + 1, x, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


POWERS = _powers(1 << 20)


def hash_spans(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, spans being in order and apart; the empty span's is that of END."""
    out = np.empty(len(begin), np.uint64)
    i = 0
    while i < len(begin):  # some spans at a time, as many as the powers reach, or one that is longer
        j = max(i + 1, int(np.searchsorted(end, begin[i] + (1 << 20), side="right")))
        lo, hi = int(begin[i]), int(end[j - 1])
        power, undo = POWERS if hi - lo <= 1 << 20 else _powers(hi - lo)
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum((data[lo:hi] + np.uint64(1)) * power[: hi - lo], out=total[1:])
        out[i:j] = (total[end[i:j] - lo] - total[begin[i:j] - lo]) * undo[begin[i:j] - lo]
        i = j
    return _mixed(out + (end - begin).astype(np.uint64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class Texts:
    """Texts as one array of bytes, lower-cased, and where their words begin and end."""

    def __init__(self, texts: list[str | None]):
        raw = [t.encode().lower() if t else b"" for t in texts]
        self.data = np.frombuffer(b" ".join([b"", *raw, b""]), np.uint8)
        space = SPACES[self.data]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        self.begin, self.end = edge[::2], edge[1::2]
        close = np.cumsum([len(r) + 1 for r in raw])  # where each text ends
        self.n_words = np.diff(np.searchsorted(self.begin, close), prepend=0)
        told = np.concatenate([[0], np.cumsum(self.end - self.begin)])[np.cumsum(self.n_words)]
        self.n_bytes = np.diff(told, prepend=0) + self.n_words + 1
        self.hashes = hash_spans(self.data, self.begin, self.end)

    def words(self, which: np.ndarray) -> list[bytes]:
        raw = self.data.tobytes()
        return [raw[a:b] for a, b in zip(self.begin[which].tolist(), self.end[which].tolist(), strict=True)]


END = _mixed(np.zeros(1, np.uint64))[0]


def pack(values: np.ndarray) -> bytes:
    """Integers, compressed byte plane by byte plane."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(raw: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, len(planes) // np.dtype(kind).itemsize).T).view(kind).ravel()


def steps(values: np.ndarray) -> np.ndarray:
    """Rising integers as the first one and the steps between them."""
    return np.diff(values, prepend=np.uint64(0))


def tally(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each value once, rising, and how often it occurs."""
    values = np.sort(values)
    new = np.flatnonzero(np.diff(values, prepend=~values[:1]) != 0)
    return values[new], np.diff(new, append=len(values))


def pack_pairs(keys: np.ndarray) -> tuple[bytes, bytes]:
    """Rising pairs as the steps between contexts, and tokens' numbers as they are: common tokens have small ones."""
    return pack(steps(keys >> np.uint64(ID_BITS))), pack((keys & np.uint64((1 << ID_BITS) - 1)).astype(np.uint32))


def unpack_pairs(contexts: bytes, numbers: bytes) -> np.ndarray:
    return np.cumsum(unpack(contexts, np.uint64), dtype=np.uint64) << np.uint64(ID_BITS) | unpack(numbers, np.uint32)


def add_up(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, rising, with the sum of its counts."""
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    new = np.flatnonzero(np.diff(keys, prepend=~keys[:1]) != 0)
    return keys[new], np.add.reduceat(counts, new) if len(new) else counts


def spread(length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs of these lengths laid end to end: where each begins, and each element's place in its run."""
    begin = np.cumsum(length, dtype=np.int64) - length
    return begin, np.arange(int(length.sum()), dtype=np.int32) - np.repeat(begin.astype(np.int32), length)


def huffman(weights: list[float]) -> np.ndarray:
    """Lengths of the words of a prefix code for these weights."""
    heap = [(w, i) for i, w in enumerate(weights)]
    heapq.heapify(heap)
    above = [0] * (2 * len(weights) - 1)
    made = len(weights)
    while len(heap) > 1:
        a, i = heapq.heappop(heap)
        b, j = heap[0]
        above[i] = above[j] = made
        heapq.heapreplace(heap, (a + b, made))
        made += 1
    depth = np.zeros(made, np.int64)
    for i in range(made - 2, -1, -1):
        depth[i] = depth[above[i]] + 1
    return depth[: len(weights)]


class Code:
    """The decisions of each token, and the first predictor's log-odds for them.

    Tokens are numbered by their place in the code: tokens with a common beginning of their paths are neighbours.
    """

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, rare: np.ndarray, once: int, letters: tuple[np.ndarray, np.ndarray]):
        every = float(counts.sum() + rare.sum() + once)
        depth = huffman([max(float(c), every / 2**21) for c in [*counts.tolist(), rare.sum() + once + 0.5]])
        order = np.argsort(depth, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.unseen = int(place[-1])
        number = place[:-1] + RARE * (place[:-1] > self.unseen)
        self._keep(hashes, number.astype(np.int32), counts)
        total = len(order) + RARE
        self.length = np.zeros(total, np.int32)
        weight = np.zeros(total)
        self.length[number], weight[number] = depth[:-1], counts
        self.escape = int(depth[-1])
        self.length[self.unseen], weight[self.unseen] = self.escape + 1, once + 0.5
        classes = slice(self.unseen + 1, self.unseen + 1 + RARE)
        self.length[classes], weight[classes] = self.escape + 1 + RARE_BITS, rare
        self.rare = rare
        width = np.left_shift(np.uint64(1), (CODE_BITS - self.length).astype(np.uint64))
        self.left = np.cumsum(width, dtype=np.uint64) - width
        self.begin = np.cumsum(self.length, dtype=np.int32) - self.length
        self.base = self._base(weight)
        self.letters, self.letter_counts = letters
        pairs = (self.letters & 0xFFFF).astype(np.int64)
        self.pair_counts = np.bincount(pairs, self.letter_counts, 1 << 16)
        self.context_counts = self.pair_counts.reshape(256, 256).sum(1)
        alone = self.pair_counts.reshape(256, 256).sum(0)
        self.letter = (alone + 1) / (alone.sum() + 256)

    def _base(self, weight: np.ndarray) -> np.ndarray:
        base = np.zeros(int(self.length.sum()), np.int8)
        above = np.full(len(weight), weight.sum())
        for d in range(int(self.length.max())):
            starts = np.flatnonzero(np.diff(self.left >> np.uint64(CODE_BITS - 1 - d), prepend=np.uint64(1 << 63)))
            below = np.repeat(np.add.reduceat(weight, starts), np.diff(starts, append=len(weight)))
            here = self.length > d
            odds = np.log((below[here] + 0.1) / (above[here] - below[here] + 0.1))
            base[self.begin[here] + d] = np.rint(np.clip(odds, -10, 10) * SCALE)
            above = below
        return base

    def _keep(self, hashes: np.ndarray, number: np.ndarray, counts: np.ndarray) -> None:
        """Words by hash: a place is that of the hash's last bits or one of the next free ones."""
        bits = max(4, (4 * len(hashes)).bit_length())
        self.slots, self.mask = np.full(1 << bits, -1, np.int32), np.uint64((1 << bits) - 1)
        self.hashes, self.number, self.counts = hashes, number, counts
        left, place = np.arange(len(hashes), dtype=np.int32), hashes & self.mask
        while len(left):
            free = self.slots[place] < 0
            self.slots[place[free]] = left[free]
            stay = self.slots[place] != left
            left, place = left[stay], (place[stay] + np.uint64(1)) & self.mask

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of each word, and its count; -1 where the word has no path of its own, and the number its bits have."""
        number = self.unseen + 1 + (hashes >> np.uint64(64 - RARE_BITS)).astype(np.int32)
        count = np.full(len(hashes), -1, np.int64)
        left, place = np.arange(len(hashes)), hashes & self.mask
        while len(left):
            word = self.slots[place]
            there = word >= 0
            left, place, word = left[there], place[there], word[there]
            own = self.hashes[word] == hashes[left]
            number[left[own]], count[left[own]] = self.number[word[own]], self.counts[word[own]]
            left, place = left[~own], (place[~own] + np.uint64(1)) & self.mask
        return number, count

    def spell(self, words: list[bytes]) -> np.ndarray:
        """Natural-log probability of each word's letters and their end."""
        size = np.array([len(w) + 1 for w in words])
        data = np.frombuffer(b"".join(b"  " + w + b" " for w in words), np.uint8).astype(np.uint32)
        begin, within = spread(size)
        at = np.repeat(np.cumsum(size + 2) - size, size) + within
        pair = data[at - 1] << 8 | data[at]
        code = data[at - 2] << 16 | pair
        where = np.minimum(np.searchsorted(self.letters, code), max(0, len(self.letters) - 1))
        seen = np.where(self.letters[where] == code, self.letter_counts[where], 0) if len(self.letters) else 0
        p = (self.pair_counts[pair] + LETTER_PRIOR * self.letter[data[at]]) / (self.context_counts[data[at - 1]] + LETTER_PRIOR)
        p = (seen + LETTER_PRIOR * p) / (self.pair_counts[data[at - 2] << 8 | data[at - 1]] + LETTER_PRIOR)
        return np.add.reduceat(np.log(np.minimum(p, 1)), begin)


def letter_codes(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Three bytes in a row, as one integer, with their counts; a word stands between spaces, and a text's end is a word without letters."""
    data = np.where(SPACES[texts.data], np.uint8(0x20), texts.data).astype(np.uint32)
    before = np.roll(data, 1)
    last = np.where(before == 0x20, np.uint32(0x20), np.roll(data, 2))
    codes = last << 16 | before << 8 | data
    keep = np.zeros(len(data), bool)
    keep[1:] = (data[1:] != 0x20) | (data[:-1] != 0x20)
    codes, counts = tally(codes[keep])
    end = 0x20 << 16 | 0x20 << 8 | 0x20
    return add_up(np.append(codes, np.uint32(end)), np.append(counts, len(texts.n_words)))


def context_bits(parts: int) -> int:
    return min(CONTEXT_BITS + (parts - 1).bit_length(), 63 - ID_BITS)


class Block:
    """Some documents' tokens, and their distinct (context, token) pairs and words without a path, both by part."""

    def __init__(self, texts: Texts, code: Code, parts: int):
        self.texts = texts
        self.size = texts.n_words + 1
        self.begin = np.cumsum(self.size) - self.size
        n = int(self.size.sum())
        is_word = np.ones(n, bool)
        is_word[self.begin + texts.n_words] = False
        hashes = np.full(n, END, np.uint64)
        hashes[is_word] = texts.hashes
        self.number, self.count = code.find(hashes)
        before = np.zeros((2, n), np.uint64)
        for k in (1, 2):
            before[k - 1, k:] = hashes[:-k] if n > k else 0
            for first in range(k):  # a document's beginning stands for the words before it
                before[k - 1, (self.begin + first)[self.size > first]] = 0
        one = _mixed(before[0] + np.uint64(0x9E3779B97F4A7C15))
        two = _mixed(one ^ (before[1] * np.uint64(0xD6E8FEB86659FD93)))
        bits = context_bits(parts)
        keys = np.concatenate([(c >> np.uint64(64 - bits)) << np.uint64(1) | np.uint64(tag) for tag, c in enumerate((one, two))])
        keys = keys << np.uint64(ID_BITS) | np.concatenate([self.number, self.number]).astype(np.uint64)
        del before, one, two
        order = np.argsort(keys)
        keys = keys[order]
        new = np.diff(keys, prepend=~keys[:1]) != 0
        pair = np.empty(len(keys), np.int32)
        pair[order] = np.cumsum(new, dtype=np.int32) - 1
        self.pair = pair.reshape(2, n)
        self.keys = keys[new]
        part = ((self.keys >> np.uint64(ID_BITS + 1)) * np.uint64(parts)) >> np.uint64(bits)
        self.cuts = np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))
        self.other = np.flatnonzero(self.count < 0)
        self.words, self.word_at = np.unique(hashes[self.other], return_inverse=True)
        part = ((self.words >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        self.word_cuts = np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))

    def spelling(self, tokens: np.ndarray) -> list[bytes]:
        """The letters of these tokens; an end has none."""
        doc = np.searchsorted(self.begin, tokens, side="right") - 1
        word = tokens - self.begin[doc] < self.size[doc] - 1
        found = iter(self.texts.words((tokens - doc)[word]))
        return [next(found) if w else b"" for w in word]

    def counts(self, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often each pair, and each word without a path, occurs in the documents for training."""
        here = np.repeat(train, self.size)
        pairs = sum(np.bincount(p[here], minlength=len(self.keys)) for p in self.pair)
        return pairs, np.bincount(self.word_at[here[self.other]], minlength=len(self.words))


CHANCE = 1 / (1 + np.exp(np.arange(-128, 128) / -SCALE))


def narrowed(odds: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Log-odds as their difference from the first predictor's, in steps that grow with the difference."""
    apart = np.clip(odds, -10, 10) - first / SCALE
    return np.rint(np.copysign(FINE * np.log1p(np.abs(apart)), apart)).astype(np.int8)


def widened(told: np.ndarray, first: np.ndarray) -> np.ndarray:
    told = told.astype(np.float64)
    apart = np.copysign(np.expm1(np.abs(told) / FINE), told)
    return np.clip(np.rint(first + apart * SCALE), -127, 127).astype(np.int8)


def favours(code: Code, keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rising pairs: down to which decision the context has other tokens, and how much it favours the token's decisions down to there."""
    number = (keys & np.uint64((1 << ID_BITS) - 1)).astype(np.int32)
    left = code.left[number]
    shared = np.full(len(keys) + 1, -1, np.int32)
    apart = left[1:] ^ left[:-1]
    same = (keys[1:] >> np.uint64(ID_BITS)) == (keys[:-1] >> np.uint64(ID_BITS))
    shared[1:-1] = np.where(same, CODE_BITS - np.frexp(apart.astype(np.float64))[1], -1)
    depth = np.maximum(shared[1:], shared[:-1]) + 1
    at = np.flatnonzero(depth)
    n, common, deep = counts[at].astype(np.float64), shared[:-1][at], depth[at]
    tag = (keys[at] >> np.uint64(ID_BITS)).astype(np.int32) & 1
    base, to = code.begin[number[at]], at.astype(np.int32)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    d = 0
    while len(n):
        starts = np.flatnonzero(common < d)
        node = np.repeat(np.add.reduceat(n, starts), np.diff(starts, append=len(n)))
        stay = (deep > d) & (node >= np.array(ENOUGH)[tag])
        depth[to[~stay]] = d
        if not stay.all():
            n, common, deep, tag, base, to, node = (x[stay] for x in (n, common, deep, tag, base, to, node))
        if not len(n):
            break
        starts = np.flatnonzero(common < d + 1)
        child = np.repeat(np.add.reduceat(n, starts), np.diff(starts, append=len(n)))
        first = code.base[base + d]
        prior = np.array(PRIOR)[tag]
        p = prior * CHANCE[first.astype(np.int32) + 128]
        odds = np.log((child + p) / (node - child + prior - p))
        found.append((to, narrowed(odds, first)))
        d += 1
    begin = np.cumsum(depth, dtype=np.int64) - depth
    out = np.empty(int(depth.sum()), np.int8)
    for d, (to, odds) in enumerate(found):
        out[begin[to] + d] = odds
    return depth.astype(np.uint8), out


def alone_table() -> np.ndarray:
    """By predictor, count (up to 255) and the first predictor's log-odds: log-odds where the context has no other token."""
    odds = [np.log((np.arange(256)[:, None] + s * CHANCE) / (s * (1 - CHANCE))) for s in PRIOR]
    return np.rint(np.clip(odds, -10, 10) * SCALE).astype(np.int8)


def answer(code: Code, keys: list[np.ndarray], counts: list[np.ndarray], at_once: int = 500_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each block's pairs: count, depth and log-odds by the sums of all blocks."""
    pairs, at = np.unique(np.concatenate(keys), return_inverse=True)
    at = at.astype(np.int32)
    seen = np.bincount(at, np.concatenate(counts), len(pairs))
    # Slices end where contexts end.
    first = np.flatnonzero(np.diff(pairs >> np.uint64(ID_BITS), prepend=~pairs[:1]) != 0)
    cuts = [*first[np.unique(np.searchsorted(first, np.arange(0, len(pairs), at_once)).clip(max=max(0, len(first) - 1)))].tolist(), len(pairs)]
    told = [favours(code, pairs[lo:hi], seen[lo:hi]) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]
    depth, odds = (np.concatenate(x) if x else np.zeros(0, np.int8) for x in (list(zip(*told, strict=True)) or ((), ())))
    del told
    begin = np.cumsum(depth, dtype=np.int32) - depth
    tag = (pairs >> np.uint64(ID_BITS)).astype(np.uint8) & 1
    short = np.where(seen >= np.array(ENOUGH)[tag], np.minimum(seen, 255), 0).astype(np.uint8)
    del pairs, seen, tag
    for own in np.split(at, np.cumsum([len(k) for k in keys])[:-1]):
        length = depth[own].astype(np.int32)
        _, within = spread(length)
        within += np.repeat(begin[own], length)
        yield short[own], depth[own], odds[within]


ALONE = alone_table().reshape(-1)
WIDENED = np.array([widened(np.full(256, x, np.int8), np.arange(-128, 128)) for x in range(-128, 128)]).reshape(-1)


class Scorer:
    """Scores the documents of a block, given the answers for its pairs and the counts of its words without a path."""

    def __init__(self, code: Code, block: Block, told: tuple[np.ndarray, np.ndarray, np.ndarray], totals: np.ndarray, rate: float = 0.1, map_prior: float = 64.0):
        self.code, self.block, self.rate = code, block, rate
        seen, depth, self.odds = told
        self.row = ((block.keys >> np.uint64(ID_BITS) & np.uint64(1)).astype(np.int64) * 256 + seen) * 256
        self.depth = depth.astype(np.int64)
        self.odds_at = np.cumsum(self.depth) - self.depth
        # Of words without a path: what is left when the decisions are coded; unseen ones leave the path at the escape.
        count = block.count.copy()
        count[block.other] = totals[block.word_at]
        self.known = count
        self.unseen = count == 0
        self.rest = np.zeros(len(count))
        rare = block.other[count[block.other] > 0]
        classes = code.rare[block.number[rare] - code.unseen - 1]
        self.rest[rare] = np.log(count[rare] / np.maximum(classes, count[rare]))
        never = np.flatnonzero(self.unseen)
        if len(never):
            words = block.spelling(never)
            number = {w: i for i, w in enumerate(dict.fromkeys(words))}
            self.rest[never] = code.spell(list(number))[[number[w] for w in words]]
        middle = (np.arange(BUCKETS) + 0.5) / 2
        self.map = (map_prior * np.array([1 / (1 + np.exp(-middle)), np.ones(BUCKETS)])).astype(np.float32)

    def _answered(self, pair: np.ndarray, begin: np.ndarray, length: np.ndarray, base: np.ndarray) -> np.ndarray:
        """Log-odds for each decision of tokens with these pairs."""
        at = np.repeat(self.row[pair], length)
        at += base
        out = ALONE[at]
        depth = np.minimum(self.depth[pair], length)
        before = np.cumsum(depth) - depth
        place, source = np.repeat(begin - before, depth), np.repeat(self.odds_at[pair] - before, depth)
        steps_on = np.arange(len(place))
        place += steps_on
        source += steps_on
        np.copyto(steps_on, self.odds[source])
        steps_on += 128
        steps_on <<= 8
        steps_on += base[place]
        out[place] = WIDENED[steps_on]
        return out

    def group(self, docs: np.ndarray) -> np.ndarray:
        """Natural-log probability of each document's decisions; documents come longest first."""
        block, code = self.block, self.code
        # Tokens by window, then by document: what is learned from a window serves the next one.
        size = block.size[docs]
        _, within = spread(size)
        doc = np.repeat(np.arange(len(docs)), size)
        window = within // WINDOW
        token = np.repeat(block.begin[docs], size) + within
        if size[0] > WINDOW:
            order = np.argsort(window, kind="stable")
            doc, token, window = doc[order], token[order], window[order]
        number = block.number[token]
        length = code.length[number].astype(np.int64)
        left = self.unseen[token]
        length[left] = code.escape + 1
        begin = np.cumsum(length) - length
        at = np.repeat(code.begin[number] - begin, length)
        at += np.arange(len(at))
        base = code.base[at]
        middle = base.view(np.uint8) ^ np.uint8(128)
        del at
        doc = np.repeat(doc, length)
        gate = doc * GATES
        x, last = [], (begin + length - 1)[left]
        for k, found in enumerate((base, *(self._answered(p[token], begin, length, middle) for p in block.pair))):
            if k:
                sure = np.abs(found)
                level = sum((sure > round(limit * SCALE)).view(np.int8) for limit in SURE)
                gate += level * np.int8(len(SURE) + 1 if k == 1 else 1)
            x.append(found.astype(np.float32))
            x[-1] *= np.float32(1 / SCALE)
            x[-1][last] *= -1  # for the words that training never had, the other outcome
        cells = doc * BUCKETS
        starts = np.flatnonzero(np.diff(window, prepend=-1))
        cuts = np.append(begin[starts], len(doc)).tolist()
        weights = np.tile(START_WEIGHTS, (len(docs), 1)).T.copy()
        maps = np.tile(self.map, len(docs))
        told = np.empty(len(doc), np.float32)
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            live = int(doc[hi - 1]) + 1
            self._window(gate[lo:hi], cells[lo:hi], [v[lo:hi] for v in x], weights[:, : live * GATES], maps[:, : live * BUCKETS], told[lo:hi])
        return np.bincount(doc, np.log(told), len(docs))

    def _window(self, gate, cells, x, weights, maps, told) -> None:
        z = weights[0][gate]
        z *= x[0]
        z += weights[1][gate] * x[1]
        z += weights[2][gate] * x[2]
        np.clip(z, -MOST, MOST, out=z)
        error = np.exp(z)
        error += 1
        np.reciprocal(error, out=error)  # one less the probability of what came true
        # The map tells how often the likelier outcome comes true, by how sure the mixer is of it, as a quarter of what is over one half.
        np.sign(z, out=told)
        came = told.astype(np.int64)
        z *= told
        z *= 2
        cell = z.astype(np.int64)
        cell += cells
        told *= (0.25 * maps[0] / maps[1] - 0.125)[cell]
        told += 0.875
        told -= 0.75 * error
        # Learning, after the window is coded.
        size = weights.shape[1]
        scale = self.rate / np.sqrt(np.maximum(np.bincount(gate, minlength=size), 1))
        for k in range(3):
            weights[k] += scale * np.bincount(gate, error * x[k], size)
        cell *= 3
        cell += came
        came = np.bincount(cell + 1, minlength=3 * maps.shape[1]).reshape(-1, 3)  # wrong, undecided, right
        maps[0] += came[:, 2]
        maps[1] += came[:, 0]
        maps[1] += came[:, 2]

    def scores(self, budget: int = 60_000) -> np.ndarray:
        """Log10 probabilities; documents are taken together up to so many tokens, of like length."""
        size = self.block.size
        out = np.add.reduceat(self.rest, self.block.begin) if len(size) else np.zeros(0)
        order = np.argsort(-size, kind="stable")
        bound = np.cumsum(size[order]) // budget
        for docs in np.split(order, np.flatnonzero(np.diff(bound)) + 1):
            if len(docs):
                out[docs] += self.group(docs)
        return out / math.log(10)

    def baseline(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each document: tokens that training has, and the sum of log10(count + 1)."""
        begin = self.block.begin
        return np.add.reduceat((self.known > 0).astype(np.int64), begin), np.add.reduceat(np.log10(self.known + 1), begin)


#: Among the parts of words (from 0) and letters (from -256), the one that tells how many characters there are.
SIZE = -257


def _count(parts: int, at_once: int = 2_000_000):
    """Words and letters of one partition's texts: hashes by part, then codes of three letters by their first bits."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: list[tuple[np.ndarray, np.ndarray]] = []
        letters: list[tuple[np.ndarray, np.ndarray]] = []

        def out(part: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            there, first = np.unique(part, return_index=True)
            spans = list(zip(first, [*first[1:], len(part)], strict=True))
            return pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array([pack(steps(keys[lo:hi])) for lo, hi in spans], pa.binary()), pa.array([pack(counts[lo:hi]) for lo, hi in spans], pa.binary())], names=["part", "keys", "counts"])

        def joined(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            return add_up(*(np.concatenate(x) for x in zip(*found, strict=True)))

        def flush() -> pa.RecordBatch:
            keys, counts = joined(words)
            words.clear()
            return out(((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64), keys, counts)

        size = 0
        for told, train in batches(rows, "text", "train"):
            size += sum(len(t) for t in told if t)
            told = [t for t, x in zip(told, train, strict=True) if x]
            for lo, hi in spans_of(told):
                texts = Texts(told[lo:hi])
                words.append(tally(np.append(texts.hashes, np.full(hi - lo, END))))
                letters.append(letter_codes(texts))
                if len(letters) > 8:
                    letters[:] = [joined(letters)]
                if len(words) > 8:
                    words[:] = [joined(words)]
                    if len(words[0][0]) > at_once:
                        yield flush()
        if words:
            yield flush()
        if letters:
            codes, counts = joined(letters)
            yield out((codes >> 16).astype(np.int64) - 256, codes.astype(np.uint64), counts)
        yield out(np.array([SIZE]), np.zeros(1, np.uint64), np.array([size]))

    return run


def spans_of(texts: list[str | None], characters: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of texts of together about so many characters."""
    if not texts:
        return
    ends = np.cumsum([len(t) if t else 0 for t in texts])
    cuts = np.flatnonzero(np.diff(ends // characters)) + 1
    yield from zip([0, *cuts.tolist()], [*cuts.tolist(), len(texts)], strict=True)


def bucket_of(counts: np.ndarray) -> np.ndarray:
    return np.floor(8 * np.log2(counts) + 1e-9).astype(np.int64)


def _sum(rows: pa.Table) -> pa.Table:
    """One part's keys, each once: the table, and how many keys have counts of about that size."""
    keys, counts = add_up(np.concatenate([np.cumsum(unpack(k, np.uint64), dtype=np.uint64) for k in rows["keys"].to_pylist()]), np.concatenate([unpack(c, np.int64) for c in rows["counts"].to_pylist()]))
    sizes = np.bincount(bucket_of(counts[counts > 0]), minlength=1)
    there = np.flatnonzero(sizes)
    shape = pa.array([list(zip(there.tolist(), sizes[there].tolist(), strict=True))], pa.list_(pa.struct([("bucket", pa.int64()), ("words", pa.int64())])))
    return pa.table({"part": rows["part"].slice(0, 1), "keys": pa.array([pack(steps(keys))], pa.binary()), "counts": pa.array([pack(counts)], pa.binary()), "total": pa.array([int(counts.sum())]), "shape": shape})


def _pick(least: int):
    """Words in the upper buckets by hash, and the other words' counts by the leading bits of the hash."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, counts in batches(rows, "keys", "counts"):
            for k, c in zip(keys, counts, strict=True):
                h, c = np.cumsum(unpack(k, np.uint64), dtype=np.uint64), unpack(c, np.int64)
                top = bucket_of(c) >= least
                bits, sums = add_up(h[~top] >> np.uint64(64 - RARE_BITS), c[~top])
                which = np.repeat([True, False], [int(top.sum()), len(bits)])
                yield pa.RecordBatch.from_arrays([pa.array(which), pa.array(np.concatenate([h[top], bits]).view(np.int64)), pa.array(np.concatenate([c[top], sums]))], names=["top", "key", "n"])

    return run


def fit(docs: DataFrame, parts: int, common: int = 1 << 17) -> tuple[Code, int, int, int]:
    """The code of the tokens of the rows for training, how many tokens these have, how many distinct ones, and the characters of all rows.

    Only the code's parts go to the driver: `common` hashes, 2^16 sums, the letters, and some hundred buckets of counts.
    """
    if common + RARE >= 1 << ID_BITS:
        raise ValueError("common is too large")
    counted = docs.select("text", "train").mapInArrow(_count(parts), "part int, keys binary, counts binary")
    sums = checkpoint(counted.groupBy("part").applyInArrow(_sum, "part int, keys binary, counts binary, total long, shape array<struct<bucket: long, words: long>>"))
    words = sums.filter("part >= 0")
    total, size = sums.agg(*(F.coalesce(F.sum(F.when(F.expr(which), F.col("total"))), F.lit(0)) for which in ("part >= 0", f"part = {SIZE}"))).first()
    shape = words.select(F.inline("shape")).groupBy("bucket").agg(F.sum("words").alias("n")).orderBy("bucket").collect()
    distinct, once = sum(r["n"] for r in shape), next((r["n"] for r in shape if r["bucket"] == 0), 0)
    least, kept = 0, distinct
    for r in shape:
        if kept <= common:
            break
        kept, least = kept - r["n"], r["bucket"] + 1
    picked = words.select("keys", "counts").mapInArrow(_pick(least), "top boolean, key long, n long").groupBy("top", "key").agg(F.sum("n").alias("n")).toPandas()
    top, rest = picked[picked["top"].astype(bool)], picked[~picked["top"].astype(bool)]
    rare = np.zeros(RARE)
    rare[rest["key"].to_numpy(np.int64)] = rest["n"]
    letters, n = np.zeros(0, np.uint32), np.zeros(0, np.int64)
    for r in sums.filter(f"part < 0 AND part <> {SIZE}").select("keys", "counts").collect():
        letters = np.append(letters, np.cumsum(unpack(r["keys"], np.uint64), dtype=np.uint64).astype(np.uint32))
        n = np.append(n, unpack(r["counts"], np.int64))
    order = np.argsort(letters)
    return Code(top["key"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64), rare, once, (letters[order], n[order])), total, distinct, size


def _deal(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A batch's rows by block, those of a block compressed together."""
    options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))
    for batch in rows:
        if not batch.num_rows:
            continue
        block = batch.column(batch.schema.get_field_index("block")).to_numpy()
        order = np.argsort(block, kind="stable")
        there, first = np.unique(block[order], return_index=True)
        out = []
        for lo, hi in zip(first, [*first[1:], len(order)], strict=True):
            sink = pa.BufferOutputStream()
            own = batch.select(["doc_id", "text", "train"]).take(pa.array(order[lo:hi]))
            with pa.ipc.new_stream(sink, own.schema, options=options) as writer:
                writer.write_batch(own)
            out.append(sink.getvalue().to_pybytes())
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(out, pa.binary())], names=["block", "rows"])


def _dealt(group: pa.Table) -> pa.Table:
    return pa.concat_tables(pa.ipc.open_stream(raw).read_all() for raw in group["rows"].to_pylist())


def _ask(model, parts: int):
    """A block's pairs, and its words without a path, with their counts in its training rows: a row for each part."""

    def run(group: pa.Table) -> pa.Table:
        rows, number = _dealt(group), group["block"][0].as_py()
        block = Block(Texts(rows["text"].to_pylist()), model.value, parts)
        pairs, words = (c.astype(np.uint32) for c in block.counts(np.array(rows["train"].to_pylist(), bool)))
        out = []
        for p in range(parts):
            (a, b), (c, d) = block.cuts[p : p + 2], block.word_cuts[p : p + 2]
            if a < b or c < d:
                out.append((number, p, *pack_pairs(block.keys[a:b]), pack(pairs[a:b]), pack(steps(block.words[c:d])), pack(words[c:d])))
        kinds = (pa.int32(), pa.int32(), *[pa.binary()] * 5)
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["block", "part", "contexts", "numbers", "counts", "words", "word_counts"])

    return run


def _answer(model):
    def run(rows: pa.Table) -> pa.Table:
        keys = [unpack_pairs(*x) for x in zip(rows["contexts"].to_pylist(), rows["numbers"].to_pylist(), strict=True)]
        words = [np.cumsum(unpack(k, np.uint64), dtype=np.uint64) for k in rows["words"].to_pylist()]
        counts, word_counts = ([unpack(k, np.uint32) for k in rows[c].to_pylist()] for c in ("counts", "word_counts"))
        told = [[pack(x) for x in t] for t in answer(model.value, keys, counts)]
        distinct, at = np.unique(np.concatenate(words), return_inverse=True)
        totals = np.bincount(at, np.concatenate(word_counts), len(distinct)).astype(np.int64)
        own = [pack(totals[x]) for x in np.split(at, np.cumsum([len(w) for w in words])[:-1])]
        columns = [pa.array(c, pa.binary()) for c in (*zip(*told, strict=True), own)]
        return pa.Table.from_arrays([rows["block"].combine_chunks(), rows["part"].combine_chunks(), *columns], names=["block", "part", "seen", "depth", "odds", "totals"])

    return run


def score_documents(docs: DataFrame, trainable: Column, common: int = 1 << 17, block_bytes: int = 10_000_000) -> DataFrame:
    """doc_id, text bytes, n_tokens, n_known, train_tokens, base_score and score (both log10) of each row."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", F.coalesce(trainable, F.lit(False)).alias("train"))
    code, total, distinct, size = fit(rows, partitions_for(docs), common)
    release(spark)
    blocks = max(partitions_for(docs), -(-size // block_bytes))
    parts = blocks
    model = spark.sparkContext.broadcast(code)
    whole = math.log10(total + distinct + 1)

    def run(group: pa.Table, replies: pa.Table) -> pa.Table:
        rows = _dealt(group)
        order = np.argsort(replies["part"].to_numpy())
        told = [np.concatenate([unpack(raw, kind) for raw in replies[c].take(pa.array(order)).to_pylist()]) for c, kind in (("seen", np.uint8), ("depth", np.uint8), ("odds", np.int8), ("totals", np.int64))]
        texts = Texts(rows["text"].to_pylist())
        scorer = Scorer(model.value, Block(texts, model.value, parts), tuple(told[:3]), told[3])
        n_known, logs = scorer.baseline()
        n = scorer.block.size
        return pa.table({"doc_id": rows["doc_id"], "n_bytes": texts.n_bytes, "n_tokens": n, "n_known": n_known, "train_tokens": np.full(len(n), total), "base_score": logs - n * whole, "score": scorer.scores()})

    # Both uses of the dealt rows have one plan, so that they are shuffled once.
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")).mapInArrow(_deal, "block int, rows binary")
    asked = dealt.groupBy("block").applyInArrow(_ask(model, parts), "block int, part int, contexts binary, numbers binary, counts binary, words binary, word_counts binary")
    told = asked.groupBy("part").applyInArrow(_answer(model), "block int, part int, seen binary, depth binary, odds binary, totals binary")
    return dealt.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(run, "doc_id long, n_bytes long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
