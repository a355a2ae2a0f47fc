"""Language identification with string kernels.

The kernel of two texts counts the character n-grams (one to three symbols) present in both, over the root of the product of
how many each has: a blended-spectrum presence kernel. Training takes a sample of labelled rows whose expected size is
a parameter, picks landmarks from it, maps rows to Nyström features (kernel values with the landmarks times the inverse
root of the landmarks' own kernel matrix) and fits one-versus-rest ridge regressions with balanced classes. As a
prediction is linear in the presence vector, landmark matrix and coefficients are multiplied once, and a batch of texts
is scored by one matrix product.

Symbols are the commonest letters of the sample, lower-cased; all other characters are a gap, and a run of gaps is one.

Rows: null text or text without a letter is `und` with score 0; so is every row if no row is labelled. Labels that are
null are not learned from. Ties go to the first label by name. Whole texts are read. Repeated rows, empty tables and
further columns need no care: each row is scored by itself and only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches, checkpoint

SYMBOLS = 64
CODES = SYMBOLS + SYMBOLS**2 + SYMBOLS**3
UNDETERMINED = "und"


class Grams:
    """The set of n-gram codes of a text, over a fixed alphabet."""

    def __init__(self, alphabet: str):
        self.symbol = np.zeros(0x110000, np.int32)
        for i, c in enumerate(alphabet[: SYMBOLS - 1]):
            self.symbol[ord(c)] = i + 1
        self.seen = np.zeros(CODES, bool)

    def __call__(self, text: str) -> np.ndarray:
        s = self.symbol[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")]
        s = np.concatenate([[0], s, [0]]).astype(np.int32)
        s = s[np.concatenate([[True], (s[1:] != 0) | (s[:-1] != 0)])]
        two = s[:-1] * SYMBOLS + s[1:]
        self.seen[s] = True
        self.seen[SYMBOLS + two] = True
        self.seen[SYMBOLS + SYMBOLS**2 + two[:-1] * SYMBOLS + s[2:]] = True
        codes = np.flatnonzero(self.seen)
        self.seen[codes] = False
        return codes


@dataclass
class Model:
    alphabet: str
    labels: list[str]
    column: np.ndarray  # of each code, in the weights; -1 where no landmark has it
    weights: np.ndarray
    bias: np.ndarray

    def scores(self, sets: list[np.ndarray]) -> np.ndarray:
        presence = np.zeros((len(sets), len(self.weights)), np.float32)
        for row, codes in zip(presence, sets, strict=True):
            at = self.column[codes]
            row[at[at >= 0]] = 1
        return (presence @ self.weights) / np.sqrt([[max(1, len(c))] for c in sets]) + self.bias


def presence(sets: list[np.ndarray], column: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(sets), width), np.float32)
    for row, codes in zip(out, sets, strict=True):
        at = column[codes]
        row[at[at >= 0]] = 1
    return out


def fit_sets(alphabet: str, sets: list[np.ndarray], labels: list[str], landmarks: int, ridge: float) -> Model:
    """Fits the machine on n-gram sets; landmarks are taken evenly from the labels, in the given order."""
    names = sorted(set(labels))
    y = np.array([names.index(x) for x in labels])
    each = -(-landmarks // len(names))
    chosen = np.sort(np.concatenate([np.flatnonzero(y == k)[:each] for k in range(len(names))]))
    codes = np.unique(np.concatenate([sets[i] for i in chosen]))
    column = np.full(CODES, -1, np.int32)
    column[codes] = np.arange(len(codes))
    size = np.sqrt([len(c) for c in sets])
    marks = (presence([sets[i] for i in chosen], column, len(codes)) / size[chosen, None]).T  # codes x landmarks
    kernel = np.concatenate([presence(sets[i : i + 256], column, len(codes)) @ marks for i in range(0, len(sets), 256)]) / size[:, None]
    values, vectors = np.linalg.eigh(kernel[chosen].astype(np.float64))
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    features = kernel @ root
    weight = 1.0 / np.bincount(y)[y]
    weight /= weight.sum()
    target = np.where(y[:, None] == np.arange(len(names)), 1.0, -1.0)
    middle, level = weight @ features, weight @ target
    centred = features - middle
    gram = centred.T @ (centred * weight[:, None]) + ridge * np.eye(features.shape[1])
    w = np.linalg.solve(gram, centred.T @ ((target - level) * weight[:, None]))
    return Model(alphabet, names, column, (marks @ (root @ w)).astype(np.float32), level - middle @ w)


def fit(docs: DataFrame, trainable: Column, per_label: int = 500, landmarks: int = 256, ridge: float = 1e-4) -> Model | None:
    """Learns from about `per_label` rows of each label, drawn by a hash of the row among those where `trainable` holds."""
    rows = docs.filter(trainable & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", "text", F.xxhash64("text", "doc_id").alias("h"))
    counts = {r["lang"]: r["n"] for r in docs.filter(trainable & F.col("lang").isNotNull() & F.col("text").isNotNull()).groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    steps = 1 << 20
    share = F.element_at(F.create_map(*(F.lit(x) for k, n in sorted(counts.items()) for x in (k, min(steps, -(-per_label * steps // n))))), F.col("lang"))
    sample = checkpoint(rows.filter(F.pmod("h", F.lit(steps)) < share))
    letters = sample.select(F.explode(F.split(F.lower("text"), "")).alias("c")).groupBy("c").count().filter(F.col("c").rlike(r"^\p{L}$")).orderBy(F.desc("count"), "c").limit(SYMBOLS - 1)
    alphabet = "".join(r["c"] for r in letters.collect())

    def grams(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Grams(alphabet)
        for langs, texts, hashes in batches(parts, "lang", "text", "h"):
            yield pa.RecordBatch.from_arrays([pa.array(langs), pa.array(hashes, pa.int64()), pa.array([of(t).astype(np.int32) for t in texts])], names=["lang", "h", "codes"])

    got = sorted(sample.mapInArrow(grams, "lang string, h long, codes array<int>").collect(), key=lambda r: (r["h"], r["lang"]))
    if not got:
        return None
    return fit_sets(alphabet, [np.array(r["codes"]) for r in got], [r["lang"] for r in got], landmarks, ridge)


def predict(docs: DataFrame, model: Model | None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, lang_pred and score of each row."""
    if model is None:
        return docs.select(id_column, F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Grams(model.alphabet)
        for keys, texts in batches(parts, "k", "t"):
            labels, scores = [UNDETERMINED] * len(keys), np.zeros(len(keys))
            told = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
            for lo in range(0, len(told), 256):
                some = told[lo : lo + 256]
                f = model.scores([of(texts[i]) for i in some])
                for i, k in zip(some, f.argmax(1), strict=True):
                    labels[i] = model.labels[k]
                scores[some] = np.clip((f.max(1) + 1) / 2, 0, 1)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(labels), pa.array(scores)], names=["k", "lang_pred", "score"])

    found = docs.select(docs[id_column].alias("k"), docs[text_column].alias("t")).mapInArrow(run, "k long, lang_pred string, score double")
    return found.withColumnRenamed("k", id_column)
