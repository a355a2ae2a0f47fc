"""Merge-type subword encoding by backtracking, and decoding, from a SentencePiece model file.

A sequence of pieces is what pair merging yields exactly if each piece re-merges to itself and each two neighbours,
merged together, stay these two. The encoder therefore looks for such a sequence from left to right: an Aho-Corasick
pass gives the longest piece that begins at each place; a piece that does not fit its left neighbour is replaced by its
next shorter prefix; a place from which nothing fits is marked in a bitfield and never tried again, so that the work
stays linear in the text.

Rows: null text is encoded as the empty text (begin and end ids only); rows are never merged or dropped, so repeated
rows give repeated results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import re
import struct
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batches

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field number and value of each field of a protocol-buffer message."""
    at, end = 0, len(raw)

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < end:
        key = varint()
        wire = key & 7
        if wire == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(wire) or varint()
            yield key >> 3, raw[at : at + size]
            at += size


class PieceModel:
    """Encoder and decoder of one model file; keeps what it has worked out about words and pairs of pieces."""

    #: Distinct words whose ids are kept; beyond it, memory starts anew (a cache: results do not depend on it).
    WORDS_KEPT = 600_000

    def __init__(self, path: str):
        with open(path, "rb") as f:
            message = list(_fields(f.read()))
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        self.scores: list[float] = []
        spec: dict[int, int | bytes] = {}
        trainer: dict[int, int | bytes] = {}
        for number, value in message:
            if number == 1:
                own = dict(_fields(value))
                self.pieces.append(own.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
                self.kinds.append(own.get(3, NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                spec = dict(_fields(value))
        if trainer.get(3) != 2 or spec.get(2) or spec.get(4, 1) or {USER_DEFINED, UNUSED} & set(self.kinds):
            raise ValueError("only merge-type models with plain normalisation and without user symbols are supported")
        self.prefix = bool(spec.get(3, 1))
        self.unk = self.kinds.index(UNKNOWN)
        self.bos, self.eos = self.pieces.index("<s>"), self.pieces.index("</s>")
        self.ids = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] == NORMAL}
        byte_ids = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.kinds[i] == BYTE}
        self.byte_ids = [byte_ids[b] for b in range(256)] if len(byte_ids) == 256 else None
        self.automaton = ahocorasick.Automaton()
        for p in self.ids:
            self.automaton.add_word(p, len(p))
        self.automaton.make_automaton()
        self.shorter: dict[str, str] = {}
        self.fits: dict[tuple[str, str], bool] = {}
        self.whole: dict[str, bool] = {}
        self.words: dict[str, bytes] = {}
        # No piece goes on after a non-space with a space, and none longer than one character has a line feed: then
        # nothing merges across the borders of these parts, and each is encoded by itself.
        apart = not any(SPACE in p.lstrip(SPACE) for p in self.ids) and not any("\n" in p[:-1] or "\n" in p[1:] for p in self.ids)
        self.parts = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+") if apart else re.compile("(?s).+")
        surfaces: list[bytes] = []
        for i, p in enumerate(self.pieces):
            kind = self.kinds[i]
            surfaces.append(b"" if kind == CONTROL else bytes([int(p[3:5], 16)]) if kind == BYTE else " ⁇ ".encode() if kind == UNKNOWN else p.replace(SPACE, " ").encode())
        self.surfaces = surfaces

    # -- pair merging, for single pieces and pairs of them only

    def merged(self, text: str) -> list[str]:
        """The symbols that merging the best-scored, leftmost pair again and again leaves."""
        n = len(text)
        symbol: list[str | None] = list(text)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        queue: list[tuple[float, int, int, str]] = []

        def offer(left: int, right: int) -> None:
            if left >= 0 and right >= 0 and (whole := symbol[left] + symbol[right]) in self.ids:
                heapq.heappush(queue, (-self.scores[self.ids[whole]], left, right, whole))

        for i in range(n - 1):
            offer(i, i + 1)
        while queue:
            _, left, right, whole = heapq.heappop(queue)
            if symbol[left] is None or symbol[right] is None or after[left] != right or symbol[left] + symbol[right] != whole:
                continue
            symbol[left], symbol[right] = whole, None
            after[left] = after[right]
            if after[left] >= 0:
                before[after[left]] = left
            offer(before[left], left)
            offer(left, after[left])
        return [s for s in symbol if s is not None]

    def _alone(self, piece: str) -> bool:
        if (known := self.whole.get(piece)) is None:
            known = self.whole[piece] = len(piece) == 1 or self.merged(piece) == [piece]
        return known

    def _pair(self, left: str, right: str) -> bool:
        if (known := self.fits.get((left, right))) is None:
            if len(self.fits) > 1_000_000:
                self.fits.clear()
            known = self.fits[left, right] = self.merged(left + right) == [left, right]
        return known

    def _next_shorter(self, piece: str) -> str:
        """The longest proper prefix that is a piece, or a single character; empty if there is none."""
        if (known := self.shorter.get(piece)) is None:
            size = len(piece) - 1
            while size > 1 and piece[:size] not in self.ids:
                size -= 1
            known = self.shorter[piece] = piece[:size]
        return known

    def split(self, text: str) -> list[str]:
        """The pieces of a text that starts at a border; a character without a piece stands for itself."""
        n = len(text)
        longest = [1] * n
        for last, size in self.automaton.iter(text):
            first = last - size + 1
            if size > longest[first]:
                longest[first] = size
        open_places = bytearray(b"\x01") * (n + 1)
        out: list[str] = []
        at, trial = 0, text[: longest[0]] if n else ""
        while trial:
            left = out[-1] if out else None
            piece = trial
            while piece:
                end = at + len(piece)
                if open_places[end] and self._alone(piece) and (left is None or self._pair(left, piece)):
                    out.append(piece)
                    at = end
                    trial = text[end : end + longest[end]] if end < n else ""
                    break
                piece = self._next_shorter(piece)
            else:
                open_places[at] = 0
                if left is None:
                    raise ValueError("no encoding")
                out.pop()
                at -= len(left)
                trial = left
        return out

    def _word(self, part: str) -> bytes:
        ids: list[int] = []
        for piece in self.split(part):
            if (i := self.ids.get(piece)) is not None:
                ids.append(i)
            elif self.byte_ids:
                ids += (self.byte_ids[b] for b in piece.encode())
            elif not ids or ids[-1] != self.unk:
                ids.append(self.unk)
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode_bytes(self, text: str | None) -> bytes:
        """The ids with begin and end, as little-endian unsigned 32-bit integers."""
        out = [struct.pack("<I", self.bos)]
        if text:
            known, put = self.words, out.append
            for part in self.parts.findall((SPACE if self.prefix else "") + text.replace(" ", SPACE)):
                if (ids := known.get(part)) is None:
                    if len(known) >= self.WORDS_KEPT:
                        known.clear()
                    ids = self._word(part)
                    if len(part) <= 64:
                        known[part] = ids
                put(ids)
        out.append(struct.pack("<I", self.eos))
        return b"".join(out)

    def encode(self, text: str | None) -> list[int]:
        raw = self.encode_bytes(text)
        return list(struct.unpack(f"<{len(raw) // 4}I", raw))

    def decode_bytes(self, raw: bytes) -> bytes:
        """The text of ids, in UTF-8; bytes that form no character become U+FFFD."""
        joined = b"".join(map(self.surfaces.__getitem__, np.frombuffer(raw, "<u4").tolist()))
        if self.prefix and joined[:1] == b" ":
            joined = joined[1:]
        try:
            joined.decode()
        except UnicodeDecodeError:
            joined = joined.decode(errors="replace").encode()
        return joined

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(struct.pack(f"<{len(ids)}I", *ids)).decode()


@functools.lru_cache(maxsize=2)
def load(path: str) -> PieceModel:
    """One model for each Python worker."""
    return PieceModel(path)


def encode_documents(docs: DataFrame, model_path: str, id_column: str = "doc_id", text_column: str = "text", digests_only: bool = False) -> DataFrame:
    """Ids and decoded text of each row's whole text: id, ids, decoded; or only their number and SHA-256 digests."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(model_path)
        for keys, texts in batches(rows, "k", "t"):
            raws = [model.encode_bytes(t) for t in texts]
            backs = [model.decode_bytes(r) for r in raws]
            counts = np.fromiter((len(r) // 4 for r in raws), dtype=np.int64, count=len(raws))
            if digests_only:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(counts), pa.array([hashlib.sha256(r).hexdigest() for r in raws]), pa.array([hashlib.sha256(b).hexdigest() for b in backs])], names=["k", "n_tokens", "ids_sha256", "decoded_sha256"])
            else:
                offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
                ids = pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(raws), "<i4")))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), ids, pa.array([b.decode() for b in backs])], names=["k", "ids", "decoded"])

    schema = "k long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digests_only else "k long, ids array<int>, decoded string"
    out = docs.select(docs[id_column].alias("k"), docs[text_column].alias("t")).mapInArrow(run, schema)
    return out.withColumnRenamed("k", id_column)
