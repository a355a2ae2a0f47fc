"""Byte-level BPE ids of a tokenizers file.

The tokenizers library is the measure. Texts of characters on which all regular-expression engines agree (ASCII and
Latin letters, digits, signs, spaces and line feeds) are merged by tiktoken over the ranks read from the same file, three
times faster with the same ids; every other text goes to the tokenizers library itself.
"""

from __future__ import annotations

import functools
import json
import os
import struct

#: Of each character, bytes in Latin-1, it is certain whether it is white space, letter, digit or neither.
PLAIN = bytes([10, *range(0x20, 0x7F), *range(0xA1, 0x100)])
#: Fixed value: the pre-tokenizer's pattern.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: itself, or the next free one from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteEncoder:
    def __init__(self, path: str, special_in_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special_in_text
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] if special_in_text else []
        self.fast = self._ranked(path)

    @staticmethod
    def _ranked(path: str):
        """tiktoken over the file's ranks; None if the file is not plain byte-level BPE whose ids follow its merges."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        if model.get("type") != "BPE" or spec.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
            return None
        added = {t["content"] for t in spec.get("added_tokens", [])}
        vocab = {k: v for k, v in model["vocab"].items() if k not in added}
        merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        if [vocab.get(m) for m in merged] != list(range(256, 256 + len(merged))) or len(vocab) != 256 + len(merged):
            return None
        import tiktoken

        byte_of = _byte_of()
        return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks={bytes(byte_of[c] for c in k): v for k, v in vocab.items()}, special_tokens={})

    def encode_bytes(self, text: str) -> bytes:
        if self.fast is not None and not any(s in text for s in self.special):
            try:
                if not text.encode("latin-1").translate(None, PLAIN):
                    return self.fast.encode_to_numpy(text, disallowed_special=()).tobytes()
            except UnicodeEncodeError:
                pass
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode_many(self, texts: list[str | None], end_id: int) -> list[bytes]:
        """For each text its ids and the end id, as little-endian unsigned 32-bit integers; null counts as empty."""
        end = struct.pack("<I", end_id)
        return [(self.encode_bytes(t) if t else b"") + end for t in texts]


@functools.lru_cache(maxsize=2)
def load(path: str, special_in_text: bool = False) -> ByteEncoder:
    """One encoder of each kind for each Python worker."""
    return ByteEncoder(path, special_in_text)
