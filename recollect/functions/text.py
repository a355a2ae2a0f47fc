"""Scalar text functions, as columns that stay inside the JVM except where a docstring says otherwise.

A null text gives null, unless a function says otherwise.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType, StringType

# Ranges whose characters count as a token each.
WIDE = r"[\x{3000}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}\x{FF00}-\x{FFEF}]"
# Words too common to follow.
STOPWORDS = [
    "the", "is", "in", "a", "an", "of", "to", "and", "or", "what", "which", "how", "do", "does",
    "are", "was", "were", "be", "for", "on", "at", "it", "this", "that", "with", "from", "by",
    "as", "i", "you", "we", "they", "there", "here", "use", "uses", "used", "their", "its",
    "all",
]
CUT_MARK = " …[truncated]"
LINES = r"[^\n]*\n|[^\n]+"
#: Unicode white space, which trimming takes off both ends.
BLANKS = r"[\x{09}-\x{0D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def trimmed(text: Column | str) -> Column:
    return F.regexp_replace(_c(text), f"^{BLANKS}+|{BLANKS}+$", "")


def is_blank(text: Column | str) -> Column:
    return F.coalesce(trimmed(text), F.lit("")) == ""


def wide_chars(text: Column | str) -> Column:
    t = _c(text)
    return (F.length(t) - F.length(F.regexp_replace(t, WIDE, ""))).cast("long")


def est_tokens(text: Column | str) -> Column:
    """A token for each wide character, and one for each four others, rounded up; null counts as empty."""
    t = F.coalesce(_c(text), F.lit(""))
    wide = wide_chars(t)
    return wide + F.ceil((F.length(t) - wide) / 4)


def truncate_to_tokens(text: Column | str, tokens: int) -> Column:
    t = _c(text)
    return F.when(F.length(t) <= 4 * tokens, t).otherwise(F.concat(F.substring(t, 1, 4 * tokens), F.lit(CUT_MARK)))


def fnv1a(text: Column | str) -> Column:
    """FNV-1a of 64 bits over UTF-8, as a signed long. The product is made of halves, as longs must not overflow."""
    octets = F.transform(F.regexp_extract_all(F.hex(F.encode(_c(text), "UTF-8")), F.lit(".."), F.lit(0)), lambda b: F.conv(b, 16, 10).cast("long"))
    low = (1 << 32) - 1

    def step(h: Column, b: Column) -> Column:
        x = h.bitwiseXOR(b)
        lo, hi = x.bitwiseAND(F.lit(low)), F.shiftrightunsigned(x, 32)
        top = (hi * 435 + F.shiftrightunsigned(lo * 435, 32) + F.shiftleft(lo, 8)).bitwiseAND(F.lit(low))
        return F.shiftleft(top, 32).bitwiseOR((lo * 435).bitwiseAND(F.lit(low)))

    return F.aggregate(octets, F.lit(-3750763034362895579), step)


def content_hash(text: Column | str) -> Column:
    return F.lpad(F.lower(F.hex(fnv1a(text))), 16, "0")


def ascii_lower(text: Column | str) -> Column:
    return F.translate(_c(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_tokens(text: Column | str) -> Column:
    """Runs of letters, digits and underscores, ASCII letters lowered, repeats kept."""
    return F.regexp_extract_all(ascii_lower(text), F.lit(r"[\p{IsAlphabetic}\p{N}_]+"), F.lit(0))


def compound_tokens(text: Column | str) -> Column:
    """Units joined by _ - . / as wholes and as parts, lowered, each once in order of first appearance."""
    units = F.transform(F.regexp_extract_all(_c(text), F.lit(r"[\p{IsAlphabetic}\p{N}_./-]+"), F.lit(0)), lambda u: F.lower(F.regexp_replace(u, r"^[_./-]+|[_./-]+$", "")))
    split = F.transform(units, lambda u: F.concat(F.array(u), F.split(u, r"[_./-]+")))
    return F.array_remove(F.array_distinct(F.flatten(split)), "")


def code_tokens(text: Column | str) -> Column:
    """Units as wholes, their parts between . / - _ and the parts' words by capitals, ASCII letters lowered, each once in order."""
    units = F.regexp_extract_all(_c(text), F.lit(r"[\p{IsAlphabetic}\p{N}_./-]+"), F.lit(0))
    words = "(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"

    def of(unit: Column) -> Column:
        parts = F.array_remove(F.split(unit, r"[./_-]"), "")
        return F.concat(F.array(unit), F.flatten(F.transform(parts, lambda p: F.concat(F.array(p), F.split(p, words)))))

    return F.array_distinct(F.transform(F.flatten(F.transform(units, of)), ascii_lower))


@F.pandas_udf(ArrayType(StringType()))
def folded_tokens(text: pd.Series) -> pd.Series:
    """Runs of letters and digits, lowered and without marks. Folding needs a decomposition that Spark lacks: Arrow."""
    import re

    import regex

    plain = re.compile("[a-z0-9]+").findall
    find = regex.compile(r"[\p{L}\p{N}\p{Co}]+").findall
    unmarked = regex.compile(r"\p{Mn}+").sub

    def of(t: str | None) -> list[str] | None:
        if t is None:
            return None
        if t.isascii():
            return plain(t.lower())
        return find(unmarked("", unicodedata.normalize("NFD", t)).lower())

    return text.map(of)


@F.pandas_udf(ArrayType(StringType()))
def replay_pieces(text: pd.Series, cap: pd.Series) -> pd.Series:
    """The text in pieces of at most so many characters, cut after white space where that is possible; joined, they give the text.

    A walk over runs that end in white space; a run longer than the cap is cut hard, and its last part stays alone.
    """
    import re

    blank = BLANKS.replace("\\x{", "\\u{")
    inner = "".join(chr(c) for a, b in _ranges(blank) for c in range(a, b + 1))
    runs = re.compile(f"[^{re.escape(inner)}]*[{re.escape(inner)}]|[^{re.escape(inner)}]+").findall

    def of(t: str | None, limit: int) -> list[str] | None:
        if t is None:
            return None
        limit, out, now, size = max(1, limit), [], [], 0
        for run in runs(t):
            if now and size + len(run) > limit:
                out.append("".join(now))
                now, size = [], 0
            if len(run) > limit:
                out += [run[k : k + limit] for k in range(0, len(run), limit)]
            else:
                now.append(run)
                size += len(run)
        return [*out, "".join(now)] if now else out

    return pd.Series([of(t, n) for t, n in zip(text, cap, strict=True)])


def _ranges(pattern: str) -> list[tuple[int, int]]:
    """The ranges of a character class written with hexadecimal numbers in braces."""
    import re

    found = re.findall(r"\{([0-9A-F]+)\}(-?)", pattern)
    out, k = [], 0
    while k < len(found):
        last = k + 1 if found[k][1] else k
        out.append((int(found[k][0], 16), int(found[last][0], 16)))
        k = last + 1
    return out


def lines_of(text: Column | str) -> Column:
    """Lines without their ends, a line feed with or without a carriage return before it; one at the end of the text begins no line."""
    t = _c(text)
    lines = F.split(F.regexp_replace(F.replace(t, F.lit("\r\n"), F.lit("\n")), r"\n\z", ""), "\n", -1)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(lines)


def truncate_to_bytes(text: Column | str, size: int) -> Column:
    """The longest beginning of so many bytes at most that ends between characters."""
    t = _c(text)
    cut = F.hex(F.substring(F.encode(t, "UTF-8"), 1, size))
    whole = F.regexp_replace(cut, "(?:[CDEF][0-9A-F]|E[0-9A-F][89AB][0-9A-F]|F[0-9A-F](?:[89AB][0-9A-F]){1,2})$", "")
    return F.when(F.octet_length(t) <= size, t).otherwise(F.decode(F.unhex(whole), "UTF-8"))


def is_usable(token: Column | str) -> Column:
    t = _c(token)
    return (F.octet_length(t) >= 2) & ~t.isin(STOPWORDS)


def idf(n: Column, df: Column) -> Column:
    return F.log1p(n / F.greatest(df, F.lit(1)))


def preview(text: Column | str, limit: int = 220) -> Column:
    t = F.replace(_c(text), F.lit("\n"), F.lit("\\n"))
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.substring(t, 1, limit), F.lit(" …(+"), F.length(t) - limit, F.lit(" chars)")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where lengths differ or a norm is 0."""
    norms = F.sqrt(dot(a, a) * dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norms == 0), 0.0).otherwise(dot(a, b) / norms)


def fence(label: str, rule: str, body: Column | str, mark: str = "quoted") -> Column:
    """The body between marks that carry its hash, so that a quoted mark cannot close the fence."""
    b = _c(body)
    tag = F.substring(content_hash(b), 9, 8)
    return F.concat(F.lit(f"[{label}] {rule}\n<<<{mark}:notes:"), tag, F.lit(">>>\n"), b, F.lit(f"\n<<<{mark}:end:"), tag, F.lit(">>>\n"))


@F.pandas_udf(BinaryType())
def vector_bytes(vector: pd.Series) -> pd.Series:
    """32-bit floats as little-endian bytes."""
    import numpy as np

    return vector.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())


@F.pandas_udf(ArrayType(FloatType()))
def bytes_vector(raw: pd.Series) -> pd.Series:
    """The floats of such bytes; what is left over at the end is no float."""
    import numpy as np

    return raw.map(lambda b: None if b is None else np.frombuffer(b[: len(b) // 4 * 4], "<f4"))
