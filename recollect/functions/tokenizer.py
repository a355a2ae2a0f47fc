"""Token counts by a tokenizer file."""

from __future__ import annotations

import functools
import os
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


@functools.lru_cache(maxsize=2)
def _load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def counter(path: str) -> Callable[[Column], Column]:
    """A column function that counts a text's tokens without special ones; a blank or null text has none. The file must
    be there on every worker: a missing one is an error at once."""
    if not os.path.exists(path):
        raise FileNotFoundError(path)

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        tokenizer = _load(path)
        return texts.map(lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids) if t and not t.isspace() else 0).astype("int64")

    return count
