"""Compatibility forms and case folding, which no built-in expression has: Arrow-batched functions over titles."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def nfkc(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Compatibility composition; null stays null."""
    for s in texts:
        yield s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@F.pandas_udf(T.StringType())
def folded(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Case folding (one to many: ß is ss), null as blank."""
    for s in texts:
        yield s.map(lambda t: (t or "").casefold())


@F.pandas_udf(T.StringType())
def title_key(titles: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The key by which nodes of two exports are the same: compatibility form, folded case, single blanks; null as blank."""
    for s in titles:
        yield s.map(lambda t: " ".join(unicodedata.normalize("NFKC", t or "").casefold().split()))
