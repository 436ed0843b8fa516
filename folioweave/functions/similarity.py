"""Title similarity: cheap cases as expressions, the sequence ratio only where they don't decide."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioweave.functions.text import match_key, token_dice


@F.pandas_udf(T.DoubleType())
def sequence_ratio(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    from difflib import SequenceMatcher

    for a, b in pairs:
        yield pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)])


def alike(ours: list[str], planned: list[str], threshold: float) -> list[str]:
    """Those of ``ours`` whose similarity to some of ``planned`` is at least ``threshold``; both are match keys.

    Equal keys, keys inside others and shared tokens are told first. The sequence ratio is no higher than twice the
    letters in common by the letters of both, so only pairs that this leaves open are aligned.
    """
    from difflib import SequenceMatcher

    if threshold <= 0:
        return list(ours) if len(planned) else []
    left, right = [a for a in ours if a], [b for b in planned if b]
    known = set(right)
    found = [a for a in left if a in known]
    left = [a for a in left if a not in known]
    if not left or not right:
        return found

    def table(keys: list[list], of: dict) -> np.ndarray:
        t = np.zeros((len(keys), len(of)), dtype=np.float32)
        for n, k in enumerate(keys):
            np.add.at(t[n], [of[x] for x in k], 1)
        return t

    words, others = [sorted(set(a.split(" "))) for a in left], [sorted(set(b.split(" "))) for b in right]
    tokens = {w: n for n, w in enumerate(sorted({w for b in others for w in b}))}
    theirs, sizes = table(others, tokens), np.array([len(b) for b in others])
    cells = {x: n for n, x in enumerate(sorted({x for b in right for x in b}))}
    letters, lengths = table(right, cells), np.array([len(b) for b in right])
    matchers: dict[int, SequenceMatcher] = {}
    for n, a in enumerate(left):
        inside = len(a) >= 4 and any(a in b or (len(b) >= 4 and b in a) for b in right)
        shared = theirs[:, [tokens[w] for w in words[n] if w in tokens]].sum(axis=1)
        if inside or (2.0 * shared.astype(float) / (len(words[n]) + sizes) >= threshold).any():
            found.append(a)
            continue
        fits = np.flatnonzero(2.0 * np.minimum(lengths, len(a)) / (lengths + len(a)) >= threshold)
        own = table([[x for x in a if x in cells]], cells)[0]
        most = 2.0 * np.minimum(letters[fits], own).sum(axis=1).astype(float) / (lengths[fits] + len(a))
        for k in fits[most >= threshold]:
            if k not in matchers:
                matchers[k] = SequenceMatcher(None, "", right[k])
            matchers[k].set_seq1(a)
            if matchers[k].ratio() >= threshold:
                found.append(a)
                break
    return found


def keys_alike(threshold: float):
    """Of two columns with a page's match keys, those of the first that are alike to one of the second."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def f(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for ours, planned in pairs:
            yield pd.Series([alike(list(a), list(b), threshold) for a, b in zip(ours, planned)], dtype=object)

    return f


def decided(a: Column, b: Column) -> Column:
    """Similarity of two match keys where it needs no alignment: blank, equal, or one inside the other."""
    inside = (F.least(F.length(a), F.length(b)) >= 4) & (F.contains(a, b) | F.contains(b, a))
    return F.when((a == "") | (b == ""), 0.0).when((a == b) | inside, 1.0)


def with_similarity(pairs: DataFrame, a: str, b: str, name: str = "similarity") -> DataFrame:
    """``pairs`` with the similarity of two title columns; null titles count as blank.

    Python only sees the pairs that no expression decides.
    """
    keyed = pairs.withColumn("__a", F.coalesce(match_key(a), F.lit(""))).withColumn("__b", F.coalesce(match_key(b), F.lit("")))
    keyed = keyed.withColumn("__d", decided(F.col("__a"), F.col("__b")))
    plain = keyed.where("__d is not null").withColumn(name, F.col("__d"))
    rest = keyed.where("__d is null").withColumn(name, F.greatest(sequence_ratio("__a", "__b"), token_dice(F.col("__a"), F.col("__b"))))
    return plain.unionByName(rest).drop("__a", "__b", "__d")


def blocked_pairs(left: DataFrame, right: DataFrame, keys: list[str], left_page: str, right_page: str, tolerance: int) -> DataFrame:
    """Pairs of equal keys whose pages differ by at most ``tolerance``: an equi-join on each possible page."""
    reach = left.withColumn("__at", F.explode(F.sequence(F.col(left_page) - tolerance, F.col(left_page) + tolerance)))
    return reach.join(right.withColumn("__at", F.col(right_page)), [*keys, "__at"]).drop("__at")
