"""Scores of a statement against evidence, and of vectors against each other."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from groundline.functions.stemming import stem
from groundline.functions.text import strip

EPSILON = 1e-8
#: Support levels: the least score of each.
LEVELS = (("high", 0.8), ("medium", 0.5), ("low", 0.3))


def containment(a: Column, b: Column) -> Column:
    """1.0 for equal texts, 0.8 where one holds the other (the empty text is held by all), else 0.0; case and outer space don't count."""
    x, y = F.lower(strip(a)), F.lower(strip(b))
    return F.when(x == y, 1.0).when(F.contains(x, y) | F.contains(y, x), 0.8).otherwise(0.0)


def lcs_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence; the rows of the table are bits of one integer."""
    if len(a) > len(b):
        a, b = b, a
    places: dict[str, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        hit = row & places.get(w, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def rouge_tokens(text: str | None, stemmed: bool) -> list[str]:
    found = re.findall(r"[a-z0-9]+", (text or "").lower())
    return [stem(w) if len(w) > 3 else w for w in found] if stemmed else found


def f_measure(target: list[str], prediction: list[str]) -> float:
    if not target or not prediction or not (n := lcs_length(target, prediction)):
        return 0.0
    precision, recall = n / len(prediction), n / len(target)
    return 2 * precision * recall / (precision + recall)


def rouge_l(target: Column, prediction: Column, stemmed: bool = True) -> Column:
    """F-measure of the longest common subsequence of words. Tokens of a text that recurs in a batch are made once."""
    @F.pandas_udf("double")
    def scored(t: pd.Series, p: pd.Series) -> pd.Series:
        tokens: dict[str | None, list[str]] = {}
        for text in {*t, *p}:
            tokens[text] = rouge_tokens(text, stemmed)
        return pd.Series([f_measure(tokens[x], tokens[y]) for x, y in zip(t, p, strict=True)], dtype="float64")

    return scored(target, prediction)


def dot(a: Column, b: Column) -> Column:
    """Dot product in doubles."""
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine with a small number added to each norm. Norms that are at hand are taken, not computed again."""
    return dot(a, b) / (((norm(a) if norm_a is None else norm_a) + EPSILON) * ((norm(b) if norm_b is None else norm_b) + EPSILON))


def greedy_similarity(candidate: Column, reference: Column, baseline: float = 0.0) -> Column:
    """``struct(precision, recall, f1)`` of token embeddings, arrays of vectors: each token's best cosine on the other side, on average.

    ``baseline`` is what unrelated texts score; scores are rescaled so that it becomes 0. An empty side scores 0.
    """
    @F.pandas_udf("precision double, recall double, f1 double")
    def scored(c: pd.Series, r: pd.Series) -> pd.DataFrame:
        rows = []
        for a, b in zip(c, r, strict=True):
            if a is None or b is None or not len(a) or not len(b):
                rows.append((0.0, 0.0, 0.0))
                continue
            x, y = (np.array([np.asarray(v, float) for v in m]) for m in (a, b))
            x, y = (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12) for m in (x, y))
            s = x @ y.T
            p, q = s.max(axis=1).mean(), s.max(axis=0).mean()
            f = 2 * p * q / (p + q) if p + q else 0.0
            rows.append(tuple((v - baseline) / (1 - baseline) for v in (p, q, f)))
        return pd.DataFrame(rows, columns=["precision", "recall", "f1"])

    return scored(candidate, reference)


def dense_score(distance: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - distance)


def level(score: Column) -> Column:
    out = F.lit("none")
    for name, least in reversed(LEVELS):
        out = F.when(score >= least, name).otherwise(out)
    return out


def alpha(score: Column) -> Column:
    """Opacity of a highlight: the score within 0.15 and 1, two decimals, halves to even as Python prints them."""
    return F.format_string("%.2f", F.bround(F.greatest(F.lit(0.15), F.least(F.lit(1.0), score)), 2))
