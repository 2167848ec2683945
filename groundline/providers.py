"""Models as pluggable column providers, with deterministic stand-ins.

A provider is a small object with one method on a list of texts; :func:`column` runs it in Arrow batches on the executors.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class Embedder(Protocol):
    def encode(self, texts: list[str]) -> list[list[float]]: ...


class TripleModel(Protocol):
    def beams(self, texts: list[str]) -> list[list[str]]:
        """Markup of each beam for each text."""


class CoreferenceModel(Protocol):
    def resolve(self, texts: list[str]) -> list[str]: ...


class TextGenerator(Protocol):
    def generate(self, prompts: list[str]) -> list[str]: ...


class HashingEmbedder:
    """Words hashed to signed places of a vector; unit length if asked."""

    def __init__(self, size: int = 64, normalize: bool = False):
        self.size, self.normalize = size, normalize

    def encode(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.size))
        for i, t in enumerate(texts):
            for w in (t or "").lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                out[i, h % self.size] += 1 if h >> 63 else -1
        if self.normalize:
            out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)
        return out.tolist()


class PatternTriples:
    """Reads ``subject -- predicate -- object`` from a text; one beam."""

    def beams(self, texts: list[str]) -> list[list[str]]:
        out = []
        for t in texts:
            parts = [p.strip() for p in (t or "").split(" -- ")]
            out.append([f"<triplet> {parts[0]} <subj> {parts[2]} <obj> {parts[1]}"] if len(parts) == 3 and all(parts) else [])
        return out


class SameText:
    """No coreference: texts stay as they are."""

    def resolve(self, texts: list[str]) -> list[str]:
        return list(texts)


class Scripted:
    """Answers prompts by the first key they contain."""

    def __init__(self, answers: dict[str, str], default: str = ""):
        self.answers, self.default = answers, default

    def generate(self, prompts: list[str]) -> list[str]:
        return [next((a for k, a in self.answers.items() if k in p), self.default) for p in prompts]


class ServerError(Exception):
    """The model server answered with an internal error."""


def retried(call: Callable[[], str], tries: int = 3, sleep: Callable[[float], None] = time.sleep) -> str:
    """``call``, again after 2 and 4 seconds where the server failed inside; other errors are raised at once."""
    for n in range(1, tries + 1):
        try:
            return call()
        except ServerError:
            if n == tries:
                raise
            sleep(2.0**n)
    raise AssertionError("unreachable")


def column(call: Callable[[list[str]], list], kind: str, text: Column, batch: int = 256) -> Column:
    """A provider's method as a column: ``batch`` texts at a time, in Arrow batches."""
    @F.pandas_udf(kind)
    def run(texts: pd.Series) -> pd.Series:
        some = texts.tolist()
        return pd.Series([x for i in range(0, len(some), batch) for x in call(some[i:i + batch])])

    return run(text)


def attempted(call: Callable[[list[str]], list], kind: str, text: Column, batch: int) -> Column:
    """As :func:`column`, but ``struct(value, error)``: the texts of a batch on which the call fails have its message and no value."""
    @F.pandas_udf(f"value {kind}, error string")
    def run(texts: pd.Series) -> pd.DataFrame:
        some, values, errors = texts.tolist(), [], []
        for i in range(0, len(some), batch):
            part = some[i:i + batch]
            try:
                found = call(part)
                values, errors = values + list(found), errors + [None] * len(part)
            except Exception as e:  # noqa: BLE001 - the failure is the batch's result
                values, errors = values + [None] * len(part), errors + [str(e) or type(e).__name__] * len(part)
        return pd.DataFrame({"value": values, "error": errors})

    return run(text)


def resolved(model: CoreferenceModel, text: Column) -> Column:
    """Text with coreference resolved; a batch on which the model fails stays as it is."""
    def safe(texts: list[str]) -> list[str]:
        try:
            return model.resolve(texts)
        except Exception:  # a model's own failure must not lose the document
            return texts

    return column(safe, "string", text)
