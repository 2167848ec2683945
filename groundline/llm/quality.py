"""Quality rules by repetition coverage: how many characters of a text lie inside n-grams and lines that it repeats.

Rolling hashes of several n-gram lengths run over a text's word codes in numpy; an n-gram counts as duplicated where its
hash occurs twice or more in the text, and a mask over words measures the characters under such n-grams. Longer n-grams are
looked for only where shorter ones were found, so a text without repeats costs one pass. The three-word windows of the base
columns are compared exactly, by word numbers and not by hash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundline.llm.common import WORD

SYMBOLS = "#*$%&|<>"
#: n-gram length: largest share of a text's word characters that may lie in its duplicated n-grams.
COVERAGE_LIMITS = {5: 0.40, 6: 0.38, 8: 0.35, 10: 0.32}
LINE_LIMIT, SYMBOL_LIMIT = 0.30, 0.10
COLUMNS = [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("dup_line_chars", pa.int64()), *[(f"dup_chars_{n}", pa.int64()) for n in COVERAGE_LIMITS]]


def duplicated(keys: np.ndarray) -> np.ndarray:
    """Which places hold a key that occurs more than once."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    same = s[1:] == s[:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def covered(starts: np.ndarray, length: int, size: int) -> np.ndarray:
    """Mask of ``size`` places under windows of ``length`` at ``starts``."""
    steps = np.zeros(size + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + length, -1)
    return np.cumsum(steps[:-1]) > 0


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


def measure(text: str | None, find=re.compile(WORD).findall) -> tuple[int, ...]:
    """The values of ``COLUMNS`` for one text; a null text is an empty one."""
    text = text or ""
    words = find(text)
    n = len(words)
    n_symbols = sum(map(text.count, SYMBOLS))
    n_dup_lines = dup_line_chars = 0
    if "\n" in text:
        seen = set()
        for line in text.split("\n"):
            if line in seen:
                n_dup_lines += 1
                dup_line_chars += sum(map(len, find(line)))
            elif find(line):
                seen.add(line)
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    lengths = np.fromiter(map(len, words), np.int64, n)
    word_chars = int(lengths.sum())
    repeats, by_length = 0, dict.fromkeys(COVERAGE_LIMITS, 0)
    if n >= 3 and len(number) < n:
        pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1]
        found = np.flatnonzero(duplicated(pairs[:-1] * np.int64(len(number)) + ids[2:]))
        if len(found):
            repeats = int(covered(found, 3, n).sum())
            code, at, m = _mix(ids), found, 3
            base = np.uint64(0x100000001B3)
            rolling = code
            for k in range(1, 3):
                rolling = rolling[:-1] * base + code[k:]
            for length in range(4, max(COVERAGE_LIMITS) + 1):
                rolling = rolling[:-1] * base + code[length - 1:]
                at = at[at < len(rolling)]
                at = at[duplicated(rolling[at])]
                m = length
                if not len(at):
                    break
                if m in by_length:
                    by_length[m] = int(lengths[covered(at, m, n)].sum())
    return n, word_chars, n_symbols, n_dup_lines, repeats, dup_line_chars, *by_length.values()


def repetition(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, the measures of ``COLUMNS``, ``base_failed`` and ``kept``.

    Base: under 50 words, or more than half of the words inside repeated three-word windows. Beyond that a text is dropped
    if its repeated lines hold over 30 % of its word characters, its duplicated n-grams more than ``COVERAGE_LIMITS``
    allow, or it has over one symbol of ``SYMBOLS`` to ten words.

    A null or empty text has no words and fails the base. Very long texts are measured whole, a text at a time. Repeated
    rows each get a row; an empty table gives none; other columns are left out, so none can clash.
    """
    names = [c for c, _ in COLUMNS]

    def measures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measure(t.as_py()) for t in batch.column("text")]
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, t) for c, (_, t) in zip(columns, COLUMNS, strict=True)]], ["doc_id", *names])

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = source.mapInArrow(measures, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in names))
    return found.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~over_limits())


def base_failed():
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def over_limits():
    found = (F.col("dup_line_chars") > LINE_LIMIT * F.col("word_chars")) | (F.col("n_symbols") > SYMBOL_LIMIT * F.col("n_words"))
    for n, limit in COVERAGE_LIMITS.items():
        found |= F.col(f"dup_chars_{n}") > limit * F.col("word_chars")
    return found
