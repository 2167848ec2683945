"""Quality classifier by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k.

Target and raw text are bags of hashed n-grams: words and word pairs, and the same over word shapes (case, end, symbols, length,
whether a word repeats one just before it). The raw model counts every document. The target model counts labelled good
documents, at most ``MAX_LABELLED`` labelled rows. A document's importance is its log ratio ``log p_target - log p_raw``: the sum
over all words of the whole text of the four kinds' mean log ratio, each drawn towards 0 where little was expected of an n-gram.

Keys are ``importance / temperature`` plus Gumbel noise of scale 1, and the ``k`` largest stay: sampling without replacement in
proportion to the importance weights. ``k`` is a parameter; left out, it is the number of documents whose importance isn't
below 0, those that the target model explains at least as well as the raw one.

Toxic text in good prose has a model of its own, since a few words don't move a sum over a text: the log ratio of words and word
pairs between labelled toxic and labelled good documents, counted once a document. A document's toxicity is the sum over its
``WORST`` terms, and its cut is set by the labelled half that doesn't fit it. What is over the cut isn't sampled.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count as count_up

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundline.llm.common import binary, fields_of, numbered_names, pack, parts_of, quoted, unpack, unused, written

MAX_LABELLED = 20_000
BITS, SHAPE_BITS = 20, 14
SIZE = 2 * (1 << BITS) + 2 * (1 << SHAPE_BITS)
SLICES = 32
PRIOR = 10.0
#: The importance of a text without words, under all others.
EMPTY = -1e12
#: Bins of a round of counts in the search for the k-th key.
BINS = 1024
#: The toxic model: terms of the largest log ratios, in so many labelled toxic documents at least; the worst so many of a text count.
MAX_TERMS, LEAST_TOXIC, TERM_PRIOR, WORST = 1 << 16, 2, 0.5, 2
FILTER_BITS = 20
SYMBOL = re.compile(r"[^\w.,'-]|_").findall
#: Bytes of text that are counted or scored at a time.
PART = 2 << 20
OUTER = re.compile(r"^[\W_]+|[\W_]+$")


def _shape(word: str) -> int:
    """Case, end, symbols and length of a word, below 1 << 10."""
    symbols = end = 0
    if not word.isalnum():
        symbols = min(3, len(SYMBOL(word)))
        end = 0 if word[-1].isalnum() else 1 if word[-1] in ".,;:!?" else 2
    case = 0 if word[0].islower() else 1 if word[0].isupper() else 2 if word[0].isdigit() else 3
    return ((min(len(word), 31) >> 1) * 4 + symbols) * 12 + end * 4 + case


def _mixed(x: np.ndarray, bits: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (x >> np.uint64(64 - bits)).astype(np.int64)


@dataclass
class Tokens:
    """Words of texts, one after another, as numbers of the different ones; and each text's number of words."""

    words: list[str]
    ids: np.ndarray
    sizes: np.ndarray


def tokenised(texts: list[str]) -> Tokens:
    """Bytes split at ASCII white space and nothing else, which is what words are here."""
    number: defaultdict[bytes, int] = defaultdict(count_up().__next__)
    found = [np.fromiter(map(number.__getitem__, words := t.encode("utf-8", "replace").split()), np.int32, len(words)) for t in texts]
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    return Tokens([w.decode() for w in number], np.concatenate([np.zeros(0, np.int32), *found]), sizes)


def ngrams(t: Tokens) -> list[np.ndarray]:
    """Four n-gram numbers for each word, an array per kind."""
    if not t.words:
        return [np.zeros(0, np.int64)] * 4
    codes = pd.util.hash_array(np.array([w.lower() for w in t.words], dtype=object), categorize=False)
    shapes = np.fromiter(map(_shape, t.words), np.uint64, len(t.words))
    h, s = codes[t.ids], (shapes * np.uint64(4))[t.ids]
    first = np.zeros(len(t.ids) + 1, bool)
    first[np.cumsum(t.sizes) - t.sizes] = True
    first, second = first[:-1], np.r_[False, first[:-1]][:len(t.ids)]
    s[1:] |= ((h[1:] == h[:-1]) & ~first[1:]).astype(np.uint64)
    s[2:] |= ((h[2:] == h[:-2]) & ~(first | second)[2:]).astype(np.uint64) << np.uint64(1)

    def before(x: np.ndarray) -> np.ndarray:
        out = np.r_[np.uint64(0), x[:-1]]
        out[first] = 0
        return out

    at = 1 << BITS
    return [
        _mixed(codes, BITS)[t.ids], at + _mixed(h * np.uint64(3) + before(h) * np.uint64(0xBF58476D1CE4E5B9), BITS),
        2 * at + _mixed(s + np.uint64(1), SHAPE_BITS), 2 * at + (1 << SHAPE_BITS) + _mixed(s * np.uint64(5) + before(s) * np.uint64(0x94D049BB133111EB) + np.uint64(7), SHAPE_BITS),
    ]


def weights(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Log ratio of the models by n-gram, each of the four kinds normalised by itself."""
    out = np.zeros(SIZE, np.float32)
    ends = np.cumsum([0, 1 << BITS, 1 << BITS, 1 << SHAPE_BITS, 1 << SHAPE_BITS])
    for a, b in zip(ends, ends[1:], strict=False):
        t, r = target[a:b].astype(float), raw[a:b].astype(float)
        if t.sum() and r.sum():
            out[a:b] = np.log((t + PRIOR) / (r * (t.sum() / r.sum()) + PRIOR))
    return out


def importance(t: Tokens, weight: np.ndarray) -> np.ndarray:
    """Each text's log ratio of the models, over all its words; ``EMPTY`` for one without words."""
    value = np.zeros(len(t.ids))
    for grams in ngrams(t):
        value += weight[grams]
    upto, ends = np.r_[0.0, np.cumsum(value / 4)], np.cumsum(t.sizes)
    return np.where(t.sizes > 0, upto[ends] - upto[ends - t.sizes], EMPTY)


def terms(t: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the texts' words, in lower case without outer symbols, and of their pairs; and the text of each."""
    if not t.words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    bare = np.array([w.lower() if w.isalnum() else OUTER.sub("", w.lower()) for w in t.words], dtype=object)
    some = (bare != "")[t.ids]
    h, text = pd.util.hash_array(bare, categorize=False)[t.ids[some]], np.repeat(np.arange(len(t.sizes)), t.sizes)[some]
    pair = text[1:] == text[:-1]
    pairs = _mixed(h[1:] * np.uint64(3) + h[:-1] * np.uint64(0xBF58476D1CE4E5B9), 64)
    return np.r_[h.view(np.int64), pairs[pair]], np.r_[text, text[1:][pair]]


def toxicity(t: Tokens, known: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Each text's sum of the ``WORST`` weights among its terms; ``known`` terms are sorted, others weigh nothing."""
    out = np.zeros(len(t.sizes))
    if len(known):
        table = np.zeros(1 << FILTER_BITS, bool)
        table[known & ((1 << FILTER_BITS) - 1)] = True
        term, text = terms(t)
        at = table[term & ((1 << FILTER_BITS) - 1)]
        term, text = term[at], text[at]
        place = np.minimum(np.searchsorted(known, term), len(known) - 1)
        at = known[place] == term
        order = np.argsort(-weight, kind="stable")
        rank = np.empty(len(known), np.int64)
        rank[order] = np.arange(len(known))
        text, term = np.divmod(np.unique(text[at] * len(known) + rank[place[at]]), len(known))
        worst = np.arange(len(text)) - np.searchsorted(text, text) < WORST
        out += np.bincount(text[worst], weights=weight[order[term[worst]]], minlength=len(t.sizes))
    return out


def _terms_counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's terms once, and a null for the document itself."""
    for batch in batches:
        for part in parts_of(batch, "text", PART):
            term, text = terms(tokenised([t or "" for t in part.column("text").to_pylist()]))
            order = np.lexsort((term, text))
            term, text = term[order], text[order]
            new = np.r_[True, (term[1:] != term[:-1]) | (text[1:] != text[:-1])][:len(term)]
            term, text = term[new], text[new]
            n, toxic = part.num_rows, np.array(part.column("role").to_pylist(), dtype=object) == "toxic"
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[np.zeros(n, np.int64), term], mask=np.arange(n + len(term)) < n), pa.array(np.r_[toxic, toxic[text]].astype(np.int32))], ["term", "toxic"])


def toxic_model(labelled: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Terms and their weights from ``labelled(text, role)`` of roles toxic and target: positive log ratios alone."""
    counts = labelled.mapInArrow(_terms_counted, "term long, toxic int").groupBy("term").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    counts = written(counts.where(F.col("term").isNull() | (F.col("t") >= LEAST_TOXIC)), "toxic-terms")
    total = counts.where("term is null").first()
    if total is None or not total["t"] or not total["c"]:
        return np.zeros(0, np.int64), np.zeros(0)
    weight = F.log((F.col("t") + TERM_PRIOR) / (F.col("c") * (total["t"] / total["c"]) + TERM_PRIOR))
    best = counts.where("term is not null").select("term", weight.alias("weight")).where("weight > 0").orderBy(F.desc("weight"), "term").limit(MAX_TERMS).toPandas().sort_values("term")
    return best["term"].to_numpy(np.int64), best["weight"].to_numpy(float)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a task's rows: by model (0 raw, 1 target) and slice of the n-gram numbers, one packed row each."""
    raw, target, any_target = np.zeros(SIZE, np.int64), np.zeros(SIZE, np.int64), False
    for batch in batches:
        for part in parts_of(batch, "text", PART):
            t = tokenised([t or "" for t in part.column("text").to_pylist()])
            mine = np.repeat(np.array(part.column("role").to_pylist(), dtype=object) == "target", t.sizes)
            grams = ngrams(t)
            raw += np.bincount(np.concatenate(grams), minlength=SIZE)
            if mine.any():
                any_target = True
                target += np.bincount(np.concatenate([g[mine] for g in grams]), minlength=SIZE)
    width = SIZE // SLICES
    out = [(m, i, pack(c[i * width:(i + 1) * width])) for m, c in enumerate((raw, target)) if m == 0 or any_target for i in range(SLICES)]
    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.binary())], ["model", "slice", "counts"])


def _added(table: pa.Table) -> pa.Table:
    total = np.zeros(SIZE // SLICES, np.int64)
    for x in binary(table, "counts"):
        total += unpack(x, "i8")
    return pa.table({"model": table.column("model")[:1], "slice": table.column("slice")[:1], "counts": pa.array([pack(total)], pa.binary())})


def cut_of(clean: np.ndarray, bad: np.ndarray, clean_loss: float) -> float:
    """The value over which documents are rejected: where the share of bad documents over it less that of clean ones is largest,
    but with no more than ``clean_loss`` of the clean ones over it. Infinite without documents of either sort."""
    if not len(clean) or not len(bad):
        return float("inf")
    least = float(np.quantile(clean, 1 - clean_loss, method="higher"))
    tried = np.unique(np.r_[bad[bad > least] - 1e-9, least])
    clean, bad = np.sort(clean), np.sort(bad)
    gain = np.searchsorted(clean, tried, side="right") / len(clean) - np.searchsorted(bad, tried, side="right") / len(bad)
    return float(tried[np.argmax(gain)])


def classify(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: ``doc_id, importance, sampled_key, toxicity, kept``.

    ``labels(doc_id, quality, toxic)``: documents of quality 1 that aren't toxic are the target. At most ``max_labelled`` labelled
    ids are used, in the order of a hash; all counts and importances are of all documents. ``k`` documents of the largest keys stay,
    and all whose key equals the last of them; ``temperature`` divides importances. Without any label of a target document
    importances are 0 and all that aren't left out by ``k`` stay; without labels of toxic ones none goes for its toxicity. A null or
    empty text comes after all others. An id that is labelled more than once is a target only if all its labels say so. Keys are
    drawn from id and text, so rows equal in both share one and stay or go together. An empty table gives none; other columns
    are left out, so none can clash.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rated, keep, names = rate(source, labels, "doc_id", "text", ("doc_id",), **options)
    return rated.select("doc_id", *(F.col(n).alias(a) for n, a in zip(names, ("importance", "sampled_key", "toxicity"), strict=True)), keep.alias("kept"))


def select(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that :func:`classify` keeps, with all their columns, of any names. The text passes through once and isn't shuffled."""
    plain, names = numbered_names(docs)
    rated, keep, _ = rate(plain, labels, names[id_col], names[text_col], tuple(plain.columns), **options)
    return rated.where(keep).select(*plain.columns).toDF(*docs.columns)


def rate(
    docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, carry: tuple[str, ...], *, k: int | None = None, temperature: float = 1.0, max_labelled: int = MAX_LABELLED, toxic_clean_loss: float = 0.001, seed: int = 5,
) -> tuple[DataFrame, Column, list[str]]:
    """``carry`` of ``docs`` with importance, key and toxicity, written out; which are kept; and the names of those three columns."""
    role, draw, label_id, good, toxic, *out = unused(docs.columns, "role", "draw", "label_id", "good", "toxic", "importance", "key", "toxicity")
    is_good = ((F.coalesce(F.col("quality"), F.lit(0)) == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)).cast("int")
    by_id = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias(label_id)).agg(F.min(is_good).alias(good), F.max((F.coalesce(F.col("toxic"), F.lit(0)) == 1).cast("int")).alias(toxic))
    label = written(by_id.orderBy(F.xxhash64(F.lit(seed), label_id), label_id).limit(max_labelled), "labels")
    fits = F.pmod(F.xxhash64(label_id, F.lit(seed)), F.lit(2)) == 0
    sort = F.when(F.col(good).isNull(), "none").when(F.col(good) == 1, F.when(fits, "target").otherwise("clean")).when(F.col(toxic) == 1, F.when(fits, "toxic").otherwise("foul")).otherwise("none")
    # max_labelled ids are all that is broadcast
    joined = docs.join(F.broadcast(label), F.col(id_col) == F.col(label_id), "left").withColumns({role: sort, draw: F.xxhash64(F.lit(seed + 1), id_col, text_col)})

    models = joined.select(F.col(text_col).alias("text"), F.col(role).alias("role")).mapInArrow(_counted, "model int, slice int, counts binary").groupBy("model", "slice").applyInArrow(_added, "model int, slice int, counts binary").collect()
    counts = np.zeros((2, SIZE), np.int64)
    for row in models:  # 2 x SLICES rows, SIZE numbers in all, whatever the corpus
        width = SIZE // SLICES
        counts[row["model"], row["slice"] * width:(row["slice"] + 1) * width] = unpack(bytes(row["counts"]), "i8")
    weight = weights(counts[1], counts[0])
    known_terms, term_weight = toxic_model(joined.where(F.col(role).isin("target", "toxic")).select(F.col(text_col).alias("text"), F.col(role).alias("role")))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts_of(batch, text_col, PART):
                t = tokenised([t or "" for t in part.column(text_col).to_pylist()])
                value, foul = importance(t, weight), toxicity(t, known_terms, term_weight)
                passed = [*carry, role, draw]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in passed), pa.array(value, pa.float64()), pa.array(foul, pa.float64())], [*passed, out[0], out[2]])

    passed = joined.select(*quoted(*dict.fromkeys([*carry, text_col])), role, draw)
    told = passed.mapInArrow(measure, f"{fields_of(passed.select(*quoted(*carry), role, draw))}, {out[0]} double, {out[2]} double")
    u = (F.pmod(draw, F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    rated = written(told.withColumn(out[1], F.col(out[0]) / temperature - F.log(-F.log(u))), "importance")
    known = rated.where(F.col(role).isin("clean", "foul")).select(F.col(role).alias("role"), F.col(out[2]).alias("toxicity")).toPandas()  # rows of at most max_labelled ids
    most = cut_of(known.loc[known["role"] == "clean", "toxicity"].to_numpy(), known.loc[known["role"] == "foul", "toxicity"].to_numpy(), toxic_clean_loss)
    if k is None:
        k = rated.where(F.col(out[0]) >= 0).count() if counts[1].any() else rated.count()
    return rated, (F.col(out[1]) >= kth_largest(rated, out[1], k)) & (F.col(out[2]) <= most), out


def kth_largest(rated: DataFrame, key: str, k: int) -> float:
    """The ``k``-th largest of the keys; infinite for no ``k``, and minus that if there are no more than ``k``.

    Rounds of counts by ``BINS`` bins narrow it down; a round tells the driver one row a bin, and no task sorts.
    """
    if k <= 0:
        return float("inf")
    all_ = rated.agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("low"), F.max(key).alias("high")).first()
    if all_["n"] <= k:
        return -float("inf")
    low, high, wanted = all_["low"], all_["high"], k
    while low < high:
        width = (high - low) / BINS
        number = F.least(F.floor((F.col(key) - low) / width), F.lit(BINS - 1))
        bins = rated.where(F.col(key).between(low, high)).groupBy(number.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("low"), F.max(key).alias("high")).collect()
        for b in sorted(bins, key=lambda b: -b["bin"]):
            if b["n"] >= wanted:
                if (b["low"], b["high"]) == (low, high):  # bins no wider than the numbers' own grain
                    return low
                low, high = b["low"], b["high"]
                break
            wanted -= b["n"]
    return low
