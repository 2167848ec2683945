"""Benchmark decontamination by template canonicalisation.

Words become template tokens: numbers, units and names are typed placeholders, other words their lower-case form without
outer punctuation. Windows of template tokens are hash-joined between documents and benchmark items, so a question whose
numbers or names were changed still meets its original. A benchmark value stands for one document value all over a document,
whatever the alignment, and windows with a slot that disagrees don't count. Windows of plain lower-case words are joined
beside them, so every verbatim copy counts, in any capitals and with however few words that aren't placeholders. A document
that holds enough of an item's windows of either sort is contaminated, by a verbatim or by a re-parameterised copy.

Both sides are tables of windows. A filter of at most 16 MB of the benchmark's window hashes goes to the tasks that read the
documents, so only windows that may match leave them; those are joined by hash, counted per document and item, and only pairs
with enough windows are looked into. Nothing of the benchmark but the filter is held by a task or the driver.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count as count_up

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundline.llm.common import WORD, parts_of, quoted, unused, written

FIND = re.compile(WORD).findall
NUMBER = re.compile(r"[+-]?[$€£#]?[0-9][0-9.,:/]*%?(?:st|nd|rd|th)?$")
UNITS = frozenset(
    "mm cm m km in inch inches ft feet foot yd yard yards mi mile miles mg g kg t ton tons tonne tonnes lb lbs oz ml l litre litres liter liters gal s sec second seconds min minute minutes "
    "h hr hour hours day days week weeks month months year years km/h mph m/s hz khz mhz ghz kb mb gb tb w kw mw v a ma c f k pa bar psi j kj cal kcal percent % $ € £ usd eur gbp cent cents dollar dollars euro euros".split()
)
WORD_KIND, NUM, UNIT, NAME = 0, 1, 2, 3
PLACEHOLDERS = np.array([0, 0x1F3D5B79A1C3E507, 0x2E4C6A8B0D1F3D5B, 0x3D5B79A1C3E5071F], np.uint64)
STEP = np.uint64(0x9E3779B97F4A7C15)
#: A template window needs so many words that are no placeholders, else it would match tables and lists; a window of plain words needs none.
LITERALS = 3
#: The filter of window hashes has at least 2^20 bits, at most 2^27 (16 MB), and 16 a window between them.
FILTER_BITS = (20, 27)
FILTER_SLICES = 16
#: Benchmark windows up to which their table is broadcast; beyond, it is joined by a shuffle with hashes dealt to SALT pieces.
BROADCAST_WINDOWS = 200_000
SALT = 16


def _token(word: str) -> tuple[str, int, bool, bool]:
    """Normal form, kind, whether its letters begin with a capital, whether it ends a sentence."""
    if word.isalpha():
        low = word.lower()
        return low, UNIT if low in UNITS else WORD_KIND, word[0].isupper(), False
    core = word.strip("\"'()[]{}<>«»“”‘’¡¿,;:.!?*_|#~`")
    end = word.rstrip("\"')]»”’").endswith((".", "!", "?"))
    low = core.lower()
    kind = NUM if NUMBER.match(core) else UNIT if low in UNITS or (not core and word in UNITS) else WORD_KIND
    return low or word.lower(), kind, core[:1].isupper(), end


@dataclass
class Tokens:
    codes: np.ndarray  #: template token of each word
    kinds: np.ndarray
    values: np.ndarray  #: hash of each word's normal form
    sizes: np.ndarray  #: words of each text


def tokens(texts: list[str]) -> Tokens:
    """Template tokens of the texts, one after another. A capital makes a name except at the start of a text or sentence; a unit
    is one only right after a number."""
    number: defaultdict[str, int] = defaultdict(count_up().__next__)
    found = [np.fromiter(map(number.__getitem__, words := FIND(t)), np.int32, len(words)) for t in texts]
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    if not number:
        none = np.zeros(0, np.int64)
        return Tokens(none.astype(np.uint64), none, none.astype(np.uint64), sizes)
    low, kind, capital, end = zip(*map(_token, number), strict=True)
    ids = np.concatenate(found)
    value = pd.util.hash_array(np.array(low, dtype=object), categorize=False)[ids]
    kinds, capital, end = np.array(kind, np.int8)[ids], np.array(capital)[ids], np.array(end)[ids]
    first = np.zeros(len(ids) + 1, bool)
    first[np.cumsum(sizes) - sizes] = True
    first = first[:-1]
    after = np.r_[True, end[:-1]] | first
    kinds[(kinds == UNIT) & (first | (np.r_[WORD_KIND, kinds[:-1]] != NUM))] = WORD_KIND
    kinds[(kinds == WORD_KIND) & capital & ~after] = NAME
    return Tokens(np.where(kinds == WORD_KIND, value, PLACEHOLDERS[kinds]), kinds, value, sizes)


def window_hashes(codes: np.ndarray, width: int, plain: bool) -> np.ndarray:
    """Hash of the ``width`` tokens from each place on; those of other widths and of the other sort are other ones."""
    n = len(codes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, 2 * width + plain, np.uint64)
    for k in range(width):
        out = (out ^ codes[k:n + k]) * STEP
        out ^= out >> np.uint64(29)
    return out


BENCH = "item long, item_id long, total int, plain boolean, width int, hash long, place int, item_values array<long>, kinds array<tinyint>"


def _rows_of(values: np.ndarray, at: np.ndarray, width: int) -> pa.Array:
    """The ``width`` values from each place on, as lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * width, pa.int32()), pa.array(values[(at[:, None] + np.arange(width)).ravel()]))


def benchmark_windows(benchmark: DataFrame, width: int) -> DataFrame:
    """A row per window of every item ``benchmark(item_id, text)``: both sorts, with the item's number of windows of that sort.

    An item under ``width`` words is one window. Equal rows are one item. Null and empty texts have none.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, item_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                t = tokens([text])
                n = int(t.sizes[0])
                w = min(width, n)
                if not w:
                    continue
                literals = np.convolve(t.kinds == WORD_KIND, np.ones(w, int), "valid")
                for plain, codes, at in ((True, t.values, np.arange(n - w + 1)), (False, t.codes, np.flatnonzero(literals >= min(LITERALS, w)))):
                    k = len(at)
                    yield pa.RecordBatch.from_arrays([
                        pa.array([item] * k, pa.int64()), pa.array([item_id] * k, pa.int64()), pa.array([k] * k, pa.int32()), pa.array([plain] * k, pa.bool_()), pa.array([w] * k, pa.int32()),
                        pa.array(window_hashes(codes, w, plain)[at].view(np.int64)), pa.array(at.astype(np.int32)), _rows_of(t.values.view(np.int64), at, w), _rows_of(t.kinds.astype(np.int8), at, w),
                    ], [x.split()[0] for x in BENCH.split(", ")])

    items = benchmark.where("text is not null and item_id is not null").select(F.xxhash64("item_id", "text").alias("item"), F.col("item_id").cast("long").alias("item_id"), "text").dropDuplicates(["item"])
    return written(items.mapInArrow(cut, BENCH), "benchmark-windows")


def hash_filter(windows: DataFrame, bits: int) -> np.ndarray:
    """A bit for each value of the first ``bits`` bits of a hash, set where a window has it; packed in bytes."""
    size = (1 << bits) // FILTER_SLICES

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(1 << bits, bool)
        for batch in batches:
            held[batch.column("hash").to_numpy().view(np.uint64) >> np.uint64(64 - bits)] = True
        out = [(i, np.packbits(held[i * size:(i + 1) * size]).tobytes()) for i in range(FILTER_SLICES) if held[i * size:(i + 1) * size].any()]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in out], pa.int32()), pa.array([b for _, b in out], pa.binary())], ["slice", "held"])

    def joined(table: pa.Table) -> pa.Table:
        every = np.zeros(size // 8, np.uint8)
        for x in table.column("held").to_pylist():
            every |= np.frombuffer(x, np.uint8)
        return pa.table({"slice": table.column("slice")[:1], "held": pa.array([every.tobytes()], pa.binary())})

    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in windows.select("hash").mapInArrow(mark, "slice int, held binary").groupBy("slice").applyInArrow(joined, "slice int, held binary").collect():  # FILTER_SLICES rows
        out[r["slice"] * size // 8:(r["slice"] + 1) * size // 8] = np.frombuffer(r["held"], np.uint8)
    return out


def document_windows(source: DataFrame, held: np.ndarray, bits: int, widths: list[int]) -> DataFrame:
    """Windows of ``source(doc_id, row, text)`` that pass the filter: ``doc_id, row, hash, at``, and for template windows their words' ``doc_values``."""
    id_kind = source.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts_of(batch, "text"):
                t = tokens([x or "" for x in part.column("text").to_pylist()])
                ends = np.cumsum(t.sizes)
                for width in widths:
                    for plain, codes in ((True, t.values), (False, t.codes)):
                        own = window_hashes(codes, width, plain)
                        bit = (own >> np.uint64(64 - bits)).astype(np.int64)
                        at = np.flatnonzero((held[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1)
                        doc = np.searchsorted(ends, at, side="right")
                        inside = at + width <= ends[doc]
                        at, doc = at[inside], doc[inside]
                        if not len(at):
                            continue
                        values = pa.nulls(len(at), pa.list_(pa.int64())) if plain else _rows_of(t.values.view(np.int64), at, width)
                        which = pa.array(doc)
                        yield pa.RecordBatch.from_arrays([part.column("doc_id").take(which), part.column("row").take(which), pa.array(own[at].view(np.int64)), values], ["doc_id", "row", "hash", "doc_values"])

    return source.mapInArrow(cut, f"doc_id {id_kind}, row long, hash long, doc_values array<long>")


def consistent(windows: list[dict]) -> tuple[int, bool]:
    """How many of an item's windows a document holds consistently, and whether any with a changed value.

    ``windows``: ``place, item_values, kinds, doc_values`` of each meeting. A changed value agrees where it is the one that stands at
    most of the item's places of that value; on ties the unchanged one, then the largest. Several item values may become equal.
    """
    stands: dict[tuple[int, int], dict[int, set[int]]] = defaultdict(lambda: defaultdict(set))
    for w in windows:
        for j, (kind, value, told) in enumerate(zip(w["kinds"], w["item_values"], w["doc_values"], strict=True)):
            if kind != WORD_KIND:
                stands[kind, value][told].add(w["place"] + j)
    most = {key: max(told, key=lambda v: (len(told[v]), v == key[1], v)) for key, told in stands.items()}
    held: dict[int, bool] = {}
    for w in windows:
        slots = [(k, v, told) for k, v, told in zip(w["kinds"], w["item_values"], w["doc_values"], strict=True) if k != WORD_KIND]
        if all(told in (v, most[k, v]) for k, v, told in slots):
            held[w["place"]] = held.get(w["place"], True) and any(told != v for _, v, told in slots)
    return len(held), any(held.values())


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [consistent(ws) for ws in batch.column("windows").to_pylist()]
        kept = batch.select(["doc_id", "row", "item_id", "total"])
        yield pa.RecordBatch.from_arrays([*kept.columns, pa.array([n for n, _ in found], pa.int64()), pa.array([new for _, new in found], pa.bool_())], [*kept.schema.names, "n", "reparameterised"])


def matches_of(source: DataFrame, benchmark: DataFrame, width: int, containment: float) -> DataFrame:
    """``(doc_id, row, matches)`` for the contaminated rows of ``source(doc_id, row, text)``; ``matches`` has an item's id, the larger share of its
    windows held, of plain words or consistent, and whether the consistent ones have changed values."""
    windows = benchmark_windows(benchmark, width)
    n = windows.count()
    widths = sorted(r["width"] for r in windows.select("width").distinct().collect())  # at most ``width`` of them
    bits = min(max(FILTER_BITS[0], (16 * n).bit_length()), FILTER_BITS[1])
    hits = document_windows(source, hash_filter(windows, bits), bits, widths)
    asked = windows.drop("width")
    if n <= BROADCAST_WINDOWS:
        met = hits.join(F.broadcast(asked), "hash")
    else:  # a passage in very many documents is SALT keys
        salted = asked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        met = hits.withColumn("salt", F.pmod("row", F.lit(SALT)).cast("int")).join(salted, ["hash", "salt"]).drop("salt")
    met = written(met.drop("hash"), "window-matches")
    pair = ["doc_id", "row", "item", "item_id", "total"]
    enough = F.col("n") >= containment * F.col("total")
    plain = met.where("plain").groupBy(*pair).agg(F.countDistinct("place").alias("n")).where(enough).withColumn("reparameterised", F.lit(False)).drop("item")
    may = met.where("not plain").groupBy(*pair).agg(F.countDistinct("place").alias("n"), F.collect_set(F.struct("place", "item_values", "kinds", "doc_values")).alias("windows")).where(enough).drop("n", "item")
    kind = source.schema["doc_id"].dataType.simpleString()
    template = may.mapInArrow(_checked, f"doc_id {kind}, row long, item_id long, total int, n long, reparameterised boolean").where(enough).where("n > 0")
    best = plain.unionByName(template).withColumn("share", F.col("n") / F.col("total")).groupBy("doc_id", "row", "item_id").agg(F.max("share").alias("containment"), F.max("reparameterised").alias("reparameterised"))
    return best.groupBy("doc_id", "row").agg(F.array_sort(F.collect_list(F.struct("item_id", "containment", "reparameterised"))).alias("matches"))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, row, text`` of documents; rows equal in id and text share a ``row``."""
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(id_col, text_col).alias("row"), F.col(text_col).alias("text"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, containment: float = 0.5) -> DataFrame:
    """One row per document: ``doc_id, contaminated, item_ids, containment`` (the largest), ``reparameterised`` (any match), ``kept``.

    ``benchmark(item_id, text)``: null and empty items and null ids match nothing; repeated items match under each id. Items of
    placeholders alone, and windows with fewer than three plain words, match verbatim copies only, whatever their capitals. A null or empty
    text is clean. Texts are read whole, whatever their length. Repeated rows each get a row; an empty table gives none; an empty
    benchmark leaves every document clean; other columns are left out, so none can clash.
    """
    source = keyed(docs, id_col, text_col)
    found = matches_of(source, benchmark, width, containment).withColumnsRenamed({"doc_id": "match_id", "row": "match_row"})
    told = source.select("doc_id", "row").join(found, (F.col("row") == F.col("match_row")) & F.col("doc_id").eqNullSafe(F.col("match_id")), "left")
    matches = F.coalesce("matches", F.array().cast("array<struct<item_id:bigint,containment:double,reparameterised:boolean>>"))
    return told.select(
        "doc_id", (F.size(matches) > 0).alias("contaminated"), F.transform(matches, lambda m: m["item_id"]).alias("item_ids"),
        F.coalesce(F.array_max(F.transform(matches, lambda m: m["containment"])), F.lit(0.0)).alias("containment"),
        F.exists(matches, lambda m: m["reparameterised"]).alias("reparameterised"), (F.size(matches) == 0).alias("kept"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, containment: float = 0.5) -> DataFrame:
    """The documents that :func:`decontaminate` keeps, with all their columns, of any names. The contaminated rows' keys are written first; Spark
    broadcasts them where their table is small and joins by a shuffle where it isn't."""
    found = written(matches_of(keyed(docs, id_col, text_col), benchmark, width, containment).select(F.col("doc_id").alias("match_id"), F.col("row").alias("match_row")), "contaminated")
    row, match_id, match_row = unused(docs.columns, "row", "match_id", "match_row")
    gone = found.select(F.col("match_id").alias(match_id), F.col("match_row").alias(match_row))
    own = docs.withColumn(row, F.xxhash64(id_col, text_col))
    return own.join(gone, (F.col(row) == F.col(match_row)) & F.col(id_col).eqNullSafe(F.col(match_id)), "left_anti").select(*quoted(*docs.columns))
