"""LM scoring by prediction by partial matching: a byte-context trie with escapes (method C) and symbol exclusion.

The trie is trained on the corpus. Contexts of ``ORDER`` bytes down to none are tried in turn: a symbol seen there is coded by
its count, else an escape is coded and the next shorter context takes over without the symbols already ruled out; below the
empty context the remaining byte values are equally likely.

Nobody holds the whole trie. Blocks of documents count their grams (a context and the byte after it) and send the distinct
ones to buckets by the context's last three bytes, so a bucket has every context of three bytes or more that it needs to
walk from the longest to the shortest. It answers each block with the log probability of the grams the block has, and the
block adds them up per document. Contexts of two bytes or fewer are a table of at most 2^24 counts, given to all buckets.
Word counts for the base score go the same way. So what a task holds depends on its block or bucket, not on the corpus.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from itertools import count as count_up

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundline.llm.common import binary, block_of, by_bucket, dealt_tasks, pack, pieces, runs, text_bytes, unpack, written

ORDER = 5
CHUNK = 1 << 18
#: Keys that wait for their counts to be added up; a block of short texts has fewer.
PENDING = 4 << 20
#: Stands for the end of a text among words, which are what bytes split into at ASCII white space; no word contains a line feed.
END = b"\n"
BLANK = re.compile(rb"[ \t\n\v\f\r]")
MIXER = np.uint64(0x9E3779B97F4A7C15)


def lowered(text: str | None) -> bytes:
    """UTF-8 bytes with A-Z in lower case; lone surrogates, which UTF-8 lacks, become question marks."""
    return (text or "").encode("utf-8", "replace").lower()


def grams(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of each piece after its first ``ORDER``: the ``ORDER`` bytes before it and itself, as one number; and where each
    piece's grams begin."""
    data = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64)
    lengths = np.fromiter((len(t) - ORDER for t in pieces), np.int64, len(pieces))
    n = len(data) - ORDER
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    whole = np.zeros(n, np.int64)
    for j in range(ORDER + 1):
        whole = (whole << 8) | data[j:n + j]
    keep = np.ones(n, bool)
    first = np.cumsum(lengths + ORDER)[:-1] - ORDER  # grams that end in the first bytes of a piece
    for j in range(ORDER):
        keep[first + j] = False
    return whole[keep], np.cumsum(lengths) - lengths


def padded(texts: Iterable[bytes], size: int = CHUNK) -> Iterator[tuple[int, bytes]]:
    """Texts with ``ORDER`` zero bytes before and one after them, and their numbers; a long one in pieces of ``size`` bytes, each
    with the ``ORDER`` bytes before it."""
    for i, t in enumerate(texts):
        if len(t) <= size:
            yield i, b"\0" * ORDER + t + b"\0"
            continue
        for at in range(0, len(t), size):
            before = b"\0" * ORDER + t[max(0, at - ORDER):at]
            yield i, before[-ORDER:] + t[at:at + size] + (b"\0" if at + size >= len(t) else b"")


def chunks(texts: Iterable[bytes], size: int = CHUNK) -> Iterator[tuple[list[int], list[bytes]]]:
    """The pieces of texts, and the texts they are of, about ``size`` bytes at a time."""
    of: list[int] = []
    some: list[bytes] = []
    n = 0
    for i, piece in padded(texts, size):
        of.append(i)
        some.append(piece)
        n += len(piece)
        if n >= size:
            yield of, some
            of, some, n = [], [], 0
    if some:
        yield of, some


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with their counts added."""
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k)
    k, c = k[order], c[order]
    at = runs(k)
    return k[at], np.add.reduceat(c, at) if len(at) else c


class Sums:
    """Counts by key, added up whenever ``PENDING`` keys more wait than are held, so that those of a long text don't pile up."""

    def __init__(self) -> None:
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys.append(keys)
        self.counts.append(counts)
        if sum(map(len, self.keys[1:])) > PENDING + len(self.keys[0]):
            self.total()

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = summed(self.keys, self.counts)
        self.keys, self.counts = [keys], [counts]
        return keys, counts


def count_grams(into: Sums, texts: list[bytes], weight: int) -> None:
    for _, some in chunks(texts):
        k, c = np.unique(grams(some)[0], return_counts=True)
        into.add(k, c * weight)


def gram_counts(texts: list[bytes], weight: int) -> tuple[np.ndarray, np.ndarray]:
    sums = Sums()
    count_grams(sums, texts, weight)
    return sums.total()


def cut(text: bytes, size: int = CHUNK) -> Iterator[bytes]:
    """A text in parts of ``size`` bytes or little more, cut at white space, so that no word is cut; an empty text is one part."""
    at = 0
    while len(text) - at > size:
        blank = BLANK.search(text, at + size)
        end = blank.start() if blank else len(text)
        yield text[at:end]
        at = end
    if at < len(text) or not text:
        yield text[at:]


def word_lists(texts: list[bytes], size: int = CHUNK) -> Iterator[list[bytes]]:
    """All words of texts, those of about ``size`` bytes at a time."""
    some, n = [], 0
    for part in (p for t in texts for p in cut(t, size)):
        some.append(part)
        n += len(part)
        if n >= size:
            yield b"\n".join(some).split()
            some, n = [], 0
    if some:
        yield b"\n".join(some).split()


def word_keys(words: list[bytes]) -> np.ndarray:
    """64-bit keys of words."""
    return pd.util.hash_array(np.array(words, dtype=object), categorize=False) if words else np.zeros(0, np.uint64)


def gram_bucket(keys: np.ndarray, n: int) -> np.ndarray:
    mixed = ((keys >> 8) & 0xFFFFFF).astype(np.uint64) * MIXER
    return ((mixed >> np.uint64(33)) % np.uint64(n)).astype(np.int64)


class Short:
    """Contexts of two, one and no bytes: sorted keys and counts of (two bytes, symbol), and what the shorter ones sum to."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys, self.c2 = keys.astype(np.int64), counts.astype(np.float64)
        self.c1 = np.bincount(self.keys & 0xFFFF, self.c2, 1 << 16)
        self.c0 = np.bincount(self.keys & 0xFF, self.c2, 1 << 8)
        ctx2 = self.keys >> 8
        self.n2, self.d2 = np.bincount(ctx2, self.c2, 1 << 16), np.bincount(ctx2, minlength=1 << 16).astype(float)
        seen1 = np.flatnonzero(self.c1)
        self.n1, self.d1 = np.bincount(seen1 >> 8, self.c1[seen1], 256), np.bincount(seen1 >> 8, minlength=256).astype(float)
        self.n0, self.d0 = self.c0.sum(), float((self.c0 > 0).sum())
        self.e1 = np.bincount(ctx2, self.c1[self.keys & 0xFFFF], 1 << 16)  # of order one, what two bytes rule out
        self.e0 = np.bincount(seen1 >> 8, self.c0[seen1 & 0xFF], 256)

    def count2(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(keys))
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.c2[at], 0.0)


def log_probabilities(keys: np.ndarray, counts: np.ndarray, short: Short) -> np.ndarray:
    """log10 of the trie's probability for each of the distinct, ascending ``keys`` with their training ``counts``.

    The keys must hold every trained gram whose context ends in the same three bytes as one of theirs.
    """
    out, open_ = np.zeros(len(keys)), np.ones(len(keys), bool)
    levels = {}
    for k in range(3, ORDER + 1):
        own = keys & ((1 << 8 * (k + 1)) - 1)
        order = np.argsort(own)
        at = runs(own[order])
        uniq, total = own[order][at], np.add.reduceat(counts[order].astype(np.float64), at)
        where = np.empty(len(keys), np.int64)
        where[order] = np.repeat(np.arange(len(at)), np.diff(np.r_[at, len(keys)]))
        ctx_at = runs(uniq >> 8)
        ctx = np.repeat(np.arange(len(ctx_at)), np.diff(np.r_[ctx_at, len(uniq)]))
        lower = levels[k - 1][1][np.searchsorted(levels[k - 1][0], uniq & ((1 << 8 * k) - 1))] if k > 3 else short.count2(uniq & 0xFFFFFF)
        seen = total > 0
        levels[k] = uniq, total, where, ctx, np.add.reduceat(total, ctx_at), np.add.reduceat(seen.astype(float), ctx_at), np.add.reduceat(np.where(seen, lower, 0.0), ctx_at)

    def step(c, n, d, e, dx):
        """Codes the open keys at one order, given counts, totals, distinct symbols and what was ruled out above."""
        nonlocal open_
        n, d = n - e, d - dx
        there = open_ & (d > 0)
        hit = there & (c > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            out[:] += np.where(hit, np.log10(c / (n + d)), 0.0) + np.where(there & ~hit, np.log10(d / (n + d)), 0.0)
        open_ &= ~hit

    e = dx = np.zeros(len(keys))
    for k in range(ORDER, 2, -1):
        uniq, total, where, ctx, n, d, lower = levels[k]
        own = ctx[where]
        step(total[where], n[own], d[own], e, dx)
        e, dx = lower[own], d[own]
    two, one, sym = (keys >> 8) & 0xFFFF, (keys >> 8) & 0xFF, keys & 0xFF
    step(short.count2(keys & 0xFFFFFF), short.n2[two], short.d2[two], e, dx)
    step(short.c1[keys & 0xFFFF], short.n1[one], short.d1[one], short.e1[two], short.d2[two])
    step(short.c0[sym], short.n0, short.d0, short.e0[one], short.d1[one])
    out[open_] -= np.log10(256.0 - short.d0)
    return out


def short_table(docs: DataFrame) -> Short:
    """Counts of three-byte grams over the training rows of ``docs(text, held_out)``: at most 2^24 of them, whatever the corpus."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, counts = [], []
            for _, some in chunks([lowered(t) for t in batch.column("text").to_pylist()]):
                k, c = np.unique((grams(some)[0] & 0xFFFFFF).astype(np.int32), return_counts=True)
                keys.append(k)
                counts.append(c)
            k, c = summed(keys, counts)
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(c, pa.int64())], ["gram", "n"])

    rows = docs.where(~F.col("held_out")).select("text").mapInArrow(count, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    found = rows.toPandas().sort_values("gram")
    return Short(found["gram"].to_numpy(np.int64), found["n"].to_numpy())


ASK = "bucket int, block int, keys binary, counts binary"
ANSWER = "block int, bucket int, values binary, distinct long"
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, log_counts double, score double, train_tokens long, distinct long"


def asks(table: pa.Table, n_grams: int, n_words: int) -> pa.Table:
    """What a block asks: its distinct grams and words by bucket, with their counts in its training texts."""
    block = table.column("block")[0].as_py()
    texts, held = [lowered(t) for t in table.column("text").to_pylist()], table.column("held_out").to_pylist()
    train, rest = [t for t, h in zip(texts, held, strict=True) if not h], [t for t, h in zip(texts, held, strict=True) if h]
    sums = Sums()
    count_grams(sums, train, 1)
    count_grams(sums, rest, 0)
    k, c = sums.total()
    bucket = gram_bucket(k, n_grams)
    words: Counter[bytes] = Counter()
    for found in word_lists(train):
        words.update(found)
    words[END] += len(train)
    for found in word_lists(rest):
        words.update(dict.fromkeys(found, 0))
    wk, wc = summed([word_keys(list(words))], [np.fromiter(words.values(), np.int64, len(words))])
    rows = []
    for key, count, of, shift in ((k, c, bucket, 0), (wk, wc, (wk % np.uint64(n_words)).astype(np.int64), n_grams)):
        rows += [(b + shift, block, pack(key[own]), pack(count[own].astype(np.int64))) for b, own in by_bucket(of)]
    columns = list(zip(*rows, strict=True))
    return pa.Table.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.binary()), pa.array(columns[3], pa.binary())], ["bucket", "block", "keys", "counts"])


def answers(table: pa.Table, n_grams: int, short: Short) -> pa.Table:
    """What a bucket answers: for each block, values in the order of its keys. Grams get log probabilities, words counts."""
    bucket = table.column("bucket")[0].as_py()
    is_gram = bucket < n_grams
    asked = [unpack(x, "i8" if is_gram else "u8") for x in binary(table, "keys")]
    k, c = summed(asked, [unpack(x, "i8") for x in binary(table, "counts")])
    values = log_probabilities(k, c, short).astype(np.float32) if is_gram else c
    blocks = table.column("block").to_pylist()
    first = min(blocks)  # the bucket's distinct trained words are told to one block only
    distinct = 0 if is_gram else int((c > 0).sum())
    return pa.Table.from_arrays([
        pa.array(blocks, pa.int32()), pa.array([bucket] * len(blocks), pa.int32()), pa.array([pack(values[np.searchsorted(k, own)]) for own in asked], pa.binary()),
        pa.array([distinct if b == first else 0 for b in blocks], pa.int64()),
    ], ["block", "bucket", "values", "distinct"])


def scores(docs: pa.Table, told: pa.Table, n_grams: int, n_words: int) -> pa.Table:
    """A block's documents with their scores, and a row without score that carries its counts of training tokens and words."""
    texts = [lowered(t) for t in docs.column("text").to_pylist()]
    held = docs.column("held_out").to_pylist()
    answered = {b: (v, told.column("values")[i].as_py()) for i, (b, v) in enumerate(zip(told.column("bucket").to_pylist(), told.column("distinct").to_pylist(), strict=True))}
    asked, starts, keys, pieces_of, every = [], [], [], [], Sums()
    for of, some in chunks(texts):  # each chunk's distinct grams, and for each of its bytes which one it is
        g, begin = grams(some)
        order = np.argsort(g)
        at = runs(g[order])
        place = np.empty(len(g), np.int32)
        place[order] = np.repeat(np.arange(len(at), dtype=np.int32), np.diff(np.r_[at, len(g)]))
        keys.append(g[order][at])
        every.add(keys[-1], np.zeros(len(at), np.int8))
        asked.append(place)
        starts.append(begin)
        pieces_of.append(of)
    k = every.total()[0]
    del every
    value = np.empty(len(k))
    for b, own in by_bucket(gram_bucket(k, n_grams)):
        value[own] = unpack(answered[b][1], "f4")
    number: defaultdict[bytes, int] = defaultdict(count_up().__next__)
    end = number[END]
    tokens = [np.concatenate([np.fromiter(map(number.__getitem__, found := part.split()), np.int32, len(found)) for part in cut(t)]) for t in texts]
    wk = word_keys(list(number))
    uniq, back = np.unique(wk, return_inverse=True)
    count = np.empty(len(uniq), np.int64)
    for b, own in by_bucket((uniq % np.uint64(n_words)).astype(np.int64)):
        count[own] = unpack(answered[n_grams + b][1], "i8")
    c_of = count[back]
    log_of, known = np.log10(c_of + 1.0), c_of > 0
    score = np.zeros(len(texts))
    for own, place, begin, of in zip(keys, asked, starts, pieces_of, strict=True):
        np.add.at(score, of, np.add.reduceat(value[np.searchsorted(k, own)][place], begin))
    n_tokens = [len(t) + 1 for t in tokens]
    n_known = [int(known[t].sum() + known[end]) for t in tokens]
    logs = [float(log_of[t].sum() + log_of[end]) for t in tokens]
    train = sum(n for n, h in zip(n_tokens, held, strict=True) if not h)
    distinct = sum(v for v, _ in answered.values())
    ids = docs.column("doc_id").to_pylist()
    pad = [None] * len(ids)
    return pa.Table.from_arrays([
        pa.array([*ids, None], pa.int64()), pa.array([*held, None], pa.bool_()), pa.array([*n_tokens, None], pa.int64()), pa.array([*n_known, None], pa.int64()),
        pa.array([*logs, None], pa.float64()), pa.array([*score, None], pa.float64()), pa.array([*pad, train], pa.int64()), pa.array([*pad, distinct], pa.int64()),
    ], ["doc_id", "held_out", "n_tokens", "n_known", "log_counts", "score", "train_tokens", "distinct"])


def score_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held_out_fold: int = 2, block_bytes: int = 6 << 20, bucket_bytes: int = 16 << 20) -> DataFrame:
    """Scores every text: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    The model learns from the rows whose ``crc32(doc_id) mod folds`` isn't ``held_out_fold`` and scores them all. ``score`` is
    the trie's log10 probability of the text's bytes, A-Z lowered, and of its end; ``base_score`` that of its words and its end
    under add-one counts. A null text is an empty one: its end is all that is scored. A null id counts as the empty string.
    Repeated rows each get a row and each count; an empty table gives none; other columns are left out, so none can clash.
    """
    crc = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), (F.pmod(crc, F.lit(folds)) == held_out_fold).alias("held_out"))
    n_bytes = text_bytes(source, "text")
    n_blocks, n_grams, n_words = pieces(n_bytes, block_bytes, 2), pieces(n_bytes, bucket_bytes, 2), pieces(n_bytes, 4 * bucket_bytes)
    short = short_table(source)
    tasks = dealt_tasks(n_bytes)
    dealt = source.select(block_of(n_blocks, "doc_id", "text"), "doc_id", "text", "held_out").repartition(tasks, "block")
    asked = dealt.groupBy("block").applyInArrow(lambda t: asks(t, n_grams, n_words), ASK).repartition(tasks, "bucket")
    told = asked.groupBy("bucket").applyInArrow(lambda t: answers(t, n_grams, short), ANSWER).repartition(tasks, "block")
    rows = written(dealt.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(lambda d, t: scores(d, t, n_grams, n_words), SCORED), "ppm-scores")
    totals = rows.where(F.col("n_tokens").isNull()).agg(F.sum("train_tokens").alias("n"), F.sum("distinct").alias("v")).first()
    n, v = totals["n"] or 0, totals["v"] or 0
    return rows.where(F.col("n_tokens").isNotNull()).select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"),
        (F.col("log_counts") - F.col("n_tokens") * F.log10(F.lit(float(n + v + 1)))).alias("base_score"), "score",
    )
