"""Suffix-array dedup: maximal repeats of at least ``LENGTH`` bytes, with all occurrences, removed from all but the first document.

A window of ``LENGTH`` bytes is filed under its least hash of ``GRAM`` bytes, so equal windows are filed alike wherever they
stand. Consecutive windows of one file are a stretch, at most ``REACH`` windows long.

1. Blocks of documents tell buckets the files they have; a file of one document alone is done.
2. Blocks send the stretches of the other files to buckets, each different stretch once with its smallest doc_id.
3. A bucket joins equal stretches, sorts the suffixes that others share into an enhanced suffix array, scans its common
   prefixes with a stack, and keeps each prefix interval whose occurrences differ to the left: the maximal repeats. Every
   occurrence of a repeat learns the smallest doc_id among all of them.
4. Blocks mark what smaller documents hold, and cut it out.

A task holds a block of texts or a bucket of stretches. A passage in very many documents sends one stretch per block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundline.llm.common import binary, block_of, by_bucket, dealt_tasks, pack, pieces, runs, text_bytes, unpack

LENGTH, GRAM = 50, 16
REACH = LENGTH - GRAM + 1
#: Bytes whose windows are hashed at once. Blocks are smaller, so only a long text is hashed in several goes.
AT_ONCE = 4 << 20
A, B, C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
LAST_ID = np.iinfo(np.int64).max


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * B
    x ^= x >> np.uint64(29)
    return x * C


@dataclass
class Stretches:
    """Stretches of texts joined in ``data``: where each begins, its number of windows, its text, its file, and a name of its bytes."""

    data: np.ndarray
    begin: np.ndarray
    windows: np.ndarray
    text: np.ndarray
    file: np.ndarray
    name: np.ndarray


def stretches(texts: list[bytes], at_once: int = AT_ONCE) -> Stretches:
    """Stretches of texts, found ``at_once`` bytes at a time: the hashes of a long text are never held together. A stretch over the border
    of two such parts is two stretches, whose windows are the same."""
    data = np.frombuffer(b"".join(texts) + b"\0" * (LENGTH + 8), np.uint8)
    n = len(data) - LENGTH - 8
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    # windows inside one text begin in these ranges
    low, high = (ends - sizes)[sizes >= LENGTH], (ends - LENGTH + 1)[sizes >= LENGTH]
    parts = [_stretches_of(data, at, min(at + at_once, n - LENGTH + 1), low, high) for at in range(0, n - LENGTH + 1, at_once)]
    none = np.zeros(0, np.int64)
    begin, windows, file, name = (np.concatenate([np.zeros(0, k), *x]) for k, x in zip((np.int64, np.int64, np.uint64, np.uint64), zip(*parts, strict=True) if parts else [[none]] * 4, strict=True))
    return Stretches(data, begin, windows, np.searchsorted(ends, begin, side="right"), file.astype(np.uint64), name.astype(np.uint64))


def _stretches_of(data: np.ndarray, first: int, end: int, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where stretches of the windows that begin from ``first`` to ``end`` begin, how many windows they have, their files and names."""
    grams = end - first + REACH - 1
    part = data[first:first + grams + GRAM]
    eight = np.ndarray((grams + 8,), "<u8", part, 0, (1,))
    h = _mixed(eight[:grams] * A ^ (eight[8:grams + 8] + C) * B)
    least, span = h, 1
    while span * 2 <= REACH:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < REACH:
        least = np.minimum(least[:len(least) - (REACH - span)], least[REACH - span:])
    # windows inside one text, and where they change their file or text
    use = np.zeros(len(least) + 1, np.int32)
    np.add.at(use, np.clip(low - first, 0, len(least)), np.int32(1))
    np.add.at(use, np.clip(high - first, 0, len(least)), np.int32(-1))
    at = np.flatnonzero(np.cumsum(use[:-1]) > 0)
    value = least[at]
    new = np.flatnonzero(np.r_[True, (value[1:] != value[:-1]) | (at[1:] != at[:-1] + 1)]) if len(at) else at
    count = np.diff(np.r_[new, len(at)])
    # runs over REACH windows, in texts that repeat themselves, are cut
    cuts = -(-count // REACH)
    start = np.repeat(new, cuts) + REACH * (np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts))
    begin, windows = at[start], np.minimum(REACH, np.repeat(new + count, cuts) - start)
    last = begin + windows - 1

    def hashed(p: np.ndarray) -> np.ndarray:
        out = np.zeros(len(p), np.uint64)
        for k in (0, GRAM, 2 * GRAM, LENGTH - GRAM):
            out = _mixed(out * A ^ h[p + k])
        return out

    return begin + first, windows, value[start], _mixed(hashed(begin) * A ^ hashed(last) + windows.astype(np.uint64))


def _bytes_of(table: pa.Table) -> tuple[list[bytes], np.ndarray]:
    """Texts in UTF-8, a null as empty, and ids, a null after all others."""
    ids = np.array([LAST_ID if i is None else i for i in table.column("doc_id").to_pylist()], np.int64)
    return [(t or "").encode("utf-8", "replace") for t in table.column("text").to_pylist()], ids


def _table(rows: list[tuple], names: list[str]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [[] for _ in names]
    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * (len(names) - 2)]
    return pa.Table.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)


def ask_files(table: pa.Table, n_buckets: int) -> pa.Table:
    """A block's files by bucket, and whether two of its documents have each."""
    texts, ids = _bytes_of(table)
    s = stretches(texts)
    order = np.argsort(s.file)
    at = runs(s.file[order])
    files, owner = s.file[order][at], ids[s.text[order]]
    shared = (np.minimum.reduceat(owner, at) != np.maximum.reduceat(owner, at)) if len(at) else np.zeros(0, bool)
    first = np.minimum.reduceat(owner, at) if len(at) else owner
    block = table.column("block")[0].as_py()
    of = (files % np.uint64(n_buckets)).astype(np.int64)
    return _table([(b, block, pack(files[o] >> np.uint64(24)), pack(np.where(shared[o], -1, first[o]))) for b, o in by_bucket(of)], ["bucket", "block", "keys", "owners"])


def answer_files(table: pa.Table) -> pa.Table:
    """For each block, a byte per file: whether two documents have it."""
    asked = [unpack(x, "u8") for x in binary(table, "keys")]
    keys, owners = np.concatenate(asked), np.concatenate([unpack(x, "i8") for x in binary(table, "owners")])
    order = np.argsort(keys)
    at = runs(keys[order])
    low, high = np.minimum.reduceat(owners[order], at), np.maximum.reduceat(owners[order], at)
    uniq, shared = keys[order][at], (low < high) | (low == -1)
    told = [pack(shared[np.searchsorted(uniq, own)].astype(np.uint8)) for own in asked]
    return pa.Table.from_arrays([table.column("block").combine_chunks(), table.column("bucket").combine_chunks(), pa.array(told, pa.binary())], ["block", "bucket", "values"])


def send_stretches(docs: pa.Table, told: pa.Table, n_files: int, n_buckets: int) -> pa.Table:
    """A block's different stretches of shared files, by bucket, with their bytes and smallest doc_id."""
    texts, ids = _bytes_of(docs)
    s = stretches(texts)
    files = np.unique(s.file)
    shared = np.zeros(len(files), bool)
    answers = dict(zip(told.column("bucket").to_pylist(), binary(told, "values"), strict=True))
    for b, o in by_bucket((files % np.uint64(n_files)).astype(np.int64)):
        shared[o] = unpack(answers[b], "u1") > 0
    mine = np.flatnonzero(shared[np.searchsorted(files, s.file)])
    order = mine[np.lexsort((ids[s.text[mine]], s.name[mine]))]
    order = order[runs(s.name[order])]  # of equal stretches, that of the smallest id
    block = docs.column("block")[0].as_py()
    of = ((s.file[order] >> np.uint64(20)) % np.uint64(n_buckets)).astype(np.int64)
    rows = []
    for b, o in by_bucket(of):
        own = order[o]
        length = s.windows[own] + LENGTH - 1
        place = np.repeat(s.begin[own] - (np.cumsum(length) - length), length) + np.arange(length.sum())
        rows.append((b, block, pack(s.name[own]), pack(length.astype(np.uint8)), pack(s.data[place]), pack(ids[s.text[own]])))
    return _table(rows, ["bucket", "block", "names", "lengths", "bytes", "owners"])


def suffix_array(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes at ``starts`` (each up to its ``ends``), and common prefixes of neighbours in that order."""
    words = -(-int((ends - starts).max()) // 8)
    padded = np.concatenate([data, np.zeros(8 * words + 8, np.uint8)])
    eight = np.ndarray((len(padded) - 7,), ">u8", padded, 0, (1,))
    left = ends - starts
    columns = []
    for k in range(words):
        w = eight[np.minimum(starts + 8 * k, len(eight) - 1)].astype(np.uint64)
        over = np.clip(8 * (k + 1) - left, 0, 8).astype(np.uint64) * np.uint64(8)  # bits past the end count as zero
        columns.append(np.where(over >= 64, np.uint64(0), (w >> np.minimum(over, np.uint64(63))) << np.minimum(over, np.uint64(63))))
    order = np.lexsort((left, *columns[::-1]))
    prefix, going = np.zeros(len(order), np.int64), np.ones(max(0, len(order) - 1), bool)
    for c in columns:
        x = c[order]
        diff = x[1:] ^ x[:-1]
        same = np.zeros(len(diff), np.int64)
        for byte in range(8):
            same += (diff >> np.uint64(56 - 8 * byte)) == 0
        prefix[1:] += np.where(going, same, 0)
        going &= diff == 0
    prefix[1:] = np.minimum(prefix[1:], np.minimum(left[order][1:], left[order][:-1]))
    return order, prefix


def maximal_repeats(order: np.ndarray, prefix: np.ndarray, before: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """Common-prefix intervals ``(length, first, end)`` of at least ``least`` bytes whose occurrences differ to the left.

    ``before`` is the byte before each suffix, or a negative number of its own where the text begins. A stack scan of the
    prefixes closes an interval where they fall; an interval carries the byte its occurrences share to the left, or -1.
    """
    def joined(x: int, y: int) -> int:
        return x if x == y else -1

    stack: list[list[int]] = []  # length, first place, byte to the left
    left = before[order].tolist()
    lengths = [*prefix.tolist()[1:], 0]
    for i, here in enumerate(lengths):
        first, own = i, left[i] if left[i] >= 0 else -1
        while stack and stack[-1][0] > here:
            length, first, byte = stack.pop()
            own = joined(byte, own)
            if own == -1:
                yield length, first, i + 1
        if stack and stack[-1][0] == here:
            stack[-1][2] = joined(stack[-1][2], own)
        elif here >= least:
            stack.append([here, first, own])


def repeats(names: np.ndarray, lengths: np.ndarray, data: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For stretches of different names: parts of them, as a stretch, its first and end window, and the smallest owner of that part.

    Every stretch's own windows come with its own owner first; repeats add parts with the owners of other stretches.
    """
    ends = np.cumsum(lengths)
    begin, windows = ends - lengths, lengths - LENGTH + 1
    stretch = np.repeat(np.arange(len(lengths)), windows)
    starts = np.repeat(begin - (np.cumsum(windows) - windows), windows) + np.arange(windows.sum())
    eight = np.ndarray((len(data),), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), 0, (1,))
    code = np.zeros(len(starts), np.uint64)
    for k in (*range(0, LENGTH - 8, 8), LENGTH - 8):
        code = _mixed(code * A ^ eight[starts + k])
    by_code = np.argsort(code)
    same = code[by_code][1:] == code[by_code][:-1]
    shared = np.unique(np.r_[by_code[1:][same], by_code[:-1][same]])  # only these can be in an interval of LENGTH or more
    parts = [(np.arange(len(lengths)), np.zeros(len(lengths), np.int64), windows, owners)]
    if len(shared):
        at, of = starts[shared], stretch[shared]
        before = np.where(at > begin[of], data[np.maximum(at - 1, 0)].astype(np.int64), -1)
        order, prefix = suffix_array(data, at, ends[of])
        for length, first, end in maximal_repeats(order, prefix, before, LENGTH):
            places = order[first:end]
            offset = at[places] - begin[of[places]]
            parts.append((of[places], offset, offset + length - LENGTH + 1, np.full(end - first, owners[of[places]].min())))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def answer_stretches(table: pa.Table) -> pa.Table:
    """For each block, parts of its stretches and the smallest document that holds each."""
    names = [unpack(x, "u8") for x in binary(table, "names")]
    owners, lengths = [unpack(x, "i8") for x in binary(table, "owners")], [unpack(x, "u1").astype(np.int64) for x in binary(table, "lengths")]
    every, owner, length = np.concatenate(names), np.concatenate(owners), np.concatenate(lengths)
    order = np.argsort(every, kind="stable")
    at = runs(every[order])
    uniq, least, one = every[order][at], np.minimum.reduceat(owner[order], at), order[at]
    data = np.concatenate([unpack(x, "u1") for x in binary(table, "bytes")])
    from_ = np.cumsum(length) - length
    own = length[one]
    place = np.repeat(from_[one] - (np.cumsum(own) - own), own) + np.arange(own.sum())
    stretch, first, end, smallest = repeats(uniq, own, data[place], least)
    by = np.lexsort((first, stretch))
    stretch, first, end, smallest = stretch[by], first[by], end[by], smallest[by]
    low = np.searchsorted(stretch, np.arange(len(uniq) + 1))
    rows = []
    for block, bucket, mine, had in zip(table.column("block").to_pylist(), table.column("bucket").to_pylist(), names, owners, strict=True):
        i = np.searchsorted(uniq, mine)
        n = low[i + 1] - low[i]
        take = np.repeat(low[i] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        name, before = np.repeat(mine, n), np.repeat(had, n)
        keep = smallest[take] < before  # what the block itself holds it knows
        take, name = take[keep], name[keep]
        rows.append((block, bucket, pack(name), pack(first[take].astype(np.uint8)), pack(end[take].astype(np.uint8)), pack(smallest[take])))
    return _table(rows, ["block", "bucket", "names", "firsts", "ends", "owners"])


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, span_starts array<long>, span_ends array<long>, kept binary"


def cut_out(docs: pa.Table, told: pa.Table, with_text: bool) -> pa.Table:
    """A block's documents without the bytes that smaller documents hold."""
    texts, ids = _bytes_of(docs)
    s = stretches(texts)
    names, firsts, ends, owners = (np.concatenate([np.zeros(0, k), *(unpack(x, k) for x in binary(told, c))]) for c, k in (("names", "u8"), ("firsts", "u1"), ("ends", "u1"), ("owners", "i8")))
    order = np.argsort(names, kind="stable")
    names = names[order]
    low, high = np.searchsorted(names, s.name, side="left"), np.searchsorted(names, s.name, side="right")
    n = high - low
    which, part = np.repeat(np.arange(len(n)), n), order[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())]
    mine = owners[part] < ids[s.text[which]]
    which, part = which[mine], part[mine]
    # whole stretches that a smaller document of the block has too
    by_name = np.lexsort((ids[s.text], s.name))
    at = runs(s.name[by_name])
    least = np.empty(len(by_name), np.int64)
    least[by_name] = np.repeat(ids[s.text[by_name[at]]], np.diff(np.r_[at, len(by_name)]))
    own = np.flatnonzero(least < ids[s.text])
    step = np.zeros(sum(map(len, texts)) + 1, np.int32)
    np.add.at(step, np.r_[s.begin[which] + firsts[part], s.begin[own]], np.int32(1))
    np.add.at(step, np.r_[s.begin[which] + ends[part].astype(np.int64), s.begin[own] + s.windows[own]] + LENGTH - 1, np.int32(-1))
    gone = np.cumsum(step[:-1], out=step[:-1]) > 0
    rows, begin = [], 0
    for i, t in zip(docs.column("doc_id").to_pylist(), texts, strict=True):
        mask = gone[begin:begin + len(t)]
        begin += len(t)
        edges = np.flatnonzero(np.diff(np.r_[False, mask, False].astype(np.int8)))
        kept = np.frombuffer(t, np.uint8)[~mask].tobytes() if len(edges) else t
        rows.append((i, len(t), int(mask.sum()), len(edges) // 2, hashlib.sha256(kept).hexdigest(), edges[::2], edges[1::2], kept if with_text else None))
    columns = list(zip(*rows, strict=True))
    long, longs = pa.int64(), pa.list_(pa.int64())
    kinds = [long, long, long, long, pa.string(), longs, longs, pa.binary()]
    return pa.Table.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in RESULT.split(", ")])


def remove_repeats(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 2 << 20, file_bucket_bytes: int = 32 << 20, stretch_bucket_bytes: int = 8 << 20, with_text: bool = True,
) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``, the removed spans and the ``kept`` bytes.

    A byte of a text goes if a window of ``LENGTH`` bytes over it also stands in a document of smaller id, both as they came in.
    Repeats inside one document, and between rows of equal id, stay. A null text is an empty one, and a null id comes after all
    others. Texts of any length are searched whole; those under ``LENGTH`` bytes are kept. Removal may cut a character
    in two, so kept text is bytes. Repeated rows each get a row; an empty table gives none; other columns are left out.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n_bytes = text_bytes(source, "text")
    n_blocks, n_files, n_stretches = pieces(n_bytes, block_bytes, 2), pieces(n_bytes, file_bucket_bytes), pieces(n_bytes, stretch_bucket_bytes, 2)
    tasks = dealt_tasks(n_bytes)
    dealt = source.select(block_of(n_blocks, "doc_id", "text"), "doc_id", "text").repartition(tasks, "block")
    asked = dealt.groupBy("block").applyInArrow(lambda t: ask_files(t, n_files), "bucket int, block int, keys binary, owners binary").repartition(dealt_tasks(n_bytes, file_bucket_bytes, 2), "bucket")
    told = asked.groupBy("bucket").applyInArrow(answer_files, "block int, bucket int, values binary").repartition(tasks, "block")
    sent = dealt.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(lambda d, t: send_stretches(d, t, n_files, n_stretches), "bucket int, block int, names binary, lengths binary, bytes binary, owners binary")
    parts = sent.repartition(tasks, "bucket").groupBy("bucket").applyInArrow(answer_stretches, "block int, bucket int, names binary, firsts binary, ends binary, owners binary").repartition(tasks, "block")
    return dealt.groupBy("block").cogroup(parts.groupBy("block")).applyInArrow(lambda d, t: cut_out(d, t, with_text), RESULT)
