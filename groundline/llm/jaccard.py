"""N-gram Jaccard join by T-occurrence search, exact, over sets of word shingles.

1. Blocks of documents send their distinct shingles to buckets, which count in how many sets each occurs and answer. A shingle
   of one set alone can't be shared, so documents with too few shared shingles have no partner and are done.
2. The others are nodes, one for each different set. Under the order of rising frequency, sets that reach the threshold share
   a shingle among their first few (prefix filter); nodes joined by such shingles form candidate groups.
3. In a group, documents are searched by T-occurrence (DivideSkip): a query's short inverted lists are merged by a heap of their
   heads, which skips what too few of them hold, its long ones are only probed by binary search for documents that may still
   reach the overlap ``T``, and the exact test on set sizes follows. Small groups share a task. A large group is dealt in the cheaper of two ways: by its shingles, each node once
   with every task that has one of its first few (groups that boilerplate chains together), or as blocks whose pairs are tasks
   (copies, which share all their shingles). A task of too many nodes is pairs of blocks too, so none holds more than two
   blocks. It returns links folded to one edge a document, and numbers of links, never its pairs; a pair that meets in several
   tasks counts in that of its first common shingle.
4. Components of the edges give each document the smallest id it is linked to.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from heapq import heapify, heappop, heappush
from itertools import count as count_up

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundline.llm.common import WORD, binary, block_of, by_bucket, dealt_tasks, pack, pieces, quoted, runs, text_bytes, unpack, unused, written
from groundline.operators.components import components

STEPS = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93], np.uint64)
#: Bits of a shingle's hash that buckets compare; the search compares all 64.
KEY_BITS = np.uint64(24)
#: Nodes in a block of a candidate group.
GROUP = 512
#: DivideSkip's weight of a probe against a merged posting.
MU = 0.0085


def _mixed(x: np.ndarray, step: np.uint64) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * step
    return x ^ (x >> np.uint64(27))


def shingle_sets(texts: list[str | None], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's distinct shingles, ascending within a text, and how many each text has.

    Bytes split at ASCII white space and nothing else, which is what words are here.
    """
    number: defaultdict[bytes, int] = defaultdict(count_up().__next__)
    found = [np.fromiter(map(number.__getitem__, w := (t or "").encode("utf-8", "replace").lower().split()), np.int32, len(w)) for t in texts]
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    if not number:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    code = pd.util.hash_array(np.array(list(number), dtype=object), categorize=False)[np.concatenate(found)]
    ends = np.cumsum(sizes)
    rolled = np.zeros(len(code), np.uint64)
    for k in range(min(width, len(code))):
        rolled[:len(code) - k] = _mixed(rolled[:len(code) - k] ^ code[k:], STEPS[k % 4] + np.uint64(2 * k))
    short = np.flatnonzero((sizes > 0) & (sizes < width))
    for i in short.tolist():  # a text of fewer words is one shingle
        whole = np.zeros(1, np.uint64)
        for k in range(width):
            whole = _mixed(whole ^ (code[ends[i] - sizes[i] + k] if k < sizes[i] else np.uint64(0)), STEPS[k % 4] + np.uint64(2 * k))
        rolled[ends[i] - sizes[i]] = whole[0]
    n = np.where(sizes >= width, sizes - width + 1, sizes > 0)
    begin = np.cumsum(n) - n
    rolled = rolled[np.repeat(ends - sizes - begin, n) + np.arange(n.sum())]
    for a, b in zip(begin.tolist(), (begin + n).tolist(), strict=True):
        rolled[a:b].sort()
    keep = np.ones(len(rolled), bool)
    keep[1:] = rolled[1:] != rolled[:-1]
    keep[begin[n > 0]] = True
    return rolled[keep], np.add.reduceat(np.r_[keep, False].astype(np.int64), np.minimum(begin, len(keep))) * (n > 0)


def set_names(hashes: np.ndarray, sizes: np.ndarray) -> list[bytes | None]:
    """128 bits that name each set; None for the empty one."""
    some = np.flatnonzero(sizes)
    begin = (np.cumsum(sizes) - sizes)[some]
    out: list[bytes | None] = [None] * len(sizes)
    if len(some):
        halves = [np.add.reduceat(_mixed(_mixed(hashes, a), b), begin) for a, b in ((STEPS[0], STEPS[1]), (STEPS[2], STEPS[3]))]
        for i, name in zip(some.tolist(), np.stack(halves, axis=1).astype(">u8"), strict=True):
            out[i] = name.tobytes()
    return out


def least_overlap(n: np.ndarray | int, num: int, den: int) -> np.ndarray | int:
    """Smallest overlap that a set of ``n`` has with a partner at similarity ``num / den``."""
    return -(-num * n // den)


def key_bytes(keys: np.ndarray) -> bytes:
    """Keys of 40 bits, five bytes each; they are as good as random, so they aren't compressed."""
    return keys.astype(np.uint32).tobytes() + (keys >> np.uint64(32)).astype(np.uint8).tobytes()


def key_array(data: bytes) -> np.ndarray:
    n = len(data) // 5
    return np.frombuffer(data, np.uint32, n).astype(np.uint64) | np.frombuffer(data, np.uint8, n, 4 * n).astype(np.uint64) << np.uint64(32)


def bucket_of(keys: np.ndarray, n: int) -> np.ndarray:
    return (keys % np.uint64(n)).astype(np.uint16 if n < 1 << 16 else np.int64)


def asks(table: pa.Table, width: int, n_buckets: int) -> pa.Table:
    """A block's distinct shingles by bucket, with the number of its different sets that hold each."""
    hashes, sizes = shingle_sets(table.column("text").to_pylist(), width)
    names, seen = set_names(hashes, sizes), set()
    new = np.array([not (n is None or n in seen or seen.add(n)) for n in names], bool)
    own = np.sort(hashes[np.repeat(new, sizes)])
    at = runs(own)
    keys, counts = own[at], np.diff(np.r_[at, len(own)])
    block = table.column("block")[0].as_py()
    rows = [(b, block, key_bytes(keys[o] >> KEY_BITS), pack(counts[o].astype(np.uint32))) for b, o in by_bucket(bucket_of(keys, n_buckets))]
    columns = list(zip(*rows, strict=True)) or [[], [], [], []]
    return pa.Table.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.binary()), pa.array(columns[3], pa.binary())], ["bucket", "block", "keys", "counts"])


def answers(table: pa.Table) -> pa.Table:
    """For each block, in how many sets its shingles occur in all."""
    asked = [key_array(x) for x in binary(table, "keys")]
    keys, counts = np.concatenate(asked), np.concatenate([unpack(x, "u4") for x in binary(table, "counts")]).astype(np.int64)
    order = np.argsort(keys)
    at = runs(keys[order])
    uniq, total = keys[order][at], np.add.reduceat(counts[order], at)
    told = [pack(np.minimum(total[np.searchsorted(uniq, own)], 2**32 - 1).astype(np.uint32)) for own in asked]
    return pa.Table.from_arrays([table.column("block").combine_chunks(), table.column("bucket").combine_chunks(), pa.array(told, pa.binary())], ["block", "bucket", "values"])


SETS = "doc_id long, row long, n_shingles long, node binary, shared binary, prefix array<long>"


def sets_of(docs: pa.Table, told: pa.Table, width: int, n_buckets: int, num: int, den: int) -> pa.Table:
    """A row per document of a block; of equal sets that may have partners, one row also has its shared shingles and its prefix."""
    hashes, sizes = shingle_sets(docs.column("text").to_pylist(), width)
    names = set_names(hashes, sizes)
    uniq, back = np.unique(hashes, return_inverse=True)
    df, answered = np.zeros(len(uniq), np.int64), dict(zip(told.column("bucket").to_pylist(), binary(told, "values"), strict=True))
    for b, own in by_bucket(bucket_of(uniq, n_buckets)):
        df[own] = unpack(answered[b], "u4")
    df = df[back]
    begin = np.cumsum(sizes) - sizes
    n_shared = np.add.reduceat(np.r_[df > 1, False].astype(np.int64), np.minimum(begin, len(df))) * (sizes > 0) if len(sizes) else sizes
    may, seen = (sizes > 0) & (n_shared >= least_overlap(sizes, num, den)), set()
    shared: list[bytes | None] = [None] * len(sizes)
    prefix: list[np.ndarray | None] = [None] * len(sizes)
    for i in np.flatnonzero(may).tolist():
        if names[i] in seen:
            continue
        seen.add(names[i])
        h, f = hashes[begin[i]:begin[i] + sizes[i]], df[begin[i]:begin[i] + sizes[i]]
        n_prefix = int(sizes[i] - least_overlap(sizes[i], num, den) + 1 - (f <= 1).sum())
        h, f = h[f > 1], f[f > 1]
        shared[i] = h.tobytes()
        prefix[i] = h[np.lexsort((h, f))][:n_prefix].view(np.int64)
    return pa.Table.from_arrays([
        docs.column("doc_id").combine_chunks(), docs.column("row").combine_chunks(), pa.array(sizes, pa.int64()), pa.array(names, pa.binary()), pa.array(shared, pa.binary()), pa.array(prefix, pa.list_(pa.int64())),
    ], ["doc_id", "row", "n_shingles", "node", "shared", "prefix"])


def merge_skip(lists: list[list[int]], least: int) -> tuple[list[int], list[int]]:
    """The values that at least ``least`` of some ascending lists hold, ascending, and how many lists have each.

    A heap holds the head of every list, a number of value and list in one. Where too few lists have the least value, the heads of
    ``least - 1`` lists are taken off, and these lists go on by binary search at the value that is on top then: no value before it
    can be in enough lists.
    """
    n = len(lists)
    found: list[int] = []
    counts: list[int] = []
    if n < least:
        return found, counts
    ends, at = [len(x) for x in lists], [0] * n
    heap = [x[0] * n + k for k, x in enumerate(lists) if x]
    heapify(heap)
    while len(heap) >= least:
        value = heap[0] // n
        end, taken = (value + 1) * n, []
        while heap and heap[0] < end:
            taken.append(heappop(heap) - value * n)
        if len(taken) >= least:
            found.append(value)
            counts.append(len(taken))
            for k in taken:
                at[k] += 1
                if at[k] < ends[k]:
                    heappush(heap, lists[k][at[k]] * n + k)
            continue
        while len(taken) < least - 1 and heap:
            taken.append(heappop(heap) % n)
        if not heap:  # the lists left are too few
            break
        goal = heap[0] // n
        for k in taken:
            at[k] = bisect_left(lists[k], goal, at[k])
            if at[k] < ends[k]:
                heappush(heap, lists[k][at[k]] * n + k)
    return found, counts


class Lists:
    """Inverted lists of an index: for each shingle the ascending numbers of the sets that hold it."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray):
        lengths = np.fromiter(map(len, sets), np.int64, len(sets))
        tokens = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        order = np.argsort(tokens, kind="stable")
        self.postings = np.repeat(np.arange(len(sets)), lengths)[order]
        at = runs(tokens[order])
        self.tokens, self.begin, self.end, self.sizes = tokens[order][at], at, np.r_[at[1:], len(tokens)], sizes

    def search(self, query: np.ndarray, size: int, num: int, den: int) -> np.ndarray:
        """Sets of the index whose similarity to a query of ``size`` shingles reaches ``num / den``."""
        at = np.minimum(np.searchsorted(self.tokens, query), max(0, len(self.tokens) - 1))
        at = at[self.tokens[at] == query] if len(self.tokens) else at[:0]
        least = int(least_overlap(size, num, den))
        if len(at) < least:
            return np.zeros(0, np.int64)
        length = self.end[at] - self.begin[at]
        at = at[np.argsort(length, kind="stable")]
        n_long = min(least - 1, max(0, int(least / (MU * np.log2(length.max() + 1) + 1))))
        short, long = at[:len(at) - n_long], at[len(at) - n_long:]
        merged = merge_skip([self.postings[self.begin[t]:self.end[t]].tolist() for t in short], least - len(long))
        found, count = np.array(merged[0], np.int64), np.array(merged[1], np.int64)
        need = -(-num * (size + self.sizes[found]) // (num + den))
        for k, t in enumerate(long):
            alive = count + (len(long) - k) >= need
            if not alive.all():
                found, count, need = found[alive], count[alive], need[alive]
                if not len(found):
                    break
            own = self.postings[self.begin[t]:self.end[t]]
            count = count + (own[np.minimum(np.searchsorted(own, found), len(own) - 1)] == found)
        return found[count >= need]


LINKS = "node binary, other binary, n_links long"


def first_common(a: list[int], b: list[int]) -> int:
    """The first of the prefix ``a`` that is in ``b``; both stand in one order, so it is the first of both."""
    other = set(b)
    return next(t for t in a if t in other)


def links_of(table: pa.Table, num: int, den: int, n_tasks: int) -> pa.Table:
    """A task's links: for each node with links here one edge towards the least node of its local component, and how many
    documents it is linked to."""
    nodes, sizes = binary(table, "node"), table.column("n_shingles").to_numpy()
    sets, copies = [np.frombuffer(x, np.uint64) for x in binary(table, "shared")], table.column("copies").to_numpy()
    side = table.column("side").to_numpy()
    task = table.column("task")[0].as_py() if table.column("kind")[0].as_py() == BY_TOKEN else None
    prefixes = table.column("prefix").to_pylist() if task is not None else []
    one = not (side > 0).any()
    index = np.arange(len(nodes)) if one else np.flatnonzero(side == 1)
    lists = Lists([sets[i] for i in index], sizes[index])
    parent, n_links = list(range(len(nodes))), np.zeros(len(nodes), np.int64)

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for q in range(len(nodes)) if one else np.flatnonzero(side == 0).tolist():
        found = index[lists.search(sets[q], int(sizes[q]), num, den)]
        found = found[found != q]
        if task is not None and len(found):
            found = found[[first_common(prefixes[q], prefixes[x]) % n_tasks == task for x in found.tolist()]]
        n_links[q] += copies[found].sum()
        if not one:
            np.add.at(n_links, found, copies[q])
        for x in found.tolist():
            a, b = root(q), root(x)
            if a != b:
                parent[max(a, b, key=lambda v: nodes[v])] = min(a, b, key=lambda v: nodes[v])
    linked = np.flatnonzero(n_links).tolist()
    return pa.Table.from_arrays([pa.array([nodes[i] for i in linked], pa.binary()), pa.array([nodes[root(i)] for i in linked], pa.binary()), pa.array(n_links[linked], pa.int64())], ["node", "other", "n_links"])


WHOLE, BY_BLOCK, BY_TOKEN = 0, 1, 2


def candidate_tasks(nodes: DataFrame, group: int, by_token: bool | None = None) -> tuple[DataFrame, int]:
    """``nodes(node, n_shingles, shared, prefix, copies)`` dealt to search tasks ``(kind, task, i, j)``; ``side`` tells the two
    blocks of a pair apart. Also how many tasks share out the shingles. ``by_token`` forces one of the two ways of large groups."""
    tokens = nodes.select("node", F.explode("prefix").alias("token"))
    shared = written(tokens.groupBy("token").agg(F.min("node").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1"), "shared-tokens")
    groups = components(tokens.join(shared, "token").select(F.col("node").alias("a"), "b"), "candidates")
    placed = groups.join(nodes.select("node", F.size("prefix").alias("n_prefix"), "n_shingles"), "node")
    n_blocks = F.ceil(F.col("size") / group).cast("int")
    # what a large group sends to tasks: each set once a block, or once for each shingle of its prefix
    way = F.lit(by_token) if by_token is not None else F.col("sent_by_token") < n_blocks * F.col("sent_once")
    sizes = placed.groupBy("label").agg(F.count(F.lit(1)).alias("size"), F.sum("n_shingles").alias("sent_once"), F.sum(F.col("n_prefix") * F.col("n_shingles")).alias("sent_by_token"))
    dealt = written(groups.join(sizes, "label").select("node", "label", "size", F.when(F.col("size") <= group, WHOLE).when(way, BY_TOKEN).otherwise(BY_BLOCK).alias("kind")), "candidate-groups")
    n_tasks = max(1, dealt.where(F.col("kind") == WHOLE).count() // group)
    columns = ["kind", "task", "i", "j", "side", "node", "n_shingles", "shared", "copies", "prefix"]
    none = F.lit(None).cast("array<long>").alias("prefix")
    sets = nodes.select("node", "n_shingles", "shared", "copies", "prefix")

    small = dealt.where(F.col("kind") == WHOLE).join(sets.drop("prefix"), "node").select("kind", F.pmod(F.xxhash64("label"), F.lit(n_tasks)).alias("task"), F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"), "node", "n_shingles", "shared", "copies", none)

    def in_blocks(rows: DataFrame) -> DataFrame:
        """Rows ``(kind, task, size, node)``, each sent to the tasks of its block with every block."""
        sent = rows.withColumn("own", F.pmod(F.xxhash64("node"), n_blocks).cast("int")).withColumn("partner", F.explode(F.sequence(F.lit(0), n_blocks - 1)))
        return sent.select("kind", "task", F.least("own", "partner").alias("i"), F.greatest("own", "partner").alias("j"), F.when(F.col("own") > F.col("partner"), 1).otherwise(0).alias("side"), "node")

    large = in_blocks(dealt.where(F.col("kind") == BY_BLOCK).select("kind", F.xxhash64("label").alias("task"), "size", "node")).join(sets.drop("prefix"), "node").withColumn("prefix", none)
    chained = written(tokens.join(shared.select("token"), "token").join(dealt.where(F.col("kind") == BY_TOKEN).select("node", "kind"), "node"), "chained")
    n_token_tasks = max(1, chained.count() // group)
    asked = chained.select("kind", F.pmod("token", F.lit(n_token_tasks)).alias("task"), "node").distinct()
    held = asked.groupBy("task").agg(F.count(F.lit(1)).alias("size"))
    by_tokens = in_blocks(asked.join(held, "task")).join(sets, "node")
    return small.unionByName(large).unionByName(by_tokens).select(*columns), n_token_tasks


def linked_sets(docs: DataFrame, *, id_col: str, text_col: str, width: int, similarity: tuple[int, int], block_bytes: int = 2 << 20, bucket_bytes: int = 8 << 20, group: int = GROUP, by_token: bool | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents ``(doc_id, row, n_shingles, node)``, different sets ``(node, label, n_links)``, and the lead of each label
    ``(label, lead)``: the ``doc_id`` and ``row``, a hash of id and text, of the smallest id that links reach.

    Components are told to different sets first and then to their copies, so a hot component meets no join with all its
    documents.
    """
    num, den = similarity
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n_bytes = text_bytes(source, "text")
    n_blocks, n_buckets = pieces(n_bytes, block_bytes, 2), pieces(n_bytes, bucket_bytes, 2)
    tasks = dealt_tasks(n_bytes)
    dealt = source.select(block_of(n_blocks, "doc_id", "text"), F.xxhash64("doc_id", "text").alias("row"), "doc_id", "text").repartition(tasks, "block")
    asked = dealt.groupBy("block").applyInArrow(lambda t: asks(t, width, n_buckets), "bucket int, block int, keys binary, counts binary").repartition(tasks, "bucket")
    told = asked.groupBy("bucket").applyInArrow(answers, "block int, bucket int, values binary").repartition(tasks, "block")
    rows = written(dealt.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(lambda d, t: sets_of(d, t, width, n_buckets, num, den), SETS), "sets")

    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")).alias("first")
    copies = rows.where("node is not null").groupBy("node").agg(F.count(F.lit(1)).alias("copies"), first)
    nodes = written(rows.where("prefix is not null").dropDuplicates(["node"]).drop("doc_id", "row").join(copies.drop("first"), "node"), "nodes")
    searched, n_token_tasks = candidate_tasks(nodes, group, by_token)
    links = written(searched.repartition(tasks, "kind", "task", "i", "j").groupBy("kind", "task", "i", "j").applyInArrow(lambda t: links_of(t, num, den, n_token_tasks), LINKS), "links")
    labels = components(links.select(F.col("node").alias("a"), F.col("other").alias("b")), "linked")
    n_links = links.groupBy("node").agg(F.sum("n_links").alias("n_links"))
    named = copies.join(labels, "node", "left").join(n_links, "node", "left").withColumn("label", F.coalesce("label", "node"))
    leads = named.groupBy("label").agg(F.min("first").alias("lead"))
    known = named.select("node", "label", (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return rows.select("doc_id", "row", "n_shingles", "node"), known, leads


def jaccard_join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 4, similarity: tuple[int, int] = (85, 100), **sizes: int) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, n_links``.

    Documents link where the Jaccard similarity of their sets of ``width``-word shingles (A-Z lowered; fewer words are one
    shingle) is at least ``similarity``, an exact fraction. ``component_id`` is the smallest doc_id that links reach, the document
    included. ``n_links`` counts the documents linked directly. A null or empty text, or one of white space, has the empty set and
    links with nothing. Repeated rows are copies and link with each other; a null id is the smallest of a component only where
    no other is. An empty table gives none; other columns are left out, so none can clash.
    """
    rows, known, leads = linked_sets(docs, id_col=id_col, text_col=text_col, width=width, similarity=similarity, **sizes)
    told = known.join(leads, "label").select("node", F.col("lead.doc_id").alias("lead_id"), "n_links")
    own = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("lead_id"))
    return rows.join(told, "node", "left").select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def drop_near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: tuple[int, int] = (80, 100), **sizes: int) -> DataFrame:
    """``docs`` without near copies: of each component the row of the smallest id stays, of rows equal in id and text one.

    Documents without words are no copies of each other and all stay. All columns are kept, of any names; of rows equal in id and
    text but not in other columns any one stays. An empty table gives none. The text is shuffled once, by the hash of its row.
    """
    row, stays = unused(docs.columns, "row", "stays")
    stay = linked_sets(docs, id_col=id_col, text_col=text_col, width=width, similarity=similarity, **sizes)[2].select(F.col("lead.row").alias(stays)).distinct()
    keyed = docs.withColumn(row, F.xxhash64(F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit(""))))
    wordless = ~F.coalesce(F.col(text_col), F.lit("")).rlike(WORD)
    kept = keyed.where(~wordless).join(stay, F.col(row) == F.col(stays), "left_semi").dropDuplicates([row]).unionByName(keyed.where(wordless))
    return kept.select(*quoted(*docs.columns))
