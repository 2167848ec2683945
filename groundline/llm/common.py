"""What several operators share: words, scratch tables, and the block exchange.

The block exchange is how operators that compare documents stay near linear: documents are dealt to blocks of a few MB, each
block sends one packed array per bucket it has items for instead of a row per item, buckets answer the blocks, and the blocks
join the answers to their texts. Blocks, buckets and tasks are counted from the input's bytes, so what a task holds stays the
same size. Packets are blocks times buckets, and shrink as both grow: at 30 GB one has hundreds of keys, at 100 TB about one, where
the exchange is a shuffle of plain keys.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundline.sources.scratch import scratch_dir, written

__all__ = ["WORD", "binary", "block_of", "pack", "parts_of", "pieces", "runs", "scratch_dir", "text_bytes", "unpack", "unused", "written"]

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def unused(columns: list[str] | tuple[str, ...], *names: str) -> list[str]:
    """``names``, each with so many underscores before it that it is none of ``columns``, whose case doesn't matter."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(*names: str) -> list[Column]:
    """Columns of these names, whatever characters are in them."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


def numbered_names(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` under column names that Python functions can be given, ``c0`` and so on, and the new name of each old one. ``toDF`` with the old names
    undoes it."""
    names = {c: f"c{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def fields_of(df: DataFrame) -> str:
    """The columns of ``df`` as a schema in words."""
    return ", ".join("`" + f.name.replace("`", "``") + "` " + f.dataType.simpleString() for f in df.schema.fields)


def text_bytes(df: DataFrame, *columns: str) -> int:
    """Bytes of text in ``columns``, over all rows."""
    return int(df.agg(F.sum(sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in columns), F.lit(0)).cast("long")).alias("n")).first()["n"] or 0)


def pieces(n_bytes: int, each: int, least: int = 1) -> int:
    """How many pieces of about ``each`` bytes ``n_bytes`` make."""
    return max(least, -(-n_bytes // each))


def dealt_tasks(n_bytes: int, each: int = 8 << 20, least: int = 8, most: int = 20_000) -> int:
    """How many tasks take ``n_bytes`` of blocks or packets: about ``each`` bytes a task, so that no task grows with the input, until ``most``
    tasks are reached; beyond, a task takes more groups, one after another."""
    return min(most, pieces(n_bytes, each, least))


def by_bucket(of: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket that ``of`` names, with the places that name it. The work doesn't depend on how many buckets there are."""
    order = np.argsort(of, kind="stable")
    for a, b in pairwise([*runs(of[order]).tolist(), len(order)]):
        yield int(of[order[a]]), order[a:b]


def block_of(n_blocks: int, *columns: str) -> Column:
    """An even deal of rows to blocks by a hash of ``columns``."""
    return F.pmod(F.xxhash64(*columns), F.lit(n_blocks)).cast("int").alias("block")


def pack(values: np.ndarray) -> bytes:
    """An array as compressed bytes; equal bytes of neighbouring items stand together first."""
    size = values.dtype.itemsize
    return zlib.compress(np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(-1, size).T).tobytes(), 1)


def unpack(data: bytes, dtype: str) -> np.ndarray:
    kind = np.dtype(dtype)
    raw = np.frombuffer(zlib.decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(kind.itemsize, -1).T).view(kind).ravel()


def binary(table: pa.Table, column: str) -> list[bytes]:
    """Values of a binary column, an item at a time."""
    return [x for chunk in table.column(column).chunks for x in chunk.to_pylist()]


def runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]])


def parts_of(batch: pa.RecordBatch, column: str, size: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``size`` bytes of text each, so that a batch of long texts isn't held twice."""
    bytes_upto = np.cumsum(np.array(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64))
    at = 0
    while at < batch.num_rows:
        done = bytes_upto[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(bytes_upto, done + size, side="right")))
        yield batch.slice(at, end - at)
        at = end
