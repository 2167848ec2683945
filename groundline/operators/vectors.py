"""Nearest neighbours by cosine, hybrid re-ranking, and pairs of near vectors. Exact; blocks of vectors meet in NumPy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundline.functions.scores import EPSILON, dense_score
from groundline.functions.text import words

BLOCK = 4096


def _matrix(table: pa.Table, column: str) -> np.ndarray:
    values = table.column(column).combine_chunks()
    flat = values.values if isinstance(values, pa.Array) else pa.concat_arrays([c.values for c in values.chunks])
    return np.asarray(flat, np.float64).reshape(len(values), -1)


def _dealt(df: DataFrame, key: str, n: int, name: str) -> DataFrame:
    return df.withColumn(name, F.pmod(F.xxhash64(key), F.lit(n)).cast("int"))


def nearest(queries: DataFrame, vectors: DataFrame, k: int = 5, *, block: int = BLOCK) -> DataFrame:
    """``(query_id, vector_id, distance, rank)``: the ``k`` vectors of least cosine distance to each query.

    ``queries(query_id, query_vector)`` is the stated query set, ``vectors(vector_id, vector)`` everything. Blocks of both meet as
    matrices and each meeting returns ``k`` rows a query, so what is ranked at the end is ``k`` times the number of blocks. Ties go
    to the smaller id. Null vectors and vectors of no direction have the distance 1; a ``k`` of 0 means 5. Vectors must be of one length.
    """
    k = k or 5
    n_queries, n_vectors = -(-max(1, queries.count()) // block), -(-max(1, vectors.count()) // block)
    q = _dealt(queries.where("query_vector is not null"), "query_id", n_queries, "i").withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(n_vectors - 1))))
    v = _dealt(vectors.where("vector is not null"), "vector_id", n_vectors, "j").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1))))
    kinds = {c: df.schema[c].dataType.simpleString() for df, c in ((queries, "query_id"), (vectors, "vector_id"))}

    def met(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.table({"query_id": left.column("query_id")[:0], "vector_id": right.column("vector_id")[:0], "distance": pa.array([], pa.float64())})
        right = right.take(pa.array(np.argsort(np.array(right.column("vector_id").to_pylist()), kind="stable")))
        a, b = _matrix(left, "query_vector"), _matrix(right, "vector")
        norms = np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None, :]
        with np.errstate(divide="ignore", invalid="ignore"):
            distance = np.where(norms > 0, 1 - a @ b.T / norms, 1.0)
        best = np.argsort(np.round(distance, 12), axis=1, kind="stable")[:, :k]
        rows = np.repeat(np.arange(len(left)), best.shape[1])
        return pa.table({"query_id": left.column("query_id").take(pa.array(rows)), "vector_id": right.column("vector_id").take(pa.array(best.ravel())), "distance": pa.array(distance[rows, best.ravel()])})

    found = q.groupBy("i", "j").cogroup(v.groupBy("i", "j")).applyInArrow(met, f"query_id {kinds['query_id']}, vector_id {kinds['vector_id']}, distance double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("distance", 12), "vector_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def keywords(text: Column) -> Column:
    """Words of a query over three characters, lower case, each once."""
    return F.array_distinct(F.filter(words(F.lower(text)), lambda w: F.length(w) > 3))


def hybrid(queries: DataFrame, vectors: DataFrame, k: int = 5, *, pool: int = 10, boost: float = 0.5) -> DataFrame:
    """``(query_id, vector_id, distance, hits, hybrid_score, rank)``: a pool of ``pool`` times ``k`` neighbours ranked again by
    closeness plus ``boost`` for each keyword of the query among the document's words.

    ``queries(query_id, query_vector, query_text)``, ``vectors(vector_id, vector, document)``.
    """
    k = k or 5
    near = nearest(queries.select("query_id", "query_vector"), vectors.select("vector_id", "vector"), pool * k).drop("rank")
    joined = near.join(queries.select("query_id", keywords(F.col("query_text")).alias("_q")), "query_id").join(vectors.select("vector_id", "document"), "vector_id")
    hits = F.size(F.array_intersect("_q", F.array_distinct(words(F.lower("document")))))
    scored = joined.withColumn("hits", F.greatest(hits, F.lit(0))).withColumn("hybrid_score", dense_score(F.col("distance")) + boost * F.col("hits"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("hybrid_score", 9)), "vector_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "vector_id", "distance", "hits", "hybrid_score", "rank")


def near_pairs(vectors: DataFrame, threshold: float = 0.90, *, block: int = 2048) -> DataFrame:
    """``(a, b, similarity)`` with ``a < b`` for vectors ``(id, vector)`` whose cosine is at least ``threshold``.

    Vectors are normalised once and dealt to blocks; a pair of blocks is one matrix product, whatever its keys.
    """
    n = -(-max(1, vectors.count()) // block)
    dealt = _dealt(vectors.where("vector is not null"), "id", n, "own").withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    paired = dealt.select(F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).alias("second"), "id", "vector")
    kind = vectors.schema["id"].dataType.simpleString()

    def met(table: pa.Table) -> pa.Table:
        ids, x = np.array(table.column("id").to_pylist()), _matrix(table, "vector")
        x = x / (np.linalg.norm(x, axis=1, keepdims=True) + EPSILON)
        second = table.column("second").to_numpy()
        one = not second.any()
        left, right = (np.arange(len(ids)), np.arange(len(ids))) if one else (np.flatnonzero(~second), np.flatnonzero(second))
        a, b, s = [], [], []
        for at in range(0, len(left), 256):  # a strip of the product at a time
            product = x[left[at:at + 256]] @ x[right].T
            r, c = np.nonzero(product >= threshold)
            p, q = ids[left[at:at + 256][r]], ids[right[c]]
            keep = p < q if one else p != q
            a.append(np.minimum(p, q)[keep])
            b.append(np.maximum(p, q)[keep])
            s.append(product[r, c][keep])
        schema = pa.schema([("a", table.schema.field("id").type), ("b", table.schema.field("id").type), ("similarity", pa.float64())])
        return pa.Table.from_arrays([pa.array(np.concatenate(v).tolist(), t) for v, t in zip((a, b, s), schema.types, strict=True)], schema=schema)

    return paired.groupBy("i", "j").applyInArrow(met, f"a {kind}, b {kind}, similarity double")
