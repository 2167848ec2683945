"""Mixing sources to target weights: Sainte-Lague apportionment of equal-token blocks. DataFrame functions only.

Sources get integer numbers of blocks by highest quotients ``target / (2k + 1)``, then each source's number is
apportioned to its regions, and each region's to its shards, by the same rule, and each shard picks its blocks by a seeded draw.
A shard is a hash bucket of one source's documents in a seeded order and a region some hundreds of shards, so of a hot source no
window holds more than one shard's documents, one region's shards, or a row for each of its regions of a quarter million documents.

The highest quotients are found without listing them all: seats that any divisor near the final one would give are given
at once, and only the few quotients around the margin are ranked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundline.llm.common import WORD, quoted, unused, written

#: Pieces of a hot source in the join that gives documents their source's figures.
SALT = 32


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def _hash(seed: int, *columns: Column) -> Column:
    """Hex digits that SQL engines agree on."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *columns).cast("binary"))


def source_targets(sizes: DataFrame, weights: Sequence[int], share: float, max_repeats: int) -> DataFrame:
    """Targets per source from ``(source, source_size)``: shares by weight, none above its cap, the excess reshared.

    The fixed point of resharing is a water level: sorted by cap over weight, those below the level take their cap and
    the others share the rest by weight. The windows run over one row per source.
    """
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    by_ratio = Window.orderBy("ratio", F.asc_nulls_last("source"))
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    return (
        sizes.withColumn("rank", F.row_number().over(by_name))
        .withColumn("weight", F.element_at(cycle, (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int")))
        .withColumn("cap", (F.lit(max_repeats) * F.col("source_size")).cast("double"))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("budget", F.lit(float(share)) * F.sum("source_size").over(everything))
        .withColumn("capped", F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("cap"))
        .withColumn("open", F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("level", (F.col("budget") - F.col("capped")) / F.col("open"))
        .withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "rank", "capped", "open"))).over(everything))
        .withColumn("is_open", F.struct("ratio", "rank") >= F.struct("level.ratio", "level.rank"))
        .withColumn("target", F.when(F.coalesce("is_open", F.lit(False)), (F.col("budget") - F.col("level.capped")) * F.col("weight") / F.col("level.open")).otherwise(F.col("cap")))
        .select("source", "source_size", "rank", F.least("target", "cap").alias("target"))
    )


def apportion(units: DataFrame, group: Sequence[str], unit: Sequence[str], weight: str, seats: str) -> DataFrame:
    """Sainte-Lague: adds ``quota`` to ``units``, summing within each ``group`` to its number of ``seats``.

    A unit of no weight gets nothing; a group of no weight seats nobody. Equal quotients go to the lower ``unit``. The
    shuffle and the windows are over units, of which a group has few against its rows.
    """
    keys = [F.col(c) for c in group]
    whole = Window.partitionBy(*keys) if keys else Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    order = [F.desc("quotient"), *[F.asc_nulls_last(c) for c in unit], F.asc("k")]
    ranked = Window.partitionBy(*keys).orderBy(*order) if keys else Window.orderBy(*order)
    w, n = F.col(weight).cast("double"), F.col(seats)
    margin = F.col("_units") / 2 + 1
    sure = F.when(n > margin, F.floor(w * (n - margin) / F.col("_all") + 0.5)).otherwise(F.lit(0))
    most = F.ceil(w * (n + margin) / F.col("_all") + 0.5)
    sized = (
        units.withColumn("_all", F.sum(w).over(whole)).withColumn("_units", F.count(F.lit(1)).over(whole))
        .withColumn("_sure", F.when((w > 0) & (n > 0), sure).otherwise(F.lit(0)).cast("long"))
        .withColumn("_most", F.when((w > 0) & (n > 0), most).otherwise(F.lit(0)).cast("long"))
        .withColumn("_left", n - F.sum("_sure").over(whole))
    )
    return (
        sized.withColumn("k", F.explode(F.sequence(F.col("_sure"), F.greatest("_most", "_sure"))))
        .withColumn("quotient", F.when(F.col("k") < F.col("_most"), w / (2 * F.col("k") + 1)).otherwise(F.lit(-1.0)))
        .withColumn("_won", ((F.row_number().over(ranked) <= F.col("_left")) & (F.col("quotient") > 0)).cast("long"))
        .groupBy(*units.columns).agg((F.first("_sure") + F.sum("_won")).alias("quota"))
    )


def mix_sources(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = (5, 2, 1), share: float = 1.5,
    max_repeats: int = 2, block_tokens: int = 16, shard_docs: int = 1024, region_shards: int = 256, seed: int = 17,
) -> DataFrame:
    """How many words of each document the mix takes: ``doc_id, size, source_size, target, taken``, a row per document.

    Sources in code point order, null last, weigh ``weights`` in turn and share ``share`` of all words; no target is over
    ``max_repeats`` times its source. Blocks of ``block_tokens`` words fill the targets. A shard that owes more blocks
    than it has takes whole passes first, and the rest by a systematic draw from a seeded start over its seeded order of
    documents, so no document is taken more than ``max_repeats`` times its size.

    Null and empty texts have size 0 and are taken 0; a null source is a source of its own, after the others. Repeated
    rows each count. Equal keys fall in an order that their size settles, and rows equal in both are alike, so reruns
    agree. An empty table gives an empty result. Other columns of ``docs`` are left out, so none can clash.
    """
    base = written(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(text_col).alias("size")), "mix-sizes")
    by_source = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    targets = source_targets(by_source.select("source", "source_size"), weights, share, max_repeats)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    seated = apportion(targets.withColumn("_seats", F.round(F.sum("target").over(everything) / block_tokens).cast("long")), [], ["rank"], "target", "_seats")
    sources = written(
        seated.withColumnRenamed("quota", "source_quota").join(by_source.select(F.col("source").alias("_s"), "n_docs"), F.col("source").eqNullSafe(F.col("_s")))
        .select("source", "source_size", "target", "source_quota", F.greatest(F.ceil(F.col("n_docs") / shard_docs), F.lit(1)).cast("long").alias("n_shards")),
        "mix-sources",
    )

    key = _hash(seed, F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    spread = base.withColumn("key", key).withColumn("digits", F.conv(F.substring("key", 1, 12), 16, 10).cast("long")).withColumn("salt", F.pmod(F.col("digits"), F.lit(SALT)))
    keyed = sources.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))).withColumnRenamed("source", "_s")
    rows = spread.join(keyed, (spread["source"].eqNullSafe(keyed["_s"])) & (spread["salt"] == keyed["salt"])).drop(keyed["salt"])
    rows = rows.select("doc_id", "source", "size", "key", "source_size", "target", "source_quota", F.pmod(F.col("digits"), F.col("n_shards")).alias("shard"))

    units = rows.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"), F.first("source_quota").alias("source_quota"))
    units = units.withColumn("region", F.expr(f"shard div {region_shards}"))
    regions = apportion(units.groupBy("source", "region").agg(F.sum("shard_size").alias("region_size"), F.first("source_quota").alias("source_quota")), ["source"], ["region"], "region_size", "source_quota")
    regions = regions.select(F.col("source").alias("_s"), F.col("region").alias("_r"), F.col("quota").alias("region_quota"))
    units = units.join(regions, units["source"].eqNullSafe(regions["_s"]) & (units["region"] == regions["_r"])).select("source", "region", "shard", "shard_size", "region_quota")
    quotas = apportion(units, ["source", "region"], ["shard"], "shard_size", "region_quota").select(F.col("source").alias("_s"), F.col("shard").alias("_shard"), "shard_size", "quota")

    in_shard = Window.partitionBy("source", "shard").orderBy("key", "size", F.asc_nulls_last("doc_id"))
    placed = rows.withColumn("end", F.sum("size").over(in_shard.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    placed = placed.join(quotas, placed["source"].eqNullSafe(quotas["_s"]) & (placed["shard"] == quotas["_shard"]))
    return taken_words(placed, block_tokens, max_repeats, seed).select("doc_id", "size", "source_size", "target", "taken")


def taken_words(placed: DataFrame, block_tokens: int, max_repeats: int, seed: int) -> DataFrame:
    """Adds ``taken``: words taken of ``(end - size, end]`` in a shard of ``shard_size`` words that owes ``quota`` blocks.

    Of ``n`` blocks ``r`` are drawn: block ``b`` is, where ``floor((b + 1 + start) r / n)`` steps up. The draw is counted,
    not listed: no row per block is made.
    """
    def drawn(b: str) -> str:
        return f"((({b}) + start) * r div n - start * r div n)"

    def upto(x: str) -> str:
        b = f"(({x}) div {block_tokens})"
        return f"({block_tokens} * {drawn(b)} + ({drawn(b + ' + 1')} - {drawn(b)}) * (({x}) - {block_tokens} * {b}))"

    start = F.conv(F.substring(_hash(seed + 1, F.coalesce("source", F.lit("")), F.col("shard").cast("string")), 1, 12), 16, 10).cast("long")
    return (
        placed.withColumn("n", F.greatest(F.expr(f"(shard_size + {block_tokens - 1}) div {block_tokens}"), F.lit(1).cast("long")))
        .withColumn("start", F.pmod(start, F.col("n")))
        .withColumn("owed", F.least(F.col("quota"), max_repeats * F.col("n")))
        .withColumn("r", F.pmod("owed", "n"))
        .withColumn("taken", F.expr(f"(owed div n) * size + {upto('end')} - {upto('end - size')}").cast("long"))
    )


def take_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The documents that the mix takes, with all their columns, of any names, and ``size, source_size, target, taken``; where a column has such
    a name already, the new one gets an underscore before it.

    Documents of which nothing is taken go. Rows equal in id and text are told apart by nothing, so each counts as its likes' mean.
    """
    row, like, *told = unused(docs.columns, "row", "like", "size", "source_size", "target", "taken")
    own = F.xxhash64(F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit("")))
    keyed = docs.select(F.struct(F.col(id_col).cast("long").alias("doc_id"), own.alias("row")).alias("doc_id"), F.col(text_col).alias("text"), F.col(source_col).alias("source"))
    mixed = mix_sources(keyed, **options)
    took = mixed.groupBy(F.col("doc_id.row").alias(like)).agg(*(F.first(c).alias(n) for c, n in zip(("size", "source_size", "target"), told, strict=False)), F.round(F.avg("taken")).cast("long").alias(told[3]))
    return docs.withColumn(row, own).join(took, F.col(row) == F.col(like)).where(F.col(told[3]) > 0).select(*quoted(*docs.columns), *told)
