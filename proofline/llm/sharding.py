"""Sharding by proportional stratified interleaving.

Rows are shuffled by a seeded digest within their source and ranked; the row
of rank r among n has the fraction (2r + 1) / 2n.  In order of that fraction
every stretch of rows holds the sources in the mixture's proportions, so equal
cuts give shards that all match it.

Both rankings are exact and neither needs a group in one task: ranks are
counted within buckets (of the digest, then of the fraction) and the rows in
earlier buckets are added from bucket counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import tagged


def shard_rows(docs: DataFrame, shards: int = 40, seed: int = 17, rows_per_bucket: int = 5_000) -> DataFrame:
    """``docs`` with ``size``, ``text_crc32``, ``shard`` and ``slot`` (replacing columns of these names).

    ``docs`` has (doc_id, text, source) and any further columns, which are
    kept.  ``size`` is the text's UTF-8 bytes plus 16; row counts of shards
    differ by one at most; ``slot`` counts from 0 in each shard.

    Defined cases: a null text has size 16 and the CRC of no bytes; a null
    source is a source of its own; repeated rows each get a slot; with fewer
    rows than shards some shards stay empty; an empty table gives no rows.
    """
    rows = docs.count()
    buckets = max(1, -(-rows // rows_per_bucket))
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    keyed = docs.withColumns({"size": F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16, "text_crc32": crc, "__source": tagged(F.col("source"))})
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("text_crc32").cast("string")).cast("binary"))
    keyed = keyed.withColumn("__digest", digest).withColumn("__bucket", F.expr(f"conv(substring(__digest, 1, 8), 16, 10) * {buckets}L div 4294967296L"))

    counts = keyed.groupBy("__source", "__bucket").agg(F.count("*").alias("__n"))
    own = Window.partitionBy("__source")
    starts = counts.select(
        "__source", "__bucket",
        F.coalesce(F.sum("__n").over(own.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"),
        F.sum("__n").over(own).alias("__of"),
    )
    within = Window.partitionBy("__source", "__bucket").orderBy("__digest", "doc_id", "size")
    ranked = (
        keyed.join(starts, ["__source", "__bucket"])
        .withColumn("__rank", F.col("__before") + F.row_number().over(within) - 1)
        .withColumn("__fraction", (2 * F.col("__rank") + 1) / (2 * F.col("__of")))
        .withColumn("__part", F.expr(f"(2 * __rank + 1) * {buckets}L div (2 * __of)"))
    )
    # Rows of a source of n rows before part j: those with (2r + 1) * buckets < 2nj.
    sources = counts.groupBy("__source").agg(F.sum("__n").alias("__of"))
    firsts = (
        sources.select("__of", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(buckets - 1).cast("long"))).alias("__part"))
        .groupBy("__part")
        .agg(F.expr(f"sum((2 * __of * __part + {buckets - 1}L) div (2 * {buckets}L))").alias("__first"), F.sum("__of").alias("__rows"))
    )
    order = Window.partitionBy("__part").orderBy("__fraction", "__source", "__digest", "doc_id", "size")
    return (
        ranked.join(firsts, "__part")
        .withColumn("__position", F.col("__first") + F.row_number().over(order) - 1)
        .withColumn("shard", F.expr(f"cast(__position * {shards} div __rows as int)"))
        .withColumn("slot", F.expr(f"__position - (shard * __rows + {shards - 1}) div {shards}"))
        .drop(*(f"__{name}" for name in ("source", "digest", "bucket", "before", "of", "rank", "fraction", "part", "first", "rows", "position")))
    )
