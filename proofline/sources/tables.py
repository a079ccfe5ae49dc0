"""Tables with a key: buckets of Parquet files, and commits that say which files are the table.

A write adds files and then one commit, a single small file.  Until that is
there, and if the writer dies before, readers see the table as it was.  A
commit names all buckets, so later ones rewrite only the buckets they touch.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows of a bucket, about, when the table is dealt.
ROWS_PER_BUCKET = 500_000
_COMMIT = "version long, writer string, buckets int, bucket int, folder string, n long, columns string"
_BUCKET = "__bucket"


def _newest(spark: SparkSession, path: str) -> list[Row]:
    """The newest commit's rows, one a bucket; none if there is no table."""
    try:
        commits = spark.read.schema(_COMMIT).parquet(f"{path}/commits")
    except AnalysisException:  # there is no table yet
        return []
    last = commits.agg(F.max(F.struct("version", "writer")).alias("c")).select("c.*")
    return commits.join(F.broadcast(last), ["version", "writer"]).collect()  # bounded by the number of buckets


def _read(spark: SparkSession, path: str, buckets: list[Row], columns: str) -> DataFrame:
    schema = StructType.fromJson(json.loads(columns))
    folders = [f"{path}/{row['folder']}/{_BUCKET}={row['bucket']}" for row in buckets if row["n"]]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The table at ``path`` as its newest commit has it; later writes don't change what was read.  No table raises."""
    now = _newest(spark, path)
    if not now:
        raise FileNotFoundError(f"no table at {path}")
    return _read(spark, path, now, now[0]["columns"])


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def write_table(rows: DataFrame, path: str, key: str, recreate: bool = False, rows_per_bucket: int = ROWS_PER_BUCKET) -> int:
    """Write ``rows`` as the table at ``path``, or put them in place of those with the same ``key``; returns how many were written.

    Only buckets with a key of ``rows`` are written again; a table that has
    outgrown its buckets twice over is dealt anew.  A key that ``rows`` has twice
    or that is null, other columns than the table's, and another number of
    written rows than there should be raise, and the table stays as it was.
    Columns may have any names but ``__bucket``.  One writer at a time: of two
    at once the later to commit raises, or both do.  Folders of earlier commits are left to readers.
    """
    spark = rows.sparkSession
    n, distinct = rows.select(key).agg(F.count("*"), F.countDistinct(key)).first()
    if n != distinct:
        raise ValueError(f"{n - distinct} rows repeat another one's {key}, or have none")
    last = _newest(spark, path)
    now = [] if recreate else last
    columns = now[0]["columns"] if now else rows.schema.json()
    schema = StructType.fromJson(json.loads(columns))
    kinds = lambda s: {f.name: f.dataType.simpleString() for f in s}
    if kinds(schema) != kinds(rows.schema):
        raise ValueError(f"the table at {path} has other columns: {schema.simpleString()}, not {rows.schema.simpleString()}")
    most = sum(row["n"] for row in now) + n
    buckets, stays = now[0]["buckets"] if now else 0, []
    if buckets * 2 * rows_per_bucket < most or not buckets:
        buckets, old = max(1, -(-most // rows_per_bucket)), now
    else:
        touched = {row["b"] for row in rows.select(_bucket(key, buckets).alias("b")).distinct().collect()}  # bounded by the number of buckets
        old, stays = [row for row in now if row["bucket"] in touched], [row for row in now if row["bucket"] not in touched]
    before = _read(spark, path, old, columns)
    merged = before.join(rows.select(key), key, "left_anti").select(*(F.col(_quoted(c)) for c in schema.names)).unionByName(rows)
    writer = uuid.uuid4().hex
    folder = f"data-{writer}"
    dealt = merged.withColumn(_BUCKET, _bucket(key, buckets))
    dealt.repartition(buckets, _BUCKET).write.partitionBy(_BUCKET).parquet(f"{path}/{folder}")
    written = {row[_BUCKET]: row["n"] for row in spark.read.schema(f"{_BUCKET} int").parquet(f"{path}/{folder}").groupBy(_BUCKET).agg(F.count("*").alias("n")).collect()}
    replaced = before.join(rows.select(key), key, "left_semi").count()
    expected = sum(row["n"] for row in old) - replaced + n
    if sum(written.values()) != expected:
        raise RuntimeError(f"{path}/{folder} has {sum(written.values())} rows, not {expected}; the table stays as it was")
    version = (last[0]["version"] if last else 0) + 1
    entries = [(version, writer, buckets, b, folder, c, columns) for b, c in written.items()] or [(version, writer, buckets, 0, folder, 0, columns)]
    entries += [(version, writer, buckets, row["bucket"], row["folder"], row["n"], columns) for row in stays if row["n"]]
    # One file, which the commit of the job moves into place.
    spark.createDataFrame(entries, _COMMIT).coalesce(1).write.mode("append").parquet(f"{path}/commits")
    commits = spark.read.schema(_COMMIT).parquet(f"{path}/commits")
    if commits.where(F.col("version") == version).select("writer").distinct().count() > 1:
        raise RuntimeError(f"{path} was written by another at the same time; write again")
    return n


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
