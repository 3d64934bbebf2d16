"""Sharding by a two-pass external shuffle.

Pass one scatters whole records over buckets by a seeded hash of their names; there are as
many buckets as make one about ``bucket_bytes`` large, so each fits in a task's memory
whatever the size of the table. Pass two takes a bucket into memory, puts it in canonical
order and shuffles it (Fisher-Yates, seeded by the bucket). Buckets laid end to end are one
random order of all records; it is dealt out to the shards in turn, so shard sizes differ
by one row at most and every shard is itself in random order.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut

#: Repeated rows up to this many kinds are sent to every task (a few tens of MB), more are joined.
BROADCAST_REPEATS = 200_000


def fisher_yates(n: int, seed: int, bucket: int) -> np.ndarray:
    """A random order of 0..n-1: from the end, each place takes one of those up to it."""
    order = np.arange(n)
    words = np.random.Philox(key=[seed & (2**64 - 1), bucket]).random_raw(max(n, 1)).tolist()
    at = order.tolist()
    for i in range(n - 1, 0, -1):
        j = words[i] * (i + 1) >> 64
        at[i], at[j] = at[j], at[i]
    return np.array(at, dtype=np.int64)


def _shuffler(seed: int):
    def shuffle(group: pa.Table) -> pa.Table:
        bucket = group.column("_bucket")[0].as_py()
        group = group.sort_by([("_name", "ascending"), ("_size", "ascending"), ("_crc", "ascending")])
        group = group.take(pa.array(fisher_yates(group.num_rows, seed, bucket)))
        at = pa.array(np.arange(group.num_rows, dtype=np.int64))
        return pa.table({**{c: group.column(c) for c in group.column_names if c != "_name"}, "_at": at})
    return shuffle


def _name(seed: int, *parts: Column) -> Column:
    return F.xxhash64(F.lit(seed), *parts)


def shard_documents(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text",
                    seed: int = 2024, bucket_bytes: int = 32 << 20) -> DataFrame:
    """The rows of ``docs`` as struct ``row`` with size, text_crc32, bucket, shard (from 0) and slot.

    size: UTF-8 bytes of the text (null: none) plus 1. text_crc32: of the text's UTF-8 bytes. slot: the
    row's place in its shard, without gaps from 0. Law: row counts of the shards differ by one at most.
    The order depends on ids, texts and ``seed`` only; rows that repeat both are told apart by
    their place in the input, so that any number of them spreads over the buckets like other rows. Equal
    texts under different ids spread by their ids.

    Null ids and texts are values like any other. A text larger than ``bucket_bytes`` makes its bucket
    as large as itself. An empty table gives an empty result. Columns with clashing names stay as they
    are inside ``row``.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    text = F.col(text_col).cast("string")
    whole = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("string").alias("_id"),
                        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("_size"),
                        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("_crc"),
                        F.xxhash64(F.lit(seed), text).alias("_digest"),
                        F.monotonically_increasing_id().alias("_place"))
    same = ["_id", "_digest"]
    # Narrow and counted before the shuffle; names a row by its hashed text.
    kinds = cut(whole.select(*same, "_size").groupBy(F.xxhash64(*same).alias("_key"))
                .agg(F.count("*").alias("_n"), F.sum("_size").alias("_bytes")))
    total, repeated = kinds.agg(F.sum("_bytes"), F.count(F.when(F.col("_n") > 1, 1))).first()
    buckets = max(1, math.ceil((total or 0) / bucket_bytes))
    often = kinds.filter("_n > 1").select("_key", F.lit(True).alias("_often"))
    keyed = whole.withColumn("_key", F.xxhash64(*same))
    if repeated:
        keyed = keyed.join(F.broadcast(often) if repeated <= BROADCAST_REPEATS else often, "_key", "left")
    else:
        keyed = keyed.withColumn("_often", F.lit(None).cast("boolean"))
    # A hash over nulls skips them, so what is null is said by the value that stands in for it.
    named = keyed.withColumn("_name", _name(seed, F.coalesce("_id", F.lit("\x00null")), "_digest",
                                            F.when(F.col("_often"), F.col("_place")).otherwise(-1)))
    named = named.withColumn("_bucket", F.pmod(_name(seed + 1, F.col("_name")), F.lit(buckets)).cast("long"))
    scattered = named.select("row", "_size", "_crc", "_name", "_bucket")
    shape = T.StructType([T.StructField("row", scattered.schema["row"].dataType),
                          *[T.StructField(c, T.LongType()) for c in ("_size", "_crc", "_bucket", "_at")]])
    placed = scattered.groupBy("_bucket").applyInArrow(_shuffler(seed), shape)
    # Where each bucket begins: counted from the names alone; one row a bucket, summed up in two steps.
    sizes = named.groupBy("_bucket").agg(F.count("*").alias("_n")).withColumn("_part", F.expr("_bucket div 4096"))
    inside = Window.partitionBy("_part").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("_part").agg(F.sum("_n").alias("_of_part"))
    ahead = parts.select("_part", (F.sum("_of_part").over(Window.orderBy("_part")) - F.col("_of_part")).alias("_ahead"))
    begin = sizes.join(ahead, "_part").select(
        F.col("_bucket").alias("_b"), (F.col("_ahead") + F.coalesce(F.sum("_n").over(inside), F.lit(0))).alias("_begin"))
    place = F.col("_begin") + F.col("_at")
    return placed.join(begin, F.col("_bucket") == F.col("_b")).select(
        "row", F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), F.col("_bucket").alias("bucket"),
        (place % shards).cast("int").alias("shard"), F.expr(f"(_begin + _at) div {int(shards)}").alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder a shard; every file is in slot order, as buckets come in order and are never split."""
    (sharded.select("row.*", F.col("shard").alias("shard"), F.col("slot").alias("slot"))
     .repartition("shard", F.expr("slot div 1000000")).sortWithinPartitions("shard", "slot")
     .write.partitionBy("shard").parquet(path))
