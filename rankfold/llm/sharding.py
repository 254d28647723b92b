"""Two-pass external shuffle of a corpus into evenly filled shards.

Pass one scatters the rows into memory-sized buckets by a seeded hash. The hash takes the
row's place in its partition besides its id, so that an id which many rows share is spread
like any other. Pass two puts each bucket into a canonical order, shuffles it with a seeded
Fisher-Yates shuffle and writes it; the written files hold the corpus in its global random
order (bucket, position). The shards are dealt from that order, one row each in turn: row
counts differ by one at most (law ``rows``), whatever the sizes of the buckets, and only the
narrow (bucket, row count) table is needed to know every row's shard and slot.

Defined cases: a null text has size 8 and the checksum of no bytes; null ids and repeated
rows are rows like others, each with its own slot; an empty table gives an empty result;
extra columns are carried along, those named like a result column as ``<name>_in``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from rankfold.llm.common import buckets_for, extended, stage, total_bytes

ROW_OVERHEAD = 8
RESULT = ("size", "text_crc32", "law", "shard", "slot", "grown_shard", "bucket", "position")


def scatter_and_shuffle(docs: DataFrame, seed: int = 0, bucket_bytes: int = 32 << 20) -> DataFrame:
    """Write ``docs`` bucket by bucket, each in its own seeded random order (columns bucket, position)."""
    docs = docs.select(*[F.col(f"`{c}`").alias(f"{c}_in" if c in RESULT else c) for c in docs.columns])
    buckets = buckets_for(total_bytes(docs, "text"), bucket_bytes, docs.sparkSession)
    keyed = docs.withColumn("__key", F.xxhash64(F.lit(seed), "doc_id", F.monotonically_increasing_id()))
    keyed = keyed.withColumn("bucket", F.pmod(F.col("__key"), F.lit(buckets)).cast("int"))
    out = extended(docs.schema, "bucket int, position long")

    def fisher_yates(table: pa.Table) -> pa.Table:
        keys = table.column("__key").to_numpy()
        bucket = table.column("bucket")[0].as_py()
        order = np.argsort(keys, kind="stable")
        shuffled = order[np.random.default_rng([seed & 0xFFFFFFFF, bucket]).permutation(len(order))]
        # Wide offsets: the texts of a bucket may exceed what 32-bit offsets reach.
        kept = table.drop_columns(["__key", "bucket"])
        wide = pa.schema([f.with_type(pa.large_string()) if pa.types.is_string(f.type) else f for f in kept.schema])
        kept = kept.cast(wide).take(pa.array(shuffled)).cast(kept.schema)
        return kept.append_column("bucket", pa.array(np.full(len(order), bucket, np.int32))) \
                   .append_column("position", pa.array(np.arange(len(order))))

    return stage(keyed.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(fisher_yates, out), "shuffled")


def deal(shuffled: DataFrame, shards: int) -> DataFrame:
    """Add shard and slot: the global order is dealt to the shards one row at a time."""
    counts = shuffled.groupBy("bucket").agg(F.count("*").alias("__n"))
    # One row per memory-sized bucket: the only window without partitions, a bucket count long.
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    rank = F.col("__base") + F.col("position")
    return (shuffled.join(bases, "bucket")
            .withColumn("shard", (rank % shards).cast("int")).withColumn("slot", F.floor(rank / shards).cast("long")).drop("__base"))


def shard_documents(docs: DataFrame, shards: int = 24, seed: int = 0, bucket_bytes: int = 32 << 20) -> DataFrame:
    """Every row with its size, checksum, shard and gapless slot under the law ``rows``."""
    dealt = deal(scatter_and_shuffle(docs, seed, bucket_bytes), shards)
    return (dealt.withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + ROW_OVERHEAD)
            .withColumn("text_crc32", F.crc32(F.coalesce("text", F.lit("")).cast("binary")))
            .withColumn("law", F.lit("rows")).withColumn("grown_shard", F.lit(None).cast("int")))


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write the shards as folders ``shard=<n>`` with their rows in slot order within each file."""
    sharded.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
