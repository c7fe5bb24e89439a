"""Two-pass external shuffle: scatter uniformly into memory-sized buckets by a seeded hash, then Fisher-Yates each bucket.

The concatenated buckets are one random permutation of the table; it is cut into `shards` runs of positions whose
lengths differ by at most one (law "rows"). The hash is taken of the seed and the record's place (file and row in it), not of a
key, so copies and hot keys spread evenly, and the permutation depends on the seed and the files only, not on the cluster.
A plain scan of Parquet files knows its places however it is split; any other input is written to the shared folder first, as
numbering its rows twice could give two numberings.

Memory: a bucket holds about `bucket_bytes` of text whatever the input, and a task GROUP of them; their number grows with the
bytes. Their offsets are running sums made by DataFrame functions, first over runs of RUN buckets, then over the runs, and reach
their bucket by a cogroup: nothing is collected or broadcast.

Nulls, empty and repeated rows are records like others, so ties need no rule; a text longer than bucket_bytes makes its
bucket as much larger. Columns are passed on untouched, whatever they are called, except that names the operator adds (size, law,
shard, slot) replace such input columns. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window, types as T
from pyspark.sql import functions as F

from .common import materialise, numbered, with_place

GROUP = 2
RUN = 4096
_ADDED = ("size", "law", "shard", "slot")


def fisher_yates(n: int, seed: tuple[int, ...]) -> np.ndarray:
    """A permutation of range(n) by swapping each place, from the last, with a uniformly drawn earlier one."""
    order = np.arange(n)
    drawn = (np.random.default_rng(seed).random(n) * (np.arange(n) + 1)).astype(np.int64)
    for i in range(n - 1, 0, -1):
        j = drawn[i]
        order[i], order[j] = order[j], order[i]
    return order


def _shuffle(total: int, shards: int, seed: int, bucket_col: str, place: str) -> Callable:
    def run(key: tuple[pa.Scalar, ...], bucket: pa.Table, offset: pa.Table) -> pa.Table:
        places = [pa.compute.struct_field(bucket.column(place), k) for k in (0, 1)]
        order = pa.compute.sort_indices(pa.table(places, names=["file", "row"]), sort_keys=[("file", "ascending"), ("row", "ascending")])
        bucket = bucket.drop_columns([bucket_col, place]).take(order)
        bucket = bucket.take(pa.array(fisher_yates(bucket.num_rows, (seed, key[0].as_py()))))
        at = offset.column("before")[0].as_py() + np.arange(bucket.num_rows, dtype=np.int64)
        # Python's integers would be needed beyond 2**63 / shards rows.
        shard = at * shards // total
        first = -(-shard * total // shards)
        return bucket.append_column("shard", pa.array(shard.astype(np.int32))).append_column("slot", pa.array(at - first))

    return run


def _offsets(counts: DataFrame) -> DataFrame:
    """(bucket, n) to (bucket, before): the rows of all buckets before it. A run's buckets meet, then the runs' sums."""
    run = F.floor(F.col("bucket") / RUN).cast("long")
    inside = counts.withColumn("run", run).withColumn("inside", F.sum("n").over(Window.partitionBy("run").orderBy("bucket")) - F.col("n"))
    runs = counts.groupBy(run.alias("run")).agg(F.sum("n").alias("all"))
    runs = runs.withColumn("before_run", F.sum("all").over(Window.orderBy("run")) - F.col("all"))  # a row for RUN buckets
    return inside.join(runs.drop("all"), "run").select("bucket", (F.col("inside") + F.col("before_run")).alias("before"))


def external_shuffle(df: DataFrame, shards: int, text_col: str = "text", seed: int = 17, bucket_bytes: int = 16 << 20) -> DataFrame:
    """Adds size (UTF-8 bytes of the text plus 1), law, shard and slot (place in the shard, gapless from 0) to every row."""
    df = df.drop(*_ADDED)
    bucket_col, place = "bucket", "place"
    given = numbered(df)
    records = with_place(given, place)
    octets = F.octet_length(F.col(f"c{df.columns.index(text_col)}").cast("string"))
    rows, total_bytes = records.select(F.count(F.lit(1)), F.coalesce(F.sum(octets), F.lit(0))).first()
    buckets = -(-(total_bytes + 64 * rows) // bucket_bytes) or 1
    placed = records.withColumn(bucket_col, F.pmod(F.xxhash64(F.lit(seed), f"{place}.file", f"{place}.row"), F.lit(buckets)))
    counts = materialise(placed.groupBy(F.col(bucket_col).alias("bucket")).agg(F.count("*").alias("n")))
    tasks = -(-buckets // GROUP)
    out = T.StructType([*given.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])
    dealt = placed.repartition(tasks, bucket_col).groupBy(bucket_col)
    offsets = _offsets(counts).repartition(tasks, "bucket").groupBy("bucket")
    shuffled = dealt.cogroup(offsets).applyInArrow(_shuffle(max(1, rows), shards, seed, bucket_col, place), out)
    sized = shuffled.withColumn("size", F.coalesce(octets, F.lit(0)).cast("long") + 1).withColumn("law", F.lit("rows"))
    return sized.toDF(*df.columns, "shard", "slot", "size", "law")


def write_shards(shuffled: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Writes a folder for each shard; the rows of a file keep the order of their slots."""
    shuffled.repartition("shard", F.floor(F.col("slot") / 1_000_000)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").format(fmt).save(path)
