"""Shared pieces: written intermediates, bounded Arrow batches, word hashes and connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.operators.ordered import shared_folder

#: A side of a join is broadcast only when it has been counted and has no more rows than this.
BROADCAST_ROWS = 1_000_000
#: Text bytes worked on at once inside a task.
BATCH_BYTES = 2 << 20
#: Rows of one Arrow batch: texts may be long, so fewer than Spark's default.
ARROW_ROWS = 1000


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write once to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark, path = df.sparkSession, shared_folder(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Bound the rows of one Arrow batch for operators over whole texts."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) != ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast after counting the rows; larger sides are joined by shuffle."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


#: Keys of more rows than this, or than a 4096th of all rows if that is more, are frequent: at most 4096.
FREQUENT_ROWS = 1000


def spread_join(rows: DataFrame, table: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join written rows with a table of small rows by one column; the rows of frequent keys stay where they are, and the table's are broadcast."""
    limit = max(FREQUENT_ROWS, rows.count() >> 12)
    found = rows.groupBy(key).count().where((F.col("count") > limit) & F.col(key).isNotNull()).select(key)
    hot = F.broadcast(rows.sparkSession.createDataFrame(found.collect(), found.schema))
    few = F.broadcast(table.join(hot, key, "left_semi"))
    return rows.join(hot, key, "left_semi").join(few, key, how).unionByName(rows.join(hot, key, "left_anti").join(table, key, how))


def slices(batches: Iterator[pa.RecordBatch], column: str, size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the column holds about `size` bytes in each piece (one long text stays whole)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        width = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        piece = (np.cumsum(width, dtype=np.int64) - width) // size
        cuts = np.flatnonzero(np.diff(piece)) + 1
        start = 0
        for stop in [*cuts.tolist(), batch.num_rows]:
            yield batch.slice(start, stop - start)
            start = stop
    pa.default_memory_pool().release_unused()


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash, on uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of each text and the row offsets into them.

    Words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z; null texts have none.
    """
    import xxhash

    words = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    ends = words.offsets.to_numpy().astype(np.int64)
    coded = words.values.slice(ends[0], ends[-1] - ends[0]).dictionary_encode()
    ends = ends - ends[0]
    digest = xxhash.xxh3_64_intdigest
    table = np.fromiter((digest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    codes = coded.indices.to_numpy(zero_copy_only=False)
    empty = pc.index(coded.dictionary, "").as_py()
    keep = codes != empty if empty >= 0 else np.ones(len(codes), bool)
    seen = np.concatenate([[0], np.cumsum(keep)])
    return table[codes[keep]], seen[ends]


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of the word shingles of each text; fewer words than `width`: the whole sequence as one."""
    hashes, ends = word_hashes(texts)
    n = len(hashes)
    rolled = np.full(max(0, n - width + 1), width, np.uint64)
    for i in range(width):
        rolled = mix(rolled * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + len(rolled)])
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
        if b - a >= width:
            own = np.sort(rolled[a : b - width + 1])
            yield own[np.concatenate([[True], own[1:] != own[:-1]])]
        elif b > a:
            h = np.full(1, b - a, np.uint64)
            for i in range(a, b):
                h = mix(h * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + 1])
            yield h
        else:
            yield np.empty(0, np.uint64)


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over the (a, b) edges, for every node that has one.

    Alternates linking larger neighbours and smaller neighbours to the local minimum until no edge
    changes; every round is written to the shared folder and compared by count and checksum.
    """
    spark = edges.sparkSession
    now = written(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )

    def state(e: DataFrame):
        r = e.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("sum(cast(hash(u, v) as bigint))")).first()
        return tuple(r)

    before = state(now)
    while before[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
        )).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        now = written(small, "edges")
        after = state(now)
        if after == before:
            break
        before = after
    pairs = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return pairs.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
