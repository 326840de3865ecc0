"""What the corpus operators share: word kernels, materialising, graph components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Java and Python form of the word pattern; bytes.split() splits at the same characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> str:
    """A column's name as Spark parses it, dots and ticks included."""
    return "`" + name.replace("`", "``") + "`"


def columns(df: DataFrame) -> list[Column]:
    """All columns of df, whatever their names."""
    return [F.col(quoted(c)) for c in df.columns]


def unused(df: DataFrame, name: str, others: Iterable[str] = ()) -> str:
    """A helper column's name that df (heedless of case) and others don't have."""
    taken = {c.lower() for c in (*df.columns, *others)}
    while name.lower() in taken:
        name = "_" + name
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as spark.checkpoint.dir names it; where it is unset, a temporary one in local mode
    (tests), and an error on a cluster, whose machines don't share such a folder."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="massloom-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def materialize(df: DataFrame) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts the lineage, fixes row
    identities, and survives lost executors. The files go when release() says so, or when the driver's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/massloom/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _file_system(spark, path).deleteOnExit(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path))
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def _file_system(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def release(*written: DataFrame) -> None:
    """Delete the files of materialized frames that nothing reads any more."""
    for df in written:
        path = df._written
        _file_system(df.sparkSession, path).delete(df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path), True)


def text_or_empty(array: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return [b"" if t is None else t for t in array.cast(pa.binary()).to_pylist()]


_hash = xxhash.xxh3_64_intdigest
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers, in an array."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hash, words), np.uint64, len(words))


def hash_grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all windows of n words (order matters); empty if there are fewer words."""
    if len(words) < n:
        return words[:0]
    out = words[: len(words) - n + 1]
    for i in range(1, n):
        out = mix64(out * _K1 + np.uint64(i)) + words[i : len(words) - n + 1 + i] * _K2
    return mix64(out)


def map_arrow(df: DataFrame, kernel: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | StructType, rows: int = 2048) -> DataFrame:
    """mapInArrow over slices of at most `rows` rows, so that few texts are held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield kernel(batch.slice(at, rows))

    return df.mapInArrow(run, schema)


#: At most this many keys are broadcast by join_counted.
HEAVY = 10_000


def join_counted(left: DataFrame, right: DataFrame, on: str, n: str) -> DataFrame:
    """Inner join with right, which has one row per key and in n how many rows of left hold it. Keys of more than 1 / HEAVY of
    left's rows are at most HEAVY and are broadcast; the others meet by merge, and no task gets more of one of them
    than that share. right should be written (it is read three times); n is dropped; null keys join with nothing."""
    total = right.agg(F.sum(n)).first()[0] or 0
    most = max(1000, total // HEAVY)
    heavy, light = F.broadcast(right.where(F.col(n) > most).drop(n)), right.where(F.col(n) <= most).drop(n)
    # left is read once where all keys are of one kind
    if light.isEmpty():
        return left.join(heavy, on)
    if right.where(F.col(n) > most).isEmpty():
        return left.join(light.hint("merge"), on)
    return left.join(heavy, on).unionByName(left.join(heavy.select(on), on, "left_anti").join(light.hint("merge"), on))


class Union:
    """Union-find over 0..n-1 whose roots are the smallest members."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph given as edges (a, b) of any orderable type.

    Returns (node, component), the component being the smallest node in it. Alternates
    large-star and small-star steps, each a minimum over neighbours with map-side combining;
    a star's centre is only ever joined, never collected, so a hub of any degree is fine.
    Every round is written to the shared folder, in place of the round before, with the number of changed edges
    deciding the end. Null ends and self loops: a self loop gives its node; edges with a null end are ignored.
    """
    edges = edges.where("a is not null and b is not null")
    held = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    nodes = held.select(F.col("a").alias("node")).union(held.select("b")).distinct()
    now, last, before = held.where("a <> b"), None, None
    for _ in range(rounds):
        # large star: every neighbour above a node goes to the least of its neighbourhood
        both = now.union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # a node that is the least of its own neighbourhood keeps its links to those above it
        large = large.where("a <> b").distinct()
        # small star: the neighbours below a node, and the node, go to the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a")
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        now = materialize(small.distinct())
        if last is not None:
            release(last)
        last = now
        # fixed point: sums of hashed edges no longer change
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or state[0] == 0:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    return nodes.join(now.select(F.col("a").alias("node"), F.col("b").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
