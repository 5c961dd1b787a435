"""Shared helpers: reading tables, cutting lineage, hashing words, components of a graph."""

from __future__ import annotations

import atexit
import contextlib
import itertools
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the plain word rule, for SQL and regular expressions.
WORD = r"[^\x20\x09-\x0D]+"
_SCRATCH: dict[str, list[str]] = {}
_STAGE: dict[str, list[str]] = {}
_OWN: dict[str, str] = {}
_TOPS: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is set and all run on this machine."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        where = _OWN[app] = _OWN.get(app) or "file://" + tempfile.mkdtemp(prefix="purselight-")
    return where.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, remembered for clear_scratch()."""
    app = spark.sparkContext.applicationId
    top = f"{shared_dir(spark)}/purselight-{app}"
    if top not in _TOPS and top.startswith(("file:", "/")):
        _TOPS.add(top)
        atexit.register(shutil.rmtree, top.removeprefix("file:").replace("//", "/"), ignore_errors=True)
    path = f"{top}/{name}-{uuid.uuid4().hex}"
    _SCRATCH.setdefault(app, []).append(path)
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: what follows survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def drop_table(df: DataFrame) -> None:
    """Delete the files of a table that cut() wrote and nothing reads any more."""
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        delete(df.sparkSession, path)


def clear_scratch(spark: SparkSession) -> None:
    """Delete all tables that cut() wrote in this application."""
    for path in _SCRATCH.pop(spark.sparkContext.applicationId, []):
        delete(spark, path)


@contextlib.contextmanager
def stage_scratch(spark: SparkSession) -> Iterator[None]:
    """Remembers the tables that cut() writes meanwhile as those of a stage."""
    app = spark.sparkContext.applicationId
    before = len(_SCRATCH.setdefault(app, []))
    yield
    _STAGE.setdefault(app, []).extend(_SCRATCH[app][before:])


def release_stage(spark: SparkSession) -> None:
    """Delete the tables of the stages so far; call it when their results are written."""
    for path in _STAGE.pop(spark.sparkContext.applicationId, []):
        delete(spark, path)


def binaries(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A string column as UTF-8 bytes; null as empty."""
    return [x if x is not None else b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def keep_batches_small(spark: SparkSession, most: str = "4m") -> None:
    """Let Arrow batches hold 4 MiB where the session has Spark's default of 64, which each task holds several times."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == "67108864b":
        spark.conf.set(name, most)


def map_batches(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | list | None], schema: str) -> DataFrame:
    """mapInArrow with a function of one batch that gives one batch, several or none."""
    keep_batches_small(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            out = f(batch)
            yield from ([out] if isinstance(out, pa.RecordBatch) else out or [])
            del batch, out
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


class HashSet:
    """Sorted 64-bit hashes with a bitmap in front, which spares most look-ups the search."""

    def __init__(self, hashes: np.ndarray, bits: int = 20):
        self.keys, self.shift = np.sort(hashes), np.uint64(64 - bits)
        self.bitmap = np.zeros(1 << bits, bool)
        self.bitmap[self.keys >> self.shift] = True

    def places(self, g: np.ndarray) -> np.ndarray:
        """Places in g whose hash is in the set."""
        at = np.nonzero(self.bitmap[g >> self.shift])[0]
        if not len(at):
            return at
        k = np.minimum(np.searchsorted(self.keys, g[at]), len(self.keys) - 1)
        return at[self.keys[k] == g[at]]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words, one per start; empty for fewer words."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out = mix(out + hashes[k : k + m] + np.uint64(0x9E3779B97F4A7C15))
    return out


def shingle_set(words: list[bytes], n: int = 5) -> np.ndarray:
    """Sorted distinct hashes of n-word shingles; all words as one if there are fewer; empty without words."""
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(grams(word_hashes(words), min(n, len(words))))


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """Connected components of undirected edges (a, b): rows (node, component), component the least node reached.

    Alternates large-star and small-star steps. Each step regroups edges by a node and keeps only links to that
    node's least neighbour, so a hub's list is never gathered: the least neighbour comes from a partial
    aggregate and is joined back. Every round is written to the shared folder.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    digest = F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.shiftright(F.xxhash64("v", "u"), 20))
    was = tuple(e.agg(*digest).first())
    for _ in range(rounds if was[0] else 0):
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        new = cut(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = tuple(new.agg(*digest).first())
        drop_table(e)
        e = new
        if now == was:
            break
        was = now
    else:
        if was[0]:
            raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def blocks(total: int, size: int) -> Iterator[tuple[int, int]]:
    """Ranges that cover 0..total."""
    for a in itertools.count(0, size):
        if a >= total:
            return
        yield a, min(total, a + size)
