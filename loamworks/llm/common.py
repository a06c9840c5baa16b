"""Helpers shared by the operators of this subpackage: scratch tables, text buffers, components."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the word rule `[^\x20\x09-\x0D]+`, by byte.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Unset, it is a temporary folder of this machine where driver and executors are one process, as in tests;
    a cluster without the setting is refused, for its executors would not see each other's files.
    """
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return base
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError(f"spark.checkpoint.dir has to name a folder that driver and executors of {master or 'the cluster'} share")
    return _own_dir()


@lru_cache(maxsize=1)
def _own_dir() -> str:
    path = tempfile.mkdtemp(prefix="loamworks-")
    atexit.register(shutil.rmtree, path, True)
    return f"file://{path}"


class Scratch:
    """Intermediate tables in the shared folder. They cut lineage and outlive a lost executor.

    As a context it removes its tables at the end, which is for results that are written inside
    it; a lazy result still reads them, so its caller keeps the Scratch and calls `close` afterwards.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/loamworks/{uuid.uuid4().hex}"
        self._n = 0

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        self._remove(self.root)

    def path(self, name: str = "t") -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def cut(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Writes df as Parquet and returns a DataFrame over the files."""
        path = self.path(name)
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *dfs: DataFrame) -> None:
        """Removes tables that nothing reads any more."""
        for df in dfs:
            if path := getattr(df, "_scratch_path", None):
                self._remove(path)

    def _remove(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


#: Bytes of text that a model is fitted on at most; what a driver gathers is a few times that.
MOST_BYTES = 128 << 20


def one_text(docs: DataFrame, pick: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """The columns of pick (_id, ...; of a bounded size) and `text`: one row a document, however often its doc_id repeats, with the least of its texts.

    Documents are taken in the order of a hash of their id while all texts taken have `most_bytes` at most; one
    that does not fit is passed over. Only ids and lengths of `pick` reach the driver for that.
    """
    text = docs.select(F.col("doc_id").alias("_doc"), F.col("text").cast("string").alias("text"))
    out = text.join(F.broadcast(pick), F.col("_doc") == F.col("_id")).groupBy(*pick.columns).agg(F.min("text").alias("text"))
    sizes = out.select("_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n"), F.xxhash64("_id").alias("h")).collect()
    if sum(r["n"] for r in sizes) <= most_bytes:
        return out
    left, fit = most_bytes, []
    for r in sorted(sizes, key=lambda r: (r["h"], r["_id"])):
        if r["n"] <= left:
            left -= r["n"]
            fit.append((r["_id"],))
    return out.join(F.broadcast(docs.sparkSession.createDataFrame(fit, "_id long")), "_id", "left_semi")


def buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets (rows + 1) of a string or binary array; nulls have no bytes."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    _, off, data = arr.buffers()
    off = np.frombuffer(off, np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if arr.null_count:
        size = np.diff(off) * np.asarray(arr.is_valid())
        if (size != np.diff(off)).any():  # a null may hide bytes
            rows = [buf[a : a + n] for a, n in zip(off[:-1], size, strict=True)]
            return np.concatenate(rows), np.concatenate([[0], np.cumsum(size)])
    return buf, off


def slices(arr: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of rows of about `most` bytes (a longer row stands alone): first row, bytes, offsets from 0."""
    buf, off = buffers(arr)
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        j = min(j, n)
        yield i, buf[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def give_back() -> None:
    """Returns to the system what this process has freed. Arrow's pool and the C library keep it otherwise, for as long as a worker lives."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc
        trim(0)


def lean(run: Callable) -> Callable:
    """The function over batches, after which a worker that waits for its next task holds no memory that it doesn't use."""

    def task(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x *= MIX1
    x ^= x >> np.uint64(27)
    x *= MIX2
    x ^= x >> np.uint64(31)
    return x


def word_bounds(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words `[^\\x20\\x09-\\x0D]+` of several texts, and of each text the number of words before it."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    word = ~SPACE[buf]
    first = word.copy()
    first[1:] &= ~word[:-1]
    last = word.copy()
    last[:-1] &= ~word[1:]
    begins = off[:-1][np.diff(off) > 0]
    first[begins] = word[begins]
    ends = off[1:][np.diff(off) > 0] - 1
    last[ends] = word[ends]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, off)


def word_counts(arr: pa.Array) -> np.ndarray:
    out = np.zeros(len(arr), np.int64)
    for i, buf, off in slices(arr):
        _, _, before = word_bounds(buf, off)
        out[i : i + len(off) - 1] = np.diff(before)
    return out


class Powers:
    """Powers of an odd base modulo 2^64 and of its inverse, grown as needed."""

    BASE = 0x9E3779B97F4A7C15 | 1

    def __init__(self):
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            m = 1 << max(16, int(n - 1).bit_length())
            self.up, self.down = _powers(self.BASE, m), _powers(pow(self.BASE, -1, 1 << 64), m)
        return self.up, self.down


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    filled, step = 1, base
    while filled < n:
        m = min(filled, n - filled)
        out[filled : filled + m] = out[:m] * np.uint64(step)
        filled += m
        step = step * step % (1 << 64)
    return out


POWERS = Powers()


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """c with c[j] - c[i], times the inverse power of i, a polynomial hash of buf[i:j]."""
    up, _ = POWERS.get(len(buf) + 1)
    c = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=c[1:])
    return c


def span_hash(c: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans [i, j) under prefix_hash c; the length counts."""
    _, down = POWERS.get(len(c))
    return mix((c[j] - c[i]) * down[i] + (j - i).astype(np.uint64) * MIX2)


#: 64-bit words of a key filter: 2 MB, whatever the number of keys.
FILTER_WORDS = 1 << 18


def key_filter(keys: DataFrame) -> np.ndarray:
    """A bitset of fixed size that holds every key, a 64-bit hash; it may hold others too."""
    rows = keys.select(F.col("key").bitwiseAND(F.lit(FILTER_WORDS - 1)).alias("w"), F.expr("shiftleft(1L, cast(shiftrightunsigned(key, 40) & 63 as int))").alias("b"))
    got = rows.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(FILTER_WORDS, np.uint64)
    out[got.column(0).to_numpy()] = got.column(1).to_numpy().view(np.uint64)
    return out


def _held(words: np.ndarray, key: np.ndarray) -> np.ndarray:
    key = key.view(np.uint64)
    return (words[(key & np.uint64(FILTER_WORDS - 1)).astype(np.int64)] >> ((key >> np.uint64(40)) & np.uint64(63)) & np.uint64(1)).astype(bool)


def only(filter_, want: bool):
    """The rows whose first column, a hash, the broadcast filter holds, or does not."""

    def run(batches):
        for b in batches:
            keep = _held(filter_.value, b.column(0).to_numpy()) == want
            yield b.filter(pa.array(keep))

    return run


class Union:
    """Union-find over 0..n-1; the root is the smallest member."""

    def __init__(self, n: int):
        self.p = list(range(n))

    def find(self, x: int) -> int:
        p = self.p
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.p[max(a, b)] = min(a, b)
        return True


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(v, root) for every endpoint of edges (a, b): root is the smallest id that links reach.

    Alternating large-star and small-star steps over a table of edges; every step is a
    pre-aggregated group-by and an equi-join that the adaptive planner can split on hot
    roots. Each round is written to the shared folder, and nothing is gathered but one
    row with a count and a checksum. Null endpoints and loops are left out.
    """
    e = edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("p")).where("v <> p").distinct()
    e = scratch.cut(e, "edges")
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("p").alias("v"), F.col("v").alias("p")))
        least = both.groupBy("v").agg(F.min("p").alias("m")).select("v", F.least("v", "m").alias("m"))
        large = both.join(least, "v").where("p > v").select(F.col("p").alias("v"), F.col("m").alias("p")).distinct()
        small = large.groupBy("v").agg(F.min("p").alias("m"))
        nxt = large.join(small, "v").select(F.explode(F.array(F.struct("v", F.col("m").alias("p")), F.struct(F.col("p").alias("v"), F.col("m").alias("p")))).alias("x"))
        nxt = scratch.cut(nxt.select("x.v", "x.p").where("v <> p").distinct(), "edges")
        mark = nxt.agg(F.count("*"), F.bit_xor(F.xxhash64("v", "p"))).first()
        scratch.drop(e)
        e = nxt
        if mark == seen:
            break
        seen = mark
    roots = e.select(F.col("p").alias("v")).distinct().join(e.select("v").distinct(), "v", "left_anti")
    return e.select("v", F.col("p").alias("root")).unionByName(roots.select("v", F.col("v").alias("root")))


def groups(batches, keys: int = 1) -> Iterator[pa.Table]:
    """Tables of the rows that share the first `keys` columns, from batches sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        change = np.zeros(b.num_rows - 1, bool)
        for c in b.columns[:keys]:
            v = c.to_numpy(zero_copy_only=False)
            change |= v[1:] != v[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), b.num_rows]
        first = tuple(c[0].as_py() for c in b.columns[:keys])
        if held and first != last:
            yield pa.Table.from_batches(held)
            held = []
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            held.append(b.slice(i, j - i))
            if j < b.num_rows:
                yield pa.Table.from_batches(held)
                held = []
        last = tuple(c[b.num_rows - 1].as_py() for c in b.columns[:keys])
    if held:
        yield pa.Table.from_batches(held)


def by_group(df: DataFrame, keys: list[str], make, schema: str) -> DataFrame:
    """make(table) for the rows of each key, streamed: like applyInArrow, but cheap for many small groups."""

    def run(batches):
        out: list[pa.RecordBatch] = []
        for t in groups(batches, len(keys)):
            if (got := make(t)) is not None and got.num_rows:
                out += got.to_batches()
                if len(out) >= 256:
                    yield from pa.Table.from_batches(out).combine_chunks().to_batches()
                    out = []
        if out:
            yield from pa.Table.from_batches(out).combine_chunks().to_batches()

    rest = [c for c in df.columns if c not in keys]
    return df.select(*keys, *rest).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(lean(run), schema)
