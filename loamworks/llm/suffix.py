"""Exact repeated byte strings by a logarithmic family of sparse suffix arrays."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MIX1, Scratch, by_group, key_filter, mix, only, prefix_hash, span_hash, table

LENGTH = 400
PREFIX = 128  # bytes by which suffixes are ordered first
ENTRY = "head binary, whash long, key long, a int, back int, fwd int"
MATCH = "khash long, whash long, key long, a int, back int, fwd int"
HOT = 4000  # windows with one prefix that a task compares at once


def window_min(v: np.ndarray, w: int) -> np.ndarray:
    """The least of every w neighbours."""
    m = len(v) - w + 1
    full = np.full(-(-len(v) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    full[: len(v)] = v
    rows = full.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:m], ahead[w - 1 : w - 1 + m])


def anchors(text: np.ndarray, length: int, prefix: int) -> tuple[np.ndarray, ...] | None:
    """The sampled suffixes of a text: their first `prefix` bytes, hash of their window, place, and the window's reach.

    Every string of `length` bytes is owned by the suffix in it whose first bytes hash least (the
    leftmost, if equal), so equal strings are owned at the same place inside them. A suffix's
    window is what the strings that it owns cover: those that start at a - back to a + fwd.
    """
    n = len(text)
    if n < length:
        return None
    c = prefix_hash(text)
    at = np.arange(n - prefix + 1)
    h = span_hash(c, at, at + prefix)
    v = (h & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    own = (window_min(v, length - prefix + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    cut = np.flatnonzero(np.diff(own))
    lo, hi = np.append(0, cut + 1), np.append(cut, len(own) - 1)
    a = own[lo]
    whash = mix(span_hash(c, lo, hi + length) + (a - lo).astype(np.uint64) * MIX1)
    heads = np.lib.stride_tricks.sliding_window_view(text, prefix)[a]
    return heads, whash.view(np.int64), a, a - lo, hi - a


def _bytes(text: pa.Scalar) -> np.ndarray:
    return np.frombuffer(text.as_buffer(), np.uint8) if text.is_valid and len(text.as_buffer()) else np.zeros(0, np.uint8)


def _entries(length: int, prefix: int, batches_: int):
    def run(batches):
        for b in batches:
            out, keys, n = [], [], 0
            for key, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if got := anchors(_bytes(text), length, prefix):
                    out.append(got)
                    keys.append(np.full(len(got[0]), key, np.int64))
                    n += len(got[0])
                if n > 100_000:
                    yield _batch(out, keys, batches_)
                    out, keys, n = [], [], 0
            if out:
                yield _batch(out, keys, batches_)

    return run


def _batch(out, keys, batches_: int) -> pa.RecordBatch:
    head, wh, a, back, fwd = (np.concatenate(c) for c in zip(*out, strict=True))
    key = np.concatenate(keys)
    batch = (mix(key.view(np.uint64)) % np.uint64(batches_)).astype(np.int32)
    n, width = head.shape
    at = pa.py_buffer(np.arange(0, (n + 1) * width, width, dtype=np.int32))
    heads = pa.Array.from_buffers(pa.binary(), n, [None, at, pa.py_buffer(np.ascontiguousarray(head))])
    return pa.RecordBatch.from_arrays([heads, pa.array(wh), pa.array(key), *(pa.array(x.astype(np.int32)) for x in (a, back, fwd)), pa.array(batch)], ["head", "whash", "key", "a", "back", "fwd", "batch"])


def _scan(batches):
    """Over suffixes in order: 2 for one whose neighbour has the same window, 1 for one whose neighbour has the same
    first bytes. Others are left out, but for the first and the last of the partition, whose neighbours lie elsewhere.
    """
    pid = TaskContext.get().partitionId()
    held, left, start = None, 0, True

    def out(t: pa.Table, state: np.ndarray, edge: np.ndarray):
        keep = np.flatnonzero((state > 0) | (edge > 0))
        t = t.take(pa.array(keep)).combine_chunks()
        cols = [t.column(i).combine_chunks() if t.column(i).num_chunks != 1 else t.column(i).chunk(0) for i in range(6)]
        return pa.RecordBatch.from_arrays([*cols, pa.array(state[keep].astype(np.int32)), pa.array(edge[keep].astype(np.int32)), pa.array(np.full(len(keep), pid, np.int32))], [*t.column_names, "state", "edge", "pid"])

    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([held, b] if held is not None else [b])
        n, k, w = t.num_rows, t.column(0), t.column(1).to_numpy()
        same = pc.equal(k.slice(1), k.slice(0, n - 1)).to_numpy().astype(np.int8) * (1 + (w[1:] == w[:-1]))
        state = np.zeros(n, np.int8)
        state[0] = left
        np.maximum(state[1:], same, out=state[1:])
        np.maximum(state[:-1], same, out=state[:-1])
        left = int(same[-1]) if len(same) else left
        edge = np.zeros(n, np.int8)
        edge[0] = start
        held = b.slice(b.num_rows - 1)
        if n > 1:
            got = out(t.slice(0, n - 1), state[:-1], edge[:-1])
            start = False
            if got.num_rows:
                yield got
    if held is not None:
        yield out(pa.Table.from_batches([held]), np.array([left]), np.array([2 + start]))


class SuffixIndex:
    """A family of suffix arrays, each a table of suffixes in order, whose sizes grow geometrically.

    A batch's array is merged with the arrays there are in one ordered pass that finds the
    suffixes with long matches; it then becomes a level of its own, and levels of equal size are merged before
    the next batch comes. Suffixes are in lexicographic order of their first bytes (the shortest match
    that matters is longer), and those alike in them in order of the hash of their window, so equal
    ones are neighbours. The order is dealt out by range, with document and place as last keys, so
    one frequent string spreads over tasks.
    """

    KEYS = ("head", "whash", "key", "a")

    def __init__(self, scratch: Scratch):
        self.scratch, self.levels, self.found = scratch, [], None

    def _ordered(self, df: DataFrame) -> DataFrame:
        return df.repartitionByRange(*self.KEYS).sortWithinPartitions(*self.KEYS)

    def add(self, batch: DataFrame) -> None:
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (n, x), (_, y) = self.levels.pop(), self.levels.pop()
            self.levels.append((n + 1, self.scratch.cut(self._ordered(x.unionByName(y)), "level")))
            self.scratch.drop(x, y)
        merged = batch
        for _, level in self.levels:
            merged = merged.unionByName(level)
        seen = self._ordered(merged).mapInArrow(_scan, f"{ENTRY}, state int, edge int, pid int")
        got = self.scratch.cut(seen.select(F.xxhash64("head").alias("khash"), *seen.columns[1:]), "matches")
        self.levels.append((0, batch))
        rows = got.where("state > 0").drop("edge", "pid")
        ends = got.where("edge > 0").orderBy("pid", "edge").collect()  # two rows a partition at most
        more = []
        for x, y in zip(ends[:-1], ends[1:], strict=True):
            if x["pid"] != y["pid"] and x["khash"] == y["khash"]:
                more += [(*r[:6], 1 + (x["whash"] == y["whash"])) for r in (x, y)]
        if more:
            rows = rows.unionByName(self.scratch.spark.createDataFrame(more, f"{MATCH}, state int"))
        self.found = rows if self.found is None else self.found.unionByName(rows)

    def matches(self) -> DataFrame:
        """The suffixes with matches, and how far they go: state 2 for the whole window, 1 for the first bytes at least."""
        return self.found.groupBy("key", "a").agg(F.max("state").alias("state"), *(F.any_value(c).alias(c) for c in ("khash", "whash", "back", "fwd")))


def _windows(length: int):
    """The bytes of the windows of some suffixes of each document."""

    def run(batches):
        types = [pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        for b in batches:
            rows: list[tuple] = []
            size = 0
            for key, text, some in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                data = _bytes(text)
                for s in some:
                    lo, hi = s["a"] - s["back"], s["a"] + s["fwd"]
                    rows.append((s["khash"], key, lo, data[lo : hi + length].tobytes()))
                    size += hi - lo + length
                if size > 4_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["khash", "key", "lo", "data"])
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["khash", "key", "lo", "data"])

    return run


def _strings(data: bytes, length: int) -> np.ndarray:
    """Hashes of the strings of `length` bytes in a window."""
    x = np.frombuffer(data, np.uint8)
    at = np.arange(len(x) - length + 1)
    return span_hash(prefix_hash(x), at, at + length)


def _runs(key: int, lo: int, twice: np.ndarray, out: list) -> None:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], twice.astype(np.int8), [0]])))
    out += [(key, lo + int(i), lo + int(j) - 1) for i, j in zip(edges[::2], edges[1::2], strict=True)]


def _compare(length: int):
    """Which strings in the windows of one prefix occur twice, as runs of starts (key, lo, hi)."""

    def run(t: pa.Table) -> pa.Table | None:
        hashes = [_strings(x.as_py(), length) for x in t.column("data")]
        _, back, count = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
        twice, at, out = count[back] > 1, 0, []
        for key, lo, h in zip(t.column("key").to_pylist(), t.column("lo").to_pylist(), hashes, strict=True):
            _runs(key, lo, twice[at : at + len(h)], out)
            at += len(h)
        return pa.table([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["key", "lo", "hi"]) if out else None

    return run


def _positions(length: int):
    def run(batches):
        for b in batches:
            for kh, key, lo, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                h = _strings(data, length)
                n = len(h)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, kh)), pa.array(h.view(np.int64)), pa.array(np.full(n, key)), pa.array(np.arange(lo, lo + n))], ["khash", "h", "key", "p"])

    return run


def keyed(docs: DataFrame) -> DataFrame:
    """key, doc_id, text; rows that share doc_id and text share their key."""
    text = F.col("text").cast("string")
    return docs.select(F.xxhash64(F.col("doc_id").cast("long"), text).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))


def repeats(docs: DataFrame, scratch: Scratch, length: int = LENGTH, prefix: int = PREFIX, batches: int = 4, hot: int = HOT) -> DataFrame:
    """(key, lo, hi): the starts, lo to hi, of strings of `length` bytes that start elsewhere too.

    Suffixes whose whole window recurs need no more. Of those that only share their first bytes,
    the windows themselves are fetched and compared string by string, with one of each recurring
    window beside them; for first bytes that more than `hot` of them share, each string becomes a
    row of a pre-aggregated count instead, so no task has to hold them all.
    """
    spark = docs.sparkSession
    rows = keyed(docs).select("key", "text")
    entries = scratch.cut(rows.mapInArrow(_entries(length, prefix, batches), f"{ENTRY}, batch int"), "entries")
    index = SuffixIndex(scratch)
    for b in range(batches):
        index.add(entries.where(F.col("batch") == b).drop("batch"))
    found = scratch.cut(index.matches(), "found")
    whole = found.where("state = 2").select("key", (F.col("a") - F.col("back")).cast("long").alias("lo"), (F.col("a") + F.col("fwd")).cast("long").alias("hi"))
    part = found.where("state = 1").select("khash", "key", "a", "back", "fwd")
    one = found.where("state = 2").groupBy("khash", "whash").agg(F.min(F.struct("key", "a", "back", "fwd")).alias("x")).select("khash", "x.*")
    some = part.unionByName(one.join(part.select("khash").distinct(), "khash", "left_semi"))
    some = some.groupBy("key").agg(F.collect_list(F.struct("khash", "a", "back", "fwd")).alias("some"))
    some = scratch.cut(some, "parts")
    held = spark.sparkContext.broadcast(key_filter(some))
    texts = rows.mapInArrow(only(held, True), "key long, text string")
    windows = scratch.cut(texts.join(some, "key").mapInArrow(_windows(length), "khash long, key long, lo int, data binary").dropDuplicates(["khash", "key", "lo"]), "windows")
    many = windows.groupBy("khash").count().where(F.col("count") > hot).select("khash")
    out = whole
    if many.isEmpty():
        out = out.unionByName(by_group(windows, ["khash"], _compare(length), "key long, lo long, hi long"))
    else:
        many = scratch.cut(many, "hot")
        out = out.unionByName(by_group(windows.join(many, "khash", "left_anti"), ["khash"], _compare(length), "key long, lo long, hi long"))
        at = windows.join(many, "khash", "left_semi").select("khash", "key", "lo", "data").mapInArrow(_positions(length), "khash long, h long, key long, p long")
        twice = at.groupBy("khash", "h").agg(F.count("*").alias("c")).where("c > 1").select("khash", "h")
        out = out.unionByName(at.join(twice, ["khash", "h"], "left_semi").select("key", F.col("p").alias("lo"), F.col("p").alias("hi")))
    return out


def spans(marks: list[dict] | None, length: int) -> list[tuple[int, int]]:
    """Maximal byte runs covered by strings that start at lo to hi."""
    out: list[list[int]] = []
    for lo, hi in sorted((m["lo"], m["hi"] + length) for m in marks or ()):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [tuple(x) for x in out]


def _removed(length: int, texts: bool, filter_=None):
    """With a filter, only for the documents whose key is not in it, as their first step."""

    def run(batches):
        for b in batches if filter_ is None else (x.select(["doc_id", "text"]) for x in only(filter_, False)(batches)):
            got = []
            marks = b.column(2).to_pylist() if b.num_columns > 2 else [None] * b.num_rows
            for text, some in zip(b.column(1), marks, strict=True):
                data = _bytes(text).tobytes()
                cut = spans(some, length)
                kept = b"".join(data[i:j] for i, j in zip([0, *(e for _, e in cut)], [*(s for s, _ in cut), len(data)], strict=True)) if cut else data
                got.append((len(data), sum(j - i for i, j in cut), len(cut), hashlib.sha256(kept).hexdigest(), [{"start": i, "end": j} for i, j in cut], kept if texts else None))
            cols = list(zip(*got, strict=True)) if got else [[]] * 6
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            arrays = [b.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string()), pa.array(cols[4], span)]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(cols[5], pa.binary())] * texts, names + ["kept"] * texts)

    return run


def remove_repeats(docs: DataFrame, scratch: Scratch, length: int = LENGTH, batches: int = 4, texts: bool = False, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (and kept, the bytes left, with `texts`) of every document.

    Removed is each byte covered by a string of `length` bytes that also starts anywhere else, in
    the same document or another, as judged on the input. Matches never cross documents.

    Null text: no bytes. Shorter texts: unchanged. Overlaps of a string with itself count. Repeated
    rows, with the same doc_id or not: copies of each other. Very long texts: whole. Null doc_id:
    kept. Empty table: no rows. Other columns are not read. Strings are compared by 64-bit hashes
    within groups that agree in 64 further bits.
    """
    marks = scratch.cut(repeats(docs, scratch, length, min(PREFIX, max(1, length // 3)), batches, hot), "marks")
    marks = marks.groupBy("key").agg(F.collect_list(F.struct("lo", "hi")).alias("marks"))
    held = docs.sparkSession.sparkContext.broadcast(key_filter(marks))
    rows = keyed(docs).select("key", "doc_id", "text")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: long, end: long>>" + ", kept binary" * texts
    clean = rows.mapInArrow(_removed(length, texts, held), schema)
    cut = rows.mapInArrow(only(held, True), "key long, doc_id long, text string").join(marks, "key", "left").select("doc_id", "text", "marks").mapInArrow(_removed(length, texts), schema)
    return clean.unionByName(cut)


def op5_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), Scratch(spark)).drop("spans")
