"""Exact top-k inner products over an impact-ordered index, score at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table

OUT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


class Shard:
    """An impact-ordered index of a bounded set of integer vectors.

    Each dimension's postings stand in order of value and are cut into segments of values that
    share a quantised impact. For a query the segments of all dimensions are taken by descending
    impact, as measured from the dimension's least contribution, so unseen contributions lie
    between 0 and the impact of the dimension's next segment.
    """

    def __init__(self, ids: np.ndarray, x: np.ndarray, step: int = 32):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[order], x[order]
        self.low, self.high = self.x.min(0), self.x.max(0)
        self.segments = []  # by dimension, ascending: least value, greatest value, rows, values above the dimension's least, values below its greatest
        for d in range(x.shape[1]):
            v = self.x[:, d]
            rows = np.argsort(v, kind="stable")
            v = v[rows]
            level = (v - v[0]) // max(1, step)
            cuts = np.flatnonzero(np.diff(level)) + 1
            ends = [0, *cuts.tolist(), len(v)]
            self.segments.append([(v[a], v[b - 1], rows[a:b], v[a:b] - v[0], v[a:b] - v[-1]) for a, b in zip(ends[:-1], ends[1:], strict=True)])

    def fitted(self, q: np.ndarray) -> np.ndarray:
        """A query as long as the shard's vectors: what is missing counts 0, what is beyond meets nothing."""
        width = self.x.shape[1]
        return np.pad(q, (0, width - len(q))) if len(q) < width else q[:width]

    def search(self, own: int, q: np.ndarray, k: int, every: int = 32, few: int = 1024) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows that are not `own`; ties go to the smaller id."""
        impact, where = [], []
        for d in np.flatnonzero((q != 0) & (self.high > self.low)):
            w, segs = int(q[d]), self.segments[d]
            best = [w * (int(s[1]) - int(self.low[d])) for s in segs] if w > 0 else [w * (int(s[0]) - int(self.high[d])) for s in segs]
            impact += best
            where += [(d, s) for s in range(len(segs))]
        acc = np.zeros(len(self.ids), np.int64)
        acc[self.ids == own] = np.iinfo(np.int64).min // 4
        order = np.argsort(-np.asarray(impact, np.int64), kind="stable").tolist()
        ahead: dict[int, list[int]] = {}
        for i in order[::-1]:
            ahead.setdefault(where[i][0], []).append(impact[i])
        rest = sum(x[-1] for x in ahead.values())
        maybe = np.arange(len(self.ids))
        for n, i in enumerate(order, 1):
            d, s = where[i]
            w = q[d]
            _, _, rows, above, below = self.segments[d][s]
            acc[rows] += w * (above if w > 0 else below)
            left = ahead[d]
            rest += (left[-2] if len(left) > 1 else 0) - left.pop()
            if n % every == 0 and len(acc) > k:
                floor = np.partition(acc, -k)[-k]
                maybe = np.flatnonzero(acc + rest >= floor)  # whatever is unseen adds 0 to `rest`: no other row can be among the best
                if len(maybe) <= few:
                    break
        else:
            if len(acc) > k:
                maybe = np.flatnonzero(acc >= np.partition(acc, -k)[-k])
        maybe = maybe[self.ids[maybe] != own]
        score = self.x[maybe] @ q
        best = np.lexsort((self.ids[maybe], -score))[:k]
        return self.ids[maybe[best]], score[best]


def _matrix(blobs: pa.ChunkedArray) -> np.ndarray:
    rows = [np.frombuffer(b, "<i8") for b in blobs.to_pylist()]
    width = max(map(len, rows))
    return np.stack([np.pad(r, (0, width - len(r))) for r in rows])


def _search(k: int, block: int = 2048):
    """Over rows (shard, query, vec_id, x) in order: a shard's candidates become its index, once, and its queries stream through it, `block` at a time."""

    def answers(shard: Shard, ids: list[int], blobs: list[bytes]) -> pa.RecordBatch:
        out = []
        for own, x in zip(ids, blobs, strict=True):
            got, score = shard.search(own, shard.fitted(np.frombuffer(x, "<i8")), k)
            out.append((np.full(len(got), own, np.int64), got, score))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], schema=OUT)

    def run(batches):
        now, rows, shard = None, [], None
        for b in batches:
            shards, asks = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((shards[1:] != shards[:-1]) | (asks[1:] != asks[:-1])) + 1
            for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows], strict=True) if b.num_rows else ():
                if shards[i] != now:
                    now, rows, shard = shards[i], [], None
                part = b.slice(i, j - i)
                if not asks[i]:
                    rows.append(part)
                    continue
                if rows:
                    t = pa.Table.from_batches(rows)
                    shard, rows = Shard(t.column(2).to_numpy(), _matrix(t.column(3))), []
                for at in range(0, part.num_rows if shard else 0, block):
                    some = part.slice(at, block)
                    yield answers(shard, some.column(2).to_pylist(), some.column(3).to_pylist())

    return run


def _integers(scale: float):
    def run(batches):
        for b in batches:
            ids, xs = [], []
            for i, v in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if i is None or not v.is_valid or v.values.null_count or not len(v.values):
                    continue
                x = v.values.to_numpy(zero_copy_only=False).astype(float)
                if np.isfinite(x).all():
                    ids.append(i)
                    xs.append(np.floor(scale * x).astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(xs, pa.binary())], ["vec_id", "x"])

    return run


def top_k(vectors: DataFrame, scratch: Scratch, k: int = 5, every: int = 50, scale: float = 256.0, shard_rows: int = 8192) -> DataFrame:
    """query_id, rank, vec_id, score: of each query (vec_id divisible by `every`) the k best other rows.

    Components become floor(scale * x); scores are integer inner products and exact. Each candidate is dealt to
    one shard of about `shard_rows`, whose index is built once, in one task; the stated query set goes to
    every shard and streams through its index in blocks. So what is shuffled is each row once, and each
    query once a shard. A shard gives k rows a query, of which the best k are taken by a group-limited
    window. A query stops early in a shard only on proof, and then its possible members are scored anew.

    Null vec_id, and vectors that are null, empty or hold null or non-finite components: take no
    part. Lengths that differ: what is missing counts 0. Ties: smaller vec_id. Rows that share a
    vec_id: one query, with the least of their vectors; none is a candidate of that query. Fewer than k candidates:
    all of them. Empty table: no rows. Other columns are not read. Products are expected to fit 64 bits.
    """
    ints = scratch.cut(vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(_integers(scale), "vec_id long, x binary"), "ints")
    shards = max(1, -(-ints.count() // shard_rows))
    # Of rows alike in vec_id and vector, however many, k can be among the best.
    few = ints.groupBy("vec_id", "x").agg(F.least(F.count("*"), F.lit(k)).alias("n")).select("vec_id", "x", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    rows = few.select(F.pmod(F.xxhash64("vec_id", "x", F.lit(1)), F.lit(shards)).cast("int").alias("shard"), F.lit(False).alias("query"), "vec_id", "x")
    asks = ints.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("x").alias("x"))
    asks = asks.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("query"), "vec_id", "x")
    part = rows.unionByName(asks).repartition("shard").sortWithinPartitions("shard", "query").mapInArrow(_search(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return part.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), Scratch(spark))


#: floor(256 * x) of all vectors, every query against all other rows.
OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
