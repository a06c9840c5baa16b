"""Retrieval: exact cosine top-k, joins by retrieved id, keyword search and filters."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed
from ..functions.text import strip


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_topk(vectors: DataFrame, query: list[float], k: int, key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """The k vectors nearest to one query by cosine; ties go to the smaller key. A literal query needs no join."""
    q = F.array(*[F.lit(float(x)) for x in query])
    score = dot(F.col(vec), q) / ((norm(F.col(vec)) + F.lit(1e-9)) * (norm(q) + F.lit(1e-9)))
    return vectors.where(F.col(vec).isNotNull()).select(key, score.alias("score")).orderBy(F.desc("score"), key).limit(k)


def cosine_topk_batch(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vec: str = "embedding", shard_rows: int = 16384, block_rows: int = 16384) -> DataFrame:
    """For each query (query_id, query) its k nearest vectors by cosine, ranked; ties go to the smaller key.

    Vectors are dealt to shards of about `shard_rows` and queries to blocks of about `block_rows`; a
    pair of shard and block is one task's bounded group and gives k rows a query, of which a
    group-limited window keeps k. Pairs without a score (lengths differ, or a null component) rank last.
    """
    rows = vectors.where(F.col(vec).isNotNull()).select(F.col(key).alias("key"), F.col(vec).cast("array<double>").alias("v"))
    asks = queries.where("query IS NOT NULL").select(F.col("query_id").alias("query_id"), F.col("query").cast("array<double>").alias("v"))
    shards, blocks = max(1, -(-rows.count() // shard_rows)), max(1, -(-asks.count() // block_rows))
    many = lambda c: F.explode(F.sequence(F.lit(0), F.lit(c - 1)))
    dealt = lambda c: F.pmod(F.xxhash64("v", c), F.lit(shards if c == "key" else blocks)).cast("int")
    rows = rows.select(dealt("key").alias("shard"), many(blocks).alias("block"), "key", "v")
    asks = asks.select(many(shards).alias("shard"), dealt("query_id").alias("block"), "query_id", "v")
    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, {key} {vectors.schema[key].dataType.simpleString()}, score double"
    out = rows.groupBy("shard", "block").cogroup(asks.groupBy("shard", "block")).applyInArrow(_nearest(k, key), kinds)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), key))
    return out.withColumn("rank", rank).where(F.col("rank") <= k)


def _matrix(column: pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors filled up with zeros, and their lengths; -1 marks a null component."""
    rows = [v.values for v in column]
    size = np.array([-1 if v.null_count else len(v) for v in rows])
    x = np.zeros((len(rows), width))
    for i in np.flatnonzero(size > 0):
        x[i, : size[i]] = rows[i].to_numpy()
    return x, size


def _nearest(k: int, key: str, step: int = 256, pairs: int = 1 << 16):
    """A matrix product finds what can be among the k; those are scored anew, component by component, so that copies tie."""

    def length(x):
        s = np.zeros(len(x))
        for d in range(x.shape[1]):
            s += x[:, d] * x[:, d]
        return np.sqrt(s) + 1e-9

    def run(t: pa.Table, q: pa.Table) -> pa.Table:
        t = t.take(pc.sort_indices(t, [("key", "ascending")], null_placement="at_start"))  # a row's place says how ties go
        width = max((pc.max(pc.list_value_length(c.column("v"))).as_py() or 0 for c in (t, q)), default=0)
        (x, nx), (y, ny) = _matrix(t.column("v"), width), _matrix(q.column("v"), width)
        lx, ly = length(x), length(y)
        got = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for at in range(0, len(y) if len(x) else 0, step):
            s = (y[at : at + step] @ x.T) / (ly[at : at + step, None] * lx)
            s[np.isnan(s)] = np.inf  # Spark, too, takes NaN for the greatest
            s[(ny[at : at + step, None] != nx) | (nx < 0)] = -np.inf
            floor = np.partition(s, -k, axis=1)[:, -k] if len(x) > k else np.full(len(s), -np.inf)
            i, j = np.nonzero(s >= floor[:, None] - 1e-9)
            i += at
            exact = np.zeros(len(i))
            for a in range(0, len(i), pairs):
                u, v = x[j[a : a + pairs]], y[i[a : a + pairs]]
                for d in range(width):
                    exact[a : a + pairs] += u[:, d] * v[:, d]
            exact /= lx[j] * ly[i]
            none = (ny[i] != nx[j]) | (nx[j] < 0)
            order = np.lexsort((j, np.where(none, np.inf, np.where(np.isnan(exact), -np.inf, -exact)), i))
            i, j, exact, none = i[order], j[order], exact[order], none[order]
            best = np.arange(len(i)) - np.searchsorted(i, i) < k
            got.append((i[best], j[best], np.ma.array(exact[best], mask=none[best])))
        i, j = (np.concatenate([g[c] for g in got]) for c in (0, 1))
        score = np.ma.concatenate([g[2] for g in got])
        return pa.table({"query_id": q.column("query_id").take(pa.array(i)), key: t.column("key").take(pa.array(j)), "score": pa.array(score.data, mask=np.ma.getmaskarray(score))})

    return run


def fetch(hits: DataFrame, rows: DataFrame, on: Column) -> DataFrame:
    """The rows behind retrieved ids, late: only top-k ids travel, and ids without a row are dropped."""
    return rows.join(F.broadcast(hits), on)  # hits are k rows


def keywords(text: str, most: int = 5) -> list[str]:
    """The first words of more than three letters."""
    return [w for w in text.split() if len(w) > 3][:most]


def keyword_search(df: DataFrame, text: str, columns: list[str], key: str, k: int) -> DataFrame:
    """Rows where a keyword occurs in a column, in order of key, with the constant score 1; all rows count where there are no keywords."""
    words = keywords(text)
    tests = [F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(w.lower())) for w in words for c in columns]
    df = df.where(reduce(lambda a, b: a | b, tests)) if tests else df
    return df.withColumn("score", F.lit(1.0)).orderBy(key).limit(k)


def like_filter(df: DataFrame, filters: dict[str, str], key: str, k: int = 50, case: bool = False) -> DataFrame:
    """Rows whose columns contain the given texts, whatever their case unless `case`; unknown columns are refused, % and _ are literal."""
    if wrong := set(filters) - set(df.columns):
        raise ValueError(f"no such columns: {sorted(wrong)}")
    for c, v in filters.items():
        df = df.where(F.contains(F.col(c), F.lit(v)) if case else F.contains(F.lower(F.col(c)), F.lit(v.lower())))
    return df.orderBy(key).limit(k)


def canonical_domain(c: Column, aliases: tuple = fixed.ALIASES) -> Column:
    """The domain of a free-text type, '' where it is unknown."""
    table = F.create_map(*[F.lit(x) for pair in aliases for x in pair])
    return F.coalesce(F.element_at(table, F.lower(strip(c))), F.lit(""))


def contained(docs: DataFrame, quotes: DataFrame, block_chars: int = 16 << 20) -> DataFrame:
    """(item_id, doc_id) for each quote (item_id, q) that occurs in a document (doc_id, c).

    Quotes are taken in blocks of about `block_chars` characters; each block is one automaton of
    bounded size that all documents are run through once, in time linear in their text, without a join.
    """
    spark = docs.sparkSession
    total = quotes.agg(F.sum(F.length("q"))).first()[0] or 0
    blocks = max(1, -(-total // block_chars))
    out = None
    for b in range(blocks):
        rows = quotes.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).select("item_id", "q").collect()
        sent = spark.sparkContext.broadcast([(r[0], r[1]) for r in rows])
        part = docs.select(F.col("doc_id").cast("long"), "c").mapInArrow(_occurs(sent), "item_id long, doc_id long")
        out = part if out is None else out.unionByName(part)
    return out


def _occurs(quotes):
    def run(batches):
        by_text: dict[str, list[int]] = {}
        for i, q in quotes.value:
            by_text.setdefault(q, []).append(i)
        auto = ahocorasick.Automaton()
        for q, ids in by_text.items():
            auto.add_word(q, ids)
        if by_text:
            auto.make_automaton()
        for b in batches:
            hits = [(i, doc) for doc, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if c and by_text for i in {i for _, ids in auto.iter(c) for i in ids}]
            yield pa.RecordBatch.from_arrays([pa.array([h[0] for h in hits], pa.int64()), pa.array([h[1] for h in hits], pa.int64())], ["item_id", "doc_id"])

    return run


def hash_embedding(c: Column, size: int = 64) -> Column:
    """An embedding that needs no model: counts of hashed words by signed slot, of length 1. For tests and offline runs."""
    words = F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"\W+"), lambda w: w != "")
    slots = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(2 * size)))
    raw = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: (F.size(F.filter(slots, lambda s: s == 2 * i)) - F.size(F.filter(slots, lambda s: s == 2 * i + 1))).cast("double"))
    return unit(raw)


def embed(df: DataFrame, c: str, model: Callable[[], Callable[[list[str]], list[list[float]]]], batch: int = 16, out: str = "embedding") -> DataFrame:
    """Adds the vectors that an injected model gives for the texts of a column, `batch` texts a call; null for null and blank texts, which are not sent.

    `model` makes the model on each worker. Calls cost, so write the vectors before using them twice.
    """
    at = df.columns.index(c)

    def run(batches):
        ask = model()
        for b in batches:
            texts = b.column(at).to_pylist()
            some = [i for i, t in enumerate(texts) if t and t.strip()]
            got: list = [None] * len(texts)
            for k in range(0, len(some), batch):
                part = some[k : k + batch]
                for i, v in zip(part, ask([texts[i] for i in part]), strict=True):
                    got[i] = v
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.list_(pa.float32()))], [*b.schema.names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.FloatType()))]))


def unit(c: Column) -> Column:
    """A vector of length 1 as floats; zero stays zero. What a stored index holds."""
    return F.transform(c, lambda x: (x.cast("double") / (norm(c) + F.lit(1e-9))).cast("float"))


def search(vectors: DataFrame | None, kb: DataFrame, query: list[float] | None, text: str, k: int, key: str = "kb_id") -> DataFrame:
    """The k records nearest to a query, with their scores; a keyword search where there are no vectors."""
    if vectors is None or query is None or vectors.isEmpty():
        return keyword_search(kb, text, ["deficiency_text", "product_name", "cmc_section"], key, k)
    hits = cosine_topk(vectors, query, k, key)
    return kb.join(F.broadcast(hits), key).orderBy(F.desc("score"), key)
