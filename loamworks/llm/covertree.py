"""Exact near-duplicate vectors by dual traversal of cover trees."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, components, groups, table

LINKS = pa.schema([("rep", pa.int64()), ("n", pa.int64()), ("root", pa.int64())])
SLACK = 1e-7  # more than distances near 0 lose by rounding, about 2e-8
RINGS = 64


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * (x @ y.T)))


class Level:
    """Nodes of one level: centre, covering radius (the farthest member's distance), members, and children one level down."""

    def __init__(self, centre: list[int], members: list[np.ndarray], radius: list[float]):
        self.centre, self.members, self.radius = np.array(centre), members, np.array(radius)
        self.children: list[np.ndarray] = []


class CoverTree:
    """Nested levels over unit vectors; every level halves the radius within which a node's centre covers its members."""

    def __init__(self, x: np.ndarray, least: float):
        self.x = x
        d = distances(x, x[:1])[:, 0]
        self.levels = [Level([0], [np.arange(len(x))], [float(d.max())])]
        reach = float(d.max()) / 2
        while self.levels[-1].radius.max(initial=0) > least:
            top = self.levels[-1]
            centre, members, radius = [], [], []
            for c, rows in zip(top.centre.tolist(), top.members, strict=True):
                at = len(centre)
                while len(rows):
                    d = distances(x[rows], x[c : c + 1])[:, 0]
                    near = (d <= reach) | (rows == c)
                    centre.append(c)
                    members.append(rows[near])
                    radius.append(float(d[near].max()) if near.sum() > 1 else 0.0)
                    rows = rows[~near]
                    c = int(rows[0]) if len(rows) else c
                top.children.append(np.arange(at, len(centre)))
            self.levels.append(Level(centre, members, radius))
            reach /= 2

    def level(self, k: int) -> Level:
        return self.levels[min(k, len(self.levels) - 1)]

    def below(self, k: int, node: int) -> np.ndarray:
        return self.levels[k].children[node] if k < len(self.levels) - 1 else np.array([node])


def close_nodes(a: CoverTree, b: CoverTree, reach: float):
    """Pairs of member lists that hold every pair within `reach`: nodes go down both trees together, and a pair of
    nodes is pruned when its centres are farther apart than both covering radii and `reach`.
    """
    same, front, deep = a is b, [(0, 0)], max(len(a.levels), len(b.levels)) - 1
    for k in range(deep):
        nxt = []
        la, lb = a.level(k + 1), b.level(k + 1)
        for p, q in front:
            i, j = a.below(min(k, len(a.levels) - 1), p), b.below(min(k, len(b.levels) - 1), q)
            keep = distances(a.x[la.centre[i]], b.x[lb.centre[j]]) <= la.radius[i][:, None] + lb.radius[j][None, :] + reach + SLACK
            for u, v in zip(*np.nonzero(keep), strict=True):
                u, v = int(i[u]), int(j[v])
                if same and u > v:
                    continue
                if same and u == v and len(la.members[u]) == 1:
                    continue
                nxt.append((u, v))
        front = nxt
    la, lb = a.level(deep), b.level(deep)
    for p, q in front:
        yield la.members[p], lb.members[q], same and p == q


class Part:
    """Vectors of one length in a chunk, at length 1, with the cover tree over them."""

    def __init__(self, rep: np.ndarray, m: np.ndarray, raw: list[bytes], least: float):
        order = np.argsort(rep, kind="stable")
        self.rep, self.m = rep[order], m[order]
        x = np.stack([np.frombuffer(raw[i], "<f8") for i in order])
        x = x / np.abs(x).max(1, keepdims=True)
        self.tree = CoverTree(x / np.linalg.norm(x, axis=1, keepdims=True), least)


def parts(t: pa.Table, least: float) -> dict[int, Part]:
    """By length: vectors of different lengths are never compared."""
    rep, m, raw = t.column("rep").to_numpy(), t.column("m").to_numpy(), t.column("x").to_pylist()
    size = np.array([len(r) for r in raw])
    return {n: Part(rep[at], m[at], [raw[i] for i in at], least) for n in np.unique(size).tolist() for at in [np.flatnonzero(size == n)]}


def between(a: Part, b: Part, threshold: float) -> tuple[np.ndarray, ...] | None:
    """(rep, n, root) of the linked vectors of two chunks, or of one with itself: how many rows each is linked with, and one that links reach."""
    own, reach = a is b, math.sqrt(max(0.0, 2 - 2 * threshold))
    rep, m = (a.rep, a.m) if own else (np.append(a.rep, b.rep), np.append(a.m, b.m))
    shift = 0 if own else len(a.rep)
    root, n = np.arange(len(rep)), np.zeros(len(rep), np.int64)
    for p, q, self_ in close_nodes(a.tree, b.tree, reach):
        for at in range(0, len(p), 1024):
            part, q_ = p[at : at + 1024], q + shift
            hit = a.tree.x[part] @ b.tree.x[q].T >= threshold
            if self_:
                hit &= part[:, None] != q[None, :]
            n[part] += hit @ m[q_]
            if not self_:
                n[q_] += hit.T @ m[part]
            for i in np.flatnonzero(hit.any(1)).tolist():
                near = root[q_[hit[i]]]
                if (near != root[part[i]]).any():
                    found = np.unique(np.append(near, root[part[i]]))
                    root[np.isin(root, found)] = found[0]
    got = np.flatnonzero(n)
    return (rep[got], n[got], rep[root[got]]) if len(got) else None


def _link(threshold: float):
    """Over rows (task, guest, turn, alone, rep, m, x) in order: a task's own chunk comes first, and its tree is built once; other chunks pass by it one after another."""
    least = math.sqrt(max(0.0, 2 - 2 * threshold)) / 4

    def run(batches):
        host: dict[int, Part] = {}
        for t in groups(batches, 3):
            now = parts(t, least)
            if not t.column("guest")[0].as_py():
                host = now
                pairs = [(p, p) for p in now.values()] if t.column("alone")[0].as_py() else []
            else:
                pairs = [(host[n], p) for n, p in now.items() if n in host]
            out = [got for a, b in pairs if (got := between(a, b, threshold))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*out, strict=True)], schema=LINKS)

    return run


def _valid(batches):
    """Of each vector that takes part its components as doubles, else null."""
    for b in batches:
        out = []
        for i, label, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            x = None
            if i is not None and label is not None and v.is_valid and len(v.values) and not v.values.null_count:
                x = v.values.to_numpy(zero_copy_only=False).astype("<f8") + 0.0
                x = x.tobytes() if np.isfinite(x).all() and x.any() else None
            out.append(x)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], ["vec_id", "label", "x"])


def _assign(centres):
    def run(batches):
        known = centres.value
        for b in batches:
            labels, raw = b.column(0).to_pylist(), b.column(3).to_pylist()
            cell, far = np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows)
            rows: dict = {}
            for i, label in enumerate(labels):
                if label in known and len(raw[i]) == 8 * known[label].shape[1]:
                    rows.setdefault(label, []).append(i)
            for label, at in rows.items():
                x = np.stack([np.frombuffer(raw[i], "<f8") for i in at])
                x = x / np.abs(x).max(1, keepdims=True)
                d = distances(x / np.linalg.norm(x, axis=1, keepdims=True), known[label])
                cell[at], far[at] = d.argmin(1), d.min(1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(far)], ["label", "rep", "m", "x", "cell", "far"])

    return run


def links(classes: DataFrame, scratch: Scratch, threshold: float, chunk: int = 2048, most_centres: int = 4096, most_guests: int = 32) -> DataFrame:
    """(rep, n, root) rows from the tasks: vectors linked to rep, and one that links reach from it.

    The top of the tree are at most `most_centres` cells over the largest labels (a bounded sample, broadcast).
    A cell is cut by distance from its centre into rings, and these into chunks of about `chunk` vectors. Pairs of
    chunks are rows of a few numbers, pruned by the distance of their centres and the least and greatest
    distance of their members before any vector moves. Of each pair that is left one chunk is the host and the
    other goes there, so what is shuffled is a chunk a pair and the hosts themselves, in tasks of `most_guests`
    pairs or so; there cover trees of both are traversed together.
    """
    spark = classes.sparkSession
    size = classes.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") > chunk).orderBy(F.desc("n"), "label").limit(most_centres // 2).collect()
    want, left = {}, most_centres
    for r in size:
        want[r["label"]] = (min(left, 256, -(-r["n"] // chunk) * 2), r["n"])
        left -= want[r["label"]][0]
    centres = {}
    if want := {k: v for k, v in want.items() if v[0] > 1}:
        ask = spark.createDataFrame([(k, c, 4.0 * c / n) for k, (c, n) in want.items()], "label long, c int, share double")
        u = F.pmod(F.xxhash64("rep", F.lit(3)), F.lit(1 << 30)) / (1 << 30)
        pick = classes.join(F.broadcast(ask), "label").where(u <= F.col("share")).withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy(u, "rep")))
        for r in pick.where("r <= c").select("label", "x").collect():
            centres.setdefault(r["label"], []).append(np.frombuffer(bytes(r["x"]), "<f8"))
        centres = {k: np.stack([x / np.abs(x).max() / np.linalg.norm(x / np.abs(x).max()) for x in v if len(x) == len(v[0])]) for k, v in centres.items()}
    rows = classes.select("label", "rep", "m", "x").mapInArrow(_assign(spark.sparkContext.broadcast(centres)), "label long, rep long, m long, x binary, cell int, far double")
    rows = scratch.cut(rows, "assigned")
    cells = rows.groupBy("label", "cell").agg(F.count("*").alias("n"), F.percentile_approx("far", [i / RINGS for i in range(1, RINGS)]).alias("cuts"))
    cells = cells.select("label", "cell", "cuts", F.least(F.lit(RINGS), F.ceil(F.col("n") / chunk)).cast("int").alias("rings"))
    rings = rows.join(cells, ["label", "cell"])
    place = F.size(F.filter("cuts", lambda c: c < F.col("far")))
    rings = rings.select("label", "cell", F.floor(place * F.col("rings") / RINGS).cast("int").alias("ring"), "rep", "m", "x", "far")
    chunks = rings.groupBy("label", "cell", "ring").agg(F.min("far").alias("lo"), F.max("far").alias("hi"), F.ceil(F.count("*") / chunk).cast("int").alias("k"))
    chunks = scratch.cut(chunks, "chunks")
    near = _near_cells(chunks, centres, threshold)
    pairs = chunks.where(~F.col("label").isin(list(centres)) if centres else F.lit(True)).select("label", "cell", F.col("cell").alias("other"), F.lit(0.0).alias("d")).distinct()
    if near:
        pairs = pairs.unionByName(spark.createDataFrame(near, "label long, cell int, other int, d double"))
    side = lambda c, names: chunks.select("label", F.col("cell").alias(c), F.col("ring").alias(names[0]), F.col("lo").alias(names[1]), F.col("hi").alias(names[2]), F.col("k").alias(names[3]))
    pairs = pairs.join(side("cell", ("ring", "lo", "hi", "k")), ["label", "cell"]).join(side("other", ("oring", "olo", "ohi", "ok")), ["label", "other"])
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + SLACK
    pairs = pairs.where((F.col("d") - F.col("hi") - F.col("ohi") <= reach) & (F.col("olo") - F.col("d") - F.col("hi") <= reach) & (F.col("lo") - F.col("d") - F.col("ohi") <= reach))
    pairs = pairs.withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).withColumn("osub", F.explode(F.sequence(F.lit(0), F.col("ok") - 1)))
    pairs = pairs.select("label", F.struct("cell", "ring", "sub").alias("a"), F.struct(F.col("other").alias("cell"), F.col("oring").alias("ring"), F.col("osub").alias("sub")).alias("b")).where("a <= b")
    first = F.xxhash64("label", "a", "b") % 2 == 0  # so that no chunk is host of all its pairs
    pairs = scratch.cut(pairs.select("label", F.when(first, F.col("a")).otherwise(F.col("b")).alias("host"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("guest")), "pairs")
    tasks = pairs.groupBy("label", "host").agg(F.ceil(F.count("*") / most_guests).alias("tasks"))
    pairs = pairs.join(tasks, ["label", "host"]).withColumn("task", F.struct("label", "host", F.pmod(F.xxhash64("guest"), F.col("tasks")).alias("part")))
    held = rings.join(chunks.select("label", "cell", "ring", "k"), ["label", "cell", "ring"])
    held = held.select("label", F.struct("cell", "ring", F.pmod(F.xxhash64("rep", F.lit(5)), F.col("k")).cast("int").alias("sub")).alias("chunk"), "rep", "m", "x")
    hosts = pairs.groupBy("label", F.col("host").alias("chunk"), "task").agg(F.bool_or(F.col("host") == F.col("guest")).alias("alone")).withColumn("turn", F.col("chunk"))
    guests = pairs.where("host <> guest").select("label", F.col("guest").alias("chunk"), "task", F.lit(False).alias("alone"), F.col("guest").alias("turn"))
    come = hosts.withColumn("guest", F.lit(False)).unionByName(guests.withColumn("guest", F.lit(True)))
    met = held.join(come, ["label", "chunk"]).select(F.xxhash64("task").alias("task"), "guest", F.xxhash64("turn").alias("turn"), "alone", "rep", "m", "x")
    return met.repartition("task").sortWithinPartitions("task", "guest", "turn").mapInArrow(_link(threshold), "rep long, n long, root long")


def _near_cells(chunks: DataFrame, centres: dict, threshold: float) -> list[tuple]:
    """Pairs of cells (label, cell, other, distance of centres) that may hold links, by their covering radii."""
    if not centres:
        return []
    rows = chunks.where(F.col("label").isin(list(centres))).groupBy("label", "cell").agg(F.max("hi").alias("radius")).collect()  # one a centre
    radius, out = {(r["label"], r["cell"]): r["radius"] for r in rows}, []
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + SLACK
    for label, c in centres.items():
        at = [i for i in range(len(c)) if (label, i) in radius]
        d, r = distances(c, c), np.array([radius[label, i] for i in at])
        for i, x in zip(at, r.tolist(), strict=True):
            out += [(label, i, at[j], float(d[i, at[j]]) if at[j] != i else 0.0) for j in np.flatnonzero(d[i, at] <= x + r + reach).tolist()]
    return out


def near_vectors(vectors: DataFrame, scratch: Scratch, threshold: float = 0.98, chunk: int = 2048) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector; links are pairs of equal label with cosine >= threshold.

    Vectors equal in all components are one class, found by a pre-aggregated group-by; classes
    are compared and their counts carried along, so no copies are expanded. Links stay in the
    tasks: a task gives each linked class its count and one neighbour nearer the root.

    Null label, and vectors that are null, empty, zero or hold null or non-finite components: no
    links, a component of their own. Null vec_id: as these, with a null component. Vectors of
    different lengths: never linked. Rows that share a vec_id and vector: linked copies. Empty
    table: no rows. Other columns are not read.
    """
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(_valid, "vec_id long, label long, x binary")
    rows = scratch.cut(rows, "vectors")
    classes = rows.where("x IS NOT NULL").groupBy("label", "x").agg(F.min("vec_id").alias("rep"), F.count("*").alias("m"))
    classes = scratch.cut(classes, "classes")
    found = scratch.cut(links(classes, scratch, threshold, chunk), "links")
    roots = components(scratch, found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("rep").agg(F.sum("n").alias("n"))
    known = classes.join(counts, "rep", "left").join(roots.withColumnRenamed("v", "rep"), "rep", "left")
    known = known.select("label", "x", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    linked = rows.where("x IS NOT NULL").join(known, ["label", "x"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("x IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op3_covertree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"), Scratch(spark))
