"""Near-duplicate documents by chosen-path set similarity join over word shingles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from .common import MIX1, MIX2, Scratch, by_group, components, key_filter, lean, mix, only, prefix_hash, slices, span_hash, table, word_bounds

T = 64  # minwise tokens of a document, by which trees branch
BINS = 512  # bins of a document's hashes, of which one byte each says what is least in it
WORDS = 5
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_RNG = np.random.default_rng(20)
STEP = _RNG.integers(1, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MULT = _RNG.integers(1, 1 << 63, T, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
U32, SALT = np.uint64(32), np.uint64(0xD6E8FEB86659FD93)


def shingle_sets(arr: pa.Array):
    """Of each text the sorted distinct 64-bit hashes of its five-word shingles; of fewer words, one of them all."""
    for i, buf, off in slices(arr):
        c = prefix_hash(LOWER[buf])
        starts, ends, before = word_bounds(buf, off)
        w = span_hash(c, starts, ends)
        n = max(0, len(w) - WORDS + 1)
        s = np.zeros(n, np.uint64)
        for k in range(WORDS):
            s += w[k : k + n] * STEP[k]
        s = mix(s)
        for d in range(len(off) - 1):
            a, b = int(before[d]), int(before[d + 1])
            if b - a >= WORDS:
                yield np.unique(s[a : b - WORDS + 1])
            elif b > a:
                yield mix((w[a:b] * STEP[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.array([b - a], np.uint64) * SALT)
            else:
                yield np.zeros(0, np.uint64)


def sketch(s: np.ndarray) -> bytes:
    """The least hash of the set under each of T functions, 32 bits each, and one byte for each of BINS bins: what its least hash is, 0 if the bin is empty."""
    out = np.full(T, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(s), 8192):
        np.minimum(out, ((s[i : i + 8192, None] * MULT) >> U32).min(0).astype(np.uint32), out=out)
    where = (s >> np.uint64(64 - (BINS - 1).bit_length())).astype(np.int64)
    first = np.flatnonzero(np.append(True, where[1:] != where[:-1])) if len(s) else np.zeros(0, np.int64)  # sets are sorted
    bins = np.zeros(BINS, np.uint8)
    bins[where[first]] = (s[first] & np.uint64(0xFFFF)) % np.uint64(254) + np.uint64(1)
    return out.tobytes() + bins.tobytes()


def identity(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed numbers."""
    return tuple(int(x.sum(dtype=np.uint64).astype(np.int64)) for x in (s, mix(s ^ SALT)))


def _sketches(batches):
    for b in batches:
        n, h1, h2, sig = [], [], [], []
        for s in shingle_sets(b.column(1)):
            n.append(len(s))
            x, y = identity(s)
            h1.append(x)
            h2.append(y)
            sig.append(sketch(s) if len(s) else None)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(sig, pa.binary())], ["doc_id", "n", "h1", "h2", "sig"])


def branching(similarity: float) -> float:
    """Children of a node on average. Above 1 / similarity a pair at the threshold shares more than one of them, so its chance does not fade with depth."""
    return min(2.0, 1 / similarity + 0.12)


def missed(similarity: float, levels: int, trees: int, threshold: float | None = None) -> float:
    """The chance that a pair shares no node of `levels` levels in any of the trees, which are built for `threshold`."""
    two, miss = branching(threshold or similarity) - 1, 0.0
    for _ in range(levels):
        one = 1 - similarity + similarity * miss
        miss = (1 - two) * one + two * one**2
    return miss**trees


def chosen(key: np.ndarray, similarity: float, used: set[int] | None = None) -> list[int]:
    """Coordinates that a node of the tree branches on: branching(similarity) of them on average, one at least."""
    rng = np.random.default_rng(key)
    free = [c for c in range(T) if not used or c not in used]
    many = min(len(free), 1 + int(rng.random() < branching(similarity) - 1))
    return rng.choice(free, many, replace=False).tolist() if free else []


def first_level(similarity: float, trees: int) -> list[tuple[int, int]]:
    """(tree, coordinate) of the first level; trees share no coordinate there, as long as there are enough."""
    rng = np.random.default_rng(7)
    deal = [int(c) for _ in range(-(-2 * trees // T)) for c in rng.permutation(T)]
    return [(t, deal.pop()) for t in range(trees) for _ in range(1 + int(rng.random() < branching(similarity) - 1))]


def _roots(similarity: float, trees: int):
    """Rows (node, rep, known) of the first level of every tree: documents that share a chosen minwise token share a node. Each is known to be connected with itself."""

    def run(batches):
        pick = first_level(similarity, trees)
        for b in batches:
            sig = tokens(b.column(1))
            nodes = [mix(sig[:, c].astype(np.uint64) + np.uint64((t * T + c + 1) << 32)).view(np.int64) for t, c in pick]
            rep = pa.array(np.tile(b.column(0).to_numpy(), len(pick)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(nodes)), rep, rep], ["node", "rep", "known"])

    return run


def _branches(similarity: float, levels: int = 3):
    """The next levels of nodes that are too large for a task: (node, rep, known). A node's own hash draws the coordinates that it branches on."""
    two = np.uint64(int((branching(similarity) - 1) * (1 << 53)))

    def run(batches):
        for b in batches:
            node, row, tok = b.column(0).to_numpy().view(np.uint64), np.arange(b.num_rows), tokens(b.column(2))
            for _ in range(levels):
                h = mix(node ^ SALT)
                c = (h % np.uint64(T)).astype(np.int64)
                more = np.flatnonzero(mix(h) >> np.uint64(11) < two)
                other = (c[more] + 1 + (mix(h[more] ^ MIX1) % np.uint64(T - 1)).astype(np.int64)) % T
                node, row, c = np.append(node, node[more]), np.append(row, row[more]), np.append(c, other)
                node = mix(node ^ ((c + 1).astype(np.uint64) * MIX2) ^ (tok[row, c].astype(np.uint64) * STEP[0]))
            yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), *(b.column(k).take(pa.array(row)) for k in (1, 3))], ["node", "rep", "known"])

    return run


def _sketch_rows(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint8).reshape(-1, 4 * T + BINS)


def tokens(col: pa.Array) -> np.ndarray:
    return np.ascontiguousarray(_sketch_rows(col)[:, : 4 * T]).view(np.uint32)


class Bins:
    """The bins of several sketches: as they are, with 255 for empty ones, and, as bits, which are filled and the lowest bit of each."""

    def __init__(self, col: pa.Array, n: np.ndarray):
        self.n = n
        self.bins = np.ascontiguousarray(_sketch_rows(col)[:, 4 * T :])
        self.other = np.where(self.bins == 0, 255, self.bins).astype(np.uint8)
        self.bits = np.packbits(self.bins > 0, axis=1).view(np.uint64)
        self.low = np.packbits(self.bins & 1, axis=1).view(np.uint64)
        self.filled = _ones(self.bits)


def _ones(bits: np.ndarray) -> np.ndarray:
    return np.bitwise_count(bits).sum(-1, dtype=np.int64)


class Roots:
    """Components over 0..n-1 as an array of roots; rows with equal `known` start as one."""

    def __init__(self, n: int, known: np.ndarray | None = None):
        self.root = np.arange(n)
        if known is not None:
            _, first, back = np.unique(known, return_index=True, return_inverse=True)
            self.root = first[back]
        self.links: list[tuple[int, int]] = []

    def join(self, i: int, others: np.ndarray) -> None:
        found = np.unique(self.root[np.append(others, i)])
        if len(found) > 1:
            first = {int(self.root[j]): int(j) for j in others[::-1].tolist()}
            self.links += [(i, j) for r, j in first.items() if r != self.root[i]]
            self.root[np.isin(self.root, found)] = found[0]


def alike(a: Bins, i: np.ndarray, b: Bins, j: np.ndarray, percent: int, slack: float = 4.0) -> np.ndarray:
    """Whether row i of a and row j of b (arrays that are broadcast together) may be as similar as asked: by size, and by bins that are alike.

    Of the bins that either fills, the share that are alike is an unbiased guess of the similarity; a pair
    at the threshold falls `slack` standard deviations below it in 3 of 10^5 cases at 4, and one a fifth less similar is told
    apart. The lowest bits say so first, with half a deviation to spare, since bins that differ agree in them half the time.
    """
    p = percent / 100
    fit = np.minimum(a.n[i], b.n[j]) * 100 >= np.maximum(a.n[i], b.n[j]) * percent
    both = a.bits[i] & b.bits[j]
    shared = _ones(both)
    filled = a.filled[i] + b.filled[j] - shared
    fit &= 2 * _ones(~(a.low[i] ^ b.low[j]) & both) - shared >= p * filled - (slack + 0.5) * np.sqrt((1 - p * p) * filled)
    some = np.nonzero(fit)
    i, j = np.broadcast_to(i, fit.shape)[some], np.broadcast_to(j, fit.shape)[some]
    for k in range(0, len(i), 4096):
        part = tuple(x[k : k + 4096] for x in some)
        same = np.count_nonzero(a.bins[i[k : k + 4096]] == b.other[j[k : k + 4096]], axis=1)
        fit[part] = same >= p * filled[part] - slack * np.sqrt(p * (1 - p) * filled[part])
    return fit


def near(sig: Bins, i: int, rows: np.ndarray, percent: int, slack: float = 4.0) -> np.ndarray:
    """The rows that may be linked with row i."""
    return rows[alike(sig, np.full(1, i), sig, rows, percent, slack)]


def _join(percent: int, leaf: int = 128):
    """The subtree below a node: small sets are compared exhaustively, larger ones branch on further tokens.

    Only pairs that no link connects yet count, so documents like the node's pivot, however many,
    end a branch as soon as they are all that is left of it.
    """

    def run(t: pa.Table) -> pa.Table | None:
        t = t.take(pc.sort_indices(t, [("rep", "ascending")]))  # nodes with the same members then have the same pivot, and give the same pairs
        rep, col = t.column("rep").to_numpy(), t.column("sig")
        tok, sig = tokens(col), Bins(col, t.column("n").to_numpy())
        state = Roots(len(rep), t.column("known").to_numpy())
        stack = [(np.arange(len(rep)), frozenset(), t.column("node")[0].as_py() % (1 << 64))]
        while stack:
            rows, used, key = stack.pop()
            if (state.root[rows] == state.root[rows[0]]).all():
                continue
            if len(rows) <= leaf or len(used) >= T - 2:
                for at in range(0, len(rows), leaf):  # more than `leaf` only where no token is left to branch on
                    part = rows[at : at + leaf]
                    hit = np.triu(alike(sig, part[:, None], sig, rows[None, at:], percent), 1)
                    for k in np.flatnonzero(hit.any(1)).tolist():
                        state.join(int(part[k]), rows[at:][hit[k]])
                continue
            pivot = int(rows[0])
            state.join(pivot, near(sig, pivot, rows[1:], percent))
            for c in chosen([key & 0xFFFFFFFF, key >> 32, len(used)], percent / 100, set(used)):
                v = tok[rows, c]
                order = np.argsort(v, kind="stable")
                for part in np.split(rows[order], np.flatnonzero(np.diff(v[order])) + 1):
                    if len(part) > 1:
                        stack.append((part, used | {c}, (key * 31 + c * 7919 + int(tok[part[0], c])) % (1 << 64)))
        if not state.links:
            return None
        a, b = np.array(state.links).T
        return pa.table({"a": rep[a], "b": rep[b]})

    return run


def candidates(reps: DataFrame, scratch: Scratch, percent: int, trees: int, node_rows: int) -> DataFrame:
    """Pairs (a, b) that connect all documents that may be linked; a spanning forest for each node."""
    sim = percent / 100
    schema = "node long, rep long, known long"
    rows = reps.select("rep", "sig").mapInArrow(lean(_roots(sim, trees)), schema)
    found, read = None, []
    while True:
        rows = scratch.cut(rows, "nodes")
        scratch.drop(*read)
        sizes = rows.groupBy("node").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("c > 1")
        # Nodes of different trees with the same members are one.
        sizes = scratch.cut(sizes.groupBy("c", "x", "lo", "hi").agg(F.min("node").alias("node")).select("node", "c"), "sizes")
        full = rows.join(sizes, "node").join(reps.select("rep", "n", "sig"), "rep")
        many = not sizes.where(F.col("c") > node_rows).isEmpty()
        if many:  # it is read more than once
            full = scratch.cut(full, "full")
        part = by_group(full.where(F.col("c") <= node_rows).select("node", "rep", "known", "n", "sig"), ["node"], _join(percent), "a long, b long")
        part = scratch.cut(part.distinct(), "pairs")
        found = part if found is None else found.unionByName(part)
        if not many:
            scratch.drop(rows, sizes)
            return found
        # Larger nodes: the pivot's likes are linked to it, and from then on known to be connected; nodes that hold nothing else end here, the others branch.
        big = full.where(F.col("c") > node_rows)
        pivots = big.groupBy("node").agg(F.min_by(F.struct(F.col("rep").alias("p"), F.col("n").alias("pn"), F.col("sig").alias("ps")), F.xxhash64("rep")).alias("v")).select("node", "v.*")
        big = scratch.cut(big.join(pivots, "node").mapInArrow(lean(_near_pivot(percent)), "node long, rep long, sig binary, known long, p long, near boolean"), "big")
        found = found.unionByName(scratch.cut(big.where("near AND known <> p").select(F.col("rep").alias("a"), F.col("p").alias("b")).distinct(), "pairs"))
        going = big.where("NOT near").select("node").distinct()
        known, read = F.when(F.col("near"), F.col("p")).otherwise(F.col("known")).alias("known"), [rows, sizes, full, big]
        rows = big.join(going, "node", "left_semi").select("node", "rep", "sig", known)
        reps = scratch.cut(reps.join(rows.select("rep").distinct(), "rep", "left_semi"), "left")  # later rounds are about no others
        rows = rows.mapInArrow(lean(_branches(sim)), schema)


def _near_pivot(percent: int):
    def run(batches):
        for b in batches:
            t = pa.Table.from_batches([b])
            own, pivot, every = Bins(t.column("sig"), t.column("n").to_numpy()), Bins(t.column("ps"), t.column("pn").to_numpy()), np.arange(b.num_rows)
            yield pa.RecordBatch.from_arrays([*(t.column(c).combine_chunks() for c in ("node", "rep", "sig", "known", "p")), pa.array(alike(own, every, pivot, every, percent))], ["node", "rep", "sig", "known", "p", "near"])

    return run


def _identities(batches):
    """Adds n, h1 and h2, which name the class of a row, to rows whose last column is the text."""
    for b in batches:
        n, h1, h2 = [], [], []
        for s in shingle_sets(b.column(b.num_columns - 1)):
            n.append(len(s))
            x, y = identity(s)
            h1.append(x)
            h2.append(y)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64())], [*b.schema.names, "n", "h1", "h2"])


def _wanted_sets(filter_):
    """The full sets of the texts whose document the filter holds, of rows (hash of doc_id, doc_id, text)."""
    keep = only(filter_, True)

    def run(batches):
        yield from _sets(b.select(["doc_id", "text"]) for b in keep(batches))

    return run


def _sets(batches):
    """Full sets of texts, and what names their class: (low, n, h1, h2, s)."""
    for b in batches:
        out = []
        for k, s in enumerate(shingle_sets(b.column(1))):
            out.append((b.column(0)[k].as_py(), len(s), *identity(s), s.tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 5, (*[pa.int64()] * 4, pa.binary()), strict=True)], ["low", "n", "h1", "h2", "s"])


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


#: Standard deviations by which a sketch may fall short where a cluster's pairs are confirmed: one pair at the threshold in 3 million is lost.
SURE = 5.0


def _confirm(percent: int):
    """Links of a cluster on full sets, as (rep, root): every pair that no confirmed link connects yet and that may be one by its sketches."""

    def run(t: pa.Table) -> pa.Table | None:
        rep, first = np.unique(t.column("rep").to_numpy(), return_index=True)
        raw = t.column("s")
        sets = [np.frombuffer(raw[i].as_py(), np.uint64) for i in first.tolist()]
        sig, state = Bins(t.column("sig").take(pa.array(first)), np.array([len(s) for s in sets])), Roots(len(rep))
        for i in range(len(rep) - 1):
            rest = np.arange(i + 1, len(rep))
            rest = rest[state.root[rest] != state.root[i]]
            for j in near(sig, i, rest, percent, SURE).tolist() if len(rest) else ():
                if state.root[i] != state.root[j] and linked(sets[i], sets[j], percent):
                    state.join(i, np.array([j]))
        moved = np.flatnonzero(state.root != np.arange(len(rep)))
        return pa.table({"rep": rep[moved], "root": rep[state.root[moved]]}) if len(moved) else None

    return run


def _compare(percent: int):
    """Of a block of rows that ask (side 1) and one of rows that are asked the pairs (a, b) that may be links; of two that ask (side 2 when asked) the smaller one does."""

    def run(t: pa.Table) -> pa.Table | None:
        rep, side, sig = t.column("rep").to_numpy(), t.column("side").to_numpy(), Bins(t.column("sig"), t.column("n").to_numpy())
        out = []
        for i in np.flatnonzero(side).tolist():
            rest = np.flatnonzero((side == 0) | (side == 2) & (rep > rep[i]))
            out += [(rep[i], rep[j]) for j in near(sig, i, rest, percent, SURE).tolist()]
        return pa.table([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"]) if out else None

    return run


def _linked_pairs(percent: int):
    """Of rows (a, b, s, p) those whose two sets are linked."""

    def run(batches):
        for b in batches:
            hit = [linked(np.frombuffer(s.as_py(), np.uint64), np.frombuffer(p.as_py(), np.uint64), percent) for s, p in zip(b.column(2), b.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays(b.columns[:2], ["a", "b"]).filter(pa.array(hit, pa.bool_()))

    return run


def _large(full: DataFrame, scratch: Scratch, percent: int, block: int = 512) -> DataFrame:
    """Links (a, b) in clusters too large for one task, confirmed on full sets, a pair at a time.

    All documents are held against the cluster's pivot. Those linked with it are connected, so
    only pairs with one of the others are left: their sketches, in blocks, meet the sketches of all,
    in blocks, and of the pairs that may be links the two sets are fetched and compared.
    """
    sets = full.select("rep", "s")
    pivot = full.groupBy("cluster").agg(F.min_by(F.struct(F.col("rep").alias("p"), F.col("s").alias("ps")), F.xxhash64("rep")).alias("v")).select("cluster", "v.*")
    spokes = full.join(pivot, "cluster").where("rep <> p").select(F.col("rep").alias("a"), F.col("p").alias("b"), "s", F.col("ps").alias("p"))
    star = scratch.cut(spokes.mapInArrow(lean(_linked_pairs(percent)), "a long, b long"), "star")
    near = star.select(F.col("a").alias("rep")).unionByName(pivot.select(F.col("p").alias("rep"))).withColumn("near", F.lit(True))
    rows = full.select("cluster", "rep", "n", "sig").join(near, "rep", "left").withColumn("near", F.coalesce("near", F.lit(False)))
    rows = scratch.cut(rows, "pivot")
    parts = rows.groupBy("cluster").agg(F.ceil(F.count_if(~F.col("near")) / block).cast("int").alias("others"), F.ceil(F.count("*") / block).cast("int").alias("all")).where("others > 0")
    rows = rows.join(parts, "cluster")
    deal = lambda n: F.pmod(F.xxhash64("rep", F.lit(9)), n).cast("int")
    asks = rows.where("NOT near").select("cluster", deal(F.col("others")).alias("x"), F.explode(F.sequence(F.lit(0), F.col("all") - 1)).alias("y"), "rep", "n", "sig", F.lit(1).alias("side"))
    base = rows.select("cluster", F.explode(F.sequence(F.lit(0), F.col("others") - 1)).alias("x"), deal(F.col("all")).alias("y"), "rep", "n", "sig", F.when(F.col("near"), 0).otherwise(2).alias("side"))
    pairs = by_group(asks.unionByName(base), ["cluster", "x", "y"], _compare(percent), "a long, b long")
    pairs = scratch.cut(pairs, "pairs")
    both = pairs.join(sets.withColumnRenamed("rep", "a"), "a").join(sets.select(F.col("rep").alias("b"), F.col("s").alias("p")), "b").select("a", "b", "s", "p")
    return star.unionByName(both.mapInArrow(lean(_linked_pairs(percent)), "a long, b long"))


def near_duplicates(docs: DataFrame, scratch: Scratch, percent: int = 80, trees: int = 10, node_rows: int = 8_192, cluster_rows: int = 2_000) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document; links are pairs whose Jaccard similarity is `percent` / 100 or more.

    Documents with equal sets are one class from the start. Classes are branched by chosen minwise
    tokens in `trees` independent trees. A node has a little more than 1 / similarity children on average, so
    a pair at the threshold survives in a tree with a chance that falls to a constant, not to 0, as
    nodes branch on: `missed` gives the chance that all trees lose it, at 0.85 and ten trees below 10^-9 after
    one level, 4 * 10^-4 after 12 and 2 * 10^-3 however deep (at 0.8 below 10^-8, 2 * 10^-3 and 6 * 10^-3). A node
    of 128 classes or fewer is compared exhaustively.

    Nodes are compared on sketches of 512 bins, which tell a pair at the threshold from one a fifth
    less similar; what may be linked is a cluster of candidates, in which every pair that sketches allow is
    compared on full sets, and only links so confirmed count. Nothing is capped: a large node branches on over the
    cluster's tasks, a large cluster is compared in blocks of sketches and then a pair at a time.

    Null text, or a text without words: an empty set, linked with nothing. One to four words: the
    sequence is the only shingle. Null doc_id: searched as any other; its component is named by the
    smallest doc_id in it, null if there is none; kept is null. Repeated rows: equal sets, one
    component; each row with the smallest doc_id is kept. Different texts of a doc_id: classes of
    their own. Very long texts: whole. Empty table: no rows. Other columns are not read.
    """
    rows, known = _classes(docs, scratch, percent, trees, node_rows, cluster_rows)
    out = rows.select("doc_id", "n", "h1", "h2").join(known.select("n", "h1", "h2", "component"), ["n", "h1", "h2"], "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def _classes(docs: DataFrame, scratch: Scratch, percent: int = 80, trees: int = 10, node_rows: int = 8_192, cluster_rows: int = 2_000) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, n, h1, h2), and their classes (n, h1, h2, root, component): linked ones share a root and the smallest doc_id."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    full = scratch.cut(text.mapInArrow(lean(_sketches), "doc_id long, n long, h1 long, h2 long, sig binary"), "sketches")
    reps = full.where("n > 0").groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("low"), F.any_value("sig").alias("sig"))
    reps = scratch.cut(reps.withColumn("rep", F.monotonically_increasing_id()), "classes")
    rows = scratch.cut(full.select("doc_id", "n", "h1", "h2"), "rows")
    scratch.drop(full)
    pairs = candidates(reps, scratch, percent, trees, node_rows)
    clusters = scratch.cut(components(scratch, pairs).select(F.col("v").alias("rep"), F.col("root").alias("cluster")), "clusters")
    wanted = clusters.join(reps.select("rep", "n", "h1", "h2", "low", "sig"), "rep")
    by, sets = ["n", "h1", "h2"], "low long, n long, h1 long, h2 long, s binary"
    # Only the texts of candidates turn into sets and are shuffled: a filter of fixed size goes to them, not they to the candidates.
    held = text.sparkSession.sparkContext.broadcast(key_filter(wanted.where("low IS NOT NULL").select(F.xxhash64("low").alias("key"))))
    named = text.where("doc_id IS NOT NULL").select(F.xxhash64("doc_id").alias("key"), "doc_id", "text").mapInArrow(lean(_wanted_sets(held)), sets)
    named = named.groupBy("low", *by).agg(F.any_value("s").alias("s"))  # one row of a repeated document
    named = named.join(wanted, [*by, "low"]).select("cluster", "rep", "n", "s", "sig")
    nameless = text.where("doc_id IS NULL").select("doc_id", "text").mapInArrow(lean(_sets), sets).groupBy(*by).agg(F.any_value("s").alias("s"))
    full = named.unionByName(nameless.join(wanted.where("low IS NULL"), by).select("cluster", "rep", "n", "s", "sig"))
    size = clusters.groupBy("cluster").agg(F.count("*").alias("size"))
    full = scratch.cut(full.join(size, "cluster"), "sets")
    roots = by_group(full.where(F.col("size") <= cluster_rows), ["cluster"], _confirm(percent), "rep long, root long")
    large = full.where(F.col("size") > cluster_rows)
    if not size.where(F.col("size") > cluster_rows).isEmpty():
        more = components(scratch, _large(large.dropDuplicates(["cluster", "rep"]), scratch, percent))
        roots = roots.unionByName(more.where("v <> root").select(F.col("v").alias("rep"), "root"))
    known = reps.select("n", "h1", "h2", "rep", "low").join(roots, "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    known = scratch.cut(known.select("n", "h1", "h2", "root", "low"), "known")
    named_by = known.groupBy("root").agg(F.min("low").alias("component"))
    return rows, known.select("n", "h1", "h2", "root").join(named_by, "root")


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), Scratch(spark), percent=85)


def deduplicate(docs: DataFrame, scratch: Scratch, **how) -> DataFrame:
    """The documents, all their columns kept, without near duplicates: of each component the smallest doc_id stays.

    Of rows with equal doc_id and text one stays. Rows without a doc_id go where their component has one;
    of a component that has none one row stays. Without words, and so linked with nothing, all of them stay.
    """
    rows, known = _classes(docs, scratch, **how)
    known = scratch.cut(known, "components")
    same = ["n", "h1", "h2"]
    # The columns of docs travel as one, so that their names can't clash with ours.
    docs = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("_text"))
    named = rows.where("doc_id IS NOT NULL").join(known, same, "left").select(F.col("doc_id").alias("_id"), *same, (F.col("n").eqNullSafe(0) | F.col("doc_id").eqNullSafe(F.col("component"))).alias("keep"))
    kept = named.groupBy("_id").agg(F.bool_or("keep").alias("_any"), F.bool_and("keep").alias("_all")).where("_any")
    kept = scratch.cut(kept, "kept")
    have = docs.join(kept, "_id")
    once = have.where("_all").select("_row", "_id", "_text")
    # Of a doc_id with several texts some may go: only such rows are looked at again.
    if not kept.where("NOT _all").isEmpty():
        some = _identified(have.where("NOT _all").select("_row", "_id", "_text"))
        once = once.unionByName(some.join(named.where("keep").select("_id", *same).distinct(), ["_id", *same], "left_semi").select("_row", "_id", "_text"))
    once = once.dropDuplicates(["_id", "_text"])
    first = known.where("component IS NULL").groupBy("root").agg(F.min(F.struct(*same)).alias("f")).select("f.*")
    null = _identified(docs.where("_id IS NULL"))
    # A group-limited window: before the shuffle each task keeps one row a class, however many copies there are.
    one = null.join(first, same, "left_semi").withColumn("_r", F.row_number().over(Window.partitionBy(*same).orderBy("_text"))).where("_r = 1")
    return once.select("_row.*").unionByName(null.where("n = 0").select("_row.*")).unionByName(one.select("_row.*"))


def _identified(rows: DataFrame) -> DataFrame:
    """Adds what names the class of a row to rows whose last column is the text."""
    more = [ST.StructField(c, ST.LongType()) for c in ("n", "h1", "h2")]
    return rows.mapInArrow(lean(_identities), ST.StructType([*rows.schema.fields, *more]))
