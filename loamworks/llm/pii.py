"""Personal data by patterns and a skip-chain conditional random field."""

from __future__ import annotations

import hashlib
import pickle
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MOST_BYTES, lean, one_text, table

KINDS = ("email", "ip", "card", "phone")
LABELS = ("other", *KINDS)
K = len(LABELS)

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# A match can only begin where a run of digits does, so looking behind saves tries inside runs and changes nothing.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
DIGITS = re.compile(r"[^0-9]+")
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
EDGE = ".,;:!?\"'()[]{}<>*#$&|="


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses, found from their signs: linear in the text."""
    out, pos, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > pos and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            pos = m.end()
        at = text.find("@", max(at + 1, pos))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind and start, of what the patterns find; a match that fails its check is dropped."""
    out = [(0, s, e) for s, e in emails(text)] if "@" in text else []
    if not DIGIT.search(text):
        return out
    if "." in text:
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
                out.append((1, *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            d = DIGITS.sub("", m[0])
            if 13 <= len(d) <= 19 and luhn(d):
                out.append((2, *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(DIGITS.sub("", m[0])) <= 15:
                out.append((3, *m.span()))
    return out


FEATURES = 24


def features(core: str) -> np.ndarray:
    """What a token looks like."""
    digits = DIGITS.sub("", core)
    n, dots = len(digits), core.count(".")
    parts = core.split(".")
    octets = len(parts) == 4 and all(p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts if p.isascii()) and core.isascii()
    letters = sum(c.isalpha() for c in core)
    row = [
        1, "@" in core, "@" in core and "." in core.rpartition("@")[2], octets, dots == 3, 0 < dots < 3, dots > 3, core.startswith("+"),
        n == 0, 1 <= n <= 3, n == 4, 5 <= n <= 8, 9 <= n <= 12, 13 <= n <= 15, 16 <= n <= 19, n > 19, 13 <= n <= 19 and luhn(digits),
        n == len(core) > 0, letters > 0, letters > 0 and n > 0, "-" in core, "(" in core or ")" in core, letters > 3 * max(1, n), "_" in core,
    ]
    return np.array(row, np.float32)


LEAST_DIGITS, LEAST_NAME = 7, 4


def telling(name: str) -> bool:
    """Whether what is before an @ can stand for its address alone: no plain word, and not too short."""
    return len(name) >= LEAST_NAME and not name.isalpha()


def keys(core: str) -> set[tuple[str, str]]:
    """What nodes that are alike share: the whole token, its last digits, or what is before its @. Short numbers, such as years, are like nothing."""
    low, digits = core.lower(), DIGITS.sub("", core)
    out = set()
    if "@" in low or len(digits) >= LEAST_DIGITS or low.count(".") == 3 and len(digits) >= 4:
        out.add(("t", low))
    if len(digits) >= LEAST_DIGITS:
        out.add(("d", digits[-LEAST_DIGITS:]))
    if telling(name := low.partition("@")[0]) and not name.replace(".", "").isdigit():
        out.add(("n", name))
    return out


class Graph:
    """The nodes and edges of one document.

    A node is a token that holds four digits or an @, lies in a pattern's span, or repeats what is
    before the @ of an address. Neighbours in the text are linked, and so are successive nodes that are
    alike, however far apart: equal but for case and edge signs, equal in their last seven digits, or
    an address and what is before its @. All other tokens are clamped to `other`.

    `y` is the label that a pattern gives, 0 without one. `open` marks nodes without a pattern whom
    links connect with one that has: what they are is not known, and nothing is learned as if it were.
    """

    def __init__(self, text: str, base: list[tuple[int, int, int]]):
        names = {text[s:e].partition("@")[0].lower() for k, s, e in base if k == 0}
        names = {x for x in names if telling(x)}
        self.span, self.x, self.y, self.chain, self.skip, self.core = [], [], [], [], [], []
        by_start = sorted((s, e, k) for k, s, e in base)
        at, last, seen = 0, -9, {}
        group: list[int] = []  # roots of what links connect
        for n, m in enumerate(TOKEN.finditer(text)):
            while at < len(by_start) and by_start[at][1] <= m.start():
                at += 1
            token = m[0]
            hit = next((k for s, e, k in by_start[at : at + 4] if s < m.end() and e > m.start()), None)
            if hit is None and "@" not in token and not (names and token.strip(EDGE).lower() in names):
                if not DIGIT.search(token) or len(DIGITS.sub("", token)) < 4:
                    continue
            left = len(token) - len(token.lstrip(EDGE))
            core = token.strip(EDGE)
            i = len(self.span)
            self.span.append((m.start() + left, m.start() + left + len(core)))
            self.core.append(core)
            self.x.append(features(core))
            self.y.append(0 if hit is None else hit + 1)
            group.append(i)
            if last == n - 1:
                self.chain.append((i - 1, i))
            last = n
            for j in sorted({seen[key] for key in keys(core) if key in seen}):
                self.skip.append((j, i))
                a, b = _top(group, i), _top(group, j)
                group[max(a, b)] = min(a, b)
            for key in keys(core):
                seen[key] = i
        tops = [_top(group, i) for i in range(len(group))]
        sure = {t for t, y in zip(tops, self.y, strict=True) if y}
        self.open = [not y and t in sure for t, y in zip(tops, self.y, strict=True)]


def _top(group: list[int], i: int) -> int:
    while group[i] != i:
        group[i] = group[group[i]]
        i = group[i]
    return i


def mentions(core: str, kind: int) -> list[str]:
    """How a text may repeat an entity so that no pattern finds it."""
    digits = DIGITS.sub("", core)
    if kind == 0:
        ways = [core.partition("@")[0], core.partition("@")[0].upper(), core.replace("@", "(at)")]
    elif kind == 1:
        ways = [core.replace(".", "-"), core.replace(".", "[.]"), core.replace(".", "_")]
    else:
        ways = [digits, digits[-LEAST_DIGITS:], f"{digits[:-4]}-{digits[-4:]}", ".".join(digits[i : i + 4] for i in range(0, len(digits), 4)), f"no{digits[-10:]}"]
    own = keys(core)
    return [w for w in dict.fromkeys(ways) if w != core and keys(w) & own and not base_spans(w)]


def rehearsal(g: Graph) -> tuple[np.ndarray, ...] | None:
    """The document's graph for training, with mentions that no pattern finds.

    Each form in which a pattern's token might be repeated is added twice: linked with the token, under its
    label, and alone, as `other`. What a mention looks like then says nothing of its label, and only the
    link tells. Labels: -1 for open nodes.
    """
    x, y, skip = list(g.x), [-1 if o else k for k, o in zip(g.y, g.open, strict=True)], list(g.skip)
    for i, k in enumerate(g.y):
        for way in mentions(g.core[i], k - 1) if k else ():
            skip.append((i, len(y)))
            x += [features(way)] * 2
            y += [k, 0]
    return (np.stack(x), np.array(y, np.int64), _pairs(g.chain), _pairs(skip)) if y else None


def _pairs(rows: list) -> np.ndarray:
    return np.array(rows, np.int64).reshape(-1, 2)


class Model:
    """Weights of the field: features by label, neighbours' labels, and labels of nodes that are alike."""

    def __init__(self):
        self.u, self.chain, self.skip = np.zeros((FEATURES, K)), np.zeros((K, K)), np.zeros((K, K))

    def fit(self, graphs: list[tuple], steps: int = 400, rate: float = 0.1, l2: float = 1e-4, every: int = 100) -> Model:
        """Maximises the pseudo-likelihood: each node's label given its features and its neighbours' labels.

        Labels of -1 are latent: at first such nodes say nothing, and are asked nothing; every `every` steps
        they take the labels that the field expects of them.
        """
        x, y, chain, skip = join(graphs)
        if not len(y):
            return self
        one, latent = np.eye(K)[np.maximum(y, 0)], y < 0
        one[latent] = 0
        asked = np.where(latent, 0.0, 1.0)
        params, p = [self.u, self.chain, self.skip], one
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for t in range(1, steps + 1):
            if t % every == 1:
                if t > 1:
                    one[latent], asked[latent] = p[latent], 1.0  # as the step before expects
                near, after, like = np.zeros((len(y), K)), np.zeros((len(y), K)), np.zeros((len(y), K))
                np.add.at(near, chain[:, 1], one[chain[:, 0]])
                np.add.at(after, chain[:, 0], one[chain[:, 1]])
                np.add.at(like, skip[:, 0], one[skip[:, 1]])
                np.add.at(like, skip[:, 1], one[skip[:, 0]])
            p = _soft(x @ self.u + near @ self.chain + after @ self.chain.T + like @ self.skip)
            d = (p - one) * asked[:, None] / asked.sum()
            grads = [x.T @ d, near.T @ d + (after.T @ d).T, like.T @ d]
            for k, g in enumerate(grads):
                g = g + l2 * params[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                params[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
            self.skip[:] = (self.skip + self.skip.T) / 2
        return self

    def infer(self, x: np.ndarray, known: np.ndarray, chain: np.ndarray, skip: np.ndarray, steps: int = 30) -> np.ndarray:
        """Marginals by loopy sum-product messages, damped; nodes with a known label other than `other` are clamped to it."""
        own = x @ self.u
        own = np.where((known > 0)[:, None], np.where(np.arange(K) == known[:, None], 0.0, -60.0), own)
        a, b = np.concatenate([chain[:, 0], skip[:, 0]]), np.concatenate([chain[:, 1], skip[:, 1]])
        if not len(a):
            return _soft(own)
        pair = np.concatenate([np.broadcast_to(self.chain, (len(chain), K, K)), np.broadcast_to(self.skip, (len(skip), K, K))])
        to, fro = np.concatenate([b, a]), np.concatenate([a, b])
        pair = np.concatenate([pair, pair.transpose(0, 2, 1)])  # message, sender's label, receiver's label
        back = np.concatenate([np.arange(len(a), 2 * len(a)), np.arange(len(a))])
        msg = np.zeros((len(to), K))
        for _ in range(steps):
            belief = own.copy()
            np.add.at(belief, to, msg)
            send = (belief[fro] - msg[back])[:, :, None] + pair
            top = send.max(1)
            new = top + np.log(np.exp(send - top[:, None]).sum(1))
            new -= new.max(1, keepdims=True)
            change = np.abs(new - msg).max()
            msg = 0.5 * msg + 0.5 * new
            if change < 1e-3:
                break
        belief = own.copy()
        np.add.at(belief, to, msg)
        return _soft(belief)


def _soft(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def join(graphs: list[tuple]) -> tuple[np.ndarray, ...]:
    """Several documents' graphs as one without edges between them."""
    at, x, y, chain, skip = 0, [np.zeros((0, FEATURES), np.float32)], [np.zeros(0, np.int64)], [_pairs([])], [_pairs([])]
    for gx, gy, gc, gs in graphs:
        x.append(gx)
        y.append(gy)
        chain.append(gc + at)
        skip.append(gs + at)
        at += len(gy)
    return np.concatenate(x), np.concatenate(y), np.concatenate(chain), np.concatenate(skip)


def graph(text: str, base) -> tuple[Graph, tuple] | None:
    g = Graph(text, base) if base or "@" in text or DIGIT.search(text) else None
    if g is None or not g.span:
        return None
    return g, (np.stack(g.x), np.array(g.y, np.int64), _pairs(g.chain), _pairs(g.skip))


def _graphs(batches):
    for b in batches:
        keys_, out = [], []
        for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if text and (got := graph(text, base_spans(text))):
                keys_.append(key)
                out.append(pickle.dumps(rehearsal(got[0])))
        yield pa.RecordBatch.from_arrays([pa.array(keys_, pa.int64()), pa.array(out, pa.binary())], ["key", "graph"])


def train(docs: DataFrame, max_train: int = 3000, most_bytes: int = MOST_BYTES) -> Model:
    """Fits the field to what the patterns find in at most `max_train` documents, those with the smallest hash of doc_id.

    One text a document, however often its id repeats, and at most `most_bytes` of text together: that
    bounds what the driver gathers, about 100 bytes a node. The sums are taken in the order of doc_id.
    """
    pick = docs.select(F.col("doc_id").cast("long").alias("_id")).where("_id IS NOT NULL").distinct().orderBy(F.xxhash64("_id"), "_id").limit(max_train)
    rows = one_text(docs, pick, most_bytes).mapInArrow(lean(_graphs), "key long, graph binary").toArrow().sort_by("key")
    return Model().fit([pickle.loads(x) for x in rows.column(1).to_pylist()])  # bytes that our own tasks wrote


def find(texts: list[str | None], model: Model, least: float = 0.9):
    """Of each text the patterns' spans and those that the field adds."""
    base = [base_spans(t) if t else [] for t in texts]
    got = [graph(t, s) if t else None for t, s in zip(texts, base, strict=True)]
    added: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if some := [g[1] for g in got if g]:
        x, y, chain, skip = join(some)
        p = model.infer(x, y, chain, skip)
        best, at = p.argmax(1), 0
        for d, g in enumerate(got):
            if g:
                for i, (s, e) in enumerate(g[0].span):
                    k = int(best[at + i])
                    if k and y[at + i] == 0 and p[at + i, k] >= least and e > s:
                        added[d].append((k - 1, s, e))
                at += len(g[0].span)
    return base, added


def _says(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


def _detect(model, least: float, rows: int = 256):
    def run(batches):
        for whole in batches:
            for i in range(0, whole.num_rows, rows):
                b = whole.slice(i, rows)
                base, added = find(b.column(1).to_pylist(), model.value, least)
                counts = [pa.array([sum(k == kind for k, _, _ in x) for x in base], pa.int64()) for kind in range(4)]
                sha = pa.array([hashlib.sha256(_says(x).encode()).hexdigest() for x in base])
                yield pa.RecordBatch.from_arrays([b.column(0), *counts, sha, pa.array([_says(x + y) for x, y in zip(base, added, strict=True)], pa.string())], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return run


def detect(docs: DataFrame, model: Model | None = None, least: float = 0.9, **how) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every document.

    Counts and the digest are those of the patterns; `spans` also holds what the field adds with a
    marginal of `least` at least, in code points, by kind and start. Messages pass within a
    document only, over its whole text, for a few hundred documents at a time.

    Null or empty text: no spans. Very long texts: whole; work is linear in the text. Repeated rows:
    each gets its row, one of them is trained on. Null doc_id: kept. Empty table: no rows. Other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model or train(docs, **how))  # a few hundred numbers
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lean(_detect(sent, least)), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span replaced by its kind; spans that overlap count as one, of the first's kind."""
    out, at = [], 0
    for s, e, k in sorted((s, e, k) for k, s, e in spans):
        if s >= at:
            out += [text[at:s], f"<{KINDS[k].upper()}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def _redact(model, least: float, place: int, rows: int = 256):
    def run(batches):
        for whole in batches:
            for i in range(0, whole.num_rows, rows):
                b = whole.slice(i, rows)
                texts = b.column(place).to_pylist()
                base, added = find(texts, model.value, least)
                new = [t if t is None else redacted(t, x + y) for t, x, y in zip(texts, base, added, strict=True)]
                yield b.set_column(place, b.schema.field(place).name, pa.array(new, pa.string()))

    return run


def redact(docs: DataFrame, model: Model | None = None, least: float = 0.9, **how) -> DataFrame:
    """The documents, all their columns kept, with personal data in `text` replaced by <KIND>, both what patterns find and what the field adds.

    Null text: null. Empty text: empty. Very long texts: whole. Repeated rows: alike, each by itself. Null
    doc_id: kept. Empty table: no rows. Other columns pass through, whatever their names.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model or train(docs, **how))
    return docs.mapInArrow(lean(_redact(sent, least, docs.columns.index("text"))), docs.schema)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(table(spark, sf_dir, "documents"))
