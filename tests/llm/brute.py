"""Plain versions of the operators, for small inputs."""

import base64
import collections
import hashlib
import re

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def components(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near_documents(rows, percent):
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    comp = components(ids, links)
    return sorted((i, len(sets[i]), comp[i], comp[i] == i) for i in ids)


def near_vectors(rows, threshold):
    ok = {i: np.array(v, float) for i, label, v in rows if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    label = {i: label for i, label, _ in rows}
    links = [(a, b) for a in ok for b in ok if a < b and label[a] == label[b] and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] / (np.linalg.norm(ok[a]) * np.linalg.norm(ok[b])) >= threshold]
    n = collections.Counter(x for link in links for x in link)
    comp = components([i for i, _, _ in rows], links)
    return sorted((i, n[i], comp[i], comp[i] == i) for i, _, _ in rows)


def repeats(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    seen = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (doc, _), t in zip(rows, texts, strict=True):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((doc, len(t), int(gone.sum()), runs, hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def records(rows):
    same = collections.defaultdict(list)
    for page, _, html in rows:
        same[html or ""].append(page)
    out = []
    for page, _, html in rows:
        p, last = (html or "").encode(), max((x for x in same[html or ""] if x is not None), default=None)
        first = last is None or page == last
        out.append((page, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if first else "revisit", None if first else last))
    return sorted(out, key=str)


PATTERNS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def personal(text):
    out = []
    for kind, rule in PATTERNS:
        for m in re.finditer(rule, text):
            d = [int(c) for c in m[0] if c in "0123456789"]
            luhn = sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d))) % 10 == 0
            if kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")) or kind == "card" and 13 <= len(d) <= 19 and luhn or kind == "phone" and 9 <= len(d) <= 15:
                out.append((kind, *m.span()))
    return out


def top_k(rows, k, every, scale=256):
    ok = {i: np.floor(scale * np.array(v, float)).astype(int) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for q in sorted(ok):
        if q % every == 0:
            best = sorted((-int(ok[q] @ ok[c]), c) for c in ok if c != q)[:k]
            out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(best)]
    return out


def targets(sizes, weights, demand, repeats):
    """Water filling in rounds, by source in order."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, out, free = demand * sum(sizes.values()), {}, list(names)
    while free:
        level = left / sum(w[s] for s in free)
        full = [s for s in free if repeats * sizes[s] <= w[s] * level]
        if not full:
            out |= {s: w[s] * level for s in free}
            break
        for s in full:
            out[s] = repeats * sizes[s]
            left -= out[s]
            free.remove(s)
    return out
