"""Plain versions of the operators on small inputs, written without looking for speed."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import xxhash

LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def groups(nodes, linked):
    """Smallest node reachable from each."""
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {n: find(n) for n in nodes}


def fingerprint(text, size=3):
    w = words((text or "").translate(LOWER))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    out = 0
    for bit in range(64):
        if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes):
            out |= 1 << bit
    return out


def boilerplate_cut(rows, ratio, least):
    """rows: (host, text). The texts without lines on too many of the host's pages."""
    pages, counts = Counter(h for h, _ in rows), Counter()

    def key(line):
        return line.strip(" \t\r")

    for host, text in rows:
        counts.update({(host, key(x)) for x in (text or "").split("\n") if key(x)})

    def gone(host, line):
        n = counts[host, key(line)]
        return key(line) and n >= least and n > pages[host] * ratio

    return [
        None if t is None else "\n".join(x for x in t.split("\n") if not gone(h, x)) for h, t in rows
    ]


def targets(sizes, weights=(5.0, 2.0, 1.0), share=1.5, cap=2.0):
    """Targets by source, the excess over the cap shared again until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, budget, out = set(order), share * sum(sizes.values()), {}
    while left:
        total = sum(weight[s] for s in left)
        over = {s for s in left if budget * weight[s] / total > cap * sizes[s]}
        if not over:
            return out | {s: budget * weight[s] / total for s in left}
        for s in over:
            out[s] = cap * sizes[s]
        budget -= sum(out[s] for s in over)
        left -= over
    return out


def copies(rows, seed=17):
    """rows: (doc_id, source, text). Copies of each row, in the order of rows."""
    sizes = defaultdict(int)
    for _, source, text in rows:
        sizes[source] += len(words(text))
    target, out = targets(sizes), [0] * len(rows)
    for source in sizes:
        own = [i for i, r in enumerate(rows) if r[1] == source]
        own.sort(key=lambda i: (len(words(rows[i][2])), rows[i][0]))
        rate = target[source] / sizes[source] if sizes[source] else 0.0
        name = f"{seed}:" + ("null" if source is None else f"={source}")
        start = int(hashlib.md5(name.encode()).hexdigest()[:12], 16) / float(1 << 48)
        for rank, i in enumerate(own, 1):
            out[i] = math.floor(rate * rank + start) - math.floor(rate * (rank - 1) + start)
    return out


def unit(v):
    try:
        x = np.array(v, float)
        return x / np.linalg.norm(x) if len(x) and np.isfinite(x).all() and x.any() else None
    except (TypeError, ValueError):
        return None


def entropy(text):
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values())
