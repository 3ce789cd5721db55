"""Slow and plain versions of the operators, for small fixtures."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import regex

WORD = regex.compile(r"[\p{L}\p{N}]+")


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def grams(text: str | None, n: int) -> frozenset:
    w = words(text)
    return frozenset(tuple(w[i : i + n]) for i in range(max(len(w) - n + 1, 1))) if w else frozenset()


def pairs(docs: dict[int, str], n: int, threshold: float) -> dict[tuple[int, int], float]:
    """All pairs of documents at or above the threshold, each document a query."""
    sets = {i: grams(t, n) for i, t in docs.items()}
    out = {}
    for a, b in combinations(sorted(i for i, s in sets.items() if s), 2):
        shared = len(sets[a] & sets[b])
        if shared and (j := shared / (len(sets[a]) + len(sets[b]) - shared)) >= threshold - 1e-9:
            out[a, b] = j
    return out


def nearest(points: np.ndarray, nodes: np.ndarray, k: int) -> dict[int, list[tuple[float, int]]]:
    """(cosine of 6 places, node) of the k nearest of each point, ties by lower node: compares all with all."""
    out = {}
    for i, v in enumerate(nodes.tolist()):
        cos = [(-round(float(c), 6), int(w)) for c, w in zip(points @ points[i], nodes, strict=True) if w != v]
        out[v] = [(-c, w) for c, w in sorted(cos)[:k]]
    return out


def walk(near: dict[int, list[int]], sims: dict[tuple[int, int], float]) -> list[list[int]]:
    """Greedy paths over an undirected graph, each step a search of everything that is left."""
    degree = {v: len(n) for v, n in near.items()}
    left, paths = set(near), []
    while left:
        v = min(left, key=lambda x: (degree[x], x))
        path = []
        while v is not None:
            left.discard(v)
            path.append(v)
            free = [u for u in near[v] if u in left]
            v = min(free, key=lambda u: (-sims[min(path[-1], u), max(path[-1], u)], degree[u], u)) if free else None
        paths.append(path)
    return paths


def across(paths: list[list[int]], sims: dict[tuple[int, int], float], shard: dict[int, int]) -> list[list[int]]:
    """paths, each walked inside a shard, in their order, after the links between shards have had their turn among the steps, one link after the other."""
    key = lambda e: (-sims[e], e)
    edge = lambda a, b: (min(a, b), max(a, b))
    first = {v: (i, j) for i, p in enumerate(paths) for j, v in enumerate(p)}
    steps = {edge(a, b) for p in paths for a, b in zip(p[:-1], p[1:], strict=True)}
    degree, taken = dict.fromkeys(first, 0), set()

    def take(links: set) -> None:
        for a, b in sorted(links, key=key):
            if degree[a] < 2 and degree[b] < 2:
                taken.add((a, b))
                degree[a] += 1
                degree[b] += 1

    take(steps | {e for e in sims if shard[e[0]] != shard[e[1]]})
    freed = {v for e in steps - taken for v in e}
    take({e for e in sims if shard[e[0]] == shard[e[1]] and freed & set(e)} - steps)
    # unbroken stretches of the walked paths
    head, stretches = {}, {}
    for p in paths:
        for j, v in enumerate(p):
            head[v] = head[p[j - 1]] if j and edge(p[j - 1], v) in taken else v
            stretches.setdefault(head[v], []).append(v)
    left = {e for e in taken - steps if head[e[0]] != head[e[1]]}
    out = {}
    parts: list[set] = []
    for h in stretches:
        part, todo = {h}, [h]
        while todo:
            x = todo.pop()
            for a, b in left:
                for u, w in ((head[a], head[b]), (head[b], head[a])):
                    if u == x and w not in part:
                        part.add(w)
                        todo.append(w)
        if part not in parts:
            parts.append(part)
    for part in parts:
        own = {e for e in left if head[e[0]] in part}
        if len(part) > 1 and len(own) == len(part):
            own.remove(max(own, key=key))  # a ring opens at its worst join
        at = min(h for h in part if sum(h in (head[a], head[b]) for a, b in own) < 2)
        start, path = at, []
        while at is not None:
            come = path[-1] if path else None
            enter = next((v for e in own for v in e if come in e and v != come and head[v] == at), None)
            own = {e for e in own if not (come in e and enter in e)}
            go = next(((v, e[0] + e[1] - v) for e in sorted(own) for v in e if head[v] == at), None)
            run = stretches[at]
            path += run[::-1] if len(run) > 1 and (enter == run[-1] if enter is not None else go and go[0] == run[0]) else run
            at = head[go[1]] if go else None
        out[first[start]] = path
    return [out[k] for k in sorted(out)]


def windows(sizes: list[tuple[int, int]], window: int) -> list[tuple[int, int, int, int]]:
    """(window, document, from, to), word by word, of documents (id, words) in order; one without a word has an empty piece."""
    out: list[list[int]] = []
    at = 0
    for doc, n in sizes:
        for word in range(n):
            w = at // window
            if out and out[-1][:2] == [w, doc] and out[-1][3] == word and word:
                out[-1][3] += 1
            else:
                out.append([w, doc, word, word + 1])
            at += 1
        if not n:
            out.append([at // window, doc, 0, 0])
    return [tuple(x) for x in out]


def simple8b(ids: list[int], block: int = 128) -> list[int]:
    """Words of a document's ids: for each word the selector with the most ids that fits, tried one after the other."""
    count, width = [120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], [0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60]
    out = []
    for b in range(0, len(ids), block):
        part, at = ids[b : b + block], 0
        while at < len(part):
            for s in range(15):
                some = part[at : at + count[s]]
                if all(x < 1 << width[s] for x in some) and (len(some) == count[s] or s > 0 or at + len(some) == len(part)):
                    out.append((s + 1) << 60 | sum(x << (j * width[s]) for j, x in enumerate(some)))
                    at += len(some)
                    break
            else:
                out += [0, part[at]]
                at += 1
    return out


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """A piece's tokens: the pair of least rank, the first of equals, becomes one until there is none."""
    if piece in ranks:
        return [ranks[piece]]
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts[:-1], parts[1:], strict=True)) if a + b in ranks), default=None)
        if best is None:
            return [ranks[p] for p in parts]
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def tokens(text: str, ranks: dict[bytes, int]) -> list[int]:
    return [t for p in PIECE.findall(text) for t in merge(p.encode(), ranks)]


def classes(docs: dict[int, str], n: int, threshold: float) -> dict[int, tuple[int, int, int]]:
    """(class, copies, links to other sets) of each document, from all pairs of sets."""
    sets = {i: grams(t, n) for i, t in docs.items()}
    members: dict = {}
    for i in sorted(docs):
        if sets[i]:
            members.setdefault(sets[i], []).append(i)
    reps = {m[0]: s for s, m in members.items()}
    linked = pairs({i: docs[i] for i in reps}, n, threshold)
    group = groups(list(linked))
    count = Counter(x for p in linked for x in p)
    return {i: (i, 0, 0) if not sets[i] else (group.get(r := members[sets[i]][0], r), len(members[sets[i]]) - 1, count[r]) for i in docs}


def groups(edges: list[tuple[int, int]]) -> dict[int, int]:
    """Least id of each one's group."""
    to: dict[int, int] = {}

    def root(x: int) -> int:
        while to.setdefault(x, x) != x:
            x = to[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        to[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(to)}


def repetition(text: str | None, min_units: int = 12) -> tuple[float, int]:
    """(covered fraction, longest repeat): compares every start with every other."""
    u = [x.lower() for x in regex.findall(r"[\p{L}\p{N}\p{M}]+|[^\p{L}\p{N}\p{M}\p{Z}\p{C}]+", text or "")]
    n, best = len(u), [0] * len(u)
    nxt = [0] * (n + 1)  # common prefixes of i and every j, from those of i + 1
    for i in range(n - 1, -1, -1):
        row = [0] * (n + 1)
        for j in range(n - 1, -1, -1):
            if i != j and u[i] == u[j]:
                row[j] = nxt[j + 1] + 1
        # the diagonal is left out, so what overlaps itself counts as at any other distance
        best[i], nxt = max(row), row
    hit = [False] * n
    for i, b in enumerate(best):
        if b >= min_units:
            hit[i : i + b] = [True] * b
    total = sum(map(len, u))
    return (sum(len(x) for x, h in zip(u, hit, strict=True) if h) / total if total else 0.0), max([b for b in best if b >= min_units], default=0)


def tandem(text: str | None, min_units: int = 12, times: int = 3) -> float:
    """Fraction of unit characters in runs of at least times copies of one period of fewer than min_units units: tries every start and period."""
    u = [x.lower() for x in regex.findall(r"[\p{L}\p{N}\p{M}]+|[^\p{L}\p{N}\p{M}\p{Z}\p{C}]+", text or "")]
    hit = [False] * len(u)
    for p in range(1, min_units):
        for i in range(len(u) - times * p + 1):
            if all(u[i + j] == u[i + j % p] for j in range(times * p)):
                hit[i : i + times * p] = [True] * (times * p)
                j = i + times * p
                while j < len(u) and u[j] == u[j - p]:
                    hit[j] = True
                    j += 1
    total = sum(map(len, u))
    return sum(len(x) for x, h in zip(u, hit, strict=True) if h) / total if total else 0.0


def char_grams(text: str | None) -> Counter:
    out: Counter = Counter()
    for w in words(text):
        m = f"\x02{w}\x03"
        out.update(m[j : j + 5] for j in range(max(len(m) - 4, 1)))
        if len(m) > 5:
            out.update(m[j : j + 7] for j in range(max(len(m) - 6, 1)))
    return out


def steps(x: np.ndarray, y: np.ndarray) -> list[tuple[float, float]]:
    """The isotonic fit by its min-max formula, pools smoothed by half an observation either way."""
    at = sorted(set(x))
    s, n = np.array([y[x == v].sum() for v in at]), np.array([(x == v).sum() for v in at])
    fit = [max(min(s[a : b + 1].sum() / n[a : b + 1].sum() for b in range(i, len(at))) for a in range(i + 1)) for i in range(len(at))]
    out: list[list] = []
    for v, f, si, ni in zip(at, fit, s, n, strict=True):
        if out and abs(out[-1][1] - f) < 1e-12:
            out[-1][2] += si
            out[-1][3] += ni
        else:
            out.append([v, f, si, ni])
    return [(v, (si + 0.5) / (ni + 1)) for v, _, si, ni in out]


def toxicity(docs: dict[int, str | None], labels: dict[int, int], k: int = 15, min_chi2: float = 25.0, min_lift: float = 5.0) -> dict[int, float]:
    """Calibrated score of each document: terms, weights, neighbours, votes and calibration computed plainly."""
    tf = {i: char_grams(t) for i, t in docs.items()}
    feats = {i: {(g, j) for g, n in c.items() for j in range(1, min(n, 3) + 1)} for i, c in tf.items()}
    ex = {i: labels[i] > 0 for i in docs if i in labels and docs[i] is not None}
    pos, neg = sum(ex.values()), len(ex) - sum(ex.values())
    a, b = Counter(), Counter()
    for i, toxic in ex.items():
        (a if toxic else b).update(feats[i])
    total, terms = pos + neg, []
    for f in a:
        hit = a[f] + b[f]
        chi2 = total * (a[f] * (neg - b[f]) - b[f] * (pos - a[f])) ** 2 / max(1.0, hit * (total - hit) * pos * neg)
        if a[f] * max(neg, 1) >= b[f] * pos * min_lift and (chi2 >= min_chi2 or not neg):
            terms.append(f)
    chosen = set(terms)
    df = Counter(f for s in feats.values() for f in s & chosen)
    idf = {f: math.log((1 + len(docs)) / (1 + df[f])) + 1 for f in chosen}

    def vector(i: int) -> dict:
        v = {f: tf[i][f[0]] * idf[f] for f in feats[i] & chosen}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {f: x / norm for f, x in v.items()}

    vecs = {i: vector(i) for i in docs}
    examples = {i: vecs[i] for i in ex if vecs[i]}

    def vote(i: int) -> float | None:
        cos = []
        for e, v in examples.items():
            if e != i and (c := round(sum(x * v.get(f, 0.0) for f, x in vecs[i].items()), 6)) > 0:
                cos.append((-c, e))
        near = sorted(cos)[:k]
        return sum(c * c * ex[e] for c, e in near) / sum(c * c for c, _ in near) if near else None

    votes = {i: vote(i) for i in docs}
    used = [i for i in examples if votes[i] is not None]
    fit = steps(np.array([votes[i] for i in used]), np.array([float(ex[i]) for i in used])) if used else []
    none = (pos - sum(ex[i] for i in examples) + 0.5) / (total - len(examples) + 1)
    return {i: none if v is None or not fit else ([s for x, s in fit if x <= v + 1e-12] or [fit[0][1]])[-1] for i, v in votes.items()}


def ppm_bits(samples: list[bytes], text: bytes, order: int = 3) -> float:
    """Code length of text under counts of samples, byte by byte and context by context."""
    counts: list[dict] = [defaultdict(Counter) for _ in range(order + 1)]
    for s in samples:
        if s:
            p = b"\n" * order + s
            for i in range(order, len(p)):
                for o in range(order + 1):
                    counts[o][p[i - o : i]][p[i]] += 1
    total, p = 0.0, b"\n" * order + text
    for i in range(order, len(p)):
        for o in range(order, -1, -1):
            c = counts[o].get(p[i - o : i])
            if c is None:
                continue
            t, q = sum(c.values()), len(c)
            if p[i] in c:
                total -= math.log2(c[p[i]] / (t + q))
                break
            total -= math.log2(q / (t + q))
        else:
            total += 8
    return total


def redact(text: str | None, rules) -> str | None:  # noqa: ANN001
    for r in rules:
        text = re.sub(r.pattern, f"[{r.rule}]", text) if text is not None else None
    return text
