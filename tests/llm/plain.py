"""Brute-force versions of what the pipeline's stages do, in plain Python on dictionaries of texts."""

import hashlib
import math
import re
from collections import Counter

from rasterloom.llm import toxicity


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def terms(text):
    """Counts of the words and of the beginnings of longer ones."""
    found = re.findall(rb"[0-9a-z\x80-\xff]+", lower(text).encode())
    return Counter([("word", w) for w in found] + [(k, w[:k]) for k in toxicity.BEGINNINGS for w in found if len(w) > k])


def likelihood_ratio(a, b, n0, n1):
    def part(x, row, col):
        return x * math.log(x * (n0 + n1) / (row * col)) if x else 0.0

    if b * n0 <= a * n1:
        return 0.0
    return max(0.0, 2 * (part(a, a + b, n0) + part(b, a + b, n1) + part(n0 - a, n0 + n1 - a - b, n0) + part(n1 - b, n0 + n1 - a - b, n1)))


def toxic_scores(texts, labels):
    """{id: (score, the three largest cosines)}; labels {id: 0 or 1} of at most EXAMPLES rows a class."""
    counts = {i: terms(t) for i, t in texts.items()}
    examples = [i for i in labels if i in texts]
    n = [sum(labels[i] == y for i in examples) for y in (0, 1)]
    df = Counter(t for c in counts.values() for t in c)
    seen = [Counter(t for i in examples if labels[i] == y for t in counts[i]) for y in (0, 1)]
    known = set(seen[0]) | set(seen[1])
    unseen = math.log(1 + len(texts)) + 1
    weight = {t: (unseen - math.log(1 + df[t])) * (1 + likelihood_ratio(seen[0][t], seen[1][t], *n)) for t in known}

    def vector(c):
        v = {t: (1 + math.log(k)) * weight.get(t, unseen) for t, k in c.items()}
        size = math.sqrt(sum(x * x for x in v.values())) or 1.0
        return {t: x / size for t, x in v.items()}

    base = sum(labels.values()) / len(labels)
    held = {i: vector(counts[i]) for i in examples if counts[i]}
    mass = {y: sum(v == y for v in labels.values()) / n[y] for y in (0, 1)}
    mean = sum(mass[labels[i]] for i in held) / len(held)
    out = {}
    for i, c in counts.items():
        v = vector(c)
        near = sorted(((round(sum(x * h[t] for t, x in v.items() if t in h), 9), labels[j]) for j, h in held.items()), reverse=True)[: toxicity.NEIGHBOURS]
        near = [(x, y) for x, y in near if x > 0]
        prior = toxicity.PRIOR * mean * max(near[0][0] ** 2 if near else 0.0, 1e-9)
        votes = [(x * x * mass[y], y) for x, y in near]
        out[i] = (sum(x * y for x, y in votes) + prior * base) / (sum(x for x, _ in votes) + prior), [x for x, _ in near[:3]]
    return out


def near_duplicates(texts, k=5):
    """Ids of documents that are not the smallest of their group."""
    sets = {}
    for i, t in texts.items():
        w = lower(t).encode().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i for i in sets if find(i) != i}


def without_repeats(texts, window=13):
    words = {i: (t or "").encode().split() for i, t in texts.items()}
    owner = {}
    for i in sorted(words):
        for j in range(len(words[i]) - window + 1):
            owner.setdefault(tuple(words[i][j : j + window]), i)
    out = {}
    for i, w in words.items():
        gone = {j + d for j in range(len(w) - window + 1) if owner[tuple(w[j : j + window])] < i for d in range(window)}
        out[i] = b" ".join(x for j, x in enumerate(w) if j not in gone).decode() if gone else texts[i]
    return out


def copies(texts, sources, seed=1):
    """How often each document comes."""
    mass = Counter()
    for i, t in texts.items():
        mass[sources[i] or ""] += len(t or "")
    total, roots = sum(mass.values()), sum(math.sqrt(m) for m in mass.values())
    out = {}
    for i in texts:
        m = mass[sources[i] or ""]
        rate = total * (math.sqrt(m) / roots) / m if m else 0.0
        u = int(hashlib.md5(f"{seed}:{i}".encode()).hexdigest()[:13], 16) / 2**52
        p = c = math.exp(-rate)
        out[i], j = 0, 0
        while c <= u and j < 160:
            j += 1
            p = p * rate / j
            c += p
            out[i] += 1
    return out
