"""Plain versions of the operators, for comparison on small tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

BLANK = re.compile(rb"[^\x20\x09-\x0D]+")
UPPER, LOWERED = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"


def lowered(text):
    return (text or "").encode().translate(bytes.maketrans(UPPER, LOWERED))


def words(text, lower=True):
    return BLANK.findall(lowered(text) if lower else (text or "").encode())


def shingles(text, width=5):
    w = words(text)
    if not w:
        return set()
    return {tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))}


def exact(rows):
    groups = defaultdict(list)
    for doc, text in rows:
        groups[lowered(text)].append(doc)
    return sorted((doc, max(g), len(g), doc == max(g), hashlib.sha256(lowered(text)).hexdigest(), min(g))
                  for doc, text in rows for g in [groups[lowered(text)]])


def near(rows):
    """``doc_id, n_shingles, component_id, kept``."""
    sets = [(doc, shingles(text)) for doc, text in rows]
    parent = {doc: doc for doc, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by_shingle = defaultdict(list)
    for i, (_, s) in enumerate(sets):
        for x in s:
            by_shingle[x].append(i)
    for i, (doc, s) in enumerate(sets):
        shared = Counter(j for x in s for j in by_shingle[x] if j < i)
        for j, n in shared.items():
            if 100 * n >= 75 * (len(s) + len(sets[j][1]) - n):
                a, b = root(doc), root(sets[j][0])
                parent[max(a, b)] = min(a, b)
    return sorted((doc, len(s), root(doc), doc == root(doc)) for doc, s in sets)


def repeats(rows, width=35):
    """``doc_id, n_words, n_removed, kept_sha256``."""
    texts = [(doc, words(text, False)) for doc, text in rows]
    seen = Counter(tuple(w[i:i + width]) for _, w in texts for i in range(len(w) - width + 1))
    out = []
    for doc, w in texts:
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i:i + width])] > 1:
                gone[i:i + width] = [True] * width
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((doc, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


ASSIGN = re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?"
                    r"([A-Za-z0-9+/_.=-]+)")


def base_secrets(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    found.sort()
    joined = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in found)
    counts = Counter(k for _, k, _ in found)
    return counts[0], counts[1], counts[2], hashlib.sha256(joined.encode()).hexdigest()


def jump(key, shards):
    """The published loop, over an unsigned 64-bit key."""
    at, to = -1, 0
    while to < shards:
        at = to
        key = (key * 2862933555777941757 + 1) % 2 ** 64
        to = int((at + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return at


def held_out(doc, parts):
    return zlib.crc32(str(doc).encode()) % parts == 1


def contained(rows, items, share=0.75):
    wanted = [(i, shingles(t)) for i, t in items]
    out = []
    for doc, text in rows:
        s = shingles(text)
        out += [(doc, i, len(w), len(w & s)) for i, w in wanted if w and len(w & s) >= share * len(w)]
    return sorted(out)


def base_scores(rows, folds=5):
    """``doc_id: (n_tokens, n_known, train_tokens, base_score)``."""
    import math

    counts = Counter()
    for doc, text in rows:
        if not held_out(doc, folds):
            counts.update(words(text) + [None])
    total, kinds = sum(counts.values()), len(counts)
    out = {}
    for doc, text in rows:
        tokens = words(text) + [None]
        out[doc] = (len(tokens), sum(counts[t] > 0 for t in tokens), total, sum(
            math.log10((counts[t] + 0.5) / (total + 0.5 * (kinds + 1))) for t in tokens))
    return out


class Ppm:
    """Static PPM with method C escapes and full exclusion, symbol by symbol."""

    def __init__(self, texts, order):
        self.order = order
        self.nodes = defaultdict(Counter)
        for text in texts:
            s = [255] * order + list(lowered(text)) + [254]
            for i in range(order, len(s)):
                for k in range(order + 1):
                    self.nodes[tuple(s[i - k:i])][s[i]] += 1

    def probability(self, context, symbol):
        p, excluded = 1.0, set()
        for k in range(self.order, -1, -1):
            node = self.nodes.get(tuple(context[len(context) - k:]))
            if node is None:
                continue
            left = {s: c for s, c in node.items() if s not in excluded}
            total = sum(left.values()) + len(left)
            if symbol in left:
                return p * left[symbol] / total
            if left:
                p *= len(left) / total
            excluded |= set(node)
        return p / max(1, 257 - len(excluded))

    def log10(self, text):
        import math

        s = [255] * self.order + list(lowered(text)) + [254]
        return sum(math.log10(self.probability(s[i - self.order:i], s[i])) for i in range(self.order, len(s)))


def margin(model, bias, text, n_chars):
    """Score of a factorisation machine before the logistic, pair by pair."""
    import numpy as np
    import pyarrow as pa

    from arborlake.llm import quality
    from arborlake.llm.text import Texts
    table = np.frombuffer(model, np.float32).reshape(-1, 1 + quality.FACTORS).astype(float)
    _, place, value = quality.features(Texts(pa.array([text or ""])), np.array([n_chars or 0]))
    terms = table[place] * value.astype(float)[:, None]
    total = bias + terms[:, 0].sum()
    for i in range(len(place)):
        total += (terms[i, 1:] * terms[i + 1:, 1:]).sum()  # with each later feature
    return total
