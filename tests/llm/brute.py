"""Plain Python versions of the operators, for small inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BLANKS = " \t\n\x0b\x0c\r"


def ws_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def grams(words, n):
    return [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]


def shingles(text, n):
    w = ws_words((text or "").translate(LOWER))
    return set(grams(w, n)) if len(w) >= n else ({tuple(w)} if w else set())


def closure(ids, links):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def jaccard_components(docs, n, num, den):
    sets = {i: shingles(t, n) for i, t in docs}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    return {i: (len(sets[i]), c) for i, c in closure(ids, links).items()}


def line_dedup(docs, min_chars=10):
    key = lambda x: x.strip(BLANKS).translate(LOWER)
    held = defaultdict(set)
    for i, t in docs:
        for x in (t or "").split("\n"):
            if len(key(x)) >= min_chars:
                held[key(x)].add(i)
    keep = {k: min(v) for k, v in held.items() if len(v) > 1}
    out = {}
    for i, t in docs:
        lines = (t or "").split("\n")
        out[i] = (len(lines), [x for x in lines if keep.get(key(x), i) == i])
    return out


def contained(docs, items, n=5, threshold=0.8):
    out = {}
    for d, t in docs:
        w = plain_words((t or "").lower())
        have = {k: set(grams(w, k)) for k in range(1, n + 1)}
        for i, s in items:
            v = plain_words((s or "").lower())
            want = set(grams(v, min(n, len(v)))) if v else set()
            if want and len(want & have[min(n, len(v))]) / len(want) >= threshold - 1e-9:
                out[d, i] = (len(want), len(want & have[min(n, len(v))]))
    return out


def repeated(docs, m):
    """Covered words of each document: windows of m words that another document has."""
    words = {i: ws_words((t or "").translate(LOWER)) for i, t in docs}
    where = defaultdict(set)
    for i, w in words.items():
        for g in grams(w, m):
            where[g].add(i)
    out = {}
    for i, w in words.items():
        cover = {k for p, g in enumerate(grams(w, m)) if len(where[g]) > 1 for k in range(p, p + m)}
        if cover:
            out[i] = cover
    return out


def backoff(docs, order, alpha=0.4, min_count=2):
    words = {i: ws_words((t or "").translate(LOWER)) for i, t in docs}
    counts = Counter(g for w in words.values() for n in range(1, order + 1) for g in grams(w, n))
    total = sum(map(len, words.values()))
    out = {}
    for i, w in words.items():
        s, skipped = 0.0, 0
        for p in range(len(w)):
            best = min(order, p + 1)
            for n in range(best, 0, -1):
                g = tuple(w[p - n + 1 : p + 1])
                if n == 1:
                    s += math.log(counts[g] / total) + (best - 1) * math.log(alpha)
                    skipped += best > 1
                elif counts[g] >= min_count:
                    s += math.log(counts[g] / counts[g[:-1]]) + (best - n) * math.log(alpha)
                    skipped += n < best
                    break
        out[i] = (len(w), skipped, s)
    return out


def pieces(text, tokenizer, capacity, end_id):
    import numpy as np

    ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [end_id], "<u4")
    return [(k // capacity, k, len(p), zlib.crc32(p.tobytes())) for k in range(0, len(ids), capacity) for p in [ids[k : k + capacity]]]


def quality(docs, common, classes, char_limit=0.25, word_limit=0.14, word_noise=1.75):
    """docs (id, text, lang) -> (n_words, base_failed, kept)."""
    facts, by = {}, defaultdict(lambda: [Counter(), Counter(), 0, 0])
    for i, t, lang in docs:
        t = t or ""
        w = ws_words(t)
        c = Counter({k: len(re.sub(p, "", t)) for k, p in classes.items()})
        c["other"] = len(t) - sum(c.values())
        h = Counter(x.lower() for x in w if x.lower() in common)
        facts[i] = (t, w, c, h, lang)
        for ref in {lang, None}:
            by[ref][0].update(c)
            by[ref][1].update(h)
            by[ref][2] += len(t)
            by[ref][3] += len(w)

    def js(p, q):
        return math.sqrt(min(1, max(0, sum((x * math.log2(2 * x / (x + y)) if x > 0 else 0) + (y * math.log2(2 * y / (x + y)) if y > 0 else 0) for x, y in zip(p, q, strict=True)) / 2)))

    out = {}
    for i, (t, w, c, h, lang) in facts.items():
        rc, rh, n_chars, n_words = by[lang]
        n = len(w)
        char = js([c[k] / max(len(t), 1) for k in rc], [rc[k] / n_chars for k in rc])
        p, q = [h[k] / max(n, 1) for k in rh], [rh[k] / n_words for k in rh]
        word = js([*p, 1 - sum(p)], [*q, 1 - sum(q)])
        g = grams(w, 3)
        times = Counter(g)
        repeats = len({k for a, x in enumerate(g) if times[x] > 1 for k in range(a, a + 3)})
        failed = n < 50 or 100 * repeats > 50 * n
        out[i] = (n, failed, not failed and (len(t) < 200 or char <= char_limit) and (n < 50 or word <= word_limit + word_noise / math.sqrt(n)))
    return out


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()
