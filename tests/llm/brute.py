"""Plain Python versions of the text operators, for small tables."""

import collections
import hashlib
import math
import re
import zlib

LOWER = {i: i + 32 for i in range(65, 91)}
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def repeated_bytes(texts):
    """(n_bytes, n_removed, n_spans, kept_sha256) of each text."""
    raw = [(t or "").encode() for t in texts]
    seen = collections.Counter(x[i : i + 200] for x in raw for i in range(len(x) - 199))
    out = []
    for x in raw:
        gone = [False] * len(x)
        for i in range(len(x) - 199):
            if seen[x[i : i + 200]] > 1:
                gone[i : i + 200] = [True] * 200
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(c for c, g in zip(x, gone, strict=True) if not g)
        out.append((len(x), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def repeated_words(rows, window=50):
    """{row number: (n_words, n_removed, kept_sha256)} of rows (id, text); a null id is the largest."""
    key = lambda i: float("inf") if i is None else i
    words = [SPACED.findall(t or "") for _, t in rows]
    least = {}
    for (i, _), w in zip(rows, words, strict=True):
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            least[k] = min(least.get(k, float("inf")), key(i))
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = set()
        for s in range(len(w) - window + 1):
            if least[tuple(w[s : s + window])] < key(i):
                gone |= set(range(s, s + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def shingles(text):
    w = SPACED.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near_groups(rows, percent=85):
    """(n_shingles, component_id) of rows (id, text); a null id is the largest and a null component."""
    big = 1 << 62
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                parent[find(a)] = find(b)
    best = {}
    for k, (i, _) in enumerate(rows):
        best[find(k)] = min(best.get(find(k), big), big if i is None else i)
    return [(len(s), None if best[find(k)] == big else best[find(k)]) for k, s in enumerate(sets)]


def contamination(texts, items):
    """(n_words, n_hit, n_items, items_sha256) of each text; items: (id, text)."""
    words = lambda t: ALNUM.findall((t or "").translate(LOWER))
    windows = []
    for i, t in items:
        w = words(t)
        n = min(len(w), 10)
        windows += [(i, tuple(w[s : s + n])) for s in range(len(w) - n + 1) if n]
    out = []
    for t in texts:
        w, hit, found = words(t), set(), set()
        for i, k in windows:
            for s in range(len(w) - len(k) + 1):
                if tuple(w[s : s + len(k)]) == k:
                    hit |= set(range(s, s + len(k)))
                    found |= {str(i)} if i is not None else set()
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()))
    return out


LETTERS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def divergence(rows, least=30, top=50):
    """(lang, source, part, item, value, rank) of rows (lang, source, text)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    counts, docs = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, source, text in rows:
        terms = LETTERS.findall(text.translate(LOWER))
        counts[lang, source].update(terms)
        docs.update((lang, t) for t in set(terms))
    out = []
    for lang in {k[0] for k in counts}:
        kept = [t for l, t in docs if l == lang and docs[l, t] >= least]
        groups = {s: {t: c[t] for t in kept} for (l, s), c in counts.items() if l == lang}
        share = lambda c, n: 1 + 1_000_000_000 * (c + 5) // (n + 5 * len(kept))  # noqa: B023, E731
        shares = {s: {t: share(c[t], sum(c.values())) for t in kept} for s, c in groups.items()}
        whole = {t: sum(c[t] for c in groups.values()) for t in kept}
        q = {t: share(whole[t], sum(whole.values())) for t in kept}
        for s, p in shares.items():
            pairs = [(o, sum(abs(p[t] - shares[o][t]) for t in kept)) for o in shares if o != s]
            terms = [(t, p[t] - q[t]) for t in kept if groups[s][t] and p[t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, k + 1) for k, (i, v) in enumerate(found[:most])]
    return out


def importance(rows, target, runs=1, buckets=10_000, percent=10, least=20):
    """(doc_id, n_features, weight, score, rank) of rows (id, text)."""

    def features(text):
        w = ALNUM.findall((text or "").translate(LOWER))
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, runs + 1) for i in range(len(w) - n + 1)], len(w)

    found = [features(t) for _, t in rows]
    s, t = collections.Counter(b for f, _ in found for b in f), collections.Counter(b for x in target for b in features(x)[0])
    total, wanted = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * total / ((s[b] + 1) * wanted))) for b in s}
    out = []
    for (i, _), (f, n) in zip(rows, found, strict=True):
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    order = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is not None, r[0]))
    rank = {id(r): k + 1 for k, r in enumerate(order[: len(order) * percent // 100])}
    return [(*r[:4], rank.get(id(r))) for r in out]
