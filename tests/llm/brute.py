"""Plain re-statements of the operators' definitions, for small fixtures."""

import re


def words2(text):
    low = re.sub(r"[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low.encode())


def contamination(docs, items, length=10):
    """{row number: (n_words, hit word places, items)}"""
    wins = {}
    for name, text in items:
        w = words2(text)
        for i in range(max(1, len(w) - length + 1) if w else 0):
            wins.setdefault(tuple(w[i:i + length]), set()).add("" if name is None else str(name))
    sizes = {len(x) for x in wins}
    out = []
    for text in docs:
        w, hit, got = words2(text), set(), set()
        for k in sizes:
            for i in range(len(w) - k + 1):
                if (t := tuple(w[i:i + k])) in wins:
                    hit |= set(range(i, i + k))
                    got |= wins[t]
        out.append((len(w), hit, sorted(got)))
    return out


def removed_bytes(docs, size=50):
    """docs: [(doc_id, text)] -> [mask of removed bytes] by the smaller-document rule."""
    first = {}
    data = [(d, (t or "").encode()) for d, t in docs]
    for d, b in data:
        for i in range(len(b) - size + 1):
            s = b[i:i + size]
            first[s] = min(first.get(s, d), d)
    out = []
    for d, b in data:
        mask = [False] * len(b)
        for i in range(len(b) - size + 1):
            if first[b[i:i + size]] < d:
                mask[i:i + size] = [True] * size
        out.append(mask)
    return out


def split8(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


def removed_words(docs, size=35):
    """docs: [text] -> [mask of removed words]: windows that start anywhere else too."""
    count = {}
    data = [split8(t) for t in docs]
    for w in data:
        for i in range(len(w) - size + 1):
            count[tuple(w[i:i + size])] = count.get(tuple(w[i:i + size]), 0) + 1
    out = []
    for w in data:
        mask = [False] * len(w)
        for i in range(len(w) - size + 1):
            if count[tuple(w[i:i + size])] > 1:
                mask[i:i + size] = [True] * size
        out.append(mask)
    return out


def shingles(text, n=4):
    low = re.sub(r"[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(rb"[^\x20\x09-\x0D]+", low.encode())
    if not w:
        return set()
    return {tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))}


def components(docs, n=4, percent=80):
    """docs: [(doc_id, text)] -> {doc_id: (n_shingles, component)}"""
    sets = {d: shingles(t, n) for d, t in docs}
    parent = {d: d for d, _ in docs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {d: (len(sets[d]), root(d)) for d in ids}
