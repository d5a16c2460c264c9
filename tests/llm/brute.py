"""Plain versions of what the operators compute, for small tables."""

from collections import defaultdict


def words(text):
    return (text or "").encode().lower().split()


def shingle_set(text, size=5):
    w = words(text)
    return frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset()


def components(texts, threshold=75):
    """doc_id -> (set size, least doc_id reachable) for a dict of texts."""
    sets = {i: shingle_set(t) for i, t in texts.items()}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                n = len(sets[a] & sets[b])
                if 100 * n >= threshold * (len(sets[a]) + len(sets[b]) - n):
                    x, y = sorted((root(a), root(b)))
                    up[y] = x
    return {i: (len(s), root(i)) for i, s in sets.items()}


def kept_bytes(texts, length=50):
    """doc_id -> (bytes, covered flags) where a string of `length` bytes also starts in a smaller doc_id."""
    data = {i: (t or "").encode() for i, t in texts.items()}
    first = defaultdict(lambda: None)
    for i in sorted(data):
        for k in range(len(data[i]) - length + 1):
            w = data[i][k : k + length]
            first[w] = i if first[w] is None else min(first[w], i)
    out = {}
    for i, b in data.items():
        covered = [False] * len(b)
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < i:
                covered[k : k + length] = [True] * length
        out[i] = b, covered
    return out
