"""Brute-force versions that the operators are held against."""

from collections import defaultdict


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def brute_repeats(docs, window=13):
    """id -> [(kept words, number of words)] of each row of the id."""
    split = [(i, (t or "").encode().split()) for i, t in docs]
    first = {}
    for i, w in split:
        for a in range(len(w) - window + 1):
            key = tuple(w[a:a + window])
            first[key] = min(first.get(key, i), i)
    out = defaultdict(list)
    for i, w in split:
        gone = [False] * len(w)
        for a in range(len(w) - window + 1):
            if first[tuple(w[a:a + window])] < i:
                gone[a:a + window] = [True] * window
        out[i].append(([x for x, g in zip(w, gone, strict=True) if not g], len(w)))
    return out


def brute_components(docs, size=5, percent=75):
    """(id -> component of each row of the id, id -> set size of each)."""
    sets = []
    for _, t in docs:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[a:a + size]) for a in range(max(1, len(w) - size + 1))} if w else set())
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            holders[g].append(i)
    for i, s in enumerate(sets):
        near = {j for g in s for j in holders[g] if j < i}
        for j in near:
            n = len(s & sets[j])
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[find(i)] = min(least.get(find(i), d), d)
    components, sizes = defaultdict(list), defaultdict(list)
    for i, (d, _) in enumerate(docs):
        components[d].append(least[find(i)])
        sizes[d].append(len(sets[i]))
    return components, sizes
