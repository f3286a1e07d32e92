"""Small tables with every awkward case, and brute-force versions of shared parts."""

from __future__ import annotations

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, node string, key string, _key string, n string, row string, size string, id string"


def docs_frame(spark, rows):
    """(doc_id, text[, lang[, source]]) rows with further columns whose names the operators use inside."""
    full = [(*r, *[None] * (4 - len(r)), None, "x", "y", "z", "w", "v", "u", "t") for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def words(text):
    return (text or "").encode().lower().split()


def shingles(text, width):
    own = words(text)
    if not own:
        return frozenset()
    run = min(width, len(own))
    return frozenset(tuple(own[i : i + run]) for i in range(len(own) - run + 1))


class Union:
    def __init__(self, items):
        self.parent = {x: x for x in items}

    def find(self, x):
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)


def linked_groups(sets, num, den):
    """Smallest member of each item's component under Jaccard >= num / den, over all pairs."""
    union, items = Union(sets), sorted(sets)
    for i, a in enumerate(items):
        for b in items[:i]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and both * den >= (len(sets[a]) + len(sets[b]) - both) * num:
                union.join(a, b)
    return {x: union.find(x) for x in items}


def edited(text, every, offset=0):
    """The text with every n-th word replaced."""
    own = text.split()
    return " ".join(f"new{i}" if i % every == offset else w for i, w in enumerate(own))
