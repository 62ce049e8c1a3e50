"""Plain-Python versions of what the operators define, and small tables with the awkward cases."""

import collections
import itertools
import re
import string

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def shingles(text, k):
    w = words(text)
    return frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset()


def near_components(texts, k, percent):
    """Smallest id reachable, by comparing every two sets that share a shingle."""
    sets = {i: shingles(t, k) for i, t in texts.items()}
    owners = collections.defaultdict(list)
    for i, s in sets.items():
        for x in s:
            owners[x].append(i)
    shared = collections.Counter()
    for ids in owners.values():
        shared.update(itertools.combinations(sorted(ids), 2))
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}, {i: len(s) for i, s in sets.items()}


def prose(seed, n):
    """``n`` words of a made-up language, the same for the same seed."""
    import random

    r = random.Random(seed)
    return " ".join("".join(r.choice("aeiou") + r.choice("bdfglmnrst") for _ in range(r.randint(1, 3))) for _ in range(n))


def docs(spark, rows, extra=False):
    """(doc_id, text, source) as ``documents``; ``extra`` adds columns whose names the operators use inside."""
    full = [(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows]
    df = spark.createDataFrame(full, DOCS)
    if extra:
        from pyspark.sql import functions as F

        for name in ("row", "key", "node", "digest", "size", "start", "pass", "words", "nth", "ident", "n", "block", "kept", "label", "line", "at", "_drop", "id"):
            df = df.withColumn(name, F.lit("x"))
    return df


AWKWARD = [
    (1, None, "a"), (2, "", None), (3, " \t\n ", "a"), (4, "one", "b"), (4, "one", "b"), (5, "one", None), (None, "one", "b"), (6, "x " * 30000, "a"),
    (7, prose(1, 300), "b"), (8, prose(1, 300) + " more", "a"), (9, prose(2, 80), ""), (10, "A b  c", "\U0001f600"), (11, "<|endoftext|> end", "z"),
]
