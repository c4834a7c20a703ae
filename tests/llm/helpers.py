"""Small tables with every awkward case, and plain versions of the operators."""

import hashlib
import re
import string
from collections import Counter

LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
PROSE = ("the quick brown fox jumps over the lazy dog while seven wizards quietly juggle boxes of frozen liquor near an old stone bridge "
         "and nobody in the village seems to mind that the river has been rising since early morning because they have seen worse years ")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))


def edge_rows():
    long = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
    rows = [
        (1, PROSE * 3), (2, (PROSE * 3).upper()), (3, None), (4, ""), (5, " \t\n\r\x0b "), (6, "one"), (7, "ONE"), (8, "one two"), (9, long), (10, long + " tail"),
        (11, PROSE * 3 + "almost the same but not quite"), (12, "Ünïcödé ÄÖÜ \x1f   x"), (13, "ünïcödé äöü \x1f   x"), (14, "a" * 450), (15, "ab" * 300),
        (16, "line one is here\nline one is here\nline one is here\n" * 30), (17, "你好 世界 " * 40), (18, "password=9f8e7d6c5b4a39281706 and token = \"1beb58b8af68854f0e01b4ad40cdbb6ae7f578ae\" end"),
        (None, PROSE * 3), (None, "lonely"), (20, "repeated row"), (20, "repeated row"), (21, "id with"), (21, "two texts"), (22, "x y z w v u t s r q p"), (23, "x y z w v u t s r q o"),
    ]
    return [(i, t, "en" if k % 2 else None, f"host{k % 3}" if k % 5 else None, len(t or ""), "extra", k) for k, (i, t) in enumerate(rows)]


#: Extra columns whose names the operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, rid int"


def edge_docs(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def counted(rows):
    return Counter(tuple(r) for r in rows)


def exact_plain(rows):
    groups = {}
    for r in rows:
        groups.setdefault((r[1] or "").translate(LOW), []).append(r[0])
    out = Counter()
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        sha, left = hashlib.sha256(text.encode()).hexdigest(), 1
        for i in sorted(ids, key=lambda i: i != keep):
            out[(i, keep, len(ids), i == keep and left == 1, sha)] += 1
            left -= i == keep
    return out


def shingles(text):
    w = words(text)
    return frozenset(zip(w, w[1:])) if len(w) > 1 else frozenset([tuple(w)] if w else [])


def components_plain(rows):
    """Component (least id) of every row, by comparing all pairs."""
    sets = [shingles(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                parent[top(i)] = top(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[top(i)] = min(r[0], least.get(top(i), r[0]))
    return [least.get(top(i)) for i in range(len(rows))], [len(s) for s in sets]


def repeats_plain(rows, length=200):
    bodies = [(r[1] or "").encode() for r in rows]
    seen = Counter(b[p : p + length] for b in bodies for p in range(len(b) - length + 1))
    out = Counter()
    for r, b in zip(rows, bodies):
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out[(r[0], len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())] += 1
    return out
