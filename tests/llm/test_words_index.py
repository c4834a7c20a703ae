"""Lexical search, spelling variants and licence scan: awkward rows, empty tables, plain versions."""

import math
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sessiograph.llm import license_scan as lic
from sessiograph.llm import spelling as sp
from sessiograph.llm.lexical_search import search
from tests.llm.helpers import LOW, PROSE, edge_docs, edge_rows, empty_docs

ITEM_SCHEMA = "item_id long, text string, doc_id long, rank int, score double"


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def search_plain(docs, items, top):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    n_docs, n_terms = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in items:
        scores = []
        for i, b, n in bags:
            m = 25 + 75 * n * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * b[t] // (1000 * b[t] + 8 * m)) for t in terms(text) if t in b)
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, k + 1, None if none else i, -s) for k, (s, none, i) in enumerate(sorted(scores)[:top])]
    return sorted(out, key=str)


def ranked(rows):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in rows), key=str)


def test_search_awkward_rows(spark):
    items = [(1, "the lazy dog", 1, 1, 1.0), (1, "the lazy dog", 1, 1, 1.0), (2, None, 1, 1, 1.0), (3, "", 1, 1, 1.0), (None, "Ünïcödé äöü ONE one one", 1, 1, 1.0),
             (4, "w5x5 w6x6 tail absent", 1, 1, 1.0), (5, PROSE * 4, 1, 1, 1.0), (6, "repeated row id with two texts line", 1, 1, 1.0)]
    docs = edge_docs(spark)
    for top in (1, 3, 10):
        got = ranked(search(docs, spark.createDataFrame(items, ITEM_SCHEMA), top).collect())
        assert got == search_plain([r[:2] for r in edge_rows()], [x[:2] for x in items], top)


def test_search_empty_tables(spark):
    items = spark.createDataFrame([(1, "one", 1, 1, 1.0)], ITEM_SCHEMA)
    assert search(empty_docs(spark), items).collect() == []
    assert search(edge_docs(spark), items.where("false")).collect() == []


def test_search_long_lists_and_ties(spark):
    """Lists beyond the skip tables, many equal scores, several blocks and groups of items."""
    docs = [(i, " ".join(["common"] * (1 + i % 3) + [f"t{i % 7}", f"u{i % 400}", "filler"] + ["pad"] * (i % 5))) for i in range(3000)]
    items = [(k, f"common t{k % 7} u{k} filler filler", 1, 1, 1.0) for k in range(30)]
    got = ranked(search(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, ITEM_SCHEMA)).collect())
    assert got == search_plain(docs, [x[:2] for x in items], 10)


def spoil(doc, run):
    h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
    return run if h % sp.SPOILED else run[: h % len(run)] + run[h % len(run) + 1 :]


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def spelling_plain(rows):
    n = Counter(w for i, t in rows for run in re.findall(r"[A-Za-zÀ-ÿ]+", (t or "").translate(LOW)) for w in [spoil(i, run)] if len(w) >= 7)
    n = {w: c for w, c in n.items() if c >= 2}
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n)


def test_spelling_awkward_rows(spark):
    base = edge_rows()
    more = [(100 + i, t) for i, t in enumerate(["separate seperate sepárate", "SEPARATE", "separate " * 40, "separat" + " separat" * 3, "aaaaaaaa aaaaaaa aaaaaaaaa " * 2, "mooooooo moooooooo " * 3,
                                                 "straßenbahn strassenbahn Straßenbahn ÀÉÎÕÜÿ× " * 3, "seperates " * 500 + "seperate " * 40 + "sepexate " * 3])]
    docs = edge_docs(spark).unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    got = sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in sp.spelling_variants(docs).collect())
    assert got == spelling_plain([r[:2] for r in base] + more)
    assert any(f and r != f for _, f, r, *_ in got)  # a chain of two forms


def test_spelling_empty_table(spark):
    assert sp.spelling_variants(empty_docs(spark)).collect() == []


def ranks_of(words):
    count = Counter(w[i : i + 2] for w in words for i in range(len(w) - 1))
    return {g: (k, n) for k, (n, g) in enumerate(sorted((n, g) for g, n in count.items()))}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("abcé", min_size=7, max_size=10), min_size=2, max_size=25, unique=True))
def test_pivots_meet_prefixes(words):
    """Every pair one edit apart shares a key of a pivot of one with the prefix of the other; pivots are the cheapest disjoint two."""
    ranks = ranks_of(words)
    parts = {w: sp.prefix_and_pivots(w, ranks) for w in words}
    for w, (_, prefix, chosen) in parts.items():
        cost = {p: ranks[w[p : p + 2]][1] for p in prefix}
        assert len(chosen) == 2 and abs(chosen[0] - chosen[1]) >= 2
        assert sum(cost[p] for p in chosen) == min(cost[p] + cost[q] for p in prefix for q in prefix if q - p >= 2)
    for a in words:
        for b in words:
            if one_edit(a, b) and parts[a][0] <= parts[b][0]:
                assert {k for p in parts[a][2] for k in sp.side_keys(a, p)} & {k for p in parts[b][1] for k in sp.side_keys(b, p)}


def scan_plain(text, weights):
    """The same definition, place by place."""
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
    base = [(i, label) for phrase, label in lic.BASE for i in range(len(ws)) if ws[i : i + len(phrase.split())] == phrase.split()]
    labels, best = {x for _, x in base}, 0.0
    for t in lic.TEMPLATES:
        tw = t.text.split()
        anchors = sorted(sorted(range(len(tw)), key=lambda i: (-weights[tw[i]], i))[: lic.ANCHORS])
        total = sum(weights[w] for w in tw)
        for place in {i - q for i, w in enumerate(ws) for q in anchors if tw[q] == w}:
            def has(word, q):
                return word in ws[max(0, place + q - lic.SHIFT) : max(0, place + q + lic.SHIFT + 1)]

            if sum(has(tw[q], q) for q in anchors) < math.ceil(lic.AGREE * len(anchors)):
                continue
            if not all(any(ws[i : i + len(p.split())] == p.split() for i in range(max(0, place + lic._place(t.text, p) - lic.SHIFT), max(0, place + lic._place(t.text, p) + lic.SHIFT + 1)))
                       for p in t.phrases):
                continue
            score = sum(weights[w] for q, w in enumerate(tw) if has(w, q)) / total
            if score >= lic.LEAST_SCORE:
                labels.add(t.label)
                best = max(best, score)
    starts = [i for i, _ in base]
    return len(ws), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), pytest.approx(min(best, 1.0))


def test_license_scan(spark):
    mit = next(t.text for t in lic.TEMPLATES if t.text.startswith("permission is hereby granted"))
    notice = next(t.text for t in lic.TEMPLATES if t.label == "gpl-notice")
    more = ["Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3.",
            "ALL rights\nreserved.", "Licensed under CC BY-NC 4.0.", PROSE + mit.replace("obtaining", "lawfully obtaining") + " " + PROSE + mit, notice.upper().replace(" ", "\n"),
            "cc", "by", "the license of the fishing club was released under version 2 of its rules", "general public license " * 300, mit[:60], "cc by cc by all rights reserved",
            PROSE * 2000 + "Licensed under CC BY 4.0", notice.replace("gnu general", "gnu very special general"), "license " * 5000 + "released under the mit license"]
    rows = [(500 + i, t) for i, t in enumerate(more)]
    docs = edge_docs(spark).unionByName(spark.createDataFrame(rows, "doc_id long, text string"), allowMissingColumns=True)
    weights = lic.word_weights(docs)
    n = len(edge_rows()) + len(rows)
    every = [r[:2] for r in edge_rows()] + rows
    for word in ("the", "license", "mit"):
        df = sum(word in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW)) for _, t in every)
        assert weights[word] == pytest.approx(math.log((n + 1) / (df + 1)) + 0.01)
    got = lic.license_scan(docs).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in every)
    by_id = {i: t for i, t in every if i is not None and i >= 500 or i in (9, 11, 17)}
    labels = {}
    for r in got:
        if r.doc_id in by_id:
            assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) == scan_plain(by_id[r.doc_id], weights), r.doc_id
            labels[r.doc_id] = r.labels
            assert {p.label for p in r.places} <= set(r.labels.split(","))
    assert [labels[500 + i] for i in range(10)] == ["apache-2.0", "mit", "gpl,gpl-3.0", "reserved", "cc-by,cc-by-nc-4.0", "mit", "gpl,gpl-notice", "", "", ""]
    assert labels[513] == "cc-by,cc-by-4.0" and labels[515] == "mit"
    two = next(r for r in got if r.doc_id == 505)
    assert len(two.places) == 2
    null = [r for r in got if r.doc_id == 3][0]
    assert (null.n_words, null.n_base, null.first_word, null.base_labels, null.labels, null.score) == (0, 0, None, "", "", 0.0)


def test_license_scan_empty_table(spark):
    assert lic.license_scan(empty_docs(spark)).collect() == []
