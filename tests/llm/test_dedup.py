"""Exact, near and substring duplicates against plain versions, edge cases included."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from sessiograph.llm import minhash_dedup
from sessiograph.llm.components import connected
from sessiograph.llm.exact_dedup import exact_duplicates, golomb_decode, golomb_encode, without_exact_duplicates
from sessiograph.llm.minhash_dedup import near_duplicates, shingle_sets, without_near_duplicates
from sessiograph.llm.suffix_dedup import repeated_spans
from sessiograph.llm.suffix_doubling import doubled_spans, repeated_positions

from .helpers import PROSE, SCHEMA, components_plain, counted, edge_docs, edge_rows, empty_docs, exact_plain, repeats_plain, shingles, words


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=300))
def test_golomb_round_trip(values):
    x = np.array(sorted(values), np.uint64)
    assert (golomb_decode(golomb_encode(x)) == x).all()


def test_golomb_is_compressed():
    x = np.unique(np.random.default_rng(1).integers(0, 2**63, 10_000).astype(np.uint64))
    assert len(golomb_encode(x)) < 0.9 * 8 * len(x)


def test_exact_edges(spark):
    assert counted(exact_duplicates(edge_docs(spark)).collect()) == exact_plain(edge_rows())


def test_exact_many_blocks_and_a_hot_text(spark):
    rows = [(i, "hot text" if i % 3 == 0 else f"text {i % 97} {i % 2}") for i in range(900)]
    got = exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(7))
    assert counted(got.collect()) == exact_plain(rows)


def test_exact_rows_that_stay(spark):
    got = without_exact_duplicates(edge_docs(spark))
    assert got.columns == edge_docs(spark).columns
    kept = [(r.doc_id, r.text) for r in got.collect()]
    assert len(kept) == len(set((t or "").lower().encode() for _, t in kept)) + 1  # "Ü" and "ü" differ: only A-Z are folded
    assert (2, (PROSE * 3).upper()) in kept and (1, PROSE * 3) not in kept and kept.count((20, "repeated row")) == 1


@pytest.mark.parametrize("op", [exact_duplicates, near_duplicates, repeated_spans, doubled_spans, without_exact_duplicates, without_near_duplicates])
def test_empty_table(spark, op):
    assert op(empty_docs(spark)).collect() == []


def _near(spark, rows, schema="doc_id long, text string"):
    got = near_duplicates(spark.createDataFrame(rows, schema))
    comp, size = components_plain(rows)
    assert counted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == counted(zip([r[0] for r in rows], size, comp))
    return got


def test_near_edges(spark):
    got = _near(spark, edge_rows(), SCHEMA).collect()
    without = [r for r in got if r.n_shingles]
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)
    kept = [r for r in without if r.stays]
    # one kept row in a component; the null id's lonely text has a component without an id, id 21 stands in two
    assert len(kept) == len({r.component_id for r in without}) + 1 and sum(r.component_id == 21 for r in kept) == 2
    assert all(r.kept and r.stays for r in got if not r.n_shingles)


def test_near_repeated_ids(spark):
    got = near_duplicates(spark.createDataFrame([(5, PROSE), (5, PROSE), (7, PROSE)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(5, 5, True), (5, 5, True), (7, 5, False)] and sum(r.stays for r in got) == 1


def test_near_families_share_components(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "SHORT", 2)  # every family is a long list: leaders, then blocks
    rng = random.Random(5)
    vocabulary = [f"v{i}" for i in range(400)]
    rows = []
    for family in range(6):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([12, 30, 150, 400]))]
        for _ in range(25):
            text = [rng.choice(vocabulary) if rng.random() < 0.07 else w for w in base]
            rows.append((len(rows), " ".join(text)))
    passage = [rng.choice(vocabulary) for _ in range(40)]
    rows += [(1000 + i, " ".join(passage + [rng.choice(vocabulary) for _ in range(60)])) for i in range(40)]  # shared, not similar
    _near(spark, rows)


def test_near_small_sets_at_the_threshold(spark):
    rows, rng = [], random.Random(2)
    for n in range(2, 24):
        base = [f"s{n}w{i}" for i in range(n + 1)]
        rows.append((len(rows), " ".join(base)))
        for _ in range(4):
            rows.append((len(rows), " ".join([*base, *(f"t{rng.random()}" for _ in range(rng.randint(1, 1 + n // 4)))])))
    _near(spark, rows)


def test_near_rows_that_stay(spark):
    got = without_near_duplicates(edge_docs(spark))
    kept = [(r.doc_id, r.text) for r in got.collect()]
    assert got.columns == edge_docs(spark).columns
    assert (1, PROSE * 3) in kept and 2 not in [i for i, _ in kept] and 11 not in [i for i, _ in kept]
    assert sum(i == 20 for i, _ in kept) == 1 and sum(i == 21 for i, _ in kept) == 2
    assert {i for i, t in kept if not (t or "").split()} == {3, 4, 5}


def test_shingle_sets_match_words():
    texts = ["a b c a b", "one", "", "x  y\tz", "é è é è"]
    assert [len(s) for s in shingle_sets([t.encode() for t in texts])] == [len(shingles(t)) for t in texts]


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 6), (20, 21), *((100, 100 + i) for i in range(1, 50)), *((200 + i, 201 + i) for i in range(30))]
    got = {r.node: r.comp for r in connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got[3] == got[2] == got[1] == 1 and got[9] == got[6] == 6 and got[149] == 100 and got[230] == got[200] == 200 and got[21] == 20
    assert len(got) == 3 + 4 + 2 + 50 + 31
    assert connected(spark.createDataFrame([], "a long, b long")).collect() == []


@pytest.mark.parametrize("op", [repeated_spans, doubled_spans])
def test_repeats_edges(spark, op):
    rows = [r for r in edge_rows() if r[0] not in (9, 10)] + [(9, " ".join(f"w{i}" for i in range(900)), None, None, 0, "", 0), (10, " ".join(f"w{i}" for i in range(700)) + " tail", None, None, 0, "", 0)]
    got = op(spark.createDataFrame(rows, SCHEMA))
    assert counted(got.collect()) == repeats_plain(rows)


@pytest.mark.parametrize("op", [repeated_spans, doubled_spans])
def test_repeats_random_passages(spark, op):
    rng = random.Random(3)
    letters = "abcdefgh "
    passages = ["".join(rng.choice(letters) for _ in range(rng.randint(150, 420))) for _ in range(12)]
    rows = []
    for i in range(60):
        parts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 260)))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            at = rng.randint(0, len(p) // 3)
            parts += [p[at:], "".join(rng.choice(letters) for _ in range(rng.randint(0, 90)))]
        rows.append((i, "".join(parts)))
    rows += [(100, "z" * 199), (101, "z" * 200), (102, "y" * 201), (103, "é" * 130), (104, "xyz" * 70)]
    got = op(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert counted(got.collect()) == repeats_plain(rows)


def _thue_morse(n, letters="ab"):
    return "".join(letters[bin(i).count("1") % 2] for i in range(n))


@pytest.mark.parametrize("op", [repeated_spans, doubled_spans])
def test_repeats_of_regular_strings(spark, op):
    rows = [(1, " " * 5000), (2, "ab " * 1500), (3, _thue_morse(3000)), (4, _thue_morse(1024, "cd") + _thue_morse(1024, "dc")), (5, "q" + "ab " * 70)]
    assert counted(op(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == repeats_plain(rows)


@pytest.mark.parametrize("op", [repeated_spans, exact_duplicates, near_duplicates])
def test_one_id_in_a_third_of_the_rows(spark, op):
    rng = random.Random(9)
    texts = [" ".join(f"h{rng.randrange(300)}" for _ in range(60)) for _ in range(40)]
    rows = [(None, texts[i % 20]) for i in range(60)] + [(None, "short")] * 5 + [(i, texts[i % 40]) for i in range(100)]
    got = counted(op(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect())
    if op is near_duplicates:
        comp, size = components_plain(rows)
        assert counted((r[0], r[1], r[2]) for r in got.elements()) == counted(zip([r[0] for r in rows], size, comp))
    else:
        assert got == (repeats_plain if op is repeated_spans else exact_plain)(rows)


def test_ranks_follow_byte_order(spark):
    rng = random.Random(11)
    bodies = [(i, bytes(rng.choice(b"ab\x00\xff") for _ in range(400))) for i in range(4)] + [(9, b"abababababababab"), (10, b""), (11, None), (12, b"short")]
    places = {(r, p): b[p : p + 12] for r, b in bodies for p in range(len(b or b"") - 11)}
    seen = counted([x] for x in places.values())
    want = {k: x for k, x in places.items() if seen[(x,)] > 1}
    got = {(r.rid, r.pos): r.rank for r in repeated_positions(spark.createDataFrame(bodies, "rid long, body binary"), 12).collect()}
    assert set(got) == set(want) and want
    by_rank = sorted(got, key=lambda k: (got[k], k))
    assert by_rank == sorted(want, key=lambda k: (want[k], k))
    with pytest.raises(ValueError):
        repeated_positions(spark.createDataFrame(bodies, "rid long, body binary"), 4)


def test_long_regular_words_differ():
    words = [_thue_morse(4096).encode(), _thue_morse(4096, "ba").encode(), b"x" * 256, b"x" * 257]
    found = [shingle_sets([w]) for w in words]
    assert len({int(s[0][0]) for s in found}) == 4
    assert int(shingle_sets([b"one " + words[0], words[0]])[1][0]) == int(found[0][0][0])


def test_repeats_long_text_in_segments(spark, monkeypatch):
    from sessiograph.llm import suffix_dedup

    rng = random.Random(4)
    long = "".join(rng.choice("abcdefghijklmnop") for _ in range(suffix_dedup.SEGMENT + 3000))
    border = long[suffix_dedup.SEGMENT - 150 : suffix_dedup.SEGMENT + 250]
    got = {r.doc_id: r for r in repeated_spans(spark.createDataFrame([(1, long), (2, "x" * 50 + border + "y" * 50)], "doc_id long, text string")).collect()}
    assert (got[1].n_removed, got[1].n_spans, got[2].n_removed, got[2].n_spans) == (400, 1, 400, 1)


def _stage_plain(rows, width=5):
    """Ids that stay: the least of every component of similarity 0.8 on runs of ``width`` words, by comparing all pairs."""
    sets = []
    for _, text in rows:
        w = words(text)
        sets.append(frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset())
    comp = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]) and comp[i] != comp[j]:
                comp = [comp[j] if c == comp[i] else c for c in comp]
    return sorted(min(r[0] for r, c in zip(rows, comp) if c == k) for k in set(comp))


def test_near_stage_compares_runs_of_five_words(spark):
    rng = random.Random(7)
    base = [f"v{rng.randrange(5000)}" for _ in range(300)]
    sparse = [f"n{i}" if i % 20 == 10 else w for i, w in enumerate(base)]  # 15 words changed: similar in pairs, not in runs of five
    near = base[:150] + ["other"] + base[151:]
    pool = [rng.choice("abcdefgh") for _ in range(3000)]  # a small vocabulary: nearly all pairs in every text
    texts = [base, sparse, near, pool[:1500], pool[1500:], ["one", "two", "three"], ["one", "two", "three"], ["one", "two", "four"], ["one"], []]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(r.doc_id for r in got.collect()) == _stage_plain(rows) == [0, 1, 3, 4, 5, 7, 8, 9]
    assert _stage_plain(rows, 2) != _stage_plain(rows)


def test_shingle_sets_of_five_words_match_words():
    texts = ["a b c a b c a b c", "a b c d e", "a b c d", "one", "", "x  y\tz"]
    assert [len(s) for s in shingle_sets([t.encode() for t in texts], 5)] == [3, 1, 1, 1, 0, 1]
