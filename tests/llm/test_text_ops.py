"""Packing, codec, quality rules, language, language model, secrets, chat and the pipeline."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from sessiograph.llm import quality_rules as quality_ops
from sessiograph.llm import secret_scan
from sessiograph.llm.chat_format import chat_format
from sessiograph.llm.language_id import language_of
from sessiograph.llm.lm_scoring import lm_scores
from sessiograph.llm.packing import best_fit_decreasing, pack, sequences, word_encoder
from sessiograph.llm.quality_rules import passing, quality
from sessiograph.llm.queries import QUERIES, SQL, tokenizer_path
from sessiograph.llm.secret_scan import redacted, secrets
from sessiograph.llm.sentencepiece_codec import Codec, decode, encode

from .helpers import PROSE, SCHEMA, edge_docs, edge_rows, empty_docs, words

DATA = "/root/testdata/sf0.001"
BPE, PIECES = tokenizer_path("word_bpe_49k.json"), tokenizer_path("piece_bpe_32k.model")


# packing
@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=120))
def test_best_fit_matches_a_plain_search(lengths):
    place, offset = best_fit_decreasing(np.array(lengths, np.int64), 64)
    room, used = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fit = [r for r in room if r >= lengths[i]]
        used[i] = min(fit) if fit else 64
        if fit:
            room.remove(min(fit))
        room.append(used[i] - lengths[i])
        assert offset[i] == 64 - used[i]
    assert len(set(place.tolist())) == len(room)


def test_word_encoder_equals_the_library():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(BPE)
    texts = ["", "Don't <|endoftext|> stop", "İstanbul ſ 你好", "it's 12½ $$'s --x", "a\xa0b\x85c", PROSE, "Ärger über Öl", "é combining", "tabs\tand\nlines\r\n"]
    want = [np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert word_encoder(BPE, "NFC+Replace+Lowercase")(texts) == want
    assert word_encoder(BPE, "unknown layout")(texts) == want


def test_pack_edges(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(BPE)
    got = pack(edge_docs(spark), BPE, window=512, with_ids=True)
    rows = got.collect()
    want = Counter((r[0], tuple(tok.encode(r[1] or "", add_special_tokens=False).ids) + (2,)) for r in edge_rows())
    for r in rows:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length <= 4 * 512 and r.start % 512 == 0
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 512
    # pieces of an id that stands once join to its ids
    once = {i for i, n in Counter(r[0] for r in edge_rows()).items() if n == 1 and i is not None}
    for i in once:
        ids = b"".join(r.ids for r in sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start))
        assert want[(i, tuple(np.frombuffer(ids, "<u4").tolist()))] == 1
    assert sum(r.length for r in rows) == sum(len(ids) * n for (_, ids), n in want.items())
    padded = sequences(got, 512).collect()
    assert all(len(r.input_ids) == 512 for r in padded) and sum(r.n_tokens for r in padded) == sum(r.length for r in rows)


def test_pack_pads_little(spark):
    rng = random.Random(1)
    docs = spark.createDataFrame([(i, "word " * rng.randint(1, 300)) for i in range(1500)], "doc_id long, text string")
    rows = pack(docs, BPE, window=1024).collect()
    assert len({r.sequence_id for r in rows}) <= math.ceil(1.01 * sum(r.length for r in rows) / 1024)


# sentencepiece
def test_codec_equals_the_library():
    import sentencepiece

    sp, codec = sentencepiece.SentencePieceProcessor(model_file=PIECES), Codec(PIECES)
    rng = random.Random(7)
    texts = ["", " ", "a", "  two  spaces ", " " * 37, "def f(x):\n        return 1", "你好 é̂ 😀", "<s> </s> <unk>", "x" * 300, "\x00\t\n"]
    texts += ["".join(rng.choice(["the", "ing", "tion", " ", "un", "re", "  ", "ex", "ß", "12", "\n", "q"]) for _ in range(rng.randint(1, 50))) for _ in range(400)]
    assert codec.encode(texts) == [sp.encode(t) for t in texts]
    assert [codec.decode(i) for i in codec.encode(texts)] == texts


def test_codec_scores_of_a_unigram_model():
    codec = Codec(PIECES)
    codec.merges, codec.scores = False, {i: -1.0 for i in codec.pieces.values()}
    codec.learn(["▁international"])
    fewest = {0: 0}
    word = "▁international"
    for end in range(1, len(word) + 1):
        fewest[end] = min(fewest[b] + 1 for b in range(end) if word[b:end] in codec.pieces)
    assert len(codec.words[word]) == fewest[len(word)]


def test_codec_edges(spark):
    rows = encode(edge_docs(spark), PIECES).collect()
    assert len(rows) == len(edge_rows()) and all(r.round_trip for r in rows) and all(r.n_tokens == len(r.ids) for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (3, 4)} == {0}
    back = decode(encode(edge_docs(spark), PIECES), PIECES)
    assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter((r[0], r[1] or "") for r in edge_rows())
    marked = encode(spark.createDataFrame([(1, "a▁b")], "doc_id long, text string"), PIECES).first()
    assert not marked.round_trip


# quality rules
def counts_plain(text):
    w = [x for x in __import__("re").findall(r"[^\x20\x09-\x0D]+", text or "")]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_edges(spark):
    got = quality(edge_docs(spark)).collect()
    have = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got)
    want = Counter()
    for r in edge_rows():
        n, chars, symbols, dup, rep = counts_plain(r[1])
        want[(r[0], n, chars, symbols, dup, rep, n < 50 or 100 * rep > 50 * n)] += 1
    assert have == want
    assert all(not r.kept for r in got if r.base_failed)


def test_quality_is_native(spark):
    plan = quality(edge_docs(spark))._jdf.queryExecution().toString() + secrets(edge_docs(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def _text(i, words_=60):
    rng = random.Random(i)
    return " ".join(f"{rng.choice('abcdefg')}{rng.choice('mnop')}{rng.randint(0, 999)}" for _ in range(words_))


def test_quality_host_verdicts(spark):
    junk = [(i, " ".join(w + "###" for w in _text(i).split()), "junk") for i in range(30)]
    clean = [(100 + i, _text(100 + i), f"good{i % 10}") for i in range(30)] + [(200, _text(200), "junk"), (201, " ".join(w + "###" for w in _text(201).split()), "good1"), (202, junk[0][1], "tiny")]
    rows = quality(spark.createDataFrame(junk + clean, "doc_id long, text string, source string")).collect()
    kept = {r.doc_id for r in rows if r.kept}
    assert kept == set(range(100, 130)) | {200, 201, 202}  # clean rows of a bad host stay; one failure does not sink a host
    stays = passing(spark.createDataFrame(junk + clean, "doc_id long, text string, source string"))
    assert {r.doc_id for r in stays.collect()} == kept


def test_quality_many_bad_hosts_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(quality_ops, "SMALL_HOSTS", 0)
    rows = [(i, " ".join(w + "###" for w in _text(i).split()), "junk") for i in range(12)] + [(100 + i, _text(100 + i), "good") for i in range(12)] + [(300, _text(300), None)]
    assert {r.doc_id for r in passing(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()} == {*range(100, 112), 300}


def test_passing_keeps_rows_as_they_are(spark):
    got = passing(edge_docs(spark))
    assert got.columns == edge_docs(spark).columns
    want = Counter(r for r in edge_rows() if not (counts_plain(r[1])[0] < 50 or 100 * counts_plain(r[1])[4] > 50 * counts_plain(r[1])[0]))
    assert Counter(tuple(r) for r in got.collect()) == want


# language
def test_language_edges_and_accuracy(spark):
    rng = random.Random(3)
    texts = {"aa": ["kalo", "mira", "tavo", "lumi"], "bb": ["schrunt", "grolz", "pfeck", "strumm"], "cc": ["ning", "thoo", "wayf", "oughl"]}
    rows = [(i, " ".join(rng.choice(texts[lang]) for _ in range(rng.randint(3, 60))), lang) for i, lang in enumerate(list(texts) * 80)]
    rows += [(1000, None, "aa"), (1001, "", "bb"), (1002, "123 !!! 456", "cc"), (None, "kalo mira kalo tavo", None), (1003, "grolz " * 20_000, None), (1004, "ÄÖ 你好", None)]
    got = {r.doc_id: r for r in language_of(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    held = [r for r in rows if r[0] is not None and r[0] < 1000 and got[r[0]].held_out]
    assert {r[0] for r in held} == {r[0] for r in rows if r[0] is not None and r[0] < 1000 and zlib.crc32(str(r[0]).encode()) % 3 == 1}
    assert sum(got[r[0]].lang_pred == r[2] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())
    assert [got[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and got[None].lang_pred == "aa" and got[1003].lang_pred == "bb"
    assert language_of(empty_docs(spark)).collect() == []
    none = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert language_of(none).first().lang_pred == "und"


# language model
def test_lm_counts_and_gain(spark):
    rng = random.Random(9)
    follow = {w: [f"w{(i * 7 + k) % 60}" for k in range(3)] for i, w in enumerate(f"w{i}" for i in range(60))}
    rows = []
    for i in range(1500):
        w, text = "w1", []
        for _ in range(rng.randint(20, 90)):
            text.append(w.upper() if rng.random() < 0.1 else w)
            w = rng.choice(follow[w])
        rows.append((i, " ".join(text)))
    rows += [(2500, None), (2501, ""), (2502, "never seen words zzz zzz"), (None, "w1 w2"), (3, "w3 w4"), (2504, "w5 " * 30_000)]
    got = lm_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    held = [r[0] is None or zlib.crc32(str(r[0]).encode()) % 7 == 2 for r in rows]
    counts = Counter()
    for r, h in zip(rows, held):
        if not h:
            counts.update([*words(r[1]), "\n"])
    total, types = sum(counts.values()), len(counts)
    want = Counter()
    for r, h in zip(rows, held):
        tokens = [*words(r[1]), "\n"]
        want[(r[0], h, len(tokens), sum(counts[t] > 0 for t in tokens), total, round(sum(math.log10((counts[t] + 1) / (total + types + 1)) for t in tokens), 4))] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    out = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 1500]
    assert sum(r.score for r in out) > 0.8 * sum(r.base_score for r in out)  # context tells one of three words out of sixty
    assert lm_scores(empty_docs(spark)).collect() == []


def test_lm_is_a_distribution():
    from sessiograph.llm.lm_scoring import ENDINGS, Model, _start_and_ends

    texts = [("a b c d " * 20 + f"rare{i}").encode() for i in range(30)]
    tokens, endings, firsts = _start_and_ends(texts)
    uniq, first, n = np.unique(tokens, return_index=True, return_counts=True)
    group = np.zeros(ENDINGS, np.int64)
    head = n > 1
    tail = {0: (int(n[~head].sum()), int((~head).sum()))}
    model = Model(uniq[head], n[head], endings[first][head], group, tail, int(n.sum()), len(n))
    model.train(tokens, endings, firsts, np.zeros_like(model.top), np.zeros_like(model.inner))
    # every word of the vocabulary, and the unknown, after the same context: probabilities sum to one
    context = _start_and_ends([b"a b"])[0][:2]
    mass = 0.0
    for w, e, c in [*zip(uniq, endings[first], n), (np.uint64(12345), 0, 0)]:
        x, ee, f = np.array([*context, w]), np.array([*_start_and_ends([b"a b"])[1][:2], e]), np.array([0, 3])
        base, _, _, out = model.score(x, ee, f)
        base2, _, _, _ = model.score(x[:2], ee[:2], np.array([0, 2]))
        extra = math.log10(c + 1) if out[2] else 0.0
        mass += 10 ** (base[0] - base2[0] + extra)
    assert abs(mass - 1) < 1e-3


# secrets
def test_secrets_and_redaction(spark):
    rng = random.Random(1)
    hexes = ["".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(40)]
    rows = [(i, f"some prose before password={h[:18]} and after", "a") for i, h in enumerate(hexes)]
    rows += [(100 + i, f"the commit {h} fixed it", "a") for i, h in enumerate(hexes)]
    rows += [(200 + i, f"AKIA{''.join(rng.choice('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') for _ in range(16))} was here", "a") for i in range(20)]
    rows += [(300, "password=changemechangeme now", "docs"), (301, None, None), (302, "", None), (303, "nothing " * 30_000, None), (304, "averyveryverylongwordindeedwithoutdigits", "a"),
             (None, f"token = \"{hexes[0]}\"", "a"), (305, f"password={hexes[1][:18]}", "a"), (305, f"password={hexes[1][:18]}", "a")]
    docs = spark.createDataFrame([(i, t, s, len(t or "")) for i, t, s in rows], "doc_id long, text string, source string, n_chars long")
    found = secrets(docs).collect()
    confirmed = Counter(r.doc_id for r in found if r.secret)
    assert set(confirmed) == {*range(40), *range(200, 220), None, 305} and confirmed[305] == 2
    text = {i: t for i, t, _ in rows}
    import hashlib
    for r in found:
        assert hashlib.sha256(text[r.doc_id][r.start : r.start + r.length].encode()).hexdigest() == r.value_sha256
    clean = redacted(docs, length_col="n_chars").collect()
    assert Counter(r.doc_id for r in clean) == Counter(i for i, _, _ in rows)
    for r in clean:
        if r.doc_id in set(confirmed):
            assert "[SECRET]" in r.text and len(r.text) == r.n_chars
        else:
            assert r.text == text[r.doc_id]
    assert secrets(empty_docs(spark)).collect() == [] and redacted(empty_docs(spark)).collect() == []


def test_secrets_from_labelled_findings(spark):
    labelled = spark.createDataFrame([(f"{i:020d}", "internal ref ", "", "x", 0.0) for i in range(30)] + [(f"ab{i}Cd{i * 7}Ef{i * 31}gh9Kq2", "key is ", "", "x", 1.0) for i in range(30)],
                                     "value string, before string, after string, path string, label double")
    docs = spark.createDataFrame([(1, "internal ref 00000000000000000077 ok", "x"), (2, "key is zb4Qw8Ef3gh9Kq2Xy71Lm ok", "x")], "doc_id long, text string, source string")
    assert {r.doc_id: r.secret for r in secrets(docs, labelled).collect()} == {1: False, 2: True}


def _secret_docs(spark, rows):
    return spark.createDataFrame([(i, t, "a") for i, t in rows], "doc_id long, text string, source string")


def test_secrets_where_one_label_is_rare(spark, monkeypatch):
    monkeypatch.setattr(secret_scan, "FIT_ROWS", 200)
    rng = random.Random(3)
    hexes = ["".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(3008)]
    rows = [(i, f"the commit {h} fixed it") for i, h in enumerate(hexes[:3000])] + [(5000 + i, f"before password={h[:18]} after") for i, h in enumerate(hexes[3000:])]
    got = secrets(_secret_docs(spark, rows)).where("secret").collect()
    assert {r.doc_id for r in got} == set(range(5000, 5008))


def test_secrets_where_all_labels_are_one(spark):
    rng = random.Random(4)
    hexes = ["".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(30)]
    rows = [(i, f"before password={h[:18]} after") for i, h in enumerate(hexes)] + [(100, f"see {hexes[0]} there"), (101, "in /usr/lib/python3/dist-packages/abc/7def it is"), (102, "password=k7Qz9w and")]
    docs = _secret_docs(spark, rows)
    got = {r.doc_id: r.secret for r in secrets(docs).collect()}
    assert got == {**dict.fromkeys(range(30), True), 100: False, 101: False, 102: True}
    assert {r.doc_id: r.text for r in redacted(docs).collect()}[100] == rows[30][1]


# chat
def test_chat_snapshots(spark):
    def turns(conv, *texts):
        return [(conv, i, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(texts)]

    rows = [*turns(1, "hi"), *turns(2, "hi", "hello"), *turns(3, "hi", "hello", "how"), *turns(4, "hi", "other"), *turns(5, "hi", "other"), *turns(6, "hello"), *turns(7, None, ""),
            (8, 5, "user", "hi"), (8, 9, "assistant", "other"), (8, 9, "assistant", "other"), (None, 0, "user", "lost"), (9, None, "user", "no number"), (9, 0, None, "then")]
    got = {r.conv_id: r for r in chat_format(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert {c: r.copies for c, r in got.items()} == {3: 1, 4: 3, 6: 1, 7: 1, 9: 1}  # 8 says the same as 4 and 5 under other numbers
    assert got[3].rendered == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nhello<|im_end|>\n<|im_start|>user\nhow<|im_end|>\n"
    parts = chat_format(spark.createDataFrame(turns(1, *map(str, range(2500))) + turns(2, *map(str, range(1500))), "conv_id long, turn long, role string, text string")).collect()
    assert [(r.conv_id, r.n_turns) for r in parts] == [(1, 2500)]
    assert parts[0].rendered == "".join(f"<|im_start|>{'assistant' if i % 2 else 'user'}\n{i}<|im_end|>\n" for i in range(2500))
    assert chat_format(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


def test_chat_ties_clashing_columns_and_long_turns(spark):
    """Turns of one number go by role and text, as in the SQL; numbers below -PART follow turns without one."""
    import duckdb
    import pandas as pd

    rows = [(1, 1, "user", t) for t in ("beta", "alpha", "zeta", "gamma")] + [(2, 1, "user", "alpha"), (2, 1, "assistant", "zeta"), (3, None, "user", "first"), (3, -5000, "user", "second"),
            (3, 7, "user", "x" * 300_000), (4, 1, "user", "alpha"), (4, 1, "user", "beta")]
    schema = "conv_id long, turn long, role string, text string"
    extra = spark.createDataFrame(rows, schema).selectExpr("*", "1 as part", "'h' as h", "2 as j", "3 as copies", "4 as n")
    got = Counter((r.conv_id, r.n_turns, r.copies, r.rendered) for r in chat_format(extra).collect())
    con = duckdb.connect()
    con.register("frame", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"turn": "Int64"}))
    con.execute("CREATE VIEW conversations AS SELECT conv_id, turn, role, text FROM frame")
    assert got == Counter(con.sql(SQL["op4_chat_format"]).select("conv_id, n_turns, copies, rendered").fetchall())
    assert 4 not in {k[0] for k in got}  # alpha, beta begins conversation 1


# pipeline and registration
def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    from .helpers import exact_plain
    from .test_dedup import _stage_plain

    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["quality_rules", "exact_dedup", "near_dedup", "secret_scan", "packing"]
    one = steps["quality_rules"](spark, docs, DATA)
    verdict = {r.doc_id: r.kept for r in quality(docs).collect()}
    left = [r for r in rows if verdict[r[0]]]
    assert sorted(r.doc_id for r in one.collect()) == sorted(r[0] for r in left) and one.columns == docs.columns
    two = steps["exact_dedup"](spark, one, DATA)
    keep = {k[0] for k in exact_plain(left) if k[3]}
    left = [r for r in left if r[0] in keep]
    assert {r.doc_id for r in two.collect()} == keep
    three = steps["near_dedup"](spark, two, DATA)
    keep = set(_stage_plain([r[:2] for r in left]))
    assert {r.doc_id for r in three.collect()} == keep
    four = steps["secret_scan"](spark, three, DATA)
    assert {r.doc_id for r in four.collect()} == keep and four.columns == docs.columns and four.where("text rlike 'AKIA[0-9A-Z]{16}'").count() == 0
    five = corpus_pipeline.run(spark, DATA)
    assert {r.doc_id for r in five.select("doc_id").distinct().collect()} == keep


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    got = QUERIES[name](spark, DATA)
    cols = sorted(got.columns)
    want = con.sql(SQL[name])
    assert sorted(want.columns) == cols
    assert Counter(tuple(r[c] for c in cols) for r in got.collect()) == Counter(want.select(*cols).fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, name):
    got = QUERIES[name](spark, DATA.replace("0.001", "0.01") if name.startswith("op9_") else DATA)  # the smallest texts hold no candidate
    assert got.where(F.col("doc_id").isNotNull()).count() > 0


def test_stored_words_are_the_librarys_ids(monkeypatch):
    sentencepiece = pytest.importorskip("sentencepiece")
    monkeypatch.setattr("sessiograph.llm.sentencepiece_codec._CACHED", 5)
    sp, codec = sentencepiece.SentencePieceProcessor(model_file=PIECES), Codec(PIECES)
    for text in ["", " two  spaces ", "one two three four five six seven", "你好 \U0001f600 bé", "one two"]:
        (words,) = codec.words_of([text])
        raw = b"".join(ids for ids, _ in words)
        assert list(memoryview(raw).cast("i")) == sp.encode(text) and codec.shown(b"".join(r for _, r in words)) == text


def test_codec_keeps_each_word_once():
    codec = Codec(PIECES)
    texts = ["one two  two ⁂ onerous", "", "two one"]
    ids = codec.encode(texts)
    assert "words" not in vars(codec) and set(codec.words) == set(codec.stored)
    assert codec.words["▁two"] == tuple(codec.encode(["two"])[0]) and ids == codec.encode(texts)


def test_words_that_come_again_outlive_a_clearing(monkeypatch):
    monkeypatch.setattr("sessiograph.llm.sentencepiece_codec._CACHED", 4)
    codec, learned = Codec(PIECES), []
    plain = codec.learn
    monkeypatch.setattr(codec, "learn", lambda words: (learned.extend(words), plain(words)))
    texts = ["the one", "the two", "the three", "the four five", "the one", "the six seven", "the"]
    ids = [codec.encode([t])[0] for t in texts]
    assert learned.count("▁the") == 1 and len(codec.stored) + len(codec.older) <= 8
    assert ids == [Codec(PIECES).encode([t])[0] for t in texts]


@pytest.mark.parametrize("bits", [21, 4])
def test_common_words_are_encoded_together(monkeypatch, bits):
    sentencepiece = pytest.importorskip("sentencepiece")
    monkeypatch.setattr("sessiograph.llm.sentencepiece_codec.SLOT_BITS", bits)
    sp, codec, alone = sentencepiece.SentencePieceProcessor(model_file=PIECES), Codec(PIECES), []
    plain = codec._forward
    monkeypatch.setattr(codec, "_forward", lambda word, *rest: (alone.append(word), plain(word, *rest)))
    rng = random.Random(3)
    parts = ["the", "ing", "tion", "un", "re", "ß", "ñ", "é", "12", "\n", "q", "e", "internation", "a", "&&", "д", "  ", " ", "A"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    assert codec.encode(texts) == [sp.encode(t) for t in texts] and all(len(w) > 64 for w in alone)
    rare = [f"{t}\U0001f600\u4f60\u0301 {t}" for t in texts] + ["", "x" * 300, " ", "a▁b ▁ c", "\x00\x1f", "▁"]
    ids, ends, shown = codec.coded(rare)
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [sp.encode(t) for t in rare]
    assert shown == [t.replace("▁", " ") for t in rare] and [list(w) for w in codec.words_of(rare[-6:])] == [list(w) for w in Codec(PIECES).words_of(rare[-6:])]
    assert codec.coded(["", ""])[1].tolist() == [0, 0, 0] and codec.coded([])[1].tolist() == [0]


def test_words_encoded_together_are_decoded_from_their_ids(monkeypatch):
    codec, alone = Codec(PIECES), []
    monkeypatch.setattr(codec, "_forward", lambda word, *rest: alone.append(word))
    codec.raw[codec.pieces["▁the"]] = b" teh"
    texts = ["the one", "".join(f" w{i}é{i % 7}" for i in range(200)), "  the\nend", "the"]
    ids, ends, shown = codec.coded(texts)
    assert not alone and shown == [codec.decode(ids[a:b].tolist()) for a, b in zip(ends, ends[1:])]
    assert [x == t for x, t in zip(shown, texts)] == [False, True, False, False] and shown[3] == "teh"
