"""License scan: a positional index of rare licence words, then checks at the places where their postings agree.

Every template's words of highest inverse document frequency (over all documents) are its anchors. An anchor in a text at p
that stands at q in a template votes for the place p - q; a place where most anchors of a template agree within a few
words is checked: the mandatory phrases must stand where the template has them, and the words found at their relative
positions must make up most of the template's weight. Two passes over the texts, nothing but counts of licence words between.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import narrow, slices

#: Anchors of a template, share of them that must agree, words by which a place may shift, share of the weight that must stand there.
ANCHORS, AGREE, SHIFT, LEAST_SCORE = 6, 0.6, 3, 0.8
#: Bytes of text that are worked on at once.
SLICE_BYTES = 8_000_000

# Phrases and labels of the contract.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))


@dataclass(frozen=True)
class Template:
    """Words of a licence text or notice, its label, and the phrases in it without which it is not that licence."""

    label: str
    text: str
    phrases: tuple[str, ...]


# Opening words of published licences and their usual notices, in lower case, words parted by single spaces.
TEMPLATES = tuple(Template(label, phrase, (phrase,)) for phrase, label in BASE) + (
    Template("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", ("affero general public license",)),
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license", "version 2 0")),
    Template("apache-2.0", "you may obtain a copy of the license at http www apache org licenses license 2 0", ("www apache org licenses",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
             ("redistribution and use in source and binary forms",)),
    Template("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software",
             ("endorse or promote products derived from",)),
    Template("bsl-1.0", "boost software license version 1 0", ("boost software license",)),
    Template("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    Template("cc-by-4.0", "creative commons attribution 4 0 international license", ("attribution 4 0",)),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    Template("cc-by-nc-4.0", "creative commons attribution noncommercial 4 0 international license", ("attribution noncommercial",)),
    Template("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    Template("cc-by-sa-4.0", "creative commons attribution sharealike 4 0 international license", ("attribution sharealike",)),
    Template("cc0-1.0", "cc0 1 0 universal public domain dedication", ("cc0",)),
    Template("gpl-2.0", "licensed under the gnu general public license version 2", ("general public license version 2",)),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", ("general public license version 3",)),
    Template("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free "
             "software foundation", ("gnu general public license", "free software foundation")),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
             ("for any purpose with or without fee",)),
    Template("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", ("lesser general public license",)),
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mit", "licensed under the mit license", ("mit license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in "
             "the software without restriction", ("permission is hereby granted free of charge",)),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template("public-domain", "this is free and unencumbered software released into the public domain", ("released into the public domain",)),
)

PLACES = T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("first_word", T.LongType()), T.StructField("n_words", T.LongType()),
                                   T.StructField("score", T.DoubleType())]))
RESULT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_base", T.LongType()),
                       T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()), T.StructField("base_labels", T.StringType()),
                       T.StructField("labels", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("places", PLACES)])


def licence_words(templates=TEMPLATES) -> list[str]:
    return sorted({w for t in templates for w in t.text.split()})


def word_weights(docs: DataFrame, templates=TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> dict[str, float]:
    """Inverse document frequency of every licence word over all of ``docs``; as many entries as the templates have words."""
    words = licence_words(templates)

    def count(batches):
        import numpy as np
        import pyarrow as pa

        held = np.zeros(len(words) + 1, np.int64)
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
            held[-1] += len(texts)
            for lo, hi in slices(texts, SLICE_BYTES):
                code, before = _licence_codes(texts[lo:hi], words)
                at = np.flatnonzero(code >= 0)
                owner = np.searchsorted(before, at, "right") - 1
                held[:-1] += np.bincount(np.unique(owner * len(words) + code[at]) % len(words), minlength=len(words))
        yield pa.RecordBatch.from_arrays([pa.array([*words, None]), pa.array(held)], names=["word", "n"])

    rows = narrow(docs, id_col, text_col).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    n = {r.word: r.n for r in rows}
    return {w: math.log((n.get(None, 0) + 1) / (n.get(w, 0) + 1)) + 0.01 for w in words}


def _licence_codes(texts: list[bytes], words: list[str]):
    """Number in ``words`` of every word of the texts (-1: none of them), and how many words lie before each text."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    from ._terms import coded

    codes, known, before = coded(texts)
    number = pc.index_in(known, pa.array([w.encode() for w in words], pa.large_binary())).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    return (number[codes] if len(codes) else codes), before


class _Index:
    """Anchors' postings, phrases and weights of the templates over word numbers."""

    def __init__(self, templates, weights):
        import numpy as np

        self.words = licence_words(templates)
        number = {w: i for i, w in enumerate(self.words)}
        value = np.array([weights[w] for w in self.words])
        self.templates = templates
        self.texts = [np.array([number[w] for w in t.text.split()], np.int64) for t in templates]
        self.weights = [value[x] / value[x].sum() for x in self.texts]
        self.anchors = [np.sort(np.lexsort((np.arange(len(x)), -value[x]))[:ANCHORS]) for x in self.texts]
        self.phrases = [[(_place(t.text, p), np.array([number[w] for w in p.split()], np.int64)) for p in t.phrases] for t in templates]
        self.base = [(np.array([number[w] for w in phrase.split()], np.int64), label) for phrase, label in BASE]


def _place(text: str, phrase: str) -> int:
    """Word number at which ``phrase`` stands in ``text``."""
    words, wanted = text.split(), phrase.split()
    return next(i for i in range(len(words)) if words[i : i + len(wanted)] == wanted)


def _standing(code, before, phrase):
    """Places where the words of ``phrase`` stand one behind the other inside one text."""
    import numpy as np

    if not len(phrase):
        return np.zeros(0, np.int64)
    at = np.flatnonzero(code == phrase[0])
    for k in range(1, len(phrase)):
        at = at[at + k < len(code)]
        at = at[code[at + k] == phrase[k]]
    ends = before[np.searchsorted(before, at, "right")]
    return at[at + len(phrase) <= ends]


def _near(sorted_at, wanted):
    """Whether a value of ``sorted_at`` lies within SHIFT of each wanted one."""
    import numpy as np

    return np.searchsorted(sorted_at, wanted - SHIFT) < np.searchsorted(sorted_at, wanted + SHIFT, "right")


def _confirmed(index: _Index, t: int, code, at_of, before):
    """Texts, places (may lie before a text's first word by SHIFT) and scores where template ``t`` is confirmed."""
    import numpy as np

    words, weights, anchors = index.texts[t], index.weights[t], index.anchors[t]
    votes = [at_of(words[q]) - q for q in anchors]
    places = np.unique(np.concatenate(votes))
    places = places[sum(_near(v, places).astype(np.int64) for v in votes) >= np.ceil(AGREE * len(anchors))]
    for offset, phrase in index.phrases[t]:
        places = places[_near(_standing(code, before, phrase), places + offset)]
    if not len(places):
        return places, places, np.zeros(0)
    # the text of a place: where its first mandatory phrase stands
    offset, phrase = index.phrases[t][0]
    found = _standing(code, before, phrase)
    owner = np.searchsorted(before, found[np.searchsorted(found, places + offset - SHIFT)], "right") - 1
    score = np.zeros(len(places))
    for q, (word, weight) in enumerate(zip(words, weights)):
        hit = np.zeros(len(places), bool)
        for shift in range(-SHIFT, SHIFT + 1):
            p = places + q + shift
            ok = (p >= before[owner]) & (p < before[owner + 1])
            hit |= ok & (code[np.where(ok, p, 0)] == word)
        score += weight * hit
    good = score >= LEAST_SCORE
    return owner[good], places[good], np.minimum(score[good], 1.0)


def _scan(index: _Index, texts: list[bytes]):
    """Per text: words, base places' count, first and last, base labels, confirmed (label, place, words, score)."""
    import numpy as np

    code, before = _licence_codes(texts, index.words)
    spots = {}

    def at_of(word):
        if word not in spots:
            spots[word] = np.flatnonzero(code == word)
        return spots[word]

    base: list[list] = [[] for _ in texts]
    for phrase, label in index.base:
        at = _standing(code, before, phrase)
        for d, p in zip((np.searchsorted(before, at, "right") - 1).tolist(), at.tolist()):
            base[d].append((p - int(before[d]), label))
    found: list[dict] = [{} for _ in texts]
    for t, template in enumerate(index.templates):
        for d, p, s in zip(*(x.tolist() for x in _confirmed(index, t, code, at_of, before))):
            # neighbouring places of one template are one finding, the best of them
            key = (template.label, max(0, p - int(before[d])), len(index.texts[t]), s)
            near = found[d].setdefault(t, [])
            if near and key[1] - near[-1][1] <= SHIFT:
                near[-1] = max(near[-1], key, key=lambda x: x[3])
            else:
                near.append(key)
    for d in range(len(texts)):
        places = sorted(x for group in found[d].values() for x in group)
        starts = [p for p, _ in base[d]]
        labels = sorted({label for _, label in base[d]})
        yield (int(before[d + 1] - before[d]), len(starts), min(starts, default=None), max(starts, default=None), ",".join(labels),
               ",".join(sorted({*labels, *(x[0] for x in places)})), max((x[3] for x in places), default=0.0),
               [dict(zip(("label", "first_word", "n_words", "score"), x)) for x in places])


def license_scan(docs: DataFrame, templates=TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and ``places`` of every row of ``docs``.

    ``places``: label, first word, number of words and score of every confirmed licence; ``score`` is the best of them, 0
    without any. Null and empty texts have no words and empty labels; repeated rows and null ids each give a row; a text of
    any length is scanned whole; an empty table gives no rows. Other columns are ignored.
    """
    weights = word_weights(docs, templates, id_col, text_col)

    def scan(batches):
        import pyarrow as pa

        index = _Index(templates, weights)
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
            rows = [r for lo, hi in slices(texts, SLICE_BYTES) for r in _scan(index, texts[lo:hi])]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), None]
            places = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("score", pa.float64())]))
            cols = list(zip(*rows)) if rows else [[]] * 8
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k or places) for c, k in zip(cols, kinds))], names=RESULT.names)

    return narrow(docs, id_col, text_col).mapInArrow(scan, RESULT)
