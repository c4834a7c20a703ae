"""SentencePiece encoding and decoding with a shared-prefix Viterbi pass.

Texts become marked words (spaces as U+2581); the distinct new words of a batch are sorted, which is a trie in depth-first
order, and forward scores stay on the path: a word computes only what lies beyond the prefix it shares with the one
before. A merge model's segmentation of a prefix is fixed by its last piece, and a piece may follow another exactly if the two
alone would be encoded as these two; so the forward pass keeps the one last piece that may follow, and its ids are the library's.
A unigram model takes the best sum of scores instead. Words of a merge model that consist of common characters go through the
trie together, one depth after the other as arrays; an automaton over the pieces names those that end at a character.
"""

from __future__ import annotations

import re
import sys
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import narrow, slices
from ._hashing import joined

MARK = "▁"
_WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_CACHED = 300_000
#: Words that go through the trie as arrays: so many at least at a time, of so many characters at most, out of so many characters.
TOGETHER, LONGEST, ALPHABET = 64, 64, 250
#: Slots (a power of two) in which an array pass remembers which pieces may follow which.
SLOT_BITS = 21
ENCODED = "doc_id long, n_tokens long, ids_crc32 long, round_trip boolean, ids array<int>"


class Matcher:
    """Automaton over the pieces made of common characters: the longest piece that ends at a character, and shorter ones behind it.

    Common are the mark, the printable Latin-1 characters and the commonest ones of the pieces. One without a piece is spelled in bytes.
    """

    def __init__(self, pieces: dict[str, int], byte_ids: dict[int, int]):
        latin = [MARK, "\t", "\n", "\r", *(chr(i) for i in range(33, 256) if chr(i).isprintable())]
        often = [c for c, _ in Counter("".join(pieces)).most_common()]
        chars = [c for c in dict.fromkeys([*latin, *often]) if c in pieces or byte_ids][:ALPHABET]
        self.char = np.zeros(sys.maxunicode + 1, np.uint8)
        self.char[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        common = set(chars)
        self.names = ["", *(p for p in pieces if common.issuperset(p)), *(c for c in chars if c not in pieces)]  # 0 stands for the start of a word
        ids = [[], *([pieces[p]] if p in pieces else [byte_ids[b] for b in p.encode()] for p in self.names[1:])]
        self.ids, self.width = np.array([i for x in ids for i in x], np.int32), np.array([len(x) for x in ids], np.int64)
        self.place = np.cumsum(self.width) - self.width
        self.size = np.array([len(p) for p in self.names], np.int64)
        number = {p: i for i, p in enumerate(self.names)}
        states = sorted({p[:k] for p in self.names for k in range(len(p) + 1)}, key=len)
        at = {x: i for i, x in enumerate(states)}
        back = np.array([0, *(next(at[x[k:]] for k in range(1, len(x) + 1) if x[k:] in at) for x in states[1:])], np.int32)
        up = np.array([0, *(at[x[:-1]] for x in states[1:])], np.int32)
        by = self.char[[0, *(ord(x[-1]) for x in states[1:])]]
        depth = np.array([len(x) for x in states])
        self.step = np.zeros((len(states), len(chars) + 1), np.int32)
        self.ending = np.array([number.get(x, 0) for x in states], np.int32)
        for d in range(1, int(depth[-1]) + 1):
            here = np.flatnonzero(depth == d)
            self.step[up[here], by[here]] = here  # the rows above are whole now
            self.step[here] = self.step[back[here]]
            self.ending[here] = np.where(self.ending[here] > 0, self.ending[here], self.ending[back[here]])
        self.shorter = self.ending[back[[at[p] for p in self.names]]]
        self.keys, self.may = np.full(1 << SLOT_BITS, -1, np.int64), np.zeros(1 << SLOT_BITS, bool)

    def following(self, left: np.ndarray, right: np.ndarray, stay: Callable[[str, str], bool]) -> np.ndarray:
        """``stay`` of each two pieces, remembered."""
        key = left.astype(np.int64) * len(self.names) + right
        slot = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        ok, new = self.may[slot], np.flatnonzero(self.keys[slot] != key)
        if len(new):
            asked, first, where = np.unique(key[new], return_index=True, return_inverse=True)
            names = self.names
            told = np.array([stay(names[a], names[b]) for a, b in (divmod(k, len(names)) for k in asked.tolist())], bool)
            ok[new] = told[where]
            # of keys that share a slot one stays, with its own answer
            slots, one = np.unique(slot[new[first]], return_index=True)
            self.keys[slots], self.may[slots] = asked[one], told[one]
        return ok

    def forward(self, chars: np.ndarray, size: np.ndarray, stay: Callable[[str, str], bool]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of sorted words, one behind the other, and where each word's start (with the end last).

        ``chars``: a row per word, zeros behind it. A prefix is computed in the first word that has it; ``owner`` names that word.
        """
        n, longest = len(size), int(size.max())
        shared = np.zeros(n, np.int64)
        differs = chars[1:] != chars[:-1]
        shared[1:] = differs.argmax(axis=1)
        owner = np.zeros((longest + 1, n), np.int32)
        last, state = np.zeros((longest + 1, n), np.int32), np.zeros(n, np.int32)
        words = np.arange(n, dtype=np.int32)
        for end in range(1, longest + 1):
            fresh = shared < end
            owner[end] = np.maximum.accumulate(np.where(fresh, words, 0))
            own = np.flatnonzero(fresh & (size >= end))
            now = self.step[state[owner[end - 1][own]], chars[own, end - 1]]
            state[own] = now
            piece = self.ending[now]
            open_ = np.flatnonzero(self.size[piece] > 1)
            while len(open_):
                try_, word = piece[open_], own[open_]
                begin = end - self.size[try_]
                open_ = open_[~self.following(last[begin, owner[begin, word]], try_, stay)]
                piece[open_] = self.shorter[piece[open_]]
                open_ = open_[self.size[piece[open_]] > 1]
            last[end, own] = piece
        # back from the ends, one piece a step
        rows, at, steps = np.arange(n), size.copy(), []
        while len(rows):
            piece = last[at, owner[at, rows]]
            steps.append((rows, piece))
            at = at - self.size[piece]
            rows, at = rows[at > 0], at[at > 0]
        count = np.zeros(n, np.int64)
        for rows, _ in steps:
            count[rows] += 1
        ends = np.concatenate([[0], np.cumsum(count)])
        flat = np.empty(ends[-1], np.int32)
        for k, (rows, piece) in enumerate(steps):
            flat[ends[rows + 1] - 1 - k] = piece
        after = np.concatenate([[0], np.cumsum(self.width[flat])])
        within = np.arange(after[-1]) - np.repeat(after[:-1], self.width[flat])
        return self.ids[np.repeat(self.place[flat], self.width[flat]) + within], after[ends]


class Codec:
    """Pieces, scores and byte pieces of one model; caches of word and pair decisions, bounded, per Python worker."""

    _open: dict[str, Codec] = {}

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(sp.get_piece_size())
        self.names = [sp.id_to_piece(i) for i in ids]
        plain = [i for i in ids if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.pieces = {self.names[i]: i for i in plain}
        self.scores = {i: sp.get_score(i) for i in plain}
        self.byte_ids = {int(self.names[i][3:-1], 16): i for i in ids if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        sizes: dict[str, set[int]] = {}
        for p in self.pieces:
            sizes.setdefault(p[-3:], set()).add(len(p))
        self.sizes = {k: [*sorted(v, reverse=True), 2] for k, v in sizes.items() if len(k) == 3}  # by the last three characters, longest first
        if any(MARK in p.lstrip(MARK) for p in self.pieces):
            raise ValueError("pieces span words; words cannot be encoded one by one")
        self.merges = all(s <= 0 and s == int(s) for s in self.scores.values())
        self.raw = [b"" if sp.is_control(i) or sp.is_unknown(i) else bytes([int(self.names[i][3:-1], 16)]) if sp.is_byte(i) else self.names[i].replace(MARK, " ").encode() for i in ids]
        self.raw[self.unknown] = " ⁇ ".encode()
        self.packed = [i.to_bytes(4, sys.byteorder) for i in ids]
        self.stored: dict[str, tuple[bytes, bytes]] = {}  # of known words: ids as 32-bit numbers, and what they decode to
        self.older: dict[str, tuple[bytes, bytes]] = {}  # words known before the last clearing; those that come again are kept
        self.pairs: dict[tuple[str, str], bool] = {}
        self.grown: dict[str, tuple[list, list] | None] = {}
        self.by_name = {p: self.scores[i] for p, i in self.pieces.items()}
        self.matcher: Matcher | None = None
        self.bytes_of: tuple[np.ndarray, np.ndarray] | None = None  # what the ids decode to, one behind the other, and where each begins

    @property
    def words(self) -> dict[str, tuple[int, ...]]:
        """Ids of the known words."""
        return {w: tuple(memoryview(ids).cast("i")) for w, (ids, _) in self.stored.items()}

    @classmethod
    def at(cls, path: str) -> Codec:
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def edges(self, piece: str) -> tuple[list, list] | None:
        """How a piece grew: its first and its last part after each merge, newest first, with the score of the merge that made
        it (none for a character). None for a piece that merging its characters never gives."""
        if piece not in self.grown:
            parts = list(piece)
            first, last = [(parts[0], np.inf)], [(parts[-1], np.inf)]
            while len(parts) > 1:
                best, at = -np.inf, -1
                for i in range(len(parts) - 1):
                    score = self.by_name.get(parts[i] + parts[i + 1], -np.inf)
                    if score > best:
                        best, at = score, i
                if at < 0:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
                if at == 0:
                    first.append((parts[0], best))
                if at == len(parts) - 1:
                    last.append((parts[-1], best))
            self.grown[piece] = (first[::-1], last[::-1]) if len(parts) == 1 else None
        return self.grown[piece]

    def may_follow(self, left: str, right: str) -> bool:
        """Whether the two, merged together from their characters, stay these two: going back merge by merge, no pair across
        the border may have been due before the merge that ended its chance (of equals, the leftmost is due first)."""
        key = (left, right)
        ok = self.pairs.get(key)
        if ok is None:
            if len(self.pairs) > _CACHED:
                self.pairs.clear()
            ok = self.pairs[key] = self._stay(left, right)
        return ok

    def _stay(self, left: str, right: str) -> bool:
        a, b = self.edges(left) if left else None, self.edges(right)
        if not left or b is None or a is None:
            return not left and b is not None
        xs, ys, i, j, due, from_left = a[1], b[0], 0, 0, -np.inf, False
        while True:
            across = self.by_name.get(xs[i][0] + ys[j][0])
            if across is not None and (across > due or across == due and not from_left):
                return False
            made_x, made_y = xs[i][1], ys[j][1]
            if made_x == made_y == np.inf:
                return True
            from_left = made_x < made_y
            due = min(made_x, made_y)
            i, j = (i + 1, j) if from_left else (i, j + 1)

    def _forward(self, word: str, start: int, last: list[str], ids: list, score: list[float]) -> None:
        """Extend last pieces, their ids and, for a unigram model, scores of the prefixes of ``word`` from ``start`` characters on."""
        known, pairs, look, scores, two = self.pieces.get, self.pairs.get, self.sizes.get, self.scores, (2,)
        if self.merges:
            for end in range(start + 1, len(word) + 1):
                piece = word[end - 1]
                here = known(piece)
                if end > 1:
                    for size in look(word[end - 3 : end], two) if end > 2 else two:
                        if size <= end:
                            part = word[end - size : end]
                            found = known(part)
                            if found is not None:
                                before = last[end - size]
                                ok = pairs((before, part))
                                if ok or ok is None and self.may_follow(before, part):
                                    piece, here = part, found
                                    break
                last.append(piece)
                ids.append(here if here is not None else self._spelled(piece))
            return
        for end in range(start + 1, len(word) + 1):
            piece = word[end - 1]
            here = known(piece)
            value = score[end - 1] + (-100.0 if here is None else scores[here])
            for size in look(word[end - 3 : end], two) if end > 2 else two if end == 2 else ():
                if size > end:
                    continue
                part = word[end - size : end]
                found = known(part)
                if found is not None and score[end - size] + scores[found] > value:
                    piece, here, value = part, found, score[end - size] + scores[found]
            last.append(piece)
            ids.append(here if here is not None else self._spelled(piece))
            score.append(value)

    def _spelled(self, piece: str) -> tuple[int, ...]:
        """Ids of a character without a piece, last byte first."""
        return tuple(self.byte_ids[b] for b in reversed(piece.encode())) if self.byte_ids else (self.unknown,)

    def _decoded(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the ids, one behind the other, and where each id's begin (with the end last)."""
        if self.bytes_of is None:
            self.bytes_of = joined(self.raw)
        body, at = self.bytes_of
        size = (at[1:] - at[:-1])[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        return body[np.arange(ends[-1]) + np.repeat(at[:-1][ids] - ends[:-1], size)], ends

    def _learn_together(self, words: list[str]) -> list[str]:
        """Encode sorted distinct words as arrays; those that have an uncommon character are left, and returned."""
        if self.matcher is None:
            self.matcher = Matcher(self.pieces, self.byte_ids)
        size = np.fromiter(map(len, words), np.int64, len(words))
        whole = "".join(words).replace(MARK, " ")
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        codes = self.matcher.char[points]
        codes[points == 32] = self.matcher.char[ord(MARK)]
        begin = np.cumsum(size) - size
        fit = np.minimum.reduceat(codes, begin) > 0
        if not fit.any():
            return words
        at, size = begin[fit], size[fit]
        chars = np.zeros((len(at), int(size.max()) + 1), np.uint8)
        within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        chars[np.repeat(np.arange(len(at)), size), within] = codes[np.repeat(at, size) + within]
        flat, ends = self.matcher.forward(chars, size, self._stay)
        shown, places = self._decoded(flat)
        ids, shown, places, ends = flat.tobytes(), shown.tobytes(), places[ends].tolist(), (4 * ends).tolist()
        known = [w for w, f in zip(words, fit.tolist(), strict=True) if f]
        cuts = zip(ends[:-1], ends[1:], places[:-1], places[1:], strict=True)
        self.stored.update(zip(known, [(ids[a:b], shown[c:d]) for a, b, c, d in cuts], strict=True))
        return [w for w, f in zip(words, fit.tolist(), strict=True) if not f]

    def learn(self, words: list[str]) -> None:
        """Encode distinct words in trie order."""
        words = sorted(words)
        if self.merges and MARK in self.pieces:
            short = [w for w in words if len(w) <= LONGEST]
            if len(short) >= TOGETHER:
                words = sorted([*self._learn_together(short), *(w for w in words if len(w) > LONGEST)])
        last, ids, score, before, packed, raw = [""], [0], [0.0], "", self.packed, self.raw
        for word in words:
            shared = len(before)
            while not word.startswith(before[:shared]):  # neighbours in order share most of a prefix
                shared -= 1
            del last[shared + 1 :], ids[shared + 1 :], score[shared + 1 :]
            self._forward(word, shared, last, ids, score)
            # most words end in a few pieces: their bytes are put before what is there already
            coded = text = b""
            end = len(word)
            while end:
                here = ids[end]
                if here.__class__ is int:
                    coded, text = packed[here] + coded, raw[here] + text
                else:
                    for i in here:
                        coded, text = packed[i] + coded, raw[i] + text
                end -= len(last[end])
            self.stored[word] = (coded, text)
            before = word

    def _hold(self, words: set[str]) -> None:
        """All these words are in ``stored`` afterwards."""
        new = words - self.stored.keys()
        again = new & self.older.keys()
        self.stored.update((w, self.older[w]) for w in again)
        new -= again
        if len(self.stored) + len(new) > _CACHED:
            self.older, self.stored = self.stored, {w: self.stored[w] for w in words - new}
        self.learn(list(new))

    def words_of(self, texts: list[str]) -> list[list[tuple[bytes, bytes]]]:
        """The encoded words of each text."""
        split = [_WORDS.findall((MARK + t).replace(" ", MARK)) if t else [] for t in texts]
        self._hold(set().union(*split))
        get = self.stored.__getitem__
        return [list(map(get, s)) for s in split]

    def coded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Ids of all texts, where each text's begin (with the end last), and what they decode to: ``words_of`` over arrays."""
        data, at = joined([f" {t}".replace(MARK, " ").encode() if t else b"" for t in texts])
        space = data == 32
        first = space.copy()
        first[1:] &= ~space[:-1]
        first[at[:-1][at[:-1] < at[1:]]] = True
        start = np.flatnonzero(first)
        words = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(np.append(start, len(data))), pa.py_buffer(data)]).dictionary_encode()
        _, ends, body = words.dictionary.buffers()
        body = np.frombuffer(body or b"", np.uint8)
        cuts = np.concatenate([[0], np.cumsum((body & 0xC0) != 0x80)])[np.frombuffer(ends, np.int64)[: len(words.dictionary) + 1]].tolist()
        whole = body.tobytes().decode().replace(" ", MARK)  # a character for a character
        distinct = [whole[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        self._hold(set(distinct))
        found = [self.stored[w] for w in distinct]
        cuts, out = np.searchsorted(start, at), []
        for k in (0, 1):
            all_ = pa.array([x[k] for x in found], pa.large_binary()).take(words.indices)
            _, ends, body = all_.buffers()
            out.append((np.frombuffer(ends, np.int64)[cuts], body or b""))
        (ids, packed), (shown, raw) = out
        view = memoryview(raw)
        return np.frombuffer(packed, np.int32)[: ids[-1] // 4], ids // 4, [self.shown(bytes(view[lo:hi])) for lo, hi in zip(shown[:-1].tolist(), shown[1:].tolist(), strict=True)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [np.frombuffer(b"".join([ids for ids, _ in words]), np.int32).tolist() for words in self.words_of(texts)]

    def decode(self, ids: list[int]) -> str:
        """Text of the ids; the space put before the first word is taken off again."""
        return self.shown(b"".join(map(self.raw.__getitem__, ids)))

    @staticmethod
    def shown(raw: bytes) -> str:
        text = raw.decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids_crc32 (of little-endian unsigned 32-bit ids), round_trip, ids.

    A null text counts as empty and has no ids. Ids equal the library's; ``round_trip`` says that decoding gives the text
    back, which fails only for texts that hold the mark U+2581 itself. Repeated rows and null ids keep their rows; an empty
    table gives an empty result; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.at(model)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for lo, hi in slices(texts, 2_000_000):
                ids, ends, shown = codec.coded(texts[lo:hi])
                raw = memoryview(ids).cast("B")
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                back = [x == t for x, t in zip(shown, texts[lo:hi], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(np.diff(ends)), pa.array(crc, pa.int64()),
                     pa.array(back, pa.bool_()), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))],
                    names=["doc_id", "n_tokens", "ids_crc32", "round_trip", "ids"])

    return narrow(docs, id_col, text_col).mapInArrow(run, ENCODED)


def decode(rows: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of every row of ids; null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.at(model)
        for batch in batches:
            texts = [None if ids is None else codec.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select(rows[id_col].cast("long").alias("doc_id"), rows[ids_col].cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")
