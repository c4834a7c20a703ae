"""Sequence packing by best-fit decreasing.

Texts become token ids where they are read; a document longer than a window is cut into full windows and a rest, and only
the pieces' sizes and checksums travel on. Pieces are dealt evenly into blocks of a fixed expected size. Inside a block
they are placed longest first, each into the open window with the least room that still suffices, which a segment tree
over remaining capacities finds in log2(window) steps.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import narrow, parts_for, slices, stored

#: Pieces one block places; a block leaves a few open windows, so this bounds padding as well as memory.
PER_BLOCK = 50_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"
#: Bytes a task spends on words whose ids it keeps, bytes of an entry besides the word, and the longest word kept.
CACHED_BYTES, ENTRY_BYTES, CACHED_WORD = 100_000_000, 150, 64
_tokenizers: dict[str, tuple] = {}

SPACE, OTHER, LETTER, NUMBER = range(4)


def _kinds() -> tuple[np.ndarray, bytes, bytes]:
    """For Latin-1 bytes: kind of character, lower case, and those that go the fast way (printable or plain white space)."""
    chars = [chr(c) for c in range(256)]
    kinds = np.array([SPACE if c in " \n\t\r" else {"L": LETTER, "N": NUMBER}.get(unicodedata.category(c)[0], OTHER) for c in chars], np.uint8)
    lower = bytes(ord(c.lower()) for c in chars)
    return kinds, lower, bytes(i for i, c in enumerate(chars) if c in " \n\t\r" or unicodedata.category(c)[0] not in "CZ")


def split_words(data: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of every word of lower-case Latin-1 text that ends in white space, as the tokenizer's own pattern cuts it.

    A word is a run of letters, one number, a run of other characters, or an apostrophe that begins such a run together with
    the s, t, m, d, re, ve or ll behind it.
    """
    kind = kinds[data]
    before = np.concatenate([[SPACE], kind[:-1]])
    first = (kind != SPACE) & ((kind != before) | (kind == NUMBER))
    mark = np.flatnonzero((data == 39) & first)
    if len(mark):
        one, two = (data[np.minimum(mark + k, len(data) - 1)] for k in (1, 2))
        size = np.where(np.isin(one, list(b"stmd")), 1, np.where(((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108), 2, 0))
        mark, size = mark[size > 0], size[size > 0]
        first[mark + 1] = False
        after = mark + 1 + size
        first[after] = kind[after] != SPACE
    edges = np.flatnonzero(first | ((kind == SPACE) & (before != SPACE)))
    starts = first[edges]
    return edges[starts], (np.append(edges[1:], len(data)) - edges)[starts]


def word_encoder(path: str, expected: str) -> Callable[[list[str]], list[bytes]]:
    """Ids of whole texts as little-endian unsigned 32-bit integers, exactly as ``Tokenizer.encode(..., add_special_tokens=False)``.

    Words of a word-level BPE are independent, so texts are cut into words as arrays, and every distinct word is encoded
    once; its ids are kept within CACHED_BYTES. This path is taken only for the layout of steps named by ``expected`` and
    for texts of printable Latin-1 characters without special-token strings; all else goes through the library as a whole.
    """
    from tokenizers import Tokenizer

    if path not in _tokenizers:
        import json

        with open(path, encoding="utf-8") as f:
            layout = json.load(f)
        steps = "+".join(x["type"] for x in layout["normalizer"].get("normalizers", [])) if layout.get("normalizer") else ""
        _tokenizers[path] = (Tokenizer.from_file(path), {}, [CACHED_BYTES], steps == expected, [t["content"].encode() for t in layout.get("added_tokens", [])], *_kinds())
    tok, known, room, by_word, special, kinds, lower, safe = _tokenizers[path]

    def bytes_of(ids: list[int]) -> bytes:
        return np.array(ids, "<u4").tobytes()

    def plain(text: str) -> bytes | None:
        try:
            body = text.encode("latin-1")
        except UnicodeEncodeError:
            return None
        return None if not by_word or body.translate(None, safe) or any(s in body for s in special) else body

    def ids_of(words: list[bytes]) -> list[bytes]:
        new = [w for w in words if w not in known]
        room[0] -= sum(len(w) + ENTRY_BYTES for w in new if len(w) <= CACHED_WORD)
        if room[0] < 0:
            known.clear()
            room[0] = CACHED_BYTES
            new = words
        fresh = {}
        for i in range(0, len(new), 4096):
            part = new[i : i + 4096]
            found = tok.encode(b" ".join(part).decode("latin-1"), add_special_tokens=False)
            ends = (4 * np.cumsum(np.bincount(found.word_ids, minlength=len(part)))).tolist()
            ids = bytes_of(found.ids)
            fresh.update(zip(part, map(ids.__getitem__, map(slice, [0, *ends[:-1]], ends)), strict=True))
        out = [fresh[w] if w in fresh else known[w] for w in words]
        known.update((w, x) for w, x in fresh.items() if len(w) <= CACHED_WORD)
        return out

    def encode_plain(bodies: list[bytes]) -> list[bytes]:
        data = np.frombuffer(b"\n".join([*bodies, b""]).translate(lower), np.uint8)
        start, size = split_words(data, kinds)
        if not len(start):
            return [b""] * len(bodies)
        offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        coded = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data[kinds[data] != SPACE])]).dictionary_encode()
        codes, ids = coded.indices.to_numpy(zero_copy_only=False), ids_of(coded.dictionary.to_pylist())
        count = np.array([len(x) // 4 for x in ids], np.int64)
        begin, flat = np.concatenate([[0], np.cumsum(count)[:-1]]), np.frombuffer(b"".join(ids), "<u4")
        ends = np.concatenate([[0], np.cumsum(count[codes])])
        out = flat[np.repeat(begin[codes] - ends[:-1], count[codes]) + np.arange(ends[-1])].tobytes()
        cuts = 4 * ends[np.searchsorted(start, np.cumsum([0, *(len(b) + 1 for b in bodies)]))]
        return [out[lo:hi] for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]

    def encode(texts: list[str]) -> list[bytes]:
        bodies = [plain(t) for t in texts]
        done = iter(encode_plain([b for b in bodies if b is not None]))
        return [bytes_of(tok.encode(t, add_special_tokens=False).ids) if b is None else next(done) for t, b in zip(texts, bodies, strict=True)]

    return encode


def _cut(path: str, window: int, end_id: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = word_encoder(path, "NFC+Replace+Lowercase")
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            texts, doc_ids = [t or "" for t in batch.column(1).to_pylist()], batch.column(0).to_pylist()
            for lo, hi in slices(texts, 2_000_000):
                out: list[list] = [[], [], [], [], [], []]
                for doc_id, ids in zip(doc_ids[lo:hi], encode(texts[lo:hi]), strict=True):
                    ids += end
                    total = len(ids) // 4
                    for start in range(0, total, window):
                        piece = ids[4 * start : 4 * (start + window)]
                        for column, x in zip(out, (doc_id, start, len(piece) // 4, zlib.crc32(piece), total, piece if with_ids else None), strict=True):
                            column.append(x)
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:5]), pa.array(out[5], pa.binary())],
                                                 names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])

    return run


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Window number and offset of each piece. Pieces are taken longest first, equal ones in the order given."""
    order = np.argsort(-lengths, kind="stable")
    size = 1 << window.bit_length()
    tree = [0] * (2 * size)  # leaf c counts the open windows with c tokens of room, each node its leaves
    open_at: list[list[int]] = [[] for _ in range(window + 1)]
    place, offset, used = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0

    def add(room: int, by: int) -> None:
        node = room + size
        while node:
            tree[node] += by
            node >>= 1

    for i, need in zip(order.tolist(), lengths[order].tolist(), strict=True):
        node = need + size
        if not tree[node]:  # climb until a right neighbour has an open window, then go down to its least leaf
            while node > 1 and (node & 1 or not tree[node + 1]):
                node >>= 1
            node = node + 1 if node > 1 else 0
            while 0 < node < size:
                node = 2 * node if tree[2 * node] else 2 * node + 1
        if node:
            room = node - size
            where = open_at[room].pop()
            add(room, -1)
        else:
            room, where, used = window, used, used + 1
        place[i], offset[i] = where, window - room
        if room > need:
            open_at[room - need].append(where)
            add(room - need, 1)
    return place, offset


def _place(window: int):
    def run(block: pa.Table) -> pa.Table:
        block = block.sort_by([(c, "ascending") for c in ("doc_id", "start", "ids_crc32", "length")])
        place, offset = best_fit_decreasing(block["length"].to_numpy().astype(np.int64), window)
        first = block["block"][0].as_py() << 32
        return block.drop_columns(["block"]).append_column("sequence_id", pa.array(place + first)).append_column("offset", pa.array(offset))

    return run


def pack(docs: DataFrame, tokenizer: str, window: int = 4096, end_id: int = 2, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids with ``with_ids``).

    A document is its token ids and ``end_id``; a null text counts as empty, so every row has at least one token.
    Windows hold pieces without gaps from offset 0. Rows are packed one by one, so repeated rows, null ids and ids that
    come with several texts each keep their own pieces. An empty table gives an empty result; other columns are ignored.
    """
    rows = narrow(docs, id_col, text_col)
    pieces = stored(rows.mapInArrow(_cut(tokenizer, window, end_id, with_ids), PIECES), "pieces")
    blocks = parts_for(pieces.count(), PER_BLOCK)
    dealt = pieces.withColumn("block", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(blocks)).cast("int"))
    kept = dealt if with_ids else dealt.drop("ids")
    schema = PIECES if with_ids else PIECES.removesuffix(", ids binary")
    return kept.groupBy("block").applyInArrow(_place(window), f"{schema}, sequence_id long, offset long")


def sequences(packed: DataFrame, window: int = 4096, pad_id: int = 0) -> DataFrame:
    """The windows themselves from ``pack(..., with_ids=True)``: sequence_id, n_tokens, input_ids padded to ``window``."""

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        ids = np.frombuffer(b"".join(rows.sort_values("offset")["ids"]), "<u4").astype(np.int32)
        return pd.DataFrame({"sequence_id": [rows["sequence_id"].iloc[0]], "n_tokens": [len(ids)], "input_ids": [np.pad(ids, (0, window - len(ids)), constant_values=pad_id)]})

    return packed.groupBy("sequence_id").applyInPandas(join, "sequence_id long, n_tokens long, input_ids array<int>")
