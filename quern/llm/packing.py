"""Packing documents into fixed-length sequences: first-fit decreasing with a tournament tree, in random groups."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import binary_text, lean, release, slices

#: Pieces whose ids a worker remembers at most, before it starts anew.
MEMORY = 400_000
#: Words that are cut into pieces here: visible ASCII and the Latin letters of two blocks, whose lower case is one
#: letter of the same blocks and which composition leaves alone. All others go through the tokenizer as a whole.
PLAIN = re.compile(r"[!-~\u00c0-\u012f\u0131-\u017e]*")
#: The tokenizer's own pattern on those characters in lower case.
PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u017e]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u017e]+")

MARKS = frozenset(".,;:!?")


def byte_letters() -> dict[int, str]:
    """A visible character for each byte, as byte-level tokenizers have it: itself if visible, else the next from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Words:
    """Token ids of whole texts. A batch's distinct words between ASCII white space are encoded once, which is exact
    for a tokenizer that drops white space and never joins across it; plain words are cut into the tokenizer's pieces
    here, whose ids are remembered."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.binary = [int(i).to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.pieces: dict[str, bytes] = {}
        #: Where pieces don't give the tokenizer's ids, nothing is cut here.
        probe = ["It's", "WE'LL", "naïve", "a1b22-c***", "Éçê.", "x'd", "don't!'s"]
        self.cuts = all(self.cut(w) == self.whole([w])[0] for w in probe)

    def whole(self, words: list[str]) -> list[bytes]:
        return [b"".join(map(self.binary.__getitem__, e.ids)) for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def piece(self, p: str) -> bytes:
        """The ids of one piece in lower case."""
        text = p if p.isascii() else "".join(map(self.letters.__getitem__, p.encode()))
        self.pieces[p] = ids = b"".join([self.binary[t.id] for t in self.model.tokenize(text)])
        return ids

    def cut(self, word: str) -> bytes:
        known, piece = self.pieces.get, self.piece
        return b"".join([known(p) or piece(p) for p in PIECE.findall(word.lower())])

    def ids(self, words: list[str]) -> list[bytes]:
        """The ids of each word. Most are letters alone, or with one mark behind, and need no pattern."""
        if len(self.pieces) > MEMORY:
            self.pieces.clear()
        out: list[bytes] = []
        put, plain, cut, piece, known = out.append, PLAIN.fullmatch, self.cut, self.piece, self.pieces.get
        rest: list[int] = []
        for i, w in enumerate(words if self.cuts else ()):
            if w.isalpha():
                if w.isascii() or plain(w):
                    p = w.lower()
                    put(known(p) or piece(p))
                    continue
            elif w and w[-1] in MARKS and (h := w[:-1]).isalpha():
                if h.isascii() or plain(h):
                    p = h.lower()
                    put((known(p) or piece(p)) + (known(w[-1]) or piece(w[-1])))
                    continue
            elif plain(w) and "<|" not in w:
                put(cut(w))
                continue
            put(b"")
            rest.append(i)
        if not self.cuts:
            return self.whole(words)
        for i, b in zip(rest, self.whole([words[i] for i in rest]) if rest else ()):
            out[i] = b
        return out

    def encode(self, texts: pa.Array, end: int) -> list[np.ndarray]:
        """For each text (a string array without nulls) its ids and `end`, as uint32."""
        parted = pc.ascii_split_whitespace(texts)
        offsets = parted.offsets.to_numpy().astype(np.int64)
        flat = parted.flatten()
        if not len(flat):
            return [np.array([end], np.uint32) for _ in range(len(texts))]
        coded = flat.dictionary_encode()
        words, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        got = self.ids(words)
        ids = np.frombuffer(b"".join(got), np.uint32)
        sizes = np.fromiter(map(len, got), np.int64, len(got)) // 4
        starts = np.cumsum(sizes) - sizes
        n = sizes[codes]
        total = np.concatenate([[0], np.cumsum(n)])
        at = np.arange(total[-1]) + np.repeat(starts[codes] - total[:-1], n)
        stream, cuts = ids[at], total[offsets - offsets[0]]
        return [np.append(stream[a:z], np.uint32(end)) for a, z in zip(cuts[:-1], cuts[1:])]


@lru_cache(maxsize=2)
def words_of(path: str) -> Words:
    return Words(path)


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each item (sizes from 1 to capacity): largest first, each into the first bin with room.

    A tournament tree over the bins holds the largest free capacity below each node, so the first bin with room is
    found by one walk from the root. Equal sizes keep their order.
    """
    leaves = 1
    while leaves < len(sizes):
        leaves *= 2
    tree = [capacity] * (2 * leaves)
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        size, node = sizes[i], 1
        while node < leaves:
            node *= 2
            if tree[node] < size:
                node += 1
        out[i] = node - leaves
        tree[node] -= size
        while node > 1:
            node //= 2
            best = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == best:
                break
            tree[node] = best
    return out


def layout(lengths: list[int], capacity: int, gap: int = 32) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece of documents with these lengths (1 or more).

    Whole capacities are cut off long documents; what is left is packed first-fit decreasing. Then the emptiest
    sequences give their tokens to others with `gap` or more free, and what remains in an underfilled sequence is cut
    at powers of two, which need no padding.
    """
    items: list[tuple[int, int, int]] = []
    full: list[list[tuple[int, int, int]]] = []
    for d, n in enumerate(lengths):
        a = 0
        while n - a >= capacity:
            full.append([(d, a, capacity)])
            a += capacity
        if n > a:
            items.append((d, a, n - a))
    bins: dict[int, list[tuple[int, int, int]]] = {}
    for it, b in zip(items, first_fit_decreasing([x[2] for x in items], capacity)):
        bins.setdefault(b, []).append(it)
    load = lambda b: sum(x[2] for x in b)
    some = sorted(bins.values(), key=load)
    free = [capacity - load(b) for b in some]
    low, high = 0, len(some) - 1
    while low < high:
        if not some[low]:
            low += 1
        elif free[high] < gap:
            high -= 1
        else:
            d, a, n = some[low].pop()
            part = min(n, free[high])
            some[high].append((d, a, part))
            free[high] -= part
            free[low] += part
            if n > part:
                some[low].append((d, a + part, n - part))
    done = full
    for b in some:
        used = load(b)
        if capacity - used < gap:
            done.append(b)
            continue
        rest = b[::-1]
        while used:
            room = 1 << (used.bit_length() - 1)
            used -= room
            own = []
            while room:
                d, a, n = rest.pop()
                part = min(n, room)
                own.append((d, a, part))
                room -= part
                if n > part:
                    rest.append((d, a + part, n - part))
            done.append(own)
    out = []
    for s, b in enumerate(done):
        at = 0
        for d, a, n in b:
            out.append((d, a, n, s, at))
            at += n
    return out


def tokens(docs: DataFrame, path: Callable[[], str], ident: str, text: str, end: int, per_group: int) -> DataFrame:
    """(group, spot, ident, ids): whole token ids as little-endian uint32, dealt at random to groups of about `per_group`."""
    groups = max(1, -(-docs.count() // per_group))
    slim = docs.select(F.col(ident).alias("ident"), binary_text(text).alias("raw"))
    schema = slim.selectExpr("0L as group", "0L as spot", "ident", "raw as ids").schema

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, row = words_of(path()), 0
        part = TaskContext.get().partitionId()
        for b in batches:
            for s in slices(b, "raw"):
                ids = own.encode(s.column(1).cast(pa.string()), end)
                spot = (np.int64(part) << np.int64(36)) + np.arange(row, row + len(ids))
                row += len(ids)
                mixed = spot.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
                group = ((mixed >> np.uint64(33)) % np.uint64(groups)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(group), pa.array(spot), s.column(0), pa.array([x.tobytes() for x in ids], pa.binary())], schema.names)

    return slim.mapInArrow(lean(encode), schema)


def pack(docs: DataFrame, path: Callable[[], str], ident: str = "doc_id", text: str = "text", capacity: int = 4096, end: int = 2, per_group: int = 2048) -> DataFrame:
    """(ident, start, length, ids, doc_tokens, sequence_id, offset): every piece of every document, with its ids.

    `path` gives the tokenizer's file on any machine. Documents are dealt to random groups by their place in the
    input, so repeated ids and texts spread evenly; each group is packed alone and its memory is bounded by
    `per_group` documents. A null or empty text is its end id alone. sequence_id is the group's number shifted by 32
    bits plus the sequence within. An empty table gives no rows.
    """
    enc = tokens(docs, path, ident, text, end, per_group)
    schema = enc.selectExpr("ident", "0L as start", "0L as length", "ids", "0L as doc_tokens", "0L as sequence_id", "0L as offset").schema

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("spot", ignore_index=True)
        raw = pdf["ids"].tolist()
        lengths = [len(x) // 4 for x in raw]
        rows = layout(lengths, capacity)
        base = int(pdf["group"].iloc[0]) << 32
        release()
        d = [r[0] for r in rows]
        return pd.DataFrame(
            {
                "ident": pdf["ident"].take(d).reset_index(drop=True),
                "start": [r[1] for r in rows],
                "length": [r[2] for r in rows],
                "ids": [raw[r[0]][4 * r[1] : 4 * (r[1] + r[2])] for r in rows],
                "doc_tokens": [lengths[k] for k in d],
                "sequence_id": [base + r[3] for r in rows],
                "offset": [r[4] for r in rows],
            }
        )

    return enc.groupBy("group").applyInPandas(one, schema).withColumnRenamed("ident", ident)


def with_crc(pieces: DataFrame) -> DataFrame:
    """pieces with ids_crc32 (of the ids as little-endian unsigned 32-bit integers) in place of ids."""
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())
