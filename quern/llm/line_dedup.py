"""Substring dedup by unit hashing: the earliest occurrence of each repeated line, paragraph or passage stays.

The units are lines (or paragraphs), of any length. Passages are pasted into the middle of lines as often as on lines of
their own, so lines are cut further into chunks: at sentence ends, before capitals and before words that a hash of the
word and the one before chooses, about one in eight. Both occurrences of a passage are cut alike inside. A chunk is
short and repeats by chance, so it is judged together with its neighbours until they hold `passage_words` words: a
window. What a passage has before its first and behind its last cut stays. In scripts without spaces each character is
a word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import binary_text, fresh, lean, streamed_groups, tidy, written

#: Thai to Khmer, kana and Han, as code points: each of these characters is a word.
ALONE = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x9FFF))
_LONE = re.compile("[" + "".join(f"{chr(a)}-{chr(z)}" for a, z in ALONE) + "]")
#: Line ends in a row that part two units.
BREAKS = {"line": 1, "paragraph": 2}
_STOP = np.isin(np.arange(256), list(b".!?"))
BASES = (0xD1342543DE82EF95, 0xA0761D6478BD642F)


class _Hashes(dict):
    """64 bits of each word's MD5, remembered up to a number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = h = int.from_bytes(md5(word, usedforsecurity=False).digest()[:8], "big")
        return h


_hashes = _Hashes()


@dataclass
class Layout:
    """Texts side by side. starts and ends of the words in `raw`; the first word of each chunk, and one past the last;
    per chunk whether it begins a line and a unit; the first chunk of each text, and one past the last."""

    raw: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    chunks: np.ndarray
    line: np.ndarray
    unit: np.ndarray
    first: np.ndarray


def layout(texts: list[str], kind: str = "line") -> Layout:
    raws = [t.encode() for t in texts]
    bounds = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raws])]).astype(np.int64)
    raw = np.frombuffer(b"\n".join(raws) + b"\n", np.uint8)
    lower = "\n".join(texts).lower()
    space = (raw == 32) | (raw - np.uint8(9) < 5)
    apart = np.concatenate([[True], space])
    wide = np.flatnonzero(raw[:-2] & 0xF0 == 0xE0) if _LONE.search(lower) else ()
    if len(wide):
        point = (raw[wide].astype(np.int32) & 15) << 12 | (raw[wide + 1].astype(np.int32) & 63) << 6 | (raw[wide + 2].astype(np.int32) & 63)
        lone = wide[np.logical_or.reduce([(point >= a) & (point <= z) for a, z in ALONE])]
        apart[lone] = apart[lone + 3] = True
        lower = _LONE.sub(r" \g<0> ", lower)
    starts = np.flatnonzero(~space & apart[:-1])
    ends = np.flatnonzero(~space & np.concatenate([(space | apart[:-1])[1:], [True]])) + 1
    words = lower.encode().split()
    n = len(words)
    hashes = np.fromiter(map(_hashes.__getitem__, words), np.uint64, n)
    breaks = np.cumsum(raw == 10, dtype=np.int32)
    text = np.searchsorted(bounds, starts, side="right") - 1
    new = np.ones(n, bool)
    new[1:] = text[1:] != text[:-1]
    between = np.zeros(n, np.int32)
    between[1:] = breaks[starts[1:]] - breaks[ends[:-1] - 1]
    cut = new | (between > 0) | (raw[starts] - np.uint8(65) < 26)
    top = hashes >> np.uint64(32)
    cut[1:] |= _STOP[raw[ends[:-1] - 1]] | ((np.uint64(3) * top[:-1] + top[1:]) & np.uint64(7) == 0)
    at = np.flatnonzero(cut)
    return Layout(raw, bounds, starts, ends, hashes, np.append(at, n), (new | (between > 0))[at], (new | (between >= BREAKS[kind]))[at], np.searchsorted(text[at], np.arange(len(texts) + 1)))


def windows(own: Layout, least_words: int, passage_words: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(first chunk, one past the last) of every unit of at least `least_words` words, and of the shortest windows of
    `passage_words` or more that start or end at each chunk of a text, each once."""
    at, m = own.chunks, len(own.chunks) - 1
    heads = np.flatnonzero(own.unit)
    first, past = [heads], [np.append(heads[1:], m)[: len(heads)]]
    if passage_words and m:
        to = np.searchsorted(at, at[:-1] + passage_words)
        first.append(np.arange(m))
        past.append(to)
        first.append(np.searchsorted(at, at[1:] - passage_words, side="right") - 1)
        past.append(np.arange(1, m + 1))
    i, e = np.concatenate(first), np.concatenate(past)
    own_text = lambda chunk: np.searchsorted(own.first, chunk, side="right")
    inside = (i >= 0) & (e <= m)
    inside[inside] = own_text(i[inside]) == own_text(e[inside] - 1)
    inside[: len(heads)] &= at[e[: len(heads)]] - at[i[: len(heads)]] >= least_words
    pairs = np.unique(i[inside] * (m + 1) + e[inside])
    return pairs // (m + 1), pairs % (m + 1)


def digests(own: Layout, first: np.ndarray, past: np.ndarray) -> list[np.ndarray]:
    """A 64-bit and a 32-bit hash of the words of each window: polynomials of the word hashes, from running sums."""
    s, e = own.chunks[first], own.chunks[past]
    out = []
    for k, base in enumerate(BASES):
        h = own.hashes if not k else (own.hashes ^ own.hashes >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)
        up = lambda b: np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(len(h), b, np.uint64))])
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up(base)[:-1])])
        d = (sums[e] - sums[s]) * up(pow(base, -1, 1 << 64))[s]
        d = (d ^ d >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
        out.append(((d ^ d >> np.uint64(29)) >> np.uint64(32 * k)).view(np.int64))
    return out


def _portions(texts: pa.Array, most: int = 4 << 20) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Places and texts of those that are not blank, in portions of about `most` bytes; a longer text stands alone."""
    places: list[int] = []
    held: list[str] = []
    size = 0
    for r, v in enumerate(texts):
        raw = v.as_py()
        if size and size + len(raw) > most:
            yield np.array(places), held
            places, held, size = [], [], 0
        if raw and not raw.isspace():
            places.append(r)
            held.append(raw.decode())
            size += len(raw)
    if held:
        yield np.array(places), held


def _dealt(docs: DataFrame, kind: str, least_words: int, passage_words: int | None) -> DataFrame:
    """(h1, h2, id, mark, loc, gone): every window's 96-bit digest and place; gone: a repeat within the same portion.

    Of equal windows in a portion only the first goes on under its digest, so a line that a third of all documents
    hold meets as often as there are portions; the rest are repeats already and keep a key of their own.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ident, mark = (b.column(k).to_numpy() for k in (0, 1))
            for places, texts in _portions(b.column(2)):
                own = layout(texts, kind)
                first, past = windows(own, least_words, passage_words)
                if not len(first):
                    continue
                h1, h2 = digests(own, first, past)
                text = np.searchsorted(own.first, first, side="right") - 1
                row, place = places[text], (first - own.first[text]) << 24 | (past - first - 1)
                order = np.lexsort((place, ident[row], h2, h1))
                h1, h2, i, m, s = h1[order], h2[order], ident[row][order], mark[row][order], place[order]
                new = np.ones(len(order), bool)
                new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
                at = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
                gone = (i != i[at]) | (s != s[at])
                start = np.where(gone & (i == i[at]) & (m == m[at]), after(s[at]), -1)
                alone = (i.view(np.uint64) * np.uint64(0xD1342543DE82EF95) + s.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.where(gone, alone.view(np.int64), h1), h2, i, m, clipped(s, start), gone)], ["h1", "h2", "id", "mark", "loc", "gone"])

    return docs.mapInArrow(lean(spread), "h1 long, h2 long, id long, mark long, loc long, gone boolean")


def after(loc: np.ndarray) -> np.ndarray:
    """The chunk behind a window."""
    return (loc >> 24) + (loc & 0xFFFFFF) + 1


def clipped(loc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Windows without the chunks before `start`; -1 for a window that is used up."""
    first, last = loc >> 24, (loc >> 24) + (loc & 0xFFFFFF)
    first = np.maximum(first, start)
    return np.where(first > last, -1, first << 24 | np.maximum(last - first, 0))


def repeats(docs: DataFrame, kind: str, least_words: int, passage_words: int | None) -> DataFrame:
    """(id, mark, loc): windows, less what they share with the occurrence that stays, of which an earlier one exists."""

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in streamed_groups(batches, ["h1", "h2"]):
            n = len(g["h1"])
            new = np.zeros(n, bool)
            new[g["starts"]] = True
            first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
            i, m, s, known = g["id"], g["mark"], g["loc"], g["gone"].astype(bool)
            found = ~known & ((i != i[first]) | (s != s[first]))
            start = np.where(found & (i == i[first]) & (m == m[first]), after(s[first]), -1)
            loc = np.where(known, s, clipped(s, start))
            keep = (known | found) & (loc >= 0)
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (i, m, loc)], ["id", "mark", "loc"])

    rows = _dealt(docs, kind, least_words, passage_words)
    return rows.repartition("h1", "h2").sortWithinPartitions("h1", "h2", "id", "loc").mapInArrow(lean(settle), "id long, mark long, loc long")


def cut(texts: list[str], gone: list[np.ndarray], kind: str = "line") -> Iterator[tuple[str, int, list[tuple[int, int]]]]:
    """Each text without the chunks of its windows, the words that went, and the character ranges of the original. A run
    that starts a line takes the line end behind it along, any other only the blanks."""
    own = layout(texts, kind)
    for t, loc in enumerate(gone):
        a, z = int(own.bounds[t]), int(own.bounds[t + 1]) - 1
        base, m = int(own.first[t]), int(own.first[t + 1] - own.first[t])
        step = np.zeros(m + 1, np.int64)
        np.add.at(step, loc >> 24, 1)
        np.add.at(step, after(loc), -1)
        bad = np.concatenate([[0], np.cumsum(step[:-1]) > 0, [0]])
        edges = np.flatnonzero(np.diff(bad)) + base
        raw = own.raw[a:z].tobytes()
        chars = np.cumsum(np.frombuffer(raw, np.uint8) & 0xC0 != 0x80)
        char = lambda byte: int(chars[byte - 1]) if byte else 0  # noqa: B023, E731
        kept, words, spans, at = [], 0, [], 0
        for i, e in zip(edges[::2].tolist(), edges[1::2].tolist()):
            x = int(own.starts[own.chunks[i]]) - a
            y = int(own.ends[own.chunks[e] - 1]) - a
            if own.line[i]:
                y = int(own.starts[own.chunks[e]]) - a if e < base + m else len(raw)
            else:
                while y < len(raw) and raw[y] in b" \t":
                    y += 1
            kept.append(raw[at:x])
            words += int(own.chunks[e] - own.chunks[i])
            spans.append((char(x), char(y)))
            at = y
        yield b"".join([*kept, raw[at:]]).decode(), words, spans


def line_dedup(docs: DataFrame, ident: str = "doc_id", text: str = "text", kind: str = "line", least_words: int = 1, passage_words: int | None = 20) -> DataFrame:
    """docs with `text` less its repeated units and passages, and n_removed (words), removed (character ranges of the
    original).

    Every line (or, by `kind`, paragraph) of at least `least_words` words is a unit, and so is every window of
    `passage_words` words or a few more (None: no windows). Words are compared in lower case, white space does not
    matter. Digests are grouped globally; the occurrence with the smallest (ident, position) stays everywhere and all
    others go, but for what they share with the one that stays. Null ids rank last; of rows that repeat an id, equal
    texts are one occurrence and share their fate, other texts rank by position. A null text stays null; an empty
    table gives no rows. Columns of docs named like the new ones stay, and the new ones get underscores.

    The digests cross the network once, sorted; the text once, to meet what to remove.
    """
    n_removed, removed, key, mark, gone = fresh(docs, "n_removed", "removed", "key_", "mark_", "gone_")
    rank = F.coalesce(F.col(ident).cast("long"), F.lit(2**63 - 1))
    slim = docs.select(rank.alias("id"), F.xxhash64(text).alias("mark"), binary_text(text).alias("raw"))
    found = written(repeats(slim, kind, least_words, passage_words).groupBy("id", "mark").agg(F.collect_list("loc").alias("gone")), "windows")
    tidy(docs.sparkSession)
    found = found.select(F.col("id").alias(key), F.col("mark").alias(mark), F.col("gone").alias(gone))
    both = docs.withColumn(key, rank).withColumn(mark, F.xxhash64(text)).join(found, [key, mark], "left").select(*docs.columns, gone)
    schema = docs.withColumn(n_removed, F.lit(0).cast("long")).withColumn(removed, F.expr("array(named_struct('start', 0L, 'end', 0L))")).schema
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    at_text, names, width = docs.columns.index(text), schema.names, len(docs.columns)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, counts, spans = b.column(at_text).to_pylist(), [0] * b.num_rows, [[] for _ in range(b.num_rows)]
            hit = [r for r, d in enumerate(b.column(width)) if d.is_valid]
            while hit:
                some, size = [], 0
                while hit and (not some or size + len(texts[hit[-1]]) <= 4 << 20):
                    some.append(hit.pop())
                    size += len(texts[some[-1]])
                for r, (kept, words, ranges) in zip(some, cut([texts[r] for r in some], [b.column(width)[r].values.to_numpy() for r in some], kind)):
                    texts[r], counts[r], spans[r] = kept, words, [{"start": a, "end": z} for a, z in ranges]
            cols = [*b.columns[:width], pa.array(counts, pa.int64()), pa.array(spans, spans_type)]
            cols[at_text] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names)

    return both.mapInArrow(lean(apply), schema)
