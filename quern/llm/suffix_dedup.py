"""Exact substring dedup over sparse suffixes: anchors, sampled range partitions, multikey quicksort, boundaries.

A 100-byte string is judged by one designated suffix inside it, its anchor: the leftmost position whose `GRAM`-byte
hash is smallest in the string. Equal strings hold equal anchors at equal places, so it is enough to sort the suffixes
at anchors (about one position in 35) instead of all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import binary_text, lean, streamed_groups, tidy, written

#: Bytes that an anchor is chosen by; a string of `length` bytes has length - GRAM + 1 candidates.
GRAM = 32
#: Bytes looked at together, at most: a place within fits into the low bits of a key.
SEGMENT = 1 << 20
LOW = np.uint64(SEGMENT - 1)
BASE = 0xD1342543DE82EF95
TOP = np.uint64(1 << 63)
#: What the suffixes are sorted by: leading tokens, the hash of GRAM bytes, the digest of all bytes of the run, the place.
KEY = ("t1", "t2", "gram", "digest", "id", "loc")


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2^64."""
    up = lambda b: np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(SEGMENT, b, np.uint64))])
    return up(BASE), up(pow(BASE, -1, 1 << 64))


def anchors(buf: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(gram hash of each position, anchor of the string at each start) of at most SEGMENT bytes."""
    power, inverse = _powers()
    n, width = len(buf), length - GRAM + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
    h = (sums[GRAM:] - sums[:-GRAM]) * inverse[: n - GRAM + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    least = (h & ~LOW) | np.arange(len(h), dtype=np.uint64)
    span = 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    return h, (least & LOW).astype(np.int64)


def runs(texts: list[bytes], length: int) -> Iterator[dict[str, np.ndarray]]:
    """Runs of string starts with one anchor: t1 and t2 (the leading tokens of the suffix at the anchor, 8 bytes each, as
    signed numbers in the order of their bytes), doc (place in texts), lo, span (last start less lo), at (anchor less lo),
    gram, and the digest of all bytes that the run's strings cover."""
    held: list[int] = []
    size = 0

    def emit(docs: list[int], data: bytes, ends: np.ndarray, shift: int) -> dict[str, np.ndarray] | None:
        if len(data) < length:
            return None
        h, anchor = anchors(np.frombuffer(data, np.uint8), length)
        start = np.arange(len(anchor))
        doc = np.searchsorted(ends, start, side="right")
        inside = start + length <= ends[doc]
        start, anchor, doc = start[inside], anchor[inside], doc[inside]
        if not len(start):
            return None
        new = np.flatnonzero((np.diff(anchor, prepend=-1) != 0) | (np.diff(doc, prepend=-1) != 0))
        lo, hi, at = start[new], start[np.append(new[1:], len(start)) - 1], anchor[new]
        digest = [xxhash.xxh3_64_intdigest(data[a:z]) for a, z in zip(lo.tolist(), (hi + length).tolist())]
        begins = np.concatenate([[0], ends[:-1]])
        own = doc[new]
        lead = np.frombuffer(data, np.uint8)[at[:, None] + np.arange(16)].view(">u8").astype(np.uint64) ^ TOP
        return {"t1": lead[:, 0], "t2": lead[:, 1], "doc": np.array(docs)[own], "lo": lo - begins[own] + shift, "span": hi - lo, "at": at - lo, "gram": h[at], "digest": np.array(digest, np.uint64)}

    def together() -> dict[str, np.ndarray] | None:
        return emit(held, b"".join(texts[i] for i in held), np.cumsum([len(texts[i]) for i in held]), 0) if held else None

    for i, t in enumerate(texts):
        if len(t) < length:
            continue
        if size + len(t) > SEGMENT:
            if (r := together()) is not None:
                yield r
            held, size = [], 0
        if len(t) <= SEGMENT:
            held.append(i)
            size += len(t)
            continue
        for a in range(0, len(t) - length + 1, SEGMENT - length + 1):
            part = t[a : a + SEGMENT]
            if (r := emit([i], part, np.array([len(part)]), a)) is not None:
                yield r
    if (r := together()) is not None:
        yield r


def multikey_quicksort(words: np.ndarray, small: int = 256) -> np.ndarray:
    """The order that sorts the rows of `words` (tokens of a string each, most significant first), ties in input order.

    Three-way partitions around one token: rows with a smaller or larger token go on at the same token, equal ones at
    the next, so no token that is settled is compared again.
    """
    n, depth = words.shape
    out = np.empty(n, np.int64)
    stack = [(np.arange(n), 0, 0)]
    while stack:
        rows, d, at = stack.pop()
        if len(rows) <= small or d >= depth:
            if d < depth and len(rows) > 1:
                rows = rows[np.lexsort(words[rows, d:].T[::-1])]
            out[at : at + len(rows)] = rows
            continue
        v = words[rows, d]
        pivot = np.sort(v[[0, len(v) // 2, -1]])[1]
        less, more = v < pivot, v > pivot
        a, c = rows[less], rows[more]
        b = rows[~(less | more)]
        stack += [(a, d, at), (b, d + 1, at + len(a)), (c, d, at + len(a) + len(b))]
    return out


def tokens(data: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """The strings data[start : start + length] as rows of big-endian 8-byte tokens."""
    wide = -(-length // 8) * 8
    m = np.zeros((len(start), wide), np.uint8)
    m[:, :length] = data[start[:, None] + np.arange(length)]
    return m.view(">u8").astype(np.uint64)


def later(words: np.ndarray, ident: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Which strings equal one with a smaller (ident, lo)."""
    order = np.lexsort((lo, ident))
    order = order[multikey_quicksort(words[order])]
    w, i, s = words[order], ident[order], lo[order]
    new = np.ones(len(order), bool)
    new[1:] = (w[1:] != w[:-1]).any(axis=1)
    first = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    out = np.zeros(len(order), bool)
    out[order] = (i != i[first]) | (s != s[first])
    return out


def packed(lo: np.ndarray, span: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (lo << 18) | (span << 9) | at


def unpacked(loc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return loc >> 18, (loc >> 9) & 511, loc & 511


def _batch(names: str, *cols: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(np.ascontiguousarray(c)) for c in cols], names.split())


def _texts(b: pa.RecordBatch, most: int = 4 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """Ids, text hashes and texts of a batch, in parts."""
    ident, mark = (b.column(k).to_numpy() for k in (0, 1))
    held, size, at = [], 0, 0
    for i, v in enumerate(b.column(2)):
        held.append(v.as_py())
        size += len(held[-1])
        if size >= most or i == b.num_rows - 1:
            yield ident[at : i + 1], mark[at : i + 1], held
            held, size, at = [], 0, i + 1


def splitters(docs: DataFrame, length: int, buckets: int, sample: int, per_bucket: int = 20) -> np.ndarray:
    """The keys, as rows of signed numbers, that cut the suffixes of a hash sample of documents into equal buckets."""
    n = max(docs.count(), 1)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ident, _, texts in _texts(b):
                for r in runs(texts, length):
                    yield _batch(" ".join(KEY), *[r[k].view(np.int64) for k in KEY[:4]], ident[r["doc"]], packed(r["lo"], r["span"], r["at"]))

    drawn = docs.where(F.pmod(F.xxhash64("id", "mark", F.lit(9)), F.lit(n)) < sample).mapInArrow(lean(keys), ", ".join(f"{k} long" for k in KEY))
    t = drawn.orderBy(F.xxhash64("gram", "digest", "id", "loc")).limit(buckets * per_bucket).toArrow()
    own = np.stack([t[k].to_numpy() for k in KEY], axis=1) if t.num_rows else np.zeros((0, len(KEY)), np.int64)
    own = own[np.lexsort(own.T[::-1])]
    return own[np.unique(np.linspace(0, len(own), buckets + 1).astype(int)[1:-1])] if len(own) > buckets else own[:0]


def bucket_of(rows: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """How many of the cuts are no larger than each row."""
    both = np.concatenate([cuts, rows])
    is_cut = np.arange(len(both)) < len(cuts)
    order = np.lexsort([~is_cut, *both.T[::-1]])
    out = np.empty(len(both), np.int64)
    out[order] = np.cumsum(is_cut[order])
    return out[len(cuts) :]


def _dealt(docs: DataFrame, length: int, cuts: np.ndarray) -> DataFrame:
    """(bucket, KEY, mark, gone): the runs of all documents in their buckets; gone: a repeat of another in the same
    slice. Those need no comparison any more and go to any bucket, so copies of one run meet as often as there are
    slices and not as there are copies.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ident, mark, texts in _texts(b):
                found = list(runs(texts, length))
                if not found:
                    continue
                c = {k: np.concatenate([f[k] for f in found]) for k in found[0]}
                rows = np.stack([*[c[k].view(np.int64) for k in KEY[:4]], ident[c["doc"]], packed(c["lo"], c["span"], c["at"])], axis=1)
                order = np.lexsort(rows.T[::-1])
                rows = rows[order]
                new = np.ones(len(rows), bool)
                new[1:] = (rows[1:, :4] != rows[:-1, :4]).any(axis=1)
                first = np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))
                gone = (rows[:, 4:] != rows[first, 4:]).any(axis=1)
                other = (rows[:, 4].view(np.uint64) * np.uint64(BASE) + rows[:, 5].view(np.uint64)) >> np.uint64(17)
                bucket = np.where(gone, (other % np.uint64(len(cuts) + 1)).astype(np.int64), bucket_of(rows, cuts))
                yield _batch("bucket " + " ".join(KEY) + " mark gone", bucket.astype(np.int32), *rows.T, mark[c["doc"]][order], gone)

    return docs.mapInArrow(lean(spread), "bucket int, " + ", ".join(f"{k} long" for k in KEY) + ", mark long, gone boolean")


def _settled(rows: DataFrame, buckets: int, most: int) -> DataFrame:
    """(id, mark, loc, kind, edge, lead, note) of runs that are repeats (kind 0) or share their gram with other bytes (1;
    2: with over `most` runs), judged in their buckets, which hold the suffixes between two splitters.

    A bucket arrives in the order of the first token; multikey quicksort orders it by all tokens. Its first and its last
    gram may go on in the buckets beside it: their runs come marked (edge 1, 2 or 3; lead: of the bucket's first digest;
    kind -2: no repeat and nothing to share a gram with so far), with a note of the bucket's ends (kind -1).
    """

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, waiting, ends = None, None, []

        def known() -> Iterator[pa.RecordBatch]:
            nonlocal bucket
            for b in batches:
                if b.num_rows:
                    bucket = b.column(0)[0].as_py()
                    gone = b.column(8).to_numpy(zero_copy_only=False)
                    at = pa.array(np.flatnonzero(gone))
                    n = len(at)
                    held.append(_batch(NAMES, b.column(5).take(at), b.column(7).take(at), b.column(6).take(at), np.zeros(n, np.int32), np.zeros(n, np.int32), np.zeros(n, bool), pa.nulls(n, pa.binary())))
                    yield b.filter(pa.array(~gone))

        held: list[pa.RecordBatch] = []
        for g in streamed_groups(known(), ["t1"]):
            yield from held
            held.clear()
            order = np.lexsort((g["loc"], g["id"]))
            words = np.stack([g[k][order].view(np.uint64) for k in KEY[:4]], axis=1)
            to = multikey_quicksort(words)
            words, order = words[to], order[to]
            i, m, s = (g[k][order] for k in ("id", "mark", "loc"))
            gram, run = (np.concatenate([[True], (words[1:, :k] != words[:-1, :k]).any(axis=1)]) for k in (3, 4))
            group, at = np.cumsum(gram) - 1, np.arange(len(i))
            first = np.maximum.accumulate(np.where(run, at, 0))
            gone = (i != i[first]) | (s != s[first])
            size = np.bincount(group)[group]
            kinds = np.bincount(group, run)[group].astype(np.int64)
            kind = np.where(gone, 0, np.where(kinds > 1, np.where(size > most, 2, 1), -2)).astype(np.int32)
            edge, lead = np.zeros(len(i), np.int32), np.zeros(len(i), bool)
            if not ends:
                edge[group == 0] = 1
                lead = (group == 0) & (np.cumsum(run) == 1)
                ends = [[*words[0].view(np.int64), i[0], s[0], kinds[0], size[0]], None]
            ends[1] = [*words[-1].view(np.int64), i[first[-1]], s[first[-1]], kinds[-1], size[-1]]
            if waiting is not None:
                yield _found(*waiting)
            waiting = (i, m, s, kind, edge, lead, group == group[-1])
        yield from held
        if waiting is not None:
            waiting[4][waiting[6]] |= 2
            yield _found(*waiting)
            note = np.array([bucket, *ends[0], *ends[1], int((waiting[4] == 3).any())], np.int64).tobytes()
            yield _batch(NAMES, *[np.zeros(1, np.int64)] * 3, np.full(1, -1, np.int32), np.zeros(1, np.int32), np.zeros(1, bool), pa.array([note], pa.binary()))

    dealt = rows.repartitionById(buckets, "bucket").sortWithinPartitions("t1")
    return dealt.mapInArrow(lean(settle), "id long, mark long, loc long, kind int, edge int, lead boolean, note binary")


NAMES = "id mark loc kind edge lead note"


def _found(i, m, s, kind, edge, lead, _) -> pa.RecordBatch:
    keep = np.flatnonzero((kind >= 0) | (edge > 0))
    return _batch(NAMES, i[keep], m[keep], s[keep], kind[keep], edge[keep], lead[keep], pa.nulls(len(keep), pa.binary()))


def boundaries(notes: list[np.ndarray]) -> dict[int, tuple[int, int, int, int, int, int, int]]:
    """bucket -> (known, id, loc, shared, runs, shared, runs): whether the bucket's first digest goes on from buckets
    before it, and the place of that digest's first run there; then, for its first and for its last gram, whether runs
    of other digests have it in any bucket, and how many runs have it. The notes are those of _settled()."""
    out: dict[int, list[int]] = {}
    chain: dict | None = None

    def close(c: dict | None) -> None:
        for bucket, places in c["parts"] if c else ():
            for p in places:
                out[bucket][p : p + 2] = [int(c["shared"]), c["runs"]]

    for note in sorted(notes, key=lambda x: x[0]):
        bucket, single = int(note[0]), bool(note[17])
        first, last = note[1:9].tolist(), note[9:17].tolist()
        out[bucket] = [0, 0, 0, 0, 0, 0, 0]
        if chain and chain["gram"] == first[:3]:
            if chain["digest"] == first[3]:
                out[bucket][:3] = [1, *chain["keeper"]]
            else:
                chain["shared"] = True
            chain["shared"] |= first[6] > 1
            chain["runs"] += first[7]
        else:
            close(chain)
            chain = {"gram": first[:3], "shared": first[6] > 1, "runs": first[7], "parts": []}
        chain["parts"].append((bucket, (3, 5) if single else (3,)))
        if single:
            chain["keeper"] = out[bucket][1:3] if out[bucket][0] and first[6] == 1 else last[4:6]
            chain["digest"] = last[3]
        else:
            close(chain)
            chain = {"gram": last[:3], "shared": last[6] > 1, "runs": last[7], "parts": [(bucket, (5,))], "digest": last[3], "keeper": last[4:6]}
    close(chain)
    return {b: tuple(x) for b, x in out.items()}


def _compared(found: DataFrame, most: int) -> DataFrame:
    """(id, mark, loc, kind) of _settled(), with what goes on across the ends of buckets compared. Each bucket tells of
    its ends in one note, so the driver sees as many rows as there are buckets."""
    ends = boundaries([np.frombuffer(r[0], np.int64) for r in found.where("kind = -1").select("note").collect()])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i, m, s, kind, edge = (b.column(k).to_numpy() for k in range(5))
            lead = b.column(5).to_numpy(zero_copy_only=False)
            own = np.array([ends[x] for x in b.column(6).to_pylist()], np.int64).reshape(-1, 7)
            gone = np.where(lead & (own[:, 0] == 1), (i != own[:, 1]) | (s != own[:, 2]), kind == 0)
            at_first = (edge & 1) == 1
            shared, n = np.where(at_first, own[:, 3], own[:, 5]), np.where(at_first, own[:, 4], own[:, 6])
            kind = np.where(gone, 0, np.where(shared == 1, np.where(n > most, 2, 1), -2)).astype(np.int32)
            keep = np.flatnonzero(kind >= 0)
            yield _batch("id mark loc kind", i[keep], m[keep], s[keep], kind[keep])

    inside = found.where("edge = 0 AND kind >= 0").select("id", "mark", "loc", "kind")
    edges = found.where("edge > 0").select("id", "mark", "loc", "kind", "edge", "lead", "bucket")
    return inside.union(edges.mapInArrow(lean(compare), "id long, mark long, loc long, kind int"))


def _blocks(docs: DataFrame, partial: DataFrame, length: int) -> DataFrame:
    """(key, bytes, id, mark, loc, kind): unsettled runs with their bytes. The key is the suffix's leading tokens; a
    run of a hot gram gives each string alone, and is keyed by all of it."""
    wanted = partial.groupBy("id", "mark").agg(F.collect_list(F.struct("loc", "kind")).alias("runs"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                ident, mark, raw = (b.column(k)[r].as_py() for k in range(3))
                own = b.column(3)[r].values
                lo, span, at = unpacked(own.field("loc").to_numpy())
                hot = own.field("kind").to_numpy() == 2
                for part in (~hot, hot):
                    a, n, p = lo[part], span[part], at[part]
                    if part is hot:
                        a, p = np.repeat(a, n + 1) + np.arange((n + 1).sum()) - np.repeat(np.cumsum(n + 1) - (n + 1), n + 1), None
                        n, p = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
                    wide = length if part is hot else GRAM
                    for c in range(0, len(a), 4096):
                        x, y, z = a[c : c + 4096], n[c : c + 4096], p[c : c + 4096]
                        keys = [raw[i : i + wide] for i in (x + z).tolist()]
                        data = [raw[i:j] for i, j in zip(x.tolist(), (x + y + length).tolist())]
                        k = len(x)
                        yield _batch("key bytes id mark loc kind", pa.array(keys, pa.binary()), pa.array(data, pa.binary()), np.full(k, ident), np.full(k, mark), packed(x, y, z), np.full(k, 2 if part is hot else 1, np.int32))

    return docs.join(wanted, ["id", "mark"]).select("id", "mark", "raw", "runs").mapInArrow(lean(fetch), "key binary, bytes binary, id long, mark long, loc long, kind int")


def _judge(t: pa.Table, length: int, offset: int | None = None) -> Iterator[pa.RecordBatch]:
    """Repeats among the strings of these blocks (of those that begin `offset` before their anchor)."""
    col = t["bytes"].combine_chunks()
    begin = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col)].astype(np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8)
    ident, mark = t["id"].to_numpy(), t["mark"].to_numpy()
    lo, span, at = unpacked(t["loc"].to_numpy())
    if offset is None:
        block = np.repeat(np.arange(len(lo)), span + 1)
        step = np.arange(len(block)) - np.repeat(np.cumsum(span + 1) - (span + 1), span + 1)
    else:
        block = np.flatnonzero((at >= offset) & (at - offset <= span))
        step = at[block] - offset
    if not len(block):
        return
    start = lo[block] + step
    hit = np.flatnonzero(later(tokens(data, begin[block] + step, length), ident[block], start))
    if len(hit):
        cut = np.ones(len(hit), bool)
        cut[1:] = (block[hit][1:] != block[hit][:-1]) | (start[hit][1:] != start[hit][:-1] + 1)
        a = np.flatnonzero(cut)
        z = np.append(a[1:], len(hit)) - 1
        own = block[hit][a]
        yield _batch("id mark lo hi", ident[own], mark[own], start[hit][a], start[hit][z])


def _sorted_buckets(blocks: DataFrame, length: int, most: int = 2048) -> DataFrame:
    """Repeats among the strings of blocks with equal leading tokens, which never lie in two buckets. A bucket is
    worked through in parts of about `most` blocks; more blocks of one key go one place of the anchor at a time."""

    def bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(parts)
            if t.num_rows <= 2 * most:
                yield from _judge(t, length)
            else:
                for o in range(length - GRAM + 1):
                    yield from _judge(t, length, o)

        for whole in batches:
            for c in range(0, whole.num_rows, most):
                b = whole.slice(c, most)
                keys = np.array([v.as_py() for v in b.column(0)], object)
                new = np.flatnonzero(keys[1:] != keys[:-1]) + 1
                if held and held[-1].column(0)[-1].as_py() != keys[0]:
                    new = np.concatenate([[0], new])
                if not len(new):
                    held.append(b)
                    continue
                parts = [*held, *([b.slice(0, int(new[-1]))] if new[-1] else [])]
                if parts:
                    yield from flush(parts)
                held = [b.slice(int(new[-1]))]
        if held:
            yield from flush(held)

    return blocks.repartitionByRange("key").sortWithinPartitions("key").drop("kind").mapInArrow(lean(bucket), "id long, mark long, lo long, hi long")


def _across_boundaries(blocks: DataFrame, length: int) -> DataFrame:
    """Repeats among single strings that range partitions of (string, id, start) may part.

    Each bucket settles its own strings but the first ones, which may continue the bucket before; the first and last
    string of every bucket, one small row each, tell which do.
    """
    dealt = blocks.withColumn("lo", F.shiftright("loc", 18)).select("key", "id", "mark", "lo")
    dealt = written(dealt.repartitionByRange("key", "id", "lo").sortWithinPartitions("key", "id", "lo").withColumn("bucket", F.spark_partition_id()), "strings")
    row = F.struct("id", "lo")
    runs_ = dealt.groupBy("bucket", "key").agg(F.min(row).alias("first"))
    ends = runs_.groupBy("bucket").agg(F.min(F.struct("key", "first")).alias("low"), F.max(F.struct("key", "first")).alias("high"))
    keeper, before = {}, None
    for r in sorted(ends.collect(), key=lambda r: (r["low"]["key"], r["low"]["first"])):
        start = before[1] if before and before[0] == r["low"]["key"] else r["low"]["first"]
        keeper[r["bucket"]] = (bytes(r["low"]["key"]), start[0], start[1])
        before = (r["high"]["key"], start if r["high"]["key"] == r["low"]["key"] else r["high"]["first"])
    known = blocks.sparkSession.createDataFrame([(b, bytearray(k), i, s) for b, (k, i, s) in keeper.items()], "bucket int, key binary, id0 long, lo0 long")
    firsts = runs_.join(F.broadcast(known), ["bucket", "key"], "left").select("bucket", "key", F.coalesce("id0", "first.id").alias("id0"), F.coalesce("lo0", "first.lo").alias("lo0"))
    return dealt.join(firsts, ["bucket", "key"]).where("id <> id0 OR lo <> lo0").select("id", "mark", "lo", F.col("lo").alias("hi"))


def repeats(docs: DataFrame, length: int = 100, sample: int = 2000, bucket_rows: int = 1_000_000, most_buckets: int = 100_000, most: int = 300_000) -> DataFrame:
    """(id, mark, lo, hi): runs of starts whose `length`-byte string starts earlier too, from (id, mark, raw) rows.

    1. Every document gives its runs, each under the suffix at its anchor. Splitters from a hash sample of documents
       cut the suffixes, ordered by leading tokens, gram, digest of the run and place, into buckets of about
       `bucket_rows`, through equal suffixes too, so that none is large however often a passage occurs. A bucket sorts
       by multikey quicksort. Of equal runs all but the first are repeats as a whole; a run whose gram no other bytes
       share is settled. What starts or ends a bucket is compared across its boundaries.
    2. Runs that share a gram with other bytes fetch their bytes from the text. Their suffixes are range-partitioned by
       leading tokens again, and each bucket sorts the single strings by multikey quicksort.
    3. Runs of a gram that over `most` runs have never come together by gram. They give their strings singly,
       range-partitioned by the whole string and place, and the ends of those buckets are compared as well.

    Runs are equal if 16 leading bytes, a 64-bit hash of GRAM bytes and a 64-bit digest of all their bytes are.
    """
    size = docs.agg(F.sum(F.octet_length("raw"))).first()[0] or 0
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = min(most_buckets, max(least, size // 30 // bucket_rows))
    cuts = splitters(docs, length, buckets, max(sample, buckets))
    settled = _settled(_dealt(docs, length, cuts), len(cuts) + 1, most)
    settled = written(settled.withColumn("bucket", F.spark_partition_id()), "runs")
    tidy(docs.sparkSession)
    found = _compared(settled, most)
    lo, span = F.shiftright("loc", 18), F.shiftright("loc", 9).bitwiseAND(511)
    out = found.where("kind = 0").select("id", "mark", lo.alias("lo"), (lo + span).alias("hi"))
    blocks = written(_blocks(docs, found.where("kind > 0"), length), "blocks")
    tidy(docs.sparkSession)
    out = out.union(_sorted_buckets(blocks.where("kind = 1"), length))
    return out.union(_across_boundaries(blocks.where("kind = 2"), length))


def dedup(docs: DataFrame, ident: str = "doc_id", text: str = "text", length: int = 100, **how) -> DataFrame:
    """(ident, n_bytes, n_removed, n_spans, spans, kept): each document less the bytes of every `length`-byte string
    that starts earlier as well (smaller ident, or same document and earlier start), judged on the input.

    Texts are UTF-8 bytes and matches stay inside one document; `kept` is binary, as a span may end inside a
    character; `spans` are byte ranges of the original text. Null text counts as empty; null ids rank last. Rows that
    repeat an id rank by start alone, and of identical rows neither is earlier. An empty table gives no rows.
    """
    if not GRAM <= length <= GRAM + 479:
        raise ValueError(f"length must be {GRAM} to {GRAM + 479}: places in a run have nine bits")
    own = docs.select(F.col(ident).alias("doc"), F.coalesce(F.col(ident).cast("long"), F.lit(2**63 - 1)).alias("id"), F.xxhash64(text).alias("mark"), binary_text(text).alias("raw"))
    found = repeats(own.select("id", "mark", "raw").where(F.octet_length("raw") >= length), length, **how)
    by_doc = found.groupBy("id", "mark").agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))
    both = own.join(by_doc, ["id", "mark"], "left").select("doc", "raw", "runs")
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    schema = both.selectExpr("doc", "0L as n_bytes", "0L as n_removed", "0L as n_spans", "array(named_struct('start', 0L, 'end', 0L)) as spans", "raw as kept").schema

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple[int, int, list[dict[str, int]], bytes]] = []
            for r in range(b.num_rows):
                raw, spans, kept = b.column(1)[r].as_py(), [], []
                if b.column(2)[r].is_valid:
                    v = b.column(2)[r].values
                    lo, hi = v.field("lo").to_numpy(), v.field("hi").to_numpy() + length
                    order = np.argsort(lo, kind="stable")
                    lo, reach = lo[order], np.maximum.accumulate(hi[order])
                    new = np.flatnonzero(np.concatenate([[True], lo[1:] > reach[:-1]]))
                    spans = [{"start": int(a), "end": int(z)} for a, z in zip(lo[new], reach[np.append(new[1:], len(lo)) - 1])]
                at = 0
                for x in spans:
                    kept.append(raw[at : x["start"]])
                    at = x["end"]
                kept.append(raw[at:])
                rows.append((len(raw), sum(x["end"] - x["start"] for x in spans), spans, b"".join(kept)))
            if rows:
                n, gone, spans, kept = zip(*rows)
                cols = [b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array([len(x) for x in spans], pa.int64()), pa.array(spans, spans_type), pa.array(kept, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, schema.names)

    return both.mapInArrow(lean(cut), schema).withColumnRenamed("doc", ident)


def brute_force(texts: list[tuple[int, bytes]], length: int) -> dict[int, tuple[int, int, int, str]]:
    """What dedup() must give for distinct ids: id -> (n_bytes, n_removed, n_spans, sha256 of what is kept)."""
    seen: set[bytes] = set()
    out = {}
    for ident, raw in sorted(texts):
        bad = np.zeros(len(raw) + 1, bool)
        for s in range(len(raw) - length + 1):
            if (x := raw[s : s + length]) in seen:
                bad[s : s + length] = True
            else:
                seen.add(x)
        edges = np.flatnonzero(np.diff(bad.astype(int), prepend=0) == 1)
        kept = bytes(np.frombuffer(raw, np.uint8)[~bad[: len(raw)]])
        out[ident] = (len(raw), int(bad.sum()), len(edges), hashlib.sha256(kept).hexdigest())
    return out
