"""SimHash near-duplicates by covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import binary_text, discard, fresh, lean, slices, streamed_groups, tidy, written
from .components import components

BITS = 64


def shingle_hashes(raw: bytes, words: int = 4, seed: int = 42) -> Iterator[np.ndarray]:
    """XXH64 of each `words`-word shingle of the ASCII-lower-cased bytes, in blocks; fewer words: the whole sequence."""
    units = raw.lower().split()
    if not units:
        return
    joined = b" ".join(units)
    size = np.fromiter(map(len, units), np.int64, len(units))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    n = max(1, len(units) - words + 1)
    heads, tails = starts[:n].tolist(), ends[min(words, len(units)) - 1 :].tolist()
    h = xxhash.xxh64_intdigest
    for a in range(0, n, 65536):
        part = [h(joined[x:y], seed) for x, y in zip(heads[a : a + 65536], tails[a : a + 65536])]
        yield np.array(part, np.uint64)


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit (bit 63 first)."""
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    total = np.zeros(BITS, np.int64)
    for a in range(0, len(bits), 255):
        total += bits[a : a + 255].sum(axis=0, dtype=np.uint8)
    return total


#: A family of fingerprints: words per shingle and a salt; without one the bits are those of XXH64 itself.
Family = tuple[int, int | None]
#: The fingerprint of the contract alone.
PLAIN: tuple[Family, ...] = ((4, None),)
#: Fingerprints of other random bits. Documents whose five-word shingles agree to 0.8 differ in about 8 of 64 bits at
#: four words but in about 5 at two, where unrelated ones still differ in 13 or more; each further fingerprint is
#: another draw, and a pair that any of them brings within the radius is linked.
WIDE: tuple[Family, ...] = tuple((2, salt) for salt in range(1, 9))


def _salted(hashes: np.ndarray, salt: int | None) -> np.ndarray:
    if salt is None:
        return hashes
    x = hashes * np.uint64((2 * salt + 1) * 0x9E3779B97F4A7C15 % 2**64 | 1)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def fingerprint(raw: bytes, families: tuple[Family, ...] = PLAIN, seed: int = 42) -> list[int]:
    """Per family: bit i is 1 if it is set in over half the shingle hashes; no words: 0."""
    total, n = np.zeros((len(families), BITS), np.int64), dict.fromkeys((w for w, _ in families), 0)
    for words in n:
        for part in shingle_hashes(raw, words, seed):
            n[words] += len(part)
            for k, (w, salt) in enumerate(families):
                if w == words:
                    total[k] += _ones(_salted(part, salt))
    return [int.from_bytes(np.packbits(2 * t > n[w]).tobytes(), "big") for t, (w, _) in zip(total, families)]


def fingerprints(docs: DataFrame, text: str = "text", families: tuple[Family, ...] = PLAIN, seed: int = 42, names: list[str] | None = None) -> DataFrame:
    """docs without `text`, with a 64-bit fingerprint per family as signed longs. Null text counts as empty: all 0."""
    rest = [c for c in docs.columns if c != text]
    names = names or [f"fp{k}" for k in range(len(families))]
    (raw,) = fresh(docs, "raw")
    slim = docs.select(*rest, binary_text(text).alias(raw))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, raw):
                fps = np.array([fingerprint(v.as_py(), families, seed) for v in part.column(len(rest))], np.uint64).view(np.int64)
                cols = [pa.array(np.ascontiguousarray(fps[:, k])) for k in range(len(families))] if len(fps) else [pa.array([], pa.int64())] * len(families)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(rest)], *cols], [*rest, *names])

    return slim.mapInArrow(lean(add), slim.drop(raw).select("*", *[F.lit(0).cast("long").alias(n) for n in names]).schema)


def covering_masks(radius: int, bits: int = BITS, seed: int = 11) -> list[int]:
    """2^(radius+1)-1 masks such that any `radius` or fewer bit positions are all outside at least one of them.

    Each position gets a vector over GF(2) of radius+1 components; mask v keeps the positions whose vector has an odd
    inner product with v. Up to `radius` vectors always leave a non-zero v orthogonal to all of them, so a pair that
    differs in those positions only agrees under mask v, for certain and not just probably.
    """
    rng = np.random.default_rng(seed)
    every = np.arange(1, 2 ** (radius + 1))
    vectors = np.concatenate([rng.permutation(every) for _ in range(-(-bits // len(every)))])[:bits]
    return [sum(1 << i for i, x in enumerate(vectors) if bin(int(x) & int(v)).count("1") % 2) for v in every]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def spanning(fps: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links, as places, that join exactly the values of `fps` (distinct) connected within `radius`: at most len(fps)-1.

    Breadth first: what one value reaches leaves the pool, so a dense bucket costs about one pass and never all pairs.
    """
    pool = np.arange(len(fps))
    while len(pool):
        front, pool = pool[:1], pool[1:]
        while len(front) and len(pool):
            at, front = front[0], front[1:]
            near = np.bitwise_count(np.bitwise_xor(fps[pool], fps[at])) <= radius
            if near.any():
                got = pool[near]
                yield np.full(len(got), at), got
                front, pool = np.concatenate([front, got]), pool[~near]


def links(entries: DataFrame, masks: list[int], radius: int = 4, dense: int = 20_000) -> DataFrame:
    """(u, v): pairs of different roots that connect the roots exactly as all pairs of fingerprints of one family within
    `radius` bits that agree under one of the masks would; entries: (family, fp, root), a row per (family, fp).

    Every fingerprint goes to one bucket per mask. A bucket whose fingerprints have one root has nothing to tell. One
    of over `dense` fingerprints is split again by a second family of covering masks over its free bits, which keeps
    the guarantee; a bucket still that large lies in a small ball, where breadth-first linking takes about one pass.
    """
    second = covering_masks(radius, seed=12)
    each = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("m")) for t, m in enumerate(masks)])
    keyed = entries.select("family", "fp", "root", F.explode(each).alias("b")).select(F.xxhash64("family", "b.t", "b.m").alias("k"), "fp", "root")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in streamed_groups(batches, ["k"]):
            f, root, s = g["fp"].view(np.uint64), g["root"], g["starts"]
            ends = np.append(s[1:], len(f))
            several = np.flatnonzero(np.minimum.reduceat(root, s) != np.maximum.reduceat(root, s))
            us, vs = [], []
            for a, z in zip(s[several], ends[several]):
                own, of = f[a:z], root[a:z]
                if z - a == 2:
                    if int(own[0] ^ own[1]).bit_count() <= radius:
                        us.append(of[:1])
                        vs.append(of[1:])
                    continue
                for part in _parts(own, second, dense):
                    for u, v in spanning(own[part], radius):
                        us.append(of[part[u]])
                        vs.append(of[part[v]])
            if us:
                u, v = np.concatenate(us), np.concatenate(vs)
                pairs = np.unique(np.stack([np.maximum(u, v), np.minimum(u, v)], axis=1)[u != v], axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, k])) for k in (0, 1)], ["u", "v"])

    bucketed = keyed.repartition("k").sortWithinPartitions("k")
    return bucketed.mapInArrow(lean(split), "u long, v long").distinct()


def _parts(own: np.ndarray, second: list[int], dense: int) -> Iterator[np.ndarray]:
    """Places in `own`, in parts that hold every pair of it that agrees under one of the second masks."""
    if len(own) <= dense:
        yield np.arange(len(own))
        return
    free = np.bitwise_or.reduce(own ^ own[0])
    for m in second:
        key = own & (np.uint64(m) & free)
        order = np.argsort(key, kind="stable")
        cuts = np.flatnonzero(np.diff(key[order])) + 1
        for part in np.split(order, cuts):
            if len(part) > 1:
                yield part


def classes(fps: DataFrame, rank: Column | str, names: list[str], radius: int = 4, first: int = 8, dense: int = 20_000) -> DataFrame:
    """(names, least): for each distinct row of fingerprints the smallest non-null `rank` of its component.

    Rows are linked if they share a fingerprint of any family or have two within the radius. They are the nodes of the
    graph. The first few masks, and the fingerprints that rows share, join nearly all that belongs together; the other
    masks then link only what these left apart, so links stay few however many fingerprints lie close together.
    """
    node = F.col(names[0]) if len(names) == 1 else F.xxhash64(*names)
    rows = written(fps.groupBy(*names).agg(F.min(rank).alias("least")).withColumn("node", node), "rows")
    each = F.array(*[F.struct(F.lit(k).alias("family"), F.col(n).alias("fp")) for k, n in enumerate(names)])
    long = rows.select("node", F.explode(each).alias("e")).select("node", "e.family", "e.fp")
    entries = written(long.groupBy("family", "fp").agg(F.min("node").alias("root"), F.max("node").alias("last")), "entries")
    shared = entries.where("root <> last").select("family", "fp", "root")
    ties = long.join(shared, ["family", "fp"]).where("node <> root").select("node", "root")
    masks = covering_masks(radius)
    near = components(links(entries, masks[:first], radius, dense).union(ties))
    tidy(fps.sparkSession)
    to = lambda df, name, comp: df.join(comp.withColumnRenamed("node", name), name, "left").withColumn(name, F.coalesce("component", name)).drop("component")
    far = components(links(to(entries.select("family", "fp", "root"), "root", near), masks[first:], radius, dense))
    known = written(to(to(rows, "node", near), "node", far), "classes")
    least = written(known.groupBy("node").agg(F.min("least").alias("least")), "least")
    for done in (rows, entries, near, far):
        discard(done)
    tidy(fps.sparkSession)
    return known.drop("least").join(least, "node").select(*names, "least")


def near_duplicates(docs: DataFrame, ident: str = "doc_id", text: str = "text", families: tuple[Family, ...] = PLAIN, radius: int = 4) -> DataFrame:
    """(ident, fingerprint, component_id), one row per document; fingerprint is the first family's.

    Exact copies share all fingerprints and meet as one row before any bucket is formed; documents link if a family's
    fingerprints differ in at most `radius` bits. Null and blank texts have fingerprint 0 and link like any other. A
    null `ident` never names a component unless all of the component is null. Repeated rows stay repeated. An empty
    table gives no rows.
    """
    names = [f"fp{k}" for k in range(len(families))]
    fps = written(fingerprints(docs.select(F.col(ident).alias("ident"), F.col(text).alias("text")), families=families, names=names), "fingerprints")
    out = fps.join(classes(fps, "ident", names, radius), names)
    return out.select(F.col("ident").alias(ident), F.lower(F.lpad(F.hex("fp0"), 16, "0")).alias("fingerprint"), F.col("least").alias("component_id"))


def keep_one(docs: DataFrame, ident: str = "doc_id", text: str = "text", families: tuple[Family, ...] = WIDE, radius: int = 4) -> DataFrame:
    """docs with one row of each near-duplicate class: the one with the smallest (ident, text hash, row hash).

    Rows are told apart by these three and not by the `ident` alone, so other texts under a repeated `ident` are judged
    by what they say; of rows that are equal throughout one stays. Null ids rank last. Reruns keep the same rows.
    """
    absent, own, mark, row = fresh(docs, "absent_", "own_", "mark_", "row_")
    plain = [f.name for f in docs.schema if not f.dataType.simpleString().startswith(("map", "variant"))]
    keys = {absent: F.col(ident).isNull(), own: F.coalesce(F.col(ident).cast("long"), F.lit(0)), mark: F.xxhash64(text), row: F.xxhash64(*plain)}
    names = [f"fp{k}" for k in range(len(families))]
    slim = docs.select(F.struct(*[c.alias(n) for n, c in keys.items()]).alias("key"), F.col(text).alias("text"))
    fps = written(fingerprints(slim, families=families, names=names), "fingerprints")
    kept = classes(fps, "key", names, radius).select("least.*").distinct()
    return docs.withColumns(keys).join(kept, list(keys), "left_semi").dropDuplicates(list(keys)).select(*docs.columns)
