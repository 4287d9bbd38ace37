"""Toxicity by multiple-instance learning: documents are bags of sentences, joined by noisy-or."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import discard, fresh, lean, written

#: A word, or the end of a sentence.
TOKEN = re.compile(r"\w+|[.!?\n]")
ENDS = frozenset(".!?\n")


def sentences(text: str) -> Iterator[list[str]]:
    """The sentences of a text as lower-case words; a sentence ends at . ! ? or a line end."""
    own: list[str] = []
    for t in TOKEN.findall(text.lower()):
        if t in ENDS:
            if own:
                yield own
            own = []
        else:
            own.append(t)
    if own:
        yield own


def features(word: str) -> list[str]:
    """What a word is judged by: itself, its beginnings of 3 to 8 characters and its ends of 3 to 6."""
    own = ["=" + word]
    own += ["<" + word[:n] for n in range(3, 1 + min(8, len(word)))]
    own += [">" + word[-n:] for n in range(3, 1 + min(6, len(word)))]
    return own


@dataclass
class Model:
    """A sentence is offensive with probability sigmoid(bias + the weights of its words' features); a document, by
    noisy-or, unless every sentence is harmless. Features without a weight count nothing.

    Each sentence over `usual` takes back what a harmless one adds to -log(1 - p) on average, and two standard errors, so that long documents
    are not offensive by their length; a document is never less offensive than its worst sentence."""

    weights: dict[str, float]
    bias: float
    harmless: float = 0.0
    spread: float = 0.0
    usual: int = 0
    #: Words whose weight is remembered at most, before memory starts anew.
    memory: int = 200_000

    def __post_init__(self) -> None:
        self.known: dict[str, float] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}}

    def word(self, w: str) -> float:
        if len(self.known) > self.memory:
            self.known.clear()
        get = self.weights.get
        self.known[w] = x = sum(v for f in features(w) if (v := get(f)) is not None)
        return x

    def sentence(self, words: list[str]) -> float:
        get = self.known.get
        return self.bias + sum(x if (x := get(w)) is not None else self.word(w) for w in words)

    def score(self, text: str | None) -> float:
        """1 - product of (1 - p) over the sentences, less the allowance for length; 0 sentences: the bias alone."""
        get, word, n, z, zs = self.known.get, self.word, 0, self.bias, []
        for t in TOKEN.findall((text or "").lower()):
            if t in ENDS:
                if n:
                    zs.append(z)
                z, n = self.bias, 0
            else:
                n += 1
                x = get(t)
                z += word(t) if x is None else x
        if n or not zs:
            zs.append(z)
        each = np.logaddexp(0, np.array(zs))
        over = max(len(zs) - self.usual, 0)
        return float(-np.expm1(-max(each.sum() - self.harmless * over - 2 * self.spread * over**0.5, each.max())))

    def locate(self, text: str | None, least: float = 0.5) -> list[tuple[int, int, float]]:
        """(start, end, probability) in characters of each sentence of at least that probability."""
        out, text = [], text or ""
        for m in re.finditer(r"[^.!?\n]+[.!?]?", text):
            words = re.findall(r"\w+", m[0].lower())
            if words and (p := float(1 / (1 + np.exp(-self.sentence(words))))) >= least:
                out.append((m.start(), m.end(), p))
        return out


#: Slots that features are counted in; a slot stands for all features of one hash.
SLOTS = 1 << 21


def _slots(word: str) -> list[int]:
    return [crc32(f.encode()) % SLOTS for f in features(word)]


def _screened(texts: list[str], y: np.ndarray, least_docs: int, most: int) -> dict[int, int]:
    """Slots to indices of those that at least `least_docs` documents have and whose share of toxic documents differs
    from the overall share by the most standard errors (over 2 at least). Texts go by in parts; only counts stay."""
    n, pos = np.zeros(SLOTS, np.int32), np.zeros(SLOTS, np.int32)
    for at in range(0, len(texts), 256):
        known: dict[str, list[int]] = {}
        for d in range(at, min(at + 256, len(texts))):
            own: set[int] = set()
            for w in {w for s in sentences(texts[d]) for w in s}:
                if (ids := known.get(w)) is None:
                    ids = known[w] = _slots(w)
                own.update(ids)
            got = np.fromiter(own, np.int64, len(own))
            n[got] += 1
            if y[d] > 0:
                pos[got] += 1
    share = y.mean()
    enough = np.flatnonzero(n >= least_docs)
    gain = (pos[enough] - n[enough] * share) / np.sqrt(n[enough] * share * (1 - share))
    order = np.lexsort((enough, -np.abs(gain)))[:most]
    return {int(enough[i]): k for k, i in enumerate(order[np.abs(gain[order]) > 2])}


def fit(texts: list[str], labels: np.ndarray, least_docs: int = 4, most: int = 4000, epochs: int = 400, rate: float = 0.3, l1: float = 2e-5) -> Model:
    """Trains the noisy-or likelihood by full-batch Adagrad with soft-thresholded weights over screened features.

    Without both labels, or without any telling feature, the model scores the share of toxic documents.
    """
    y = np.asarray(labels, float)
    share = float(np.clip(y.mean() if len(y) else 0.0, 0.001, 0.999))
    constant = Model({}, float(np.log(share / (1 - share))))
    if not len(y) or y.min() == y.max():
        return constant
    texts = [t or "" for t in texts]
    kept = _screened(texts, y, least_docs, most)
    if not kept:
        return constant
    names: list[set[str]] = [set() for _ in kept]
    known: dict[str, list[int]] = {}
    ids: list[int] = []
    sent: list[int] = []
    doc: list[int] = []
    for d, text in enumerate(texts):
        if len(known) > 100_000:
            known.clear()
        for s in [*sentences(text)] or [[]]:
            for w in s:
                if (own := known.get(w)) is None:
                    own = []
                    for f, slot in zip(features(w), _slots(w)):
                        if (k := kept.get(slot)) is not None:
                            own.append(k)
                            names[k].add(f)
                    known[w] = own
                ids += own
                sent += [len(doc)] * len(own)
            doc.append(d)
    ids_, sent_, doc_ = np.array(ids, np.int64), np.array(sent, np.int64), np.array(doc, np.int64)
    w, b = np.zeros(len(names)), -6.0
    gw, gb = np.full(len(names), 1e-8), 1e-8
    weigh = 1 / len(y)
    for _ in range(epochs):
        z = b + np.bincount(sent_, w[ids_], len(doc_))
        total = np.maximum(np.bincount(doc_, np.logaddexp(0, z), len(y)), 1e-9)
        down = np.where(y > 0, -1 / np.expm1(np.minimum(total, 50)), 1.0) * weigh
        dz = down[doc_] / (1 + np.exp(-z))
        dw, db = np.bincount(ids_, dz[sent_], len(names)), dz.sum()
        gw += dw * dw
        gb += db * db
        step = rate / np.sqrt(gw)
        w -= step * dw
        w = np.sign(w) * np.maximum(np.abs(w) - step * l1, 0)
        b = min(b - rate * db / np.sqrt(gb), -1.0)
    each, clean = np.logaddexp(0, b + np.bincount(sent_, w[ids_], len(doc_))), y[doc_] == 0
    return Model({f: float(x) for fs, x in zip(names, w) for f in sorted(fs) if abs(x) > 1e-3}, float(b), float(each[clean].mean()), float(each[clean].std()), int(np.ceil(len(doc_) / len(y))))


def held_out(ident: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(ident).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def within(sizes: list[tuple[int, int, int]], most_bytes: int) -> list[int]:
    """Which of (order, ident, bytes) a sample takes: in their order, all that still fit; one that does not is passed over."""
    out, left = [], most_bytes
    for _, ident, size in sorted(sizes):
        if size <= left:
            out.append(ident)
            left -= size
    return out


def train(docs: DataFrame, labels: DataFrame, ident: str = "doc_id", text: str = "text", label: str = "toxic", most_rows: int = 10_000, most_bytes: int = 40 << 20, **how) -> Model:
    """Fits on the labelled documents that are not held out, of any length, drawn by a hash of the id.

    The bounds of the sample are `most_rows` rows and `most_bytes` of text; both hold before any text is collected.
    Labels that contradict each other for one id are left out; of rows that repeat an id the smallest text counts.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(ident).isNotNull() & ~held_out(ident)).groupBy(F.col(ident).cast("long").alias("ident_")).agg(F.min(label).alias("y"), F.max(label).alias("y2")).where("y = y2").select("ident_", "y")
    chosen = known.orderBy(F.xxhash64("ident_", F.lit(17)), "ident_").limit(most_rows)
    own = docs.select(F.col(ident).cast("long").alias("ident_"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    rows = written(own.join(F.broadcast(chosen), "ident_").groupBy("ident_", "y").agg(F.min("t").alias("t")), "labelled")
    drawn = within([tuple(r) for r in rows.select(F.xxhash64("ident_", F.lit(17)), "ident_", F.octet_length("t")).collect()], most_bytes)
    ids = docs.sparkSession.createDataFrame([(i,) for i in drawn], "ident_ long")
    kept = [(r["t"], r["y"]) for r in rows.join(F.broadcast(ids), "ident_").sort("ident_").collect()]
    discard(rows)
    return fit([t for t, _ in kept], np.array([y for _, y in kept]), **how)


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """docs with the model's score of the whole text. Null and empty texts get the score of the bias alone; repeated rows
    stay repeated; an empty table gives no rows."""
    names = [*docs.columns, *fresh(docs, name)]
    at = docs.columns.index(text)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [model.score(v.as_py()) for v in b.column(at)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.float64())], names)

    return docs.mapInArrow(lean(add), docs.withColumn(names[-1], F.lit(0.0)).schema)


def offending(docs: DataFrame, model: Model, text: str = "text", ident: str = "doc_id", least: float = 0.5) -> DataFrame:
    """(ident, start, end, probability): the sentences to which the document's score is due; none of null, empty and
    harmless texts, and those of repeated rows as often as the rows."""
    slim = docs.select(F.col(ident).alias("ident"), F.col(text).alias("t"))
    schema = slim.selectExpr("ident", "0L as start", "0L as end", "0D as probability").schema

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hits = [(i, *x) for i, v in enumerate(b.column(1)) for x in model.locate(v.as_py(), least)]
            own = b.column(0).take(pa.array([h[0] for h in hits], pa.int64()))
            rest = [pa.array([h[k] for h in hits], t) for k, t in ((1, pa.int64()), (2, pa.int64()), (3, pa.float64()))]
            yield pa.RecordBatch.from_arrays([own, *rest], schema.names)

    return slim.mapInArrow(lean(find), schema).withColumnRenamed("ident", ident)
