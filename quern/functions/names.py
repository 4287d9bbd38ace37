"""File names, file groups, subtitles, tags that match terms."""

from __future__ import annotations

import re
from calendar import month_abbr, month_name
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import date

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .strings import has_words, similarity

# --- file names -----------------------------------------------------------------------------------------------------

BRACKETS = re.compile(r"\([^()]*\)|\[[^\[\]]*\]|\{[^{}]*\}|<[^<>]*>")
BETWEEN = re.compile(r" - |[,_:/]")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: The orders of year, month and day that three tokens are read in.
ORDERS = ("ymd", "dmy", "mdy")
MONTHS = {name.lower(): i for names in (month_name, month_abbr) for i, name in enumerate(names) if name}


@dataclass(frozen=True)
class Token:
    text: str
    start: int
    end: int


@dataclass
class Segment:
    start: int
    end: int
    tokens: list[Token] = field(default_factory=list)


def tokenized(text: str, offset: int = 0) -> list[Token]:
    """Words between spaces, dots, hyphens and changes of case, without the brackets around them."""
    out = []
    for m in re.finditer(r"[^\s.\-]+", text):
        at = m.start()
        for part in CAMEL.split(m[0]):
            own = part.strip("()[]{}<>")
            if own:
                lead = part.index(own)
                out.append(Token(own, offset + at + lead, offset + at + lead + len(own)))
            at += len(part)
    return out


def segments(name: str) -> list[Segment]:
    """A file name cut at commas, underscores, colons, slashes, spaced hyphens and around brackets, with its tokens."""
    cuts = {0, len(name)}
    for m in BRACKETS.finditer(name):
        cuts |= {m.start(), m.end()}
    spans, at = [], sorted(cuts)
    for a, z in zip(at, at[1:]):
        start = a
        for m in BETWEEN.finditer(name, a, z):
            spans.append((start, m.start()))
            start = m.end()
        spans.append((start, z))
    out = [Segment(a, z, tokenized(name[a:z], a)) for a, z in spans]
    return [s for s in out if s.tokens]


def _date(order: str, texts: list[str], digits: int) -> date | None:
    """The date that the texts spell in an order, with a year of so many digits; months are numbers or names."""
    part = dict(zip(order, texts))
    month = MONTHS.get(part["m"].lower()) or (int(part["m"]) if re.fullmatch(r"[0-9]{1,2}", part["m"]) else 0)
    if not re.fullmatch(r"[0-9]{1,2}", part["d"]) or not re.fullmatch(f"[0-9]{{{digits}}}", part["y"]):
        return None
    year = int(part["y"]) + (0 if digits == 4 else 2000 if int(part["y"]) < 69 else 1900)
    try:
        return date(year, month, int(part["d"]))
    except ValueError:
        return None


def find_date(tokens: list[Token]) -> tuple[date, int, int] | None:
    """The first three tokens in a row that spell a date: it, and the range of tokens. Years of four digits come first."""
    texts = [t.text for t in tokens]
    readings = ((_date(order, texts[i : i + 3], digits), i, i + 3) for i in range(len(texts) - 2) for digits in (4, 2) for order in ORDERS)
    return next((r for r in readings if r[0]), None)


def without_text(parts: list[Segment], text: str) -> list[Segment]:
    """Segments without tokens that the text holds; segments left empty go."""
    gone = {t.text.lower() for t in tokenized(text)}
    out = [Segment(s.start, s.end, [t for t in s.tokens if t.text.lower() not in gone]) for s in parts]
    return [s for s in out if s.tokens]


@F.pandas_udf(T.ArrayType(T.StringType()))
def name_tokens(names: pd.Series) -> pd.Series:
    return names.map(lambda n: None if n is None else [t.text for s in segments(n) for t in s.tokens])


@F.pandas_udf(T.DateType())
def name_date(names: pd.Series) -> pd.Series:
    def one(n: str | None) -> date | None:
        got = find_date([t for s in segments(n or "") for t in s.tokens])
        return got[0] if got else None

    return names.map(one)


# --- file groups ----------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class FileType:
    """A sibling of a file: what its name has before and behind the base."""

    name: str
    prefix: str = ""
    suffix: str = ""

    def rank(self) -> int:
        return (0 if self.prefix and self.suffix else 1 if self.prefix else 2 if self.suffix else 3) * 1000 - len(self.prefix + self.suffix)


def most_constrained(types: list[FileType]) -> list[FileType]:
    """Both prefix and suffix first, then prefix, suffix, none; longer ones first."""
    return sorted(types, key=lambda t: (t.rank(), t.name))


def split_path(path: str, types: list[FileType]) -> tuple[str, str, str, str, str]:
    """(dir, prefix, base, suffix, type) by the most constrained type that fits; ValueError if none does."""
    d, _, name = path.rpartition("/")
    for t in most_constrained(types):
        if name.startswith(t.prefix) and name.endswith(t.suffix) and len(name) > len(t.prefix) + len(t.suffix):
            return d, t.prefix, name[len(t.prefix) : len(name) - len(t.suffix)], t.suffix, t.name
    raise ValueError(f"no type fits {path!r}")


def translated(path: str, to: str, types: list[FileType]) -> str:
    """The path of the sibling of another type."""
    d, _, base, _, _ = split_path(path, types)
    t = next(t for t in types if t.name == to)
    return (d + "/" if d else "") + t.prefix + base + t.suffix


def type_column(path: Column, types: list[FileType]) -> Column:
    """The type of each path, in the JVM."""
    name = F.substring_index(path, "/", -1)
    out = F.lit(None).cast("string")
    for t in reversed(most_constrained(types)):
        out = F.when(name.startswith(t.prefix) & name.endswith(t.suffix) & (F.length(name) > len(t.prefix) + len(t.suffix)), t.name).otherwise(out)
    return out


def first_glob(key: Column, patterns: list[str]) -> Column:
    """The first glob (* and ?) that a key fits; null if none does."""
    out = F.lit(None).cast("string")
    for p in reversed(patterns):
        rx = "^" + "".join(".*" if ch == "*" else "." if ch == "?" else re.escape(ch) for ch in p) + "$"
        out = F.when(key.rlike(rx), p).otherwise(out)
    return out


# --- subtitles ------------------------------------------------------------------------------------------------------


def dialogs(c: Column) -> Column:
    """Subtitle text as an array of struct(start, end, text), times in seconds."""
    from .strings import clock_to_seconds

    parts = F.split(F.replace(c, F.lit("\r"), F.lit("")), r"\n\s*\n")

    def one(p: Column) -> Column:
        when = F.regexp_extract(p, r"(\d+:\d+:\d+[,.]\d+\s*-->\s*\d+:\d+:\d+[,.]\d+)", 1)
        text = F.regexp_extract(p, r"(?s)-->[^\n]*\n(.*)$", 1)
        return F.struct(clock_to_seconds(F.substring_index(when, "-->", 1)).alias("start"), clock_to_seconds(F.substring_index(when, "-->", -1)).alias("end"), F.regexp_replace(text, r"^\s+|\s+$", "").alias("text"))

    return F.filter(F.transform(parts, one), lambda d: d["start"].isNotNull())


def shifted(c: Column, seconds: float) -> Column:
    return F.transform(c, lambda d: F.struct((d["start"] + seconds).alias("start"), (d["end"] + seconds).alias("end"), d["text"].alias("text")))


# --- terms and tags -------------------------------------------------------------------------------------------------


def word_match(a: str, b: str) -> float:
    """The mean similarity of words matched greedily, best pair first; unmatched words count 0."""
    x, y = a.split(), b.split()
    pairs = sorted(((similarity(p, q), i, j) for i, p in enumerate(x) for j, q in enumerate(y)), key=lambda t: (-t[0], t[1], t[2]))
    used_x, used_y, total = set(), set(), 0.0
    for s, i, j in pairs:
        if i not in used_x and j not in used_y:
            used_x.add(i)
            used_y.add(j)
            total += s
    return total / max(len(x), len(y)) if x and y else 0.0


@F.pandas_udf(T.DoubleType())
def words_alike(it: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in it:
        yield pd.Series([None if p is None or q is None else word_match(p, q) for p, q in zip(a, b)])


@F.pandas_udf(T.DoubleType())
def spelled_alike(it: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in it:
        yield pd.Series([None if p is None or q is None else similarity(p, q) for p, q in zip(a, b)])


#: The order in which kinds of match are tried.
MATCHES = ("constant", "exact", "hasword", "contains", "unordered", "starts", "ends", "typo")


def match_score(term: Column, tag: Column, weights: dict[str, float]) -> Column:
    """The weight times score of the first kind of match that hits, else 0; blank tags score 0."""
    some = term != ""
    kinds = {
        "constant": F.lit(1.0),
        "exact": (term == tag).cast("double"),
        "hasword": has_words(tag, term).cast("double"),
        "contains": (some & (F.contains(tag, term) | F.contains(term, tag))).cast("double"),
        "unordered": F.when(words_alike(term, tag) > 0.3, words_alike(term, tag)).otherwise(0.0),
        "starts": F.startswith(tag, term).cast("double"),
        "ends": F.endswith(tag, term).cast("double"),
        "typo": F.when(spelled_alike(term, tag) > 0.7, spelled_alike(term, tag)).otherwise(0.0),
    }
    out = F.lit(0.0)
    for k in reversed([k for k in MATCHES if k in weights]):
        s = kinds[k] * weights[k]
        out = F.when(s > 0, s).otherwise(out)
    return F.when(F.trim(tag) == "", 0.0).otherwise(out)
