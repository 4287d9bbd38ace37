"""String functions: columns in, columns out."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def make_safe(c: Column) -> Column:
    """Lower case, everything but letters and digits as _."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "_")


def safe(c: Column, keep: str = "A-Za-z0-9.-", rep: str = "_") -> Column:
    """Lower case; other characters become `rep`, runs of it collapse and none stands at the ends."""
    s = F.regexp_replace(F.lower(c), f"[^{keep}]", rep)
    return F.btrim(F.regexp_replace(s, f"{rep}+", rep), F.lit(rep))


def join_items(c: Column, sep: str = ",", fmt: str | None = None) -> Column:
    """An array as text, each item formatted printf-style."""
    return F.array_join(F.transform(c, lambda x: F.format_string(fmt, x) if fmt else x.cast("string")), sep)


def indent(c: Column, by: str = "\t") -> Column:
    return F.concat(F.lit(by), F.replace(c, F.lit("\n"), F.lit("\n" + by)))


def replace_till(c: Column, anchor: str, base: str) -> Column:
    """The text from the anchor on, after `base`; null if the anchor is missing."""
    at = F.instr(c, anchor)
    return F.when(at > 0, F.concat(F.lit(base), F.substr(c, at)))


def thousands(c: Column, decimals: int = 0) -> Column:
    return F.format_number(c, decimals)


def int_or(c: Column, default: int | None = 0) -> Column:
    return F.coalesce(F.trim(c).try_cast("bigint"), F.lit(default).cast("bigint"))


def float_or(c: Column, default: float | None = 0.0) -> Column:
    return F.coalesce(F.trim(c).try_cast("double"), F.lit(default).cast("double"))


def specialize(c: Column) -> Column:
    """struct(kind, b, i, d, s): text as the narrowest of bool, int, float and str."""
    t = F.trim(c)
    b = F.when(F.lower(t).isin("true", "false"), F.lower(t) == "true")
    i = F.when(t.rlike(r"^[+-]?\d{1,18}$"), t.try_cast("bigint"))
    d = F.when(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), t.try_cast("double"))
    kind = F.when(c.isNull() | (F.lower(t) == "none"), "null").when(b.isNotNull(), "bool").when(i.isNotNull(), "int").when(d.isNotNull(), "float").otherwise("str")
    return F.struct(kind.alias("kind"), b.alias("b"), i.alias("i"), d.alias("d"), F.when(kind == "str", c).alias("s"))


def number_spec(c: Column) -> Column:
    """'1,3-5' -> [1, 3, 4, 5], in order and distinct; parts that are no numbers add nothing."""

    def part(p: Column) -> Column:
        a = F.regexp_extract(p, r"^\s*(\d+)\s*(?:-\s*\d+\s*)?$", 1).try_cast("bigint")
        z = F.coalesce(F.regexp_extract(p, r"^\s*\d+\s*-\s*(\d+)\s*$", 1).try_cast("bigint"), a)
        return F.when(a.isNotNull() & (z >= a), F.sequence(a, z)).otherwise(F.array().cast("array<bigint>"))

    return F.array_distinct(F.flatten(F.transform(F.split(c, ","), part)))


def tags_of(c: Column) -> Column:
    """What follows 'tags:' in a description without markdown marks: lower case, inner spaces as -, distinct, sorted."""
    plain = F.regexp_replace(c, r"[*_`#]+", "")
    after = F.regexp_extract(plain, r"(?is)tags:\s*(.*)$", 1)
    items = F.transform(F.split(after, r"[,;\n]"), lambda x: F.regexp_replace(F.lower(F.trim(x)), r"\s+", "-"))
    return F.array_sort(F.array_distinct(F.filter(items, lambda x: x != "")))


def pairs_to_text(m: Column, sep: str = "@", between: str = "::") -> Column:
    """A map as k@v::k@v, by key."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit(sep), e["value"].cast("string"))), between)


def text_to_pairs(c: Column, sep: str = "@", between: str = "::") -> Column:
    """The inverse; parts that are blank or lack the separator are skipped, later keys win."""
    parts = F.filter(F.split(c, between), lambda p: F.contains(p, F.lit(sep)))
    return F.map_from_entries(F.transform(parts, lambda p: F.struct(F.substring_index(p, sep, 1), F.substr(p, F.instr(p, sep) + len(sep)))))


def find_all(c: Column, sub: str) -> Column:
    """Starts (from 0) of every occurrence, overlapping ones too."""
    n = F.length(c) - len(sub)
    places = F.when(n >= 0, F.sequence(F.lit(0), n)).otherwise(F.array().cast("array<int>"))
    return F.filter(places, lambda i: F.substr(c, i + 1, F.lit(len(sub))) == sub)


def words(c: Column) -> Column:
    """White-space separated parts; none for blank text."""
    return F.filter(F.split(F.trim(c), r"\s+"), lambda x: x != "")


def punctuated(c: Column) -> Column:
    """Text cut at punctuation, which stays as items of its own."""
    marked = F.regexp_replace(c, r'([".,;:?!\n]+)', "\u0001$1\u0001")
    return F.filter(F.split(marked, "\u0001"), lambda x: x != "")


def token_norm(c: Column) -> Column:
    """A word as n-grams know it: lower case letters and digits; null (a break) if nothing is left."""
    s = F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")
    return F.when(s != "", s)


def ngrams(tokens: Column, n: int) -> Column:
    """Runs of n non-null tokens, space-joined."""
    places = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - n + 1)).otherwise(F.array().cast("array<int>"))
    runs = F.transform(places, lambda i: F.slice(tokens, i, F.lit(n)))
    whole = F.filter(runs, lambda r: F.forall(r, lambda t: t.isNotNull()))
    return F.transform(whole, lambda r: F.array_join(r, " "))


def has_words(text: Column, term: Column) -> Column:
    """Whether the term is a run of whole words of the text, case ignored."""
    pad = lambda c: F.concat(F.lit(" "), F.array_join(words(F.lower(c)), " "), F.lit(" "))
    return F.contains(pad(text), pad(term))


def clock_to_seconds(c: Column) -> Column:
    """'HH:MM:SS,mmm' -> seconds."""
    g = lambda i: F.regexp_extract(c, r"^\s*(\d+):(\d+):(\d+)[,.](\d+)", i).try_cast("double")
    return g(1) * 3600 + g(2) * 60 + g(3) + g(4) / 1000


def seconds_to_clock(c: Column) -> Column:
    ms = F.round(c * 1000).cast("bigint")
    part = lambda by, mod: F.pmod(F.floor(ms / by).cast("bigint"), F.lit(mod))
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3_600_000).cast("bigint"), part(60_000, 60), part(1000, 60), F.pmod(ms, F.lit(1000)))


def clean_text(c: Column) -> Column:
    """Common character references decoded, white space collapsed, ends trimmed."""
    s = c
    # The references that texts hold most.
    for ref, ch in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        s = F.replace(s, F.lit(ref), F.lit(ch))
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def matching_brackets(s: str, kind: str = "(") -> list[tuple[int, int]]:
    """(open, close) places of one kind of bracket in closing order; unbalanced text raises ValueError."""
    close, stack, out = {"(": ")", "[": "]", "{": "}", "<": ">"}[kind], [], []
    for i, ch in enumerate(s):
        if ch == kind:
            stack.append(i)
        elif ch == close:
            if not stack:
                raise ValueError(f"unmatched {close} at {i}")
            out.append((stack.pop(), i))
    if stack:
        raise ValueError(f"unmatched {kind} at {stack[-1]}")
    return out


def similarity(a: str, b: str) -> float:
    """0 to 1: a blend of difflib's ratio, the longest common run, all matching runs and containment at an end."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    m = difflib.SequenceMatcher(None, a, b, autojunk=False)
    blocks = [x.size for x in m.get_matching_blocks()]
    small = min(len(a), len(b))
    ends = float(a.startswith(b) or b.startswith(a) or a.endswith(b) or b.endswith(a))
    return (m.ratio() + 5 * max(blocks) / small + sum(blocks) / small + ends) / 8


@F.pandas_udf(T.DoubleType())
def string_similarity(it: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in it:
        yield pd.Series([None if x is None or y is None else similarity(x, y) for x, y in zip(a, b)])


def random_text(key: Column, length: int = 10, seed: int = 0) -> Column:
    """Letters and digits that follow from key and seed."""
    signs = F.lit("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
    each = F.transform(F.sequence(F.lit(1), F.lit(length)), lambda i: F.substr(signs, (F.pmod(F.xxhash64(key, F.lit(seed), i), F.lit(62)) + 1).cast("int"), F.lit(1)))
    return F.array_join(each, "")


def cut_at(c: Column, cuts: list[tuple[str, int]]) -> Column:
    """A map from label to the piece that starts at its offset and ends at the next."""
    ends = [*[at for _, at in cuts[1:]], None]
    pieces = [F.substr(c, F.lit(at + 1), F.lit(end - at)) if end is not None else F.substr(c, F.lit(at + 1)) for (_, at), end in zip(cuts, ends)]
    return F.create_map(*[x for (label, _), p in zip(cuts, pieces) for x in (F.lit(label), p)])


def arguments(c: Column) -> Column:
    """['k=v', ...] as a map from name to value, each value read as bool, int, float or text; others are skipped."""
    pairs = F.filter(c, lambda p: F.contains(p, F.lit("=")))
    return F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.trim(F.substring_index(p, "=", 1)), specialize(F.substr(p, F.instr(p, "=") + 1)))))
