"""JSON, HTML and maps."""

from __future__ import annotations

import html as html_lib
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field
from html.parser import HTMLParser
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- maps -----------------------------------------------------------------------------------------------------------


def only(m: Column, names: list[str]) -> Column:
    return F.map_filter(m, lambda k, _: k.isin(names))


def without(m: Column, names: list[str]) -> Column:
    return F.map_filter(m, lambda k, _: ~k.isin(names))


def blank_keys(m: Column, patterns: list[str]) -> Column:
    """Values of keys that a pattern matches from their start become null."""
    hit = "^(?:" + "|".join(f"(?:{p})" for p in patterns) + ")"
    return F.transform_values(m, lambda k, v: F.when(~k.rlike(hit), v))


def renamed(m: Column, names: dict[str, str]) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.transform_keys(m, lambda k, _: F.coalesce(F.try_element_at(pairs, k), k))


def value_or(m: Column, key: str, default: Any) -> Column:
    return F.coalesce(F.try_element_at(m, F.lit(key)), F.lit(default))


def hashable(m: Column) -> Column:
    """A map in a form that groups: its entries by key."""
    return F.array_sort(F.map_entries(m))


def flat_columns(df: DataFrame, sep: str = "_") -> DataFrame:
    """Nested structs as columns named by their path."""
    def leaves(schema: T.StructType, path: tuple[str, ...]) -> Iterator[Column]:
        for f in schema.fields:
            if isinstance(f.dataType, T.StructType):
                yield from leaves(f.dataType, (*path, f.name))
            else:
                yield F.col(".".join(f"`{p}`" for p in (*path, f.name))).alias(sep.join((*path, f.name)))

    return df.select(*leaves(df.schema, ()))


# --- JSON -----------------------------------------------------------------------------------------------------------


def json_path(c: Column, path: str) -> Column:
    return F.get_json_object(c, "$." + path)


def key_paths(df: DataFrame, col: str, depth: int | None = None) -> DataFrame:
    """(path, n): how often each dotted path of JSON objects occurs; down to a depth, or as deep as they go."""
    level = df.select(F.lit("").alias("path"), F.col(col).alias("j"))
    out = None
    at = 0
    while depth is None or at < depth:
        at += 1
        keys = level.withColumn("k", F.explode(F.json_object_keys("j")))
        child = F.expr("get_json_object(j, concat('$[''', k, ''']'))")
        level = keys.select(F.when(F.col("path") == "", F.col("k")).otherwise(F.concat("path", F.lit("."), "k")).alias("path"), child.alias("j"))
        out = level.select("path") if out is None else out.union(level.select("path"))
        level = level.where("j LIKE '{%'")
        if depth is None and level.isEmpty():
            break
    return out.groupBy("path").agg(F.count("*").alias("n"))


def decode_nested(value: Any) -> Any:
    """Strings that are JSON objects or lists, at any depth, as what they say."""
    if isinstance(value, str) and value[:1] in "[{":
        try:
            return decode_nested(json.loads(value))
        except ValueError:
            return value
    if isinstance(value, dict):
        return {k: decode_nested(v) for k, v in value.items()}
    if isinstance(value, list):
        return [decode_nested(v) for v in value]
    return value


def embedded_json(text: str) -> Any:
    """The first JSON object or list inside other text; ValueError if there is none."""
    decoder = json.JSONDecoder()
    for m in re.finditer(r"[\[{]", text):
        try:
            return decoder.raw_decode(text, m.start())[0]
        except ValueError:
            continue
    raise ValueError("no JSON value in the text")


@F.pandas_udf(T.StringType())
def embedded_json_text(s: pd.Series) -> pd.Series:
    def one(x: str | None) -> str | None:
        try:
            return None if x is None else json.dumps(embedded_json(x), sort_keys=True, ensure_ascii=False)
        except ValueError:
            return None

    return s.map(one)


# --- HTML -----------------------------------------------------------------------------------------------------------


def clean_html(c: Column, most: int = 200_000) -> Column:
    """HTML without scripts, styles, SVG, links and inline images, cut to `most` characters."""
    s = F.regexp_replace(c, r"(?is)<(script|style|svg)\b.*?</\1\s*>", "")
    s = F.regexp_replace(s, r"(?is)<link\b[^>]*>", "")
    s = F.regexp_replace(s, r"data:image/[^\s\"')]*", "")
    return F.substring(s, 1, most)


VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


@dataclass
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list[Node | str] = field(default_factory=list)
    parent: Node | None = None

    def walk(self) -> Iterator[Node]:
        for c in self.children:
            if isinstance(c, Node):
                yield c
                yield from c.walk()

    def text(self) -> str:
        return "".join(c if isinstance(c, str) else c.text() for c in self.children if not (isinstance(c, Node) and c.tag in ("script", "style")))

    def html(self) -> str:
        inner = "".join(html_lib.escape(c, quote=False) if isinstance(c, str) else c.html() for c in self.children)
        attrs = "".join(f' {k}="{html_lib.escape(v)}"' for k, v in self.attrs.items())
        return f"<{self.tag}{attrs}>" + ("" if self.tag in VOID else f"{inner}</{self.tag}>")


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.root = self.at = Node("")

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        node = Node(tag, {k: v or "" for k, v in attrs}, parent=self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_endtag(self, tag: str) -> None:
        n = self.at
        while n.parent is not None and n.tag != tag:
            n = n.parent
        if n.parent is not None:
            self.at = n.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def tree(page: str) -> Node:
    b = _Builder()
    b.feed(page or "")
    b.close()
    return b.root


SIMPLE = re.compile(r"(?P<tag>[\w*-]+)?(?P<rest>(?:[.#][\w-]+|\[[\w-]+(?:=\"?[^\]\"]*\"?)?\])*)$")


def matches(node: Node, simple: str) -> bool:
    """Whether a node fits tag, .class, #id and [attr=value] parts written without spaces."""
    m = SIMPLE.match(simple)
    if not m:
        raise ValueError(f"selector {simple!r} is not supported")
    if m["tag"] not in (None, "*") and node.tag != m["tag"].lower():
        return False
    for part in re.findall(r"[.#][\w-]+|\[[^\]]+\]", m["rest"]):
        if part[0] == "." and part[1:] not in node.attrs.get("class", "").split():
            return False
        if part[0] == "#" and node.attrs.get("id") != part[1:]:
            return False
        if part[0] == "[":
            name, eq, value = part[1:-1].partition("=")
            if name not in node.attrs or eq and node.attrs[name] != value.strip('"'):
                return False
    return True


def select(root: Node, selector: str) -> list[Node]:
    """Nodes that fit a selector of simple parts joined by descent (space), in page order."""
    level = [root]
    for part in selector.split():
        seen: dict[int, Node] = {}
        for n in level:
            for d in n.walk():
                if id(d) not in seen and matches(d, part):
                    seen[id(d)] = d
        level = list(seen.values())
    return level


#: Steps that clean what a rule has found, as columns.
CLEAN: dict[str, Callable[..., Column]] = {"strip": F.trim, "lower": F.lower, "replace": lambda v, old, new="": F.replace(v, F.lit(old), F.lit(new))}


def whole_number(v: Column) -> Column:
    """'1.2K', '3M', '1,234' as a whole number; null for what is none."""
    form = r"^\s*(-?[\d,]*\.?\d+)\s*([kKmMbB]?)\s*$"
    digits, unit = F.replace(F.regexp_extract(v, form, 1), F.lit(","), F.lit("")), F.lower(F.regexp_extract(v, form, 2))
    factor = F.when(unit == "k", 1e3).when(unit == "m", 1e6).when(unit == "b", 1e9).otherwise(1.0)
    return F.when(v.rlike(form), F.round(digits.try_cast("double") * factor).cast("long"))


@dataclass(frozen=True)
class Rule:
    """What to take from a page: nodes by selector, of each its text, html or an attribute; steps of CLEAN, each a name
    and its arguments; and what it gives: "text", "int" (what is no number stays text) or "split" with a separator."""

    name: str
    selector: str
    take: str = "text"
    many: bool = False
    clean: tuple[tuple[str, ...], ...] = ()
    give: tuple[str, ...] = ("text",)

    def found(self, root: Node) -> list[str]:
        nodes = select(root, self.selector)
        got = [n.text() if self.take == "text" else n.html() if self.take == "html" else n.attrs.get(self.take) for n in nodes]
        return [v for v in got if v is not None]

    def as_json(self, v: Column) -> Column:
        for step, *args in self.clean:
            v = CLEAN[step](v, *args)
        text = F.to_json(F.array(v))
        text = F.substring(text, 2, F.length(text) - 2)
        if self.give[0] == "int":
            return F.coalesce(whole_number(v).cast("string"), text)
        if self.give[0] == "split":
            return F.to_json(F.split(v, re.escape(self.give[1])))
        return text


def rules_text(rules: list[Rule]) -> str:
    return json.dumps([asdict(r) for r in rules])


def rules_of(text: str) -> list[Rule]:
    """The rules that rules_text() wrote."""
    frozen = lambda x: tuple(map(frozen, x)) if isinstance(x, list) else x
    return [Rule(**{k: frozen(v) for k, v in d.items()}) for d in json.loads(text)]


def apply_rules(c: Column, rules: list[Rule]) -> Column:
    """A map from rule name to value as JSON text. Pages are parsed once for all rules; the rest is done by columns."""

    @F.pandas_udf("array<array<string>>")
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(lambda page: [r.found(root) for r in rules] if (root := tree(page or "")) else [])

    def value(r: Rule, found: Column) -> Column:
        each = F.transform(found, r.as_json)
        return F.concat(F.lit("["), F.array_join(each, ", "), F.lit("]")) if r.many else F.coalesce(F.get(each, 0), F.lit("null"))

    lists = run(c)
    return F.map_from_arrays(F.array(*[F.lit(r.name) for r in rules]), F.array(*[value(r, F.get(lists, i)) for i, r in enumerate(rules)]))


def simplified(page: str) -> str:
    """HTML without hidden, empty, style, script and footer nodes; wrappers of a single node give way to it."""

    def keep(n: Node | str) -> Node | str | None:
        if isinstance(n, str):
            return re.sub(r"\s+", " ", n) if n.strip() else None
        if n.tag in ("script", "style", "footer", "noscript") or "hidden" in n.attrs or "display:none" in n.attrs.get("style", "").replace(" ", ""):
            return None
        kids = [k for c in n.children if (k := keep(c)) is not None]
        if not kids and n.tag not in ("img", "br", "hr", "input"):
            return None
        if len(kids) == 1 and isinstance(kids[0], Node) and n.tag in ("div", "span", "section"):
            return kids[0]
        return Node(n.tag, n.attrs, kids)

    out = [keep(c) for c in tree(page).children]
    return "".join(x if isinstance(x, str) else x.html() for x in out if x is not None)


@F.pandas_udf(T.StringType())
def simplified_html(pages: pd.Series) -> pd.Series:
    return pages.map(lambda p: None if p is None else simplified(p))


def json_ld(page: str, kind: str) -> dict[str, Any] | None:
    """The first linked-data object of a type in a page."""
    for n in select(tree(page), 'script[type="application/ld+json"]'):
        try:
            data = json.loads("".join(c for c in n.children if isinstance(c, str)))
        except ValueError:
            continue
        todo = [data]
        while todo:
            x = todo.pop(0)
            if isinstance(x, list):
                todo = x + todo
            elif isinstance(x, dict):
                t = x.get("@type")
                if t == kind or isinstance(t, list) and kind in t:
                    return x
                todo += [x[k] for k in ("@graph",) if k in x]
    return None
