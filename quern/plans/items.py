"""Requests over items, their scores and relations, as one DataFrame from filters to pages.

items: id, source, stype, otype, url, name, parent, ts, added_ts, explored_ts, seen_ts, embed_ts, md (JSON text).
scores: id, ttype, tag, score, ts. rels: src, tgt, rtype, ts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import joins

#: Longest first.
COMPARE = (">=", "<=", "!=", "<>", ">", "<")
NAMES = ("source", "stype", "otype", "url", "name")
TIMES = ("ts", "added_ts", "explored_ts", "seen_ts", "embed_ts")


def operator_of(text: str | float) -> tuple[str, float | None]:
    """'>=12' -> ('>=', 12.0); '<>' means null; a plain number means equality."""
    s = str(text).strip()
    for op in COMPARE:
        if s.startswith(op):
            return (op, None) if op == "<>" else (op, float(s[len(op) :]))
    return "=", float(s)


def compared(c: Column, text: str | float) -> Column:
    op, v = operator_of(text)
    if op == "<>":
        return c.isNull()
    return {">=": c >= v, "<=": c <= v, "!=": c != v, ">": c > v, "<": c < v, "=": c == v}[op]


def ids_of(spec: Any) -> list[int]:
    """An id, a list of ids or a spec such as '1,3-5'."""
    if isinstance(spec, int):
        return [spec]
    if isinstance(spec, (list, tuple)):
        return list(dict.fromkeys(int(x) for x in spec))
    out: dict[int, None] = {}
    for part in str(spec).split(","):
        m = re.fullmatch(r"\s*(\d+)\s*(?:-\s*(\d+))?\s*", part)
        if m:
            out |= dict.fromkeys(range(int(m[1]), int(m[2] or m[1]) + 1))
    return list(out)


@dataclass
class Collection:
    items: DataFrame
    scores: DataFrame
    rels: DataFrame
    me: int = 1

    def request(self, **kw: Any) -> DataFrame:
        """The items that a request asks for, in its order. All filters apply, whatever the order or scores wanted."""
        df = self.basic(self.items, kw)
        df = self.relations(df, kw)
        for t in TIMES:
            if t in kw:
                df = df.where(compared(F.col(t), kw[t]))
        for key, negate in (("has_rel", False), ("no_rel", True)):
            if key in kw:
                mine = self.rels.where((F.col("src") == self.me) & F.col("rtype").isin(_list(kw[key]))).select(F.col("tgt").alias("id"))
                df = df.join(mine, "id", "left_anti" if negate else "left_semi")
        if "tags" in kw:
            hit = self.scores.where(F.col("tag").isin(_list(kw["tags"])) & (F.col("score") > kw.get("min_score", 0.0)))
            df = df.join(hit.select("id"), "id", "left_semi")
        if "min_like" in kw:
            df = df.join(self.scores.where((F.col("ttype") == "like") & (F.col("score") >= kw["min_like"])).select("id"), "id", "left_semi")
        return self.page(self.ordered(df, kw), kw)

    def basic(self, df: DataFrame, kw: dict[str, Any]) -> DataFrame:
        if "ids" in kw:
            df = df.where(F.col("id").isin(ids_of(kw["ids"])))
        for n in NAMES:
            if n in kw:
                df = df.where(F.col(n).isin(_list(kw[n])))
        return df

    def relations(self, df: DataFrame, kw: dict[str, Any]) -> DataFrame:
        if "parent" in kw:
            df = df.where(F.col("parent").isin(ids_of(kw["parent"])))
        if "ancestor" in kw:
            up = joins.ancestors(self.items, "id", "parent", 2).where(F.col("ancestor").isin(ids_of(kw["ancestor"])) & F.col("hops").between(1, 2))
            df = df.join(up.select("id"), "id", "left_semi")
        if "same_user" in kw:
            users = joins.closest_ancestor(self.items, "id", "parent", F.col("otype") == "user")
            mine = users.where(F.col("id").isin(ids_of(kw["same_user"]))).select("ancestor")
            df = df.join(users.join(mine, "ancestor", "left_semi").select("id"), "id", "left_semi")
        if "has_md" in kw:
            df = df.where(F.get_json_object("md", "$." + kw["has_md"]).isNotNull())
        return df

    def ordered(self, df: DataFrame, kw: dict[str, Any]) -> DataFrame:
        order = str(kw.get("order", "-id"))
        name, desc = order.lstrip("-"), order.startswith("-")
        m = re.fullmatch(r"md\[[\"']?(\w+)[\"']?\]", name)
        c = F.get_json_object("md", "$." + m[1]) if m else F.col(name)
        keys = [c.desc_nulls_last() if desc else c.asc_nulls_first()]
        if name != "id":
            keys.append(F.col("id").desc())
        if kw.get("reverse"):
            keys = [c.asc_nulls_first() if desc else c.desc_nulls_last(), *([F.col("id").asc()] if name != "id" else [])]
        return df.orderBy(*keys)

    def page(self, df: DataFrame, kw: dict[str, Any]) -> DataFrame:
        if "limit" not in kw:
            return df
        return (df.offset(int(kw["offset"])) if kw.get("offset") else df).limit(int(kw["limit"]))

    def by_tag_groups(self, groups: list[list[str]], k: int, least: float = 0.0) -> DataFrame:
        """(id, score): items with a score above `least` in every group of tags; the best of each group, summed."""
        one = None
        for i, g in enumerate(groups):
            s = self.scores.where(F.col("tag").isin(g) & (F.col("score") > least)).select("id", F.lit(i).alias("g"), "score")
            one = s if one is None else one.union(s)
        best = one.groupBy("id", "g").agg(F.max("score").alias("m"))
        full = best.groupBy("id").agg(F.count("*").alias("n"), F.sum("m").alias("score")).where(F.col("n") == len(groups))
        return full.select("id", "score").orderBy(F.col("score").desc(), "id").limit(k)

    def top_tags(self, ids: DataFrame, least: float = 0.5) -> DataFrame:
        """(tag, n): how many of the items score above `least`."""
        return self.scores.where(F.col("score") > least).join(ids.select("id"), "id", "left_semi").groupBy("tag").agg(F.count("*").alias("n"))

    def user_scores(self, least_items: int = 1) -> DataFrame:
        """(user, score, n): like scores summed per user over items, of users with enough of them."""
        users = joins.closest_ancestor(self.items, "id", "parent", F.col("otype") == "user")
        s = self.scores.where("ttype = 'like'").join(users, "id").groupBy(F.col("ancestor").alias("user")).agg(F.sum("score").alias("score"), F.count("*").alias("n"))
        return s.where(F.col("n") >= least_items)

    def liked(self, kinds: list[str] | None = None) -> DataFrame:
        """(id): what I like, and the children of it, distinct."""
        own = self.rels.where((F.col("src") == self.me) & (F.col("rtype") == "like")).select(F.col("tgt").alias("id"))
        kids = self.items.join(own.withColumnRenamed("id", "parent"), "parent", "left_semi").select("id")
        out = own.union(kids).distinct()
        return out.join(self.items.where(F.col("otype").isin(kinds)).select("id"), "id", "left_semi") if kinds else out

    def user_stats(self) -> DataFrame:
        """(user, n, n_otypes, last_ts, mean_score, n_positive): per user over the items below it."""
        users = joins.closest_ancestor(self.items, "id", "parent", F.col("otype") == "user")
        own = self.items.join(users, "id").where("id <> ancestor")
        s = self.scores.groupBy("id").agg(F.avg("score").alias("m"), F.sum((F.col("score") > 0).cast("long")).alias("p"))
        return own.join(s, "id", "left").groupBy(F.col("ancestor").alias("user")).agg(F.count("*").alias("n"), F.countDistinct("otype").alias("n_otypes"), F.max("ts").alias("last_ts"), F.avg("m").alias("mean_score"), F.sum(F.coalesce("p", F.lit(0))).alias("n_positive"))


def _list(x: Any) -> list[Any]:
    return list(x) if isinstance(x, (list, tuple, set)) else [x]
