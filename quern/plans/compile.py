"""Predicate trees to Spark columns, joins, order and limits."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .catalog import MAX_IN, Catalog, ValidationError, check_field
from .cond import EXISTENCE, Cond, Join, Leaf, Op, Tree

# --- rows of one table, two-valued ----------------------------------------------------------------------------------


def smart_case(pattern: str) -> str:
    """Case matters only to patterns with a capital letter."""
    return pattern if re.search(r"[A-Z]", pattern) else f"(?i){pattern}"


def at_path(column: Column, kind: T.DataType, path: list[str]) -> Column:
    """A dotted path below a struct, map, array, variant or JSON string column."""
    if not path:
        return column
    head, rest = path[0], path[1:]
    if isinstance(kind, T.StructType):
        return at_path(column[head], kind[head].dataType, rest)
    if isinstance(kind, T.MapType):
        return at_path(column[head], kind.valueType, rest)
    if isinstance(kind, T.ArrayType):
        return at_path(F.get(column, F.lit(int(head))), kind.elementType, rest)
    if isinstance(kind, T.StringType):
        return F.get_json_object(column, "$." + ".".join(path))
    raise ValidationError(f"no path {path} in {kind.simpleString()}")


def object_leaf(df: DataFrame, leaf: Leaf, presence: str | None = None) -> Column:
    """One condition on the rows of df; a comparison with a null or missing value is false, never null.

    `presence` names a map column from field to boolean for sources where missing and null differ; without it a field
    exists if it is a column.
    """
    check_field(leaf.field)
    head, *path = leaf.field.split(".")
    known = {f.name: f.dataType for f in df.schema.fields}
    if presence:
        exists = F.coalesce(F.col(presence)[leaf.field], F.lit(False))
    else:
        exists = F.lit(head in known) if not path else F.lit(head in known) & at_path(F.col(head), known[head], path).isNotNull() if head in known else F.lit(False)
    if leaf.op is Op.EXISTS:
        return exists
    if leaf.op is Op.NOT_EXISTS:
        return ~exists
    if head not in known:
        return F.lit(False)
    c = at_path(F.col(head), known[head], path)
    kind = df.select(c).schema.fields[0].dataType
    if leaf.op is Op.IS_NULL:
        return exists & c.isNull()
    if leaf.op is Op.IS_NOT_NULL:
        return exists & c.isNotNull()
    return F.coalesce(compare(c, leaf, kind), F.lit(False))


def typed(c: Column, value: Any, kind: T.DataType | None) -> Column:
    """Text compared with a number or truth value is read as one."""
    if isinstance(kind, T.StringType):
        if isinstance(value, bool):
            return F.lower(c).try_cast("boolean") if hasattr(c, "try_cast") else F.lower(c).cast("boolean")
        if isinstance(value, (int, float)):
            return c.try_cast("double")
    return c


def compare(c: Column, leaf: Leaf, kind: T.DataType | None = None) -> Column:
    v, op = leaf.value, leaf.op
    if op in (Op.EQ, Op.NEQ):
        same = typed(c, v, kind) == F.lit(v)
        return same if op is Op.EQ else ~same
    if op in (Op.GT, Op.GTE, Op.LT, Op.LTE):
        t = typed(c, v, kind)
        return {Op.GT: t > v, Op.GTE: t >= v, Op.LT: t < v, Op.LTE: t <= v}[op]
    if op in (Op.LIKE, Op.NOT_LIKE):
        hit = c.cast("string").rlike(smart_case(str(v)))
        return hit if op is Op.LIKE else ~hit
    if op in (Op.IN, Op.NOT_IN):
        if not isinstance(v, (list, tuple)):
            raise ValidationError(f"{leaf.field} {op.value} needs a list")
        hit = member(c, list(v), kind)
        return hit if op is Op.IN else ~hit
    if op in (Op.HAS, Op.NOT_HAS):
        hit = F.array_contains(c, v) if isinstance(kind, T.ArrayType) else F.contains(c.cast("string"), F.lit(str(v)))
        return hit if op is Op.HAS else ~hit
    raise ValidationError(f"{op.name} is a vector condition: use quern.operators.vectors")


def member(c: Column, values: list[Any], kind: T.DataType | None) -> Column:
    """c IN values; values of other types than the column's are compared as text reads."""
    if not values:
        return F.when(c.isNotNull(), F.lit(False))
    numbers = [x for x in values if isinstance(x, (int, float)) and not isinstance(x, bool)]
    others = [x for x in values if not (isinstance(x, (int, float)) and not isinstance(x, bool))]
    out = None
    if numbers:
        out = typed(c, numbers[0], kind).isin(numbers)
    if others and (isinstance(kind, (T.StringType, T.BooleanType)) or kind is None):
        hit = c.isin([str(x) if isinstance(kind, T.StringType) else x for x in others])
        out = hit if out is None else F.coalesce(out, F.lit(False)) | hit
    return out if out is not None else F.when(c.isNotNull(), F.lit(False))


def object_predicate(df: DataFrame, cond: Cond, presence: str | None = None) -> Column:
    """The two-valued predicate of a tree over the rows of df. NOT negates the conjunction of its children."""
    if isinstance(cond, Leaf):
        return object_leaf(df, cond, presence)
    assert isinstance(cond, Tree)
    kids = [object_predicate(df, c, presence) for c in cond.conds]
    out = kids[0]
    for k in kids[1:]:
        out = out | k if cond.join is Join.OR else out & k
    return ~out if cond.join is Join.NOT else out


def match_score(df: DataFrame, cond: Cond, presence: str | None = None) -> Column:
    """How many conditions a row meets: AND sums, OR takes the most, NOT counts 1 if its child fails."""
    if isinstance(cond, Leaf):
        return object_leaf(df, cond, presence).cast("int")
    assert isinstance(cond, Tree)
    kids = [match_score(df, c, presence) for c in cond.conds]
    if cond.join is Join.NOT:
        return (~object_predicate(df, cond.conds[0], presence)).cast("int")
    if cond.join is Join.OR:
        return F.greatest(*kids) if len(kids) > 1 else kids[0]
    out = kids[0]
    for k in kids[1:]:
        out = out + k
    return out


# --- a main table with related tables, three-valued -----------------------------------------------------------------


def leading_number(c: Column) -> Column:
    """Text as a number by its longest numeric prefix; 0 if there is none, null for null."""
    head = F.regexp_extract(c.cast("string"), r"^\s*([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)", 1)
    return F.when(c.isNull(), F.lit(None).cast("double")).otherwise(F.coalesce(head.try_cast("double"), F.lit(0.0)))


def sql_compare(c: Column, leaf: Leaf, kind: T.DataType) -> Column:
    """Three-valued comparison as in SQL: ordered comparisons are numeric, LIKE means contains and ignores case."""
    v, op = leaf.value, leaf.op
    if op in EXISTENCE:
        return c.isNotNull() if op in (Op.EXISTS, Op.IS_NOT_NULL) else c.isNull()
    if v is None:
        raise ValidationError(f"{leaf.field} {op.value} needs a value")
    if op in (Op.GT, Op.GTE, Op.LT, Op.LTE):
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            t, v = c, F.lit(v).cast(kind)
        else:
            t, v = leading_number(c) if isinstance(kind, T.StringType) else c, F.lit(float(v))
        return {Op.GT: t > v, Op.GTE: t >= v, Op.LT: t < v, Op.LTE: t <= v}[op]
    if op in (Op.LIKE, Op.NOT_LIKE):
        hit = c.cast("string").ilike("%" + str(v).replace("\\", "\\\\") + "%")
        return hit if op is Op.LIKE else ~hit
    if op in (Op.IN, Op.NOT_IN) and (not isinstance(v, (list, tuple)) or len(v) > MAX_IN):
        raise ValidationError(f"{leaf.field} {op.value} needs a list of at most {MAX_IN}")
    if op in (Op.HAS, Op.NOT_HAS, Op.CLOSE_TO):
        raise ValidationError(f"{op.name} is not a condition on stored tables")
    return compare(c, leaf, kind)


@dataclass
class Plan:
    """Joins in order (alias -> table, key, parent alias), predicate, order and bounds of one search."""

    joins: dict[str, tuple[str, str, str]] = field(default_factory=dict)
    order: list[tuple[str, bool]] = field(default_factory=list)
    limit: int | None = None
    offset: int = 0


class Compiler:
    """Resolves the fields of a tree against a catalog.

    A field is `column`, `json_column.path`, `table.column`, `table_key.column` (conditions on one name share one
    joined row), `table.3.column` (independent rows by number), `table_key.other.column` (a second hop through the
    related row's `other` key back to main), or a magic one: $limit, $offset, $order.
    """

    def __init__(self, catalog: Catalog):
        self.catalog, self.plan = catalog, Plan()
        #: Joined rows that the conditions compiled last refer to.
        self.touched: set[str] = set()
        self.names, self.fresh = catalog.named(), 0
        self.kinds = {f.name: f.dataType for f in catalog.main.schema.fields}

    def expand(self, leaf: Leaf) -> list[Leaf]:
        """Aliases: a path, or a macro that ties a tag to a score in a joined row of its own."""
        alias = self.catalog.aliases.get(leaf.field)
        if alias is None:
            return [leaf]
        if isinstance(alias, str):
            return [Leaf(alias, leaf.op, leaf.value)]
        kind = alias.get("type")
        if kind == "nested_relation":
            return [Leaf(alias["path"], leaf.op, leaf.value)]
        if kind not in ("score_condition", "multi_score_condition"):
            raise ValidationError(f"bad alias {leaf.field!r}")
        out = []
        for d in alias["conditions"] if kind == "multi_score_condition" else [alias]:
            self.fresh += 1
            row = f"{d.get('table', 'score')}.{900 + self.fresh}"
            own = d if kind == "multi_score_condition" else {}
            out.append(Leaf(f"{row}.tag", Op.EQ, d["tag_field"]))
            out.append(Leaf(f"{row}.{d.get('score_field', 'score')}", Op(own.get("op", leaf.op.value)), own.get("value", leaf.value)))
        return out

    def related(self, alias: str, table: str, key: str, parent: str = "") -> dict[str, T.DataType]:
        self.plan.joins[alias] = (table, key, parent)
        self.touched.add(alias)
        df = self.catalog.main if table == "" else self.catalog.related[table][0]
        return {f.name: f.dataType for f in df.schema.fields}

    def resolve(self, name: str) -> tuple[Column, T.DataType]:
        check_field(name)
        head, *path = name.split(".")
        if not path:
            if head not in self.kinds:
                raise ValidationError(f"no column {head!r}")
            return F.col(f"main.{head}"), self.kinds[head]
        if head in self.kinds and (head in self.catalog.json_columns.get("main", set()) or not isinstance(self.kinds[head], T.StringType)):
            c = at_path(F.col(f"main.{head}"), self.kinds[head], path)
            return c, T.StringType() if isinstance(self.kinds[head], T.StringType) else self.catalog.main.select(at_path(F.col(head), self.kinds[head], path)).schema.fields[0].dataType
        tables = self.catalog.related
        if path[0].isdigit():
            if head not in tables or len(tables[head][1]) != 1 or not 1 <= int(path[0]) <= 999 or len(path) < 2:
                raise ValidationError(f"bad numbered field {name!r}")
            return self.column(f"{head}_{path[0]}", head, tables[head][1][0], path[1:])
        if head in self.names:
            table, key = self.names[head]
            return self.column(head, table, key, path)
        raise ValidationError(f"no table or column for {name!r}")

    def column(self, alias: str, table: str, key: str, path: list[str]) -> tuple[Column, T.DataType]:
        kinds = self.related(alias, table, key)
        head, *rest = path
        if head not in kinds:
            raise ValidationError(f"{table} has no column {head!r}")
        if not rest:
            return F.col(f"{alias}.{head}"), kinds[head]
        if head in self.catalog.json_columns.get(table, set()) or not isinstance(kinds[head], (T.LongType, T.IntegerType, T.StringType)):
            return at_path(F.col(f"{alias}.{head}"), kinds[head], rest), T.StringType()
        hop = self.related(f"{alias}__{head}", "", head, alias)
        if rest[0] not in hop:
            raise ValidationError(f"the main table has no column {rest[0]!r}")
        c = at_path(F.col(f"{alias}__{head}.{rest[0]}"), hop[rest[0]], rest[1:])
        return c, hop[rest[0]] if not rest[1:] else T.StringType()

    def magic(self, leaf: Leaf) -> Column:
        v = leaf.value
        if leaf.op is not Op.EQ:
            raise ValidationError(f"{leaf.field} takes =")
        if leaf.field == "$limit" and isinstance(v, int) and 1 <= v <= 50_000:
            self.plan.limit = v
        elif leaf.field == "$offset" and isinstance(v, int) and 0 <= v <= 1_000_000:
            self.plan.offset = v
        elif leaf.field == "$order" and isinstance(v, str) and 0 < len(v) <= 100:
            self.plan.order.append((v.lstrip("-"), v.startswith("-")))
        else:
            raise ValidationError(f"bad {leaf.field} {v!r}")
        return F.lit(True)

    def predicate(self, cond: Cond) -> Column:
        if isinstance(cond, Leaf):
            if cond.field.startswith("$"):
                return self.magic(cond)
            out = None
            for leaf in self.expand(cond):
                c, kind = self.resolve(leaf.field)
                hit = sql_compare(c, leaf, kind)
                out = hit if out is None else out & hit
            return out
        assert isinstance(cond, Tree)
        kids = [self.predicate(c) for c in cond.conds]
        out = kids[0]
        for k in kids[1:]:
            out = out | k if cond.join is Join.OR else out & k
        return ~out if cond.join is Join.NOT else out


    def conjuncts(self, cond: Cond) -> list[tuple[Column, set[str]]]:
        """The conditions that must all hold, each with the joined rows it refers to."""
        if isinstance(cond, Tree) and cond.join is Join.AND:
            return [x for c in cond.conds for x in self.conjuncts(c)]
        leaves = self.expand(cond) if isinstance(cond, Leaf) and not cond.field.startswith("$") else [cond]
        out = []
        for c in leaves:
            self.touched = set()
            out.append((self.predicate(c), self.touched))
        return out

    def root(self, alias: str) -> str:
        while parent := self.plan.joins[alias][2]:
            alias = parent
        return alias

    def joined(self, df: DataFrame, alias: str) -> DataFrame:
        table, key, parent = self.plan.joins[alias]
        if table == "":
            return df.join(self.catalog.main.alias(alias), F.col(f"{parent}.{key}") == F.col(f"{alias}.{self.catalog.key}"))
        return df.join(self.catalog.related[table][0].alias(alias), F.col(f"{alias}.{key}") == F.col(f"main.{self.catalog.key}"))

    def run(self, cond: Cond, limit: int | None = None) -> DataFrame:
        """(id): distinct ids of main in the order asked for, else by id.

        Related tables count as joined inner, above the predicate, wherever in the tree they occur, so rows of main
        without a related row never match. Where every conjunct refers to one joined row at most and the order to
        none, each joined row becomes a semi-join that holds all its conditions: no row of main is multiplied and
        nothing needs to be made distinct. Otherwise tables are joined and ids grouped, and order keys are reduced per
        id first (least ascending, greatest descending), which keeps DISTINCT and ORDER BY apart.
        """
        cat = self.catalog
        parts = self.conjuncts(cond)
        self.touched = set()
        keys = [(*self.resolve(name), desc) for name, desc in self.plan.order]
        roots = [{self.root(a) for a in aliases} for _, aliases in parts]
        apart = not self.touched and all(len(r) <= 1 for r in roots)
        df = cat.main.alias("main")
        if apart:
            for (c, _), r in zip(parts, roots):
                if not r:
                    df = df.where(c)
            for alias in dict.fromkeys(a for a in self.plan.joins if not self.plan.joins[a][2]):
                table, key, _ = self.plan.joins[alias]
                right = cat.related[table][0].alias(alias)
                for a in self.plan.joins:
                    if a != alias and self.root(a) == alias:
                        right = self.joined(right, a)
                on = F.col(f"{alias}.{key}") == F.col(f"main.{cat.key}")
                for (c, _), r in zip(parts, roots):
                    if alias in r:
                        on = on & c
                df = df.join(right, on, "left_semi")
        else:
            for alias in self.plan.joins:
                df = self.joined(df, alias)
            for c, _ in parts:
                df = df.where(c)
        ident = F.col(f"main.{cat.key}").alias("id")
        sort = [F.col("id").asc()]
        if apart or not self.plan.joins:
            out = df.select(ident, *[(leading_number(c) if isinstance(k, T.StringType) and "." in n else c).alias(f"k{i}") for i, ((c, k, _), (n, _)) in enumerate(zip(keys, self.plan.order))])
        else:
            aggs = [(F.max(c) if desc else F.min(c)).alias(f"k{i}") for i, (c, _, desc) in enumerate(keys)]
            out = df.groupBy(ident).agg(*aggs) if aggs else df.select(ident).distinct()
        order = [F.col(f"k{i}").desc_nulls_last() if desc else F.col(f"k{i}").asc_nulls_first() for i, (_, _, desc) in enumerate(keys)]
        n = self.plan.limit if self.plan.limit is not None else limit
        if n is None and not self.plan.offset:
            return (out.orderBy(*order, *sort) if order else out).select("id")
        out = out.orderBy(*order, *sort)
        if self.plan.offset:
            out = out.offset(self.plan.offset)
        return (out.limit(n) if n is not None else out).select("id")
