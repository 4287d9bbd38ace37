"""The search language: text and JSON forms, and golden searches over objects and related tables."""

import json
import random
import string

import pytest
from pyspark.sql import functions as F

from quern.plans.catalog import Catalog, ValidationError
from quern.plans.cond import Join, Leaf, Op, Tree
from quern.plans.parse import QueryError, field_and_op, parse
from quern.plans.search import matching, search, search_rows

RNG = random.Random(20)
LETTERS = string.ascii_letters + "_"


def word(most: int) -> str:
    """A name of the grammar: a letter or underscore, then letters, digits and underscores."""
    return RNG.choice(LETTERS) + "".join(RNG.choices(LETTERS + string.digits, k=RNG.randint(0, most)))


def scalar(kind: str) -> tuple[str, object]:
    """A literal of a kind, and what it means."""
    if kind == "quoted":
        value = "".join(RNG.choices(string.ascii_letters + string.digits + " ,.;:()[]|&!'\"\\\n\t\u00e9\u4e2d", k=RNG.randint(0, 20)))
        return json.dumps(value), value
    if kind == "bare":
        value = "b" + word(12)
        return value, value
    if kind == "flag":
        value = RNG.random() < 0.5
        return "".join(RNG.choice((c.upper(), c)) for c in str(value).lower()), value
    value = RNG.randint(-(10**9), 10**12) if kind == "whole" else round(RNG.uniform(-1000, 1000), 5)
    return repr(value), value


def listed() -> tuple[str, object]:
    items = [scalar(RNG.choice(("quoted", "whole", "real"))) for _ in range(RNG.randint(0, 5))]
    return "[" + ", ".join(t for t, _ in items) + "]", [v for _, v in items]


FIELDS = [word(n) for n in (0, 1, 5, 9, 14, 60)]
VALUES = [scalar(kind) for kind in ("quoted", "bare", "flag", "whole", "real") for _ in range(4)] + [listed() for _ in range(6)]


@pytest.mark.parametrize("op", [o for o in Op if o.value not in ("?", "!?", "?+", "!?+")])
@pytest.mark.parametrize("text,value", VALUES)
def test_every_operator_with_every_value(op, text, value):
    for f in FIELDS:
        assert parse(f"{f} {op.value} {text}") == Leaf(f, op, value)
        assert parse(f"{f}{op.value}{text}") == Leaf(f, op, value)


@pytest.mark.parametrize("op", [Op.EXISTS, Op.NOT_EXISTS, Op.IS_NULL, Op.IS_NOT_NULL])
def test_existence(op):
    for f in FIELDS:
        assert parse(f"{f} {op.value}") == Leaf(f, op)


def test_joins_and_parentheses():
    a, b = Leaf("name", Op.EQ, "John"), Leaf("age", Op.GT, 25)
    assert parse('name = "John", age > 25') == parse('(name = "John" & age > 25)') == Tree(Join.AND, (a, b))
    assert parse("name = John | age > 25") == Tree(Join.OR, (a, b))
    assert parse("!(age > 25)") == Tree(Join.NOT, (b,))
    assert parse("((name = John, age > 25) | !(name = John))") == Tree(Join.OR, (Tree(Join.AND, (a, b)), Tree(Join.NOT, (a,))))


@pytest.mark.parametrize("text", ["invalid query", 'name = "John" age > 25', 'name ^ "John"', 'name = "John")', '(name = "John"', "a = 1, b = 2 | c = 3", "", "a = [1"])
def test_errors(text):
    with pytest.raises(QueryError):
        parse(text)


def test_json_forms():
    assert parse(["&", ["a", "~", "x"], ["b", ">=", 2020]]) == Tree(Join.AND, (Leaf("a", Op.LIKE, "x"), Leaf("b", Op.GTE, 2020)))
    assert parse(json.dumps({"name~": "john", "age>": 5, "eyes:": ["blue"]})) == Tree(Join.AND, (Leaf("name", Op.LIKE, "john"), Leaf("age", Op.GT, 5), Leaf("eyes", Op.IN, ["blue"])))
    assert parse(["not", ["draft", "=", True]]) == Tree(Join.NOT, (Leaf("draft", Op.EQ, True),))
    assert field_and_op("x!?+") == ("x", Op.IS_NULL) and field_and_op("plain") == ("plain", Op.EQ)
    for bad in ([], ["a", "%", 1], ["&"], ["a"], {}):
        with pytest.raises(QueryError):
            parse(bad)


def test_filter_keeps_not():
    t = parse("!((a = 1, b = 2))")
    assert t.filter(lambda c: c.field == "a") == Tree(Join.NOT, (Leaf("a", Op.EQ, 1),))
    assert t.filter(lambda c: False) is None


@pytest.fixture(scope="module")
def people(spark):
    rows = [("John", 30, ["a", "b"], "active", "gemini", True), ("Jane", 25, ["b", "c"], None, "libra", True), ("Bob", 35, ["a", "c"], "inactive", "scorpio", True), ("Alice", 28, None, None, "virgo", False)]
    df = spark.createDataFrame(rows, "name string, age int, tags array<string>, status string, zodiac string, t boolean")
    has = F.create_map(*[x for c in ("name", "age", "status", "zodiac") for x in (F.lit(c), F.lit(True))], F.lit("tags"), F.col("t"))
    return df.withColumn("has", has)


GOLDEN = [
    ("age > 30", "Bob"), ('name ~ "J"', "Jane John"), ('age > 25, name ~ "J"', "John"), ("age < 30 | age > 33", "Alice Bob Jane"), ("tags ?", "Bob Jane John"), ("tags !?", "Alice"), ("tags ?+", "Bob Jane John"),
    ("status !?+", "Alice Jane"), ("status ?+", "Bob John"), ('zodiac : ["gemini", "scorpio"]', "Bob John"), ('name !: ["John", "Jane"]', "Alice Bob"), ("tags @ a", "Bob John"), ('tags !@ "b"', "Bob"),
    ("!(status = active)", "Alice Bob Jane"), ("nothing = 1", ""), ("nothing !?", "Alice Bob Jane John"),
]


@pytest.mark.parametrize("query,names", GOLDEN)
def test_objects(people, query, names):
    got = matching(people, query, presence="has").select("name").collect()
    assert " ".join(sorted(r[0] for r in got)) == names


def test_rerank(people):
    got = search_rows(people, "(age > 26 | name ~ J)", "name", 10, presence="has", rerank=True).collect()
    assert [r["id"] for r in got] == ["Alice", "Bob", "Jane", "John"] and got[0]["score"] == pytest.approx(1.1)
    with pytest.raises(ValidationError):
        search_rows(people, "age > 1", "name", 0)


@pytest.fixture(scope="module")
def movies(spark):
    item = spark.createDataFrame([(1, "movie", "Up", '{"runtime": 96}'), (2, "movie", "Long", '{"runtime": 220}'), (3, "person", "Ann", "{}"), (4, "genre", "Drama", None)], "id long, otype string, name string, md string")
    score = spark.createDataFrame([(1, "budget", 10.0), (1, "rating", 9.0), (2, "budget", 90.0), (2, "rating", 3.0)], "id long, tag string, score double")
    rel = spark.createDataFrame([(1, 4, "genre"), (2, 4, "genre"), (3, 1, "acted")], "src long, tgt long, rtype string")
    aliases = {"long": "md.runtime", "budget": {"type": "score_condition", "tag_field": "budget"}, "cheap_hit": {"type": "multi_score_condition", "conditions": [{"tag_field": "budget", "op": "<", "value": 50}, {"tag_field": "rating", "op": ">", "value": 5}]}, "genre": {"type": "nested_relation", "path": "rel_src.tgt.name"}}
    return Catalog(item, "id", {"score": (score, ["id"]), "rel": (rel, ["src", "tgt"])}, {"main": {"md"}}, aliases)


CASES = [
    (["otype", "=", "movie"], [1, 2]), (["name", "~", "u"], [1]), (["id", ":", [1, 3]], [1, 3]), (["id", "!:", [1, 3]], [2, 4]), (["md.runtime", ">=", 100], [2]), (["long", "<", 100], [1]), (["md.runtime", "=", 96], [1]),
    (["&", ["score.tag", "=", "budget"], ["score.score", ">", 50]], [2]), (["&", ["score.1.tag", "=", "budget"], ["score.2.tag", "=", "rating"], ["score.2.score", ">", 5]], [1]), (["budget", ">", 50], [2]), (["cheap_hit", "=", True], [1]),
    (["genre", "=", "Drama"], [1, 2]), (["rel_tgt.rtype", "=", "acted"], [1]), (["md", "!?"], [4]), (["|", ["name", "=", "Ann"], ["score.score", ">", 80]], [2]),
    ({"otype": "movie", "$order": "-md.runtime", "$limit": 1}, [2]), ({"otype": "movie", "$order": "name", "$offset": 1}, [1]), ({"$order": "-score.score", "otype": "movie", "$limit": 2}, [2, 1]),
]


@pytest.mark.parametrize("query,ids", CASES)
def test_related(movies, query, ids):
    got = [r[0] for r in search(movies, query, None).collect()]
    assert (got if isinstance(query, dict) else sorted(got)) == ids


@pytest.mark.parametrize("query", [["nope", "=", 1], ["score.9999.tag", "=", "x"], ["rel.rtype", "=", "x"], ["$limit", "=", 0], ["$order", "~", "x"], ["id", ":", 3], ["a..b", "=", 1], ["name", "@", "x"], ["name", "=", None]])
def test_refused(movies, query):
    with pytest.raises((ValidationError, QueryError)):
        search(movies, query, None)


def test_semi_joins_where_conditions_allow(movies):
    plan = lambda q: search(movies, q, None)._jdf.queryExecution().optimizedPlan().toString()
    apart = plan(["&", ["score.tag", "=", "budget"], ["score.score", ">", 50], ["otype", "=", "movie"]])
    assert "LeftSemi" in apart and "Aggregate" not in apart
    assert "LeftSemi" in plan(["genre", "=", "Drama"])
    mixed = plan(["|", ["score.1.score", ">", 50], ["score.2.score", "<", 5]])
    assert "Inner" in mixed and "Aggregate" in mixed
