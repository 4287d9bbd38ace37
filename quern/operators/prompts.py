"""Maps and joins through a text model. The model is any picklable function from prompt to answer."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.semi import embedded_json

Model = Callable[[str], str]


def numbered(items: list[str]) -> str:
    return "\n".join(f"{i}. {x}" for i, x in enumerate(items, 1))


def numbered_answers(text: str, n: int) -> list[str | None]:
    """The n lines '1. ...' of an answer; those that are missing are null."""
    got = {int(m[1]): m[2].strip() for m in re.finditer(r"(?m)^\s*(\d+)[.)]\s*(.*)$", text)}
    return [got.get(i) for i in range(1, n + 1)]


def batched(df: DataFrame, column: str, prompt: str, model: Model, size: int = 10, out: str = "answer") -> DataFrame:
    """df with the model's line for each value, in batches of one prompt."""
    schema = df.withColumn(out, F.lit(None).cast("string")).schema

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            got: list[str | None] = []
            for a in range(0, len(pdf), size):
                part = ["" if v is None else str(v) for v in pdf[column].iloc[a : a + size]]
                try:
                    got += numbered_answers(model(f"{prompt}\n{numbered(part)}"), len(part))
                except Exception:  # noqa: BLE001
                    got += [None] * len(part)
            yield pdf.assign(**{out: got})

    return df.mapInPandas(run, schema)


def into_schema(df: DataFrame, column: str, fields: dict[str, list[str] | None], model: Model, allow_new: bool = False) -> DataFrame:
    """df with mapped: JSON text cast by a model into fields; a field with choices drops other values."""
    schema = df.withColumn("mapped", F.lit(None).cast("string")).schema

    def one(text: Any) -> str | None:
        try:
            got = embedded_json(model(f"Fields: {json.dumps(fields)}\nObject: {text}"))
        except ValueError:
            return None
        if not isinstance(got, dict):
            return None
        keep = {k: v for k, v in got.items() if k in fields and (allow_new or fields[k] is None or v in fields[k])}
        return json.dumps(keep, sort_keys=True)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pdf.assign(mapped=pdf[column].map(one))

    return df.mapInPandas(run, schema)


def fuzzy_join(wanted: DataFrame, stored: list[dict[str, Any]], ident: str, text: str, model: Model, chunk: int = 50, k: int = 3) -> DataFrame:
    """(id, match, confidence): the k stored objects that a model finds most alike, from answers as JSON lists of
    {"id", "confidence"}. The stored list is bounded by what the caller can hold; it is shown in chunks."""
    kind = wanted.schema[ident].dataType.simpleString()
    parts = [stored[a : a + chunk] for a in range(0, len(stored), chunk)]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for i, t in zip(pdf[ident], pdf[text]):
                found: list[tuple[float, str]] = []
                for part in parts:
                    try:
                        answer = embedded_json(model(f"Find: {t}\nAmong: {json.dumps(part)}"))
                    except ValueError:
                        continue
                    found += [(float(x["confidence"]), str(x["id"])) for x in answer if isinstance(x, dict) and "id" in x and "confidence" in x]
                rows += [(i, m, c) for c, m in sorted(found, key=lambda x: (-x[0], x[1]))[:k]]
            yield pd.DataFrame(rows, columns=["id", "match", "confidence"])

    return wanted.select(ident, text).mapInPandas(run, f"id {kind}, match string, confidence double")


def tag_groups(answer: str, known: set[str]) -> list[list[str]]:
    """Groups of tags from an answer with a JSON list of lists, or lines of comma-separated tags; unknown ones go."""
    try:
        got = embedded_json(answer)
        groups = got if all(isinstance(g, list) for g in got) else [got]
    except (ValueError, TypeError):
        groups = [line.split(",") for line in answer.splitlines()]
    kept = [[t for x in g if (t := str(x).strip().lower()) in known] for g in groups]
    return [g for g in kept if g]
