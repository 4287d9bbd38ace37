"""What a search needs to know of its tables: keys, foreign keys, JSON columns, aliases."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame

MAX_IN = 1000
MAX_FIELD = 200
MAX_PARTS = 10


class ValidationError(ValueError):
    pass


@dataclass
class Catalog:
    """main: the table whose ids a search returns. related: other tables with the columns that refer to main's id.
    json_columns: by table. aliases: see expand()."""

    main: DataFrame
    key: str = "id"
    related: dict[str, tuple[DataFrame, list[str]]] = field(default_factory=dict)
    json_columns: dict[str, set[str]] = field(default_factory=dict)
    aliases: dict[str, Any] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for name, (df, keys) in self.related.items():
            if not re.fullmatch(r"[\w-]{1,64}", name):
                raise ValidationError(f"bad table name {name!r}")
            if missing := [k for k in keys if k not in df.columns]:
                raise ValidationError(f"{name} has no column {missing}")

    def named(self) -> dict[str, tuple[str, str]]:
        """Names by which a query may join: `table`, or `table_key` where a table refers to main more than once."""
        out = {}
        for name, (_, keys) in self.related.items():
            for k in keys:
                out[name if len(keys) == 1 else f"{name}_{k}"] = (name, k)
        return out


def check_field(name: str) -> None:
    parts = name.split(".")
    if not name or len(name) > MAX_FIELD or len(parts) > MAX_PARTS or not all(parts):
        raise ValidationError(f"bad field {name!r}")
