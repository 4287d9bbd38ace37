"""Cached units of work wired by their types, calls with memory and a rate, and sources by address."""

from __future__ import annotations

import hashlib
import json
import time
from collections import defaultdict
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession


def _key(*parts: Any) -> str:
    return hashlib.md5(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()


@dataclass
class Task:
    """Makes a DataFrame from DataFrames; its result is kept as Parquet under the key of its settings and inputs."""

    name: str
    takes: tuple[str, ...]
    gives: str
    run: Callable[..., DataFrame]
    settings: tuple[tuple[str, Any], ...] = ()


class Runner:
    """Runs tasks once all kinds they take exist. A result that is stored already is loaded and not made again."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.made: list[str] = []

    def load_or_run(self, task: Task, inputs: dict[str, tuple[str, DataFrame]]) -> tuple[str, DataFrame]:
        key = _key(task.name, task.settings, sorted(k for k, _ in inputs.values()))
        path = f"{self.folder}/{task.name}-{key}"
        done = self.spark._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
        if not done.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(done):
            task.run(**{k: df for k, (_, df) in inputs.items()}, **dict(task.settings)).write.mode("overwrite").parquet(path)
            self.made.append(task.name)
        return key, self.spark.read.parquet(path)

    def run(self, tasks: list[Task], seeds: dict[str, tuple[str, DataFrame]]) -> dict[str, DataFrame]:
        """seeds: kind -> (version, table). Returns the table of every kind."""
        have = {k: (_key("seed", k, v), df) for k, (v, df) in seeds.items()}
        todo = list(tasks)
        while todo:
            ready = [t for t in todo if all(k in have for k in t.takes)]
            if not ready:
                raise ValueError(f"nothing gives what {[t.name for t in todo]} take")
            for t in ready:
                have[t.gives] = self.load_or_run(t, {k: have[k] for k in t.takes})
                todo.remove(t)
        return {k: df for k, (_, df) in have.items()}


class Calls:
    """A function with memory for `ttl` seconds (0: none, None: for good) and at most `rate` calls a second."""

    def __init__(self, call: Callable[..., Any], ttl: float | None = None, rate: float | None = None, clock: Callable[[], float] = time.time, sleep: Callable[[float], None] = time.sleep):
        self.call, self.ttl, self.rate, self.clock, self.sleep = call, ttl, rate, clock, sleep
        self.known: dict[str, tuple[float, Any]] = {}
        self.past: dict[str, list[tuple[float, Any]]] = defaultdict(list)
        self.last = float("-inf")

    def __call__(self, *args: Any) -> Any:
        k = _key(*args)
        if k in self.known and (self.ttl is None or self.clock() - self.known[k][0] < self.ttl):
            return self.known[k][1]
        if self.rate and (wait := self.last + 1 / self.rate - self.clock()) > 0:
            self.sleep(wait)
        self.last = self.clock()
        if k in self.known:
            self.past[k].append(self.known[k])
        self.known[k] = (self.clock(), self.call(*args))
        return self.known[k][1]

    def many(self, items: Iterable[Any]) -> list[Any]:
        """Results in the order of the items."""
        return [self(x) for x in items]


class Sources:
    """Readers by name; an address goes to the first that says it can read it."""

    def __init__(self) -> None:
        self.known: dict[str, tuple[Callable[[str], bool], Callable[[SparkSession, str], DataFrame]]] = {}

    def add(self, name: str, fits: Callable[[str], bool], read: Callable[[SparkSession, str], DataFrame]) -> None:
        self.known[name] = (fits, read)

    def read(self, spark: SparkSession, address: str) -> DataFrame:
        for fits, read in self.known.values():
            if fits(address):
                return read(spark, address)
        raise ValueError(f"no source reads {address!r}")
