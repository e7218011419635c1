"""Registries by name, configuration merging and rank layouts: driver-side utilities."""

from __future__ import annotations

import importlib
from collections.abc import Callable, Mapping
from copy import deepcopy
from itertools import product
from typing import Any

from pyspark.sql import DataFrame, SparkSession


class Registry:
    """Names to builders; a name is taken once, an unknown one is an error."""

    def __init__(self, what: str):
        self.what, self._entries = what, {}

    def register(self, name: str, entry: Any) -> Any:
        if name in self._entries:
            raise ValueError(f"{self.what} {name!r} is already registered")
        self._entries[name] = entry
        return entry

    def get(self, name: str) -> Any:
        if name not in self._entries:
            raise ValueError(f"unknown {self.what} {name!r}; known: {sorted(self._entries)}")
        entry = self._entries[name]
        if isinstance(entry, str):
            module, _, attribute = entry.rpartition(".")
            entry = getattr(importlib.import_module(module), attribute)
        return entry

    def names(self) -> list[str]:
        return sorted(self._entries)


#: Row processors: DataFrame -> DataFrame. Scorers: a pair of columns and metrics. Datasets: (spark, config) -> DataFrame.
processors, environments, datasets = Registry("processor"), Registry("environment"), Registry("dataset")
processors.register("default", lambda df: df)


def process_by_task(rows: DataFrame, by_task: Mapping[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Each task's rows through its processor; a task without one is an error. The tasks' results must share a schema."""
    from pyspark.sql import functions as F

    known = F.col("task_name").isin(list(by_task))
    checked = rows.filter(F.when(~F.coalesce(known, F.lit(False)), F.raise_error(F.concat(F.lit("no processor for "), F.coalesce("task_name", F.lit("null")))).cast("boolean")).otherwise(True))
    parts = [f(checked.filter(F.col("task_name") == t)) for t, f in by_task.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def load_dataset(spark: SparkSession, config: Mapping[str, Any]) -> DataFrame:
    """A registered dataset by ``dataset_name``, bound to its processor (``processor``, default ``default``)."""
    rows = datasets.get(config["dataset_name"])(spark, config)
    return processors.get(config.get("processor", "default"))(rows)


def with_defaults(config: Mapping, defaults: Mapping) -> dict:
    """Missing keys filled in."""
    return {**defaults, **config}


def deep_merge(base: Mapping, extra: Mapping) -> dict:
    """Later wins; dicts merge, anything else (lists too) is replaced whole."""
    out = deepcopy(dict(base))
    for k, v in extra.items():
        out[k] = deep_merge(out[k], v) if isinstance(out.get(k), Mapping) and isinstance(v, Mapping) else deepcopy(v)
    return out


def merge_override(base: Mapping, extra: Mapping) -> dict:
    """As ``deep_merge``, but a section marked ``_override_`` replaces the base's."""
    out = deepcopy(dict(base))
    for k, v in extra.items():
        if isinstance(v, Mapping):
            v = dict(v)
            replace = bool(v.pop("_override_", False))
            out[k] = merge_override({} if replace or not isinstance(out.get(k), Mapping) else out[k], v)
        else:
            out[k] = deepcopy(v)
    return out


def inherited(configs: Mapping[str, Mapping], name: str) -> dict:
    """A config over its ``defaults`` (a name or names), each over its own."""
    own = dict(configs[name])
    parents = own.pop("defaults", [])
    base: dict = {}
    for p in [parents] if isinstance(parents, str) else parents:
        base = merge_override(base, inherited(configs, p))
    return merge_override(base, own)


def resolve(node: Any, root: Any = None) -> Any:
    """``${mul:a,b}``, ``${max:a,b}``, ``${add:a,b}`` and ``${path.to.key}`` put in."""
    import re

    root = node if root is None else root
    if isinstance(node, Mapping):
        return {k: resolve(v, root) for k, v in node.items()}
    if isinstance(node, list):
        return [resolve(v, root) for v in node]
    if not isinstance(node, str):
        return node

    def look(path: str) -> Any:
        at = root
        for part in path.split("."):
            at = at[part]
        return resolve(at, root)

    def value(text: str) -> Any:
        text = text.strip()
        if m := re.fullmatch(r"\$\{(.*)\}", text, re.S):
            inner = m[1]
            if f := re.match(r"(mul|max|add):", inner):
                args = [value(a) for a in _arguments(inner[f.end() :])]
                if f[1] == "mul":
                    out = 1
                    for a in args:
                        out *= a
                    return out
                return max(args) if f[1] == "max" else sum(args)
            return look(inner)
        for kind in (int, float):
            try:
                return kind(text)
            except ValueError:
                pass
        return text

    return value(node) if node.strip().startswith("${") else node


def _arguments(text: str) -> list[str]:
    out, depth, at = [], 0, 0
    for i, c in enumerate(text):
        depth += (c == "{") - (c == "}")
        if c == "," and not depth:
            out.append(text[at:i])
            at = i + 1
    return [*out, text[at:]]


def lookup_path(config: Mapping, path: str) -> Any:
    """A dotted path into nested config; null if missing."""
    at: Any = config
    for part in path.split("."):
        if not isinstance(at, Mapping) or part not in at:
            return None
        at = at[part]
    return at


class RankLayout:
    """Ranks on a grid of named axes, as a small table."""

    def __init__(self, shape: Mapping[str, int], ranks: list[int] | None = None):
        self.names, self.shape = list(shape), dict(shape)
        cells = list(product(*(range(n) for n in shape.values())))
        ranks = list(range(len(cells))) if ranks is None else ranks
        if len(ranks) != len(cells) or len(set(ranks)) != len(ranks):
            raise ValueError("ranks must be unique and fill the grid")
        self.at = dict(zip(cells, ranks, strict=True))

    def _checked(self, coords: Mapping[str, int]) -> None:
        for name in coords:
            if name not in self.shape:
                raise ValueError(f"unknown axis {name!r}; known: {self.names}")

    def coords(self, rank: int) -> dict[str, int]:
        for cell, r in self.at.items():
            if r == rank:
                return dict(zip(self.names, cell, strict=True))
        raise ValueError(f"rank {rank} isn't in the layout")

    def ranks_by_coord(self, **coords: int) -> list[int]:
        """Ranks with these coordinates, ascending; none if one is out of range."""
        self._checked(coords)
        return sorted(r for cell, r in self.at.items() if all(cell[self.names.index(n)] == c for n, c in coords.items()))

    def ranks(self, **coords: int) -> RankLayout | int:
        """The layout over the other axes, or the rank if none is left; out of range is an IndexError."""
        self._checked(coords)
        for n, c in coords.items():
            if not 0 <= c < self.shape[n]:
                raise IndexError(f"{n}={c}")
        rest = {n: s for n, s in self.shape.items() if n not in coords}
        hits = [r for cell, r in sorted(self.at.items()) if all(cell[self.names.index(n)] == c for n, c in coords.items())]
        return RankLayout(rest, hits) if rest else hits[0]

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(r, *cell) for cell, r in self.at.items()]
        return spark.createDataFrame(rows, "rank int, " + ", ".join(f"{n} int" for n in self.names))
