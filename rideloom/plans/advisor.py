"""Advice on physical design, and what the optimiser did with a query."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame


def explain(df: DataFrame, mode: str = "formatted") -> str:
    """The physical plan as text."""
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


def plan_facts(df: DataFrame) -> dict[str, object]:
    """Pushed filters and partition filters, columns read, and counts of exchanges, joins and Python steps."""
    text = explain(df)
    return {
        "pushed": sorted({f for m in re.findall(r"PushedFilters: \[(.*?)\]", text) for f in m.split(", ") if f}),
        "partition": sorted({m for m in re.findall(r"PartitionFilters: \[(.*?)\]", text) if m}),
        "columns": sorted({c.split(":")[0] for m in re.findall(r"ReadSchema: struct<(.*?)>", text) for c in m.split(",") if c}),
        "steps": Counter(re.findall(r"\b(\w*Exchange|\w*Join|\w*Pandas|MapInArrow|Window)\b \(\d+\)", text)),
    }


def bloom_size(n: int, false_rate: float) -> tuple[int, int]:
    """Bits (64 at least) and hash functions of a bloom filter."""
    bits = max(64, math.ceil(-n * math.log(false_rate) / math.log(2) ** 2))
    return bits, max(1, round(bits / max(n, 1) * math.log(2)))


def index_for(distinct: int, rows: int, ranged: bool = False, sequential: bool = False) -> str:
    """Kind of skipping structure: min and max for ranges and sorted columns, a set for few values, bloom for many."""
    if ranged or sequential:
        return "minmax"
    if distinct < 100 or distinct / max(rows, 1) < 0.01:
        return "set"
    return "bloom" if distinct > 1000 else "minmax"


def partition_for(filter_counts: dict[str, int], days: int, rows: int) -> dict[str, object]:
    """Partition by the column filtered most, by day up to 90 days and by month beyond; with warnings."""
    if not filter_counts:
        return {"column": None, "grain": None, "warnings": []}
    column = min(filter_counts, key=lambda c: (-filter_counts[c], c))
    grain = "day" if days <= 90 else "month"
    parts = days if grain == "day" else math.ceil(days / 30)
    warn = [f"{parts} partitions"] * (parts > 1000) + [f"{rows / max(days, 1):.0f} rows a day"] * (rows / max(days, 1) < 1000)
    return {"column": column, "grain": grain, "warnings": warn}


@dataclass(frozen=True)
class Feature:
    """A feature's definition; names are unique within a group."""

    name: str
    dtype: str
    entity: str
    sla_s: int | None = None


@dataclass(frozen=True)
class FeatureGroup:
    name: str
    features: Sequence[Feature] = field(default_factory=tuple)

    def problems(self, df: DataFrame) -> list[str]:
        """Features a table lacks or holds in another type, and names given twice."""
        kinds = dict(df.dtypes)
        twice = [f"{n} twice" for n, k in Counter(f.name for f in self.features).items() if k > 1]
        return twice + [f"{f.name} is {kinds.get(f.name, 'missing')}, not {f.dtype}" for f in self.features if kinds.get(f.name) != f.dtype]
