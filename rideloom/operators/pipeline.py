"""Layers, change capture, slowly changing dimensions and scheduling of steps."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rideloom.operators.relational import conjunction, fingerprint


def bronze(df: DataFrame, source: str, at: str | None = None) -> DataFrame:
    """Raw rows with a record id, their source and the time of ingestion."""
    return df.withColumns({"record_id": fingerprint(df.columns), "source_name": F.lit(source), "ingested_at": F.lit(at).cast("timestamp") if at else F.current_timestamp()})


def silver(df: DataFrame, required: Sequence[str], casts: Mapping[str, str], ranges: Mapping[str, tuple[float, float]], order: Sequence[Column]) -> DataFrame:
    """All rows with state accepted, rejected or repeated: required values, conversions, inclusive ranges, then the raw row's hash."""
    raw = df.columns
    x = df.withColumn("_hash", fingerprint(raw))
    present = conjunction([F.col(c).isNotNull() & (F.col(c).cast("string") != "") for c in required])
    x = x.withColumn("_in", present).withColumns({c: F.expr(f"try_cast(`{c}` AS {k})") for c, k in casts.items()})
    cast_ok = conjunction([F.col(c).isNotNull() for c in casts if c in required])
    in_range = conjunction([F.col(c).isNull() | F.col(c).between(*r) for c, r in ranges.items()])
    x = x.withColumn("_ok", F.coalesce(F.col("_in") & cast_ok & in_range, F.lit(False)))
    first = F.row_number().over(Window.partitionBy("_hash").orderBy(*order)) == 1
    return x.withColumn("state", F.when(~F.col("_ok"), "rejected").when(first, "accepted").otherwise("repeated")).drop("_hash", "_in", "_ok")


def since(df: DataFrame, column: str, watermark) -> DataFrame:
    """Rows past the watermark, all of them before the first load; rows without a value only come with a full load."""
    return df if watermark is None else df.where(F.col(column) > F.lit(watermark))


class IncrementalLoad:
    """Loads what is past a watermark and then advances it; a failed write leaves it as it was."""

    def __init__(self, column: str, watermark=None) -> None:
        self.column, self.watermark = column, watermark

    def run(self, source: DataFrame, write: Callable[[DataFrame], None]) -> int:
        new = since(source, self.column, self.watermark)
        facts = new.agg(F.count(F.lit(1)).alias("n"), F.max(self.column).alias("top")).first()
        write(new)
        if facts["top"] is not None:
            self.watermark = facts["top"]
        return facts["n"]


def apply_changes(target: DataFrame, changes: DataFrame, key: str, columns: Sequence[str], seq: str = "sequence", op: str = "operation") -> DataFrame:
    """Target state after inserts, updates and deletes: only each key's last change matters. changes holds the after image."""
    last = changes.groupBy(key).agg(F.max_by(F.struct(F.col(op).alias("_op"), *columns), seq).alias("x")).select(key, "x.*")
    kept = target.join(last.select(key), key, "left_anti").select(key, *columns)
    return kept.unionByName(last.where(F.upper("_op") != "DELETE").select(key, *columns))


def versions_of(changes: DataFrame, key: str, at: str, columns: Sequence[str]) -> DataFrame:
    """SCD-2 rows from partial changes: null columns keep their last value; valid_to is the next change, null while open."""
    w = Window.partitionBy(key).orderBy(at)
    carried = {c: F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)) for c in columns}
    x = changes.select(key, F.col(at).alias("valid_from"), F.lead(at).over(w).alias("valid_to"), F.row_number().over(w).alias("version"), *[c.alias(n) for n, c in carried.items()])
    return x.withColumn("is_current", F.col("valid_to").isNull())


def task_levels(tasks: Mapping[str, Sequence[str]]) -> list[list[str]]:
    """Tasks (name -> those it needs) by level of parallel execution; a cycle is an error."""
    left, levels, done = dict(tasks), [], set()
    while left:
        ready = sorted(t for t, needs in left.items() if all(n in done or n not in tasks for n in needs))
        if not ready:
            raise ValueError(f"cycle among {sorted(left)}")
        levels.append(ready)
        done |= set(ready)
        for r in ready:
            del left[r]
    return levels


def run_tasks(tasks: Mapping[str, tuple[Sequence[str], Callable[[], object]]]) -> dict[str, str]:
    """State of each task: success, failed, or skipped since one it needs did not succeed."""
    state: dict[str, str] = {}
    for level in task_levels({k: needs for k, (needs, _) in tasks.items()}):
        for name in level:
            needs, act = tasks[name]
            if any(state.get(n) != "success" for n in needs if n in tasks):
                state[name] = "skipped"
                continue
            try:
                act()
                state[name] = "success"
            except Exception:  # noqa: BLE001  a task may fail in any way
                state[name] = "failed"
    return state


def closure(edges: DataFrame, src: str, dst: str, starts: DataFrame, most_depth: int | None = None) -> DataFrame:
    """(start, node, depth): nodes reached from each start, at their least depth; a cycle may reach the start itself.

    Frontier by frontier until none is new: each step a join and an anti join, its result written to the shared folder.
    With most_depth, nodes beyond it are an error.
    """
    from rideloom.common import written

    e = edges.select(F.col(src).alias("_s"), F.col(dst).alias("node")).distinct()
    front = starts.select(F.col(starts.columns[0]).alias("start")).distinct().withColumn("at", F.col("start"))
    seen = None
    for depth in itertools.count(1):
        step = front.join(e, F.col("at") == F.col("_s")).select("start", "node").distinct()
        if seen is not None:
            step = step.join(seen, ["start", "node"], "left_anti")
        step = written(step.withColumn("depth", F.lit(depth)), "closure")
        if step.isEmpty():
            break
        if most_depth is not None and depth > most_depth:
            raise RuntimeError(f"nodes beyond depth {most_depth}")
        seen = step if seen is None else seen.unionByName(step)
        front = step.select("start", F.col("node").alias("at"))
    return seen if seen is not None else front.select("start", F.col("at").alias("node"), F.lit(0).alias("depth")).limit(0)
