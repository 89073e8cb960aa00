"""Rebuilding published tables beside the ones in use: a plan pinned to its inputs, an isolated replay, a comparison, a promotion that can be taken back.

Each replay is a generation, a folder of its own. What is in use is named by one pointer file
a change, created only if absent, so that a promotion is atomic and two can't both win.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators.snapshots import compared, typed_fingerprint
from tidemark.sources import published


class Refused(ValueError):
    """The generation may not be built or promoted."""


def _print(df: DataFrame) -> dict:
    r = typed_fingerprint(df).first()
    return {"rows": r["row_count"], "digest": r["digest_sum"]}


def plan(inputs: dict[str, DataFrame], settings: dict | None = None) -> dict:
    """The inputs' rows and digests, the settings, and the plan's own id."""
    return varied({"inputs": {name: _print(df) for name, df in sorted(inputs.items())}}, settings)


def varied(planned: dict, settings: dict | None = None) -> dict:
    """A plan of the same pinned inputs and other settings; the inputs aren't read again."""
    pinned = {"inputs": planned["inputs"], "settings": settings or {}}
    return pinned | {"id": hashlib.sha256(json.dumps(pinned, sort_keys=True).encode()).hexdigest()[:16]}


def _save(spark: SparkSession, path: str, value: dict) -> None:
    fs, at = published._fs(spark, path)
    stream = fs.create(at, False)
    stream.write(bytearray(json.dumps(value).encode()))
    stream.close()


def report(spark: SparkSession, root: str, generation: str) -> dict:
    """A whole generation's plan and tables."""
    fs, at = published._fs(spark, f"{root}/generations/{generation}/report.json")
    if not fs.exists(at):
        raise KeyError(f"generation {generation} isn't complete")
    return json.loads(spark.read.text(at.toString()).first()[0])


def replay(spark: SparkSession, root: str, generation: str, pinned: dict, inputs: dict[str, DataFrame], build: Callable[[dict[str, DataFrame]], dict[str, DataFrame]]) -> dict:
    """Builds a generation apart from what is in use; refused if an input isn't the planned one. The report is written last."""
    for name, want in pinned["inputs"].items():
        if name not in inputs or _print(inputs[name]) != want:
            raise Refused(f"{name} isn't the input that was planned")
    tables = {}
    for name, df in build(inputs).items():
        at = f"{root}/generations/{generation}/{name}"
        df.write.mode("errorifexists").parquet(at)
        tables[name] = _print(spark.read.parquet(at))
    found = {"generation": generation, "plan": pinned["id"], "settings": pinned["settings"], "tables": tables}
    _save(spark, f"{root}/generations/{generation}/report.json", found)
    return found


def table(spark: SparkSession, root: str, generation: str, name: str) -> DataFrame:
    report(spark, root, generation)
    return spark.read.parquet(f"{root}/generations/{generation}/{name}")


def reconcile(spark: SparkSession, root: str, one: str, two: str, keys: dict[str, list[str]]) -> dict[str, dict[str, int]]:
    """By table the keys that were added, removed or changed from one to two; equal digests aren't looked into."""
    a, b = report(spark, root, one)["tables"], report(spark, root, two)["tables"]
    out = {}
    for name in sorted(set(a) | set(b)):
        if name not in a or name not in b:
            out[name] = {"lacking": 1}
        elif a[name] == b[name]:
            out[name] = {}
        else:
            n = compared(table(spark, root, one, name), table(spark, root, two, name), keys[name]).groupBy("change").count().collect()
            # rows that repeat differ in number only
            out[name] = {r["change"]: r["count"] for r in n} or {"repeated": abs(a[name]["rows"] - b[name]["rows"])}
    return out


def pointers(spark: SparkSession, root: str) -> list[dict]:
    """Promotions and rollbacks, oldest first."""
    return published.history(spark, root)


def current(spark: SparkSession, root: str) -> str | None:
    found = published.history(spark, root, 1)
    return found[-1]["generation"] if found else None


def promote(spark: SparkSession, root: str, generation: str, checked_by: str, expected: str | None) -> int:
    """Puts a generation in use.

    checked_by: a second replay of the same plan; if its tables differ in any row, the
    promotion is refused. expected: what is in use now (None: nothing); Conflict if it isn't.
    """
    mine, other = report(spark, root, generation), report(spark, root, checked_by)
    if generation == checked_by or mine["plan"] != other["plan"]:
        raise Refused("a second replay of the same plan is needed")
    if mine["tables"] != other["tables"]:
        raise Refused(f"replays differ: {sorted(n for n in {*mine['tables'], *other['tables']} if mine['tables'].get(n) != other['tables'].get(n))}")
    return _point(spark, root, generation, "promote", expected)


def rollback(spark: SparkSession, root: str) -> str:
    """Puts the generation before the present one in use again, and returns it."""
    line: list[str] = []
    for p in pointers(spark, root):
        line = line[:-1] if p["operation"] == "rollback" else [*line, p["generation"]]
    if len(line) < 2:
        raise Refused("there is no generation before this one")
    _point(spark, root, line[-2], "rollback", line[-1])
    return line[-2]


def _point(spark: SparkSession, root: str, generation: str, operation: str, expected: str | None) -> int:
    past = pointers(spark, root)
    now = past[-1]["generation"] if past else None
    if now != expected:
        raise published.Conflict(f"{now} is in use, not {expected}")
    return published.write_commit(spark, root, {"version": len(past), "operation": operation, "operation_id": None, "generation": generation})


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of the generation in use."""
    now = current(spark, root)
    if now is None:
        raise KeyError(f"nothing is in use at {root}")
    return table(spark, root, now, name)
