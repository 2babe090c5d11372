"""Review commands (ids of the blueprint in brackets): parsing on the driver, effects as table operations."""

from __future__ import annotations

import shlex
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import candidates

STATUSES = ("pending", "approved", "rejected", "merged_into_entity", "inactive")


@dataclass(frozen=True)
class Command:
    name: str
    args: tuple[str, ...] = ()
    options: dict[str, str] = field(default_factory=dict)


def parse(line: str) -> Command:
    """"name a b key=value"; a leading colon is allowed."""
    parts = shlex.split(line.strip().removeprefix(":"))
    if not parts:
        raise ValueError("empty command")
    options = dict(p.split("=", 1) for p in parts[1:] if "=" in p and p[0] not in "<>=")
    return Command(parts[0].lower(), tuple(p for p in parts[1:] if not ("=" in p and p[0] not in "<>=")), options)


def validate(command: Command, kinds: tuple[str, ...]) -> list[str]:
    """What is wrong with a command's options."""
    wrong = []
    if (kind := command.options.get("type")) and kind.upper() not in kinds:
        wrong.append(f"unknown type: {kind}")
    if (status := command.options.get("status")) and status.lower() not in STATUSES:
        wrong.append(f"unknown status: {status}")
    if (value := command.options.get("confidence")) is not None:
        try:
            if not 0 <= float(value) <= 1:
                wrong.append(f"confidence out of range: {value}")
        except ValueError:
            wrong.append(f"confidence is no number: {value}")
    return wrong


def apply(rows: DataFrame, command: Command) -> DataFrame:
    """[F5, F6, F16, F17, Q35] filter, sort and threshold commands as table operations."""
    o = command.options
    if command.name == "filter":
        return candidates.queue(rows, o.get("status"), [o["type"].upper()] if "type" in o else None, float(o["confidence"]) if "confidence" in o else None, o.get("text") or (command.args[0] if command.args else None))
    if command.name == "sort":
        return candidates.sort(rows, command.args[0] if command.args else "confidence", o.get("order", "desc") == "desc")
    if command.name in ("approve", "reject", "threshold") and command.args:
        return candidates.threshold(rows, command.args[0])
    raise ValueError(f"unknown command: {command.name}")


def step(position: int, by: int, hits: int) -> int:
    """Next or previous search hit, around the end."""
    return (position + by) % hits if hits else 0


def session_statistics(events: DataFrame) -> DataFrame:
    """[A20] kind, n, and decisions a minute over the session; events: ts, kind (approve, reject, merge, ...)."""
    span = events.agg(F.greatest((F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts"))) / 60, F.lit(1 / 60)).alias("minutes"))
    return events.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).crossJoin(span).select("kind", "n", (F.col("n") / F.col("minutes")).alias("per_minute"))  # one row
