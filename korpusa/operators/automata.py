"""Line automata: finite control and carried values over the ordered lines of many texts, long ones in pieces.

A machine reads a text's lines in order. Its control is one of few states; beside it stand registers, values
that a line may set or clear but that never steer the control. So what a stretch of lines does is a small
table, for each state it may begin in: the state it ends in and the registers it leaves changed. Such tables
compose, which makes a run a prefix scan: texts are cut into segments, each segment's table is worked out on
its own, the tables of a text are composed in order, and then all segments run at once, each from the state and
the registers it begins with. Texts of one segment, nearly all, need one shuffle and no tables.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Stands for the place of the line that sets a register.
HERE = "\x00here"
SEGMENT = 4096


@dataclass(frozen=True)
class Machine:
    """``step(state, line, flag)`` gives the next state, register changes (None clears) and the line's role.

    State 0 is the first one, all registers are empty there. ``flag`` is what the caller knows of a line beyond its text.
    """

    states: int
    registers: tuple[str, ...]
    step: Callable[[int, str, int], tuple[int, dict[str, str | None], str]]


def _summary(machine: Machine, rows: list[tuple[int, str, int]]) -> str:
    """What a segment does from each state, as JSON."""
    out = []
    for start in range(machine.states):
        state, changed = start, {}
        for n, line, flag in rows:
            state, sets, _ = machine.step(state, line, flag)
            for r, v in sets.items():
                changed[r] = str(n) if v == HERE else v
        out.append([state, changed])
    return json.dumps(out)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows of each key and segment of a partition in that order, however the batches are cut."""
    at, held = None, []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if row[:2] != at and held:
                yield at, held
                held = []
            at = row[:2]
            held.append(row[2:])
    if held:
        yield at, held


def run(lines: DataFrame, machine: Machine, key: str = "doc_id", segment: int = SEGMENT) -> DataFrame:
    """``lines(key, n, line[, flag])`` with ``role`` and the registers as they are after each line.

    ``n`` counts a text's lines from 0 and may leave out some. Lines are strings, null ones count as empty;
    rows without key are one text. No task holds more than one segment and, in the fold of the tables,
    one row for each segment of a text.
    """
    flag = F.col("flag").cast("int") if "flag" in lines.columns else F.lit(0)
    kind = lines.schema[key].dataType.simpleString()
    rows = lines.select(F.col(key).alias("k"), F.floor(F.col("n") / segment).alias("seg"), F.col("n").cast("long").alias("n"), F.coalesce("line", F.lit("")).alias("line"), flag.alias("flag"))
    long = rows.where("seg > 0").select(F.col("k").alias("long")).distinct()
    if long.limit(1).count():
        entries = _entries(rows.join(long, F.col("k").eqNullSafe(F.col("long")), "left_semi"), machine, kind)
        begun = entries.withColumnsRenamed({"k": "k2", "seg": "seg2"})
        rows = rows.join(begun, F.col("k").eqNullSafe(F.col("k2")) & (F.col("seg") == F.col("seg2")), "left").drop("k2", "seg2")
    else:
        rows = rows.withColumns({"state": F.lit(None).cast("int"), "held": F.lit(None).cast("string")})
    names = machine.registers

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, values = None, 0, {}
        for b in batches:
            # registers change on few lines: each batch keeps their versions, and the number of its version for each line
            versions, place, roles = [tuple(values.values())], [], []
            ks, segs, ns, texts, marks = (b.column(c).to_pylist() for c in ("k", "seg", "n", "line", "flag"))
            for i, (k, seg, n, line, mark) in enumerate(zip(ks, segs, ns, texts, marks, strict=True)):
                if at != (k, seg):
                    at, state = (k, seg), b.column("state")[i].as_py() or 0
                    values = dict.fromkeys(names) | json.loads(b.column("held")[i].as_py() or "{}")
                    versions.append(tuple(values.values()))
                state, sets, role = machine.step(state, line, mark)
                if sets:
                    for r, v in sets.items():
                        values[r] = str(n) if v == HERE else v
                    versions.append(tuple(values.values()))
                place.append(len(versions) - 1)
                roles.append(role)
            own = pa.array(place, pa.int32())
            if not versions[0]:  # before the first line of all
                versions[0] = (None,) * len(names)
            registers = [pa.array([v[j] for v in versions], pa.string()).take(own) for j in range(len(names))]
            yield pa.RecordBatch.from_arrays([b.column("k"), b.column("n"), b.column("line"), pa.array(roles, pa.string()), *registers], ["k", "n", "line", "role", *names])

    schema = ", ".join(["k " + kind, "n long", "line string", "role string", *(f"{r} string" for r in names)])
    return rows.repartition("k", "seg").sortWithinPartitions("k", "seg", "n").mapInArrow(go, schema).withColumnRenamed("k", key)


def _typed(batches: Iterator[pa.RecordBatch], box: list) -> Iterator[pa.RecordBatch]:
    """The batches; the type of their first column goes into ``box``."""
    for b in batches:
        if not box:
            box.append(b.column(0).type)
        yield b


def _entries(rows: DataFrame, machine: Machine, kind: str) -> DataFrame:
    """``(k, seg, state, held)``: what each segment of a text begins with."""

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        box: list = []
        for (k, seg), held in _pieces(_typed(batches, box)):
            yield pa.RecordBatch.from_arrays([pa.array([k], box[0]), pa.array([seg], pa.int64()), pa.array([_summary(machine, held)])], ["k", "seg", "table"])

    def fold(own: pa.Table) -> pa.Table:
        own = own.sort_by("seg")
        state, values, states, held = 0, {}, [], []
        for table in own["table"].to_pylist():
            states.append(state)
            held.append(json.dumps(values))
            state, changed = json.loads(table)[state]
            values = values | changed
        return pa.table({"k": own["k"], "seg": own["seg"], "state": pa.array(states, pa.int32()), "held": pa.array(held, pa.string())})

    dealt = rows.repartition("k", "seg").sortWithinPartitions("k", "seg", "n")
    return dealt.mapInArrow(tables, f"k {kind}, seg long, table string").groupBy("k").applyInArrow(fold, f"k {kind}, seg long, state int, held string")
