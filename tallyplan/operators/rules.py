"""Tables of rules over measured rows: names with alternatives, each a line of bounds that must all hold.

A line reads ``name column>=value column<value ...``; lines of one name are alternatives, and lines of ``!name`` are its
exceptions. The order of names is that of their first lines.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

_BOUND = re.compile(r"^([a-z_]+)(>=|<=|=|<|>)(-?\d+)$")


class Bound(NamedTuple):
    column: str
    op: str
    value: int


class Line(NamedTuple):
    name: str
    exception: bool
    bounds: tuple[Bound, ...]


def read(table: str) -> list[Line]:
    lines = []
    for text in table.strip().splitlines():
        name, *bounds = text.split()
        lines.append(Line(name.lstrip("!"), name.startswith("!"), tuple(Bound(c, op, int(v)) for c, op, v in (_BOUND.match(b).groups() for b in bounds))))
    return lines


def names(lines: list[Line]) -> list[str]:
    return list(dict.fromkeys(line.name for line in lines))


def _every(line: Line) -> str:
    return "(" + " AND ".join(f"`{b.column}` {b.op} {b.value}" for b in line.bounds) + ")"


def holds(lines: list[Line], name: str) -> Column:
    """Whether some alternative of the name holds and none of its exceptions does; one parsed expression, for tables have hundreds of bounds."""
    some, never = ([_every(line) for line in lines if line.name == name and line.exception == x] for x in (False, True))
    return F.expr(f"({' OR '.join(some) or 'false'}) AND NOT ({' OR '.join(never) or 'false'})")


def first(lines: list[Line]) -> Column:
    """The first name that holds, in the table's order; null if none does."""
    return F.coalesce(*(F.when(holds(lines, n), F.lit(n)) for n in names(lines)))


def all_names(lines: list[Line]) -> Column:
    """The names that hold, in the table's order, joined by commas."""
    return F.concat_ws(",", *(F.when(holds(lines, n), F.lit(n)) for n in names(lines)))


def sql(lines: list[Line], rows: str, identity: str, result: str) -> str:
    """The same by relational division: measures as rows, joined to the table's bounds. ``result`` aggregates over the
    names (name, pos) that hold; rows without any get its value over none."""
    columns = sorted({b.column for line in lines for b in line.bounds})
    order = names(lines)
    bounds = ", ".join(f"('{line.name}', {order.index(line.name)}, {k}, {str(line.exception).lower()}, '{b.column}', '{b.op}', {b.value})" for k, line in enumerate(lines) for b in line.bounds)
    return f"""bounds(name, pos, alt, exception, col, op, val) AS (VALUES {bounds}),
 measures AS (UNPIVOT (SELECT {identity}, {', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in columns)} FROM {rows}) ON {', '.join(columns)} INTO NAME col VALUE v),
 lines AS (SELECT {identity}, name, pos, alt, exception, bool_and(CASE op WHEN '>=' THEN v >= val WHEN '<=' THEN v <= val WHEN '=' THEN v = val WHEN '<' THEN v < val ELSE v > val END) AS ok FROM measures JOIN bounds USING (col) GROUP BY ALL),
 named AS (SELECT {identity}, name, pos FROM lines GROUP BY {identity}, name, pos HAVING bool_or(ok AND NOT exception) AND NOT bool_or(ok AND exception))
 SELECT r.{identity}, {result} FROM {rows} r LEFT JOIN named n ON n.{identity} = r.{identity} GROUP BY r.{identity}"""
