"""Build one statement out of named parts and a result schema."""

from __future__ import annotations

import re

from shelfcast.plans.present import DECIMALS, NUDGE, fields


def _shown(name: str, kind: str) -> str:
    name = f'"{name}"'
    if kind in DECIMALS:
        rounded = f"round(CAST({name} AS DOUBLE) + CAST({NUDGE} AS DOUBLE), {DECIMALS[kind]})"
        return f"CASE WHEN {rounded} = 0 THEN CAST(0 AS DOUBLE) ELSE {rounded} END AS {name}"
    if kind == "t":
        return f"strftime({name}, '%Y-%m-%d') AS {name}"
    if kind == "T":
        return f"strftime({name}, '%Y-%m-%d %H:%M:%S') AS {name}"
    return f"CAST({name} AS {dict(s='VARCHAR', i='BIGINT', b='BOOLEAN')[kind]}) AS {name}"


def _needed(sql: str, parts: dict[str, str]) -> list[str]:
    """Parts mentioned in `sql`, each after the parts it mentions itself."""
    order: list[str] = []

    def visit(text: str) -> None:
        for word in dict.fromkeys(re.findall(r"[a-z_][a-z0-9_]*", text)):
            if word in parts and word not in order:
                visit(parts[word])
                order.append(word)

    visit(sql)
    return order


def statement(sql: str, schema: str, parts: dict[str, str]) -> str:
    named = [f"{name} AS MATERIALIZED (\n{parts[name].strip()}\n)" for name in _needed(sql, parts)]
    named.append(f"answer AS (\n{sql.strip()}\n)")
    shown = ",\n  ".join(_shown(name, kind) for name, kind in fields(schema))
    return "WITH RECURSIVE " + ",\n".join(named) + f"\nSELECT {shown}\nFROM answer"
