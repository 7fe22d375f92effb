"""Query registry: one Spark callable and, where SQL can say it, one oracle statement per name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import rnd

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return deco


def _split(spec: str):
    for item in spec.split():
        name, _, kind = item.partition(":")
        yield name, kind


def show(df: DataFrame, spec: str) -> DataFrame:
    """Project to plain comparable types. ``name:4`` rounds, ``:i`` bigint, ``:b`` flag, ``:d`` date text."""
    out = []
    for name, kind in _split(spec):
        c = F.col(name)
        if kind == "d":
            c = F.date_format(c, "yyyy-MM-dd")
        elif kind == "t":
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif kind in ("i", "b"):
            c = c.cast("bigint") if kind == "i" else c.cast("int").cast("bigint")
        elif kind:
            c = rnd(c, int(kind))
        out.append(c.alias(name))
    return df.select(*out)


def sel(spec: str) -> str:
    """The same projection as SQL text."""
    out = []
    for name, kind in _split(spec):
        if kind == "d":
            e = f"strftime({name}, '%Y-%m-%d')"
        elif kind == "t":
            e = f"strftime({name}, '%Y-%m-%d %H:%M:%S')"
        elif kind in ("i", "b"):
            e = f"CAST({name} AS BIGINT)"
        elif kind:
            e = f"round(CAST({name} AS DOUBLE), {kind}) + 0.0"
        else:
            e = name
        out.append(f"{e} AS {name}")
    return ", ".join(out)


CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, body: str, *deps: str):
    CTES[name] = (deps, body)


def sql_with(body: str, *deps: str, recursive: bool = False) -> str:
    """Prefix ``body`` with the named common table expressions and what they depend on."""
    if not deps:
        return body.strip()
    seen: list[str] = []

    def visit(n):
        if n in seen:
            return
        for d in CTES[n][0]:
            visit(d)
        seen.append(n)

    for d in deps:
        visit(d)
    parts = ",\n".join(f"{n} AS MATERIALIZED (\n{CTES[n][1]}\n)" for n in seen)
    body = body.strip()
    if body.upper().startswith("WITH "):
        body = body[5:]
        joiner = ",\n"
    else:
        joiner = "\n"
    kw = "WITH RECURSIVE" if recursive else "WITH"
    return f"{kw} {parts}{joiner}{body}"
