"""Filters of REST and search interfaces as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pg


def typed(value: str):
    """Integer, then float, then text."""
    for kind in (int, float):
        try:
            return kind(value)
        except ValueError:
            pass
    return value


def _list(value: str) -> list:
    """The values of ``(1,2,"a,b")``; quoted ones are text and may hold commas."""
    found = re.findall(r'\s*(?:"((?:[^"\\]|\\.)*)"|([^,]*))\s*(?:,|$)', value.strip()[1:-1] if value.strip()[:1] in ("(", "{") else value)
    return [re.sub(r"\\(.)", r"\1", quoted) if quoted or not plain else typed(plain.strip()) for quoted, plain in found if quoted or plain.strip()]


def _every(c: Column, query: str) -> Column:
    return F.size(F.array_except(pg.tsvector(F.lit(query)), pg.tsvector(c))) == 0


def _phrase(c: Column, query: str) -> Column:
    """The query's words side by side."""
    joined = lambda w: F.concat(F.lit(" "), F.array_join(w, " "), F.lit(" "))
    return F.contains(joined(pg.tsvector(c)), joined(pg.tsvector(F.lit(query))))


def _web(c: Column, query: str) -> Column:
    """Words and "phrases" that are all there, ``or`` between alternatives, ``-`` before what isn't."""
    out = None
    for part in re.split(r"(?i)\s+or\s+", query):
        every = None
        for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', part):
            one = _phrase(c, phrase or word)
            one = ~one if minus else one
            every = one if every is None else every & one
        out = every if out is None else out | every
    return out


REST = {
    "eq": lambda c, v: c == F.lit(typed(v)),
    "neq": lambda c, v: c != F.lit(typed(v)),
    "gt": lambda c, v: c > F.lit(typed(v)),
    "gte": lambda c, v: c >= F.lit(typed(v)),
    "lt": lambda c, v: c < F.lit(typed(v)),
    "lte": lambda c, v: c <= F.lit(typed(v)),
    "like": lambda c, v: c.like(v.replace("*", "%")),
    "ilike": lambda c, v: c.ilike(v.replace("*", "%")),
    "is": lambda c, v: {"null": c.isNull(), "true": c == F.lit(True), "false": c == F.lit(False)}[v.lower()] if v.lower() != "null" else c.isNull(),
    "in": lambda c, v: c.isin(_list(v)),
    "cs": lambda c, v: pg.contains(c, F.array(*map(F.lit, _list(v)))),
    "cd": lambda c, v: pg.contains(F.array(*map(F.lit, _list(v))), c),
    "ov": lambda c, v: F.arrays_overlap(c, F.array(*map(F.lit, _list(v)))),
    "fts": lambda c, v: pg.ts_match(pg.tsvector(c), pg.tsvector(F.lit(v))),
    "plfts": _every,
    "phfts": _phrase,
    "wfts": _web,
}


def condition(column: str, spec: str) -> Column:
    """``gte.5``, ``not.in.(1,2)``, ``is.null``"""
    op, _, value = spec.partition(".")
    if op == "not":
        return ~condition(column, value)
    if op == "is":
        c = F.col(column)
        return c.isNull() if value.lower() == "null" else c == F.lit(value.lower() == "true")
    if op not in REST:
        raise ValueError(f"unknown operator {op!r}")
    return REST[op](F.col(column), value)


def any_of(spec: str) -> Column:
    """``(a.eq.1,and(b.gt.2,c.is.null))``"""
    return _tree(spec, "or")


def _tree(spec: str, how: str) -> Column:
    parts, depth, at = [], 0, 0
    body = spec.strip()
    body = body[1:-1] if body.startswith("(") else body
    for i, ch in enumerate(body + ","):
        depth += (ch == "(") - (ch == ")")
        if ch == "," and not depth:
            parts.append(body[at:i])
            at = i + 1
    out = None
    for p in parts:
        m = re.match(r"(and|or)\((.*)\)$", p)
        c = _tree(m[2], m[1]) if m else condition(*p.split(".", 1))
        out = c if out is None else (out | c if how == "or" else out & c)
    return out


def rest(df: DataFrame, params: dict[str, str], owner: tuple[str, object] | None = None) -> DataFrame:
    """select, order, limit, offset, and, or, and a filter per column; ``owner`` adds row security."""
    if owner:
        df = df.where(F.col(owner[0]) == F.lit(owner[1]))
    for k, v in params.items():
        if k in ("and", "or"):
            df = df.where(_tree(v, k))
        elif k not in ("select", "order", "limit", "offset"):
            df = df.where(condition(k, v))
    if "order" in params:
        keys = [x.split(".") for x in params["order"].split(",")]
        df = df.orderBy(*(F.desc_nulls_last(k[0]) if "desc" in k[1:] else F.asc_nulls_first(k[0]) for k in keys))
    if "offset" in params:
        df = df.offset(int(params["offset"]))
    if "limit" in params:
        df = df.limit(int(params["limit"]))
    return df.select(*params["select"].split(",")) if params.get("select", "*") != "*" else df


def metadata(column: str, op: str, *values) -> Column:
    """Filters of semantic search."""
    c, v = F.col(column), values[0] if values else None
    ops = {
        "eq": lambda: c == v, "ne": lambda: c != v, "gt": lambda: c > v, "gte": lambda: c >= v, "lt": lambda: c < v, "lte": lambda: c <= v,
        "in": lambda: c.isin(list(v)), "not_in": lambda: ~c.isin(list(v)), "contains": lambda: c.contains(v), "starts_with": lambda: c.startswith(v),
        "ends_with": lambda: c.endswith(v), "exists": lambda: c.isNotNull(), "is_null": lambda: c.isNull(), "is_not_null": lambda: c.isNotNull(),
        "between": lambda: c.between(*values), "regex": lambda: c.rlike(v),
    }
    return ops[op]()


def row_security(df: DataFrame, policies: dict[str, Column], role: str) -> DataFrame:
    """Rows that the role's policy allows; a role without a policy sees none."""
    return df.where(policies.get(role, F.lit(False)))
