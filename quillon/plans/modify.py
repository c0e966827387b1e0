"""Data definition and modification: every statement makes a new version of a table.

Tables are DataFrames under a name.  A modification writes the new version to the
session's shared folder, so plans stay short and a version is never half visible.  A
branch is a set of names: it begins with its parent's versions and keeps its own, and a
merge holds both against those it began with.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import relational, versions
from ..sources import io
from ..sources.shared import written
from .dialect import TYPES, rewritten
from .tokens import split, text, tokens

FLAGS = re.IGNORECASE | re.DOTALL


def _parts(s: str) -> list[str]:
    return [text(x) for x in split(tokens(s))]


class Tables:
    """The statements that change tables; ``run`` gives None for anything else."""

    def __init__(self, spark: SparkSession, query: Callable[[str], DataFrame] | None = None):
        self.spark = spark
        self.query = query or (lambda sql: spark.sql(rewritten(sql)))
        self.keys: dict[str, list[str]] = {}
        self.defaults: dict[str, dict[str, str]] = {}
        self.required: dict[str, set[str]] = {}
        self.serial: dict[str, dict[str, int]] = {}
        self.branches: dict[str, dict[str, DataFrame]] = {"main": {}}
        self.bases: dict[str, tuple[str, dict[str, DataFrame]]] = {}
        self.branch = "main"

    @property
    def here(self) -> dict[str, DataFrame]:
        """The tables of the branch in use."""
        return self.branches[self.branch]

    def adopt(self, name: str, df: DataFrame) -> DataFrame:
        df.createOrReplaceTempView(name)
        self.here[name] = df
        return df

    def forget(self, name: str) -> None:
        self.spark.catalog.dropTempView(name)
        self.here.pop(name, None)

    def put(self, name: str, df: DataFrame) -> DataFrame:
        return self.adopt(name, written(df, name))

    def status(self, rows: int) -> DataFrame:
        return self.spark.createDataFrame([(rows,)], "rows_affected long")

    def run(self, sql: str) -> DataFrame | None:
        s = sql.strip().rstrip(";")
        for pattern, fn in (
            (r"create\s+(?:temp(?:orary)?\s+)?table\s+(?:if\s+not\s+exists\s+)?(\w+)\s+as\s+(.*)$", self.create_as),
            (r"create\s+(?:temp(?:orary)?\s+)?table\s+(?:if\s+not\s+exists\s+)?(\w+)\s*\((.*)\)(?:\s*inherits\s*\((\w+)\)|\s*partition\s+by\b.*|\s*with\s*\(.*\)|\s*engine\b.*)?$", self.create),
            (r"create\s+(?:or\s+replace\s+)?(?:temp(?:orary)?\s+)?view\s+(\w+)\s*(\([^)]*\))?\s+as\s+(.*)$", self.view),
            (r"drop\s+(?:table|view)\s+(?:if\s+exists\s+)?(\w+(?:\s*,\s*\w+)*)(?:\s+cascade|\s+restrict)?$", self.drop),
            (r"truncate\s+(?:table\s+)?(\w+)(?:\s+(?:cascade|restart\s+identity))*$", self.truncate),
            (r"alter\s+table\s+(?:if\s+exists\s+)?(\w+)\s+(.*)$", self.alter),
            (r"(insert\s+or\s+replace|insert\s+or\s+ignore|replace|insert(?:\s+ignore)?)\s+into\s+(\w+)\s*(\([^)]*\))?\s*((?:values|select|with)\b.*)$", self.insert),
            (r"update\s+(\w+)(?:\s+(?:as\s+)?((?!set\b)\w+))?\s+set\s+(.*)$", self.update),
            (r"delete\s+from\s+(\w+)(?:\s+(?:as\s+)?((?!where\b|using\b|returning\b)\w+))?(?:\s+using\s+(.*?))?(?:\s+where\s+(.*?))?(?:\s+returning\s+(.*))?$", self.delete),
            (r"(?:create|drop)\s+(?:unique\s+)?index\b(.*)$", lambda _: self.status(0)),
            (r"copy\s+(\w+|\(.*?\))\s*(\([^)]*\))?\s+(from|to)\s+'([^']*)'\s*(.*)$", self.copy),
            (r"create\s+branch\s+(?:if\s+not\s+exists\s+)?(\w+)(?:\s+from\s+(\w+))?(?:\s+as\s+of\s+now)?$", self.create_branch),
            (r"drop\s+branch\s+(?:if\s+exists\s+)?(\w+)$", self.drop_branch),
            (r"use\s+branch\s+(\w+)$", self.use_branch),
            (r"merge\s+(?:database\s+)?branch\s+(\w+)(?:\s+into\s+(\w+))?(?:\s+(?:with\s*\(?\s*)?(?:conflict_resolution\s*=\s*|strategy\s*=?\s*|using\s+)?'?(\w+)'?\s*\)?)?$", self.merge_branch),
            (r"show\s+branches$", self.show_branches),
        ):
            if m := re.match(pattern, s, FLAGS):
                return fn(*m.groups())
        return None

    # --- definition ---

    def create_as(self, name: str, query: str) -> DataFrame:
        return self.status(self.put(name, self.query(query)).count())

    def create(self, name: str, body: str, parent: str | None = None) -> DataFrame:
        fields, keys, defaults, required, serial = [], [], {}, set(), {}
        for part in split(tokens(body)):
            words = [t.text for t in part]
            low = [w.lower() for w in words]
            if not words:
                continue
            if low[0] in ("primary", "unique", "constraint", "foreign", "check"):
                if "primary" in low:
                    at = low.index("key")
                    keys = [w for w in words[at + 1 :] if re.match(r"\w", w)]
                continue
            column = words[0].strip('"`')
            kind = TYPES.get(low[1], words[1].upper()) if len(low) > 1 else "STRING"
            if len(low) > 2 and low[1] in ("numeric", "decimal") and words[2] == "(":
                kind = "DECIMAL" + "".join(words[2 : words.index(")") + 1])
            elif len(low) > 1 and low[1] == "double":
                kind = "DOUBLE"
            elif len(low) > 1 and low[1] in ("serial", "bigserial") or "autoincrement" in low or "auto_increment" in low:
                kind, serial[column] = "BIGINT", 1
            elif len(low) > 1 and low[1] == "vector":
                kind = "ARRAY<DOUBLE>"
            elif words[2:4] == ["[", "]"]:
                kind = f"ARRAY<{kind}>"
            elif kind in ("CHAR", "CHARACTER", "VARCHAR"):
                kind = "STRING"
            fields.append(f"`{column}` {kind}")
            if "primary" in low:
                keys = [column]
            if "default" in low:
                at = low.index("default") + 1
                defaults[column] = text(part[at : _default_end(low, at)])
            if "not" in low and "null" in low[low.index("not") :]:
                required.add(column)
        if parent:
            inherited = self.spark.table(parent).schema
            fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in inherited] + fields
        self.keys[name], self.defaults[name], self.required[name], self.serial[name] = keys, defaults, required, serial
        self.put(name, self.spark.createDataFrame([], ", ".join(fields)))
        return self.status(0)

    def view(self, name: str, columns: str | None, query: str) -> DataFrame:
        df = self.query(query)
        (df.toDF(*(c.strip() for c in columns.strip("()").split(","))) if columns else df).createOrReplaceTempView(name)
        return self.status(0)

    def drop(self, names: str) -> DataFrame:
        for n in names.split(","):
            self.forget(n.strip())
        return self.status(0)

    def truncate(self, name: str) -> DataFrame:
        self.put(name, self.spark.table(name).limit(0))
        return self.status(0)

    def alter(self, name: str, change: str) -> DataFrame:
        df = self.spark.table(name)
        kind_of = lambda s: rewritten(f"SELECT NULL::{s.strip()}").split(" AS ", 1)[1][:-1]
        if re.match(r"add\s+(?:constraint|primary|unique|foreign|check)\b", change, FLAGS):
            if m := re.search(r"primary\s+key\s*\(([^)]*)\)", change, FLAGS):
                self.keys[name] = [k.strip() for k in m[1].split(",")]
            return self.status(0)
        if m := re.match(r"(?:drop\s+constraint|owner\s+to|set\s+schema|enable|disable|cluster|validate)\b", change, FLAGS):
            return self.status(0)
        if m := re.match(r"add\s+(?:column\s+)?(?:if\s+not\s+exists\s+)?(\w+)\s+(.*?)(?:\s+not\s+null)?(?:\s+default\s+(.*?))?(?:\s+not\s+null)?$", change, FLAGS):
            if m[1] not in df.columns:
                df = df.withColumn(m[1], F.expr(rewritten(m[3]) if m[3] else "NULL").cast(kind_of(m[2])))
                if m[3]:
                    self.defaults.setdefault(name, {})[m[1]] = m[3]
        elif m := re.match(r"drop\s+(?:column\s+)?(?:if\s+exists\s+)?(\w+)(?:\s+cascade|\s+restrict)?$", change, FLAGS):
            df = df.drop(m[1])
        elif m := re.match(r"rename\s+to\s+(\w+)$", change, FLAGS):
            self.adopt(m[1], df)
            for kept in (self.keys, self.defaults, self.required, self.serial):
                if name in kept:
                    kept[m[1]] = kept.pop(name)
            self.forget(name)
            return self.status(0)
        elif m := re.match(r"rename\s+(?:column\s+)?(\w+)\s+to\s+(\w+)$", change, FLAGS):
            df = df.withColumnRenamed(m[1], m[2])
            self.keys[name] = [m[2] if k == m[1] else k for k in self.keys.get(name, [])]
        elif m := re.match(r"alter\s+(?:column\s+)?(\w+)\s+(?:set\s+data\s+)?type\s+(.*?)(?:\s+using\s+(.*))?$", change, FLAGS):
            df = df.withColumn(m[1], (F.expr(rewritten(m[3])) if m[3] else F.col(m[1])).cast(kind_of(m[2])))
        elif m := re.match(r"alter\s+(?:column\s+)?(\w+)\s+(?:set\s+default\s+(.*)|drop\s+default)$", change, FLAGS):
            self.defaults.setdefault(name, {}).pop(m[1], None)
            if m[2]:
                self.defaults[name][m[1]] = m[2]
            return self.status(0)
        elif m := re.match(r"alter\s+(?:column\s+)?(\w+)\s+(set|drop)\s+not\s+null$", change, FLAGS):
            required = self.required.setdefault(name, set())
            if m[2].lower() == "set":
                self._no_nulls(df, {m[1]})
                required.add(m[1])
            else:
                required.discard(m[1])
            return self.status(0)
        else:
            raise ValueError(f"unknown change {change!r}")
        self.put(name, df)
        return self.status(0)

    # --- modification ---

    @staticmethod
    def _no_nulls(df: DataFrame, columns: set[str]) -> None:
        for c in sorted(columns & set(df.columns)):
            if not df.where(F.col(f"`{c}`").isNull()).isEmpty():
                raise ValueError(f"null value in column {c!r} violates not-null constraint")

    def insert(self, verb: str, name: str, columns: str | None, source: str) -> DataFrame:
        target = self.spark.table(name)
        returning = conflict = None
        if m := re.search(r"\sreturning\s+(.*)$", source, FLAGS):
            returning, source = m[1], source[: m.start()]
        if m := re.search(r"\son\s+(?:conflict\s*(?:\(([^)]*)\))?\s*do\s+(nothing|update\s+set\s+(.*))|duplicate\s+key\s+update\s+(.*))$", source, FLAGS):
            conflict, source = m, source[: m.start()]
        names = [c.strip().strip('"`') for c in columns.strip("()").split(",")] if columns else target.columns
        rows = self.query(f"SELECT * FROM {source} AS v" if source.lower().startswith("values") else source).toDF(*names)
        defaults, serial = self.defaults.get(name, {}), self.serial.get(name, {})
        fresh = [c for c in serial if c not in names]
        rows = rows.select(*((F.col(f"`{f.name}`") if f.name in names else F.expr(rewritten(defaults.get(f.name, "NULL")))).cast(f.dataType).alias(f.name) for f in target.schema))
        for c in fresh:
            rows = relational.numbered(rows.drop(c), c, [x for x in rows.columns if x != c], serial[c]).select(*target.columns)
        rows = written(rows, "inserted")
        for c in fresh:
            serial[c] += rows.count()
        self._no_nulls(rows, self.required.get(name, set()) | set(self.keys.get(name, [])))
        keys = [k.strip() for k in conflict[1].split(",")] if conflict and conflict[1] else self.keys.get(name, [])
        low = " ".join(verb.lower().split())
        if not keys and (conflict or low != "insert"):
            raise ValueError(f"{name} has no key that rows could conflict on")
        if low in ("insert or replace", "replace"):
            out = relational.upsert(target, rows, keys)
        elif low in ("insert or ignore", "insert ignore") or conflict and (conflict[2] or "").lower() == "nothing":
            out = relational.upsert(target, rows, keys, update=False)
        elif conflict:
            sets = dict(self._assignments(conflict[3] or conflict[4]))
            old, new = target.alias("old"), rows.alias("excluded")
            both = old.join(new, [F.col(f"old.{k}") == F.col(f"excluded.{k}") for k in keys])
            changed = both.select(*(F.expr(rewritten(self._qualified(sets[c], target.columns)) if c in sets else f"old.`{c}`").cast(target.schema[c].dataType).alias(c) for c in target.columns))
            out = target.join(rows.select(*keys), keys, "left_anti").select(*target.columns).unionByName(changed).unionByName(rows.join(target.select(*keys), keys, "left_anti").select(*rows.columns))
        else:
            out = target.unionByName(rows)
        self.put(name, out)
        return rows.selectExpr(*map(rewritten, _parts(returning))) if returning else self.status(rows.count())

    @staticmethod
    def _qualified(expr: str, columns: list[str]) -> str:
        """Bare columns are the old row's; VALUES(c) is MySQL's for the new row's."""
        expr = re.sub(r"(?i)\bvalues\s*\(\s*(\w+)\s*\)", r"excluded.\1", expr)
        return re.sub(r"(?<![\w.])(" + "|".join(map(re.escape, columns)) + r")\b(?!\s*[(.])", r"old.\1", expr)

    @staticmethod
    def _assignments(s: str) -> list[tuple[str, str]]:
        return [tuple(x.strip() for x in p.split("=", 1)) for p in _parts(s)]

    def _numbered(self, name: str, alias: str) -> DataFrame:
        """The table with a number a row, under the alias that the statement's expressions use."""
        rows = written(self.spark.table(name).withColumn("_rid", F.monotonically_increasing_id()), "numbered")
        rows.createOrReplaceTempView(f"_{alias}_rows")
        return rows

    def update(self, name: str, alias: str | None, rest: str) -> DataFrame:
        m = re.match(r"(.*?)(?:\s+from\s+((?:(?!\bwhere\b).)*?))?(?:\s+where\s+(.*?))?(?:\s+returning\s+(.*))?$", _outside(rest), FLAGS)
        part = lambda k: rest[m.start(k) : m.end(k)] if m[k] is not None else None
        sets, source, where, returning = dict(self._assignments(part(1))), part(2), part(3) or "true", part(4)
        sets = {k.split(".")[-1].strip('"`'): v for k, v in sets.items()}
        target, alias = self.spark.table(name), alias or name
        rows = self._numbered(name, alias)
        values = ", ".join(f"CAST({sets[f.name]} AS {f.dataType.simpleString()}) AS `{f.name}`" if f.name in sets else f"{alias}.`{f.name}`" for f in target.schema)
        changed = self.query(f"SELECT {alias}._rid AS _rid, {values} FROM _{alias}_rows AS {alias}{', ' + source if source else ''} WHERE {where}")
        changed = written(changed.dropDuplicates(["_rid"]), "updated")
        self._no_nulls(changed, self.required.get(name, set()))
        self.put(name, rows.join(changed.select("_rid"), "_rid", "left_anti").select(*target.columns).unionByName(changed.drop("_rid")))
        return changed.selectExpr(*map(rewritten, _parts(returning))) if returning else self.status(changed.count())

    def delete(self, name: str, alias: str | None, source: str | None, where: str | None, returning: str | None) -> DataFrame:
        alias = alias or name
        columns, rows = self.spark.table(name).columns, self._numbered(name, alias)
        hit = self.query(f"SELECT DISTINCT {alias}._rid AS _rid FROM _{alias}_rows AS {alias}{', ' + source if source else ''} WHERE {where or 'true'}")
        gone = written(rows.join(hit, "_rid", "left_semi"), "deleted")
        self.put(name, rows.join(gone.select("_rid"), "_rid", "left_anti").select(*columns))
        gone = gone.select(*columns)
        return gone.selectExpr(*map(rewritten, _parts(returning))) if returning else self.status(gone.count())

    def copy(self, what: str, columns: str | None, way: str, path: str, options: str) -> DataFrame:
        """COPY table FROM 'path', COPY table or (query) TO 'path'; text, csv or Parquet."""
        flag = lambda k: bool(re.search(rf"\b{k}\b(?!\s*(?:false|off|0))", options, FLAGS))
        given = lambda k: (m[1] if (m := re.search(rf"\b{k}\s+(?:as\s+)?'([^']*)'", options, FLAGS)) else None)
        fmt = next((k for k in ("csv", "parquet", "text") if re.search(rf"\b{k}\b", options, FLAGS)), "text")
        names = [c.strip() for c in columns.strip("()").split(",")] if columns else None
        if way.lower() == "to":
            df = self.query(what[1:-1]) if what.startswith("(") else self.spark.table(what)
            df = df.select(*names) if names else df
            if fmt == "parquet":
                df.write.parquet(path)
            else:
                io.copy_to(df, path, fmt, flag("header"), given("delimiter"), given("null"))
            return self.status(df.count())
        target = self.spark.table(what)
        schema = target.select(*(names or target.columns)).schema
        rows = self.spark.read.schema(schema).parquet(path) if fmt == "parquet" else io.copy_from(self.spark, path, schema, fmt, flag("header"), given("delimiter"), given("null"))
        rows = written(rows.select(*(F.col(f"`{f.name}`") if f.name in schema.names else F.expr(rewritten(self.defaults.get(what, {}).get(f.name, "NULL"))).cast(f.dataType).alias(f.name) for f in target.schema)), "copied")
        self.put(what, target.unionByName(rows))
        return self.status(rows.count())

    # --- branches ---

    def create_branch(self, name: str, parent: str | None) -> DataFrame:
        parent = parent or self.branch
        self.branches[name] = dict(self.branches[parent])
        self.bases[name] = (parent, dict(self.branches[parent]))
        return self.status(0)

    def drop_branch(self, name: str) -> DataFrame:
        if name in ("main", self.branch):
            raise ValueError(f"branch {name!r} is in use")
        self.branches.pop(name, None)
        self.bases.pop(name, None)
        return self.status(0)

    def use_branch(self, name: str) -> DataFrame:
        tables = self.branches[name]
        for t in set(self.here) - set(tables):
            self.spark.catalog.dropTempView(t)
        self.branch = name
        for t, df in tables.items():
            df.createOrReplaceTempView(t)
        return self.status(0)

    def merge_branch(self, name: str, into: str | None, strategy: str | None) -> DataFrame:
        """Into its parent, or another branch.  Tables of no key are taken whole if they changed."""
        into = into or self.bases[name][0]
        base, source, target = self.bases[name][1], self.branches[name], self.branches[into]
        changed = 0
        for t, df in source.items():
            if t in base and df is base[t]:
                continue
            if t in base and t in target and self.keys.get(t):
                df = written(versions.three_way_merge(base[t], df, target[t], self.keys[t], (strategy or "auto").lower()), t)
            elif t in target and t in base and target[t] is not base[t] and (strategy or "").lower() in ("ours", "manual"):
                if strategy.lower() == "manual":
                    raise versions.MergeConflict(f"{t} was changed on both branches")
                df = target[t]
            target[t] = df
            changed += 1
        for t in set(base) - set(source):
            target.pop(t, None)
        self.bases[name] = (into, dict(source))
        return (self.use_branch(self.branch), self.status(changed))[1]

    def show_branches(self) -> DataFrame:
        rows = [(b, self.bases[b][0] if b in self.bases else None, b == self.branch) for b in self.branches]
        return self.spark.createDataFrame(rows, "branch_name string, parent string, current boolean")


def _default_end(low: list[str], at: int) -> int:
    """Where a default's expression ends: at a constraint."""
    depth = 0
    for i in range(at, len(low)):
        depth += (low[i] == "(") - (low[i] == ")")
        if not depth and low[i] in ("not", "null", "primary", "unique", "check", "references") and i > at:
            return i
    return len(low)


def _outside(s: str) -> str:
    """The text with what is in brackets and strings blanked, so that its clauses can be found."""
    out, depth, quote = [], 0, ""
    for c in s:
        if quote:
            quote = "" if c == quote else quote
            out.append(" " if c.isspace() else "_")
        elif c in "'\"`":
            quote = c
            out.append("_")
        else:
            depth -= c == ")"
            out.append(c if not depth else "_")
            depth += c == "("
    return "".join(out)
