"""PostgreSQL-flavoured scalar functions as Column expressions.

Everything here is a composition of Spark's built-in functions, so it stays inside
whole-stage code generation wherever Spark's own functions do.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def _lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


# --- strings -----------------------------------------------------------------


def substr(s, start, length=None) -> Column:
    """1-based; a start below one counts as one and doesn't shorten the result."""
    at = F.greatest(_lit(start), F.lit(1))
    return F.substring(_col(s), at, _lit(length)) if length is not None else F.substring(_col(s), at, F.lit(2**31 - 1))


def concat(*parts) -> Column:
    """Null counts as an empty string."""
    return F.concat_ws("", *map(_col, parts))


def initcap(s) -> Column:
    """A word begins after anything that is not a letter or digit."""
    words = F.split(_col(s), r"(?<=[^\p{L}\p{N}])")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substring(w, F.lit(2), F.lit(2**31 - 1))))), "")


def strpos(s, sub) -> Column:
    return F.locate(sub, _col(s)) if isinstance(sub, str) else F.instr(_col(s), sub)


def similar_to_regex(pattern: str, escape: str = "\\") -> str:
    """An SQL regular expression as an anchored one of Java's."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == escape and i + 1 < len(pattern):
            i += 1
            out.append("\\" + pattern[i] if not pattern[i].isalnum() else pattern[i])
        elif c == "[":  # a class is the same in both, but for Java's signs of its own
            stop = pattern.find("]", i + (3 if pattern[i + 1 : i + 3] == "^]" else 2))
            stop = len(pattern) - 1 if stop < 0 else stop
            out.append(re.sub(r"(?<!^)[\[&]", r"\\\g<0>", pattern[i : stop + 1]))
            i = stop
        elif c == "%":
            out.append(".*")
        elif c == "_":
            out.append(".")
        elif c in ".^$\\":
            out.append("\\" + c)
        else:
            out.append(c)
        i += 1
    return f"^(?:{''.join(out)})$"


def similar_to(s, pattern: str, escape: str = "\\") -> Column:
    return _col(s).rlike(similar_to_regex(pattern, escape))


# --- numbers -----------------------------------------------------------------


def int_div(a, b, kind: str = "long") -> Column:
    """Integer division truncates and stays an integer; division by zero is an error."""
    a, b = _col(a), _lit(b)
    return F.call_function("div", a, b).cast(kind)


def ceil(x) -> Column:
    return F.ceil(_col(x)).cast("double")


def floor(x) -> Column:
    return F.floor(_col(x)).cast("double")


def trunc(x, digits: int = 0) -> Column:
    """Towards zero."""
    x, scale = _col(x), 10.0**digits
    return F.signum(x) * F.floor(F.abs(x) * scale) / scale


def _checked(x: Column, ok: Column, message: str, value: Column) -> Column:
    return F.when(x.isNull() | ok, value).otherwise(F.raise_error(F.lit(message)).cast("double"))


def sqrt(x) -> Column:
    x = _col(x)
    return _checked(x, x >= 0, "cannot take square root of a negative number", F.sqrt(x))


def ln(x) -> Column:
    x = _col(x)
    return _checked(x, x > 0, "cannot take logarithm of zero or a negative number", F.log(x))


def log10(x) -> Column:
    x = _col(x)
    return _checked(x, x > 0, "cannot take logarithm of zero or a negative number", F.log10(x))


def asin(x) -> Column:
    x = _col(x)
    return _checked(x, F.abs(x) <= 1, "input is out of range", F.asin(x))


def acos(x) -> Column:
    x = _col(x)
    return _checked(x, F.abs(x) <= 1, "input is out of range", F.acos(x))


# --- dates -------------------------------------------------------------------


def extract(field: str, ts) -> Column:
    """EXTRACT with PostgreSQL's fields."""
    t, field = _col(ts), field.lower()
    year = F.year(t)
    own = {
        "epoch": lambda: F.unix_micros(t.cast("timestamp")) / 1e6,
        "dow": lambda: F.dayofweek(t) - 1,
        "isodow": lambda: F.weekday(t) + 1,
        "doy": lambda: F.dayofyear(t),
        "decade": lambda: F.floor(year / 10).cast("int"),
        "century": lambda: F.ceil(year / 100).cast("int"),
        "millennium": lambda: F.ceil(year / 1000).cast("int"),
        "milliseconds": lambda: F.extract(F.lit("second"), t).cast("double") * 1000,
        "microseconds": lambda: F.extract(F.lit("second"), t).cast("double") * 1000000,
    }
    return own[field]() if field in own else F.extract(F.lit(field), t)


def date_trunc(field: str, ts) -> Column:
    """Truncation that keeps TIMESTAMP WITHOUT TIME ZONE and knows decades and longer."""
    t, field = _col(ts), field.lower()
    spans = {"decade": 10, "century": 100, "millennium": 1000}
    if field in spans:
        n, shift = spans[field], 0 if field == "decade" else 1
        year = F.floor((F.year(t) - shift) / n) * n + shift
        return F.make_date(year.cast("int"), F.lit(1), F.lit(1)).cast("timestamp_ntz")
    return F.date_trunc(field, t).cast("timestamp_ntz")


#: PostgreSQL's and MySQL's codes as Java's.
TO_CHAR = {"YYYY": "yyyy", "MM": "MM", "DD": "dd", "HH24": "HH", "HH12": "hh", "MI": "mm", "SS": "ss", "MS": "SSS", "US": "SSSSSS", "Month": "MMMM", "Mon": "MMM", "Day": "EEEE", "Dy": "EEE", "AM": "a", "PM": "a"}
MYSQL_FORMAT = {"%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%H": "HH", "%h": "hh", "%i": "mm", "%s": "ss", "%S": "ss", "%M": "MMMM", "%b": "MMM", "%W": "EEEE", "%a": "EEE", "%p": "a", "%j": "DDD"}


def _codes(pattern: str, table: dict[str, str]) -> str:
    parts = re.split("(" + "|".join(map(re.escape, sorted(table, key=len, reverse=True))) + ")", pattern)
    return "".join(table[p] if p in table else "".join(f"'{c}'" if c.isalpha() else c for c in p) for p in parts)


def to_char(ts, pattern: str) -> Column:
    return F.date_format(_col(ts), _codes(pattern, TO_CHAR))


def date_format(ts, pattern: str) -> Column:
    return F.date_format(_col(ts), _codes(pattern, MYSQL_FORMAT))


def to_timestamp(s, pattern: str) -> Column:
    return F.to_timestamp_ntz(_col(s), F.lit(_codes(pattern, TO_CHAR)))


# --- arrays ------------------------------------------------------------------


def subscript(a, i) -> Column:
    """1-based; null outside of the array."""
    a, i = _col(a), _lit(i)
    return F.when(i >= 1, F.try_element_at(a, i))


def array_length(a, dim: int = 1) -> Column:
    a = _col(a)
    return F.when(F.size(a) > 0, F.size(a)) if dim == 1 else F.lit(None).cast("int")


def array_position(a, x) -> Column:
    p = F.array_position(_col(a), x)
    return F.when(p > 0, p)


def array_append(a, x) -> Column:
    return F.concat(F.coalesce(_col(a), F.array()), F.array(_lit(x)))


def array_prepend(x, a) -> Column:
    return F.concat(F.array(_lit(x)), F.coalesce(_col(a), F.array()))


def contains(a, b) -> Column:
    """``a @> b`` on arrays."""
    return F.size(F.array_except(_col(b), _col(a))) == 0


def array_order(a) -> list[Column]:
    """Sort keys with the reference's order of arrays: the shorter first."""
    return [F.size(_col(a)), _col(a)]


# --- json --------------------------------------------------------------------


def json_get(j, *path) -> Column:
    """``#>``: the value at a path, as JSON text; null if missing."""
    at = "$" + "".join(f"[{p}]" if isinstance(p, int) else f".{p}" for p in path)
    return F.get_json_object(_col(j), at)


def json_typeof(j) -> Column:
    first = F.substring(F.trim(_col(j)), 1, 1)
    return (
        F.when(first == "{", "object").when(first == "[", "array").when(first == '"', "string").when(first.isin("t", "f"), "boolean").when(first == "n", "null").when(first.isNotNull(), "number")
    )


def json_keys(j) -> Column:
    return F.json_object_keys(_col(j))


def json_has_key(j, key: str) -> Column:
    """``?``: false for anything but an object."""
    return F.coalesce(F.array_contains(json_keys(j), key), F.lit(False))


def json_has_any(j, keys: list[str]) -> Column:
    return F.coalesce(F.arrays_overlap(json_keys(j), F.array(*map(F.lit, keys))), F.lit(False))


def json_has_all(j, keys: list[str]) -> Column:
    return F.coalesce(F.size(F.array_except(F.array(*map(F.lit, keys)), json_keys(j))) == 0, F.lit(False))


def json_valid(j) -> Column:
    return F.when(_col(j).isNotNull(), F.try_parse_json(_col(j)).isNotNull())


def json_build_object(**values) -> Column:
    """Nulls stay as nulls."""
    return F.to_json(F.struct(*(_col(v).alias(k) for k, v in values.items())), {"ignoreNullFields": "false"})


def json_build_array(*values) -> Column:
    return F.to_json(F.array(*map(_col, values)), {"ignoreNullFields": "false"})


def _walked(fn, kind: str = "string"):
    """A JSON rewrite as an Arrow-batched function: Spark has no recursive expressions."""
    import json

    import pandas as pd

    def each(*columns) -> pd.Series:
        rows = zip(*columns, strict=True)
        return pd.Series([None if any(x is None for x in row) else fn(*map(json.loads, row)) for row in rows], dtype=object)

    if fn.__code__.co_argcount == 1:

        def run(a: pd.Series) -> pd.Series:
            return each(a)
    else:

        def run(a: pd.Series, b: pd.Series) -> pd.Series:
            return each(a, b)

    run.__annotations__ = dict.fromkeys(run.__annotations__, pd.Series)
    return F.pandas_udf(run, kind)


def _dump(x, **kw) -> str:
    import json

    return json.dumps(x, ensure_ascii=False, separators=kw.pop("separators", (",", ":")), **kw)


def json_contains(a, b) -> Column:
    """``a @> b``: every part of b is in a; an array holds a scalar that is in it."""

    def inside(x, y) -> bool:
        if isinstance(x, dict) and isinstance(y, dict):
            return all(k in x and inside(x[k], v) for k, v in y.items())
        if isinstance(x, list):
            return all(any(inside(e, v) for e in x) for v in (y if isinstance(y, list) else [y]))
        return type(x) is type(y) and x == y or isinstance(x, int | float) and isinstance(y, int | float) and not isinstance(x, bool) and not isinstance(y, bool) and x == y

    return F.coalesce(_walked(inside, "boolean")(_col(a), _lit(b)), _col(a).isNotNull())


def json_strip_nulls(j) -> Column:
    def strip(x):
        if isinstance(x, dict):
            return {k: strip(v) for k, v in x.items() if v is not None}
        return [strip(v) for v in x] if isinstance(x, list) else x

    return _walked(lambda x: _dump(strip(x)))(_col(j))


def json_pretty(j) -> Column:
    return _walked(lambda x: _dump(x, indent=4, separators=(",", ": ")))(_col(j))


def json_set(j, path: list[str], value, create: bool = True) -> Column:
    def put(x, v):
        at = x
        for p in path[:-1]:
            at = at[int(p)] if isinstance(at, list) else at.get(p) if isinstance(at, dict) else None
            if at is None:
                return _dump(x)
        last = path[-1]
        if isinstance(at, dict) and (create or last in at):
            at[last] = v
        elif isinstance(at, list) and -len(at) <= int(last) < len(at):
            at[int(last)] = v
        return _dump(x)

    return _walked(put)(_col(j), _lit(value))


def json_concat(a, b) -> Column:
    def join(x, y):
        if isinstance(x, dict) and isinstance(y, dict):
            return _dump(x | y)
        return _dump((x if isinstance(x, list) else [x]) + (y if isinstance(y, list) else [y]))

    return _walked(join)(_col(a), _lit(b))


def json_delete(j, key: str) -> Column:
    def drop(x):
        if isinstance(x, dict):
            x.pop(key, None)
        elif isinstance(x, list):
            x = [v for v in x if v != key]
        return _dump(x)

    return _walked(drop)(_col(j))


# --- vectors -----------------------------------------------------------------


def vector(values) -> Column:
    return F.array(*(F.lit(float(v)) for v in values)) if isinstance(values, list | tuple) else _col(values)


def inner_product(a, b) -> Column:
    products = F.zip_with(_col(a), vector(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def l2_distance(a, b) -> Column:
    squares = F.zip_with(_col(a), vector(b), lambda x, y: (x.cast("double") - y) * (x.cast("double") - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def l1_distance(a, b) -> Column:
    parts = F.zip_with(_col(a), vector(b), lambda x, y: F.abs(x.cast("double") - y))
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(F.transform(_col(a), lambda x: x.cast("double") * x), F.lit(0.0), lambda s, x: s + x))


def cosine_distance(a, b) -> Column:
    """One if either vector is zero."""
    size = norm(a) * norm(vector(b)) if not isinstance(b, list | tuple) else norm(a) * F.lit(float(sum(v * v for v in b)) ** 0.5)
    return F.when(size == 0, F.lit(1.0)).otherwise(1 - inner_product(a, b) / size)


def cosine_similarity(a, b) -> Column:
    return 1 - cosine_distance(a, b)


# --- text search -------------------------------------------------------------


#: Unicode's word boundaries (UAX 29) as a pattern: ideographs stand alone; letters go on over an
#: apostrophe, a full stop, a colon or a middle dot between letters, digits over an apostrophe, a
#: full stop, a comma or a semicolon between digits.
_WORD = r"(?:[\p{L}\p{M}\p{N}_&&[^\p{IsHan}\p{IsHiragana}]]|(?<=\p{L})[:\u00b7.'\u2019](?=\p{L})|(?<=\p{N})[.,;'\u2019](?=\p{N}))"
WORDS = rf"[\p{{IsHan}}\p{{IsHiragana}}]|_*[\p{{L}}\p{{N}}&&[^\p{{IsHan}}\p{{IsHiragana}}]]{_WORD}*"


def tsvector(text) -> Column:
    """Lower-cased words by Unicode's word boundaries."""
    return F.regexp_extract_all(F.lower(F.coalesce(_col(text), F.lit(""))), F.lit(WORDS), F.lit(0))


def ts_match(document, query) -> Column:
    """``@@``: any word of the query is in the document."""
    return F.arrays_overlap(_col(document), _col(query))


def ts_rank(document, query) -> Column:
    """BM25 against the document alone: ln(4/3) * 2.2 tf / (tf + 1.2) for each word of the query."""
    d = _col(document)
    tf = lambda w: F.size(F.filter(d, lambda x: x == w)).cast("double")
    score = lambda s, w: s + F.log(F.lit(4.0) / 3) * 2.2 * tf(w) / (tf(w) + 1.2)
    return F.aggregate(F.array_distinct(_col(query)), F.lit(0.0), score)
