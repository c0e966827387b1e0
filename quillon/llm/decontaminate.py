r"""Benchmark decontamination by template and literal windows, in DataFrame functions only.

A token is a run of letters and digits.  A token that begins with a digit becomes a
number slot, a whole number with its separators one; a unit after a number a unit slot;
a capitalised token that goes on a sentence a name slot, a run of them one; all others
are lower-cased.  Windows of ``WINDOW`` such tokens (the whole item if it is shorter)
are hashed and joined with the documents' windows.  Matches are put together by
document, item and offset, and those at near offsets once more, for what was put in or
left out between them.  A document holds an item if at least ``COVERAGE`` of the item's
tokens are covered and the slots are consistent: each value in the item stands for one
value of its type in the document throughout.  So a question with other numbers or names
is caught, and one that merely uses the same phrases is not.  Of an item that is mostly
slots, such as a short sum, all that windows with a word in them cover has to be covered.

Every item is also looked for word for word, by windows of lower-cased tokens without
slots, and held at the same coverage.

Only the benchmark's window hashes are broadcast, and only while they are fewer than
``BROADCAST_ROWS``; beyond that the windows are shuffled.  A window of slots alone is
left out: any row of numbers would match it.  Null
texts have no tokens and match nothing; repeated documents and items are found each, and the
query gives one row a pair of ids; texts of any length are whole; empty tables give an empty
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ROW, identified, named, written

WINDOW, COVERAGE, BROADCAST_ROWS = 8, 0.5, 2_000_000
#: Fixed list of units that may follow a number.
UNITS = "mm cm m km in ft yd mi mg g kg t oz lb ml cl l s sec min h hr hrs hours minutes seconds days weeks months years dollars euros eur usd percent miles meters metres feet inches grams litres liters".split()
NAME, NUMBER, UNIT = "\ue001", "\ue002", "\ue003"  # private use: in no token
TOKEN, BREAK = r"[\p{L}\p{N}]", r"[^\p{L}\p{N}]"
#: At most three characters, none of which ends a sentence, between a name and the token before.
GAP = r"[^\p{L}\p{N}.!?:;\n]{1,3}"
GLUE = "\ue004"  # within a token
#: A separator within a number: of three digits, before decimals, or a comma that isn't a list's.
SEPARATOR = r"\.(?<=\p{N}.)(?=\p{N})|,(?<=\p{N}.)(?=\p{N}{3}(?!\p{N}))|,(?<=\p{N}.)(?<!,\p{N}{1,9}.)(?=\p{N}+(?!,?\p{N}))"
#: What the paths of a match are, the first of a pair of document and item counts.
PLACE, PLACES, LITERAL = 0, 1, 2


def cleaned(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), NAME + NUMBER + UNIT + GLUE, "    ")


def tokens(text: Column) -> tuple[Column, Column]:
    """The canonical tokens and, place by place, the tokens as they are."""
    own = rf"[\p{{L}}\p{{N}}{NAME}{GLUE}]"
    marked = F.regexp_replace(cleaned(text), SEPARATOR, GLUE)
    marked = F.regexp_replace(marked, rf"\p{{Lu}}(?<={TOKEN}{GAP}.)", f"{NAME}$0")
    marked = F.regexp_replace(marked, rf"[ \t-](?={NAME})(?<={NAME}{TOKEN}{{1,40}}.)", GLUE)
    x = F.regexp_replace(marked, rf"{NAME}{own}*", NAME)
    x = F.regexp_replace(x, rf"\p{{N}}(?<!{own}.){own}*", NUMBER)
    x = F.regexp_replace(x, rf"({NUMBER}{BREAK}{{1,3}})(?:{'|'.join(UNITS)})(?!{TOKEN})", f"$1{UNIT}")
    broken = rf"[^\p{{L}}\p{{N}}{NAME}-{GLUE}]+"
    return F.array_remove(F.split(F.lower(x), broken), ""), F.array_remove(F.split(marked, broken), "")


def literals(text: Column) -> tuple[Column, Column]:
    """The lower-cased tokens, without slots, in the two roles of ``tokens``."""
    words = F.array_remove(F.split(F.lower(cleaned(text)), rf"{BREAK}+"), "")
    return words, words


def windows(df: DataFrame, size: Column | int, at: str = "at") -> DataFrame:
    """A row for each window of ``size`` tokens, with its place and hash."""
    word = lambda k: F.get("canon", F.col(at) + k)
    places = F.when(F.size("canon") >= size, F.sequence(F.lit(0), F.size("canon") - size))
    return df.withColumn(at, F.explode(places)).withColumn("h", F.xxhash64(F.lit(size), *(word(k) for k in range(size))))


def is_slot(x: Column) -> Column:
    return x.isin(NAME, NUMBER, UNIT)


def template(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", form=tokens) -> DataFrame:
    """item_id, canonical and raw tokens of every item."""
    canon, raw = form(F.col(text_col))
    return benchmark.select(F.col(id_col).cast("long").alias("item_id"), canon.alias("canon"), raw.alias("item_raw")).where(F.size("canon") > 0)


def coverable() -> Column:
    """The places of an item that a window with a word in it covers."""
    size = F.least("n_item", F.lit(WINDOW))
    worded = lambda q: F.exists(F.slice("canon", q + 1, size), lambda t: ~is_slot(t))
    starts = F.filter(F.sequence(F.lit(0), F.col("n_item") - size), worded)
    return F.filter(F.sequence(F.lit(0), F.col("n_item") - 1), lambda i: F.exists(starts, lambda q: (q <= i) & (i < q + size)))


def consistent(df: DataFrame, coverage: float) -> DataFrame:
    """Of groups of ``places`` those that cover enough with one value for each of the item's."""
    enough = F.coalesce(F.col("all_of"), coverage * F.col("n_item"))
    df = df.withColumn("n_covered", F.size(F.array_distinct(F.transform("places", lambda p: p["i"])))).where(F.col("n_covered") >= enough)
    slots = F.filter("places", lambda p: is_slot(F.get("canon", p["i"])))
    pair = lambda p: F.struct(F.get("canon", p["i"]).alias("kind"), F.lower(F.get("item_raw", p["i"])).alias("a"), p["t"].alias("b"))
    df = df.withColumn("pairs", F.array_distinct(F.transform(slots, pair)))
    df = df.where(F.size(F.array_distinct(F.transform("pairs", lambda p: F.struct(p["kind"], p["a"])))) == F.size("pairs"))
    return df.select(*ROW, "doc_id", "item_id", "n_covered", "n_item", F.exists("pairs", lambda p: p["a"] != p["b"]).alias("changed"))


def matches(docs: DataFrame, benchmark: DataFrame, form, id_col: str, text_col: str, coverage: float) -> DataFrame | None:
    """The columns of ``leaks`` by the tokens that ``form`` gives; None without items."""
    items = template(benchmark, form=form).withColumn("n_item", F.size("canon"))
    mostly = F.size(F.filter("canon", is_slot)) * 2 > F.col("n_item")
    items = written(items.withColumn("all_of", F.when(mostly, F.size(coverable()))), "items")
    sizes = [r[0] for r in items.select(F.least("n_item", F.lit(WINDOW))).distinct().collect()]  # at most WINDOW numbers
    canon, raw = form(F.col(text_col))
    rows = docs.select(*ROW, F.col(id_col).alias("doc_id"), canon.alias("canon"), raw.alias("raw"))
    found = None
    for size in sizes:
        part = items.where(F.col("n_item") >= WINDOW if size == WINDOW else F.col("n_item") == size)
        known = windows(part, size, "q").where(F.exists(F.slice("canon", F.col("q") + 1, F.lit(size)), lambda t: ~is_slot(t)))
        known = written(known.select("h", "item_id", "q"), "windows")
        if known.count() <= BROADCAST_ROWS:
            known = F.broadcast(known)
        hits = windows(rows, size).join(known, "h")
        hits = hits.select(*ROW, "doc_id", "item_id", (F.col("at") - F.col("q")).alias("offset"), "q", F.slice("raw", F.col("at") + 1, F.lit(size)).alias("seen"))
        found = hits if found is None else found.union(hits)
    if found is None:
        return None
    by_place = found.groupBy(*ROW, "doc_id", "item_id", "offset").agg(F.collect_list(F.struct("q", "seen")).alias("w"))
    places = F.array_distinct(F.flatten(F.transform("w", lambda x: F.transform(x["seen"], lambda t, k: F.struct((x["q"] + k).alias("i"), F.lower(t).alias("t"))))))
    by_place = written(by_place.select(*ROW, "doc_id", "item_id", "offset", places.alias("places")), "places")
    alone = consistent(by_place.join(items, "item_id"), coverage)
    # Offsets less than half an item apart are one copy's; a copy's neighbour begins after its end.
    order = Window.partitionBy(*ROW, "doc_id", "item_id").orderBy("offset")
    near = by_place.join(items.select("item_id", "n_item").distinct(), "item_id")
    near = near.withColumn("new", F.coalesce((F.col("offset") - F.lag("offset").over(order)) * 2 >= F.col("n_item"), F.lit(True)).cast("int"))
    near = near.withColumn("copy", F.sum("new").over(order)).groupBy(*ROW, "doc_id", "item_id", "copy")
    near = near.agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"), F.count("*").alias("n")).where("n > 1")
    several = consistent(near.join(items, "item_id"), coverage)
    if form is literals:
        return alone.union(several).withColumn("path", F.lit(LITERAL))
    return alone.withColumn("path", F.lit(PLACE)).union(several.withColumn("path", F.lit(PLACES)))


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """A row per place and path by which a document holds an item: the document's key (ROW) and
    id, item_id, n_covered and n_item tokens, whether values differ (``changed``), and ``path``."""
    keyed = identified(docs)
    out = [x for form in (tokens, literals) if (x := matches(keyed, benchmark, form, id_col, text_col, coverage)) is not None]
    if not out:
        return docs.sparkSession.createDataFrame([], "_q_file long, _q_row long, doc_id long, item_id long, n_covered int, n_item int, changed boolean, path int")
    return out[0].union(out[1]) if len(out) > 1 else out[0]


def op8_template_decontamination(spark, sf_dir: str) -> DataFrame:
    df = leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    first = df.groupBy("doc_id", "item_id", "path").agg(F.max("n_covered").cast("long").alias("n_covered"), F.max("n_item").cast("long").alias("n_item"), F.min("changed").alias("changed"))
    figures = F.min_by(F.struct("n_covered", "n_item", "changed"), "path").alias("x")
    return first.groupBy("doc_id", "item_id").agg(figures).select("doc_id", "item_id", "x.*")


def clean_stage(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no item, with their own columns."""
    keyed = identified(docs)
    held = written(leaks(keyed, benchmark).select(*ROW).distinct(), "held")
    return keyed.join(held, ROW, "left_anti").select(*named(docs))


_UNITS = ", ".join(f"'{u}'" for u in UNITS)


def _tokens_sql(table: str, key: str) -> str:
    return rf"""
{table}_t AS (
  SELECT rid, {key}, unnest(regexp_extract_all(t, '[\p{{L}}\p{{N}}]+')) AS raw,
         unnest(range(0, len(regexp_extract_all(t, '[\p{{L}}\p{{N}}]+')))) AS i,
         unnest(list_slice(regexp_extract_all(t, '[^\p{{L}}\p{{N}}]+'), 1, len(regexp_extract_all(t, '[\p{{L}}\p{{N}}]+')))) AS sep,
         regexp_matches(t, '^[\p{{L}}\p{{N}}]') AS at_start
  FROM (SELECT row_number() OVER () AS rid, {key}, translate(coalesce(text, ''), '{NAME}{NUMBER}{UNIT}', '   ') AS t FROM {table})
), {table}_s AS (
  SELECT *, CASE WHEN i = 0 THEN NULL WHEN at_start THEN lag(sep) OVER w ELSE sep END AS gap FROM {table}_t WHERE raw IS NOT NULL WINDOW w AS (PARTITION BY rid ORDER BY i)
), {table}_c AS (
  SELECT *, CASE WHEN regexp_matches(raw, '^\p{{N}}') THEN '{NUMBER}'
    WHEN i > 0 AND regexp_matches(raw, '^\p{{Lu}}') AND regexp_full_match(gap, '[^.!?:;\n]{{1,3}}') THEN '{NAME}' ELSE raw END AS c0 FROM {table}_s
), {table}_k AS (
  SELECT rid, {key}, i, lower(raw) AS raw, CASE WHEN c0 IN ({_UNITS}) AND length(gap) <= 3 AND lag(c0) OVER w = '{NUMBER}' THEN '{UNIT}' ELSE lower(c0) END AS c
  FROM {table}_c WINDOW w AS (PARTITION BY rid ORDER BY i)
), {table}_a AS (
  SELECT rid, {key}, list(c ORDER BY i) AS cs, list(raw ORDER BY i) AS rs FROM {table}_k GROUP BY rid, {key}
)"""


ORACLE_SQL = rf"""
WITH {_tokens_sql("documents", "doc_id")}, {_tokens_sql("benchmark", "item_id")},
bw AS (
  SELECT rid AS b, item_id, cs, rs, q, list_slice(cs, q + 1, q + s) AS w, s FROM (
    SELECT *, least(len(cs), {WINDOW}) AS s, unnest(range(0, len(cs) - least(len(cs), {WINDOW}) + 1)) AS q FROM benchmark_a)
  WHERE 2 * len(list_filter(list_slice(cs, q + 1, q + s), lambda x: x IN ('{NAME}', '{NUMBER}', '{UNIT}'))) <= s
), sizes AS (SELECT DISTINCT s FROM bw),
dw AS (
  SELECT rid AS d, doc_id, p, list_slice(cs, p + 1, p + s) AS w, s FROM (
    SELECT rid, doc_id, cs, s, unnest(range(0, len(cs) - s + 1)) AS p FROM documents_a, sizes WHERE len(cs) >= s)
), hit AS (
  SELECT d, doc_id, b, item_id, p - q AS o, unnest(range(q, q + bw.s)) AS i FROM dw JOIN bw ON dw.w = bw.w AND dw.s = bw.s
), pos AS (SELECT DISTINCT d, doc_id, b, item_id, o, i FROM hit),
pair AS (
  SELECT pos.*, len(x.cs) AS n_item, x.cs[i + 1] IN ('{NAME}', '{NUMBER}', '{UNIT}') AS slot, x.rs[i + 1] AS va, y.rs[o + i + 1] AS vb
  FROM pos JOIN benchmark_a x ON pos.b = x.rid JOIN documents_a y ON pos.d = y.rid
), place AS (
  SELECT doc_id, item_id, d, b, o, count(*) AS n_covered, max(n_item) AS n_item,
         coalesce(count(DISTINCT (va, vb)) FILTER (slot), 0) AS np, count(DISTINCT va) FILTER (slot) AS na, count(DISTINCT vb) FILTER (slot) AS nb,
         coalesce(bool_or(va <> vb) FILTER (slot), false) AS changed
  FROM pair GROUP BY ALL
)
SELECT doc_id, item_id, max(n_covered)::BIGINT AS n_covered, max(n_item)::BIGINT AS n_item, bool_and(changed) AS changed
FROM place WHERE n_covered >= {COVERAGE} * n_item AND np = na AND np = nb GROUP BY doc_id, item_id
"""
