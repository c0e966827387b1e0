"""Host-level quality rules, in DataFrame functions only.

Every document is measured by a few rules.  Rule failures are summed by host,
each host's failure rate is shrunk towards an empirical beta prior fitted over
all hosts by the method of moments, and the host's verdicts are joined back.

A document goes if it fails a base rule.  Otherwise it goes if it fails, of the
soft rules, at least two, or at least one that its host is flagged for (shrunk
failure rate above ``flag_rate``).  So a document without any failure stays
whatever its host is, and small hosts are not flagged on a few bad documents.

Null text counts as a text without words; null host is a host of its own; rows
that repeat count as often as they occur; an empty table gives an empty result.
Columns of the input with names of ours are replaced only where ``OUT`` says so;
scratch columns start with ``_q_``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ROW, WORD_PATTERN, identified, named, partitions, written

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SYMBOLS = "#*$%&|<>"
#: Soft rules; each is a condition on the measures.
SOFT = {
    "symbols": "_q_n_symbols > 0.1 * _q_n_words",
    "dup_lines": "_q_n_dup_lines > 0.3 * _q_n_lines",
    "repeats": "_q_n_repeat_words > 0.2 * _q_n_words",
    "word_length": "_q_word_chars < 3 * _q_n_words OR _q_word_chars > 12 * _q_n_words",
}
FLAG_RATE, LEAST_STRENGTH, MOST_STRENGTH = 0.5, 1.0, 10000.0
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def measured(docs: DataFrame, text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: its key, ``carry`` columns, and ``_q_`` measures of the whole text.

    Texts are dealt out once by key.  Each three-word window becomes a row with
    its hash; a sort by key and hash puts equal windows side by side, and those
    with an equal neighbour give the places they cover.  The row of a
    document's first window carries its other measures along."""
    docs = identified(docs)
    t = F.coalesce(F.col(text), F.lit(""))
    dealt = docs.select(*ROW, t.alias("_q_text"), *(F.col(c).alias(f"_q_carry_{c}") for c in carry)).repartition(partitions(docs.sparkSession), *ROW)
    lines = F.filter(F.split("_q_text", "\n"), lambda x: x.rlike(WORD_PATTERN))
    words = F.array_remove(F.split("_q_text", r"[\x20\x09-\x0D]+"), "")
    df = dealt.withColumns({"_q_words": words, "_q_lines": lines})
    df = df.withColumn("_q_i", F.explode(F.sequence(F.lit(0), F.greatest(F.size("_q_words") - 3, F.lit(0)))))
    word = lambda k: F.get("_q_words", F.col("_q_i") + k)
    first = F.struct(
        *(F.col(f"_q_carry_{c}").alias(c) for c in carry),
        F.size("_q_words").cast("long").alias("_q_n_words"),
        F.length(F.array_join("_q_words", "")).cast("long").alias("_q_word_chars"),
        F.regexp_count("_q_text", F.lit(f"[{SYMBOLS}]")).cast("long").alias("_q_n_symbols"),
        F.size("_q_lines").cast("long").alias("_q_n_lines"),
        (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long").alias("_q_n_dup_lines"),
    )
    windows = df.select(*ROW, "_q_i", F.xxhash64(word(0), word(1), word(2)).alias("_q_h"), F.when(F.col("_q_i") == 0, first).alias("_q_first"))
    by_hash = Window.partitionBy(*ROW).orderBy("_q_h")
    windows = windows.withColumns({"_q_a": F.lag("_q_h").over(by_hash), "_q_b": F.lead("_q_h").over(by_hash)})
    twice = F.coalesce(F.col("_q_a") == F.col("_q_h"), F.lit(False)) | F.coalesce(F.col("_q_b") == F.col("_q_h"), F.lit(False))
    windows = windows.withColumn("_q_twice", twice).where("_q_twice OR _q_first IS NOT NULL")
    i = F.col("_q_i")
    by_row = windows.groupBy(*ROW).agg(
        F.max_by("_q_first", F.col("_q_first").isNotNull()).alias("_q_first"),
        F.collect_list(F.when(F.col("_q_twice"), F.array(i, i + 1, i + 2))).alias("_q_covered"),
    )
    return by_row.select(*ROW, "_q_first.*", F.size(F.array_distinct(F.flatten("_q_covered"))).cast("long").alias("_q_n_repeat_words"))


def judged(df: DataFrame) -> DataFrame:
    """Adds base failure and soft failures to measured documents."""
    base = (F.col("_q_n_words") < MIN_WORDS) | (100 * F.col("_q_n_repeat_words") > MAX_REPEAT_PERCENT * F.col("_q_n_words"))
    soft = {f"_q_fail_{k}": F.expr(rule) for k, rule in SOFT.items()}
    return df.withColumns({"_q_base_failed": base} | soft)


def host_verdicts(df: DataFrame, host: str, flag_rate: float = FLAG_RATE) -> DataFrame:
    """One row per host with its shrunk failure rate and flag for each soft rule."""
    by_host = df.groupBy(F.col(host).alias("_q_host")).agg(
        F.count(F.lit(1)).alias("_q_docs"), *(F.sum(F.col(f"_q_fail_{k}").cast("long")).alias(f"_q_sum_{k}") for k in SOFT)
    )
    by_host = written(by_host, "hosts")
    rate = lambda k: F.col(f"_q_sum_{k}") / F.col("_q_docs")
    moments = by_host.agg(*(x for k in SOFT for x in (F.avg(rate(k)).alias(f"m_{k}"), F.var_pop(rate(k)).alias(f"v_{k}")))).first()
    out = by_host
    for k in SOFT:
        alpha, beta = beta_prior(moments[f"m_{k}"], moments[f"v_{k}"])
        shrunk = (F.col(f"_q_sum_{k}") + F.lit(alpha)) / (F.col("_q_docs") + F.lit(alpha + beta))
        out = out.withColumn(f"_q_rate_{k}", shrunk).withColumn(f"_q_flag_{k}", shrunk > flag_rate)
    return written(out, "verdicts")


def beta_prior(mean: float | None, variance: float | None) -> tuple[float, float]:
    """A beta prior by the method of moments; its strength is kept within bounds."""
    if mean is None:
        return LEAST_STRENGTH / 2, LEAST_STRENGTH / 2
    strength = mean * (1 - mean) / variance - 1 if variance > 1e-12 else MOST_STRENGTH
    strength = min(max(strength, LEAST_STRENGTH), MOST_STRENGTH)
    return mean * strength, (1 - mean) * strength


def host_rules(docs: DataFrame, text: str = "text", host: str = "source", flag_rate: float = FLAG_RATE, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: its key, ``carry`` columns, measures, base verdict,
    soft failures, its host's shrunk rates and ``_q_kept``.  The measures, which are
    a few numbers a row, are written once; host verdicts are joined back."""
    df = written(judged(measured(docs, text, tuple(dict.fromkeys((*carry, host))))), "measured")
    hosts = host_verdicts(df, host, flag_rate)
    key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    hosts = hosts.select(key("_q_host").alias("_q_key"), *(f"_q_rate_{k}" for k in SOFT), *(f"_q_flag_{k}" for k in SOFT))
    df = df.withColumn("_q_key", key(host)).join(hosts, "_q_key", "left").drop("_q_key")
    fails = sum((F.col(f"_q_fail_{k}").cast("int") for k in SOFT), F.lit(0))
    flagged = F.lit(False)
    for k in SOFT:
        flagged = flagged | (F.col(f"_q_fail_{k}") & F.col(f"_q_flag_{k}"))
    return df.withColumn("_q_kept", ~F.col("_q_base_failed") & ~(fails >= 2) & ~flagged)


def op5_host_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    df = host_rules(docs, carry=("doc_id",))
    long = lambda k: F.col(f"_q_{k}").alias(k)
    return df.select(
        "doc_id", *map(long, MEASURES[:5]), F.col("_q_base_failed").alias("base_failed"), F.col("_q_kept").alias("kept"), "source"
    )


def filter_stage(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """The documents that stay, with their own columns."""
    keyed = identified(docs)
    kept = written(host_rules(keyed, text, host).where("_q_kept").select(*ROW), "kept")
    return keyed.join(kept, ROW, "left_semi").select(*named(docs))


_WORD_SQL = r"'[^\x20\x09-\x0D]+'"
ORACLE_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT rid, doc_id, source, t, regexp_extract_all(t, {_WORD_SQL}) AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, {_WORD_SQL})) AS ls FROM d
), win AS (
  SELECT rid, i, [ws[i], ws[i + 1], ws[i + 2]] AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)
), twice AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM win) WHERE n > 1
), cover AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) v(k) GROUP BY rid
), m AS (
  SELECT w.rid, doc_id, source, len(ws)::BIGINT AS n_words,
         length(array_to_string(ws, ''))::BIGINT AS word_chars,
         (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines
  FROM w LEFT JOIN cover c ON w.rid = c.rid
), j AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
         n_symbols > 0.1 * n_words AS f1, n_dup_lines > 0.3 * n_lines AS f2, n_repeat_words > 0.2 * n_words AS f3,
         word_chars < 3 * n_words OR word_chars > 12 * n_words AS f4 FROM m
), h AS (
  SELECT source, count(*) AS n, sum(f1::INT) AS s1, sum(f2::INT) AS s2, sum(f3::INT) AS s3, sum(f4::INT) AS s4 FROM j GROUP BY source
), r AS (
  SELECT source, n, k, s FROM (SELECT source, n, unnest([1, 2, 3, 4]) AS k, unnest([s1, s2, s3, s4]) AS s FROM h)
), p AS (
  SELECT k, avg(s / n) AS m, var_pop(s / n) AS v FROM r GROUP BY k
), b AS (
  SELECT k, m, least(greatest(CASE WHEN v > 1e-12 THEN m * (1 - m) / v - 1 ELSE {MOST_STRENGTH} END, {LEAST_STRENGTH}), {MOST_STRENGTH}) AS z FROM p
), flags AS (
  SELECT source, bool_or(k = 1 AND x) AS g1, bool_or(k = 2 AND x) AS g2, bool_or(k = 3 AND x) AS g3, bool_or(k = 4 AND x) AS g4
  FROM (SELECT source, r.k, (s + m * z) / (n + z) > {FLAG_RATE} AS x FROM r JOIN b ON r.k = b.k) GROUP BY source
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (f1::INT + f2::INT + f3::INT + f4::INT >= 2)
       AND NOT ((f1 AND g1) OR (f2 AND g2) OR (f3 AND g3) OR (f4 AND g4)) AS kept, j.source
FROM j JOIN flags ON j.source IS NOT DISTINCT FROM flags.source
"""
