"""Queries that are DataFrame programs over the engine's operators, with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pg
from ..operators import filters, graph, relational, search, versions
from ..sources import io
from ..sources.shared import new_path as _folder
from ..streaming import feeds
from .engine import Engine
from .statements import JOINED

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- relational ------------------------------------------------------------------


@query("SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")
def distinct_on_first(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return relational.distinct_on(df, ["o_custkey"], ["-o_totalprice", "o_orderkey"])


@query("SELECT o_custkey, o_orderkey FROM orders WHERE (o_custkey, o_orderkey) > (50, 900) ORDER BY o_custkey, o_orderkey LIMIT 15")
def keyset_page(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    return relational.top_k(relational.after(df, ["o_custkey", "o_orderkey"], [50, 900]), ["o_custkey", "o_orderkey"], 15)


@query("WITH RECURSIVE t(a, b) AS (SELECT * FROM (VALUES (1, 2), (2, 3), (3, 4), (4, 2), (5, 6)) v(a, b)), r(n) AS (SELECT 1 UNION SELECT t.b FROM r JOIN t ON t.a = r.n) SELECT n FROM r")
def recursive_reach(spark, sf_dir):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 2), (5, 6)], "a int, b int")
    seed = spark.createDataFrame([(1,)], "n int")
    return relational.recursive(seed, lambda r: r.join(edges, F.col("n") == F.col("a")).select(F.col("b").alias("n")))


@query(
    """SELECT o_orderkey, (floor((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) / ceil(count(*) OVER (PARTITION BY o_custkey) / 4.0)) + 1)::BIGINT AS bucket FROM orders"""
)
def ntile_even(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", relational.ntile_even(4, ["o_custkey"], ["o_orderkey"]).alias("bucket"))


@query("SELECT o_orderkey, ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::INT AS bucket FROM orders")
def ntile_standard(spark, sf_dir):
    from pyspark.sql import Window

    return table(spark, sf_dir, "orders").select("o_orderkey", F.ntile(4).over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("bucket"))


@query("SELECT o_orderkey, sum(o_custkey) OVER (PARTITION BY o_orderpriority ORDER BY o_custkey, o_orderkey ROWS UNBOUNDED PRECEDING)::BIGINT AS total FROM orders")
def window_default_rows(spark, sf_dir):
    w = relational.rows_window(["o_orderpriority"], ["o_custkey", "o_orderkey"])
    return table(spark, sf_dir, "orders").select("o_orderkey", F.sum("o_custkey").over(w).alias("total"))


@query("SELECT c_custkey, c_name, CASE WHEN c_custkey <= 10 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer UNION ALL SELECT -1, 'new', 1.5")
def upsert_rows(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    changed = df.where("c_custkey <= 10").withColumn("c_acctbal", F.lit(0.0))
    new = spark.createDataFrame([(-1, "new", 1.5)], df.schema)
    return relational.upsert(df, changed.unionByName(new), ["c_custkey"])


@query("SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal + 100 ELSE c_acctbal END AS c_acctbal FROM customer WHERE NOT (c_acctbal < 0)")
def update_then_delete(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    df = relational.delete(df, F.col("c_acctbal") < 0)
    return relational.update(df, F.col("c_mktsegment") == "BUILDING", c_acctbal=F.col("c_acctbal") + 100).select("c_custkey", "c_acctbal")


@query("SELECT o_orderkey, 100 + 5 * (row_number() OVER (ORDER BY o_orderkey) - 1) AS n FROM orders")
def sequence_numbers(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey")
    return relational.numbered(df, "n", ["o_orderkey"], 100, 5).select("o_orderkey", "n")


@query("SELECT l_orderkey, l_linenumber, s_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_quantity > 49")
def salted_hot_join(spark, sf_dir):
    left = table(spark, sf_dir, "lineitem").where("l_quantity > 49").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("k"))
    right = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), "s_name")
    return relational.salted_join(left, right, ["k"]).select("l_orderkey", "l_linenumber", "s_name")


@query("SELECT o_orderkey, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice > 250000")
def sized_broadcast_join(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").where("o_totalprice > 250000").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    out = relational.sized_join(orders, table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey")), "c_custkey")
    return relational.sized_join(out, table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "n_nationkey").select("o_orderkey", "n_name")


@query("SELECT generate_series AS i FROM generate_series(10, 2, -3)")
def series_operator(spark, sf_dir):
    return relational.generate_series(spark, 10, 2, -3).withColumnRenamed("generate_series", "i")


# --- functions -------------------------------------------------------------------


@query(
    r"""SELECT o_orderkey, epoch_us(o_orderdate) / 1e6 AS epoch, dayofweek(o_orderdate)::INT AS dow, isodow(o_orderdate)::INT AS isodow, (year(o_orderdate) // 10)::INT AS decade,
    ceil(year(o_orderdate) / 100)::INT AS century, date_trunc('month', o_orderdate)::TIMESTAMP AS mon, make_timestamp((year(o_orderdate) // 10) * 10, 1, 1, 0, 0, 0) AS dec,
    strftime(o_orderdate, '%Y-%m-%d %H:%M') AS text FROM orders"""
)
def function_extract(spark, sf_dir):
    d = "o_orderdate"
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", pg.extract("epoch", d).alias("epoch"), pg.extract("dow", d).cast("int").alias("dow"), pg.extract("isodow", d).cast("int").alias("isodow"),
        pg.extract("decade", d).alias("decade"), pg.extract("century", d).alias("century"), pg.date_trunc("month", d).alias("mon"), pg.date_trunc("decade", d).alias("dec"),
        pg.to_char(d, "YYYY-MM-DD HH24:MI").alias("text"),
    )


@query(
    """SELECT * FROM (VALUES (1, 'Hello World-Foo', 'Hel', 'ab', 3.0, -3.0, 2::BIGINT, true), (2, 'Ab1 C', 'ab1', 'ab', -2.0, 2.0, NULL, false)) t(id, init, head, cat, up, cut, pos, has)"""
)
def function_parity(spark, sf_dir):
    df = spark.createDataFrame([(1, "hello WORLD-foo", "Hello", [7, 8], 2.5, -3.7, '{"a":1}'), (2, "ab1 c", "ab1", [1], -2.0, 2.2, "[1]")], "id int, s string, t string, a array<int>, x double, y double, j string")
    return df.select(
        "id", pg.initcap("s").alias("init"), pg.substr("t", -5, 3).alias("head"), pg.concat(F.lit("a"), F.lit(None).cast("string"), F.lit("b")).alias("cat"),
        pg.ceil("x").alias("up"), pg.trunc("y").alias("cut"), pg.array_position("a", 8).alias("pos"), pg.json_has_key("j", "a").alias("has"),
    )


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, 'object' AS kind, true AS ok, '{\"id\":' || event_id || ',\"none\":null}' AS made FROM events")
def function_json_build(spark, sf_dir):
    df = table(spark, sf_dir, "events")
    made = pg.json_build_object(id="event_id", none=F.lit(None).cast("string"))
    return df.select("event_id", pg.json_get("props", "k").alias("k"), pg.json_typeof("props").alias("kind"), pg.json_valid("props").alias("ok"), made.alias("made"))


@query("SELECT event_id, '{\"k\":' || json_extract_string(props, '$.k') || ',\"z\":1}' AS joined, CAST(json_extract(props, '$.k') AS BIGINT) = 7 AS seven FROM events")
def function_json_rewrite(spark, sf_dir):
    df = table(spark, sf_dir, "events")
    return df.select("event_id", pg.json_strip_nulls(pg.json_concat("props", F.lit('{"z":1,"n":null}'))).alias("joined"), pg.json_contains("props", F.lit('{"k":7}')).alias("seven"))


# --- filters ---------------------------------------------------------------------


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 100000 AND o_orderstatus NOT IN ('F', 'P') AND (o_custkey < 50 OR (o_custkey > 100 AND o_orderpriority LIKE '1%')) ORDER BY o_totalprice DESC, o_orderkey LIMIT 30")
def rest_filter(spark, sf_dir):
    params = {"o_totalprice": "gte.100000", "o_orderstatus": "not.in.(F,P)", "or": "(o_custkey.lt.50,and(o_custkey.gt.100,o_orderpriority.like.1*))", "order": "o_totalprice.desc,o_orderkey", "limit": "30", "select": "o_orderkey,o_totalprice"}
    return filters.rest(table(spark, sf_dir, "orders"), params)


@query("SELECT c_custkey FROM customer WHERE c_nationkey = 3 AND c_name IS NOT NULL AND contains(c_mktsegment, 'I')")
def row_security(spark, sf_dir):
    df = filters.row_security(table(spark, sf_dir, "customer"), {"tenant": F.col("c_nationkey") == 3}, "tenant")
    return df.where(filters.metadata("c_name", "is_not_null") & filters.metadata("c_mktsegment", "contains", "I")).select("c_custkey")


# --- search ----------------------------------------------------------------------

_BM25 = rf"""WITH w AS (SELECT doc_id, list_filter(regexp_extract_all({JOINED.format('text')}, '[\p{{L}}\p{{M}}\p{{N}}_]+'), lambda w: regexp_matches(w, '[\p{{L}}\p{{N}}]')) AS t FROM documents),
s AS (SELECT count(*) AS n, avg(len(t)) AS a FROM w), q AS (SELECT unnest(['the', 'ontion', 'que']) AS term),
tf AS (SELECT doc_id, len(t) AS dl, term, len(list_filter(t, lambda x: x = term)) AS f FROM w, q), df AS (SELECT term, count(*) FILTER (f > 0) AS d FROM tf GROUP BY term)
SELECT doc_id AS id, sum(ln((n - d + 0.5) / (d + 0.5) + 1) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / a))) AS score FROM tf JOIN df USING (term), s WHERE f > 0 GROUP BY doc_id"""


@query(f"SELECT id, round(score, 6) AS score FROM ({_BM25}) ORDER BY score DESC, id LIMIT 50")
def search_bm25(spark, sf_dir):
    hits = search.bm25(table(spark, sf_dir, "documents"), "the ontion que", "doc_id", "text")
    return search.best(hits.select("id", F.round("score", 6).alias("score")), 50)


_Q = "(SELECT embedding AS q FROM embeddings ORDER BY vec_id LIMIT 1)"


def _query_vector(spark, sf_dir) -> list[float]:
    return [float(x) for x in table(spark, sf_dir, "embeddings").orderBy("vec_id").select("embedding").first()[0]]


@query(f"SELECT vec_id, round(d, 5) AS distance FROM (SELECT vec_id, sqrt(list_sum(list_transform(list_zip(embedding, q), lambda p: (p[1]::DOUBLE - p[2]) * (p[1]::DOUBLE - p[2])))) AS d FROM embeddings, {_Q}) ORDER BY d, vec_id LIMIT 10")
def knn_l2(spark, sf_dir):
    hits = search.knn(table(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir), 10, "l2", "vec_id")
    return hits.select("vec_id", F.round("distance", 5).alias("distance"))


@query(f"SELECT vec_id, round(1 - list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]), 5) AS distance FROM embeddings, {_Q} WHERE label = 1 ORDER BY 1 - list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]), vec_id LIMIT 10")
def knn_cosine_filtered(spark, sf_dir):
    hits = search.knn(table(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir), 10, "cosine", "vec_id", where=F.col("label") == 1)
    return hits.select("vec_id", F.round("distance", 5).alias("distance"))


@query(f"SELECT vec_id, round(list_inner_product(embedding::DOUBLE[], q::DOUBLE[]), 5) AS ip, round(list_sum(list_transform(list_zip(embedding, q), lambda p: abs(p[1]::DOUBLE - p[2]))), 4) AS l1 FROM embeddings, {_Q}")
def vector_functions(spark, sf_dir):
    q = _query_vector(spark, sf_dir)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(pg.inner_product("embedding", q), 5).alias("ip"), F.round(pg.l1_distance("embedding", q), 4).alias("l1"))


@query()
def knn_ivf(spark, sf_dir):
    """Every vector whose id is divisible by 100; half of the cells are looked into."""
    df = table(spark, sf_dir, "embeddings")
    cells = max(4, min(256, math.isqrt(df.count()) // 2))
    index = search.IvfIndex(df, "vec_id", "embedding", cells=cells)
    return index.search_all(df.where("vec_id % 100 = 0"), 20, probes=-(-cells * 3 // 4))


@query()
def knn_quantized(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings")
    n = df.count()
    pq = search.ProductQuantizer(df, "embedding", parts=16, codes=max(8, min(256, math.isqrt(n))))
    return pq.search(df, df.where("vec_id % 100 = 0"), 20, max(200, 4 * math.isqrt(n)), "vec_id")


@query(
    f"""WITH b AS (SELECT id, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS r FROM ({_BM25}) QUALIFY r <= 100),
    v AS (SELECT vec_id AS id, row_number() OVER (ORDER BY d, vec_id) AS r FROM (SELECT vec_id, round(sqrt(list_sum(list_transform(list_zip(embedding, q), lambda p: (p[1]::DOUBLE - p[2]) * (p[1]::DOUBLE - p[2])))), 9) AS d FROM embeddings, {_Q}) QUALIFY r <= 100)
    SELECT id, round(sum(1.0::DOUBLE / (60 + r)), 9) AS score FROM (SELECT * FROM b UNION ALL SELECT * FROM v) GROUP BY id"""
)
def hybrid_rrf(spark, sf_dir):
    text = search.bm25(table(spark, sf_dir, "documents"), "the ontion que", "doc_id", "text").withColumn("score", F.round("score", 9))
    vec = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.round(pg.l2_distance("embedding", _query_vector(spark, sf_dir)), 9).alias("score"))
    lists = [search.ranked(search.best(text, 100)), search.ranked(vec.orderBy("score", "id").limit(100), descending=False)]
    return search.rrf(lists).select("id", F.round("score", 9).alias("score"))


@query(
    f"""WITH b AS (SELECT id, score AS s FROM ({_BM25}) ORDER BY round(score, 9) DESC, id LIMIT 50), v AS (SELECT vec_id AS id, list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]) AS s FROM embeddings, {_Q} ORDER BY round(s, 9) DESC, vec_id LIMIT 50),
    bn AS (SELECT id, (s - min(s) OVER ()) / (max(s) OVER () - min(s) OVER ()) AS s FROM b), vn AS (SELECT id, (s - min(s) OVER ()) / (max(s) OVER () - min(s) OVER ()) AS s FROM v)
    SELECT id, round(0.6 * coalesce(vn.s, 0) + 0.4 * coalesce(bn.s, 0), 6) AS score FROM vn FULL JOIN bn USING (id)"""
)
def hybrid_linear(spark, sf_dir):
    text = search.bm25(table(spark, sf_dir, "documents"), "the ontion que", "doc_id", "text").withColumn("r", F.round("score", 9))
    vec = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), pg.cosine_similarity("embedding", _query_vector(spark, sf_dir)).alias("score")).withColumn("r", F.round("score", 9))
    out = search.linear(search.best(vec, 50, "r").drop("r"), search.best(text, 50, "r").drop("r"), 0.6)
    return out.select("id", F.round("score", 6).alias("score"))


@query()
def hybrid_mmr(spark, sf_dir):
    q = _query_vector(spark, sf_dir)
    near = search.knn(table(spark, sf_dir, "embeddings"), q, 30, "cosine", "vec_id").select("vec_id", "embedding").collect()  # thirty candidates
    return spark.createDataFrame(search.mmr([(r[0], [float(x) for x in r[1]]) for r in near], q, 10, 0.7), "vec_id long, score double")


@query("SELECT doc_id AS id, i::INT AS ordinal, substr(text, (i * 180 + 1)::BIGINT, 200) AS chunk FROM (SELECT doc_id, text, unnest(range(0, ceil(length(text) / 180.0)::BIGINT)) AS i FROM documents) WHERE length(substr(text, (i * 180 + 1)::BIGINT, 200)) >= 1")
def document_chunks(spark, sf_dir):
    return search.chunks(table(spark, sf_dir, "documents"), "doc_id", "text", 200, 20)


# --- graph -----------------------------------------------------------------------


def _edges(spark, sf_dir) -> DataFrame:
    """customer -> nation -> region, and customer -> order, as c1, n1, r1, o1."""
    c, o, n = (table(spark, sf_dir, t) for t in ("customer", "orders", "nation"))
    name = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    one = F.lit(1.0).alias("weight")
    return (
        c.select(name("c", "c_custkey").alias("src"), name("n", "c_nationkey").alias("dst"), F.lit("lives").alias("label"), one)
        .union(n.select(name("n", "n_nationkey"), name("r", "n_regionkey"), F.lit("in"), F.lit(1.0)))
        .union(o.select(name("c", "o_custkey"), name("o", "o_orderkey"), F.lit("ordered"), (F.col("o_totalprice") / 1000).alias("weight")))
    )


_EDGES_SQL = """e AS (SELECT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst, 1.0::DOUBLE AS weight FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 1.0 FROM nation
    UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey, o_totalprice / 1000 FROM orders)"""


@query(f"WITH RECURSIVE {_EDGES_SQL}, g(node, depth) AS (SELECT 'c1', 0::BIGINT UNION SELECT dst, depth + 1 FROM g JOIN e ON src = node WHERE depth < 3) SELECT node, min(depth) AS depth FROM g GROUP BY node")
def graph_bfs(spark, sf_dir):
    return graph.bfs(graph.directed(_edges(spark, sf_dir)), spark.createDataFrame([("c1",)], "node string"), 3)


@query(f"WITH RECURSIVE {_EDGES_SQL}, g(node, d) AS (SELECT 'c2', 0.0::DOUBLE UNION SELECT dst, d + weight FROM g JOIN e ON src = node) SELECT node, round(min(d), 6) AS distance FROM g GROUP BY node")
def graph_distances(spark, sf_dir):
    best = graph.shortest_distances(graph.directed(_edges(spark, sf_dir)), spark.createDataFrame([("c2",)], "node string"))
    return best.select("node", F.round("distance", 6).alias("distance"))


@query()
def graph_shortest_path(spark, sf_dir):
    edges = graph.directed(_edges(spark, sf_dir), "out", ["lives", "in"])
    path = graph.shortest_path(edges, "c3", "r" + str(table(spark, sf_dir, "nation").join(table(spark, sf_dir, "customer").where("c_custkey = 3"), F.col("n_nationkey") == F.col("c_nationkey")).first()["n_regionkey"]))
    return spark.createDataFrame(list(enumerate(path)), "step int, node string")


@query(f"WITH {_EDGES_SQL}, d AS (SELECT dst AS node, sum(weight) AS w FROM e GROUP BY dst) SELECT node, round(w / (SELECT max(w) FROM d), 9) AS centrality FROM d")
def graph_centrality(spark, sf_dir):
    return graph.centrality(graph.directed(_edges(spark, sf_dir))).select("node", F.round("centrality", 9).alias("centrality"))


@query(
    f"""WITH RECURSIVE {_EDGES_SQL}, g(node, depth) AS (SELECT 'c1', 0::BIGINT UNION SELECT dst, depth + 1 FROM g JOIN e ON src = node WHERE depth < 2), h AS (SELECT node, min(depth) AS depth FROM g GROUP BY node),
    d AS (SELECT dst AS node, sum(weight) AS w FROM e GROUP BY dst), c AS (SELECT node, w / (SELECT max(w) FROM d) AS c FROM d)
    SELECT node, depth, round(1 / (1 + depth) * (1 + 2 * coalesce(c, 0.2)), 9) AS score FROM h LEFT JOIN c USING (node)"""
)
def graph_rerank(spark, sf_dir):
    edges = graph.directed(_edges(spark, sf_dir))
    hits = graph.bfs(edges, spark.createDataFrame([("c1",)], "node string"), 2)
    return graph.reranked(hits, graph.centrality(edges), 2.0).select("node", "depth", F.round("score", 9).alias("score"))


@query("SELECT 'turn:' || conv_id || '-' || turn AS node, 0::BIGINT AS depth FROM conversations WHERE contains(lower(text), 'the') UNION SELECT 'turn:' || b.conv_id || '-' || b.turn, 1 FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE contains(lower(a.text), 'the') AND NOT contains(lower(b.text), 'the')")
def graph_text_search(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").withColumn("id", F.concat_ws("-", "conv_id", "turn"))
    nodes, _ = graph.ingest(t, "id", "turn", None, "text")
    name = lambda d: F.concat(F.lit("turn:"), F.concat_ws("-", "conv_id", F.col("turn") + d))
    edges = graph.directed(t.select(name(0).alias("src"), name(1).alias("dst")))
    known = nodes.select(F.col("node").alias("dst"))
    return graph.graph_search(nodes, edges.join(known, "dst", "left_semi"), "the", 1)


# --- versions, branches, views -----------------------------------------------------


def _log(spark, sf_dir) -> DataFrame:
    """Every order inserted at 1, a third updated at 2, a fifth deleted at 3."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("price"))
    at = lambda ts, op, x: x.select("k", F.lit(ts).cast("long").alias("ts"), F.lit(op).alias("op"), "price")
    return at(1, "I", o).union(at(2, "U", o.where("k % 3 = 0").withColumn("price", F.col("price") + 1))).union(at(3, "D", o.where("k % 5 = 0")))


@query("SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS price FROM orders")
def time_travel_as_of(spark, sf_dir):
    return versions.as_of(_log(spark, sf_dir), ["k"], 2)


@query("SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS price FROM orders WHERE o_orderkey % 5 <> 0")
def time_travel_statement(spark, sf_dir):
    from .engine import Engine

    engine = Engine(spark)
    engine.register_versions("orders_log", _log(spark, sf_dir), ["k"])
    return engine.sql("SELECT k, price FROM orders_log AS OF TRANSACTION 3")


@query("SELECT o_orderkey AS k, 2::BIGINT AS ts FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, 3 FROM orders WHERE o_orderkey % 5 = 0")
def versions_between(spark, sf_dir):
    return versions.versions_between(_log(spark, sf_dir), 2, 3).select("k", "ts")


@query("SELECT o_orderkey AS k, 1::BIGINT AS ts FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT o_orderkey, 2 FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, 3 FROM orders WHERE o_orderkey % 5 = 0")
def version_vacuum(spark, sf_dir):
    return versions.vacuum(_log(spark, sf_dir), ["k"], 2).select("k", "ts")


def _nations(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))


@query("SELECT n_nationkey AS k, CASE WHEN n_nationkey < 3 THEN 'x' ELSE n_name END AS name FROM nation WHERE n_nationkey <> 9 UNION ALL SELECT 99, 'new'")
def branch_overlay(spark, sf_dir):
    delta = spark.createDataFrame([(0, "U", "x"), (1, "U", "x"), (2, "U", "x"), (9, "D", None), (99, "I", "new")], "k int, op string, name string")
    return versions.branch_read(_nations(spark, sf_dir), delta, ["k"])


@query("SELECT n_nationkey AS k, CASE WHEN n_nationkey = 1 THEN 's' WHEN n_nationkey = 2 THEN 't' WHEN n_nationkey = 3 THEN 's3' ELSE n_name END AS name FROM nation WHERE n_nationkey <> 5")
def branch_merge(spark, sf_dir):
    base = _nations(spark, sf_dir)
    source = relational.update(relational.update(base, F.col("k") == 1, name="s"), F.col("k") == 3, name="s3").where("k <> 5")
    target = relational.update(relational.update(base, F.col("k") == 2, name="t"), F.col("k") == 3, name="t3")
    return versions.three_way_merge(base, source, target, ["k"], "auto")


@query("SELECT n_nationkey AS k, n_name AS name, 'left' AS side FROM nation WHERE n_nationkey IN (1, 4) UNION ALL SELECT 1, 's', 'right'")
def branch_diff(spark, sf_dir):
    base = _nations(spark, sf_dir)
    return versions.diff(base, relational.update(base, F.col("k") == 1, name="s").where("k <> 4"))


@query("SELECT o_orderstatus AS s, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderkey % 5 <> 0 GROUP BY o_orderstatus")
def view_incremental_aggregate(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"), F.col("o_totalprice").alias("price"))
    view = o.where("k % 7 <> 0").groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.sum("price").alias("total"))
    deltas = o.where("k % 7 = 0").withColumn("op", F.lit("I")).union(o.where("k % 5 = 0").withColumn("op", F.lit("D")))
    return versions.merged_aggregate(view, deltas, ["s"], "price").withColumn("total", F.round("total", 2))


@query("SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 0 THEN o_totalprice * 2 ELSE o_totalprice END AS price FROM orders WHERE CASE WHEN o_orderkey % 4 = 0 THEN o_totalprice * 2 ELSE o_totalprice END > 200000")
def view_incremental_filter(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("price"))
    deltas = o.where("k % 4 = 0").select("k", (F.col("price") * 2).alias("price"), F.lit("U").alias("op"))
    return versions.merged_filter(o.where("price > 200000"), deltas, ["k"], "price > 200000")


@query("SELECT o_orderkey AS k, c_name AS name FROM orders JOIN customer ON c_custkey = CASE WHEN o_orderkey % 9 = 0 THEN 1 ELSE o_custkey END")
def view_incremental_join(spark, sf_dir):
    left = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"))
    right = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("c"), F.col("c_name").alias("name"))
    deltas = left.where("k % 9 = 0").select("k", F.lit(1).cast("long").alias("c"), F.lit("U").alias("op"))
    view = left.join(right, "c").select("k", "name")
    return versions.merged_join(view, left, right, deltas, ["c"], ["k"])


# --- streaming -------------------------------------------------------------------


def _event_stream(spark, sf_dir) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_tumbling(spark, sf_dir):
    df = feeds.windowed(_event_stream(spark, sf_dir), "ts", "1 hour", keys=["event_type"], value="value")
    out = feeds.collected(df, _folder(spark, "out"), _folder(spark, "state"), "complete")
    return out.select("start", "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT s AS start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE, time_bucket(INTERVAL 30 MINUTE, ts)]) AS s FROM events) GROUP BY s")
def stream_sliding(spark, sf_dir):
    df = feeds.windowed(_event_stream(spark, sf_dir), "ts", "1 hour", "30 minutes")
    return feeds.collected(df, _folder(spark, "out"), _folder(spark, "state"), "complete").select("start", "n")


@query("SELECT event_id, user_id::VARCHAR AS who, event_type FROM events WHERE value > 50")
def stream_subscription(spark, sf_dir):
    sub = feeds.Subscription(where="value > 50", rename={"user_id": "who"}, drop=["props", "value", "ts"], cast={"user_id": "string"})
    return feeds.collected(feeds.subscribed(_event_stream(spark, sf_dir), sub), _folder(spark, "out"), _folder(spark, "state"))


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def stream_maintained_view(spark, sf_dir):
    out = _folder(spark, "view")
    stream = _event_stream(spark, sf_dir).select("event_type", "value", F.lit("I").alias("op"))
    feeds.maintained_view(stream, out, ["event_type"], "value", _folder(spark, "state")).awaitTermination()
    return spark.read.parquet(f"{out}/v=1").select("event_type", "n", F.round("total", 4).alias("total"))


# --- statements that change something ------------------------------------------------


def script(spark, sf_dir: str, tables: list[str], *statements: str) -> DataFrame:
    """What the last of a session's statements gives."""
    engine = Engine(spark)
    engine.register_dir(sf_dir, tables)
    for s in statements[:-1]:
        engine.sql(s)
    return engine.sql(statements[-1])


@query("SELECT c_custkey AS id, c_name AS label, c_acctbal + 1 AS balance, 7 AS extra FROM customer WHERE c_nationkey < 5 AND c_custkey % 2 = 0")
def statement_table(spark, sf_dir):
    return script(
        spark, sf_dir, ["customer"],
        "CREATE TABLE s_table AS SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, c_mktsegment AS seg FROM customer WHERE c_nationkey < 5",
        "ALTER TABLE s_table ADD COLUMN extra INT DEFAULT 7", "ALTER TABLE s_table RENAME COLUMN name TO label", "ALTER TABLE s_table DROP COLUMN seg",
        "ALTER TABLE s_table ALTER COLUMN balance TYPE DOUBLE PRECISION", "ALTER TABLE s_table ALTER COLUMN label SET NOT NULL", "ALTER TABLE s_table ADD PRIMARY KEY (id)",
        "UPDATE s_table SET balance = balance + 1 WHERE id >= 0", "DELETE FROM s_table WHERE id % 2 = 1", "ALTER TABLE s_table RENAME TO s_table_2", "SELECT * FROM s_table_2",
    )


@query("SELECT n_nationkey AS id, CASE WHEN n_nationkey < 3 THEN 100 + n_nationkey ELSE n_nationkey END::BIGINT AS v FROM nation UNION ALL SELECT 99, 1")
def statement_upsert(spark, sf_dir):
    return script(
        spark, sf_dir, ["nation"], "CREATE TABLE s_upsert (id INT PRIMARY KEY, v BIGINT DEFAULT 1)", "INSERT INTO s_upsert SELECT n_nationkey, n_nationkey FROM nation",
        "INSERT INTO s_upsert (id, v) VALUES (0, 100), (1, 100), (2, 100) ON CONFLICT (id) DO UPDATE SET v = excluded.v + v",
        "INSERT INTO s_upsert (id) VALUES (5), (99) ON CONFLICT (id) DO NOTHING", "SELECT id, v FROM s_upsert",
    )


@query("SELECT o_orderkey AS k, o_totalprice * 2 AS p, c_name AS who FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 3 UNION ALL SELECT o_orderkey, o_totalprice, NULL FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey NOT IN (3, 4)")
def statement_update_from(spark, sf_dir):
    return script(
        spark, sf_dir, ["orders", "customer"], "CREATE TABLE s_orders AS SELECT o_orderkey AS k, o_custkey AS c, o_totalprice AS p, NULL::text AS who FROM orders",
        "UPDATE s_orders AS o SET p = o.p * 2, who = customer.c_name FROM customer WHERE o.c = customer.c_custkey AND customer.c_nationkey = 3",
        "DELETE FROM s_orders USING customer WHERE s_orders.c = customer.c_custkey AND customer.c_nationkey = 4", "SELECT k, p, who FROM s_orders",
    )


@query("SELECT 10::BIGINT AS a, 13::BIGINT AS b, 13::BIGINT AS c, 13::BIGINT AS d, 1003::BIGINT AS e")
def statement_sequence(spark, sf_dir):
    return script(
        spark, sf_dir, [], "CREATE SEQUENCE s_seq START WITH 10 INCREMENT BY 3", "CREATE TABLE s_seen AS SELECT nextval('s_seq') AS a, nextval('s_seq') AS b, currval('s_seq') AS c, lastval() AS d",
        "SELECT setval('s_seq', 1000) AS x", "CREATE TABLE s_next AS SELECT nextval('s_seq') AS e", "SELECT a, b, c, d, e FROM s_seen, s_next",
    )


@query("SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 3 AND c_acctbal > 100")
def statement_prepared(spark, sf_dir):
    return script(spark, sf_dir, ["customer"], "PREPARE s_p (INT, DOUBLE) AS SELECT c_custkey, c_name FROM customer WHERE c_nationkey = $1 AND c_acctbal > $2", "EXECUTE s_p(1 + 2, 100)")


@query("SELECT o_orderkey, o_totalprice * 0.2::DOUBLE AS tax, (o_custkey // 10 + 1) * 2 AS bucket FROM orders")
def statement_function(spark, sf_dir):
    return script(
        spark, sf_dir, ["orders"], "CREATE FUNCTION s_tax(price DOUBLE PRECISION) RETURNS DOUBLE PRECISION AS $$ SELECT price * 0.2::float8 $$ LANGUAGE sql IMMUTABLE",
        "CREATE OR REPLACE FUNCTION s_twice(bigint) RETURNS bigint LANGUAGE sql AS 'SELECT $1 * 2'", "SELECT o_orderkey, s_tax(o_totalprice) AS tax, s_twice(o_custkey / 10 + 1) AS bucket FROM orders",
    )


@query("SELECT c_nationkey, count(*) + (c_nationkey = 1)::INT AS n FROM customer GROUP BY c_nationkey")
def statement_materialized_view(spark, sf_dir):
    return script(
        spark, sf_dir, ["customer"], "CREATE TABLE s_base AS SELECT c_custkey, c_nationkey FROM customer",
        "CREATE MATERIALIZED VIEW s_view AS SELECT c_nationkey, count(*) AS n FROM s_base GROUP BY c_nationkey", "INSERT INTO s_base VALUES (-1, 1)",
        "REFRESH MATERIALIZED VIEW s_view", "ALTER MATERIALIZED VIEW s_view RENAME TO s_counts", "SELECT c_nationkey, n FROM s_counts",
    )


@query("SELECT n_nationkey AS k, CASE WHEN n_nationkey = 1 THEN 'theirs' WHEN n_nationkey = 2 THEN 'main' ELSE n_name END AS v FROM nation WHERE n_nationkey <> 3")
def statement_branch(spark, sf_dir):
    return script(
        spark, sf_dir, ["nation"], "CREATE TABLE s_branch (k INT PRIMARY KEY, v TEXT)", "INSERT INTO s_branch SELECT n_nationkey, n_name FROM nation", "CREATE BRANCH s_dev", "USE BRANCH s_dev",
        "UPDATE s_branch SET v = 'theirs' WHERE k = 1", "DELETE FROM s_branch WHERE k = 3", "USE BRANCH main", "UPDATE s_branch SET v = 'main' WHERE k IN (1, 2)", "MERGE BRANCH s_dev INTO main", "SELECT k, v FROM s_branch",
    )


@query("SELECT n_nationkey AS k, n_name AS v FROM nation UNION ALL SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1")
def statement_copy(spark, sf_dir):
    a, b = _folder(spark, "copy"), _folder(spark, "copy")
    return script(
        spark, sf_dir, ["nation"], "CREATE TABLE s_copy (k INT, v TEXT)", f"COPY (SELECT n_nationkey, n_name FROM nation) TO '{a}' WITH (FORMAT csv, HEADER true)", f"COPY s_copy FROM '{a}' WITH (FORMAT csv, HEADER true)",
        f"COPY (SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1) TO '{b}'", f"COPY s_copy (k, v) FROM '{b}'", "SELECT k, v FROM s_copy",
    )


@query("SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS price FROM orders WHERE o_orderkey % 5 <> 0")
def time_travel_now(spark, sf_dir):
    engine = Engine(spark)
    engine.register_versions("s_log", _log(spark, sf_dir), ["k"])
    engine.sql("VACUUM s_log")
    return engine.sql("SELECT k, price FROM s_log AS OF NOW")


# --- sources -------------------------------------------------------------------------


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey > 10 ORDER BY c_custkey LIMIT 40")
def source_csv(spark, sf_dir):
    path = _folder(spark, "csv")
    io.export(table(spark, sf_dir, "customer"), path, "csv", ["c_custkey", "c_name", "c_acctbal"], "c_custkey > 10", ["c_custkey"], 40)
    return io.import_file(spark, path, "csv").select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_name", "c_acctbal")


@query("SELECT event_id, event_type AS kind, value FROM events")
def source_json_lines(spark, sf_dir):
    path = _folder(spark, "json")
    io.export(table(spark, sf_dir, "events"), path, "jsonl", ["event_id", "event_type", "value", "props"])
    return io.import_file(spark, path, "jsonl", {"event_type": "kind"}, ["props"])


@query("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderstatus IN ('F', 'P') GROUP BY o_orderstatus")
def source_partitioned(spark, sf_dir):
    path = _folder(spark, "parts")
    io.write_partitioned(table(spark, sf_dir, "orders"), path, ["o_orderstatus"], 4)
    return spark.read.parquet(path).where("o_orderstatus IN ('F', 'P')").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def source_dump_restore(spark, sf_dir):
    path = _folder(spark, "dump")
    io.dump({t: table(spark, sf_dir, t) for t in ("nation", "region")}, path)
    back = io.restore(spark, path, ["nation", "region"])
    return back["nation"].join(back["region"], F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")


@query("SELECT 'INSERT INTO \"nation\" (\"n_nationkey\", \"n_name\") VALUES (' || n_nationkey || ', ''' || replace(n_name, '''', '''''') || ''');' AS value FROM nation")
def source_inserts(spark, sf_dir):
    return io.inserts(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "nation")


# --- more of search and graphs --------------------------------------------------------


@query(f"SELECT vec_id AS id, round(0.7 * d / max(d) OVER () - 0.3 * least(c, 1.0), 6) AS score FROM (SELECT vec_id, label / 10.0 AS c, sqrt(list_sum(list_transform(list_zip(embedding, q), lambda p: (p[1]::DOUBLE - p[2]) * (p[1]::DOUBLE - p[2])))) AS d FROM embeddings, {_Q} ORDER BY d, vec_id LIMIT 40)")
def knn_biased(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings")
    hits = search.knn(df, _query_vector(spark, sf_dir), 40, "l2", "vec_id").select(F.col("vec_id").alias("id"), "distance")
    central = df.select(F.col("vec_id").alias("id"), (F.col("label") / 10).alias("centrality"))
    return search.biased(hits, central, 40, 0.3).select("id", F.round("score", 6).alias("score"))


@query(f"SELECT id, place FROM (SELECT id, row_number() OVER (PARTITION BY source ORDER BY score DESC, id) AS place FROM (SELECT id, round(score, 6) AS score, source FROM ({_BM25}) b JOIN documents ON id = doc_id WHERE lang = 'en') WHERE score >= 0.5) WHERE place <= 2")
def search_refined(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    hits = search.bm25(docs, "the ontion que", "doc_id", "text").select("id", F.round("score", 6).alias("score"))
    return search.refined(hits.join(docs.select(F.col("doc_id").alias("id"), "source", "lang"), "id"), 0.5, group_by="source", per_group=2, namespace=("lang", "en")).select("id", "place")


@query("SELECT doc_id AS id, 2::INT AS first, 4::INT AS last, substr(text, 361, 200) || ' ' || substr(text, 541, 200) || ' ' || substr(text, 721, 200) AS text FROM documents WHERE length(text) > 920 UNION ALL SELECT doc_id, 5, 5, substr(text, 901, 200) FROM documents WHERE length(text) > 920")
def rag_merged(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where(F.length("text") > 920)
    chunks = search.chunks(docs, "doc_id", "text", 200, 20)
    return search.merged(chunks.where("ordinal BETWEEN 2 AND 5").select("id", "ordinal"), chunks, 610)


@query(f"WITH RECURSIVE {_EDGES_SQL}, g(node, depth) AS (SELECT 'c1', 0::BIGINT UNION SELECT dst, depth + 1 FROM g JOIN e ON src = node WHERE depth < 2 AND (dst LIKE 'n%' OR dst LIKE 'r%')) SELECT node, min(depth) AS depth FROM g GROUP BY node HAVING node NOT LIKE 'r%'")
def graph_in_sql(spark, sf_dir):
    engine = Engine(spark)
    engine.register_graph(_edges(spark, sf_dir))
    return engine.sql("SELECT node, depth FROM graph_traverse('c1', 'lives', 'out', 2)")


@query("SELECT 0::BIGINT AS step, 'c3' AS node UNION ALL SELECT 1, 'n' || c_nationkey FROM customer WHERE c_custkey = 3 UNION ALL SELECT 2, 'r' || n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey = 3")
def graph_path_in_sql(spark, sf_dir):
    engine = Engine(spark)
    engine.register_graph(_edges(spark, sf_dir))
    goal = engine.spark.read.parquet(f"{sf_dir}/nation.parquet").join(table(spark, sf_dir, "customer").where("c_custkey = 3"), F.col("n_nationkey") == F.col("c_nationkey")).first()["n_regionkey"]
    return engine.sql(f"SELECT step, node FROM graph_shortest_path('c3', 'r{goal}', 'dijkstra')")


@query("""SELECT src, dst, round(weight, 5) AS weight FROM (SELECT a.vec_id AS src, b.vec_id AS dst, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS weight,
    row_number() OVER (PARTITION BY a.vec_id ORDER BY round(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9), b.vec_id) AS r FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0) WHERE r <= 3 AND weight >= 0.2""")
def graph_linked_by_vector(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return graph.linked_by_vector(df.where("id % 100 = 0"), df, 3, 0.2, 8).select("src", "dst", F.round("weight", 5).alias("weight"))


# --- more of views and streams ---------------------------------------------------------


@query("SELECT o_custkey AS c, min(p) AS low, max(p) AS high, round(avg(p), 6) AS mean FROM (SELECT o_custkey, CASE WHEN o_orderkey % 9 = 0 THEN o_totalprice * 10 ELSE o_totalprice END AS p FROM orders) GROUP BY o_custkey")
def view_incremental_extremes(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), F.col("o_totalprice").alias("p"))
    view = o.groupBy("c").agg(F.min("p").alias("low"), F.max("p").alias("high"), F.avg("p").alias("mean"))
    after = o.withColumn("p", F.when(F.col("k") % 9 == 0, F.col("p") * 10).otherwise(F.col("p")))
    deltas = after.where("k % 9 = 0").withColumn("op", F.lit("U"))
    return versions.merged_extremes(view, deltas, after, ["c"], "p").select("c", "low", "high", F.round("mean", 6).alias("mean"))


@query("SELECT o_custkey AS c, count(*) AS n, round(sum(o_totalprice + (CASE WHEN o_orderkey % 4 = 0 THEN 5 ELSE 0 END)), 2) AS total FROM orders GROUP BY o_custkey")
def view_incremental_updates(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c"), F.col("o_totalprice").alias("p"))
    view = o.groupBy("c").agg(F.count("*").alias("n"), F.sum("p").alias("total"))
    deltas = o.where("o_orderkey % 4 = 0").select("c", (F.col("p") + 5).alias("p"), F.col("p").alias("old_p"), F.lit("U").alias("op"))
    return versions.merged_aggregate(view, deltas, ["c"], "p").select("c", "n", F.round("total", 2).alias("total"))


@query("SELECT o_orderkey AS k, o_custkey AS c, CASE WHEN c_custkey % 7 = 0 THEN 'new' ELSE c_name END AS name FROM orders JOIN customer ON o_custkey = c_custkey")
def view_incremental_join_right(spark, sf_dir):
    left = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"))
    right = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("c"), F.col("c_name").alias("name"))
    view = left.join(right, "c").select("k", "c", "name")
    none = left.limit(0).withColumn("op", F.lit("I"))
    changed = right.where("c % 7 = 0").select("c", F.lit("new").alias("name"), F.lit("U").alias("op"))
    return versions.merged_join(view, left, right, none, ["c"], ["k"], changed, ["c"])


@query("SELECT 'c' AS column_name, 'int' AS left_type, 'bigint' AS right_type UNION ALL SELECT 'd', NULL, 'string'")
def branch_schema_diff(spark, sf_dir):
    return versions.schema_diff(spark.createDataFrame([], "a int, c int"), spark.createDataFrame([], "a int, c long, d string"))


@query("SELECT min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS \"end\", user_id, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 30 MINUTE, true)::INT AS fresh FROM events)) GROUP BY user_id, s")
def event_sessions(spark, sf_dir):
    return feeds.sessions(table(spark, sf_dir, "events"), "ts", "30 minutes", ["user_id"])


@query("SELECT event_id AS lsn, event_type AS table_name, value FROM events WHERE event_id > 100 AND event_id <= 900 AND event_type IN ('click', 'view')")
def change_feed(spark, sf_dir):
    path = _folder(spark, "changes")
    log = table(spark, sf_dir, "events").select(F.col("event_id").alias("lsn"), F.col("event_type").alias("table_name"), "value")
    log.repartition(5).write.parquet(path)
    stream = feeds.changes(feeds.change_stream(spark, path, log.schema, 2), 100, 900, ["click", "view"])  # several batches
    return feeds.collected(stream, _folder(spark, "out"), _folder(spark, "state"))


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def stream_view_over_batches(spark, sf_dir):
    """A view over a stream of several batches."""
    path, out = _folder(spark, "changes"), _folder(spark, "view")
    log = table(spark, sf_dir, "events").select("event_type", "value", F.lit("I").alias("op"))
    log.repartition(6).write.parquet(path)
    stream = feeds.change_stream(spark, path, log.schema, 2)
    feeds.maintained_view(stream, out, ["event_type"], "value", _folder(spark, "state")).awaitTermination()
    return spark.read.parquet(f"{out}/v=3").select("event_type", "n", F.round("total", 4).alias("total"))
