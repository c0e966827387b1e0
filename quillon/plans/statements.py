"""Queries that are one SQL statement, in the engine's dialect, and DuckDB's where it differs."""

from __future__ import annotations

#: DuckDB's text with what joins letters or digits to one word replaced by a private character.
JOINED = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(coalesce({0}, '')), '(\p{{L}})[:.''’·](\p{{L}})', '\1\2', 'g'), '(\p{{L}})[:.''’·](\p{{L}})', '\1\2', 'g'),
'(\p{{N}})[.,;''’](\p{{N}})', '\1\2', 'g'), '(\p{{N}})[.,;''’](\p{{N}})', '\1\2', 'g')"""
#: name: (statement, DuckDB's statement or None for the same)
STATEMENTS: dict[str, tuple[str, str | None]] = {
    # --- scans, filters, projections
    "q_pricing_summary": (
        """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
           round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge,
           round(avg(l_quantity), 4) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
           FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus""",
        None,
    ),
    "q_forecast_revenue": ("SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1994-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1995-01-01 00:00:00' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24", None),
    "scan_projection": ("SELECT c_custkey, c_mktsegment FROM customer", None),
    "scan_filtered": ("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 200000", None),
    "project_expressions": ("SELECT o_orderkey, o_totalprice * 2 AS doubled, o_orderkey % 7 AS rest, -o_custkey AS negative FROM orders", None),
    "distinct_rows": ("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders", None),
    "distinct_on_statement": ("SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_orderkey", None),
    "dual_scan": ("SELECT 1 AS one, 'x' AS letter", None),
    "derived_table_alias": ("SELECT s.k, s.n FROM (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey) s WHERE s.n > 12", None),
    # --- aggregates
    "aggregate_having": ("SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey HAVING count(*) > 14", None),
    "aggregate_global": ("SELECT count(*) AS n, count(c_acctbal) AS known, min(c_acctbal) AS low, max(c_name) AS last, round(avg(c_acctbal), 6) AS mean FROM customer", None),
    "aggregate_global_empty": ("SELECT count(*) AS n, sum(o_totalprice) AS total, max(o_orderkey) AS top FROM orders WHERE o_orderkey < 0", None),
    "aggregate_distinct": ("SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers, count(DISTINCT o_orderpriority) AS kinds FROM orders GROUP BY o_orderstatus", None),
    "aggregate_expression_key": ("SELECT o_orderkey % 10 AS bucket, count(*) AS n, min(o_totalprice) AS low FROM orders GROUP BY o_orderkey % 10", None),
    "aggregate_string_agg": (
        "SELECT n_regionkey, string_agg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey",
        "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey",
    ),
    "aggregate_group_concat": (
        "SELECT n_regionkey, GROUP_CONCAT(n_name ORDER BY n_name SEPARATOR ';') AS names FROM nation GROUP BY n_regionkey",
        "SELECT n_regionkey, string_agg(n_name, ';' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey",
    ),
    "aggregate_array_agg": (
        "SELECT n_regionkey, array_join(sort_array(array_agg(n_name)), '|') AS names FROM nation GROUP BY n_regionkey",
        "SELECT n_regionkey, array_to_string(list_sort(list(n_name)), '|') AS names FROM nation GROUP BY n_regionkey",
    ),
    "aggregate_json_agg": (
        "SELECT n_regionkey, json_agg(n_nationkey ORDER BY n_nationkey) AS keys FROM nation GROUP BY n_regionkey",
        "SELECT n_regionkey, to_json(list_sort(list(n_nationkey)))::VARCHAR AS keys FROM nation GROUP BY n_regionkey",
    ),
    "aggregate_null_group": ("SELECT k, count(*) AS n, count(v) AS nv, sum(v) AS sv FROM (VALUES (1, 2), (1, NULL), (NULL, 5), (NULL, 7), (2, NULL)) t(k, v) GROUP BY k", None),
    "aggregate_spread": ("SELECT o_orderstatus, round(stddev_samp(o_totalprice), 4) AS sd, round(var_samp(o_totalprice) / 1000000, 4) AS var_m FROM orders GROUP BY o_orderstatus", None),
    "aggregate_filter_clause": ("SELECT o_custkey % 5 AS g, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) AS n FROM orders GROUP BY o_custkey % 5", None),
    "aggregate_rollup": ("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)", None),
    "aggregate_cube": ("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)", None),
    # --- joins
    "join_inner": ("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 300000", None),
    "join_left": ("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey", None),
    "join_left_residual": ("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 250000 GROUP BY c_custkey", None),
    "join_right": ("SELECT c_custkey, o_orderkey FROM orders RIGHT JOIN customer ON o_custkey = c_custkey AND o_orderstatus = 'P'", None),
    "join_full": ("SELECT a.k AS ak, b.k AS bk FROM (SELECT c_custkey AS k FROM customer WHERE c_custkey % 2 = 0) a FULL JOIN (SELECT c_custkey AS k FROM customer WHERE c_custkey % 3 = 0) b ON a.k = b.k", None),
    "join_cross": ("SELECT r_name, n_name FROM region CROSS JOIN nation", None),
    "join_theta": ("SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey", None),
    "join_nonequi": ("SELECT a.r_regionkey AS a, b.n_nationkey AS b FROM region a JOIN nation b ON b.n_nationkey > a.r_regionkey * 5", None),
    "join_self": ("SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey", None),
    "join_using": ("SELECT k, x, y FROM (SELECT n_nationkey AS k, n_name AS x FROM nation) a JOIN (SELECT s_nationkey AS k, s_name AS y FROM supplier) b USING (k)", None),
    "join_natural": ("SELECT * FROM (SELECT n_nationkey AS k, n_name AS x FROM nation) a NATURAL JOIN (SELECT s_nationkey AS k, s_name AS y FROM supplier) b", None),
    "join_lateral": ("SELECT c_custkey, t.o_orderkey FROM customer, LATERAL (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2) t", None),
    "join_multi": (
        """SELECT r_name, n_name, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey
           JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name""",
        None,
    ),
    "join_null_keys": ("SELECT a.x, b.y FROM (VALUES (1, 'a'), (NULL, 'b'), (2, 'c')) a(k, x) LEFT JOIN (VALUES (1, 'p'), (NULL, 'q')) b(k, y) ON a.k = b.k", None),
    "join_cross_type": ("SELECT a.k AS k, b.y AS y FROM (VALUES ('1'), ('2')) a(k) JOIN (VALUES (1, 'p'), (3, 'q')) b(k, y) ON a.k::int4 = b.k", "SELECT a.k AS k, b.y AS y FROM (VALUES ('1'), ('2')) a(k) JOIN (VALUES (1, 'p'), (3, 'q')) b(k, y) ON a.k::INT = b.k"),
    "join_semi_in": ("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 350000)", None),
    "join_semi_exists": ("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')", None),
    "join_anti_not_exists": ("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)", None),
    "join_anti_left_null": ("SELECT c_custkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE o_orderkey IS NULL", None),
    "join_anti_not_in_null": ("SELECT x FROM (VALUES (1), (2), (3)) t(x) WHERE x NOT IN (SELECT y FROM (VALUES (1), (NULL)) s(y))", None),
    # --- sorts, limits
    "sort_nulls": ("SELECT x, row_number() OVER (ORDER BY x) AS up, row_number() OVER (ORDER BY x DESC) AS down FROM (VALUES (3), (NULL), (1), (2)) t(x)", "SELECT x, row_number() OVER (ORDER BY x NULLS FIRST) AS up, row_number() OVER (ORDER BY x DESC NULLS LAST) AS down FROM (VALUES (3), (NULL), (1), (2)) t(x)"),
    "limit_offset": ("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 25", None),
    "limit_mysql": ("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 5, 10", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 5"),
    "top_k": ("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20", None),
    # --- set operations
    "union_distinct": ("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey AS k FROM supplier", None),
    "union_all": ("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey AS k FROM supplier", None),
    "intersect_distinct": ("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey AS k FROM supplier", None),
    "intersect_all": ("SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey AS k FROM supplier", None),
    "except_distinct": ("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey AS k FROM orders", None),
    "except_all": ("SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey AS k FROM supplier", None),
    # --- CTEs
    "cte_chain": ("WITH a AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey), b AS (SELECT k FROM a WHERE n > 13) SELECT c_name FROM customer JOIN b ON c_custkey = k", None),
    "cte_column_alias": ("WITH t(k, n) AS (SELECT o_custkey, count(*) FROM orders GROUP BY o_custkey) SELECT max(n) AS top, min(k) AS low FROM t", None),
    "generate_series_up": ("SELECT generate_series AS i FROM generate_series(1, 10, 3)", "SELECT generate_series AS i FROM generate_series(1, 10, 3)"),
    "generate_series_empty": ("SELECT generate_series AS i FROM generate_series(5, 1)", "SELECT generate_series AS i FROM generate_series(5, 1)"),
    "generate_series_down": ("SELECT generate_series AS i FROM generate_series(9, 1, -4)", "SELECT generate_series AS i FROM generate_series(9, 1, -4)"),
    "unnest_array": ("SELECT unnest(ARRAY[3, 1, 2]) AS x", "SELECT unnest([3, 1, 2]) AS x"),
    # --- windows
    "window_ranking": ("SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER w AS rk, dense_rank() OVER w AS dr FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey)", None),
    "window_distribution": ("SELECT o_orderkey, round(percent_rank() OVER w, 9) AS pr, round(cume_dist() OVER w, 9) AS cd FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice)", None),
    "window_lag_lead": ("SELECT o_orderkey, lag(o_totalprice) OVER w AS before, lead(o_totalprice, 2, 0.0) OVER w AS later FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)", None),
    "window_first_last_nth": (
        """SELECT o_orderkey, first_value(o_totalprice) OVER w AS f, last_value(o_totalprice) OVER w AS l, nth_value(o_totalprice, 2) OVER w AS n2
           FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""",
        None,
    ),
    "window_running_rows": ("SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS total FROM orders", None),
    "window_moving_frame": ("SELECT o_orderkey, round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 4) AS mean, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders", None),
    "window_range_frame": ("SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_orderkey ORDER BY l_quantity RANGE BETWEEN 5 PRECEDING AND CURRENT ROW) AS n FROM lineitem", None),
    "window_min_max": ("SELECT o_orderkey, min(o_totalprice) OVER (PARTITION BY o_custkey) AS low, max(o_totalprice) OVER (PARTITION BY o_custkey) AS top FROM orders", None),
    # --- predicates
    "predicate_between_in": ("SELECT p_partkey FROM part WHERE p_size BETWEEN 5 AND 9 AND p_size NOT IN (6, 8) AND p_retailprice NOT BETWEEN 1000 AND 1200", None),
    "predicate_nulls": ("SELECT x, x = NULL AS eq, x IS NULL AS isnull, x IN (1, NULL) AS isin, NOT (x > 1) AS neg FROM (VALUES (1), (2), (NULL)) t(x)", None),
    "predicate_distinct_from": ("SELECT a, b, a IS DISTINCT FROM b AS d, a IS NOT DISTINCT FROM b AS s FROM (VALUES (1, 1), (1, NULL), (NULL, NULL)) t(a, b)", None),
    "predicate_like": ("SELECT p_partkey FROM part WHERE p_name LIKE '%a%' AND p_type NOT LIKE '%zz%'", None),
    "predicate_ilike": ("SELECT c_custkey FROM customer WHERE c_mktsegment ILIKE 'b%'", None),
    "predicate_regex": ("SELECT c_custkey FROM customer WHERE c_name ~ '7$' AND c_mktsegment !~ '^B' AND c_mktsegment ~* 'a'", "SELECT c_custkey FROM customer WHERE regexp_matches(c_name, '7$') AND NOT regexp_matches(c_mktsegment, '^B') AND regexp_matches(c_mktsegment, '(?i)a')"),
    "predicate_similar": ("SELECT c_custkey FROM customer WHERE c_mktsegment SIMILAR TO '(A|B)%'", "SELECT c_custkey FROM customer WHERE c_mktsegment SIMILAR TO '(A|B).*'"),
    "predicate_any_array": ("SELECT n_nationkey FROM nation WHERE n_nationkey = ANY(ARRAY[1, 5, 9])", "SELECT n_nationkey FROM nation WHERE n_nationkey IN (1, 5, 9)"),
    "predicate_row_compare": ("SELECT o_custkey, o_orderkey FROM orders WHERE (o_custkey, o_orderkey) > (140::int8, 5000::int8)", None),
    "case_searched": ("SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band, CASE o_orderstatus WHEN 'F' THEN 1 ELSE 0 END AS f FROM orders", None),
    "cast_matrix": ("SELECT '42'::int8 AS i, 3.7::double precision AS d, 12::text AS t, 'true'::bool AS b, '2024-02-29'::date AS dt", "SELECT '42'::BIGINT AS i, 3.7::DOUBLE AS d, 12::VARCHAR AS t, 'true'::BOOL AS b, '2024-02-29'::DATE AS dt"),
    "subquery_scalar": ("SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.8 FROM orders)", None),
    "subquery_scalar_correlated": ("SELECT c_custkey, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS top FROM customer", None),
    "subquery_scalar_empty": ("SELECT r_regionkey, (SELECT n_name FROM nation WHERE n_nationkey < 0) AS nothing FROM region", None),
    # --- scalar functions
    "function_strings": (
        """SELECT c_custkey, upper(c_name) AS u, lower(c_mktsegment) AS l, length(c_name) AS n, substr(c_name, 3, 4) AS s, left(c_name, 3) AS lf, right(c_name, 3) AS rt,
           replace(c_name, 'C', 'K') AS rp, reverse(c_mktsegment) AS rv, repeat('ab', 2) AS re, lpad(c_mktsegment, 12, '*') AS lp, rpad(c_mktsegment, 3, '*') AS rd,
           strpos(c_name, '#') AS sp, split_part(c_name, '#', 2) AS pt, concat_ws('-', c_mktsegment, NULL, 'x') AS cw, trim('  x ') AS tr FROM customer""",
        None,
    ),
    "function_math": (
        """SELECT o_orderkey, abs(-o_totalprice) AS a, round(o_totalprice, 1) AS r, ceil(o_totalprice) AS c, floor(o_totalprice) AS f,
           round(sqrt(o_totalprice), 6) AS s, power(2.0, 3) AS p, CAST(sign(o_totalprice) AS INT) AS g, greatest(1, o_custkey, 50) AS gr, least(9, o_custkey) AS le,
           round(exp(1.0), 9) AS e, round(ln(o_totalprice), 9) AS ln, round(log10(o_totalprice), 9) AS lg, round(sin(0.5), 9) AS sn, round(atan2(1.0, 2.0), 9) AS at, round(degrees(pi()), 6) AS dg FROM orders""",
        None,
    ),
    "function_conditional": ("SELECT coalesce(NULL, x, 0) AS c, nullif(x, 2) AS n, ifnull(x, -1) AS i FROM (VALUES (1), (2), (NULL)) t(x)", None),
    "function_dates": (
        "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, quarter(o_orderdate) AS q, dayofyear(o_orderdate) AS doy, extract(week FROM o_orderdate) AS w FROM orders",
        "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, quarter(o_orderdate) AS q, dayofyear(o_orderdate) AS doy, week(o_orderdate) AS w FROM orders",
    ),
    "function_date_arithmetic": (
        "SELECT o_orderkey, datediff(o_orderdate, TIMESTAMP_NTZ '1992-01-01 00:00:00') AS days, o_orderdate + INTERVAL '1' MONTH AS later, make_date(2024, 2, 29) AS leap FROM orders",
        "SELECT o_orderkey, date_diff('day', TIMESTAMP '1992-01-01 00:00:00', date_trunc('day', o_orderdate)) AS days, o_orderdate + INTERVAL 1 MONTH AS later, make_date(2024, 2, 29) AS leap FROM orders",
    ),
    "function_json": (
        "SELECT event_id, (props ->> 'k')::int8 AS k, json_array_length('[1,2,3]') AS n FROM events",
        "SELECT event_id, (props ->> '$.k')::BIGINT AS k, json_array_length('[1,2,3]')::INT AS n FROM events",
    ),
    "function_arrays": (
        "SELECT n_nationkey, cardinality(a) AS n, array_position(a, n_nationkey) AS p, array_join(array_append(a, 99), ',') AS ap, array_join(array_remove(a, 2), ',') AS rm FROM (SELECT n_nationkey, array(n_nationkey, 2, n_nationkey + 1) AS a FROM nation)",
        "SELECT n_nationkey, len(a)::INT AS n, list_position(a, n_nationkey)::BIGINT AS p, array_to_string(list_append(a, 99), ',') AS ap, array_to_string(list_filter(a, lambda x: x <> 2), ',') AS rm FROM (SELECT n_nationkey, [n_nationkey, 2, n_nationkey + 1] AS a FROM nation)",
    ),
    "function_patterns": (
        "SELECT o_orderkey, to_char(o_orderdate, 'YYYY-MM-DD HH24:MI:SS') AS t, to_date('2024/02/29', 'YYYY/MM/DD') AS d, date_format(o_orderdate, '%d.%m.%Y') AS m FROM orders",
        "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS t, DATE '2024-02-29' AS d, strftime(o_orderdate, '%d.%m.%Y') AS m FROM orders",
    ),
    "function_extract_fields": (
        "SELECT o_orderkey, EXTRACT(epoch FROM o_orderdate) AS e, EXTRACT(dow FROM o_orderdate) AS w, EXTRACT(isodow FROM o_orderdate) AS i, date_part('century', o_orderdate) AS c FROM orders",
        "SELECT o_orderkey, epoch_us(o_orderdate) / 1e6 AS e, dayofweek(o_orderdate)::INT AS w, isodow(o_orderdate)::INT AS i, ceil(year(o_orderdate) / 100)::INT AS c FROM orders",
    ),
    "function_dialect_strings": (
        "SELECT c_custkey, concat(c_name, NULL, '!') AS c, initcap(c_mktsegment) AS i, trunc(c_acctbal) AS t, trunc(c_acctbal, 1) AS t1 FROM customer",
        "SELECT c_custkey, concat(c_name, NULL, '!') AS c, upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) AS i, trunc(c_acctbal) AS t, sign(c_acctbal) * floor(abs(c_acctbal) * 10) / 10 AS t1 FROM customer",
    ),
    "function_ts_rank": (
        "SELECT doc_id, round(ts_rank(to_tsvector(text), to_tsquery('the en')), 6) AS score FROM documents",
        "SELECT doc_id, round(ln(4.0 / 3) * 2.2 * (a / (a + 1.2) + b / (b + 1.2)), 6) AS score FROM (SELECT doc_id, len(list_filter(t, lambda x: x = 'the')) AS a, len(list_filter(t, lambda x: x = 'en')) AS b FROM (SELECT doc_id, list_filter(regexp_extract_all(" + JOINED.format("text") + ", '[\\p{L}\\p{M}\\p{N}_]+'), lambda w: regexp_matches(w, '[\\p{L}\\p{N}]')) AS t FROM documents))",
    ),
    "function_text_search": (
        "SELECT doc_id FROM documents WHERE to_tsvector(text) @@ plainto_tsquery('the en')",
        "SELECT doc_id FROM documents WHERE list_has_any(list_filter(regexp_extract_all(" + JOINED.format("text") + ", '[\\p{L}\\p{M}\\p{N}_]+'), lambda w: regexp_matches(w, '[\\p{L}\\p{N}]')), ['the', 'en'])",
    ),
    # --- the dialect's own rules, in PostgreSQL's words
    "division_of_integers": ("SELECT o_orderkey, o_custkey / 7 AS q, o_custkey / 2 / 3 AS two, -o_custkey / 4 AS neg, o_totalprice / 2 AS half FROM orders WHERE o_custkey / 10 > 3", "SELECT o_orderkey, o_custkey // 7 AS q, o_custkey // 2 // 3 AS two, -o_custkey // 4 AS neg, o_totalprice / 2 AS half FROM orders WHERE o_custkey // 10 > 3"),
    "division_in_aggregates": ("SELECT o_custkey / 100 AS g, sum(o_orderkey) / count(*) AS mean FROM orders GROUP BY o_custkey / 100", "SELECT o_custkey // 100 AS g, (sum(o_orderkey) // count(*))::BIGINT AS mean FROM orders GROUP BY 1"),
    "aggregate_ordered_text": ("SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name DESC) AS names FROM nation GROUP BY n_regionkey", None),
    "aggregate_ordered_array": ("SELECT n_regionkey, array_agg(n_nationkey ORDER BY n_name DESC, n_nationkey) AS ks FROM nation GROUP BY n_regionkey", None),
    "aggregate_ordered_nulls": ("SELECT k, array_agg(x ORDER BY y, x) AS a FROM (VALUES (1, 'a', 2), (1, 'b', NULL), (1, NULL, 1), (2, NULL, 1), (1, 'c', 1)) t(k, x, y) GROUP BY k", "SELECT k, coalesce(list(x ORDER BY y NULLS FIRST, x) FILTER (x IS NOT NULL), []) AS a FROM (VALUES (1, 'a', 2), (1, 'b', NULL), (1, NULL, 1), (2, NULL, 1), (1, 'c', 1)) t(k, x, y) GROUP BY k"),
    "aggregate_json": ("SELECT n_regionkey, json_agg(n_nationkey ORDER BY n_nationkey DESC) AS ks FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, to_json(list(n_nationkey ORDER BY n_nationkey DESC))::VARCHAR AS ks FROM nation GROUP BY n_regionkey"),
    "distinct_on_expression": ("SELECT DISTINCT ON (o_custkey % 10, o_orderstatus) o_custkey % 10 AS g, o_orderstatus, o_orderkey FROM orders ORDER BY o_custkey % 10, o_orderstatus, o_totalprice DESC, o_orderkey", None),
    "distinct_on_limited": ("SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey LIMIT 7 OFFSET 2", None),
    "distinct_on_nested": ("WITH d AS (SELECT DISTINCT ON (o_custkey) o_custkey AS k, o_totalprice AS p FROM orders ORDER BY o_custkey, o_totalprice DESC) SELECT c_custkey, x.p FROM customer JOIN (SELECT k, p FROM d WHERE p > 1000) x ON c_custkey = x.k", None),
    "recursive_union": ("WITH RECURSIVE e(a, b) AS (VALUES (1, 2), (2, 3), (3, 1), (3, 4), (9, 9)), r(n) AS (SELECT 1 UNION SELECT e.b FROM r JOIN e ON e.a = r.n) SELECT n FROM r", None),
    "recursive_union_all_dedups": ("WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n % 5 + 1 FROM r) SELECT count(*) AS c, max(n) AS top FROM r", "SELECT 5::BIGINT AS c, 5 AS top"),
    "recursive_tree": ("WITH RECURSIVE tree(k, path) AS (SELECT r_regionkey, r_name::text FROM region WHERE r_regionkey < 2 UNION SELECT n_nationkey + 100, path || '>' || n_name FROM nation JOIN tree ON n_regionkey = k) SELECT k, path FROM tree", "SELECT r_regionkey AS k, r_name AS path FROM region WHERE r_regionkey < 2 UNION ALL SELECT n_nationkey + 100, r_name || '>' || n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey < 2"),
    "unnest_from": ("SELECT x FROM unnest(ARRAY[3, 1, 2]) AS x", "SELECT unnest([3, 1, 2]) AS x"),
    "unnest_lateral": ("SELECT n_nationkey, u.x FROM nation, unnest(ARRAY[n_nationkey, n_regionkey]) AS u(x)", "SELECT n_nationkey, unnest([n_nationkey, n_regionkey]) AS x FROM nation"),
    "unnest_selected": ("SELECT n_nationkey, unnest(ARRAY[n_regionkey, 7]) AS x FROM nation", "SELECT n_nationkey, unnest([n_regionkey, 7]) AS x FROM nation"),
    "series_lateral": ("SELECT r_regionkey, g FROM region, generate_series(1, r_regionkey) AS g", "SELECT r_regionkey, unnest(range(1, r_regionkey + 1)) AS g FROM region"),
    "quantified_arrays": ("SELECT n_nationkey FROM nation WHERE n_nationkey <> ALL(ARRAY[1, 5, 9]) AND n_regionkey >= ANY(ARRAY[2, 4])", "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (1, 5, 9) AND n_regionkey >= 2"),
    "quantified_queries": ("SELECT n_nationkey FROM nation WHERE n_regionkey = ANY(SELECT r_regionkey FROM region WHERE r_regionkey > 2) AND n_nationkey > ALL(SELECT r_regionkey FROM region)", None),
    "window_default_frame": ("SELECT o_orderkey, sum(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey) AS total, count(*) OVER w AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)", None),
    "window_ties_count_rows": ("SELECT v, n, sum(v) OVER (ORDER BY v) AS total FROM (VALUES (10, 1), (20, 2), (30, 3)) t(v, n)", "SELECT v, n, sum(v) OVER (ORDER BY v ROWS UNBOUNDED PRECEDING) AS total FROM (VALUES (10, 1), (20, 2), (30, 3)) t(v, n)"),
    "window_ties_peers": ("SELECT max(total) AS top, min(total) AS low, count(DISTINCT total) AS kinds FROM (SELECT sum(v) OVER (ORDER BY k) AS total FROM (VALUES (1, 10), (1, 10), (1, 10)) t(k, v)) s", "SELECT 30::HUGEINT AS top, 10::HUGEINT AS low, 3::BIGINT AS kinds"),
    "window_named_and_inherited": ("SELECT o_orderkey, count(*) OVER (w ORDER BY o_orderkey) AS n, first_value(o_orderkey) OVER v AS f FROM orders WINDOW w AS (PARTITION BY o_custkey), v AS (w ORDER BY o_orderkey DESC)", None),
    "window_filtered": ("SELECT o_orderkey, count(*) FILTER (WHERE o_orderstatus = 'F') OVER (PARTITION BY o_custkey) AS f FROM orders", None),
    "math_keeps_types": ("SELECT o_orderkey, ceil(o_totalprice) AS c, floor(-o_totalprice) AS f, ceiling(o_custkey) AS i, sqrt(o_totalprice) AS s, ln(o_totalprice) AS l, log10(o_totalprice) AS g FROM orders", "SELECT o_orderkey, ceil(o_totalprice) AS c, floor(-o_totalprice) AS f, o_custkey AS i, sqrt(o_totalprice) AS s, ln(o_totalprice) AS l, log10(o_totalprice) AS g FROM orders"),
    "text_parts": ("SELECT c_custkey, substr(c_name, -1, 3) AS a, substring(c_name, 0, 2) AS b, substr(c_name, 4) AS c, substring(c_name FROM 2 FOR 3) AS d FROM customer", "SELECT c_custkey, substr(c_name, 1, 3) AS a, substr(c_name, 1, 2) AS b, substr(c_name, 4) AS c, substr(c_name, 2, 3) AS d FROM customer"),
    "similar_classes": ("SELECT c_custkey, c_mktsegment SIMILAR TO '[^A-M]%' AS a, 'x%' SIMILAR TO 'x[%_]' AS b, c_name SIMILAR TO '%!#%' ESCAPE '!' AS c FROM customer", "SELECT c_custkey, regexp_full_match(c_mktsegment, '[^A-M].*') AS a, true AS b, regexp_full_match(c_name, '.*#.*') AS c FROM customer"),
    "date_truncated": ("SELECT o_orderkey, date_trunc('decade', o_orderdate) AS d, date_trunc('century', o_orderdate) AS c, date_trunc('month', o_orderdate) AS m, date_trunc('year', o_orderdate::date) AS y, date_trunc('week', o_orderdate) AS w FROM orders", "SELECT o_orderkey, make_timestamp(year(o_orderdate) // 10 * 10, 1, 1, 0, 0, 0) AS d, make_timestamp((year(o_orderdate) - 1) // 100 * 100 + 1, 1, 1, 0, 0, 0) AS c, date_trunc('month', o_orderdate)::TIMESTAMP AS m, date_trunc('year', o_orderdate)::DATE AS y, date_trunc('week', o_orderdate)::TIMESTAMP AS w FROM orders"),
    "date_words": ("SELECT o_orderkey, date_add(o_orderdate, INTERVAL 3 DAY) AS a, date_sub(o_orderdate, INTERVAL 2 MONTH) AS b, unix_timestamp(o_orderdate) AS u, from_unixtime(86400) AS f, timestampdiff(DAY, TIMESTAMP '1992-01-01 00:00:00', o_orderdate) AS n FROM orders", "SELECT o_orderkey, o_orderdate + INTERVAL 3 DAY AS a, o_orderdate - INTERVAL 2 MONTH AS b, epoch(o_orderdate)::BIGINT AS u, TIMESTAMP '1970-01-02 00:00:00' AS f, date_sub('day', TIMESTAMP '1992-01-01 00:00:00', o_orderdate) AS n FROM orders"),
    "age_of_dates": ("SELECT o_orderkey, age(o_orderdate, TIMESTAMP '1992-01-01 00:00:00') = o_orderdate - TIMESTAMP '1992-01-01 00:00:00' AS same, age(o_orderdate, TIMESTAMP '1990-01-01 00:00:00') > INTERVAL '365' DAY AS more FROM orders", "SELECT o_orderkey, true AS same, o_orderdate - TIMESTAMP '1990-01-01 00:00:00' > INTERVAL 365 DAY AS more FROM orders"),
    "json_steps": ("""SELECT event_id, props -> 'k' AS a, ('{"l":[1,' || (props ->> 'k') || ',{"d":"e"}]}') -> 'l' ->> -2 AS b, ('{"l":[1,' || (props ->> 'k') || ',{"d":"e"}]}') #>> '{l,2,d}' AS c, ('[' || props || ']') -> 0 ->> 'k' AS d FROM events""", "SELECT event_id, json_extract(props, '$.k')::VARCHAR AS a, props ->> '$.k' AS b, 'e' AS c, props ->> '$.k' AS d FROM events"),
    "json_tests": ("""SELECT event_id, props @> '{"k":7}' AS a, props ? 'k' AS b, props ?| ARRAY['z', 'k'] AS c, props ?& ARRAY['z', 'k'] AS d, props IS JSON AS e, event_type IS JSON AS f, props IS NOT JSON ARRAY AS g FROM events""", "SELECT event_id, (props ->> '$.k')::BIGINT = 7 AS a, true AS b, true AS c, false AS d, true AS e, false AS f, true AS g FROM events"),
    "json_made": ("""SELECT event_id, jsonb_build_object('id', event_id, 'in', jsonb_build_array(1, 'x', NULL), 'p', props::jsonb) AS o, jsonb_set(props, '{k}', '0') AS s, jsonb_concat(props, '{"z":1}') AS c, jsonb_delete(props, 'k') AS d, jsonb_typeof(props) AS t, jsonb_strip_nulls('{"a":null,"b":[{"c":null}]}') AS n FROM events""",
        """SELECT event_id, '{"id":' || event_id || ',"in":[1,"x",null],"p":{"k":' || (props ->> '$.k') || '}}' AS o, '{"k":0}' AS s, '{"k":' || (props ->> '$.k') || ',"z":1}' AS c, '{}' AS d, 'object' AS t, '{"b":[{}]}' AS n FROM events"""),
    "json_paths": ("""SELECT event_id, jsonb_path_query_first(props, '$.k') AS a, jsonb_path_exists(props, '$.z') AS b, jsonb_path_match(props, '$.k > 50') AS c, jsonb_extract_path_text(props, 'k') AS d, jsonb_path_query_array('{"l":[1,5,9]}', '$.l[*] ? (@ > 4)') AS f FROM events""", "SELECT event_id, props ->> '$.k' AS a, false AS b, (props ->> '$.k')::BIGINT > 50 AS c, props ->> '$.k' AS d, '[5,9]' AS f FROM events"),
    "json_rows": ("SELECT e.event_id, x.key, x.value FROM events e, jsonb_each_text(e.props) AS x", "SELECT event_id, 'k' AS key, props ->> '$.k' AS value FROM events"),
    "json_elements": ("""SELECT r_regionkey, v FROM region, jsonb_array_elements('[1,"x",{"a":[2]}]') AS v""", """SELECT r_regionkey, unnest(['1', '"x"', '{"a":[2]}']) AS v FROM region"""),
    "arrays_keep_types": ("SELECT n_nationkey, array_cat(ARRAY[n_nationkey], ARRAY[1, 2]) AS c, array_append(ARRAY[n_regionkey], 9) AS a, array_prepend(0, ARRAY[n_regionkey]) AS p, (ARRAY[n_nationkey, 5])[2] AS s, (ARRAY[n_nationkey])[3] AS none FROM nation", "SELECT n_nationkey, list_concat([n_nationkey], [1, 2]) AS c, [n_regionkey, 9] AS a, [0, n_regionkey] AS p, 5 AS s, NULL::INT AS none FROM nation"),
    "vector_words": ("SELECT vec_id, round(cosine_similarity(embedding, embedding), 6) AS one, round(predict('mean', embedding), 5) AS mean, round(predict('max', embedding), 6) AS top, euclidean_distance(embedding, embedding) AS zero FROM embeddings", "SELECT vec_id, 1.0::DOUBLE AS one, round(list_avg(embedding::DOUBLE[]), 5) AS mean, round(list_max(embedding)::DOUBLE, 6) AS top, 0.0::DOUBLE AS zero FROM embeddings"),
    "system_tables": ("SELECT table_name FROM information_schema.tables WHERE table_name IN ('nation', 'region') AND (SELECT count(*) FROM nation, region) > 0", "SELECT unnest(['nation', 'region']) AS table_name"),
    "system_columns": ("SELECT column_name, ordinal_position FROM information_schema.columns WHERE table_name = 'nation' AND (SELECT count(*) FROM nation) > 0", "SELECT unnest(['n_nationkey', 'n_name', 'n_regionkey']) AS column_name, unnest([1, 2, 3]) AS ordinal_position"),
    "trailing_comma": ("SELECT r_regionkey, r_name, FROM region", "SELECT r_regionkey, r_name FROM region"),
    "text_search_words": ("SELECT w FROM unnest(to_tsvector('english', 'Don''t pay 3.14, or 1,000 a_b e.g. x:y it''s.')) AS w", "SELECT unnest(['don''t', 'pay', '3.14', 'or', '1,000', 'a_b', 'e.g', 'x:y', 'it''s']) AS w"),
}
