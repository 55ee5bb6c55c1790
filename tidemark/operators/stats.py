"""Group comparison and small relational helpers: effect sizes, Kruskal-Wallis, FDR, rankings and the trial store."""

from tidemark.plans.portable import step

step("feature_rows", "SELECT subject, label, j, avg(v) AS v FROM {cells3} GROUP BY subject, label, j", public=False)
step("hedges_g", """
SELECT j, round((ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)) * (1 - 3.0 / (4 * (na + nb) - 9)) + 1e-9, 6) AS g FROM (
  SELECT j, avg(CASE WHEN label = 0 THEN v END) AS ma, avg(CASE WHEN label = 1 THEN v END) AS mb, var_samp(CASE WHEN label = 0 THEN v END) AS va, var_samp(CASE WHEN label = 1 THEN v END) AS vb,
         sum(CASE WHEN label = 0 THEN 1 ELSE 0 END) AS na, sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS nb FROM {feature_rows} GROUP BY j)""")
step("ranked", "SELECT j, label, rank() OVER (PARTITION BY j ORDER BY v) + (count(*) OVER (PARTITION BY j, v) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY j, v) AS ties, count(*) OVER (PARTITION BY j) AS n FROM {feature_rows}", public=False)
step("kruskal_h", """
SELECT g.j, (12.0 / (max(g.n) * (max(g.n) + 1)) * sum(g.s * g.s / g.c) - 3 * (max(g.n) + 1)) / max(t.fix) AS h FROM (SELECT j, label, sum(r) AS s, count(*) AS c, max(n) AS n FROM {ranked} GROUP BY j, label) g
JOIN (SELECT j, 1 - sum(ties * ties - 1.0) / (1.0 * max(n) * max(n) * max(n) - max(n)) AS fix FROM {ranked} GROUP BY j) t ON g.j = t.j GROUP BY g.j""", public=False, duckdb="""
WITH r AS (SELECT a.j, a.label, a.subject, sum(CASE WHEN b.v < a.v THEN 1 WHEN b.v = a.v THEN 0.5 ELSE 0 END) + 0.5 AS r FROM {feature_rows} a JOIN {feature_rows} b ON a.j = b.j GROUP BY a.j, a.label, a.subject),
     m AS (SELECT j, label, avg(r) AS own, count(*) AS c FROM r GROUP BY j, label), n AS (SELECT j, avg(r) AS every, count(*) AS c, var_pop(r) * count(*) AS spread FROM r GROUP BY j)
SELECT n.j, (max(n.c) - 1) * sum(m.c * power(m.own - n.every, 2)) / max(n.spread) AS h FROM m JOIN n ON m.j = n.j GROUP BY n.j""")
step("kruskal", "SELECT j, round(h + 1e-9, 6) AS h, round(exp(-h / 2) + 1e-9, 6) AS p FROM {kruskal_h}")
step("fdr", """
SELECT j, p, least(1.0, min(p * m / rn) OVER (ORDER BY rn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS q
FROM (SELECT j, exp(-h / 2) AS p, row_number() OVER (ORDER BY h DESC, j) AS rn, count(*) OVER () AS m FROM {kruskal_h})""", public=False, duckdb="""
SELECT a.j, a.p, least(1.0, min(b.p * b.m / b.upto)) AS q FROM (SELECT j, exp(-h / 2) AS p FROM {kruskal_h}) a
JOIN (SELECT x.j, exp(-x.h / 2) AS p, count(*) AS upto, (SELECT count(*) FROM {kruskal_h}) AS m FROM {kruskal_h} x JOIN {kruskal_h} y ON y.h >= x.h GROUP BY x.j, x.h) b ON b.p >= a.p GROUP BY a.j, a.p""")
step("bh_fdr", "SELECT j, round(p + 1e-9, 6) AS p, round(q + 1e-9, 6) AS q FROM {fdr}")
step("fdr_count", "SELECT count(*) AS n FROM {fdr} WHERE q < 0.05")
step("sort_by_p", "SELECT j, rn FROM (SELECT j, row_number() OVER (ORDER BY p, j) AS rn FROM {fdr}) WHERE rn <= 15")
step("feature_names", "SELECT DISTINCT concat(CASE WHEN j % 2 = 0 THEN 'rbp' ELSE 'conn' END, '__m', CAST(CAST(floor(j / 16) AS bigint) AS string), '__b', CAST(j % 4 AS string), '__R', CAST(j AS string)) AS name, j FROM {cells}", public=False)
step("feature_select", "SELECT name, j FROM {feature_names} WHERE substring(name, 1, 5) = 'rbp__'")
step("feature_groups", "SELECT grp, count(*) AS n FROM (SELECT concat('measure=', split_part(name, '__', 2), '|band=', split_part(name, '__', 3)) AS grp FROM {feature_names} UNION ALL SELECT concat('family=', split_part(name, '__', 1)) AS grp FROM {feature_names}) GROUP BY grp")
step("params_histogram", "SELECT k, count(*) AS n FROM (SELECT DISTINCT user_id, k FROM {props}) GROUP BY k")
step("small_share", "SELECT user_id, round(avg(CASE WHEN k <= 2 THEN 1e0 ELSE 0e0 END) + 1e-9, 6) AS share FROM {props} GROUP BY user_id")
step("config_hash", "SELECT event_id, substring(md5(concat(CAST(k AS string), '|', event_type)), 1, 10) AS key FROM {props}")
step("best_trial", "SELECT o_orderkey AS trial, round(o_totalprice, 4) AS value FROM {orders} WHERE o_orderstatus = 'F' ORDER BY o_totalprice, o_orderkey LIMIT 1")
step("top_trials", "SELECT o_orderkey AS trial, round(o_totalprice, 4) AS value FROM {orders} WHERE o_orderstatus = 'F' ORDER BY o_totalprice, o_orderkey LIMIT 10")
step("distinct_params", "SELECT DISTINCT p_brand AS param, p_size AS value FROM {part}")
step("trial_params", """
SELECT o.o_orderkey AS trial, l.l_linenumber AS param, round(l.l_quantity, 4) AS value FROM (SELECT o_orderkey FROM {orders} WHERE o_orderstatus = 'F' ORDER BY o_totalprice, o_orderkey LIMIT 10) o JOIN {lineitem} l ON l.l_orderkey = o.o_orderkey""")
step("demographics", "SELECT c_custkey AS subject, round(c_acctbal, 4) AS age, CASE WHEN c_mktsegment = 'BUILDING' THEN 1e0 ELSE 0e0 END AS sex_m, n_name AS site FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey")
step("tumbling_events", "SELECT event_type, count(*) AS n, round(sum(value) + 1e-9, 4) AS total FROM {props} GROUP BY event_type")
