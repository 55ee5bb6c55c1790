"""The protocol round an evaluation: nested selection inside the training subjects, tasks, bags, samples, checks and reports.

A candidate is the nearest-centroid model with one sharpness of its softmax; sharpness 0 is the dummy that knows no features. It is
chosen on inner folds of the training subjects alone, by subject-level balanced accuracy, then macro AUC, then its number.
"""

import re

from tidemark.plans.portable import step

step("candidates", "SELECT 0 AS candidate, 0e0 AS sharp UNION ALL SELECT 1, 0.05e0 UNION ALL SELECT 2, 0.2e0 UNION ALL SELECT 3, 1e0", public=False)
step("inner_folds", """
SELECT repeat, fold, subject, label, (row_number() OVER (PARTITION BY repeat, fold, label ORDER BY md5(concat(CAST(subject AS string), '#', CAST(49 + 1000 * repeat AS string))), subject) - 1) % 4 AS part
FROM (SELECT r.repeat, r.fold, r.subject, s.label FROM {roles} r JOIN {subjects} s ON s.subject = r.subject WHERE r.role = 'train')""", public=False)
step("inner_sums", """
SELECT f.repeat, f.fold, f.part, f.label, s.j, sum(s.s) AS s, sum(s.n) AS n FROM {subject_sums} s JOIN {inner_folds} f ON f.subject = s.subject GROUP BY f.repeat, f.fold, f.part, f.label, s.j""", public=False)
step("inner_centroids", """
SELECT repeat, fold, part, label, j, (sum(s) OVER (PARTITION BY repeat, fold, label, j) - s) / nullif(sum(n) OVER (PARTITION BY repeat, fold, label, j) - n, 0) AS m FROM {inner_sums}""", public=False)
step("inner_distances", """
SELECT f.repeat, f.fold, c.subject, c.label AS y, c.epoch, m.label AS k, sum(power(c.v - m.m, 2)) AS d
FROM {cells3} c JOIN {inner_folds} f ON c.subject = f.subject JOIN {inner_centroids} m ON m.repeat = f.repeat AND m.fold = f.fold AND m.part = f.part AND m.j = c.j
GROUP BY f.repeat, f.fold, c.subject, c.label, c.epoch, m.label""", public=False)
step("inner_proba", """
SELECT repeat, fold, candidate, subject, y, k, round(exp(g - hi) / sum(exp(g - hi)) OVER (PARTITION BY repeat, fold, candidate, subject), 9) AS p FROM (
  SELECT *, max(g) OVER (PARTITION BY repeat, fold, candidate, subject) AS hi FROM (
    SELECT repeat, fold, candidate, subject, y, k, avg(ln(greatest(least(p, 1), 1e-7))) AS g FROM (
      SELECT d.repeat, d.fold, c.candidate, d.subject, d.y, d.k, exp(c.sharp * (lo - d)) / sum(exp(c.sharp * (lo - d))) OVER (PARTITION BY d.repeat, d.fold, c.candidate, d.epoch) AS p
      FROM (SELECT *, min(d) OVER (PARTITION BY repeat, fold, epoch) AS lo FROM {inner_distances}) d JOIN {candidates} c ON c.candidate >= 0) GROUP BY repeat, fold, candidate, subject, y, k))""", public=False)
step("inner_classes", """
SELECT repeat, fold, candidate, k, sum(CASE WHEN y = k AND best = 1 THEN 1e0 ELSE 0e0 END) / sum(CASE WHEN y = k THEN 1 ELSE 0 END) AS recall,
       (sum(CASE WHEN y = k THEN r ELSE 0 END) - sum(CASE WHEN y = k THEN 1 ELSE 0 END) * (sum(CASE WHEN y = k THEN 1 ELSE 0 END) + 1) / 2e0) / nullif(sum(CASE WHEN y = k THEN 1 ELSE 0 END) * sum(CASE WHEN y <> k THEN 1 ELSE 0 END), 0) AS auc
FROM (SELECT *, row_number() OVER (PARTITION BY repeat, fold, candidate, subject ORDER BY p DESC, k) AS best,
             rank() OVER (PARTITION BY repeat, fold, candidate, k ORDER BY p) + (count(*) OVER (PARTITION BY repeat, fold, candidate, k, p) - 1) / 2e0 AS r FROM {inner_proba}) GROUP BY repeat, fold, candidate, k""", public=False)
step("inner_scores", "SELECT repeat, CAST(fold AS bigint) AS fold, candidate, round(avg(recall), 6) AS balanced_accuracy, round(avg(auc), 6) AS macro_auc FROM {inner_classes} GROUP BY repeat, fold, candidate")
step("select_best", """
SELECT repeat, fold, candidate, balanced_accuracy, macro_auc FROM (SELECT *, row_number() OVER (PARTITION BY repeat, fold ORDER BY balanced_accuracy DESC, macro_auc DESC, candidate) AS rn FROM {inner_scores}) WHERE rn = 1""")
step("nested_subjects", """
SELECT repeat, fold, candidate, subject, y, k, exp(g - hi) / sum(exp(g - hi)) OVER (PARTITION BY repeat, subject) AS p FROM (SELECT *, max(g) OVER (PARTITION BY repeat, subject) AS hi FROM (
  SELECT repeat, fold, candidate, subject, y, k, avg(ln(greatest(least(p, 1), 1e-7))) AS g FROM (
    SELECT d.repeat, d.fold, w.candidate, d.subject, d.y, d.k, exp(c.sharp * (lo - d)) / sum(exp(c.sharp * (lo - d))) OVER (PARTITION BY d.repeat, d.epoch) AS p
    FROM (SELECT *, min(d) OVER (PARTITION BY repeat, epoch) AS lo FROM {distances}) d JOIN {select_best} w ON w.repeat = d.repeat AND w.fold = d.fold JOIN {candidates} c ON c.candidate = w.candidate)
  GROUP BY repeat, fold, candidate, subject, y, k))""", public=False)
step("nested_predictions", "SELECT repeat, CAST(fold AS bigint) AS fold, candidate, subject, y, k, round(p, 6) AS p FROM {nested_subjects}")
step("nested_score", """
SELECT repeat, round(avg(recall), 6) AS balanced_accuracy FROM (SELECT repeat, y, avg(CASE WHEN y = k THEN 1e0 ELSE 0e0 END) AS recall FROM (
  SELECT *, row_number() OVER (PARTITION BY repeat, subject ORDER BY round(p, 9) DESC, k) AS rn FROM {nested_subjects}) WHERE rn = 1 GROUP BY repeat, y) GROUP BY repeat""")
# inner folds part the training subjects: neither a subject outside them nor one left out
step("partition_check", """
SELECT count(*) AS n_wrong FROM ((SELECT repeat, fold, subject FROM {inner_folds} EXCEPT SELECT repeat, fold, subject FROM {roles} WHERE role = 'train')
UNION ALL (SELECT repeat, fold, subject FROM {roles} WHERE role = 'train' EXCEPT SELECT repeat, fold, subject FROM {inner_folds})
UNION ALL (SELECT repeat, fold, subject FROM {inner_folds} GROUP BY repeat, fold, subject HAVING count(*) > 1))""")
step("bag_splits", """
SELECT repeat, CAST(fold AS bigint) AS fold, subject, (row_number() OVER (PARTITION BY repeat, fold, label ORDER BY md5(concat(CAST(subject AS string), '#', CAST(1033 + 1000 * repeat AS string))), subject) - 1) % 5 AS bag FROM {inner_folds}""")
step("tasks", """
SELECT 'cv3' AS task, 'cv' AS protocol, 0 AS label, 0 AS y UNION ALL SELECT 'cv3', 'cv', 1, 1 UNION ALL SELECT 'cv3', 'cv', 2, 2 UNION ALL
SELECT 'loso3', 'loso', 0, 0 UNION ALL SELECT 'loso3', 'loso', 1, 1 UNION ALL SELECT 'loso3', 'loso', 2, 2 UNION ALL
SELECT 'legacy', 'fixed', 0, 0 UNION ALL SELECT 'legacy', 'fixed', 1, 1 UNION ALL SELECT 'legacy', 'fixed', 2, 2 UNION ALL
SELECT 'loso_ad_cn', 'loso', 1, 0 UNION ALL SELECT 'loso_ad_cn', 'loso', 0, 1 UNION ALL SELECT 'loso_ftd_cn', 'loso', 1, 0 UNION ALL SELECT 'loso_ftd_cn', 'loso', 2, 1 UNION ALL
SELECT 'cv_ad_cn', 'cv', 1, 0 UNION ALL SELECT 'cv_ad_cn', 'cv', 0, 1 UNION ALL SELECT 'cv_ftd_cn', 'cv', 1, 0 UNION ALL SELECT 'cv_ftd_cn', 'cv', 2, 1 UNION ALL
SELECT 'cv_ad_ftd', 'cv', 2, 0 UNION ALL SELECT 'cv_ad_ftd', 'cv', 0, 1""", public=False)
step("task_subjects", "SELECT t.task, t.protocol, s.subject, t.y FROM {subjects} s JOIN {tasks} t ON t.label = s.label")
step("task_epochs", "SELECT t.task, e.subject, e.epoch, t.y FROM {epochs} e JOIN {task_subjects} t ON t.subject = e.subject")
step("first_label", """
SELECT subject, CASE WHEN min(label) = max(label) THEN min(label) ELSE CAST(raise_error('a subject has several labels') AS bigint) END AS label FROM {epochs} GROUP BY subject""")
step("sample_80_20", """
SELECT subject, CASE WHEN rn <= round(0.8 * n) THEN 'train' ELSE 'test' END AS role
FROM (SELECT subject, row_number() OVER (ORDER BY md5(concat(CAST(subject AS string), '#42')), subject) AS rn, count(*) OVER () AS n FROM {subjects})""")
# with replacement, 32 draws for each subject: classes in turn, then a subject of the class and an epoch of that alike likely, which are the
# balanced weights without a range join. A pick is the first 32 bits of an md5, modulo what there is to pick from.
_WEIGHTED = """
SELECT d.draw, s.subject, e.epoch FROM (SELECT q.draw, c.label, 1 + BITS[concat('s', CAST(q.draw AS string))] % c.n AS pick, BITS[concat('e', CAST(q.draw AS string))] AS h
  FROM (SELECT t.subject * 32 + r.b AS draw, 1 + (t.subject * 32 + r.b) % k.n AS class FROM {subjects} t JOIN {numbers} r ON r.b < 32 JOIN (SELECT count(DISTINCT label) AS n FROM {subjects}) k ON k.n > 0) q
  JOIN (SELECT label, n, row_number() OVER (ORDER BY label) AS class FROM (SELECT label, count(*) AS n FROM {subjects} GROUP BY label)) c ON c.class = q.class) d
JOIN {ranked_subjects} s ON s.label = d.label AND s.rn = d.pick
JOIN (SELECT subject, epoch, row_number() OVER (PARTITION BY subject ORDER BY epoch) AS rn, count(*) OVER (PARTITION BY subject) AS n FROM {epochs3}) e ON e.subject = s.subject AND e.rn = 1 + d.h % e.n"""
step("weighted_sample", re.sub(r"BITS\[(.*?\))\]", r"CAST(conv(substring(md5(\1), 1, 8), 16, 10) AS bigint)", _WEIGHTED), duckdb=re.sub(r"BITS\[(.*?\))\]", r"CAST(concat('0x', substring(md5(\1), 1, 8)) AS bigint)", _WEIGHTED))
step("train_medians", """
SELECT r.repeat, CAST(r.fold AS bigint) AS fold, CAST(c.j AS bigint) AS j, round(percentile(c.v, 0.5), 9) AS median FROM {cells3} c JOIN {roles} r ON r.subject = c.subject WHERE r.role = 'train' GROUP BY r.repeat, r.fold, c.j""", public=False)
step("common_repeats", "SELECT v.repeat, count(*) AS n FROM {verdicts} v JOIN (SELECT DISTINCT repeat FROM {verdicts} INTERSECT SELECT DISTINCT repeat FROM {prior_verdicts} WHERE repeat > 0) r ON r.repeat = v.repeat GROUP BY v.repeat")
step("paired_wins", """
SELECT CAST(sum(CASE WHEN d > 1e-12 THEN 1 ELSE 0 END) AS bigint) AS wins, CAST(sum(CASE WHEN abs(d) <= 1e-12 THEN 1 ELSE 0 END) AS bigint) AS ties, count(*) AS n, round(avg(d), 6) AS delta,
       CASE WHEN max(v.lo) > 0 THEN 'better' WHEN max(v.hi) < 0 THEN 'worse' ELSE 'not distinguishable' END AS verdict
FROM (SELECT repeat, avg(ra) - avg(rb) AS d FROM (SELECT a.repeat, a.y, avg(CASE WHEN a.pred_a = a.y THEN 1e0 ELSE 0e0 END) AS ra, avg(CASE WHEN a.pred_b = a.y THEN 1e0 ELSE 0e0 END) AS rb
      FROM {paired_verdicts} a GROUP BY a.repeat, a.y) GROUP BY repeat) JOIN {paired_diff} v ON v.p_not_better >= 0""")
# format_number rounds the number itself, half to even (56.25: 56.2); Spark's printf rounds its shortest decimals half up (56.3)
step("report_rows", """
SELECT 'centroid' AS model, concat(format_number(100 * m.mean, '0.0'), ' ± ', format_number(100 * m.sd, '0.0'), ' [', format_number(100 * c.lo, '0.0'), ', ', format_number(100 * c.hi, '0.0'), ']') AS balanced_accuracy
FROM {mean_sd} m JOIN {bootstrap_ci} c ON c.hi >= c.lo""", duckdb="""
SELECT 'centroid' AS model, printf('%.1f ± %.1f [%.1f, %.1f]', 100 * m.mean, 100 * m.sd, 100 * c.lo, 100 * c.hi) AS balanced_accuracy FROM {mean_sd} m JOIN {bootstrap_ci} c ON c.hi >= c.lo""")
step("sorted_results", "SELECT repeat, balanced_accuracy, CAST(row_number() OVER (ORDER BY balanced_accuracy DESC, repeat) AS bigint) AS place FROM {per_repeat}")
step("roc_points", """
SELECT repeat, k, p, sum(tp) OVER (PARTITION BY repeat, k ORDER BY p DESC) / sum(tp) OVER (PARTITION BY repeat, k) AS tpr, sum(fp) OVER (PARTITION BY repeat, k ORDER BY p DESC) / sum(fp) OVER (PARTITION BY repeat, k) AS fpr
FROM (SELECT repeat, k, round(p, 9) AS p, sum(CASE WHEN y = k THEN 1e0 ELSE 0e0 END) AS tp, sum(CASE WHEN y <> k THEN 1e0 ELSE 0e0 END) AS fp FROM {subject_proba} GROUP BY repeat, k, round(p, 9))""", public=False)
# the curve over a grid: linear between the last point at or before a place and the first one after it
step("mean_roc", """
SELECT k, g, round(avg(CASE WHEN x1 > x0 THEN y0 + (y1 - y0) * (g / 100e0 - x0) / (x1 - x0) ELSE y0 END), 6) AS tpr FROM (
  SELECT repeat, k, g, max(CASE WHEN fpr <= g / 100e0 THEN fpr ELSE 0 END) AS x0, max(CASE WHEN fpr <= g / 100e0 THEN tpr ELSE 0 END) AS y0,
         min(CASE WHEN fpr > g / 100e0 THEN fpr ELSE 1 END) AS x1, min(CASE WHEN fpr > g / 100e0 THEN tpr ELSE 1 END) AS y1
  FROM {roc_points} r JOIN (SELECT b AS g FROM {numbers}) n ON n.g >= 0 GROUP BY repeat, k, g) GROUP BY k, g""")
