"""Leak-free evaluation by subject: splits, weights, the nearest-centroid model, aggregation, metrics and resampling.

Randomness is an order by md5 of a key and a seed: the same on every engine and cluster size. The model of a fold is the class means
of the other folds (total sums less the fold's own), so no fold scans the epochs again.
"""

from tidemark.plans.portable import step

step("subjects", "SELECT DISTINCT subject, label FROM {epochs} WHERE label < 3", public=False)
step("epochs3", "SELECT * FROM {epochs} WHERE label < 3", public=False)
step("cells3", "SELECT * FROM {cells} WHERE label < 3", public=False)
step("folds", """
SELECT r.repeat, (row_number() OVER (PARTITION BY r.repeat, s.label ORDER BY md5(concat(CAST(s.subject AS string), '#', CAST(42 + 1000 * r.repeat AS string))), s.subject) - 1) % 5 AS fold, s.subject, s.label
FROM {subjects} s JOIN {repeats} r ON r.repeat >= 0""", public=False)
step("folds_stratified", "SELECT repeat, CAST(fold AS bigint) AS fold, subject, label FROM {folds}")
step("loso_splits", "SELECT a.subject AS fold, b.subject, CASE WHEN a.subject = b.subject THEN 'test' ELSE 'train' END AS role FROM {subjects} a JOIN {subjects} b ON b.label >= 0")
step("fixed_split", "SELECT subject, CASE WHEN subject % 8 IN (0, 5) THEN 'test' ELSE 'train' END AS role FROM {subjects}")
step("roles", "SELECT f.repeat, k.fold, f.subject, CASE WHEN f.fold = k.fold THEN 'test' ELSE 'train' END AS role FROM {folds} f JOIN (SELECT DISTINCT repeat, fold FROM {folds}) k ON f.repeat = k.repeat", public=False)
step("split_members", "SELECT repeat, CAST(fold AS bigint) AS fold, role, count(*) AS n FROM {roles} GROUP BY repeat, fold, role")
step("leakage_check", """
SELECT count(*) AS leaks FROM (SELECT repeat, fold, subject FROM {roles} WHERE role = 'train' INTERSECT SELECT repeat, fold, subject FROM {roles} WHERE role = 'test')""")
step("unknown_subjects", "SELECT subject FROM {epochs} EXCEPT SELECT subject FROM {subjects}")
step("required_inputs", "SELECT 'feat' AS input UNION SELECT 'cov' AS input UNION SELECT 'feat' AS input")
step("split_epochs", "SELECT f.repeat, CAST(f.fold AS bigint) AS fold, e.subject, e.epoch FROM {epochs3} e JOIN {folds} f ON e.subject = f.subject")
step("raw_weights", "SELECT e.subject, e.epoch, 1e0 / count(*) OVER (PARTITION BY e.subject) / c.n AS w FROM {epochs3} e JOIN (SELECT label, count(*) AS n FROM {subjects} GROUP BY label) c ON e.label = c.label", public=False)
# the mean is one row sent to all tasks: a window over everything would be a single task
step("balanced_weights", "SELECT w.subject, w.epoch, round(w.w / m.m, 6) AS weight FROM {raw_weights} w JOIN (SELECT avg(w) AS m FROM {raw_weights}) m ON m.m > 0")
step("class_weights", "SELECT label, round(sum(count(*)) OVER () / (count(*) OVER () * count(*)) + 1e-9, 6) AS weight FROM {epochs3} GROUP BY label")
step("subsample_cap", "SELECT subject, epoch FROM (SELECT subject, epoch, row_number() OVER (PARTITION BY subject ORDER BY md5(concat('7#', CAST(epoch AS string)))) AS rn FROM {epochs3}) WHERE rn <= 3")
step("undersample", "SELECT label, epoch FROM (SELECT label, epoch, row_number() OVER (PARTITION BY label ORDER BY md5(CAST(epoch AS string))) AS rn FROM {epochs}) WHERE rn <= (SELECT min(n) FROM (SELECT count(*) AS n FROM {epochs} GROUP BY label))")
# places within blocks of keys, after the rows of earlier blocks: only one row a block is ordered as a whole
step("epoch_blocks", "SELECT epoch, CAST(floor(epoch / 65536) AS bigint) AS block FROM {epochs}", public=False)
step("systematic_sample", """
SELECT e.epoch FROM (SELECT epoch, block, row_number() OVER (PARTITION BY block ORDER BY epoch) AS rn FROM {epoch_blocks}) e
JOIN (SELECT block, sum(n) OVER (ORDER BY block) - n AS earlier FROM (SELECT block, count(*) AS n FROM {epoch_blocks} GROUP BY block)) o ON o.block = e.block WHERE (o.earlier + e.rn) % 5 = 1""",
     duckdb="SELECT epoch FROM (SELECT epoch, row_number() OVER (ORDER BY epoch) AS rn FROM {epochs}) WHERE rn % 5 = 1")
step("subject_mean", "SELECT subject, j, round(avg(v) + 1e-9, 6) AS v FROM {cells3} GROUP BY subject, j")
step("label_recode", "SELECT subject, CASE label WHEN 0 THEN 'AD' WHEN 1 THEN 'CN' ELSE 'FTD' END AS diagnosis FROM {subjects}")
step("label_permute", """
SELECT a.subject, b.label FROM (SELECT subject, row_number() OVER (ORDER BY subject) AS rn FROM {subjects}) a
JOIN (SELECT label, row_number() OVER (ORDER BY md5(concat(CAST(subject AS string), '#p'))) AS rn FROM {subjects}) b ON a.rn = b.rn""")
step("fold_sums", "SELECT f.repeat, f.fold, c.label, c.j, sum(c.v) AS s, count(*) AS n FROM {cells3} c JOIN {folds} f ON c.subject = f.subject GROUP BY f.repeat, f.fold, c.label, c.j", public=False)
step("centroids", """
SELECT repeat, fold, label, j, (sum(s) OVER (PARTITION BY repeat, label, j) - s) / (sum(n) OVER (PARTITION BY repeat, label, j) - n) AS m FROM {fold_sums}""", public=False)
step("distances", """
SELECT f.repeat, f.fold, c.subject, c.label AS y, c.epoch, m.label AS k, sum(power(c.v - m.m, 2)) AS d
FROM {cells3} c JOIN {folds} f ON c.subject = f.subject JOIN {centroids} m ON m.repeat = f.repeat AND m.fold = f.fold AND m.j = c.j
GROUP BY f.repeat, f.fold, c.subject, c.label, c.epoch, m.label""", public=False)
step("proba", """
SELECT repeat, fold, subject, y, epoch, k, exp(lo - d) / sum(exp(lo - d)) OVER (PARTITION BY repeat, epoch) AS p
FROM (SELECT *, min(d) OVER (PARTITION BY repeat, epoch) AS lo FROM {distances})""", public=False)
step("centroid_proba", "SELECT repeat, CAST(fold AS bigint) AS fold, subject, y, epoch, k, round(p + 1e-9, 6) AS p FROM {proba}")
step("geomean", "SELECT repeat, fold, subject, y, k, avg(ln(greatest(least(p, 1), 1e-7))) AS g, count(*) AS n FROM {proba} GROUP BY repeat, fold, subject, y, k", public=False)
step("subject_proba", """
SELECT repeat, fold, subject, y, k, n, exp(g - hi) / sum(exp(g - hi)) OVER (PARTITION BY repeat, subject) AS p
FROM (SELECT *, max(g) OVER (PARTITION BY repeat, subject) AS hi FROM {geomean})""", public=False)
step("subject_geomean", "SELECT repeat, CAST(fold AS bigint) AS fold, subject, y, k, n, round(p + 1e-9, 6) AS p FROM {subject_proba}")
step("verdicts", "SELECT repeat, fold, subject, y, k AS pred, p FROM (SELECT *, row_number() OVER (PARTITION BY repeat, subject ORDER BY p DESC, k) AS rn FROM {subject_proba}) WHERE rn = 1", public=False)
step("confusion", "SELECT repeat, y, pred, count(*) AS n FROM {verdicts} GROUP BY repeat, y, pred")
step("per_class", """
SELECT v.repeat, c.k, sum(CASE WHEN y = k THEN 1 ELSE 0 END) AS support, sum(CASE WHEN y = k AND pred = k THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN y <> k AND pred = k THEN 1 ELSE 0 END) AS fp,
       sum(CASE WHEN y <> k AND pred <> k THEN 1 ELSE 0 END) AS tn, count(*) AS n
FROM {verdicts} v JOIN (SELECT DISTINCT label AS k FROM {subjects}) c ON c.k >= 0 GROUP BY v.repeat, c.k""", public=False)
step("class_report", """
SELECT repeat, k, round(tp / nullif(support, 0) + 1e-9, 6) AS recall, round(tn / nullif(tn + fp, 0) + 1e-9, 6) AS specificity, round(coalesce(tp / nullif(tp + fp, 0), 0) + 1e-9, 6) AS precision_,
       round(coalesce(2.0 * tp / nullif(tp + fp + support, 0), 0) + 1e-9, 6) AS f1 FROM {per_class}""")
step("log_loss", "SELECT repeat, round(-avg(ln(greatest(least(p, 1), 1e-7))) + 1e-9, 6) AS log_loss FROM {subject_proba} WHERE y = k GROUP BY repeat")
step("midranks", """
SELECT repeat, k, y, rank() OVER (PARTITION BY repeat, k ORDER BY p) + (count(*) OVER (PARTITION BY repeat, k, p) - 1) / 2e0 AS r FROM {subject_proba}""", public=False)
step("auc", """
SELECT repeat, k, (sum(CASE WHEN y = k THEN r ELSE 0 END) - sum(CASE WHEN y = k THEN 1 ELSE 0 END) * (sum(CASE WHEN y = k THEN 1 ELSE 0 END) + 1) / 2e0)
       / nullif(sum(CASE WHEN y = k THEN 1 ELSE 0 END) * sum(CASE WHEN y <> k THEN 1 ELSE 0 END), 0) AS auc FROM {midranks} GROUP BY repeat, k""", public=False, duckdb="""
SELECT a.repeat, a.k, avg(CASE WHEN a.p > b.p THEN 1e0 WHEN a.p = b.p THEN 0.5e0 ELSE 0e0 END) AS auc FROM {subject_proba} a JOIN {subject_proba} b ON b.repeat = a.repeat AND b.k = a.k AND b.y <> b.k
WHERE a.y = a.k GROUP BY a.repeat, a.k""")
step("auc_ovr", "SELECT repeat, k, round(auc + 1e-9, 6) AS auc FROM {auc}")
step("metrics", """
SELECT c.repeat, avg(tp / nullif(support, 0)) AS bal, sum(tp) / max(n) AS acc, avg(coalesce(2.0 * tp / nullif(tp + fp + support, 0), 0)) AS f1, max(a.auc) AS auc
FROM {per_class} c JOIN (SELECT repeat, avg(auc) AS auc FROM {auc} GROUP BY repeat) a ON c.repeat = a.repeat GROUP BY c.repeat""", public=False)
step("per_repeat", "SELECT repeat, round(bal + 1e-9, 6) AS balanced_accuracy, round(acc + 1e-9, 6) AS accuracy, round(f1 + 1e-9, 6) AS macro_f1, round(auc + 1e-9, 6) AS macro_auc FROM {metrics}")
step("per_fold", "SELECT repeat, CAST(fold AS bigint) AS fold, round(avg(CASE WHEN y = pred THEN 1e0 ELSE 0e0 END) + 1e-9, 6) AS accuracy FROM {verdicts} GROUP BY repeat, fold")
step("mean_sd", "SELECT round(avg(bal) + 1e-9, 6) AS mean, round(coalesce(stddev_samp(bal), 0) + 1e-9, 6) AS sd FROM {metrics}")
step("pairwise_accuracy", """
SELECT a.k AS a, b.k AS b, round((a.tp + b.tp) / (a.support + b.support) + 1e-9, 6) AS accuracy FROM {per_class} a JOIN {per_class} b ON a.repeat = b.repeat AND a.k < b.k WHERE a.repeat = 0""")
step("ranked_subjects", "SELECT label, subject, row_number() OVER (PARTITION BY label ORDER BY subject) AS rn, count(*) OVER (PARTITION BY label) AS n FROM {subjects}", public=False)
# the first 32 bits of md5 as a number, modulo the subjects of the class
step("picks", """
SELECT d.b, s.label, 1 + CAST(conv(substring(md5(concat(CAST(d.b AS string), ':', CAST(s.label AS string), ':', CAST(s.rn AS string))), 1, 8), 16, 10) AS bigint) % s.n AS pick
FROM {ranked_subjects} s JOIN {boot_numbers} d ON d.b >= 0""", public=False, duckdb="""
SELECT d.b, s.label, 1 + CAST(concat('0x', substring(md5(concat(CAST(d.b AS string), ':', CAST(s.label AS string), ':', CAST(s.rn AS string))), 1, 8)) AS bigint) % s.n AS pick
FROM {ranked_subjects} s JOIN {boot_numbers} d ON d.b >= 0""")
step("draws", "SELECT p.b, p.label, s.subject, count(*) AS mult FROM {picks} p JOIN {ranked_subjects} s ON s.label = p.label AND s.rn = p.pick GROUP BY p.b, p.label, s.subject", public=False)
step("bootstrap_draws", "SELECT b, label, subject, mult FROM {draws}")
step("boot", """
SELECT b, avg(bal) AS bal FROM (SELECT b, repeat, avg(rec) AS bal FROM (
  SELECT d.b, v.repeat, v.y, sum(CASE WHEN v.pred = v.y THEN d.mult ELSE 0 END) / sum(d.mult) AS rec FROM {draws} d JOIN {verdicts} v ON v.subject = d.subject GROUP BY d.b, v.repeat, v.y) GROUP BY b, repeat) GROUP BY b""", public=False)
step("bootstrap_ci", "SELECT round(percentile(bal, 0.025) + 1e-9, 6) AS lo, round(percentile(bal, 0.975) + 1e-9, 6) AS hi, round(avg(bal) + 1e-9, 6) AS mean FROM {boot}")
# at epoch level a draw keeps the whole subject: its hits and epochs count as often as it was drawn
step("epoch_hits", """
SELECT repeat, subject, y, sum(CASE WHEN k = y THEN 1 ELSE 0 END) AS hits, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY repeat, epoch ORDER BY d, k) AS rn FROM {distances}) WHERE rn = 1 GROUP BY repeat, subject, y""", public=False)
step("bootstrap_ci_epochs", """
SELECT round(percentile(bal, 0.025) + 1e-9, 6) AS lo, round(percentile(bal, 0.975) + 1e-9, 6) AS hi, round(avg(bal) + 1e-9, 6) AS mean FROM (SELECT b, avg(rec) AS bal FROM (
  SELECT d.b, h.repeat, h.y, sum(h.hits * d.mult) * 1e0 / sum(h.n * d.mult) AS rec FROM {draws} d JOIN {epoch_hits} h ON h.subject = d.subject GROUP BY d.b, h.repeat, h.y) GROUP BY b)""")
step("prior_verdicts", "SELECT v.repeat, v.subject, v.y, m.label AS pred FROM {verdicts} v JOIN (SELECT label FROM (SELECT label, row_number() OVER (ORDER BY count(*) DESC, label) AS rn FROM {epochs3} GROUP BY label) WHERE rn = 1) m ON v.y >= 0", public=False)
step("prior_dummy", "SELECT label, round(count(*) / sum(count(*)) OVER () + 1e-9, 6) AS p FROM {epochs3} GROUP BY label")
# both models' verdicts side by side; a subject that one of them lacks, or labels otherwise, is an error
step("paired_verdicts", """
SELECT coalesce(a.repeat, p.repeat) AS repeat, coalesce(a.subject, p.subject) AS subject, a.y, CASE WHEN a.y IS NULL OR p.y IS NULL OR a.y <> p.y THEN raise_error('the models differ in their subjects or labels') ELSE a.pred END AS pred_a, p.pred AS pred_b
FROM {verdicts} a FULL JOIN {prior_verdicts} p ON p.repeat = a.repeat AND p.subject = a.subject""", public=False)
step("paired_diff", """
SELECT round(avg(d) + 1e-9, 6) AS delta, round(percentile(d, 0.025) + 1e-9, 6) AS lo, round(percentile(d, 0.975) + 1e-9, 6) AS hi, round(avg(CASE WHEN d <= 0 THEN 1e0 ELSE 0e0 END) + 1e-9, 6) AS p_not_better
FROM (SELECT b, avg(ra - rb) AS d FROM (
  SELECT d.b, a.repeat, a.y, sum(CASE WHEN a.pred_a = a.y THEN d.mult ELSE 0 END) / sum(d.mult) AS ra, sum(CASE WHEN a.pred_b = a.y THEN d.mult ELSE 0 END) / sum(d.mult) AS rb
  FROM {draws} d JOIN {paired_verdicts} a ON a.subject = d.subject GROUP BY d.b, a.repeat, a.y) GROUP BY b)""")
step("permuted", """
SELECT a.b, a.subject, c.label FROM (SELECT n.b, s.subject, row_number() OVER (PARTITION BY n.b ORDER BY s.subject) AS rn FROM {subjects} s JOIN {numbers} n ON n.b >= 0) a
JOIN (SELECT n.b, s.label, row_number() OVER (PARTITION BY n.b ORDER BY md5(concat(CAST(s.subject AS string), '#', CAST(n.b AS string)))) AS rn FROM {subjects} s JOIN {numbers} n ON n.b >= 0) c ON a.b = c.b AND a.rn = c.rn""", public=False)
step("null_folds", """
SELECT b, subject, label, (row_number() OVER (PARTITION BY b, label ORDER BY md5(concat(CAST(subject AS string), '#f', CAST(b AS string))), subject) - 1) % 5 AS fold FROM {permuted}""", public=False)
step("subject_sums", "SELECT subject, j, sum(v) AS s, count(*) AS n FROM {cells3} GROUP BY subject, j", public=False)
# centroids are sums of subjects, so squared distances (less the epoch's own square, alike for all classes) are sums of these products
step("epoch_dots", "SELECT c.subject, c.epoch, t.subject AS other, sum(c.v * t.s) AS dot FROM {cells3} c JOIN {subject_sums} t ON t.j = c.j GROUP BY c.subject, c.epoch, t.subject", public=False)
step("subject_dots", "SELECT x.subject AS one, y.subject AS other, sum(x.s * y.s) AS dot FROM {subject_sums} x JOIN {subject_sums} y ON x.j = y.j GROUP BY x.subject, y.subject", public=False)
step("null_train", """
SELECT t.b, k.fold, t.label, t.subject, c.n FROM {null_folds} t JOIN (SELECT DISTINCT b, fold FROM {null_folds}) k ON k.b = t.b AND k.fold <> t.fold
JOIN (SELECT subject, max(n) AS n FROM {subject_sums} GROUP BY subject) c ON c.subject = t.subject""", public=False)
step("null_norms", """
SELECT m.b, m.fold, m.label, m.n, q.dot / m.n / m.n AS norm FROM (SELECT b, fold, label, sum(n) AS n FROM {null_train} GROUP BY b, fold, label) m
JOIN (SELECT x.b, x.fold, x.label, sum(d.dot) AS dot FROM {null_train} x JOIN {null_train} y ON x.b = y.b AND x.fold = y.fold AND x.label = y.label
      JOIN {subject_dots} d ON d.one = x.subject AND d.other = y.subject GROUP BY x.b, x.fold, x.label) q ON q.b = m.b AND q.fold = m.fold AND q.label = m.label""", public=False)
step("null_distances", """
SELECT s.b, s.subject, s.y, s.epoch, s.k, m.norm - 2 * s.dot / m.n AS d FROM (
  SELECT f.b, f.fold, f.label AS y, e.subject, e.epoch, t.label AS k, sum(e.dot) AS dot FROM {epoch_dots} e JOIN {null_folds} f ON f.subject = e.subject
  JOIN {null_train} t ON t.b = f.b AND t.fold = f.fold AND t.subject = e.other GROUP BY f.b, f.fold, f.label, e.subject, e.epoch, t.label) s
JOIN {null_norms} m ON m.b = s.b AND m.fold = s.fold AND m.label = s.k""", public=False)
step("null_verdicts", """
SELECT b, subject, y, k AS pred FROM (SELECT *, row_number() OVER (PARTITION BY b, subject ORDER BY g DESC, k) AS rn FROM (
  SELECT b, subject, y, k, avg(ln(greatest(least(p, 1), 1e-7))) AS g FROM (
    SELECT b, subject, y, k, exp(lo - d) / sum(exp(lo - d)) OVER (PARTITION BY b, epoch) AS p FROM (SELECT *, min(d) OVER (PARTITION BY b, epoch) AS lo FROM {null_distances})) GROUP BY b, subject, y, k)) WHERE rn = 1""", public=False)
step("null_scores", """
SELECT b, avg(rec) AS bal FROM (SELECT b, y, avg(CASE WHEN pred = y THEN 1e0 ELSE 0e0 END) AS rec FROM {null_verdicts} GROUP BY b, y) GROUP BY b""", public=False)
step("permutation_p", """
SELECT round((1 + sum(CASE WHEN n.bal >= o.bal - 1e-9 THEN 1 ELSE 0 END)) / (1.0 + count(*)) + 1e-9, 6) AS p, round(avg(n.bal) + 1e-9, 6) AS null_mean, round(stddev_samp(n.bal) + 1e-9, 6) AS null_sd, round(percentile(n.bal, 0.95) + 1e-9, 6) AS null_95
FROM {null_scores} n JOIN (SELECT avg(bal) AS bal FROM {metrics}) o ON o.bal >= 0""")
step("soft_vote", """
SELECT repeat, subject, y, k, round(exp(g - hi) / sum(exp(g - hi)) OVER (PARTITION BY repeat, subject) + 1e-9, 6) AS p
FROM (SELECT *, max(g) OVER (PARTITION BY repeat, subject) AS hi FROM (
  SELECT repeat, subject, y, k, CASE WHEN count(*) = 2 THEN avg(ln(greatest(least(p, 1), 1e-7))) ELSE CAST(raise_error('the members of a vote differ in their subjects') AS double) END AS g FROM (
    SELECT repeat, subject, y, k, p FROM {subject_proba} UNION ALL
    SELECT s.repeat, s.subject, s.y, s.k, d.p FROM {subject_proba} s JOIN (SELECT label, count(*) * 1.0 / sum(count(*)) OVER () AS p FROM {epochs3} GROUP BY label) d ON d.label = s.k) GROUP BY repeat, subject, y, k))""")
step("distances_by_group", """
SELECT f.repeat, f.fold, c.subject, c.label AS y, c.epoch, m.label AS k, CAST(floor(c.j / 16) AS bigint) AS grp, sum(power(c.v - m.m, 2)) AS d
FROM {cells3} c JOIN {folds} f ON c.subject = f.subject JOIN {centroids} m ON m.repeat = f.repeat AND m.fold = f.fold AND m.j = c.j
GROUP BY f.repeat, f.fold, c.subject, c.label, c.epoch, m.label, CAST(floor(c.j / 16) AS bigint)""", public=False)
step("tested", "SELECT f.repeat, f.fold, e.epoch FROM {epochs3} e JOIN {folds} f ON e.subject = f.subject", public=False)
step("group_sizes", "SELECT CAST(floor(j / 16) AS bigint) AS grp, count(DISTINCT j) AS n_features FROM {cells3} GROUP BY CAST(floor(j / 16) AS bigint)", public=False)
step("shuffled", """
SELECT b.repeat, b.fold, b.grp, b.draw, a.epoch, b.epoch AS other FROM (SELECT repeat, fold, epoch, row_number() OVER (PARTITION BY repeat, fold ORDER BY epoch) AS rn FROM {tested}) a
JOIN (SELECT t.repeat, t.fold, g.grp, n.b AS draw, t.epoch, row_number() OVER (PARTITION BY t.repeat, t.fold, g.grp, n.b
        ORDER BY md5(concat(CAST(t.epoch AS string), '#', CAST(t.repeat AS string), '#', CAST(g.grp AS string), '#', CAST(n.b AS string), '#s'))) AS rn
      FROM {tested} t JOIN {group_sizes} g ON g.grp >= 0 JOIN {numbers} n ON n.b < 5) b ON a.repeat = b.repeat AND a.fold = b.fold AND a.rn = b.rn""", public=False)
# grp -1: nothing shuffled
step("shuffled_distances", """
SELECT repeat, fold, -1 AS grp, 0 AS draw, subject, y, epoch, k, sum(d) AS d FROM {distances_by_group} GROUP BY repeat, fold, subject, y, epoch, k UNION ALL
SELECT g.repeat, g.fold, g.grp, s.draw, g.subject, g.y, g.epoch, g.k, t.d - g.d + o.d AS d FROM {distances_by_group} g
JOIN (SELECT repeat, epoch, k, sum(d) AS d FROM {distances_by_group} GROUP BY repeat, epoch, k) t ON t.repeat = g.repeat AND t.epoch = g.epoch AND t.k = g.k
JOIN {shuffled} s ON s.repeat = g.repeat AND s.fold = g.fold AND s.grp = g.grp AND s.epoch = g.epoch
JOIN {distances_by_group} o ON o.repeat = s.repeat AND o.epoch = s.other AND o.k = g.k AND o.grp = g.grp""", public=False)
step("shuffled_proba", """
SELECT repeat, fold, grp, draw, subject, y, k, round(exp(g - hi) / sum(exp(g - hi)) OVER (PARTITION BY repeat, grp, draw, subject), 12) AS p FROM (SELECT *, max(g) OVER (PARTITION BY repeat, grp, draw, subject) AS hi FROM (
  SELECT repeat, fold, grp, draw, subject, y, k, avg(ln(greatest(least(p, 1), 1e-7))) AS g FROM (
    SELECT *, exp(lo - d) / sum(exp(lo - d)) OVER (PARTITION BY repeat, grp, draw, epoch) AS p FROM (SELECT *, min(d) OVER (PARTITION BY repeat, grp, draw, epoch) AS lo FROM {shuffled_distances}))
  GROUP BY repeat, fold, grp, draw, subject, y, k))""", public=False)
step("shuffled_classes", """
SELECT repeat, fold, grp, draw, k, sum(CASE WHEN y = k AND best = 1 THEN 1e0 ELSE 0e0 END) / nullif(sum(CASE WHEN y = k THEN 1 ELSE 0 END), 0) AS recall,
       (sum(CASE WHEN y = k THEN r ELSE 0 END) - sum(CASE WHEN y = k THEN 1 ELSE 0 END) * (sum(CASE WHEN y = k THEN 1 ELSE 0 END) + 1) / 2e0) / nullif(sum(CASE WHEN y = k THEN 1 ELSE 0 END) * sum(CASE WHEN y <> k THEN 1 ELSE 0 END), 0) AS auc
FROM (SELECT *, row_number() OVER (PARTITION BY repeat, grp, draw, subject ORDER BY p DESC, k) AS best,
             rank() OVER (PARTITION BY repeat, fold, grp, draw, k ORDER BY p) + (count(*) OVER (PARTITION BY repeat, fold, grp, draw, k, p) - 1) / 2e0 AS r FROM {shuffled_proba}) GROUP BY repeat, fold, grp, draw, k""", public=False)
step("shuffled_scores", """
SELECT repeat, fold, grp, draw, avg(recall) AS bal, avg(auc) AS auc, max(CASE WHEN k = 0 THEN auc END) AS a0, max(CASE WHEN k = 1 THEN auc END) AS a1, max(CASE WHEN k = 2 THEN auc END) AS a2
FROM {shuffled_classes} GROUP BY repeat, fold, grp, draw""", public=False)
step("split_drops", """
SELECT s.grp, s.repeat, s.fold, avg(o.bal - s.bal) AS bal, avg(o.auc - s.auc) AS auc, avg(o.a0 - s.a0) AS a0, avg(o.a1 - s.a1) AS a1, avg(o.a2 - s.a2) AS a2
FROM {shuffled_scores} s JOIN {shuffled_scores} o ON o.repeat = s.repeat AND o.fold = s.fold AND o.grp = -1 WHERE s.grp >= 0 GROUP BY s.grp, s.repeat, s.fold""", public=False)
step("perm_importance", """
SELECT d.grp, max(g.n_features) AS n_features, round(avg(bal) + 1e-9, 6) AS drop_bal_acc, round(stddev_samp(bal) + 1e-9, 6) AS drop_bal_acc_sd, round(avg(auc) + 1e-9, 6) AS drop_macro_auc, round(stddev_samp(auc) + 1e-9, 6) AS drop_macro_auc_sd, round(avg(a0) + 1e-9, 6) AS drop_auc_ad, round(stddev_samp(a0) + 1e-9, 6) AS drop_auc_ad_sd, round(avg(a1) + 1e-9, 6) AS drop_auc_cn, round(stddev_samp(a1) + 1e-9, 6) AS drop_auc_cn_sd, round(avg(a2) + 1e-9, 6) AS drop_auc_ftd, round(stddev_samp(a2) + 1e-9, 6) AS drop_auc_ftd_sd
FROM {split_drops} d JOIN {group_sizes} g ON g.grp = d.grp GROUP BY d.grp ORDER BY drop_macro_auc DESC, d.grp""")
