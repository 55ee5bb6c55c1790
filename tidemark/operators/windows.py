"""Windows of a recording: overlapping full windows, boundary exclusion, robust rejection, re-referencing and scaling."""

from tidemark.plans.portable import step

step("windows_sliding", """
SELECT user_id, epoch, epoch * 8 AS start, count(*) AS n, round(avg(value) + 1e-9, 6) AS mean, round(max(value) - min(value) + 1e-9, 6) AS ptp
FROM {window_samples} GROUP BY user_id, epoch""")
step("windows_tumbling", """
SELECT user_id, CAST(floor(i / 16) AS bigint) AS epoch, count(*) AS n, round(sum(value) + 1e-9, 6) AS total
FROM {samples} GROUP BY user_id, CAST(floor(i / 16) AS bigint) HAVING count(*) = 16""")
step("window_marks", """
SELECT user_id, epoch, max(CASE WHEN event_type = 'error' AND value > 150 THEN 1 ELSE 0 END) AS hit, ln(max(value) - min(value) + 1e-12) AS amp
FROM {window_samples} GROUP BY user_id, epoch""", public=False)
step("boundary_antijoin", "SELECT user_id, epoch FROM {window_marks} WHERE hit = 0")
step("amp_centre", """
SELECT user_id, count(*) AS kept, median(amp) AS med FROM {window_marks} WHERE hit = 0 GROUP BY user_id""", public=False)
step("amp_spread", """
SELECT m.user_id, c.kept, c.med, median(abs(m.amp - c.med)) AS mad
FROM {window_marks} m JOIN {amp_centre} c ON m.user_id = c.user_id WHERE m.hit = 0 GROUP BY m.user_id, c.kept, c.med""", public=False, duckdb="SELECT user_id, count(*) AS kept, median(amp) AS med, mad(amp) AS mad FROM {window_marks} WHERE hit = 0 GROUP BY user_id")
step("window_fate", """
SELECT m.user_id, m.epoch, m.hit,
       CASE WHEN m.hit = 0 AND s.kept > 5 AND m.amp > s.med + 5 * (1.4826 * s.mad + 1e-12) THEN 1 ELSE 0 END AS loud
FROM {window_marks} m LEFT JOIN {amp_spread} s ON m.user_id = s.user_id""", public=False)
step("mad_reject", "SELECT user_id, epoch FROM {window_fate} WHERE hit = 0 AND loud = 0")
step("windows_yield", """
SELECT user_id, count(*) AS n_candidates, CAST(sum(hit) AS bigint) AS n_boundary, CAST(sum(loud) AS bigint) AS n_loud,
       CAST(count(*) - sum(hit) - sum(loud) AS bigint) AS n_epochs FROM {window_fate} GROUP BY user_id""")
step("yield_rollup", """
SELECT coalesce(CAST(g AS string), 'total') AS grp, CAST(sum(n_epochs) AS bigint) AS total, CAST(min(n_epochs) AS bigint) AS least, CAST(max(n_epochs) AS bigint) AS most
FROM (SELECT user_id % 3 AS g, n_epochs FROM {windows_yield}) GROUP BY ROLLUP (g)""")
step("zscore", """
SELECT user_id, event_id, round((value - m) / (CASE WHEN s < 1e-6 THEN 1 ELSE s END) + 1e-9, 6) AS z
FROM (SELECT *, avg(value) OVER (PARTITION BY user_id) AS m, stddev_pop(value) OVER (PARTITION BY user_id) AS s FROM {samples})""")
step("pad_truncate", """
SELECT u.user_id, i.b AS i, round(coalesce(s.value, 0) + 1e-9, 6) AS value
FROM (SELECT DISTINCT user_id FROM {samples}) u JOIN {numbers} i ON i.b < 64 LEFT JOIN {samples} s ON s.user_id = u.user_id AND s.i = i.b""")
step("zero_crossings", """
SELECT user_id, CAST(sum(CASE WHEN (d < 0) <> (p < 0) THEN 1 ELSE 0 END) AS bigint) AS crossings
FROM (SELECT user_id, value - m AS d, lag(value - m) OVER (PARTITION BY user_id ORDER BY i) AS p
      FROM (SELECT *, avg(value) OVER (PARTITION BY user_id) AS m FROM {samples})) GROUP BY user_id""")
step("channels", "SELECT subject, label, epoch, CAST(floor(j / 16) AS bigint) AS ch, j % 16 AS t, v FROM {cells}", public=False)
step("average_reference", """
SELECT epoch, ch, t, round(v - avg(v) OVER (PARTITION BY epoch, t) + 1e-9, 6) AS v FROM {channels}""")
step("bipolar", """
SELECT a.epoch, a.ch AS pair, a.t, a.v - b.v AS d FROM {channels} a JOIN {channels} b ON a.epoch = b.epoch AND a.t = b.t AND b.ch = a.ch + 1""", public=False)
step("bipolar_scale", """
SELECT p.epoch, p.pair, p.t, round(p.d / (s.q + 1e-8) + 1e-9, 6) AS v
FROM {bipolar} p JOIN (SELECT epoch, percentile(abs(d), 0.95) AS q FROM {bipolar} GROUP BY epoch) s ON p.epoch = s.epoch""")
step("label_holdout", """
SELECT user_id, epoch, CASE WHEN rn <= 0.1 * n THEN 'test_within' ELSE 'train' END AS role
FROM (SELECT user_id, epoch, row_number() OVER (PARTITION BY user_id ORDER BY md5(concat(CAST(epoch AS string), '#', CAST(user_id AS string)))) AS rn,
             count(*) OVER (PARTITION BY user_id) AS n FROM (SELECT DISTINCT user_id, epoch FROM {window_samples}))""")
