"""A recording before its windows: crop in seconds, guard against short ones, boundary marks, units and chunks. Eight samples are a second."""

from tidemark.plans.portable import step

step("lengths", "SELECT user_id, count(*) AS n FROM {samples} GROUP BY user_id", public=False)
step("crop", "SELECT s.user_id, s.i - 16 AS i, s.value FROM {samples} s JOIN {lengths} n ON n.user_id = s.user_id WHERE s.i >= 16 AND s.i < n.n - 8")
step("short_recordings", "SELECT user_id, n, (n - 24) / 8e0 AS seconds_left FROM {lengths} WHERE n - 24 < 60 * 8")
step("marks", "SELECT user_id, i FROM {samples} WHERE event_type = 'error' AND value > 150", public=False)
step("rebased_marks", "SELECT m.user_id, m.i - 16 AS i FROM {marks} m JOIN {lengths} n ON n.user_id = m.user_id WHERE m.i >= 16 AND m.i < n.n - 8")
# a window within half a second of a mark goes: a mark names the windows near it by arithmetic, so the join is one of equal keys
step("near_marks", """
SELECT DISTINCT user_id, epoch FROM (SELECT m.user_id, m.i, CAST(floor((m.i + 4) / 8) AS bigint) - b.b AS epoch FROM {marks} m JOIN {numbers} b ON b.b < 4) WHERE i < epoch * 8 + 16 + 4""", public=False)
step("boundary_margin", "SELECT w.user_id, w.epoch FROM {windows_sliding} w LEFT JOIN {near_marks} b ON b.user_id = w.user_id AND b.epoch = w.epoch WHERE b.epoch IS NULL")
step("unit_scale", "SELECT user_id, event_id, round(value * 1e6, 3) AS microvolt, round(value * 1e6 * 0.01, 3) AS hundredth FROM {samples}")
step("chunks", """
SELECT c.user_id, c.chunk, c.n, CASE WHEN c.user_id % 5 = 0 THEN 'test_cross' WHEN row_number() OVER (PARTITION BY c.user_id ORDER BY md5(concat(CAST(c.chunk AS string), '#', CAST(c.user_id AS string))), c.chunk) <= floor(0.1 * count(*) OVER (PARTITION BY c.user_id)) THEN 'test_within' ELSE 'train' END AS role
FROM (SELECT user_id, CAST(floor(i / 32) AS bigint) AS chunk, count(*) AS n FROM {crop} GROUP BY user_id, CAST(floor(i / 32) AS bigint) HAVING count(*) = 32) c""")
step("checkpoint_names", "SELECT user_id, concat('fold', CAST(k % 5 AS string), '_epoch', CAST(event_id AS string), '.ckpt') AS file FROM {props} WHERE k IS NOT NULL", public=False)
step("latest_checkpoint", """
SELECT user_id, file FROM (SELECT user_id, file, row_number() OVER (PARTITION BY user_id ORDER BY CAST(substring(split_part(file, '_', 1), 5, 9) AS bigint) DESC, CAST(substring(split_part(split_part(file, '_', 2), '.', 1), 6, 18) AS bigint) DESC) AS rn FROM {checkpoint_names}) WHERE rn = 1""")
# all five bands of 0.5-45 Hz over a bin of df = 1 Hz; bins above the Nyquist frequency are none
step("band_powers", """
SELECT epoch, round(sum(CASE WHEN k >= 0.5 AND k < 4 THEN p ELSE 0 END), 6) AS delta, round(sum(CASE WHEN k >= 4 AND k < 8 THEN p ELSE 0 END), 6) AS theta, round(sum(CASE WHEN k >= 8 AND k < 13 THEN p ELSE 0 END), 6) AS alpha,
       round(sum(CASE WHEN k >= 13 AND k < 25 THEN p ELSE 0 END), 6) AS beta, round(sum(CASE WHEN k >= 25 AND k <= 45 THEN p ELSE 0 END), 6) AS gamma, round(sum(CASE WHEN k >= 0.5 AND k <= 45 THEN p ELSE 0 END), 6) AS total FROM {psd} GROUP BY epoch""")
