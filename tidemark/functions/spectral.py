"""Spectral, shape and connectivity features as declarative steps over epochs of 64 samples (64 Hz, so bin k is k Hz)."""

from tidemark.plans.portable import step

# an epoch is one array: its sums need no shuffle
step("dft", """
SELECT epoch, k, aggregate(transform(x, (v, j) -> v * cos(2 * pi() * k * j / 64)), 0D, (a, b) -> a + b) AS re, -aggregate(transform(x, (v, j) -> v * sin(2 * pi() * k * j / 64)), 0D, (a, b) -> a + b) AS im
FROM (SELECT epoch, x, explode(sequence(0L, 32L)) AS k FROM {signals})""", public=False, duckdb="""
SELECT c.epoch, b.k, sum(c.v * cos(2 * pi() * b.k * c.j / 64)) AS re, -sum(c.v * sin(2 * pi() * b.k * c.j / 64)) AS im
FROM {cells} c JOIN {bins} b ON b.k >= 0 GROUP BY c.epoch, b.k""")
step("psd", "SELECT epoch, k, (re * re + im * im) / 4096 * (CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END) AS p FROM {dft}", public=False)
step("psd_dft", "SELECT epoch, k, round(p + 1e-9, 6) AS p FROM {psd}")
# power is density times the width of a bin (1 Hz), over 0.5-45 Hz, of which 64 Hz leave what is below 32 Hz
step("bands", """
SELECT epoch, sum(CASE WHEN k >= 0.5 AND k < 4 THEN p ELSE 0 END) AS delta, sum(CASE WHEN k >= 4 AND k < 8 THEN p ELSE 0 END) AS theta, sum(CASE WHEN k >= 8 AND k < 13 THEN p ELSE 0 END) AS alpha,
       sum(CASE WHEN k >= 13 AND k < 25 THEN p ELSE 0 END) AS beta, sum(CASE WHEN k >= 25 AND k <= 45 THEN p ELSE 0 END) AS gamma, sum(CASE WHEN k >= 0.5 AND k <= 45 THEN p ELSE 0 END) AS total FROM {psd} GROUP BY epoch""", public=False)
step("band_power", "SELECT epoch, round(delta + 1e-9, 6) AS delta, round(theta + 1e-9, 6) AS theta, round(alpha + 1e-9, 6) AS alpha, round(beta + 1e-9, 6) AS beta, round(gamma + 1e-9, 6) AS gamma, round(total + 1e-9, 6) AS total FROM {bands}")
step("relative_power", """
SELECT epoch, round(delta / nullif(total, 0) + 1e-9, 6) AS delta, round(theta / nullif(total, 0) + 1e-9, 6) AS theta, round(alpha / nullif(total, 0) + 1e-9, 6) AS alpha, round(beta / nullif(total, 0) + 1e-9, 6) AS beta, round(gamma / nullif(total, 0) + 1e-9, 6) AS gamma,
       round(ln(theta / nullif(alpha, 0)) / ln(10) + 1e-9, 6) AS log_theta_alpha, round(ln((delta + theta) / nullif(alpha + beta, 0)) / ln(10) + 1e-9, 6) AS log_slow_fast FROM {bands}""")
step("psd_share", """
SELECT epoch, k, p, p / nullif(sum(p) OVER (PARTITION BY epoch), 0) AS q, sum(p) OVER (PARTITION BY epoch ORDER BY k) / nullif(sum(p) OVER (PARTITION BY epoch), 0) AS cdf
FROM {psd} WHERE k >= 0.5 AND k <= 45""", public=False)
step("spectral_entropy", "SELECT epoch, round(-sum(q * ln(q + 1e-20)) / ln(count(*)) + 1e-9, 6) AS entropy FROM {psd_share} GROUP BY epoch")
step("median_freq", "SELECT epoch, min(CASE WHEN cdf >= 0.5 THEN k END) AS median_hz, min(CASE WHEN cdf >= 0.95 THEN k END) AS sef95_hz FROM {psd_share} GROUP BY epoch")
step("peak_freq", """
SELECT epoch, k AS peak_hz FROM (SELECT epoch, k, row_number() OVER (PARTITION BY epoch ORDER BY p DESC, k) AS rn FROM {psd} WHERE k >= 5 AND k <= 14) WHERE rn = 1""")
step("alpha_cog", "SELECT epoch, round(sum(p * k) / nullif(sum(p), 0) + 1e-9, 6) AS cog FROM {psd} WHERE k >= 7 AND k <= 13 GROUP BY epoch")
step("aperiodic_linear", "SELECT epoch, round(regr_intercept(ln(p + 1e-20), ln(k)) + 1e-9, 6) AS intercept, round(-regr_slope(ln(p + 1e-20), ln(k)) + 1e-9, 6) AS exponent, round(regr_r2(ln(p + 1e-20), ln(k)) + 1e-9, 6) AS r2 FROM {psd} WHERE k >= 1 GROUP BY epoch")
step("log_band_mean", "SELECT epoch, round(ln(avg(CASE WHEN k >= 1 AND k <= 4 THEN p END) + 1e-10) + 1e-9, 6) AS slow, round(ln(avg(CASE WHEN k >= 8 AND k <= 13 THEN p END) + 1e-10) + 1e-9, 6) AS alpha FROM {psd} GROUP BY epoch")
step("fft_band_mean", "SELECT epoch, round(avg(CASE WHEN k >= 4 AND k <= 8 THEN sqrt(re * re + im * im) END) + 1e-9, 6) AS theta, round(avg(CASE WHEN k >= 13 AND k <= 30 THEN sqrt(re * re + im * im) END) + 1e-9, 6) AS beta FROM {dft} GROUP BY epoch")
step("steps1", "SELECT epoch, j, v, v - lag(v) OVER (PARTITION BY epoch ORDER BY j) AS d FROM {cells}", public=False)
step("steps2", "SELECT epoch, j, v, d, d - lag(d) OVER (PARTITION BY epoch ORDER BY j) AS dd FROM {steps1}", public=False)
step("hjorth", """
SELECT epoch, round(ln(v0) + 1e-9, 6) AS activity, round(sqrt(v1 / v0) + 1e-9, 6) AS mobility, round(sqrt(v2 / v1) / sqrt(v1 / v0) + 1e-9, 6) AS complexity
FROM (SELECT epoch, var_pop(v) AS v0, var_pop(d) AS v1, var_pop(dd) AS v2 FROM {steps2} GROUP BY epoch) WHERE v0 > 0 AND v1 > 0""")
step("svm_stats", """
SELECT epoch, round(avg(v) + 1e-9, 6) AS mean, round(stddev_pop(v) + 1e-9, 6) AS sd, round(max(v) + 1e-9, 6) AS most, round(min(v) + 1e-9, 6) AS least,
       round(percentile(v, 0.75) - percentile(v, 0.25) + 1e-9, 6) AS iqr, round(sum(v * v) + 1e-9, 6) AS energy FROM {cells} GROUP BY epoch""")
step("region_mean", "SELECT epoch, CASE WHEN ch < 2 THEN 'front' ELSE 'back' END AS region, round(avg(v) + 1e-9, 6) AS mean FROM {channels} GROUP BY epoch, CASE WHEN ch < 2 THEN 'front' ELSE 'back' END")
step("edges", "SELECT a.epoch, a.ch AS i, b.ch AS j, corr(a.v, b.v) AS w FROM {channels} a JOIN {channels} b ON a.epoch = b.epoch AND a.t = b.t AND a.ch < b.ch GROUP BY a.epoch, a.ch, b.ch", public=False)
step("corr_edges", "SELECT epoch, i, j, round(w + 1e-9, 6) AS w FROM {edges}")
step("node_strength", "SELECT epoch, n AS ch, round(sum(abs(w)) / 3 + 1e-9, 6) AS strength FROM (SELECT epoch, i AS n, w FROM {edges} UNION ALL SELECT epoch, j AS n, w FROM {edges}) GROUP BY epoch, n")
step("dynamic_adjacency", "SELECT epoch, i, j, round(abs(w) / nullif(max(abs(w)) OVER (PARTITION BY epoch), 0) + 1e-9, 6) AS w FROM {edges}")
step("edge_threshold", "SELECT epoch, i, j FROM (SELECT *, max(abs(w)) OVER (PARTITION BY epoch) AS m FROM {edges}) WHERE abs(w) > 0.5 * m")
step("places", "SELECT n_nationkey AS id, cos(n_nationkey * 1.0) AS x, sin(n_nationkey * 2.0) AS y FROM {nation}", public=False)
step("distance_adjacency", "SELECT a.id AS i, b.id AS j, round(1 / (1 + sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2))) + 1e-9, 6) AS w FROM {places} a JOIN {places} b ON a.id <= b.id")
