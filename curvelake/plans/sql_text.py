"""SQL of the registered queries, for a second engine to check them with."""

from __future__ import annotations

U = "(('0x' || substr(md5({}), 1, 8))::BIGINT / 4294967296.0)"

OBS = """obs AS (
    SELECT 'U' || user_id AS curve_key, 'P' || (user_id % 5) AS test_id, [0, 0.1, 0.3, 1, 3, 10, 30, 100][(user_id % 8) + 1]::DOUBLE AS concentration,
           date_diff('microsecond', TIMESTAMP '2024-01-01', ts::TIMESTAMP) / 86400000000.0 AS time_h,
           round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) / 1000.0, 6) AS od, value / 100.0 AS od_raw, event_id
    FROM events)"""
RAW = "raw AS (SELECT curve_key, time_h, avg(od_raw) AS od FROM obs GROUP BY ALL)"
POINTS = "points AS (SELECT curve_key, time_h, avg(od) AS od FROM obs GROUP BY ALL)"
EARLY = "early AS (SELECT * FROM obs WHERE time_h <= 16)"
STATS = """stats AS (
    SELECT *, CASE WHEN n_points = 1 THEN 0.0 ELSE greatest(0, expected - n_points) / expected END AS missing_frac, n_points < 4 AS too_sparse
    FROM (SELECT curve_key, count(*) AS n_points, max(gap) AS max_gap, max(time_h) - min(time_h) AS span, (round_even((max(time_h) - min(time_h)) / 0.5, 0) + 1)::BIGINT AS expected
          FROM (SELECT *, time_h - lag(time_h) OVER (PARTITION BY curve_key ORDER BY time_h) AS gap FROM {source}) GROUP BY curve_key))"""
GRID = """grid0 AS (SELECT curve_key, g.i::INT AS grid_ix, (g.i * 0.5)::DOUBLE AS time_h FROM (SELECT DISTINCT curve_key FROM obs), (SELECT unnest(range(0, 33)) AS i) g),
counted AS (SELECT *, count(*) OVER (PARTITION BY curve_key) AS n FROM points),
back AS (SELECT g.*, p.time_h AS t0, p.od AS y0, p.n FROM grid0 g ASOF LEFT JOIN counted p ON g.curve_key = p.curve_key AND g.time_h >= p.time_h),
near AS (SELECT b.*, p.time_h AS t1, p.od AS y1 FROM back b ASOF LEFT JOIN counted p ON b.curve_key = p.curve_key AND b.time_h <= p.time_h),
grid AS (SELECT curve_key, grid_ix, time_h, CASE WHEN n < 2 OR t0 IS NULL OR t1 IS NULL THEN NULL WHEN t0 = t1 THEN y0 ELSE y0 + (y1 - y0) / (t1 - t0) * (time_h - t0) END AS od FROM near)"""
SEEN = "seen AS (SELECT curve_key, time_h, od FROM grid WHERE od IS NOT NULL)"


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


GRIDDED = _with(OBS, POINTS, GRID, SEEN)

ROLLED = "rolled AS (SELECT curve_key, time_h, CASE WHEN count(*) OVER (PARTITION BY curve_key) < 5 THEN od ELSE sum(od) OVER (PARTITION BY curve_key ORDER BY time_h ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5 END AS od FROM seen)"


def _savgol() -> str:
    def combine(weights, offsets):
        return "(" + " + ".join(f"{w} * {'od' if o == 0 else f'lead(od, {o}) OVER w' if o > 0 else f'lag(od, {-o}) OVER w'}" for w, o in zip(weights, offsets, strict=True)) + ") / 35.0"

    first, second, mid = [31, 9, -3, -5, 3], [9, 13, 12, 6, -5], [-3, 12, 17, 12, -3]
    return f"""smoothed AS (SELECT curve_key, time_h, CASE WHEN n < 5 THEN od WHEN i = 1 THEN {combine(first, [0, 1, 2, 3, 4])} WHEN i = 2 THEN {combine(second, [-1, 0, 1, 2, 3])}
    WHEN i = n THEN {combine(first, [0, -1, -2, -3, -4])} WHEN i = n - 1 THEN {combine(second, [1, 0, -1, -2, -3])} ELSE {combine(mid, [-2, -1, 0, 1, 2])} END AS od
    FROM (SELECT *, count(*) OVER (PARTITION BY curve_key) AS n, row_number() OVER (PARTITION BY curve_key ORDER BY time_h) AS i FROM seen) WINDOW w AS (PARTITION BY curve_key ORDER BY time_h))"""


SMOOTHED = _savgol()
MINMAX = "normed AS (SELECT curve_key, time_h, CASE WHEN hi - lo <= 1e-9 * size THEN 0.0 ELSE (od - lo) / (hi - lo) END AS od FROM (SELECT *, max(od) OVER w AS hi, min(od) OVER w AS lo, max(abs(od)) OVER w AS size FROM smoothed WINDOW w AS (PARTITION BY curve_key)))"

FEATURES = """p1 AS (
    SELECT curve_key, time_h, od, lag(time_h) OVER w AS t0, lag(od) OVER w AS y0, lead(od) OVER w AS y1, row_number() OVER w AS i, count(*) OVER a AS n, min(od) OVER a AS lo, max(od) OVER a AS hi,
           first(od) OVER w AS start, min(time_h) OVER a AS t_first, sum(od) OVER (PARTITION BY curve_key ORDER BY time_h ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5.0 AS rolled
    FROM normed WINDOW w AS (PARTITION BY curve_key ORDER BY time_h), a AS (PARTITION BY curve_key)),
p2 AS (SELECT *, od - y0 AS dy, time_h - t0 AS dt, (od - y0) / (time_h - t0) AS slope, sign(od - y0) AS sgn FROM p1),
p3 AS (SELECT *, last(CASE WHEN sgn <> 0 THEN sgn END IGNORE NULLS) OVER (PARTITION BY curve_key ORDER BY time_h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_sgn,
       CASE WHEN i > 1 AND i < n AND od >= y0 AND od >= y1 THEN time_h END AS peak FROM p2),
per AS (
    SELECT curve_key, max(time_h) AS observed_tmax, count(*) AS n_grid, max(dt) AS grid_gap, quantile_cont(dt, 0.5) AS median_dt, arg_min(od, time_h) AS initial_OD, arg_max(od, time_h) AS final_OD,
           coalesce(sum((od + y0) / 2 * dt), 0.0) AS auc, max(slope) AS max_slope, min(time_h) FILTER (slope = ms) AS time_of_max_slope, min(time_h) FILTER (od = hi) AS time_of_max_OD,
           count(*) FILTER (dy > 0) / nullif(count(dy), 0) AS monotonicity_fraction, min(dy) AS worst, max(hi) AS hi, max(lo) AS lo, stddev_pop(dy) AS roughness, stddev_pop(od - rolled) AS resid,
           min(time_h) FILTER (od >= start + 0.1 * (hi - lo)) AS t10, min(time_h) FILTER (od >= start + 0.9 * (hi - lo)) AS t90,
           quantile_cont(od, 0.5) FILTER (i > n - greatest(2, ceil(0.15 * n))) AS plateau_OD, count(*) FILTER (sgn <> 0 AND prev_sgn IS NOT NULL AND sgn <> prev_sgn) AS changes, min(peak) AS peak_first, max(peak) AS peak_last, max(t_first) AS t_first
    FROM (SELECT *, max(slope) OVER (PARTITION BY curve_key) AS ms FROM p3) GROUP BY curve_key),
valley AS (SELECT curve_key, max(od) FILTER (time_h = peak_first) AS od_first, max(od) FILTER (time_h = peak_last) AS od_last, min(od) FILTER (time_h > peak_first AND time_h < peak_last) AS od_between
           FROM p3 JOIN per USING (curve_key) GROUP BY curve_key),
feats AS (
    SELECT curve_key, observed_tmax, n_points::BIGINT AS n_points_observed, max_gap AS max_gap_hours, missing_frac AS missing_frac_on_grid, too_sparse::INT AS too_sparse,
           (coalesce(median_dt, 0) > 0.5 OR coalesce(max_gap, grid_gap, 0) > 2 OR missing_frac > 0.25)::INT AS grid_resolution_mismatch, 16.0::DOUBLE AS train_horizon, (coalesce(observed_tmax, 16) < 16 - 1e-9)::INT AS is_censored,
           initial_OD, final_OD, auc, CASE WHEN observed_tmax > 0 THEN auc / observed_tmax END AS auc_per_hour, CASE WHEN observed_tmax > 0 THEN (final_OD - initial_OD) / observed_tmax END AS net_change_per_hour,
           max_slope, time_of_max_slope, time_of_max_OD, monotonicity_fraction, CASE WHEN hi IS NULL THEN NULL WHEN hi - lo <= 1e-9 OR coalesce(worst >= 0, true) THEN 0.0 ELSE abs(worst) / (hi - lo) END AS largest_drop_frac,
           roughness, CASE WHEN n_points >= 8 THEN resid WHEN n_points >= 4 THEN roughness / sqrt(2.0) END AS noise_residual_std, CASE WHEN n_grid IS NOT NULL THEN (n_points >= 4 AND n_points < 8)::INT END AS noise_residual_std_is_fallback, t10 AS lag_time_est, plateau_OD,
           CASE WHEN t90 >= t10 THEN t90 - t10 END AS growth_phase_duration, (time_of_max_OD - t_first) / nullif(observed_tmax - t_first, 0) AS symmetry_factor, changes::BIGINT AS num_slope_sign_changes,
           CASE WHEN n_grid IS NULL THEN NULL ELSE coalesce(n_points >= 7 AND peak_last > peak_first AND od_first > initial_OD + 0.2 * (hi - lo) AND od_last > initial_OD + 0.2 * (hi - lo) AND od_between < hi - 0.2 * (hi - lo), false)::INT END AS multi_phase_flag
    FROM stats LEFT JOIN per USING (curve_key) LEFT JOIN valley USING (curve_key))"""

NOISE = """within AS (SELECT curve_key, time_h > 16 AS late, od - lag(od) OVER (PARTITION BY curve_key, time_h > 16 ORDER BY time_h) AS x FROM raw),
noise AS (SELECT curve_key, greatest(coalesce(CASE WHEN n0 >= 6 THEN 1.4826 * s0 WHEN n1 >= 6 THEN 1.4826 * s1 END, 0.005), 0.005) AS noise_level
          FROM (SELECT curve_key, count(*) FILTER (NOT late) AS n0, count(*) FILTER (late) AS n1, mad(x) FILTER (NOT late) AS s0, mad(x) FILTER (late) AS s1 FROM within GROUP BY curve_key))"""
LATE = "late AS (SELECT * FROM raw WHERE time_h > 16)"
SLOPES = "slopes AS (SELECT a.curve_key, median((b.od - a.od) / (b.time_h - a.time_h)) AS slope FROM late a JOIN late b ON a.curve_key = b.curve_key AND b.time_h > a.time_h GROUP BY 1)"
ARTIFACT = """st AS (SELECT *, od - lag(od) OVER w AS dy, time_h - lag(time_h) OVER w AS dt FROM late WINDOW w AS (PARTITION BY curve_key ORDER BY time_h)),
big AS (SELECT st.*, CASE WHEN abs(dy) > 2 * noise_level THEN sign(dy) END AS big FROM st JOIN noise USING (curve_key)),
big2 AS (SELECT *, last(big IGNORE NULLS) OVER (PARTITION BY curve_key ORDER BY time_h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_big FROM big),
art0 AS (SELECT curve_key, count(*) AS n, avg(od) AS mu, stddev_pop(od) AS sd, count(big) AS k, count(*) FILTER (big <> last_big) AS flips, regr_slope(od, time_h) AS slope, regr_r2(od, time_h) AS r2 FROM big2 GROUP BY curve_key),
art1 AS (SELECT curve_key, n, least(1.0, greatest(0.0, (sd / greatest(abs(mu), 1e-9) - 0.05) / (0.20 - 0.05))) AS cv_score, CASE WHEN k >= 2 THEN least(1.0, flips / (k - 1)) ELSE 0.0 END AS flip_score,
         CASE WHEN n >= 4 AND slope < -0.005 THEN least(1.0, greatest(0.0, coalesce(r2, 0))) ELSE 0.0 END AS decline_score FROM art0),
artifact AS (SELECT *, CASE WHEN n < 3 THEN 0.5 ELSE (cv_score + flip_score + decline_score) / 3 END AS artifact_score FROM art1)"""
NEEDED = """needed AS (SELECT curve_key, least(10, greatest(3, round_even((CASE WHEN n >= 2 AND span > 0 THEN (n - 1) / span ELSE 2.0 END) * 2.5, 0)))::INT AS m
           FROM (SELECT curve_key, count(*) AS n, max(time_h) - min(time_h) AS span FROM raw WHERE time_h <= 16 GROUP BY curve_key))"""
EVIDENCE = """spans AS (SELECT curve_key, count(*) AS n_late, max(time_h) - min(time_h) AS late_span, quantile_cont(dt, 0.5) FILTER (dt > 0) AS dt_med, arg_max(od, time_h) - arg_min(od, time_h) AS late_delta FROM st GROUP BY curve_key),
joined AS (SELECT a.curve_key, a.n_all, coalesce(s.n_late, 0) AS n, coalesce(m.m, 5) AS m, s.late_span, s.dt_med, s.late_delta, z.noise_level, t.slope, r.artifact_score, r.decline_score
           FROM (SELECT curve_key, count(*) AS n_all FROM raw GROUP BY 1) a LEFT JOIN needed m USING (curve_key) LEFT JOIN noise z USING (curve_key) LEFT JOIN spans s USING (curve_key) LEFT JOIN slopes t USING (curve_key) LEFT JOIN artifact r USING (curve_key)),
checked AS (SELECT *, n_all >= 3 AND n >= m AND coalesce(CASE WHEN late_span > 0 THEN greatest(0.0, round_even(late_span, 0) + 1 - n) / (round_even(late_span, 0) + 1) END, 0) <= 0.85 AS ok FROM joined),
scored AS (SELECT curve_key, n::BIGINT AS late_n_points, m::INT AS min_late_points_required, late_span AS late_span_hours, ok AS late_coverage_ok, CASE WHEN ok THEN noise_level END AS noise_level, CASE WHEN ok THEN slope END AS late_slope, CASE WHEN ok THEN late_delta END AS late_delta,
           CASE WHEN ok AND n >= 2 THEN least(50.0, abs(slope) / greatest(noise_level / coalesce(dt_med, 1), 1e-12)) ELSE 0.0 END AS growth_z_like, CASE WHEN ok THEN artifact_score ELSE 0.5 END AS artifact_score, CASE WHEN ok THEN decline_score ELSE 0.0 END AS decline_score,
           CASE WHEN NOT ok OR n < m THEN 0.0 ELSE (least(1.0, n / (2 * m)) + least(1.0, late_span / 4.0) + 1) / 3 END AS data_quality FROM checked),
evidence AS (SELECT *, greatest(0.0, least(1.0, data_quality * least(1.0, growth_z_like / 4.0) * (1 - artifact_score))) AS decision_confidence FROM scored)"""

VOTES = f"""members AS (SELECT curve_key, {U.format("'HGB|' || curve_key")} AS p_hgb, {U.format("'RF|' || curve_key")} AS p_rf, CASE WHEN {U.format("'gap|' || curve_key")} >= 0.2 THEN {U.format("'LR|' || curve_key")} END AS p_lr FROM (SELECT DISTINCT curve_key FROM obs)),
vote0 AS (SELECT *, (0.4 * p_hgb + 0.35 * p_rf + coalesce(0.25 * p_lr, 0)) / (0.4 + 0.35 + CASE WHEN p_lr IS NOT NULL THEN 0.25 ELSE 0 END) AS p FROM members),
votes AS (SELECT curve_key, round(p, 4) AS confidence_valid, CASE WHEN p >= 0.5 THEN 'Valid' ELSE 'Invalid' END AS pred_label, round(greatest(p, 1 - p), 4) AS pred_confidence FROM vote0)"""
STATUS = """status AS (SELECT *, CASE WHEN data_quality < 0.3 THEN 'Insufficient' WHEN pred_label = 'Invalid' AND growth_z_like >= 2 AND artifact_score < 0.7 THEN 'Contradiction' WHEN pred_label = 'Invalid' THEN 'Corroborated'
           WHEN artifact_score >= 0.7 OR decline_score >= 0.7 THEN 'Contradiction' ELSE 'Corroborated' END AS stage2_label,
           CASE WHEN data_quality < 0.3 THEN 'S2_INSUFFICIENT_DATA_QUALITY' WHEN pred_label = 'Invalid' AND growth_z_like >= 2 AND artifact_score < 0.7 THEN 'S2_CONTRADICTORY_LATE_GROWTH' WHEN pred_label = 'Invalid' THEN 'S2_CORROBORATES_INVALID'
           WHEN artifact_score >= 0.7 THEN 'S2_ARTIFACT_DETECTED' WHEN decline_score >= 0.7 THEN 'S2_LATE_DECLINE_DETECTED' WHEN growth_z_like >= 2 THEN 'S2_CONTINUED_GROWTH' ELSE 'S2_STABLE_OR_PLATEAU' END AS code
           FROM votes JOIN evidence USING (curve_key)),
assigned AS (SELECT *, least(confidence_valid, 1 - confidence_valid) > 0.30 + 1e-9 AS shaky FROM status),
labelled AS (SELECT *, CASE WHEN shaky THEN 'S1_LOW_CONFIDENCE: Confidence(' || pred_label || ') = ' || printf('%.2f', ((round(confidence_valid * 10000)::BIGINT + 50) // 100) / 100.0) WHEN stage2_label = 'Contradiction' THEN code || ': Confidence(' || pred_label || ') = ' || printf('%.2f', ((round(pred_confidence * 10000)::BIGINT + 50) // 100) / 100.0) ELSE code END AS label_reason,
             CASE WHEN shaky OR stage2_label = 'Contradiction' THEN 'Unsure' ELSE pred_label END AS final_label FROM assigned)"""
ALL_FEATURES = _with(OBS, "points AS (SELECT curve_key, time_h, avg(od) AS od FROM obs WHERE time_h <= 16 GROUP BY ALL)", GRID.replace("FROM obs)", "FROM obs WHERE time_h <= 16)"), SEEN, SMOOTHED, MINMAX, STATS.format(source="(SELECT * FROM obs WHERE time_h <= 16)"), FEATURES)
FINAL = ALL_FEATURES.rstrip() + ",\n" + ",\n".join([RAW, NOISE, LATE, SLOPES, ARTIFACT, NEEDED, EVIDENCE, VOTES, STATUS]) + """,
overridden AS (SELECT l.curve_key, pred_label, stage2_label,
    CASE WHEN too_sparse = 1 THEN 'TOO_SPARSE_OVERRIDE' WHEN lacking > 0.25 THEN 'FEATURE_COMPLETENESS_OVERRIDE' WHEN gap THEN 'OUT_OF_DISTRIBUTION_GAP_OVERRIDE' ELSE label_reason END AS label_reason,
    CASE WHEN too_sparse = 1 OR lacking > 0.25 OR gap THEN 'Unsure' ELSE final_label END AS final_label
    FROM labelled l JOIN (SELECT *, coalesce(max_gap_hours > 10 OR missing_frac_on_grid > 0.85, false) AS gap, ((largest_drop_frac IS NULL)::INT + (auc_per_hour IS NULL)::INT + (growth_phase_duration IS NULL)::INT + (multi_phase_flag IS NULL)::INT + (max_slope IS NULL)::INT
        + (final_OD IS NULL)::INT + (net_change_per_hour IS NULL)::INT + (lag_time_est IS NULL)::INT + (roughness IS NULL)::INT + (max_gap_hours IS NULL)::INT) / 10.0 AS lacking FROM feats) f USING (curve_key))
"""
LATE_ALL = _with(OBS, RAW, NOISE, LATE, SLOPES, ARTIFACT, NEEDED, EVIDENCE, VOTES, STATUS)
METRIC_ROWS = f"""rows AS (SELECT d.doc_id, d.lang, d.source, l.quality AS y, {U.format("'p|' || d.doc_id")} AS p, ({U.format("'p|' || d.doc_id")} >= 0.5)::INT AS predicted FROM documents d JOIN labels l USING (doc_id) WHERE l.quality IS NOT NULL)"""
RESPONSES = "responses AS (SELECT test_id, concentration, max(od) AS a, avg(od_raw) AS m FROM obs GROUP BY curve_key, test_id, concentration)"

RATES = """CASE WHEN tp + fn > 0 AND tn + fp > 0 THEN (coalesce(tp / nullif(tp + fn, 0), 0) + coalesce(tn / nullif(tn + fp, 0), 0)) / 2 ELSE greatest(coalesce(tp / nullif(tp + fn, 0), 0), coalesce(tn / nullif(tn + fp, 0), 0)) END"""

FEATURE_COLUMNS = (
    "SELECT curve_key, round(observed_tmax, 6) AS observed_tmax, n_points_observed, round(max_gap_hours, 6) AS max_gap_hours, round(missing_frac_on_grid, 6) AS missing_frac_on_grid, too_sparse, grid_resolution_mismatch, train_horizon, noise_residual_std_is_fallback, is_censored, "
    + ", ".join(f"round({c}, 5) AS {c}" for c in "initial_OD final_OD auc auc_per_hour net_change_per_hour max_slope time_of_max_slope time_of_max_OD monotonicity_fraction largest_drop_frac roughness noise_residual_std lag_time_est plateau_OD growth_phase_duration symmetry_factor".split()) + ", num_slope_sign_changes, multi_phase_flag FROM feats"
)
PICKED = "picked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY curve_key ORDER BY " + U.format("'42|' || curve_key || '|' || ht") + ", h) AS r FROM (SELECT DISTINCT curve_key FROM obs0), (SELECT unnest([8.0, 10.0, 12.0, 14.5, 16.0]) AS h, unnest(['8', '10', '12', '14.5', '16']) AS ht)) WHERE r <= 3)"
TRUNCATED = "obs AS (SELECT o.curve_key || '_H' || ht AS curve_key, time_h, od FROM obs0 o JOIN picked USING (curve_key) WHERE time_h <= h + 1e-9)"
TRUNCATED_FEATURES = _with(OBS.replace("obs AS", "obs0 AS", 1), PICKED, TRUNCATED, POINTS, GRID, SEEN, SMOOTHED, MINMAX, STATS.format(source="obs").replace("n_points < 4", "n_points < 3"), FEATURES)
AUDIT_FEATURES = "observed_tmax auc largest_drop_frac plateau_OD".split()
AUDIT = FINAL.rstrip() + """
SELECT o.curve_key, any_value(o.test_id) AS test_id, any_value(o.concentration) AS concentration, any_value(v.pred_label) AS pred_label, any_value(v.final_label) AS final_label, any_value(v.label_reason) AS label_reason,
       """ + ", ".join(f"round(any_value(f.{c}), 5) AS {c}" for c in AUDIT_FEATURES) + """, any_value(p.n) AS n_processed, round(any_value(p.total), 4) AS processed_sum, any_value(v.final_label) AS true_label
FROM obs o LEFT JOIN overridden v USING (curve_key) LEFT JOIN feats f USING (curve_key) LEFT JOIN (SELECT curve_key, count(*)::INT AS n, sum(od) AS total FROM normed GROUP BY 1) p USING (curve_key) GROUP BY o.curve_key"""

SQL = {
    "curve_point_stats": _with(OBS, STATS.format(source="obs")) + "SELECT curve_key, n_points, round(max_gap, 6) AS max_gap, round(span, 6) AS span, expected, round(missing_frac, 6) AS missing_frac, too_sparse FROM stats",
    "dedupe_mean_long": "SELECT user_id, date_trunc('day', ts) AS day, round(avg(value), 6) AS mean_value, count(*) AS n FROM events GROUP BY ALL",
    "long_to_wide": GRIDDED + "SELECT curve_key, " + ", ".join(f"round(max(od) FILTER (time_h = {t}), 6) AS t{t}" for t in (0, 4, 8, 12, 16)) + " FROM grid GROUP BY curve_key",
    "wide_to_long": "SELECT l_returnflag, measure, count(*) AS n, round(avg(v), 4) AS mean_value FROM (UNPIVOT (SELECT l_returnflag, l_quantity, l_discount, l_tax FROM lineitem) ON l_quantity, l_discount, l_tax INTO NAME measure VALUE v) GROUP BY ALL",
    "conc_from_id": "SELECT user_id, s AS curve_id, try_cast(regexp_extract(s, '(?i)\\[(?:\\s*conc\\s*=\\s*)?([0-9]+(?:\\.[0-9]+)?)\\s*\\]', 1) AS DOUBLE) AS conc FROM (SELECT DISTINCT user_id, CASE user_id % 4 WHEN 0 THEN 'A' || user_id || '[Conc=' || user_id / 4 || ']' WHEN 1 THEN 'B[ ' || user_id || ' ]' WHEN 2 THEN 'C[x]' ELSE 'D' || user_id END AS s FROM events)",
    "duration_to_hours": "SELECT event_id, CASE event_id % 4 WHEN 0 THEN (event_id % 24) + (event_id % 60) / 60.0 WHEN 1 THEN (event_id % 90) / 60.0 WHEN 2 THEN (event_id % 50) + 0.5 ELSE 0.0 END AS hours FROM events",
    "time_unit_inference": "SELECT user_id, user_id % 3 AS unit, max(d) AS span_hours FROM (SELECT user_id, ((row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) * 0.5)::DOUBLE AS d FROM events) GROUP BY user_id",
    "curve_key_attach": "SELECT DISTINCT user_id, CASE WHEN user_id % 3 = 0 THEN 'U' || user_id || '[Conc=1]' WHEN user_id % 3 = 1 THEN 'U' || user_id ELSE 'U' || user_id || '||' || ['0', '0.1', '0.3', '1', '3', '10', '30', '100'][(user_id % 8) + 1] END AS curve_key FROM events",
    "grid_interpolate": GRIDDED + "SELECT curve_key, grid_ix, time_h, round(od, 6) AS od FROM grid",
    "grid_missing": GRIDDED + "SELECT curve_key, count(od) AS n_filled, count(*) FILTER (od IS NULL) AS n_missing FROM grid GROUP BY curve_key",
    "baseline_correct": GRIDDED + "SELECT curve_key, time_h, round(greatest(od - b, 0), 6) AS od FROM seen JOIN (SELECT curve_key, quantile_cont(od, 0.5) AS b FROM (SELECT *, row_number() OVER (PARTITION BY curve_key ORDER BY time_h) AS i FROM seen) WHERE i <= 5 GROUP BY 1) USING (curve_key)",
    "rolling_smooth": _with(OBS, POINTS, GRID, SEEN, ROLLED) + "SELECT curve_key, time_h, round(od, 6) AS od FROM rolled",
    "savgol_smooth": _with(OBS, POINTS, GRID, SEEN, SMOOTHED) + "SELECT curve_key, time_h, round(od, 6) AS od FROM smoothed",
    "max_normalize": GRIDDED + "SELECT curve_key, time_h, round(CASE WHEN hi > 0 THEN od / hi ELSE od END, 6) AS od FROM (SELECT *, max(od) OVER (PARTITION BY curve_key) AS hi FROM seen)",
    "minmax_normalize": _with(OBS, POINTS, GRID, SEEN, "smoothed AS (SELECT * FROM seen)", MINMAX) + "SELECT curve_key, time_h, round(od, 6) AS od FROM normed",
    "preprocess_chain": _with(OBS, POINTS, GRID, SEEN, SMOOTHED, MINMAX) + "SELECT curve_key, time_h, round(od, 6) AS od FROM normed",
    "features_all": ALL_FEATURES + FEATURE_COLUMNS,
    "truncated_features": TRUNCATED_FEATURES + FEATURE_COLUMNS,
    "audit_join": AUDIT,
    "mad_noise": _with(OBS, RAW, NOISE) + "SELECT curve_key, round(noise_level, 6) AS noise_level FROM noise",
    "theil_sen": _with(OBS, RAW, LATE, SLOPES) + "SELECT curve_key, round(slope, 6) AS slope FROM slopes",
    "artifact_score": _with(OBS, RAW, NOISE, LATE, ARTIFACT) + "SELECT curve_key, round(cv_score, 6) AS cv_score, round(flip_score, 6) AS flip_score, round(decline_score, 6) AS decline_score, round(artifact_score, 6) AS artifact_score FROM artifact",
    "dynamic_min_points": _with(OBS, RAW, NEEDED) + "SELECT curve_key, m AS min_late_points_required FROM needed",
    "stage2_evidence": LATE_ALL + "SELECT curve_key, late_n_points, min_late_points_required, round(late_span_hours, 6) AS late_span_hours, late_coverage_ok, round(noise_level, 6) AS noise_level, round(late_slope, 6) AS late_slope, round(late_delta, 6) AS late_delta, round(growth_z_like, 5) AS growth_z_like, round(artifact_score, 6) AS artifact_score, round(decline_score, 6) AS decline_score, round(data_quality, 6) AS data_quality, round(decision_confidence, 6) AS decision_confidence FROM evidence",
    "ensemble_vote": _with(OBS, VOTES) + "SELECT curve_key, confidence_valid, pred_label, pred_confidence FROM votes",
    "stage2_status": LATE_ALL + "SELECT curve_key, pred_label, stage2_label, label_reason, final_label FROM labelled",
    "final_labels": FINAL + "SELECT curve_key, pred_label, stage2_label, label_reason, final_label FROM overridden",
    "validity_join": FINAL + "SELECT o.curve_key, count(*) AS n, count(*) FILTER (v.final_label = 'Valid') AS n_valid FROM obs o LEFT JOIN overridden v USING (curve_key) GROUP BY 1",
    "membership_filter": FINAL + "SELECT curve_key, count(*) AS n FROM obs WHERE curve_key IN (SELECT curve_key FROM overridden WHERE final_label IN ('Valid', 'Unsure')) GROUP BY 1",
    "label_counts": FINAL + "SELECT final_label AS label, count(*) AS n FROM overridden GROUP BY 1",
    "review_curves": FINAL + "SELECT curve_key, nullif(regexp_extract(curve_key, '(?i)\\[(?:\\s*conc\\s*=\\s*)?([0-9]+(?:\\.[0-9]+)?)\\s*\\]', 1), '')::DOUBLE AS concentration, o.final_label AS true_label, false AS reviewed, v.pred_label, v.pred_confidence, v.confidence_valid FROM overridden o LEFT JOIN votes v USING (curve_key) WHERE o.final_label <> 'Unsure'",
    "run_stability": _with(METRIC_ROWS) + "SELECT model, metric, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS std, round(min(value), 6) AS min, round(max(value), 6) AS max FROM (UNPIVOT (SELECT lang AS model, source, avg((y = predicted)::INT) AS accuracy, avg(p) AS mean_score FROM rows GROUP BY 1, 2) ON accuracy, mean_score INTO NAME metric VALUE value) GROUP BY 1, 2",
    "label_resolution": "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'Valid' WHEN 1 THEN 'Invalid' WHEN 2 THEN 'Unsure' WHEN 3 THEN 'Valid' WHEN 4 THEN 'Invalid' ELSE NULL END AS label FROM labels",
    "truncate_augment": _with(OBS, f"picked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY curve_key ORDER BY {U.format(chr(39) + '42|' + chr(39) + ' || curve_key || ' + chr(39) + '|' + chr(39) + ' || ht')}, h) AS r FROM (SELECT DISTINCT curve_key FROM obs), (SELECT unnest([8.0, 10.0, 12.0, 14.5, 16.0]) AS h, unnest(['8', '10', '12', '14.5', '16']) AS ht)) WHERE r <= 3)") + "SELECT curve_key || '_H' || ht AS aug_id, o.curve_key AS base_curve_id, h::DOUBLE AS train_horizon, count(*) AS n, h < any_value(tm) - 1e-9 AS is_censored FROM (SELECT *, max(time_h) OVER (PARTITION BY curve_key) AS tm FROM obs) o JOIN picked USING (curve_key) WHERE time_h <= h + 1e-9 GROUP BY o.curve_key, h, ht",
    "class_metrics_by_slice": _with(METRIC_ROWS) + f"SELECT slice, slice_value, tp, fp, fn, tn, n, round({RATES}, 6) AS balanced_accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM (SELECT CASE WHEN grouping(lang) = 0 THEN 'lang' WHEN grouping(source) = 0 THEN 'source' ELSE 'overall' END AS slice, CASE WHEN grouping(lang) = 0 THEN coalesce(lang, 'null') WHEN grouping(source) = 0 THEN coalesce(source, 'null') ELSE 'all' END AS slice_value, count(*) FILTER (y = 1 AND predicted = 1) AS tp, count(*) FILTER (y = 0 AND predicted = 1) AS fp, count(*) FILTER (y = 1 AND predicted = 0) AS fn, count(*) FILTER (y = 0 AND predicted = 0) AS tn, count(*) AS n FROM rows GROUP BY GROUPING SETS ((), (lang), (source)) HAVING count(*) >= 5)",
    "roc_auc": _with(METRIC_ROWS) + "SELECT lang, round(sum(CASE WHEN y = 1 THEN r - 0.0 END) / nullif(sum(y) * (count(*) - sum(y)), 0) - (sum(y) + 1) / 2.0 / nullif(count(*) - sum(y), 0), 6) AS roc_auc FROM (SELECT *, rank() OVER (PARTITION BY lang ORDER BY p) + (count(*) OVER (PARTITION BY lang, p) - 1) / 2.0 AS r FROM rows) GROUP BY lang",
    "average_precision": _with(METRIC_ROWS) + "SELECT lang, round(CASE WHEN sum(y) > 0 AND sum(y) < count(*) THEN sum(y * tp / k) / sum(y) END, 6) AS average_precision FROM (SELECT *, sum(y) OVER w AS tp, count(*) OVER w AS k FROM rows WINDOW w AS (PARTITION BY lang ORDER BY p DESC RANGE UNBOUNDED PRECEDING)) GROUP BY lang",
    "class_weights": _with(METRIC_ROWS) + "SELECT y AS label, count(*) AS n, round((SELECT count(*) FROM rows) / ((SELECT count(DISTINCT y) FROM rows) * count(*)), 6) AS weight FROM rows GROUP BY y",
    "group_split": _with(METRIC_ROWS).rstrip() + """, ranked AS (SELECT source, row_number() OVER (ORDER BY h) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT source, ('0x' || substr(md5('42|' || source), 1, 15))::BIGINT AS h FROM rows)),
named AS (SELECT source, CASE WHEN k <= ceil(0.2 * n) THEN 'test' WHEN k <= ceil(0.2 * n) + ceil(0.25 * (n - ceil(0.2 * n))) THEN 'val' ELSE 'train' END AS split FROM ranked)
SELECT source, split, count(*) AS n FROM rows JOIN named USING (source) GROUP BY 1, 2""",
    "bootstrap_mean_ci": _with(OBS).rstrip() + ", pts AS (SELECT curve_key AS k, (row_number() OVER (PARTITION BY curve_key ORDER BY time_h, event_id) - 1)::INT AS ix, od_raw AS v FROM obs), sizes AS (SELECT k, count(*) AS n FROM pts GROUP BY k), draws AS (SELECT k, r, (('0x' || substr(md5('42|' || k || '|' || r || '|' || d), 1, 8))::BIGINT % n)::INT AS ix FROM sizes, (SELECT unnest(range(0, 50)) AS r), LATERAL (SELECT unnest(range(0, n)) AS d)), means AS (SELECT k, r, avg(v) AS m FROM draws JOIN pts USING (k, ix) GROUP BY k, r) SELECT k AS curve_key, count(*) AS n, round(avg(m) + 1e-9, 6) AS mean, round(stddev_samp(m) + 1e-9, 6) AS sd, round(quantile_cont(m, 0.025) + 1e-9, 6) AS ci_lo, round(quantile_cont(m, 0.975) + 1e-9, 6) AS ci_hi FROM means GROUP BY k",
    "gap_augment": _with(OBS, f"""few AS (SELECT * FROM obs WHERE time_h <= 16),
copies AS (SELECT curve_key, rep, CASE WHEN {U.format("'42|kind|' || curve_key || '|' || rep")} < 0.5 THEN 'B' ELSE 'S' END AS gap_kind, 2 + 4 * {U.format("'42|len|' || curve_key || '|' || rep")} AS gap_len, {U.format("'42|at|' || curve_key || '|' || rep")} AS gap_at, 0.4 + 0.4 * {U.format("'42|drop|' || curve_key || '|' || rep")} AS share
           FROM (SELECT DISTINCT curve_key FROM few WHERE {U.format("'42|pick|' || curve_key")} < 0.3), (SELECT unnest([1, 2]) AS rep)),
placed AS (SELECT curve_key, rep, gap_kind, count(*) AS n, count(*) FILTER (time_h > start AND time_h < start + gap_len) AS inside, any_value(share) AS share
           FROM (SELECT *, lo + gap_at * greatest(hi - lo - gap_len, 0) AS start FROM (SELECT *, min(time_h) OVER (PARTITION BY curve_key, rep) AS lo, max(time_h) OVER (PARTITION BY curve_key, rep) AS hi FROM few JOIN copies USING (curve_key))) GROUP BY ALL)
SELECT curve_key || '_GAP' || rep || gap_kind AS aug_id, curve_key AS base_curve_id, gap_kind, (n - greatest(0, least(CASE WHEN gap_kind = 'B' THEN inside ELSE floor(share * n)::BIGINT END, n - 4)))::BIGINT AS n FROM placed""").rstrip(),
    "model_curve_eval": _with(OBS) + "SELECT curve_key, round(t, 6) AS t, round(0.1 + 2 / (1 + exp(4 * 0.5 / 2 * (3 - t) + 2)), 6) AS logistic, round(0.1 + 2 * exp(-exp(exp(1.0) * 0.5 / 2 * (3 - t) + 1)), 6) AS gompertz FROM (SELECT curve_key, time_h AS t FROM obs)",
    "aic_table": _with(OBS) + "SELECT curve_key, n, round(n * ln(greatest(rss, 1e-12) / n) + 4, 6) AS aic, round(n * ln(greatest(rss, 1e-12) / n) + 2 * ln(n), 6) AS bic FROM (SELECT curve_key, count(*) AS n, sum(pow(od - (s * time_h + i), 2)) AS rss FROM obs JOIN (SELECT curve_key, regr_slope(od, time_h) AS s, regr_intercept(od, time_h) AS i FROM obs GROUP BY 1) USING (curve_key) GROUP BY curve_key)",
    "dr_response_table": _with(OBS, RESPONSES) + "SELECT test_id, concentration, count(*) AS n, round(avg(a), 6) AS response FROM responses GROUP BY ALL",
    "conc_span": _with(OBS, RESPONSES) + "SELECT test_id, count(DISTINCT concentration) AS n_conc, round(log10(max(concentration) / min(concentration) FILTER (concentration > 0)), 6) AS span, coalesce(log10(max(concentration) / min(concentration) FILTER (concentration > 0)) >= 2, false) AS log_advisable, CASE WHEN count(DISTINCT concentration) < 6 THEN 'too_few_conc_points_' || count(DISTINCT concentration) END AS reason FROM responses GROUP BY 1",
    "ec50_linear_crossing": _with(OBS, RESPONSES) + "SELECT test_id, round(min(c), 6) AS ec50, round(any_value(middle), 6) AS middle, count(*) AS n_crossings FROM (SELECT test_id, middle, concentration + (middle - y) / (y1 - y) * (c1 - concentration) AS c FROM (SELECT *, lead(concentration) OVER w AS c1, lead(y) OVER w AS y1, (first(y) OVER (PARTITION BY test_id ORDER BY concentration ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) + last(y) OVER (PARTITION BY test_id ORDER BY concentration ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) / 2 AS middle FROM (SELECT test_id, concentration, avg(a) AS y FROM responses GROUP BY 1, 2) WINDOW w AS (PARTITION BY test_id ORDER BY concentration)) WHERE c1 IS NOT NULL AND (y - middle) * (y1 - middle) <= 0 AND y <> y1) GROUP BY 1",
}
