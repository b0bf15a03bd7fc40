"""SQL (DuckDB) that states the results of the catalogue, written from the definitions and not from the DataFrames."""

from __future__ import annotations

from statistics import NormalDist

from stockweave import params

#: Columns in money or volume: rounded to 2 digits, all other doubles to 6.
MONEY = frozenset("revenue units y y_ref demand abs_err err avg_inv_value avg_inv_units inv_classic inv_average weight Clasica SeasonalNaive_value mean_demand middle forecast_28d valor".split())

CTES: dict[str, str] = {}
#: Parts that several others read, or that a join would repeat: worked out once.
SHARED = frozenset({"dense", "sales", "cv", "marg", "basis", "plan", "eval"})
ORACLES: dict[str, str] = {}


def oracle(name: str, ctes: str, select: str, doubles: str = "") -> None:
    """ctes: names of the first-level parts that select needs, in order."""
    wanted = [f"{c} AS {'MATERIALIZED ' if c in SHARED else ''}({CTES[c]})" for c in ctes.split()]
    replace = ", ".join(f'round("{c}", {2 if c in MONEY else 6}) AS "{c}"' for c in doubles.split())
    ORACLES[name] = f"WITH RECURSIVE {', '.join(wanted)} SELECT * {f'REPLACE ({replace})' if replace else ''} FROM ({select})"


CTES["lines"] = """SELECT p_brand || '_' || p_type AS unique_id, p_brand AS item_id, p_type AS dept_id, CAST(l_shipdate AS DATE) AS ds, l_quantity AS quantity, CAST(round(p_retailprice * (1 - l_discount) * 10000) AS BIGINT) AS price
    FROM lineitem JOIN part ON l_partkey = p_partkey WHERE CAST(l_shipdate AS DATE) <= (SELECT max(CAST(o_orderdate AS DATE)) FROM orders)"""
CTES["spine"] = "SELECT unique_id, item_id, dept_id, CAST(unnest(generate_series(min(ds), (SELECT max(CAST(o_orderdate AS DATE)) FROM orders), INTERVAL 1 DAY)) AS DATE) AS ds FROM lines GROUP BY unique_id, item_id, dept_id"
CTES["dense"] = """SELECT s.*, coalesce(q.y, 0.0) AS y, CAST(floor((s.ds - DATE '1994-12-31') / 7.0) AS INTEGER) AS wm_yr_wk
    FROM spine s LEFT JOIN (SELECT unique_id, ds, sum(quantity) AS y FROM lines GROUP BY ALL) q USING (unique_id, ds)"""
CTES["weekprice"] = """SELECT unique_id, wm_yr_wk, last_value(p IGNORE NULLS) OVER (PARTITION BY unique_id ORDER BY wm_yr_wk ROWS UNBOUNDED PRECEDING) AS sell_price FROM
    (SELECT DISTINCT unique_id, wm_yr_wk FROM dense) LEFT JOIN (SELECT unique_id, CAST(floor((ds - DATE '1994-12-31') / 7.0) AS INTEGER) AS wm_yr_wk, CAST((sum(price) * 64) // (count(*) * 10000) AS DOUBLE) / 64 AS p FROM lines GROUP BY ALL) USING (unique_id, wm_yr_wk)"""
_CASES = lambda k: "CASE " + " ".join(f"WHEN month(ds) = {m} AND day(ds) = {d} THEN '{(n, t)[k]}'" for m, d, n, t in params.EVENTS) + " END"
CTES["sales"] = f"""SELECT unique_id, ds, y, item_id, dept_id, wm_yr_wk, CAST(day(ds) <= 10 AS INTEGER) AS snap, {_CASES(0)} AS event_name_1, {_CASES(1)} AS event_type_1, sell_price
    FROM dense JOIN weekprice USING (unique_id, wm_yr_wk)"""
P = "lines spine dense weekprice sales"

oracle("sales_long", P, "SELECT * FROM sales", "y sell_price")
CTES["days"] = "SELECT ds, sum(y) AS y, max(event_name_1) AS event_name_1, max(event_type_1) AS event_type_1, max(snap) AS snap FROM sales GROUP BY ds"
oracle("panel_overview", P, """SELECT count(*) AS n_series, CAST(sum(n) AS BIGINT) AS n_rows, count(DISTINCT dept_id) AS n_depts, min(lo) AS first_day, max(hi) AS last_day, sum(u) AS units, sum(z) / sum(n) AS zero_share, median(n) AS median_days, quantile_cont(n, 0.1) AS p10_days
    FROM (SELECT unique_id, count(*) AS n, sum(y) AS u, count(*) FILTER (y = 0) AS z, min(ds) AS lo, max(ds) AS hi, any_value(dept_id) AS dept_id FROM sales GROUP BY 1)""", "units zero_share median_days p10_days")
oracle("weekly_demand", P + " days", """SELECT week_end, units FROM (SELECT CAST(ds + CAST((7 - isodow(ds)) AS INTEGER) AS DATE) AS week_end, sum(y) AS units FROM days GROUP BY 1)
    QUALIFY week_end > min(week_end) OVER () AND week_end < max(week_end) OVER ()""", "units")
oracle("quiet_days", P + " days", "SELECT ds, y FROM days WHERE 2 * y < (SELECT median(y) FROM days)", "y")
oracle("closed_days", P + " days", "SELECT ds, y FROM days WHERE y < 0.05::DOUBLE * (SELECT median(y) FROM days)", "y")
oracle("dow_index", P + " days", """SELECT CAST(isodow(ds) - 1 AS INTEGER) AS weekday, avg(y) AS mean_y, avg(y) / avg(avg(y)) OVER () AS "index" FROM days GROUP BY 1""", "mean_y index")
oracle("snap_lift", P + " days", """SELECT CAST(isodow(ds) - 1 AS INTEGER) AS weekday, avg(y) FILTER (snap = 1) AS with_snap, avg(y) FILTER (snap = 0) AS without_snap, avg(y) FILTER (snap = 1) / nullif(avg(y) FILTER (snap = 0), 0) - 1 AS lift FROM days GROUP BY 1""", "with_snap without_snap lift")
oracle("event_profile", P + " days", """SELECT e.event_type_1 AS event_type, o.k AS "offset", median(i.v) AS median_index
    FROM (SELECT ds, event_type_1 FROM days WHERE event_name_1 IS NOT NULL) e, (SELECT CAST(unnest(range(-7, 4)) AS INTEGER) AS k) o,
    (SELECT d.ds, d.y / nullif((SELECT avg(b.y) FROM days b WHERE b.ds <> d.ds AND abs(b.ds - d.ds) <= 28 AND (b.ds - d.ds) % 7 = 0), 0) AS v FROM days d) i WHERE i.ds = e.ds + o.k GROUP BY ALL""", "median_index")
oracle("price_response", P, """SELECT bucket, sum(y) AS y, sum(yr) AS y_ref, count(*) AS obs, sum(y) / nullif(sum(yr), 0) AS "index", count(*) / sum(count(*)) OVER () AS share FROM (
    SELECT y, yr, CASE WHEN sell_price / pr <= 0.85::DOUBLE THEN '< -15%' WHEN sell_price / pr <= 0.95::DOUBLE THEN '-15 a -5%' WHEN sell_price / pr <= 0.99::DOUBLE THEN '-5 a -1%' WHEN sell_price / pr <= 1.01::DOUBLE THEN 'sin cambio' WHEN sell_price / pr <= 1.05::DOUBLE THEN '+1 a +5%' ELSE '> +5%' END AS bucket
    FROM (SELECT *, avg(sell_price) OVER w AS pr, avg(y) OVER w AS yr, count(*) OVER w AS n FROM sales WINDOW w AS (PARTITION BY unique_id ORDER BY ds ROWS BETWEEN 91 PRECEDING AND 1 PRECEDING)) WHERE n >= 28) GROUP BY bucket""", "y y_ref index share")
oracle("wide_unpivot", P, "SELECT 'd_' || day(ds) AS d, count(*) AS n, CAST(sum(y) AS BIGINT) AS units FROM sales GROUP BY 1")
oracle("unpivot_price_join", P, "SELECT unique_id, count(*) AS n, sum(y * p) AS revenue FROM (SELECT unique_id, y, min(sell_price) OVER (PARTITION BY unique_id, date_trunc('month', ds)) AS p FROM sales) GROUP BY 1", "revenue")
oracle("future_exog", P, f"""SELECT unique_id, item_id, dept_id, ds, CAST(floor((ds - DATE '1994-12-31') / 7.0) AS INTEGER) AS wm_yr_wk, CAST(day(ds) <= 10 AS INTEGER) AS snap, {_CASES(0)} AS event_name_1, {_CASES(1)} AS event_type_1, sell_price
    FROM (SELECT unique_id, item_id, dept_id, arg_max(sell_price, ds) AS sell_price FROM sales GROUP BY 1, 2, 3), (SELECT CAST(last + CAST(unnest(range(1, 29)) AS INTEGER) AS DATE) AS ds FROM (SELECT max(ds) AS last FROM sales))""", "sell_price")
oracle("min_history_filter", P, "SELECT unique_id, count(*) AS n FROM sales GROUP BY 1 HAVING count(*) >= (SELECT max(n) FROM (SELECT count(*) AS n FROM sales GROUP BY unique_id))")

oracle("raw_round_trip", P, """SELECT unique_id, dept_id, count(*) AS n_days, sum(y) AS units, sum(y * sell_price) AS revenue, min(ds) AS first_day, max(ds) AS last_day, count(event_name_1) AS event_days, CAST(sum(snap) AS BIGINT) AS snap_days,
    CAST(0 AS BIGINT) AS rejected_lines FROM sales GROUP BY 1, 2""", "units revenue")


def _classes(days_before: int) -> dict[str, str]:
    """The parts of the classes as of some days before the panel's end."""
    return {
        "cl_win": f"SELECT s.*, e.end_day FROM sales s, (SELECT max(ds) - {days_before} AS end_day FROM sales) e WHERE s.ds > e.end_day - 365 AND s.ds <= e.end_day",
        "cl_week": "SELECT i.unique_id, w.week, coalesce(sum(x.y), 0) AS v FROM (SELECT DISTINCT unique_id FROM cl_win) i CROSS JOIN (SELECT unnest(range(52)) AS week) w LEFT JOIN cl_win x ON x.unique_id = i.unique_id AND (x.end_day - x.ds) // 7 = w.week GROUP BY ALL",
        "cl_base": """SELECT unique_id, sum(y * sell_price) AS revenue, sum(y) AS units, avg(y) AS mean_daily, arg_max(sell_price, ds) AS price, count(*) FILTER (y = 0) / count(*) AS zero_share, any_value(c) AS cv_weekly,
            CASE WHEN count(*) FILTER (y > 0) > 0 THEN count(*) / count(*) FILTER (y > 0) ELSE 'Infinity'::DOUBLE END AS adi, coalesce(pow(stddev_pop(y) FILTER (y > 0) / avg(y) FILTER (y > 0), 2), 0) AS cv2
            FROM cl_win JOIN (SELECT unique_id, CASE WHEN avg(v) > 0 THEN stddev_samp(v) / avg(v) END AS c FROM cl_week GROUP BY 1) USING (unique_id) GROUP BY 1""",
        "classes": """SELECT *, abc || xyz AS segment, CASE WHEN adi < 1.32 AND cv2 < 0.49 THEN 'suave' WHEN adi < 1.32 THEN 'errática' WHEN cv2 < 0.49 THEN 'intermitente' ELSE 'irregular' END AS pattern FROM (
            SELECT *, CASE WHEN total <= 0 OR before / total < 0.8 THEN 'A' WHEN before / total < 0.95 THEN 'B' ELSE 'C' END AS abc, revenue / nullif(total, 0) AS revenue_share, CASE WHEN cv_weekly <= 0.5 THEN 'X' WHEN cv_weekly <= 1 THEN 'Y' ELSE 'Z' END AS xyz
            FROM (SELECT *, sum(revenue) OVER () AS total, coalesce(sum(revenue) OVER (ORDER BY revenue DESC, unique_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM cl_base))""",
    }


CTES |= _classes(0)
C = P + " cl_win cl_week cl_base classes"
oracle("sku_classes", C, "SELECT unique_id, revenue, units, mean_daily, price, zero_share, cv_weekly, adi, cv2, abc, revenue_share, xyz, segment, pattern FROM classes", "revenue units mean_daily price zero_share cv_weekly adi cv2 revenue_share")
CTES["part_lines"] = """SELECT CAST(l_partkey AS VARCHAR) AS unique_id, CAST(l_shipdate AS DATE) AS ds, l_quantity AS y, l_quantity * CAST(round(p_retailprice * (1 - l_discount) * 10000) AS BIGINT) AS paid
    FROM lineitem JOIN part ON l_partkey = p_partkey WHERE CAST(l_shipdate AS DATE) <= (SELECT max(CAST(o_orderdate AS DATE)) FROM orders)"""
CTES["part_days"] = """SELECT unique_id, end_day, CAST(unnest(generate_series(greatest(first_day, end_day - 364), end_day, INTERVAL 1 DAY)) AS DATE) AS ds
    FROM (SELECT unique_id, CAST(min(ds) AS TIMESTAMP) AS first_day FROM part_lines GROUP BY 1) JOIN (SELECT max(CAST(o_orderdate AS DATE)) AS end_day FROM orders) ON true"""
CTES["part_win"] = "SELECT d.*, coalesce(q.y, 0.0) AS y, coalesce(q.paid, 0.0) AS paid FROM part_days d LEFT JOIN (SELECT unique_id, ds, sum(y) AS y, sum(paid) AS paid FROM part_lines GROUP BY ALL) q USING (unique_id, ds)"
CTES["part_weeks"] = """SELECT unique_id, CASE WHEN avg(v) > 0 THEN stddev_samp(v) / avg(v) END AS c FROM (SELECT i.unique_id, week, coalesce(v, 0.0) AS v FROM (SELECT DISTINCT unique_id FROM part_win) i CROSS JOIN (SELECT unnest(range(52)) AS week) w
    LEFT JOIN (SELECT unique_id, (end_day - ds) // 7 AS week, sum(y) AS v FROM part_win GROUP BY ALL) USING (unique_id, week)) GROUP BY 1"""
CTES["part_base"] = """SELECT unique_id, sum(paid) AS revenue, sum(y) AS units, avg(y) AS mean_daily, sum(paid) / nullif(sum(y), 0) / 10000 AS price, count(*) FILTER (y = 0) / count(*) AS zero_share, any_value(c) AS cv_weekly,
    CASE WHEN count(*) FILTER (y > 0) > 0 THEN count(*) / count(*) FILTER (y > 0) ELSE 'Infinity'::DOUBLE END AS adi, coalesce((count(*) FILTER (y > 0) * sum(y * y) - sum(y) * sum(y)) / nullif(sum(y) * sum(y), 0), 0) AS cv2 FROM part_win JOIN part_weeks USING (unique_id) GROUP BY 1"""
CTES["part_cl"] = "SELECT * REPLACE (revenue / 10000 AS revenue) FROM (" + CTES["classes"].replace("cl_base", "part_base") + ")"
PC = "part_lines part_days part_win part_weeks part_base part_cl"
oracle("part_classes", PC, "SELECT unique_id, revenue, units, mean_daily, price, zero_share, cv_weekly, adi, cv2, abc, revenue_share, xyz, segment, pattern FROM part_cl", "revenue units mean_daily price zero_share cv_weekly adi cv2 revenue_share")
oracle("part_class_matrix", PC, "SELECT abc, xyz, count(*) AS n_skus FROM part_cl GROUP BY CUBE (abc, xyz)")
oracle("part_patterns", PC, "SELECT pattern, abc, count(*) AS n_skus, sum(units) AS units, avg(zero_share) AS zero_share FROM part_cl GROUP BY 1, 2", "units zero_share")
oracle("abc_summary", C, "SELECT abc, count(*) AS n_skus, sum(revenue_share) AS revenue_share FROM classes GROUP BY 1", "revenue_share")
oracle("xyz_matrix_cube", C, "SELECT abc, xyz, count(*) AS n_skus FROM classes GROUP BY CUBE (abc, xyz)")
oracle("demand_pattern_counts", C, "SELECT pattern, count(*) AS n_skus, sum(units) AS units FROM classes GROUP BY 1", "units")
oracle("pareto_curve", C, "SELECT unique_id, sum(revenue) OVER (ORDER BY revenue DESC, unique_id ROWS UNBOUNDED PRECEDING) / sum(revenue) OVER () AS revenue_share, row_number() OVER (ORDER BY revenue DESC, unique_id) / count(*) OVER () AS sku_share FROM classes", "revenue_share sku_share")
oracle("revenue_matrix", C, """SELECT abc, coalesce(sum(revenue) FILTER (xyz = 'X'), 0) AS "X", coalesce(sum(revenue) FILTER (xyz = 'Y'), 0) AS "Y", coalesce(sum(revenue) FILTER (xyz = 'Z'), 0) AS "Z" FROM classes GROUP BY 1""", "X Y Z")
oracle("report_columns", C, """SELECT dept_id, '{"id":[' || string_agg('"' || unique_id || '"', ',' ORDER BY unique_id) || '],"revenue":[' || string_agg(CAST(CAST(trunc(round(revenue, 2)) AS BIGINT) AS VARCHAR), ',' ORDER BY unique_id) || ']}' AS document
    FROM classes JOIN (SELECT DISTINCT unique_id, dept_id FROM sales) USING (unique_id) GROUP BY 1""")

oracle("calendar_features", P, """SELECT s.unique_id, s.ds, CAST(s.event_name_1 IS NOT NULL AS INTEGER) AS is_event, coalesce(s.event_name_1, 'none') AS event_name, coalesce(s.event_type_1, 'none') AS event_type,
    CAST(least(coalesce((SELECT min(e.ds) FROM (SELECT DISTINCT ds FROM sales WHERE event_name_1 IS NOT NULL) e WHERE e.ds >= s.ds) - s.ds, 7), 7) AS INTEGER) AS days_to_event FROM sales s""")
oracle("price_features", P, """SELECT unique_id, ds, sell_price / avg(sell_price) OVER (PARTITION BY unique_id ORDER BY ds ROWS BETWEEN 90 PRECEDING AND CURRENT ROW) AS price_rel_item, sell_price / avg(sell_price) OVER (PARTITION BY dept_id, ds) AS price_rel_dept,
    coalesce(sell_price / lag(sell_price, 7) OVER (PARTITION BY unique_id ORDER BY ds) - 1, 0) AS price_change_7 FROM sales""", "price_rel_item price_rel_dept price_change_7")
oracle("lag_features", P, "SELECT unique_id, ds, lag(y, 7) OVER w AS lag_7, lag(y, 14) OVER w AS lag_14, lag(y, 28) OVER w AS lag_28 FROM sales WINDOW w AS (PARTITION BY unique_id ORDER BY ds)", "lag_7 lag_14 lag_28")
_ROLL = ", ".join(f"CASE WHEN row_number() OVER (PARTITION BY unique_id ORDER BY ds) >= {lag + rows} THEN {stat}(y) OVER (PARTITION BY unique_id ORDER BY ds ROWS BETWEEN {lag + rows - 1} PRECEDING AND {lag} PRECEDING) END AS {n}" for n, lag, rows, stat in params.ROLLING)
oracle("rolling_features", P, f"SELECT unique_id, ds, {_ROLL} FROM sales", " ".join(n for n, *_ in params.ROLLING))
oracle("date_features", P, "SELECT DISTINCT ds, CAST(isodow(ds) - 1 AS INTEGER) AS dayofweek, CAST(day(ds) AS INTEGER) AS day, CAST(month(ds) AS INTEGER) AS month FROM sales")

CTES["wins"] = """SELECT CAST(k AS INTEGER) AS "window", CAST(e - CAST(28 * (k + 1) AS INTEGER) AS DATE) AS cutoff FROM (SELECT max(ds) AS e FROM sales), (SELECT unnest(range(6)) AS k)"""
CTES["test"] = """SELECT s.unique_id, s.dept_id, s.ds, s.y, w.cutoff, w."window", CAST(s.ds - w.cutoff AS INTEGER) AS step FROM sales s JOIN wins w ON s.ds > w.cutoff AND s.ds <= w.cutoff + 28"""
_CV = """SELECT t.*, '{0}' AS model, {1} AS yhat FROM test t JOIN {2}"""
CTES["cv"] = " UNION ALL ".join([
    _CV.format("Naive", "n.y", "sales n ON n.unique_id = t.unique_id AND n.ds = t.cutoff"),
    _CV.format("SeasonalNaive", "n.y", "sales n ON n.unique_id = t.unique_id AND n.ds = t.cutoff - 6 + (t.step - 1) % 7"),
    _CV.format("MediaMovil28", "m.f", "(SELECT s.unique_id, w.cutoff, avg(s.y) AS f FROM sales s JOIN wins w ON s.ds > w.cutoff - 28 AND s.ds <= w.cutoff GROUP BY ALL) m ON m.unique_id = t.unique_id AND m.cutoff = t.cutoff"),
])
B = P + " wins test cv"
oracle("cv_cutoffs", P + " wins", """SELECT "window", cutoff, CAST(cutoff + 1 AS DATE) AS first_day, CAST(cutoff + 28 AS DATE) AS last_day, CASE WHEN "window" < 3 THEN 'eval' ELSE 'calib' END AS split FROM wins""")
oracle("cv_long_union", B, "SELECT unique_id, ds, cutoff, model, y, yhat FROM cv", "y yhat")
for _name, _model in (("fc_naive", "Naive"), ("fc_seasonal_naive", "SeasonalNaive"), ("fc_window_average", "MediaMovil28")):
    oracle(_name, B, f"SELECT unique_id, ds, yhat FROM cv WHERE model = '{_model}'", "yhat")
oracle("cv_full_outer", B, """SELECT unique_id, ds, cutoff, coalesce(a.y, b.y) AS y, a.yhat AS "SeasonalNaive", b.yhat AS "MediaMovil28" FROM (SELECT * FROM cv WHERE model = 'SeasonalNaive' AND "window" > 0) a
    FULL JOIN (SELECT * FROM cv WHERE model = 'MediaMovil28' AND "window" < 4) b USING (unique_id, ds, cutoff)""", "y SeasonalNaive MediaMovil28")
oracle("cv_wide_to_long", B, "SELECT unique_id, ds, cutoff, model, y, yhat FROM cv", "y yhat")
oracle("weekly_horizon_error", B, """SELECT CAST((step - 1) // 7 + 1 AS INTEGER) AS week, model, avg(w) AS wape FROM (SELECT step, model, sum(abs(y - yhat)) / nullif(sum(abs(y)), 0) AS w FROM cv WHERE "window" < 3 GROUP BY 1, 2) GROUP BY 1, 2""", "wape")
oracle("recent_days", P, "SELECT unique_id, ds, y, sell_price FROM sales QUALIFY row_number() OVER (PARTITION BY unique_id ORDER BY ds DESC) <= 84", "y sell_price")
_TOTALS = """sum(y) AS "real", sum(a) AS "MediaMovil28", sum(n) AS "Naive", sum(s) AS "SeasonalNaive" FROM (
    SELECT unique_id, dept_id, ds, max(y) AS y, max(yhat) FILTER (model = 'Naive') AS n, max(yhat) FILTER (model = 'SeasonalNaive') AS s, max(yhat) FILTER (model = 'MediaMovil28') AS a FROM cv WHERE "window" < 3 GROUP BY 1, 2, 3)"""
oracle("dept_day_totals", B, f"SELECT dept_id AS dept, strftime(ds, '%Y-%m-%d') AS ds, {_TOTALS} GROUP BY dept_id, ds UNION ALL SELECT 'Total', strftime(ds, '%Y-%m-%d'), {_TOTALS} GROUP BY ds", "real MediaMovil28 Naive SeasonalNaive")
CTES["ahead"] = f"""SELECT unique_id, item_id, dept_id, ds, NULL::DOUBLE AS y, {_CASES(0)} AS event_name_1, sell_price, 'future' AS part
    FROM (SELECT unique_id, item_id, dept_id, arg_max(sell_price, ds) AS sell_price FROM sales GROUP BY 1, 2, 3), (SELECT CAST(last + CAST(unnest(range(1, 29)) AS INTEGER) AS DATE) AS ds FROM (SELECT max(ds) AS last FROM sales))"""
CTES["frames"] = "SELECT unique_id, dept_id, ds, event_name_1, sell_price, 'history' AS part FROM sales UNION ALL SELECT unique_id, dept_id, ds, event_name_1, sell_price, part FROM ahead"
oracle("model_inputs", P + " ahead frames", """SELECT unique_id, ds, CAST(event_name_1 IS NOT NULL AS INTEGER) AS is_event, CAST(least(coalesce(e - ds, 7), 7) AS INTEGER) AS days_to_event, price_rel_item, price_rel_dept, price_change_7, part FROM (
    SELECT f.*, d.e, sell_price / avg(sell_price) OVER (PARTITION BY unique_id ORDER BY ds ROWS BETWEEN 90 PRECEDING AND CURRENT ROW) AS price_rel_item, sell_price / avg(sell_price) OVER (PARTITION BY dept_id, ds) AS price_rel_dept,
    coalesce(sell_price / lag(sell_price, 7) OVER (PARTITION BY unique_id ORDER BY ds) - 1, 0) AS price_change_7
    FROM frames f JOIN (SELECT ds, min(CASE WHEN ev THEN ds END) OVER (ORDER BY ds ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS e FROM (SELECT ds, bool_or(event_name_1 IS NOT NULL) AS ev FROM frames GROUP BY ds)) d USING (ds))
    WHERE ds > (SELECT max(ds) FROM sales) - 28""", "price_rel_item price_rel_dept price_change_7")
oracle("point_metrics", B, "SELECT cutoff, model, avg(abs(y - yhat)) AS mae, sqrt(avg((y - yhat) ** 2)) AS rmse, sum(abs(y - yhat)) / nullif(sum(abs(y)), 0) AS wape, CASE WHEN sum(y) > 0 THEN sum(yhat - y) / sum(y) END AS bias FROM cv GROUP BY 1, 2", "mae rmse wape bias")
CTES["lv"] = """SELECT 'total' AS level, 'total' AS key, ds, sum(y) AS y, sum(y * sell_price) AS r FROM sales GROUP BY ds UNION ALL SELECT 'dept', dept_id, ds, sum(y), sum(y * sell_price) FROM sales GROUP BY dept_id, ds UNION ALL SELECT 'sku', unique_id, ds, y, y * sell_price FROM sales"""
CTES["scale"] = """SELECT level, key, cutoff, nullif(avg(c * c) FILTER (ds > first), 0) AS scale, coalesce(sum(r) FILTER (ds > cutoff - 28), 0) AS weight FROM wins JOIN (
    SELECT *, y - lag(y) OVER (PARTITION BY level, key ORDER BY ds) AS c, min(ds) FILTER (y <> 0) OVER (PARTITION BY level, key) AS first FROM lv) ON ds <= cutoff GROUP BY 1, 2, 3"""
CTES["rms"] = """SELECT level, key, cutoff, model, sqrt(mse / scale) AS rmsse, coalesce(weight, 0) AS weight FROM (SELECT level, key, cutoff, model, avg((y - f) ** 2) AS mse FROM (
    SELECT 'total' AS level, 'total' AS key, cutoff, model, ds, sum(y) AS y, sum(yhat) AS f FROM cv GROUP BY cutoff, model, ds UNION ALL SELECT 'dept', dept_id, cutoff, model, ds, sum(y), sum(yhat) FROM cv GROUP BY dept_id, cutoff, model, ds UNION ALL SELECT 'sku', unique_id, cutoff, model, ds, y, yhat FROM cv
    ) GROUP BY 1, 2, 3, 4) LEFT JOIN scale USING (level, key, cutoff)"""
CTES["wrm"] = """SELECT level, cutoff, model, sum(weight * rmsse) / nullif(sum(weight), 0) AS value FROM (SELECT *, bool_or(rmsse IS NULL) OVER (PARTITION BY level, key, cutoff) AS undefined FROM rms) WHERE NOT undefined GROUP BY 1, 2, 3"""
CTES["wrmsse"] = "SELECT * FROM wrm UNION ALL SELECT 'WRMSSE', cutoff, model, avg(value) FROM wrm GROUP BY cutoff, model"
M = B + " lv scale rms"
oracle("naive_scale", B + " lv scale", "SELECT level, key, cutoff, scale, weight FROM scale", "scale weight")
oracle("rmsse_by_level", M, "SELECT * FROM rms", "rmsse weight")
oracle("wrmsse", M + " wrm wrmsse", "SELECT level, cutoff, model, value FROM wrmsse", "value")
oracle("wrmsse_report", M + " wrm wrmsse", """SELECT cutoff, avg(value) FILTER (model = 'Naive') AS "Naive", avg(value) FILTER (model = 'SeasonalNaive') AS "SeasonalNaive", avg(value) FILTER (model = 'MediaMovil28') AS "MediaMovil28" FROM wrmsse WHERE level = 'WRMSSE' GROUP BY ROLLUP (cutoff)""", "Naive SeasonalNaive MediaMovil28")
oracle("model_wins", M + " wrm wrmsse", "SELECT model, avg(value) AS mean_value, bool_and(value <= least_value) AS wins_all FROM (SELECT *, min(value) OVER (PARTITION BY cutoff) AS least_value FROM wrmsse WHERE level = 'WRMSSE') GROUP BY 1", "mean_value")
CTES["sku"] = """SELECT unique_id, cutoff, model, sum(y) AS demand, sum(abs(y - yhat)) AS abs_err, sum(yhat - y) AS err, avg(abs(y - yhat)) AS mae, any_value(rmsse) AS rmsse, CASE WHEN any_value("window") < 3 THEN 'eval' ELSE 'calib' END AS split
    FROM cv LEFT JOIN (SELECT key AS unique_id, cutoff, model, rmsse FROM rms WHERE level = 'sku') USING (unique_id, cutoff, model) GROUP BY 1, 2, 3"""
oracle("sku_metrics", M + " sku", "SELECT unique_id, cutoff, model, demand, abs_err, err, mae, rmsse, split FROM sku", "demand abs_err err mae rmsse")
CTES |= _classes(84)
EC = " cl_win cl_week cl_base classes"
_GROUPS = (("total", "'total'"), ("abc", "abc"), ("xyz", "xyz"), ("segment", "segment"), ("pattern", "pattern"), ("dept", "dept_id"))
CTES["segs"] = " UNION ALL ".join(f"""SELECT split, '{n}' AS "grouping", {e} AS "group", model, count(DISTINCT unique_id) AS n_skus, sum(demand) AS demand, avg(mae) AS mae, sum(abs_err) / nullif(sum(demand), 0) AS wape, sum(err) / nullif(sum(demand), 0) AS bias, avg(rmsse) AS rmsse
    FROM sku LEFT JOIN (SELECT c.*, d.dept_id FROM classes c JOIN (SELECT DISTINCT unique_id, dept_id FROM sales) d USING (unique_id)) USING (unique_id) GROUP BY 1, 2, 3, 4""" for n, e in _GROUPS)
oracle("segment_table", M + " sku" + EC + " segs", "SELECT * FROM segs", "demand mae wape bias rmsse")
oracle("best_model_by_segment", M + " sku" + EC + " segs", """SELECT "grouping", "group", arg_min(model, (wape, model)) AS model, min(wape) AS wape FROM segs WHERE split = 'eval' GROUP BY 1, 2""", "wape")
oracle("versus_best", M + " sku" + EC + " segs", """SELECT *, wape_model / nullif(wape_other, 0) - 1 AS difference FROM (SELECT "grouping", "group", max(n_skus) AS n_skus, max(wape) FILTER (model = 'MediaMovil28') AS wape_model, arg_min(model, (wape, model)) FILTER (model <> 'MediaMovil28') AS best_other, min(wape) FILTER (model <> 'MediaMovil28') AS wape_other FROM segs WHERE split = 'eval' GROUP BY 1, 2)""", "wape_model wape_other difference")
oracle("horizon_error", B, """SELECT step, model, sum(abs(y - yhat)) / nullif(sum(abs(y)), 0) AS wape FROM cv WHERE "window" < 3 GROUP BY 1, 2""", "wape")


def _margins(where: str) -> str:
    """Row numbers and two-row interpolation at the finite-sample level."""
    level = "CASE WHEN q >= 0.5 THEN least(1.0, ceil((n + 1) * q) / n) ELSE greatest(0.0, 1 - ceil((n + 1) * (1.0::DOUBLE - q)) / n) END"
    return f"""SELECT unique_id, model, level, max(v) FILTER (side = 'lo') AS lo, max(v) FILTER (side = 'hi') AS hi FROM (
        SELECT unique_id, model, level, side, max(e) FILTER (k = floor(h)) + (any_value(h) - floor(any_value(h))) * (coalesce(max(e) FILTER (k = floor(h) + 1), max(e) FILTER (k = floor(h))) - max(e) FILTER (k = floor(h))) AS v FROM (
        SELECT *, (n - 1) * {level} AS h FROM (SELECT unique_id, model, y - yhat AS e, row_number() OVER (PARTITION BY unique_id, model ORDER BY y - yhat) - 1 AS k, count(*) OVER (PARTITION BY unique_id, model) AS n FROM cv WHERE {where}),
        (VALUES (80, 'lo', {(1 - 80 / 100) / 2!r}::DOUBLE), (80, 'hi', {1 - (1 - 80 / 100) / 2!r}::DOUBLE), (95, 'lo', {(1 - 95 / 100) / 2!r}::DOUBLE), (95, 'hi', {1 - (1 - 95 / 100) / 2!r}::DOUBLE)) l(level, side, q)) GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3"""


CTES["marg"] = _margins("true")
oracle("conformal_margins", B + " marg", "SELECT * FROM marg", "lo hi")
CTES["marg"] = _margins('"window" > 0')
oracle("forecast_intervals", B + " marg", """SELECT cv.unique_id, model, ds, yhat, level, greatest(yhat + lo, 0) AS lo, greatest(yhat + hi, 0) AS hi FROM cv JOIN marg USING (unique_id, model) WHERE "window" = 0""", "yhat lo hi")
CTES["marg"] = _margins('"window" >= 3')
CTES["bounds"] = """SELECT cv.unique_id, model, y, level, greatest(yhat + lo, 0) AS lo, greatest(yhat + hi, 0) AS hi FROM cv JOIN marg USING (unique_id, model) WHERE "window" < 3"""
oracle("interval_coverage", B + " marg bounds" + EC, " UNION ALL ".join(f"""SELECT model, '{n}' AS "grouping", {e} AS "group", level, level / 100.0::DOUBLE AS nominal, avg(CASE WHEN y BETWEEN lo AND hi THEN 1.0 ELSE 0 END) AS coverage, avg(hi - lo) AS mean_width, count(*) AS n_obs FROM bounds LEFT JOIN classes USING (unique_id) GROUP BY 1, 2, 3, 4""" for n, e in _GROUPS[:3] + _GROUPS[4:5]), "nominal coverage mean_width")

# ---- inventory
_L = "(SELECT CAST(unnest([{}]) AS INTEGER) AS lead_time)"


def _basis(lead_times) -> dict[str, str]:
    """basis: unique_id, policy, lead_time, w, mu (29 values), daily, sigma, errs; w = 0 is the oldest evaluation window."""
    leads = _L.format(", ".join(map(str, lead_times)))
    return {
        "arr": """SELECT unique_id, model AS policy, list(y - yhat ORDER BY ds) AS e, list(yhat ORDER BY ds) AS f FROM cv WHERE model <> 'Naive' GROUP BY 1, 2""",
        "hist": f"""SELECT unique_id, list(y ORDER BY ds) AS h FROM sales WHERE ds > (SELECT max(ds) FROM sales) - {84 + 56} GROUP BY 1""",
        "fb": f"""SELECT unique_id, policy, lead_time, CAST(w AS INTEGER) AS w, [list_sum(g[o + 1 : o + lead_time]) for o in range(29)] AS mu, list_avg(own) AS daily, list_aggregate(past, 'stddev_samp') AS sigma,
            flatten([[list_sum(past[28 * j + s + 1 : 28 * j + s + lead_time]) for s in range(29 - lead_time)] for j in range(w + 3)]) AS errs FROM (
            SELECT *, f[28 * (w + 3) + 1 : 28 * (w + 4)] AS own, f[28 * (w + 3) + 1 : 28 * (w + 4)] || f[28 * (w + 3) + 15 : 28 * (w + 4)] || f[28 * (w + 3) + 15 : 28 * (w + 4)] AS g, e[1 : 28 * (w + 3)] AS past FROM arr, {leads}, (SELECT unnest(range(3)) AS w))""",
        "cb": f"""SELECT unique_id, 'Clásica (media móvil)' AS policy, lead_time, CAST(w AS INTEGER) AS w, [m * lead_time for o in range(29)] AS mu, m AS daily, list_aggregate(past, 'stddev_samp') AS sigma,
            [list_sum(past[s + 1 : s + lead_time]) - m * lead_time for s in range(57 - lead_time)] AS errs FROM (SELECT *, list_avg(past) AS m FROM (SELECT *, h[28 * w + 1 : 28 * w + 56] AS past FROM hist, {leads}, (SELECT unnest(range(3)) AS w)))""",
        "basis": "SELECT *, list_aggregate(errs, 'stddev_samp') AS sigma_lead FROM (SELECT * FROM fb UNION ALL SELECT * FROM cb)",
    }


CTES |= _basis(params.LEAD_TIMES)
I = B + " arr hist fb cb basis"
_FLAT = "SELECT unique_id, policy, lead_time, w, mu[1] AS mu_first, mu[29] AS mu_last, daily, sigma, sigma_lead, CAST(len(errs) AS BIGINT) AS n_errors FROM basis WHERE policy {} 'Clásica (media móvil)'"
oracle("classic_basis", I, _FLAT.format("="), "mu_first mu_last daily sigma sigma_lead")
oracle("forecast_basis", I, _FLAT.format("<>"), "mu_first mu_last daily sigma sigma_lead")


def _scenarios(methods, levels, clip=True, costs=((5.0, 0.25),)) -> str:
    rows = ", ".join(f"('{m}', {p!r}::DOUBLE, {NormalDist().inv_cdf(p)!r}::DOUBLE, {k!r}::DOUBLE, {h!r}::DOUBLE, {str(clip).lower()})" for m in methods for p in levels for k, h in costs)
    return f"SELECT * FROM (VALUES {rows}) v(ss_method, service_level, z, order_cost, holding_rate, clip)"


CTES["eval"] = "SELECT unique_id, list(y ORDER BY ds) AS demand, avg(sell_price) AS price FROM sales WHERE ds > (SELECT max(ds) FROM sales) - 84 GROUP BY 1"
CTES["stock"] = """SELECT *, CASE WHEN ss_method = 'empirico' THEN es[CAST(floor(p) AS INTEGER) + 1] + (p - floor(p)) * (coalesce(es[CAST(floor(p) AS INTEGER) + 2], es[CAST(floor(p) AS INTEGER) + 1]) - es[CAST(floor(p) AS INTEGER) + 1])
    WHEN clip THEN greatest(nrm, 0) ELSE nrm END AS ss FROM (SELECT b.*, c.*, list_sort(errs) AS es, (len(errs) - 1) * least(1.0::DOUBLE, ceil((len(errs) + 1) * service_level) / len(errs)) AS p,
    CASE WHEN ss_method = 'sqrt' THEN z * sigma * sqrt(lead_time) ELSE z * sigma_lead END AS nrm FROM basis b, scen c)"""
CTES["lots"] = """SELECT unique_id, policy, lead_time, ss_method, service_level, order_cost, holding_rate, price, w, ss, [CAST(ceil(round(greatest(m + ss, 0), 6)) AS DOUBLE) for m in mu] AS rop,
    greatest(1.0, CAST(ceil(round(least(greatest(CASE WHEN daily > 0 AND price > 0 THEN sqrt(2.0 * (daily * 365.0) * order_cost / (price * 0.7::DOUBLE * holding_rate)) ELSE 0 END, daily), daily * 14.0), 6)) AS DOUBLE)) AS lot FROM stock JOIN eval USING (unique_id)"""
CTES["plan"] = """SELECT unique_id, policy, lead_time, ss_method, service_level, order_cost, holding_rate, price, flatten(list(rop[1 : CASE WHEN w = 2 THEN 29 ELSE 28 END] ORDER BY w)) AS rop,
    flatten(list([lot for i in range(CASE WHEN w = 2 THEN 29 ELSE 28 END)] ORDER BY w)) AS lot, flatten(list([ss for i in range(CASE WHEN w = 2 THEN 29 ELSE 28 END)] ORDER BY w)) AS ss FROM lots GROUP BY ALL"""
CTES["runs"] = "SELECT row_number() OVER () AS id, p.*, e.demand FROM plan p JOIN eval e USING (unique_id)"
CTES["sim"] = """SELECT id, 0 AS t, rop[1] + lot[1] AS stock, [0.0::DOUBLE for i in range(lead_time)] AS due, 0.0::DOUBLE AS oo, false AS short, 0.0::DOUBLE AS sales, 0.0::DOUBLE AS lost, 0.0::DOUBLE AS ssum, 0 AS ld, 0 AS no, 0 AS cy, 0 AS sc, rop, lot, demand FROM runs UNION ALL
    SELECT id, t + 1, lft, due[2:] || [q], oo - due[1] + q, (short AND NOT due[1] > 0) OR demand[t + 1] > sold, sales + sold, lost + demand[t + 1] - sold, ssum + lft, ld + CAST(demand[t + 1] > sold AS INTEGER), no + CAST(q > 0 AS INTEGER), cy + CAST(due[1] > 0 AS INTEGER), sc + CAST(due[1] > 0 AND short AS INTEGER), rop, lot, demand
    FROM (SELECT *, CASE WHEN lft + oo - due[1] <= rop[t + 2] THEN ceil(greatest(rop[t + 2] + lot[t + 2] - lft - oo + due[1], 0)) ELSE 0.0::DOUBLE END AS q FROM (SELECT *, stock + due[1] - sold AS lft FROM (SELECT *, least(stock + due[1], demand[t + 1]) AS sold FROM sim WHERE t < 84)))"""
CTES["skus"] = """SELECT r.unique_id, r.policy, r.lead_time, r.ss_method, r.service_level, r.order_cost, r.holding_rate, r.price, s.sales, s.lost, CAST(s.no AS DOUBLE) AS n_orders, CAST(s.cy AS DOUBLE) AS cycles, CAST(s.sc AS DOUBLE) AS stockout_cycles,
    list_avg(r.ss[2:]) AS safety_stock, list_avg(r.rop[2:]) AS rop, list_sum(r.demand) AS demand, list_sum(r.demand) / 84 AS daily_demand, s.sales / nullif(list_sum(r.demand), 0) AS fill_rate, s.ld, 84 AS days, s.ld / 84 AS stockout_days, s.ssum / 84 AS avg_on_hand, s.ssum / 84 * r.price * 0.7::DOUBLE AS avg_inv_value
    FROM sim s JOIN runs r USING (id) WHERE s.t = 84"""
CTES["kpi"] = """SELECT k.*, g."group", count(x.unique_id) AS n_skus, sum(x.sales * x.price) / nullif(sum(x.demand * x.price), 0) AS fill_rate, sum(x.sales) / nullif(sum(x.demand), 0) AS fill_rate_units, 1 - sum(x.stockout_cycles) / nullif(sum(x.cycles), 0) AS cycle_service,
    sum(x.ld) / sum(x.days) AS stockout_days, coalesce(sum(x.avg_on_hand), 0) AS avg_inv_units, coalesce(sum(x.avg_inv_value), 0) AS avg_inv_value, sum(x.avg_on_hand) / nullif(sum(x.daily_demand), 0) AS days_of_supply, avg(x.n_orders) AS orders_per_sku, avg(CASE WHEN x.fill_rate >= x.service_level THEN 1.0 WHEN x.fill_rate IS NOT NULL THEN 0 END) AS skus_meeting_target
    FROM (SELECT DISTINCT policy, ss_method, lead_time, service_level, order_cost, holding_rate FROM skus) k CROSS JOIN (VALUES ('Total'), ('A'), ('B'), ('C')) g("group")
    LEFT JOIN (SELECT s.*, c.abc FROM skus s LEFT JOIN classes c USING (unique_id)) x ON (k.policy, k.ss_method, k.lead_time, k.service_level, k.order_cost, k.holding_rate) = (x.policy, x.ss_method, x.lead_time, x.service_level, x.order_cost, x.holding_rate) AND g."group" IN ('Total', x.abc) AND (g."group" = 'Total' OR g."group" = x.abc)
    GROUP BY ALL"""
CTES |= _basis([params.DEFAULT_LEAD])
CTES["scen"] = _scenarios(params.SS_METHODS, params.SERVICE_LEVELS)
oracle("safety_stock_methods", I + " scen stock", "SELECT unique_id, policy, ss_method, service_level, max(ss) FILTER (w = 0) AS ss_first, max(ss) FILTER (w = 2) AS ss_last FROM stock GROUP BY 1, 2, 3, 4", "service_level ss_first ss_last")
CTES |= _basis(params.LEAD_TIMES)
CTES["scen"] = _scenarios(["sqrt"], [0.95])
oracle("rop_eoq_lot", I + " eval scen stock lots plan", "SELECT unique_id, policy, lead_time, CAST(d AS INTEGER) AS d, rop[d + 1] AS rop, lot[d + 1] AS lot FROM plan, (SELECT unnest(range(85)) AS d)", "rop lot")
CTES |= _basis([params.DEFAULT_LEAD])
S = I + " eval scen stock lots plan runs sim skus"
_SKU_D = "service_level price sales lost n_orders cycles stockout_cycles safety_stock rop demand daily_demand fill_rate stockout_days avg_on_hand avg_inv_value"
oracle("sim_single", S, "SELECT * EXCLUDE (order_cost, holding_rate, ld, days) FROM skus", _SKU_D)
_KPI_D = "service_level fill_rate fill_rate_units cycle_service stockout_days avg_inv_units avg_inv_value days_of_supply orders_per_sku skus_meeting_target"
oracle("sim_kpis_by_class", S + EC + " kpi", "SELECT * EXCLUDE (order_cost, holding_rate) FROM kpi", _KPI_D)
oracle("missing_target", S + EC, "SELECT policy, pattern, count(*) AS n_skus, avg(CASE WHEN fill_rate < service_level THEN 1.0 ELSE 0 END) AS missing_share, median(fill_rate) AS median_fill, avg(demand) AS mean_demand FROM skus JOIN (SELECT unique_id, pattern FROM classes) USING (unique_id) WHERE fill_rate IS NOT NULL GROUP BY 1, 2", "missing_share median_fill mean_demand")
oracle("missing_by_class", S + EC, "SELECT policy, abc, count(*) AS n_skus, avg(CASE WHEN fill_rate >= service_level THEN 1.0 ELSE 0 END) AS meeting_share, quantile_cont(fill_rate, 0.1) AS fill_p10 FROM skus JOIN (SELECT unique_id, abc FROM classes) USING (unique_id) WHERE fill_rate IS NOT NULL GROUP BY 1, 2", "meeting_share fill_p10")
CTES["scen"] = _scenarios(params.SS_METHODS, params.SERVICE_LEVELS)
oracle("nominal_service", S + EC + " kpi", """SELECT service_level, max(cycle_service) FILTER (ss_method = 'sqrt') AS "sqrt", max(cycle_service) FILTER (ss_method = 'acumulado') AS acumulado, max(cycle_service) FILTER (ss_method = 'empirico') AS empirico FROM kpi WHERE "group" = 'Total' AND policy = 'MediaMovil28' GROUP BY 1""", "service_level sqrt acumulado empirico")
CTES["scen"] = _scenarios(["sqrt"], params.FRONTIER_LEVELS, clip=False)
oracle("service_curve", S + EC + " kpi", """SELECT service_level, fill_rate, cycle_service, avg_inv_value FROM kpi WHERE "group" = 'Total' AND policy = 'MediaMovil28'""", "service_level fill_rate cycle_service avg_inv_value")
CTES |= _basis(params.LEAD_TIMES)
CTES["scen"] = _scenarios(params.SS_METHODS, params.SERVICE_LEVELS)
oracle("scenario_grid", S + EC + " kpi", "SELECT * EXCLUDE (order_cost, holding_rate) FROM kpi", _KPI_D)
oracle("scenario_report", S + EC + " kpi", """SELECT lead_time, ss_method, max(avg_inv_value) FILTER (policy LIKE 'Cl%') AS "Clasica", max(avg_inv_value) FILTER (policy = 'SeasonalNaive') AS "SeasonalNaive", max(avg_inv_value) FILTER (policy = 'MediaMovil28') AS "MediaMovil28" FROM kpi WHERE "group" = 'Total' AND service_level = 0.95::DOUBLE GROUP BY 1, 2""", "Clasica SeasonalNaive MediaMovil28")
CTES["scen"] = _scenarios(["sqrt"], params.FRONTIER_LEVELS, clip=False)
oracle("frontier", S + EC + " kpi", """SELECT policy, ss_method, lead_time, service_level, "group", fill_rate, avg_inv_value FROM kpi""", "service_level fill_rate avg_inv_value")


def _at_fill(keys: str, targets) -> str:
    """Interpolation between the last point at or below the target and the first above it, on the running maximum."""
    return f"""SELECT {keys}, target_fill_rate, CASE WHEN broken OR target_fill_rate > top THEN NULL WHEN lo.f = target_fill_rate THEN lo.v ELSE lo.v + (target_fill_rate - lo.f) / (hi.f - lo.f) * (hi.v - lo.v) END AS avg_inv_value FROM (
        SELECT {keys}, target_fill_rate, bool_or(fill_rate IS NULL) AS broken, max(f) AS top, arg_max({{'f': f, 'v': avg_inv_value}}, k) FILTER (f <= target_fill_rate) AS lo, arg_min({{'f': f, 'v': avg_inv_value}}, k) FILTER (f > target_fill_rate) AS hi FROM (
        SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY avg_inv_value, fill_rate) AS k, max(fill_rate) OVER (PARTITION BY {keys} ORDER BY avg_inv_value, fill_rate ROWS UNBOUNDED PRECEDING) AS f FROM kpi),
        (SELECT unnest([{", ".join(f"{t!r}::DOUBLE" for t in targets)}]) AS target_fill_rate) GROUP BY ALL)"""


oracle("inventory_at_fill", S + EC + " kpi", _at_fill('policy, ss_method, lead_time, "group"', params.FILL_TARGETS), "target_fill_rate avg_inv_value")
CTES["needed"] = _at_fill('policy, ss_method, lead_time, "group"', params.FILL_TARGETS)
oracle("savings_by_target", S + EC + " kpi needed", """SELECT *, "MediaMovil28" / nullif("Clasica", 0) - 1 AS saving FROM (SELECT target_fill_rate, lead_time, max(avg_inv_value) FILTER (policy LIKE 'Cl%') AS "Clasica", max(avg_inv_value) FILTER (policy = 'SeasonalNaive') AS "SeasonalNaive", max(avg_inv_value) FILTER (policy = 'MediaMovil28') AS "MediaMovil28" FROM needed WHERE "group" = 'Total' GROUP BY 1, 2)""", "target_fill_rate Clasica SeasonalNaive MediaMovil28 saving")
CTES |= _basis([params.DEFAULT_LEAD])
CTES["scen"] = _scenarios(["sqrt"], params.FRONTIER_LEVELS, False, [(k, h) for k in params.ORDER_COSTS for h in params.HOLDING_RATES])
CTES["need"] = f"""SELECT * FROM ({_at_fill('"group", policy, order_cost, holding_rate', [params.DEFAULT_LEVEL])}) WHERE "group" = 'Total'"""
oracle("cost_sensitivity", S + EC + " kpi need", """SELECT order_cost, holding_rate, c AS inv_classic, a AS inv_average, a / nullif(c, 0) - 1 AS reduction FROM (SELECT order_cost, holding_rate, max(avg_inv_value) FILTER (policy LIKE 'Cl%') AS c, max(avg_inv_value) FILTER (policy = 'MediaMovil28') AS a FROM need GROUP BY 1, 2)""", "order_cost holding_rate inv_classic inv_average reduction")
_ORDERS = {c: f"order_{c:g}".replace(".", "_") for c in params.ORDER_COSTS}
_PIVOT = ", ".join(f'max(a) FILTER (policy = \'MediaMovil28\' AND order_cost = {c!r}::DOUBLE) / nullif(max(a) FILTER (policy LIKE \'Cl%\' AND order_cost = {c!r}::DOUBLE), 0) - 1 AS {n}' for c, n in _ORDERS.items())
oracle("cost_pivot", S + EC + " kpi need", f"SELECT holding_rate, {_PIVOT} FROM (SELECT *, avg_inv_value AS a FROM need) GROUP BY 1", "holding_rate " + " ".join(_ORDERS.values()))
CTES["scen"] = _scenarios(params.SS_METHODS, params.FRONTIER_LEVELS, False)
CTES["needed"] = _at_fill('policy, ss_method, "group"', [params.DEFAULT_LEVEL])
oracle("method_comparison", S + EC + " kpi needed", """SELECT k.policy, k.ss_method, k.cycle_service, n.avg_inv_value FROM kpi k LEFT JOIN needed n ON k.policy = n.policy AND k.ss_method = n.ss_method AND n."group" = 'Total' WHERE k."group" = 'Total' AND k.service_level = 0.95::DOUBLE""", "cycle_service avg_inv_value")
CTES["rec"] = f"""SELECT unique_id, lead_time, service_level, ss_method, f, price, CAST(ceil(round(greatest(CASE WHEN ss_method = 'sqrt' THEN z * sigma * sqrt(lead_time::DOUBLE) ELSE z * sigma_lead END, 0), 6)) AS DOUBLE) AS ss FROM (
    SELECT unique_id, lead_time, list_aggregate(e, 'stddev_samp') AS sigma, list_aggregate(flatten([[list_sum(e[28 * j + s + 1 : 28 * j + s + lead_time]) for s in range(29 - lead_time)] for j in range(6)]), 'stddev_samp') AS sigma_lead FROM arr, {_L.format(", ".join(map(str, params.LEAD_TIMES)))} WHERE policy = 'MediaMovil28')
    JOIN (SELECT unique_id, avg(y) AS f, arg_max(sell_price, ds) AS price FROM sales WHERE ds > (SELECT max(ds) FROM sales) - 28 GROUP BY 1) USING (unique_id), scen"""
CTES["scen"] = _scenarios(("sqrt", "acumulado"), params.SERVICE_LEVELS)
oracle("stock_value_by_segment", B + " arr scen rec" + EC, """SELECT CAST(((CASE lead_time WHEN 3 THEN 0 WHEN 7 THEN 1 ELSE 2 END) * 3 + (CASE service_level WHEN 0.9::DOUBLE THEN 0 WHEN 0.95::DOUBLE THEN 1 ELSE 2 END)) * 2 + (CASE ss_method WHEN 'sqrt' THEN 0 ELSE 1 END) AS INTEGER) AS escenario, segment AS segmento, d.dept_id AS dept, sum(ss * r.price) * 0.7::DOUBLE AS valor
    FROM rec r JOIN classes USING (unique_id) JOIN (SELECT DISTINCT unique_id, dept_id FROM sales) d USING (unique_id) GROUP BY 1, 2, 3""", "valor")
CTES["scen"] = _scenarios(["sqrt"], [params.DEFAULT_LEVEL])
oracle("planner_table", B + " arr scen rec" + EC, """SELECT *, rop + lot AS order_up_to FROM (SELECT r.unique_id, d.item_id, d.dept_id, abc, xyz, segment, pattern, f * 28 AS forecast_28d, f * 7 AS demand_lead_time, ss AS safety_stock, CAST(ceil(round(greatest(f * 7 + ss, 0), 6)) AS DOUBLE) AS rop,
    greatest(1.0::DOUBLE, CAST(ceil(round(least(greatest(CASE WHEN f > 0 AND r.price > 0 THEN sqrt(2.0 * f * 365 * 5.0 / (r.price * 0.7::DOUBLE * 0.25::DOUBLE)) ELSE 0 END, f), f * 14), 6)) AS DOUBLE)) AS lot
    FROM rec r JOIN classes USING (unique_id) JOIN (SELECT DISTINCT unique_id, item_id, dept_id FROM sales) d USING (unique_id) WHERE lead_time = 7) ORDER BY forecast_28d DESC, unique_id LIMIT 10""", "forecast_28d demand_lead_time safety_stock rop lot order_up_to")
CTES |= _classes(0)
oracle("top_products", C, """SELECT unique_id, revenue, segment, strftime(max(s.ds) FILTER (s.y > 0), '%Y-%m-%d') AS last_sale, strftime(min(s.ds), '%Y-%m') AS first_month FROM classes JOIN sales s USING (unique_id) GROUP BY 1, 2, 3 ORDER BY revenue DESC, unique_id LIMIT 10""", "revenue")
oracle("recommendation", B + " arr", f"""SELECT unique_id, f * 28 AS forecast_28d, f AS forecast_daily, f * 7 AS demand_lead_time, sigma_error, sigma_lead, price, safety_stock, rop, lot, rop + lot AS order_up_to, 7 AS lead_time, 0.95::DOUBLE AS service_level, 'sqrt' AS ss_method FROM (
    SELECT *, CAST(ceil(round(greatest(f * 7 + safety_stock, 0), 6)) AS DOUBLE) AS rop, greatest(1.0::DOUBLE, CAST(ceil(round(least(greatest(CASE WHEN f > 0 AND price > 0 THEN sqrt(2.0 * f * 365 * 5.0 / (price * 0.7::DOUBLE * 0.25::DOUBLE)) ELSE 0 END, f), f * 14), 6)) AS DOUBLE)) AS lot FROM (
    SELECT *, CAST(ceil(round(greatest({NormalDist().inv_cdf(0.95)!r}::DOUBLE * sigma_error * sqrt(7.0::DOUBLE), 0), 6)) AS DOUBLE) AS safety_stock FROM (SELECT unique_id, list_aggregate(e, 'stddev_samp') AS sigma_error, list_aggregate(flatten([[list_sum(e[28 * j + s + 1 : 28 * j + s + 7]) for s in range(22)] for j in range(6)]), 'stddev_samp') AS sigma_lead FROM arr WHERE policy = 'MediaMovil28')
    JOIN (SELECT unique_id, avg(y) AS f, arg_max(sell_price, ds) AS price FROM sales WHERE ds > (SELECT max(ds) FROM sales) - 28 GROUP BY 1) USING (unique_id)))""", "forecast_28d forecast_daily demand_lead_time sigma_error sigma_lead price safety_stock rop lot order_up_to service_level")
