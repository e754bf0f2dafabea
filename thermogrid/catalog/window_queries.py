"""Windows, neighbourhoods, splits and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from thermogrid.catalog.registry import query
from thermogrid.functions import round_even
from thermogrid.operators import raster as RS, series as SR
from thermogrid.operators.keyed import union_all
from thermogrid.plans import city as C, models as MD


def r6(*names):
    return [round_even(n, 6).alias(n) for n in names]


@query("rolling_week_W1", """
    SELECT site, date, R6(avg(t2m) OVER (PARTITION BY site ORDER BY date ROWS 6 PRECEDING)) AS t2m_7d, R6(avg(ws2m) OVER (PARTITION BY site ORDER BY date ROWS 6 PRECEDING)) AS ws2m_7d FROM weather_daily""")
def _(d):
    return SR.rolling_means(d.weather_daily, ["site"], "date", ["t2m", "ws2m"], 7, "_7d").select("site", "date", *r6("t2m_7d", "ws2m_7d"))


@query("rolling_month_W2", "SELECT site, date, R6(avg(rh2m) OVER (PARTITION BY site ORDER BY date ROWS 29 PRECEDING)) AS rh2m_30d FROM weather_daily")
def _(d):
    return SR.rolling_means(d.weather_daily, ["site"], "date", ["rh2m"], 30, "_30d").select("site", "date", *r6("rh2m_30d"))


@query("missing_days_W3", """
    WITH s AS (SELECT site, unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS d FROM weather_daily GROUP BY site)
    SELECT s.site, CAST(s.d AS DATE) AS missing FROM s WHERE NOT EXISTS (SELECT 1 FROM weather_daily w WHERE w.site = s.site AND w.date = CAST(s.d AS DATE))""")
def _(d):
    return SR.missing_days(d.weather_daily, ["site"], "date")


@query("rank_models_W4", """
    WITH m AS (SELECT fold, season, sqrt(avg(pow(predicted_lst - target_lst, 2))) AS rmse FROM close_predictions GROUP BY fold, season)
    SELECT fold, season, R6(rmse) AS rmse, row_number() OVER (PARTITION BY season ORDER BY rmse, fold) AS "rank" FROM m""")
def _(d):
    from thermogrid.operators.metrics import regression_metrics

    m = regression_metrics(d.close_predictions, "target_lst", "predicted_lst", ["fold", "season"])
    return MD.rank_models(m, "fold", by=["season"]).select("fold", "season", *r6("rmse"), "rank")


@query("quartile_class_W6", """
    WITH p AS (SELECT grid_id, R2(-0.05e0 * green_cover - 2.0e0 * coalesce(mean_ndvi, 0.0e0)) AS v FROM cells),
    q AS (SELECT quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.5) AS b, quantile_cont(v, 0.75) AS c FROM p)
    SELECT grid_id, v AS max_cooling_c, CASE WHEN v < a THEN 'VERY HIGH' WHEN v < b THEN 'HIGH' WHEN v < c THEN 'MODERATE' ELSE 'LOW' END AS cooling_class FROM p, q""")
def _(d):
    p = d.cells.select("grid_id", round_even(-0.05 * F.col("green_cover") - 2.0 * F.coalesce("mean_ndvi", F.lit(0.0)), 2).alias("max_cooling_c"))
    return C.cooling_classes(p)


_RANKS = "WITH r AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS r, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM cell_lst_dates) d)"


@query("chronological_split_W7", _RANKS + """,
    s AS (SELECT date, CASE WHEN r < floor(n * 0.7) THEN 'train' WHEN r < floor(n * 0.7) + floor(n * 0.15) THEN 'validation' ELSE 'test' END AS split FROM r)
    SELECT split, count(*) AS n, min(o.date) AS first_date, max(o.date) AS last_date FROM cell_lst_dates o JOIN s ON s.date = o.date GROUP BY split""")
def _(d):
    return SR.split_by_date(d.cell_lst_dates, "date").groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


@query("date_folds_W8", _RANKS + """,
    f AS (SELECT date, CAST(CASE WHEN r < (n % 4) * (floor(n / 4) + 1) THEN floor(r / (floor(n / 4) + 1)) ELSE n % 4 + floor((r - (n % 4) * (floor(n / 4) + 1)) / floor(n / 4)) END AS INT) AS fold FROM r)
    SELECT fold, count(*) AS n, count(DISTINCT o.date) AS dates, min(o.date) AS first_date FROM cell_lst_dates o JOIN f ON f.date = o.date GROUP BY fold""")
def _(d):
    return SR.date_folds(d.cell_lst_dates, "date", 4).groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("date").alias("dates"), F.min("date").alias("first_date"))


@query("expanding_folds_W8b", _RANKS + """,
    f AS (SELECT date, CAST(CASE WHEN r < (n % 4) * (floor(n / 4) + 1) THEN floor(r / (floor(n / 4) + 1)) ELSE n % 4 + floor((r - (n % 4) * (floor(n / 4) + 1)) / floor(n / 4)) END AS INT) AS fold FROM r)
    SELECT t.k AS test_fold, CASE WHEN f.fold = t.k THEN 'test' ELSE 'train' END AS role, count(*) AS n, max(o.date) AS last_date
    FROM cell_lst_dates o JOIN f ON f.date = o.date JOIN (VALUES (1), (2), (3)) t(k) ON f.fold <= t.k GROUP BY 1, 2""")
def _(d):
    uses = SR.expanding_folds(d.cell_lst_dates, "date", 4)
    return uses.groupBy("test_fold", "role").agg(F.count(F.lit(1)).alias("n"), F.max("date").alias("last_date"))


def draw_sql(column: str, seed: int) -> str:
    return f"(({column} % 1000000007 * 1000003 + {seed * 7919}) % 998244353 * 48271 + 12345) % 2147483647"


@query("random_split_W9", f"SELECT grid_id, {draw_sql('grid_id', 42)} % 1000000 < 200000 AS is_test, CAST({draw_sql('grid_id', 43)} % 5 AS INT) AS fold FROM cells")
def _(d):
    folded = MD.hash_folds(MD.hash_split(d.cells.select("grid_id", "mean_lst"), "grid_id", 0.2), "grid_id", 5)
    return folded.select("grid_id", "is_test", "fold")


@query("early_stopping_slice_W10", f"""
    WITH d AS (SELECT grid_id, {draw_sql('grid_id', 44)} AS d, count(*) OVER () AS n FROM cells)
    SELECT grid_id, row_number() OVER (ORDER BY d % 4096, d, grid_id) <= least(greatest(500, floor(n * 0.1e0)), floor(n / 2.0e0)) AS validation FROM d""")
def _(d):
    return MD.early_stopping_slice(d.cells.select("grid_id"), "grid_id").select("grid_id", "validation")


NEAR_SQL = """
    WITH q AS (SELECT m."row", m.col, m.ground AS z, nw.ground AS nw, n.ground AS n, ne.ground AS ne, w.ground AS w, e.ground AS e, sw.ground AS sw, s.ground AS s, se.ground AS se FROM dem m
      LEFT JOIN dem nw ON nw."row" = m."row" - 1 AND nw.col = m.col - 1 LEFT JOIN dem n ON n."row" = m."row" - 1 AND n.col = m.col LEFT JOIN dem ne ON ne."row" = m."row" - 1 AND ne.col = m.col + 1
      LEFT JOIN dem w ON w."row" = m."row" AND w.col = m.col - 1 LEFT JOIN dem e ON e."row" = m."row" AND e.col = m.col + 1
      LEFT JOIN dem sw ON sw."row" = m."row" + 1 AND sw.col = m.col - 1 LEFT JOIN dem s ON s."row" = m."row" + 1 AND s.col = m.col LEFT JOIN dem se ON se."row" = m."row" + 1 AND se.col = m.col + 1),
    g AS (SELECT "row", col, ((ne + 2.0e0 * e + se) - (nw + 2.0e0 * w + sw)) / 240.0e0 AS gx, ((sw + 2.0e0 * s + se) - (nw + 2.0e0 * n + ne)) / 248.0e0 AS gy FROM q),
    sl AS (SELECT "row", col, gx, gy, degrees(atan(sqrt(gx * gx + gy * gy))) AS slope, ((90.0e0 - degrees(atan2(gy, -gx)) + 720.0e0) % 360.0e0) AS aspect FROM g)
"""


@query("slope_aspect_W11", NEAR_SQL + "SELECT \"row\", col, R5(slope) AS slope, R5(CASE WHEN slope <= 1e-6 THEN -1.0e0 ELSE aspect END) AS aspect FROM sl WHERE gx IS NOT NULL AND gy IS NOT NULL")
def _(d):
    out = RS.slope_aspect(d.dem.select("row", "col", "ground"), "ground", 30.0, 31.0)
    return out.where("dzdx is not null and dzdy is not null").select("row", "col", round_even("slope", 5).alias("slope"), round_even("aspect", 5).alias("aspect"))


@query("hillshade_W12", NEAR_SQL + """
    SELECT "row", col, R4(255.0e0 * greatest(0.0e0, least(1.0e0, cos(radians(45.0e0)) * cos(radians(slope)) + sin(radians(45.0e0)) * sin(radians(slope)) * cos(radians(135.0e0) - radians(aspect))))) AS hillshade FROM sl WHERE gx IS NOT NULL AND gy IS NOT NULL""")
def _(d):
    out = RS.hillshade(RS.slope_aspect(d.dem.select("row", "col", "ground"), "ground", 30.0, 31.0))
    return out.where("dzdx is not null and dzdy is not null").select("row", "col", round_even("hillshade", 4).alias("hillshade"))


def _fill_sql() -> str:
    """Four passes, twice, each reading the last; every line wraps at its ends."""
    ctes, prev = [], "SELECT \"row\", col, elevation AS z FROM dem"
    step = 0
    for _ in range(2):
        for line, index in (('"row"', "col"), ("col", '"row"')):
            for fn, edge, pick in (("lag", "min", "arg_max"), ("lead", "max", "arg_min")):
                step += 1
                src = prev if step == 1 else f"SELECT * FROM f{step - 1}"
                # arg_null keeps nulls: the wrapped neighbour may itself be empty.
                ctes.append(f"""f{step} AS (SELECT "row", col, coalesce(z, CASE WHEN {index} = {edge}({index}) OVER (PARTITION BY {line}) THEN
                    {'last_value' if fn == 'lag' else 'first_value'}(z) OVER (PARTITION BY {line} ORDER BY {index} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
                    ELSE {fn}(z) OVER (PARTITION BY {line} ORDER BY {index}) END) AS z FROM ({src}) s)""")
    return "WITH " + ", ".join(ctes) + ' SELECT "row", col, R6(coalesce(z, (SELECT quantile_cont(z, 0.5) FROM f8))) AS filled FROM f8'


@query("nodata_fill_W13", _fill_sql())
def _(d):
    return RS.fill_nodata(d.dem.select("row", "col", "elevation"), "elevation").select("row", "col", *r6("filled"))


@query("edge_padding_W14", """
    WITH x AS (SELECT min("row") + 1 AS r0, max("row") - 1 AS r1, min(col) + 1 AS c0, max(col) - 1 AS c1 FROM dem)
    SELECT a."row", a.col, R6(b.ground) AS ground FROM dem a CROSS JOIN x LEFT JOIN dem b ON b."row" = greatest(r0, least(r1, a."row")) AND b.col = greatest(c0, least(c1, a.col))""")
def _(d):
    return RS.pad_edges(d.dem.select("row", "col", "ground"), ["ground"]).select("row", "col", *r6("ground"))


@query("union_of_scenes_U1", "SELECT scene_key, row_id, col_id, R6(lst_c) AS lst_c FROM lst_pixels")
def _(d):
    keep = ["scene_key", "row_id", "col_id"]
    even, odd = (d.lst_pixels.where(F.col("scene_key") % 2 == i) for i in (0, 1))
    return union_all([even.select(*keep, "lst_c"), odd.select("lst_c", *keep)]).select(*keep, *r6("lst_c"))


@query("union_of_green_layers_U1b", "SELECT point_id AS id, kind FROM points UNION ALL SELECT rect_id, kind FROM rects")
def _(d):
    return union_all([d.points.select(F.col("point_id").alias("id"), "kind"), d.rects.select(F.col("rect_id").alias("id"), "kind")])


@query("common_cells_U1c", "SELECT grid_id FROM cell_two_dates WHERE side = 0 INTERSECT SELECT grid_id FROM cell_two_dates WHERE side = 1")
def _(d):
    t = d.cell_two_dates
    return t.where("side = 0").select("grid_id").intersect(t.where("side = 1").select("grid_id"))


@query("unknown_features_U1d", "SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_orderkey NOT IN (SELECT o_custkey FROM orders)")
def _(d):
    wanted, known = d.lineitem.select(F.col("l_orderkey").alias("k")).distinct(), d.orders.select(F.col("o_custkey").alias("k"))
    return wanted.join(known, "k", "left_anti")
