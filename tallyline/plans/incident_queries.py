"""Statistics, series and map tables on the incident views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import anomalies as A, association as S, concentration as K, distribution as S1
from ..operators import incidents as I, mapping as M, observed as O, series as R
from ..session import scratch_path
from ..sources import files
from .registry import query

AS_OF = "2024-01-25"

# the prepared incident view, as SQL
PREP = """prep AS (
 SELECT *, year(combined_date) AS year, month(combined_date) AS month, dayname(combined_date) AS day_of_week,
  dayofyear(combined_date) AS day_of_year, weekofyear(combined_date) AS week_of_year,
  CAST(date_trunc('month', combined_date) AS DATE) AS month_year,
  CAST(substr(combined_time, 1, 2) AS BIGINT) AS hour, CAST(substr(combined_time, 4, 2) AS BIGINT) AS minute,
  coalesce(primary_type, 'Unknown') AS crime_type, location_description AS location_type,
  'City ' || substr(source_city, 6) AS city
 FROM v_incidents WHERE combined_date BETWEEN DATE '1990-01-01' AND DATE '2024-01-25')"""
DAILY = "daily AS (SELECT combined_date, count(*) AS n FROM v_daily GROUP BY 1)"
MONTHLY = "monthly AS (SELECT CAST(date_trunc('month', combined_date) AS DATE) AS month_year, count(*) AS n FROM v_daily GROUP BY 1)"
INC, DLY = ("v_incidents",), ("v_daily",)


def prep(t):
    return I.prepare(t.v_incidents, AS_OF)


@query("d01_date_validity", """
SELECT count(*) AS total, count(*) FILTER (combined_date IS NULL) AS missing,
 count(*) FILTER (combined_date > DATE '2001-06-30') AS after_as_of,
 count(*) FILTER (combined_date < DATE '1990-01-01') AS before_earliest,
 count(*) FILTER (combined_date BETWEEN DATE '1990-01-01' AND DATE '2001-06-30') AS kept,
 count(*) FILTER (combined_date > DATE '2001-06-30' OR combined_date < DATE '1990-01-01') AS removed
FROM v_daily""", DLY)
def d01(t):
    return I.date_validity(t.v_daily, "2001-06-30")


@query("d02_date_parts", f"""
WITH {PREP} SELECT incident_id, year, month, day_of_week, day_of_year, week_of_year,
 CAST(month_year AS VARCHAR) AS month_year, hour, minute FROM prep""", INC)
def d02(t):
    return prep(t).select("incident_id", "year", "month", "day_of_week", "day_of_year", "week_of_year", "month_year",
                          "hour", "minute")


@query("d02b_series_parts", """
SELECT incident_id, CAST(CAST(date_trunc('week', combined_date) AS DATE) AS VARCHAR) AS week,
 CAST(combined_date AS VARCHAR) AS date_str, coalesce(combined_time, 'Unknown') AS time_str FROM v_incidents""", INC)
def d02b(t):
    return I.add_series_parts(t.v_incidents).select("incident_id", "week", "date_str", "time_str")


@query("d03_labels", """
SELECT incident_id, coalesce(primary_type, 'Unknown') AS crime_type, location_description AS location_type,
 'City ' || substr(source_city, 6) AS city FROM v_incidents""", INC)
def d03(t):
    return I.add_labels(t.v_incidents).select("incident_id", "crime_type", "location_type", "city")


@query("d04a_date_quality", """
WITH f AS (SELECT combined_date AS d, count(*) AS n FROM v_daily GROUP BY 1)
SELECT round(date_diff('day', min(d), max(d)) / 365.25, 6) AS span_years,
 CAST(coalesce(sum(n) FILTER (d > DATE '2001-06-30'), 0) AS BIGINT) AS future_count,
 CAST(coalesce(sum(n) FILTER (d < DATE '1995-03-01'), 0) AS BIGINT) AS very_old_count,
 (SELECT string_agg(CAST(d AS VARCHAR), ',' ORDER BY d) FROM (SELECT d FROM f WHERE d > DATE '2001-06-30' ORDER BY d LIMIT 5)) AS future_sample,
 (SELECT string_agg(CAST(d AS VARCHAR), ',' ORDER BY d) FROM (SELECT d FROM f WHERE d < DATE '1995-03-01' ORDER BY d LIMIT 5)) AS very_old_sample
FROM f""", DLY)
def d04a(t):
    return S1.date_quality(t.v_daily, "2001-06-30", earliest="1995-03-01")


HOURS_SQL = f"""
WITH {PREP}, hc AS (SELECT hour, count(*) AS n FROM prep WHERE hour IS NOT NULL GROUP BY 1),
 tot AS (SELECT count(*) AS t, count(hour) AS w, count(*) FILTER (hour = 0) AS m FROM prep),
 fh AS (SELECT hour, n FROM hc ORDER BY hour LIMIT 1), ph AS (SELECT hour, n FROM hc ORDER BY n DESC, hour LIMIT 1)
SELECT round(100.0 * (t - w) / t, 6) AS missing_time_percentage, w AS records_with_time,
 round(100.0 * w / t, 6) AS time_coverage_percentage, fh.hour AS first_hour, fh.n AS first_hour_count,
 round(fh.n / (SELECT avg(n) FROM hc), 6) AS first_hour_ratio, ph.hour AS peak_hour, ph.n AS peak_hour_count,
 round(ph.n / (SELECT avg(n) FROM hc), 6) AS peak_hour_ratio, round(100.0 * m / w, 6) AS midnight_percentage,
 m > 2 * (SELECT avg(n) FROM hc) AS midnight_spike
FROM tot, fh, ph"""


@query("d04b_time_quality", HOURS_SQL, INC)
def d04b(t):
    return S1.hour_profile(prep(t))


@query("d04c_volume_quality", f"""
WITH {DAILY} SELECT count(*) FILTER (n < 10) AS days_very_low,
 count(*) FILTER (n > (SELECT quantile_cont(n, 0.99) FROM daily)) AS days_very_high,
 count(*) FILTER (n = 0) AS zero_days, max(n) AS max_in_day, min(n) AS min_in_day FROM daily""", DLY)
def d04c(t):
    return S1.volume_quality(I.daily_counts(t.v_daily))


@query("d04c_volume_quality_dense", f"""
WITH {DAILY}, span AS (SELECT min(combined_date) AS lo, max(combined_date) AS hi FROM daily),
 cal AS (SELECT CAST(lo + INTERVAL 1 DAY * i AS DATE) AS d FROM (
   SELECT lo, unnest(range(0, date_diff('day', lo, hi) + 1)) AS i FROM span)),
 dense AS (SELECT d, coalesce(n, 0) AS n FROM cal LEFT JOIN daily ON combined_date = d)
SELECT count(*) FILTER (n < 10) AS days_very_low,
 count(*) FILTER (n > (SELECT quantile_cont(n, 0.99) FROM dense)) AS days_very_high,
 count(*) FILTER (n = 0) AS zero_days, max(n) AS max_in_day, min(n) AS min_in_day FROM dense""", DLY)
def d04c_dense(t):
    return S1.volume_quality(I.dense_daily_counts(I.daily_counts(t.v_daily)))


@query("d04d_coordinate_quality", """
SELECT count(*) FILTER (latitude IS NULL OR longitude IS NULL) AS missing_count,
 round(100.0 * count(*) FILTER (latitude IS NULL OR longitude IS NULL) / count(*), 6) AS missing_percentage,
 count(*) FILTER (latitude = 0 AND longitude = 0) AS zero_count,
 round(min(latitude), 6) AS lat_min, round(max(latitude), 6) AS lat_max,
 round(min(longitude), 6) AS lon_min, round(max(longitude), 6) AS lon_max FROM v_incidents""", INC)
def d04d(t):
    return S1.coordinate_quality(t.v_incidents)


@query("d04_observed_quality", """
WITH p AS (SELECT *, CAST(substr(combined_time, 1, 2) AS BIGINT) AS hour FROM v_incidents), hc AS (SELECT hour, count(*) AS n FROM p WHERE hour IS NOT NULL GROUP BY 1),
 fh AS (SELECT hour, n FROM hc ORDER BY hour LIMIT 1), ph AS (SELECT hour, n FROM hc ORDER BY n DESC, hour LIMIT 1)
SELECT count(*) AS rows, round(date_diff('day', min(combined_date), max(combined_date)) / 365.25, 6) AS span_years,
 count(*) FILTER (combined_date > DATE '2024-01-10') AS future_count, count(*) FILTER (combined_date < DATE '2024-01-03') AS very_old_count,
 round(100.0 * count(*) FILTER (p.hour IS NULL) / count(*), 6) AS missing_time_percentage, count(p.hour) AS records_with_time,
 any_value(fh.hour) AS first_hour, any_value(fh.n) AS first_hour_count, any_value(ph.hour) AS peak_hour, any_value(ph.n) AS peak_hour_count,
 round(100.0 * count(*) FILTER (p.hour = 0) / count(p.hour), 6) AS midnight_percentage, count(*) FILTER (p.hour = 0) > 2 * (SELECT avg(n) FROM hc) AS midnight_spike,
 count(*) FILTER (latitude IS NULL OR longitude IS NULL) AS missing_count, round(100.0 * count(*) FILTER (latitude IS NULL OR longitude IS NULL) / count(*), 6) AS missing_percentage,
 count(*) FILTER (latitude = 0 AND longitude = 0) AS zero_count, round(min(latitude), 6) AS lat_min, round(max(latitude), 6) AS lat_max,
 round(min(longitude), 6) AS lon_min, round(max(longitude), 6) AS lon_max FROM p, fh, ph""", INC)
def d04_observed(t):
    """The prepared table is written once; the figures come with the write."""
    table, seen = O.observe_quality(I.add_date_parts(t.v_incidents), "2024-01-10", earliest="2024-01-03")
    files.write_parquet(table, scratch_path(t.spark, "prepared"))
    return O.quality_figures(t.v_incidents, seen)


@query("d05_daily_counts", f"WITH {DAILY} SELECT CAST(combined_date AS VARCHAR) AS combined_date, n FROM daily", DLY)
def d05(t):
    return I.daily_counts(t.v_daily)


DESCRIBE_SQL = """
SELECT round(avg(n), 6) AS mean, round(quantile_cont(n, 0.5), 6) AS median, round(stddev_samp(n), 6) AS std,
 min(n) AS min, max(n) AS max, round(quantile_cont(n, 0.25), 6) AS q25, round(quantile_cont(n, 0.75), 6) AS q75,
 round(quantile_cont(n, 0.75) - quantile_cont(n, 0.25), 6) AS iqr, round(stddev_samp(n) / avg(n), 6) AS cv,
 round((SELECT avg(power(n - m, 3)) FROM daily, (SELECT avg(n) AS m FROM daily)) / power(stddev_pop(n), 3), 6) AS skewness,
 round((SELECT avg(power(n - m, 4)) FROM daily, (SELECT avg(n) AS m FROM daily)) / power(var_pop(n), 2) - 3, 6) AS kurtosis
FROM daily"""


@query("d06_describe_daily", f"WITH {DAILY} {DESCRIBE_SQL}", DLY)
def d06(t):
    return S1.describe_counts(I.daily_counts(t.v_daily))


@query("d06_overview", f"""
WITH {PREP} SELECT count(*) AS total_records, date_diff('day', min(combined_date), max(combined_date)) AS date_range_days,
 count(DISTINCT city) AS unique_cities, count(DISTINCT crime_type) AS unique_crime_types,
 count(DISTINCT location_type) AS unique_location_types FROM prep""", INC)
def d06_overview(t):
    return S1.overview(I.cube(prep(t)), "n")


@query("d07_most_common", f"""
WITH {PREP}, a AS (SELECT 'crime_type' AS dim, crime_type AS value, count(*) AS n FROM prep GROUP BY 2 ORDER BY n DESC, value LIMIT 1),
 b AS (SELECT 'location_type' AS dim, location_type AS value, count(*) AS n FROM prep GROUP BY 2 ORDER BY n DESC, value LIMIT 1)
SELECT dim, value, n AS count, round(100.0 * n / (SELECT count(*) FROM prep), 6) AS percentage
FROM (SELECT * FROM a UNION ALL SELECT * FROM b)""", INC)
def d07(t):
    p = I.cube(prep(t))
    parts = [S1.most_common(p, d, "n").select(F.lit(d).alias("dim"), "*") for d in ("crime_type", "location_type")]
    return parts[0].union(parts[1])


CAT = "c AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1)"


@query("d08_shannon_diversity", f"""
WITH {CAT} SELECT round(-sum(p * ln(p)), 6) AS diversity_index FROM (SELECT n / (SELECT sum(n) FROM c) AS p FROM c)""")
def d08(t):
    return K.diversity(I.tally(t.orders, ["o_custkey"]))


@query("d09_gini", f"""
WITH {CAT}, r AS (SELECT n, sum(n) OVER (ORDER BY n, k ROWS UNBOUNDED PRECEDING) AS cs FROM c)
SELECT round((count(*) + 1 - 2.0 * sum(cs) / sum(n)) / count(*), 6) AS gini_coefficient FROM r""")
def d09(t):
    return K.gini(I.tally(t.orders, ["o_custkey"]))


@query("d10_herfindahl", f"""
WITH {CAT} SELECT round(sum(p * p), 6) AS herfindahl_index FROM (SELECT n / (SELECT sum(n) FROM c) AS p FROM c)""")
def d10(t):
    return K.herfindahl(I.tally(t.orders, ["o_custkey"]))


@query("d11_top_shares", f"""
WITH {CAT}, r AS (SELECT n, row_number() OVER (ORDER BY n DESC, k) AS rk,
  sum(n) OVER (ORDER BY n DESC, k ROWS UNBOUNDED PRECEDING) AS cs FROM c),
 s AS (SELECT count(*) AS m, sum(n) AS t FROM c)
SELECT round((SELECT cs FROM r WHERE rk = greatest(floor(0.1 * m), 1)) * 100.0 / t, 6) AS top_10_pct_share,
 round((SELECT cs FROM r WHERE rk = greatest(floor(0.2 * m), 1)) * 100.0 / t, 6) AS top_20_pct_share FROM s""")
def d11(t):
    return K.top_shares(I.tally(t.orders, ["o_custkey"]))


@query("d12_autocorrelation", f"""
WITH {DAILY}, l AS (SELECT n, lag(n, 1) OVER (ORDER BY combined_date) AS a, lag(n, 7) OVER (ORDER BY combined_date) AS b FROM daily)
SELECT round(corr(n, a), 6) AS autocorr_lag1, round((SELECT corr(n, b) FROM l), 6) AS autocorr_lag7 FROM l""", DLY)
def d12(t):
    return S1.autocorrelation(I.daily_counts(t.v_daily))


GROWTH = "g AS (SELECT month_year, n, n / lag(n) OVER (ORDER BY month_year) - 1 AS growth FROM monthly)"


@query("d13_monthly_growth", f"""
WITH {MONTHLY}, {GROWTH} SELECT CAST(month_year AS VARCHAR) AS month_year, n, round(growth, 6) AS growth FROM g""", DLY)
def d13(t):
    return S1.monthly_growth(I.monthly_counts(t.v_daily))


@query("d13_growth_summary", f"""
WITH {MONTHLY}, {GROWTH} SELECT count(growth) AS count, round(avg(growth), 6) AS mean, round(stddev_samp(growth), 6) AS std,
 round(min(growth), 6) AS min, round(quantile_cont(growth, 0.25), 6) AS p25, round(quantile_cont(growth, 0.5), 6) AS p50,
 round(quantile_cont(growth, 0.75), 6) AS p75, round(max(growth), 6) AS max FROM g""", DLY)
def d13_summary(t):
    return S1.growth_summary(I.monthly_counts(t.v_daily))


@query("d14_monthly_cv", f"WITH {MONTHLY} SELECT round(stddev_samp(n) / avg(n), 6) AS monthly_cv FROM monthly", DLY)
def d14(t):
    return S1.monthly_cv(I.monthly_counts(t.v_daily))


@query("d15_weekday_peak", """
WITH w AS (SELECT dayname(combined_date) AS d, count(*) AS n FROM v_daily GROUP BY 1)
SELECT (SELECT d FROM w ORDER BY n DESC, d LIMIT 1) AS peak_day_of_week, round(max(n) / avg(n), 6) AS peak_dow_ratio FROM w""", DLY)
def d15(t):
    return S1.weekday_peak(t.v_daily)


@query("d16_hour_profile", f"SELECT first_hour, first_hour_ratio, peak_hour, peak_hour_ratio, records_with_time, "
       f"time_coverage_percentage FROM ({HOURS_SQL})", INC)
def d16(t):
    return S1.hour_profile(I.cube(prep(t)), "n").select(
        "first_hour", "first_hour_ratio", "peak_hour", "peak_hour_ratio", "records_with_time", "time_coverage_percentage")


def chi_sql(src: str, row: str, col: str) -> str:
    return f"""
, x AS (SELECT {row} AS a, {col} AS b, count(*) AS n FROM {src} GROUP BY 1, 2),
 ra AS (SELECT a, sum(n) AS r FROM x GROUP BY 1), cb AS (SELECT b, sum(n) AS c FROM x GROUP BY 1),
 t AS (SELECT CAST(sum(n) AS DOUBLE) AS tot FROM x),
 m AS (SELECT ra.a, cb.b, coalesce(n, 0) AS o, CAST(r AS DOUBLE) * c / tot AS e FROM ra CROSS JOIN cb CROSS JOIN t
       LEFT JOIN x ON x.a = ra.a AND x.b = cb.b),
 d AS (SELECT (SELECT count(*) - 1 FROM ra) * (SELECT count(*) - 1 FROM cb) AS dof,
              least((SELECT count(*) FROM ra), (SELECT count(*) FROM cb)) AS k),
 s AS (SELECT sum(power(CASE WHEN dof = 1 THEN greatest(abs(o - e) - 0.5, 0) ELSE o - e END, 2) / e) AS chi FROM m, d),
 p AS (SELECT chi, dof, k, 1 - (SELECT sum(exp((dof / 2.0 + i) * ln(chi / 2.0) - chi / 2.0 - lgamma(dof / 2.0 + i + 1)))
        FROM (SELECT unnest(range(0, 3000)) AS i)) AS p_value FROM s, d)
SELECT round(chi, 6) AS chi_square, CAST(dof AS BIGINT) AS dof, round(p_value, 6) AS p_value,
 round(sqrt(chi / (tot * (k - 1))), 6) AS cramers_v, p_value < 0.05 AS significant FROM p, t"""


@query("d17_type_location_chi_square", f"WITH {PREP}{chi_sql('prep', 'crime_type', 'location_type')}", INC)
def d17(t):
    return S.chi_square(prep(t), "crime_type", "location_type")


@query("d17_two_by_two_chi_square", "WITH q AS (SELECT combined_date < DATE '2000-01-01' AS early, location_type = 'F' AS fin "
       f"FROM v_daily){chi_sql('q', 'early', 'fin')}", DLY)
def d17_yates(t):
    q = t.v_daily.select((F.col("combined_date") < F.lit("2000-01-01").cast("date")).alias("early"),
                         (F.col("location_type") == "F").alias("fin"))
    return S.chi_square(q, "early", "fin")


@query("d18_hour_type_correlation", f"""
WITH {PREP}, x AS (SELECT hour, crime_type, count(*) AS n FROM prep WHERE hour IS NOT NULL GROUP BY 1, 2),
 h AS (SELECT hour, sum(n) AS h FROM x GROUP BY 1), y AS (SELECT crime_type, sum(n) AS t FROM x GROUP BY 1),
 tot AS (SELECT CAST(sum(n) AS DOUBLE) AS nn FROM x),
 phi AS (SELECT abs((nn * coalesce(n, 0) - h * t) / sqrt(h * (nn - h) * t * (nn - t))) AS p
  FROM h CROSS JOIN y CROSS JOIN tot LEFT JOIN x ON x.hour = h.hour AND x.crime_type = y.crime_type)
SELECT round(max(p), 6) AS max_correlation, round(avg(p), 6) AS mean_correlation FROM phi""", INC)
def d18(t):
    return S.hour_type_correlation(prep(t))


@query("d19_z_outliers", f"""
WITH {DAILY}, s AS (SELECT avg(n) AS m, stddev_pop(n) AS sd FROM daily)
SELECT CAST(combined_date AS VARCHAR) AS combined_date, n, round((n - m) / sd, 6) AS z FROM daily, s WHERE abs((n - m) / sd) > 3""", DLY)
def d19(t):
    return A.z_outliers(I.daily_counts(t.v_daily))


@query("d19_z_outlier_summary", f"""
WITH {DAILY}, s AS (SELECT avg(n) AS m, stddev_pop(n) AS sd FROM daily),
 o AS (SELECT combined_date AS d FROM daily, s WHERE abs((n - m) / sd) > 3)
SELECT count(*) AS count, round(100.0 * count(*) / (SELECT count(*) FROM daily), 6) AS percentage,
 coalesce((SELECT string_agg(CAST(d AS VARCHAR), ',' ORDER BY d) FROM (SELECT d FROM o ORDER BY d LIMIT 10)), '') AS dates FROM o""", DLY)
def d19_summary(t):
    daily = I.daily_counts(t.v_daily)
    return A.outlier_summary(A.z_outliers(daily), daily)


@query("d20_iqr_outlier_summary", f"""
WITH {DAILY}, s AS (SELECT quantile_cont(n, 0.25) AS q1, quantile_cont(n, 0.75) AS q3 FROM daily),
 o AS (SELECT combined_date AS d FROM daily, s WHERE n < q1 - 1.5 * (q3 - q1) OR n > q3 + 1.5 * (q3 - q1))
SELECT count(*) AS count, round(100.0 * count(*) / (SELECT count(*) FROM daily), 6) AS percentage,
 coalesce((SELECT string_agg(CAST(d AS VARCHAR), ',' ORDER BY d) FROM (SELECT d FROM o ORDER BY d LIMIT 10)), '') AS dates FROM o""", DLY)
def d20(t):
    daily = I.daily_counts(t.v_daily)
    return A.outlier_summary(A.iqr_outliers(daily), daily)


@query("d21_extremes", f"""
WITH {DAILY} SELECT round(avg(n), 6) AS mean, round(stddev_samp(n), 6) AS std, max(n) AS max,
 (SELECT CAST(combined_date AS VARCHAR) FROM daily ORDER BY n DESC, combined_date LIMIT 1) AS max_date, min(n) AS min,
 (SELECT CAST(combined_date AS VARCHAR) FROM daily ORDER BY n, combined_date LIMIT 1) AS min_date FROM daily""", DLY)
def d21(t):
    return A.extremes(I.daily_counts(t.v_daily))


@query("d22_top_and_other", f"""
WITH {PREP}, c AS (SELECT location_type AS value, count(*) AS n FROM prep GROUP BY 1),
 r AS (SELECT value, n, row_number() OVER (ORDER BY n DESC, value) AS rk FROM c)
SELECT value, n, false AS is_other FROM r WHERE rk <= 10
UNION ALL SELECT 'Other', CAST(sum(n) AS BIGINT), true FROM r WHERE rk > 10 HAVING sum(n) > 0""", INC)
def d22(t):
    return K.top_and_other(prep(t), "location_type")


@query("d23_ranked_frequency", f"""
WITH {PREP}, c AS (SELECT location_type AS value, count(*) AS n FROM prep GROUP BY 1)
SELECT row_number() OVER (ORDER BY n DESC, value) AS rank, value, n,
 round(100.0 * n / (SELECT sum(n) FROM c), 6) AS percentage FROM c ORDER BY n DESC, value LIMIT 10""", INC)
def d23(t):
    return K.ranked(prep(t), "location_type")


@query("d24_city_breakdown", f"""
WITH {PREP} SELECT city AS value, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM prep), 6) AS percentage
FROM prep GROUP BY 1""", INC)
def d24(t):
    return K.breakdown(prep(t), "city")


MCUBE = """mc AS (SELECT CAST(date_trunc('month', combined_date) AS DATE) AS month_year, crime_type, city, location_type,
 count(*) AS n FROM v_daily GROUP BY ALL)"""


@query("d26_monthly_cube", f"""
WITH {MCUBE} SELECT CAST(month_year AS VARCHAR) AS month_year, crime_type, city, location_type, n FROM mc""", DLY)
def d26(t):
    return R.monthly_cube(t.v_daily)


@query("d27_pair_series", f"""
WITH {MCUBE} SELECT crime_type, city, CAST(month_year AS VARCHAR) AS month_year, CAST(sum(n) AS BIGINT) AS n
FROM mc GROUP BY ALL""", DLY)
def d27(t):
    return R.pair_series(R.monthly_cube(t.v_daily))


@query("d28_series_by_type", f"""
WITH {MCUBE} SELECT crime_type, city, CAST(month_year AS VARCHAR) AS month_year, CAST(sum(n) AS BIGINT) AS n
FROM mc WHERE crime_type = '1-URGENT' GROUP BY ALL""", DLY)
def d28(t):
    return R.select_series(R.pair_series(R.monthly_cube(t.v_daily)), "crime_type", "1-URGENT")


@query("d28_series_by_city", f"""
WITH {MCUBE} SELECT crime_type, city, CAST(month_year AS VARCHAR) AS month_year, CAST(sum(n) AS BIGINT) AS n FROM mc WHERE city = 'city 3' GROUP BY ALL""", DLY)
def d28_city(t):
    return R.select_series(R.pair_series(R.monthly_cube(t.v_daily)), "city", "city 3")


CELLS = """, grid AS (SELECT d, h FROM (SELECT unnest(range(0, 7)) AS d), (SELECT unnest(range(0, 24)) AS h)),
 pc AS (SELECT *, (dayofweek(combined_date) + 6) % 7 AS wd FROM prep)"""
DAYNAME = "list_extract(['Mon','Tue','Wed','Thu','Fri','Sat','Sun'], CAST(d + 1 AS BIGINT))"


@query("d29_weekday_hour_matrix", f"""
WITH {PREP}{CELLS}, c AS (SELECT wd, hour, count(*) AS n FROM pc WHERE hour IS NOT NULL GROUP BY 1, 2)
SELECT {DAYNAME} AS day, h AS hour, coalesce(n, 0) AS n FROM grid LEFT JOIN c ON wd = d AND hour = h""", INC)
def d29(t):
    return R.weekday_hour_matrix(prep(t))


@query("d30_sliced_matrices", f"""
WITH {PREP}{CELLS}, u AS (SELECT 'all' AS dim, 'All' AS value, wd, hour FROM pc
  UNION ALL SELECT 'crime_type', crime_type, wd, hour FROM pc UNION ALL SELECT 'city', city, wd, hour FROM pc),
 sl AS (SELECT DISTINCT dim, value FROM u),
 c AS (SELECT dim, value, wd, hour, count(*) AS n FROM u WHERE hour IS NOT NULL GROUP BY ALL)
SELECT sl.dim, sl.value, {DAYNAME} AS day, h AS hour, coalesce(n, 0) AS n
FROM sl CROSS JOIN grid LEFT JOIN c ON c.dim = sl.dim AND c.value = sl.value AND wd = d AND hour = h""", INC)
def d30(t):
    return R.sliced_matrices(prep(t))


@query("d31_top_series", """
WITH c AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, k LIMIT 10)
SELECT o_custkey AS value, CAST(CAST(date_trunc('month', o_orderdate) AS DATE) AS VARCHAR) AS month_year, count(*) AS n
FROM orders WHERE o_custkey IN (SELECT k FROM c) GROUP BY 1, 2""")
def d31(t):
    return R.top_series(t.orders.withColumn("combined_date", F.col("o_orderdate").cast("date")), "o_custkey")


TOP = """WITH c AS (SELECT {dim} AS k, count(*) AS n FROM v_daily GROUP BY 1 ORDER BY n DESC, k LIMIT 2)
SELECT {dim} AS value, CAST(CAST(date_trunc('month', combined_date) AS DATE) AS VARCHAR) AS month_year, count(*) AS n FROM v_daily WHERE {dim} IN (SELECT k FROM c) GROUP BY 1, 2"""


@query("d31_top_series_by_city", TOP.format(dim="city"), DLY)
def d31_city(t):
    return R.top_series(t.v_daily, "city", 2)


@query("d31_top_series_by_location", TOP.format(dim="location_type"), DLY)
def d31_location(t):
    return R.top_series(t.v_daily, "location_type", 2)


@query("d32_dataset_summary", """
WITH r AS (SELECT 'records' AS section, CAST(min(combined_date) AS VARCHAR) || ' to ' || CAST(max(combined_date) AS VARCHAR) AS value,
  count(*) AS n FROM v_daily),
 a AS (SELECT 'crime_type' AS section, crime_type AS value, count(*) AS n FROM v_daily GROUP BY 2 ORDER BY n DESC, value LIMIT 10),
 b AS (SELECT 'location_type' AS section, location_type AS value, count(*) AS n FROM v_daily GROUP BY 2 ORDER BY n DESC, value LIMIT 10)
SELECT * FROM r UNION ALL SELECT 'city', city, count(*) FROM v_daily GROUP BY 2 UNION ALL SELECT * FROM a UNION ALL SELECT * FROM b""", DLY)
def d32(t):
    return R.dataset_summary(t.v_daily)


@query("d33_map_points", """
WITH g AS (SELECT coalesce(primary_type, 'null') AS g, count(*) AS n FROM v_incidents GROUP BY 1)
SELECT round(latitude, 6) AS latitude, round(longitude, 6) AS longitude, incident_id, CAST(combined_date AS VARCHAR) AS combined_date,
 combined_time, primary_type, location_description, source_city, g || ' (' || n || ')' AS group_label
FROM v_incidents JOIN g ON g = coalesce(primary_type, 'null')""", INC)
def d33(t):
    return M.map_points(t.v_incidents, "primary_type")


@query("d34_density_weighted", """
SELECT CAST(floor(latitude / 0.05) AS BIGINT) AS cell_lat, CAST(floor(longitude / 0.05) AS BIGINT) AS cell_lon, round(sum(value), 6) AS density
FROM v_incidents WHERE latitude <> 0 AND longitude <> 0 GROUP BY 1, 2""", INC)
def d34(t):
    return M.density_grid(M.valid_coordinates(t.v_incidents), 0.05, "value")


@query("d34_density_unweighted", """
SELECT CAST(floor(latitude / 0.05) AS BIGINT) AS cell_lat, CAST(floor(longitude / 0.05) AS BIGINT) AS cell_lon, CAST(count(*) AS DOUBLE) AS density
FROM v_incidents WHERE latitude <> 0 AND longitude <> 0 GROUP BY 1, 2""", INC)
def d34_count(t):
    return M.density_grid(M.valid_coordinates(t.v_incidents), 0.05)


KERNEL = M.gaussian(1.5, 4)
WEIGHTS_SQL = "SELECT unnest([" + ", ".join(str(k - 4) for k in range(9)) + "]) AS k, unnest([" + ", ".join(f"{w!r}::DOUBLE" for w in KERNEL) + "]) AS w"


@query("d34_kernel_density", f"""
WITH g AS (SELECT CAST(floor(latitude / 0.05) AS BIGINT) AS y, CAST(floor(longitude / 0.05) AS BIGINT) AS x, CAST(count(*) AS DOUBLE) AS n
 FROM v_incidents WHERE latitude <> 0 AND longitude <> 0 GROUP BY 1, 2), t AS ({WEIGHTS_SQL})
SELECT y + a.k AS cell_lat, x + b.k AS cell_lon, round(sum(n * a.w * b.w), 6) AS density FROM g, t a, t b GROUP BY 1, 2""", INC)
def d34_kernel(t):
    return M.kernel_density(M.density_grid(M.valid_coordinates(t.v_incidents), 0.05), KERNEL)


@query("d35_further_groups", """
WITH c AS (SELECT location_description AS value, count(*) AS n FROM v_incidents GROUP BY 1)
SELECT value, n, greatest((SELECT count(*) FROM c) - 10, 0) AS further_groups FROM c ORDER BY n DESC, value LIMIT 10""", INC)
def d35(t):
    return K.further_groups(t.v_incidents, "location_description")


@query("c17_valid_coordinates", """
SELECT incident_id, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude FROM v_incidents
WHERE latitude <> 0 AND longitude <> 0 AND incident_id % 29 <> 0""", INC)
def c17(t):
    df = t.v_incidents.withColumn("latitude", F.when(F.col("incident_id") % 29 == 0, "NaN").otherwise(F.col("latitude").cast("string")))
    return M.valid_coordinates(df).select("incident_id", "latitude", "longitude")


@query("c21_bounding_box", """
SELECT incident_id, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude FROM v_incidents
WHERE latitude BETWEEN 41.6 AND 42.1 AND longitude BETWEEN -88.0 AND -87.4""", INC)
def c21(t):
    return M.within_box(t.v_incidents).select("incident_id", "latitude", "longitude")


@query("b21_incidents_around_point", """
WITH d AS (SELECT incident_id, 2 * 6371.0088 * asin(sqrt(least(1.0, power(sin(radians(latitude - 41.85) / 2), 2)
  + cos(radians(41.85)) * cos(radians(latitude)) * power(sin(radians(longitude + 87.65) / 2), 2)))) AS km
 FROM v_incidents WHERE combined_date BETWEEN DATE '2024-01-20' - INTERVAL 14 DAY AND DATE '2024-01-20')
SELECT incident_id, round(km, 6) AS distance_km FROM d WHERE km <= 20""", INC)
def b21(t):
    return M.around(t.v_incidents, 41.85, -87.65, 20.0, "2024-01-20", 14).select("incident_id", "distance_km")


def haversine_sql(lat: str, lon: str, lat0: str, lon0: str) -> str:
    return (f"2 * 6371.0088 * asin(sqrt(least(1.0, power(sin(radians({lat} - {lat0}) / 2), 2)"
            f" + cos(radians({lat0})) * cos(radians({lat})) * power(sin(radians({lon} - {lon0}) / 2), 2))))")


@query("b21_incidents_around_cities", f"""
SELECT incident_id, place_id, round({haversine_sql('i.latitude', 'i.longitude', 'p.latitude', 'p.longitude')}, 6) AS distance_km
FROM v_incidents i JOIN v_places p ON {haversine_sql('i.latitude', 'i.longitude', 'p.latitude', 'p.longitude')} <= p.radius_km
WHERE combined_date BETWEEN DATE '2024-01-20' - INTERVAL 14 DAY AND DATE '2024-01-20'""", (*INC, "v_places"))
def b21_cities(t):
    near = t.v_incidents.filter("combined_date between date '2024-01-06' and date '2024-01-20'")
    return M.around_centres(near, t.v_places, "radius_km", hot_rows=2_000).select("incident_id", "centre.place_id", "distance_km")


@query("b21_points_around_the_globe", f"""
SELECT point_id, post_id, round({haversine_sql('i.latitude', 'i.longitude', 'p.latitude', 'p.longitude')}, 6) AS distance_km
FROM v_globe i JOIN v_posts p ON {haversine_sql('i.latitude', 'i.longitude', 'p.latitude', 'p.longitude')} <= 300""", ("v_globe", "v_posts"))
def b21_globe(t):
    """Posts on both poles, on the date line and between."""
    return M.around_centres(t.v_globe, t.v_posts, 300.0).select("point_id", "centre.post_id", "distance_km")
