"""Every figure of the statistics report, one row each, against the statements of the single operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..operators import incidents as I
from . import bindings
from .incident_queries import AS_OF, CAT, INC, PREP, prep
from .registry import ORACLES, query
from .report import DIMS, statistics_report
from .source_queries import report


def figures(df: DataFrame, parts: list[str]) -> DataFrame:
    """(part, field, number, label) of the fields of ``section.part`` structs; numbers as doubles, all else as text."""
    rows = []
    for part in parts:
        section, name = part.split(".")
        kinds = df.schema[section].dataType[name].dataType
        for f in kinds.fields:
            value: Column = F.col(f"{part}.{f.name}")
            number = isinstance(f.dataType, T.NumericType)
            rows.append(F.struct(F.lit(part).alias("part"), F.lit(f.name).alias("field"), (F.round(value.cast("double"), 6) if number else F.lit(None).cast("double")).alias("number"),
                                 (F.lit(None) if number else value).cast("string").alias("label")))
    return df.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def figures_sql(parts: dict[str, str]) -> str:
    one = """SELECT '{part}' AS part, field, round(TRY_CAST(v AS DOUBLE), 6) AS number, CASE WHEN TRY_CAST(v AS DOUBLE) IS NULL THEN v END AS label
 FROM (UNPIVOT (SELECT coalesce(CAST(COLUMNS(*) AS VARCHAR), chr(0)) FROM ({sql})) ON COLUMNS(*) INTO NAME field VALUE v)"""
    body = " UNION ALL ".join(one.format(part=p, sql=s) for p, s in parts.items())
    return f"SELECT part, field, number, CASE WHEN label <> chr(0) THEN label END AS label FROM ({body})"


DAILY_PARTS = {
    "basic.daily": "d06_describe_daily", "diagnostics.volume": "d04c_volume_quality", "temporal.autocorrelation": "d12_autocorrelation",
    "temporal.monthly_growth": "d13_growth_summary", "temporal.monthly": "d14_monthly_cv", "temporal.weekday": "d15_weekday_peak",
    "anomalies.z_score": "d19_z_outlier_summary", "anomalies.iqr": "d20_iqr_outlier_summary", "anomalies.extremes": "d21_extremes"}


@query("d25_report_of_days", figures_sql({p: ORACLES[q] for p, q in DAILY_PARTS.items()}))
def d25_days(t):
    return figures(report(t), list(DAILY_PARTS))


def of_prepared(name: str, dim: str) -> str:
    """An operator's statement, with the counts of a dimension of the prepared incidents in place of its own."""
    text = ORACLES[name]
    assert CAT in text
    return bindings.with_views(text.replace(CAT, f"{PREP}, c AS (SELECT {dim} AS k, count(*) AS n FROM prep GROUP BY 1)"), INC)


def most_common_sql(dim: str) -> str:
    return bindings.with_views(f"""WITH {PREP} SELECT {dim} AS value, count(*) AS count, round(100.0 * count(*) / (SELECT count(*) FROM prep), 6) AS percentage
 FROM prep GROUP BY 1 ORDER BY count DESC, value LIMIT 1""", INC)


INCIDENT_PARTS = {
    "diagnostics.dates": bindings.with_views(f"""
WITH f AS (SELECT combined_date AS d, count(*) AS n FROM v_incidents GROUP BY 1)
SELECT round(date_diff('day', min(d), max(d)) / 365.25, 6) AS span_years, CAST(coalesce(sum(n) FILTER (d > DATE '{AS_OF}'), 0) AS BIGINT) AS future_count, 0 AS very_old_count,
 (SELECT string_agg(CAST(d AS VARCHAR), ',' ORDER BY d) FROM (SELECT d FROM f WHERE d > DATE '{AS_OF}' ORDER BY d LIMIT 5)) AS future_sample, '' AS very_old_sample FROM f""", INC),
    "diagnostics.times": ORACLES["d04b_time_quality"], "temporal.hours": ORACLES["d04b_time_quality"], "basic.overview": ORACLES["d06_overview"],
    "diagnostics.coordinates": bindings.with_views(f"""
WITH {PREP} SELECT count(*) FILTER (latitude IS NULL OR longitude IS NULL) AS missing_count, round(100.0 * count(*) FILTER (latitude IS NULL OR longitude IS NULL) / count(*), 6) AS missing_percentage,
 count(*) FILTER (latitude = 0 AND longitude = 0) AS zero_count, round(min(latitude), 6) AS lat_min, round(max(latitude), 6) AS lat_max, round(min(longitude), 6) AS lon_min,
 round(max(longitude), 6) AS lon_max FROM prep""", INC),
    "correlation.type_location": ORACLES["d17_type_location_chi_square"], "correlation.hour_type": ORACLES["d18_hour_type_correlation"],
}
for _dim in DIMS:
    INCIDENT_PARTS |= {
        f"basic.{_dim}_most_common": most_common_sql(_dim), f"basic.{_dim}_diversity": of_prepared("d08_shannon_diversity", _dim), f"basic.{_dim}_gini": of_prepared("d09_gini", _dim),
        f"concentration.{_dim}_shares": of_prepared("d11_top_shares", _dim), f"concentration.{_dim}_gini": of_prepared("d09_gini", _dim),
        f"concentration.{_dim}_herfindahl": of_prepared("d10_herfindahl", _dim)}


@query("d25_report_of_incidents", figures_sql(INCIDENT_PARTS))
def d25_incident_figures(t):
    return figures(statistics_report(prep(t), AS_OF, I.parse_date(t.v_incidents)), list(INCIDENT_PARTS))
