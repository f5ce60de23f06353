"""The full statistics report: six sections from one cube."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.joins import one_row
from ..operators import anomalies as A, association as S, concentration as K, distribution as D, incidents as I
from ..session import cut_lineage

DIMS = ("crime_type", "location_type")


def _section(parts: dict[str, DataFrame]):
    """Named one-row tables as one struct of scalar subqueries."""
    return F.struct(*[one_row(p).alias(name) for name, p in parts.items()])


def statistics_report(prepared: DataFrame, as_of: str, raw: DataFrame | None = None) -> DataFrame:
    """One row with a struct per section.

    The incidents are read into the cube (date, hour, type, location, city) and the tallies of
    its dimensions, which are written to the checkpoint folder; only the coordinate figures, and the date
    diagnostics (from ``raw``, the unfiltered dates, if given), read rows again, two columns and one column wide.
    """
    cube = cut_lineage(I.cube(prepared))
    daily = cut_lineage(I.daily_counts(cube, weight="n"))
    monthly = I.monthly_counts(daily, weight="n")
    counts = {d: cut_lineage(I.tally(cube, [d], "n")) for d in DIMS}
    # sections that show the same figure share one table
    hours, gini = D.hour_profile(cube, "n"), {d: K.gini(counts[d]) for d in DIMS}
    dates = I.daily_counts(raw if raw is not None else prepared)
    diagnostics = {
        "dates": D.date_quality(dates, as_of, weight="n"), "times": hours, "volume": D.volume_quality(daily)}
    if {"latitude", "longitude"} <= set(prepared.columns):
        diagnostics["coordinates"] = D.coordinate_quality(prepared)
    basic = {"overview": D.overview(cube, "n"), "daily": D.describe_counts(daily)}
    for d in DIMS:
        basic |= {f"{d}_most_common": D.most_common(counts[d], d, "n"), f"{d}_diversity": K.diversity(counts[d]), f"{d}_gini": gini[d]}
    temporal = {"autocorrelation": D.autocorrelation(daily), "monthly_growth": D.growth_summary(monthly),
                "monthly": D.monthly_cv(monthly), "weekday": D.weekday_peak(daily, "n"), "hours": hours}
    correlation = {"type_location": S.chi_square(cube, *DIMS, weight="n"), "hour_type": S.hour_type_correlation(cube, weight="n")}
    concentration = {}
    for d in DIMS:
        concentration |= {f"{d}_shares": K.top_shares(counts[d]), f"{d}_gini": gini[d], f"{d}_herfindahl": K.herfindahl(counts[d])}
    anomalies = {"z_score": A.outlier_summary(A.z_outliers(daily), daily), "iqr": A.outlier_summary(A.iqr_outliers(daily), daily),
                 "extremes": A.extremes(daily)}
    sections = {"diagnostics": diagnostics, "basic": basic, "temporal": temporal, "correlation": correlation,
                "concentration": concentration, "anomalies": anomalies}
    one = prepared.sparkSession.range(1)
    return one.select(*[_section(parts).alias(name) for name, parts in sections.items()])
