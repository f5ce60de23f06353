"""Manager tenures by gap, and who preceded whom."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.joins import repeat_rows, spread_by
from ..session import cut_lineage

UNIT = ["company", "unit_id"]
PERSON = ["company", "person_id"]
KEYS = ["company", "unit_id", "person_id"]


def manager_titles(df: DataFrame, title: str = "job_title_cd") -> DataFrame:
    """General or store managers, neither assistant nor in training; no title is no manager."""
    has = {w: F.col(title).ilike(f"%{w}%") for w in ("general", "store", "manager", "assistant", "training")}
    return df.filter((has["general"] | has["store"]) & has["manager"] & ~has["assistant"] & ~has["training"])


def gap_tenures(df: DataFrame, gap_days: int = 30, keys: list[str] = KEYS) -> DataFrame:
    """Tenures: a row opens a new one when it starts more than ``gap_days`` after the end of the previous row.

    The previous row counts, not the latest end so far. Rows are ordered by
    start, end (a missing end last) and title; after a missing end no new tenure
    opens, and the tenure's own end is missing. Titles are joined in order of
    appearance. Rows without a start cannot be placed and are left out.

    Rows of one start day and title are combined before the shuffle, as all but
    reversed rows (ending more than ``gap_days`` before they start) continue each
    other: the windows see one row per calendar day and title, however many rows
    a key has. Reversed rows each open a tenure of their own and are combined
    only with their exact copies.
    """
    eff, end = F.col("eff_date"), F.col("end_date")
    reversed_ = F.coalesce(F.datediff(eff, end) > gap_days, F.lit(False))
    days = df.filter(eff.isNotNull()).groupBy(
        *keys, "eff_date", F.when(reversed_, end).alias("rev_end"), "job_title_cd",
    ).agg(
        F.coalesce(F.min(end), F.lit("9999-12-31").cast("date")).alias("first_end"),
        F.max(end).alias("last_end"), F.count_if(end.isNull()).alias("open"), F.count(F.lit(1)).alias("copies"))
    days = spread_by(days, keys, df.count())      # one exchange that serves all windows and the last aggregate
    # a reversed row stands alone within its day, all other rows of a day form one step
    day = W.partitionBy(*keys, "eff_date", "rev_end", F.when(F.col("rev_end").isNotNull(), F.col("job_title_cd")))
    whole = day.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    place = [eff, F.col("rev_end").asc_nulls_last(), F.col("job_title_cd")]
    key = W.partitionBy(*keys).orderBy(*place)
    steps = days.withColumns({
        "day_end": F.when(F.max("open").over(whole) == 0, F.max("last_end").over(whole)),
        "leads": F.row_number().over(day.orderBy("job_title_cd")) == 1})
    gap = F.datediff(eff, F.lag("day_end").over(key))
    opens = F.col("leads") & ((F.row_number().over(key) == 1) | F.coalesce(gap > gap_days, F.lit(False)))
    numbered = steps.withColumn("opens", opens.cast("int")).withColumn("tenure", F.sum("opens").over(key))
    rev = F.col("rev_end").isNotNull()
    seen = F.struct(eff.alias("eff"), (~rev).alias("normal"), F.col("first_end").alias("e"), F.col("job_title_cd").alias("t"))
    titles = F.array_distinct(F.transform(F.array_sort(F.collect_list(seen)), lambda x: x["t"]))
    # a reversed row is the last of its tenure; its further copies each stand alone
    tenures = numbered.groupBy(*keys, "tenure").agg(
        F.min("eff_date").alias("first"),
        F.when(F.max("open") == 0, F.max("last_end")).alias("last"),
        F.array_join(titles, "; ", "NA").alias("titles"),
        F.max(F.when(rev, eff)).alias("rev_eff"), F.max("rev_end").alias("rev_end"),
        F.max(F.when(rev, F.col("job_title_cd"))).alias("rev_title"),
        (1 + F.coalesce(F.max(F.when(rev, F.col("copies") - 1)), F.lit(0))).alias("n"))
    one = F.col("i") == 1
    return repeat_rows(tenures, "n", "i").select(
        *keys, F.when(one, F.col("first")).otherwise(F.col("rev_eff")).alias("eff_date"),
        F.when(one, F.col("last")).otherwise(F.col("rev_end")).alias("end_date"),
        F.when(one, F.col("titles")).otherwise(F.coalesce("rev_title", F.lit("NA"))).alias("job_title_cd"))


def add_length(df: DataFrame, as_of: str) -> DataFrame:
    """``current_tenure`` is 1 when the end is not before ``as_of``; length in days, up to ``as_of`` if current."""
    cutoff = F.lit(as_of).cast("date")
    current = F.col("end_date") >= cutoff
    return df.withColumns({
        "current_tenure": F.when(current, 1).when(~current, 0),
        "tenure_length": F.when(current, F.datediff(cutoff, "eff_date"))
                          .when(~current, F.datediff("end_date", "eff_date"))})


def manager_tenures(df: DataFrame, as_of: str, gap_days: int = 30) -> DataFrame:
    return add_length(gap_tenures(manager_titles(df), gap_days), as_of)


def _carry(events: DataFrame, keys: list[str], names: list[str], ends_first: bool, rows: int) -> DataFrame:
    """The last ``names`` known at each start date: ends and starts merged in date order, one row per day and kind.

    ``ends_first`` decides whether an end on the start day itself is known.
    """
    kind = F.col("is_start") if ends_first else ~F.col("is_start")
    upto = W.partitionBy(*keys).orderBy("day", kind).rowsBetween(W.unboundedPreceding, 0)
    return spread_by(events, keys, 2 * rows).select(*keys, "day", "is_start", *[F.last(n, ignorenulls=True).over(upto).alias(n) for n in names]) \
        .filter("is_start").drop("is_start")


def previous_at_unit(tenures: DataFrame, rows: int | None = None) -> DataFrame:
    """For each (company, unit, start day) the last leaver by then and the last leaver who is someone else.

    Per unit and end day only the two preferred persons are kept (earliest start
    first); the ranking filter prunes them before the shuffle. The windows then
    see at most two rows per unit and calendar day, and one row per start day.
    """
    ended = tenures.filter("end_date is not null")
    # start day and length in one long, which a hash aggregate can hold: earliest start, then shortest
    start_day = F.datediff("eff_date", F.lit("1970-01-01").cast("date")).cast("bigint")
    best = ended.groupBy(*UNIT, "end_date", "person_id").agg(
        F.min(F.shiftleft(start_day, 32) + F.col("tenure_length") + F.lit(1 << 31)).alias("packed"))
    best = best.select(*UNIT, "end_date", "person_id", F.shiftright("packed", 32).alias("start_day"),
                       (F.col("packed").bitwiseAND(F.lit((1 << 32) - 1)) - F.lit(1 << 31)).cast("int").alias("tenure_length"))
    day = W.partitionBy(*UNIT, "end_date").orderBy("start_day", "person_id")
    two = best.withColumn("rk", F.row_number().over(day)).filter("rk <= 2")
    # preferred leaver last within a day, so 'last so far' is the preferred one
    line = W.partitionBy(*UNIT).orderBy("end_date", F.col("rk").desc())
    who = F.struct("person_id", "tenure_length")
    prior = F.lag("who").over(line)
    ranked = two.withColumn("who", who).withColumn("prior", prior)
    turned = F.when(F.col("prior.person_id") != F.col("person_id"), F.col("prior"))
    other = F.last(turned, ignorenulls=True).over(line.rowsBetween(W.unboundedPreceding, 0))
    ends = ranked.withColumn("other", other).filter("rk = 1").select(
        *UNIT, F.col("end_date").alias("day"), F.lit(False).alias("is_start"),
        F.struct(F.col("who").alias("first"), F.col("other").alias("other")).alias("leaver"))
    starts = tenures.select(*UNIT, F.col("eff_date").alias("day")).distinct().select(
        *UNIT, "day", F.lit(True).alias("is_start"), F.lit(None).cast(ends.schema["leaver"].dataType).alias("leaver"))
    return _carry(ends.unionByName(starts), UNIT, ["leaver"], ends_first=True, rows=tenures.count() if rows is None else rows)


def previous_of_person(tenures: DataFrame, rows: int | None = None) -> DataFrame:
    """For each (company, person, start day) the tenure that ended last before that day."""
    ended = tenures.filter("end_date is not null")
    ends = ended.groupBy(*PERSON, "end_date").agg(
        F.min(F.struct("unit_id", "eff_date", "tenure_length")).alias("past")
    ).select(*PERSON, F.col("end_date").alias("day"), F.lit(False).alias("is_start"), "past")
    starts = tenures.select(*PERSON, F.col("eff_date").alias("day")).distinct().select(
        *PERSON, "day", F.lit(True).alias("is_start"), F.lit(None).cast(ends.schema["past"].dataType).alias("past"))
    return _carry(ends.unionByName(starts), PERSON, ["past"], ends_first=False, rows=tenures.count() if rows is None else rows)


def with_previous_manager(tenures: DataFrame) -> DataFrame:
    """Inclusive backward as-of lookup at the unit, another person only; the tenures are written once to the checkpoint folder."""
    tenures, at = cut_lineage(tenures), [*UNIT, "eff_date"]
    rows = tenures.count()
    known = previous_at_unit(tenures, rows).withColumnRenamed("day", "eff_date")
    joined = spread_by(tenures, at, rows).join(spread_by(known, at, rows), at, "left")
    first, other = F.col("leaver.first"), F.col("leaver.other")
    pick: Column = F.when(first["person_id"] != F.col("person_id"), first).otherwise(other)
    return joined.withColumns({"previous_manager_id": pick["person_id"],
                               "previous_manager_tenure": pick["tenure_length"]}).drop("leaver")


def with_previous_unit(tenures: DataFrame) -> DataFrame:
    """Strict backward as-of lookup over all units of the person; the tenures are written once to the checkpoint folder."""
    tenures, at = cut_lineage(tenures), [*PERSON, "eff_date"]
    rows = tenures.count()
    known = previous_of_person(tenures, rows).withColumnRenamed("day", "eff_date")
    return spread_by(tenures, at, rows).join(spread_by(known, at, rows), at, "left").withColumns({
        "new_manager_previous_store": F.col("past.unit_id"),
        "new_manager_previous_store_tenure": F.col("past.tenure_length")}).drop("past")


def management_changes(tenures: DataFrame) -> DataFrame:
    """One row per tenure with the previous manager of the unit and the previous unit of the manager.

    Both lookups are windows over one row per day, joined back by equality: no
    range join, and no group larger than the calendar.
    """
    return with_previous_unit(with_previous_manager(tenures)).select(
        "company", F.col("person_id").alias("new_manager_id"), F.col("unit_id").alias("current_store"),
        F.col("eff_date").alias("start_date"), "previous_manager_id", "previous_manager_tenure",
        "new_manager_previous_store", "new_manager_previous_store_tenure")
