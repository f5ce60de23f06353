"""Stints, months, tenures and management changes on the employment and staffing views."""

from __future__ import annotations

from ..operators import spans as S, stints as E, tenures as T
from ..session import cut_lineage
from .registry import query

EMP, STAFF = ("v_employment",), ("v_staff",)

SINGLE = """keep AS (SELECT company, person_id FROM v_employment GROUP BY ALL
  HAVING count(DISTINCT date_of_hire) + CAST(count(*) > count(date_of_hire) AS INT) = 1),
 st AS (SELECT e.company, e.person_id, coalesce(date_of_rehire, date_of_hire) AS s, term_date AS e
  FROM v_employment e JOIN keep k ON e.company = k.company AND e.person_id = k.person_id),
 num AS (SELECT *, row_number() OVER (PARTITION BY company, person_id ORDER BY s, e NULLS LAST) AS rn FROM st)"""


def fold(as_of: str, days: int) -> str:
    """Row-by-row merge as a recursive statement: b, x are start and end of the stint so far, k its number."""
    reach = f"coalesce(f.x, DATE '{as_of}')"
    joins = f"(n.s <= {reach} OR date_diff('day', {reach}, n.s) <= {days})"
    return f"""WITH RECURSIVE {SINGLE},
 f AS (SELECT company, person_id, rn, s AS b, e AS x, 1 AS k FROM num WHERE rn = 1
  UNION ALL
  SELECT n.company, n.person_id, n.rn, CASE WHEN {joins} THEN f.b ELSE n.s END,
   CASE WHEN {joins} THEN CASE WHEN n.e IS NULL OR f.x IS NULL THEN NULL ELSE greatest(f.x, n.e) END ELSE n.e END,
   CASE WHEN {joins} THEN f.k ELSE f.k + 1 END
  FROM f JOIN num n ON n.company = f.company AND n.person_id = f.person_id AND n.rn = f.rn + 1),
 stint AS (SELECT company, person_id, b AS s, x AS e FROM f
  QUALIFY row_number() OVER (PARTITION BY company, person_id, k ORDER BY rn DESC) = 1)"""


def months(as_of: str, days: int, where: str = "") -> str:
    return fold(as_of, days) + f""",
 lim AS (SELECT company, person_id, e, CAST(date_trunc('month', s) AS DATE) AS m0,
  CAST(date_trunc('month', least(coalesce(e, DATE '{as_of}'), DATE '{as_of}')) AS DATE) AS m1 FROM stint),
 ex AS (SELECT company, person_id, e, m1, CAST(m0 + INTERVAL 1 MONTH * i AS DATE) AS m FROM (
  SELECT *, unnest(range(0, date_diff('month', m0, m1) + 1)) AS i FROM lim WHERE m0 <= m1))
SELECT company, person_id, year(m) AS year, month(m) AS month,
 CAST(m = m1 AND e IS NOT NULL AND e <= DATE '{as_of}' AS BIGINT) AS churn_flag FROM ex {where}"""


STINT_OUT = " SELECT company, person_id, CAST(s AS VARCHAR) AS stint_start, CAST(e AS VARCHAR) AS stint_end FROM stint"
LATE, MID = "2002-12-31", "1999-06-30"


@query("e01_single_hire_date", f"""
WITH {SINGLE} SELECT v.company, v.person_id, CAST(date_of_hire AS VARCHAR) AS date_of_hire,
 CAST(date_of_rehire AS VARCHAR) AS date_of_rehire, CAST(term_date AS VARCHAR) AS term_date
FROM v_employment v JOIN keep k ON v.company = k.company AND v.person_id = k.person_id""", EMP)
def e01(t):
    return E.single_hire_date(t.v_employment)


@query("e02_stint_bounds", """
SELECT company, person_id, CAST(coalesce(date_of_rehire, date_of_hire) AS VARCHAR) AS stint_start,
 CAST(term_date AS VARCHAR) AS stint_end FROM v_employment""", EMP)
def e02(t):
    return E.stints(t.v_employment)


@query("e03_coalesce_stints", fold(LATE, 30) + STINT_OUT, EMP)
def e03(t):
    return E.coalesce_stints(E.stints(E.single_hire_date(t.v_employment)), LATE, 30)


@query("e03_coalesce_stints_mid_cutoff", fold(MID, 30) + STINT_OUT, EMP)
def e03_mid(t):
    return E.coalesce_stints(E.stints(E.single_hire_date(t.v_employment)), MID, 30)


@query("e04_expand_months", months(LATE, 30), EMP)
def e04(t):
    return E.expand_months(E.employment_stints(t.v_employment, LATE, 30), LATE)


@query("e05_churn_by_month", f"""
{months(MID, 30).replace('SELECT company, person_id, year(m)', ', emp AS (SELECT company, person_id, year(m)')})
SELECT company, year, month, count(*) AS employed, CAST(sum(churn_flag) AS BIGINT) AS churned FROM emp GROUP BY ALL""", EMP)
def e05(t):
    from pyspark.sql import functions as F
    return E.employment_months(t.v_employment, MID, 30).groupBy("company", "year", "month").agg(
        F.count("*").alias("employed"), F.sum("churn_flag").alias("churned"))


@query("e06_months_from_start", months(LATE, 30, "WHERE m >= DATE '1997-03-15'"), EMP)
def e06(t):
    return E.from_start(E.employment_months(t.v_employment, LATE, 30), "1997-03-15")


@query("e07_employment_months", months(MID, 1, "WHERE m >= DATE '1996-01-01'"), EMP)
def e07(t):
    return E.employment_months(t.v_employment, MID, start="1996-01-01")


@query("e08_employment_stints", fold(MID, 1) + STINT_OUT, EMP)
def e08(t):
    return E.employment_stints(t.v_employment, MID)


MGR = """mgr AS (SELECT * FROM v_staff WHERE ((job_title_cd ILIKE '%general%' AND job_title_cd ILIKE '%manager%')
  OR (job_title_cd ILIKE '%store%' AND job_title_cd ILIKE '%manager%'))
  AND NOT job_title_cd ILIKE '%assistant%' AND NOT job_title_cd ILIKE '%training%')"""
TEN = f"""{MGR}, o AS (SELECT *, row_number() OVER w AS rn, lag(end_date) OVER w AS pe FROM mgr
  WINDOW w AS (PARTITION BY company, unit_id, person_id ORDER BY eff_date, end_date, job_title_cd)),
 g AS (SELECT *, sum(CASE WHEN rn = 1 OR date_diff('day', pe, eff_date) > 30 THEN 1 ELSE 0 END)
   OVER (PARTITION BY company, unit_id, person_id ORDER BY rn) AS gid FROM o),
 f AS (SELECT company, unit_id, person_id, gid, job_title_cd, min(rn) AS r FROM g GROUP BY ALL),
 tt AS (SELECT company, unit_id, person_id, gid, string_agg(job_title_cd, '; ' ORDER BY r) AS titles FROM f GROUP BY ALL),
 b AS (SELECT company, unit_id, person_id, gid, min(eff_date) AS eff_date, max(end_date) AS end_date FROM g GROUP BY ALL),
 ten AS (SELECT b.company, b.unit_id, b.person_id, eff_date, end_date, titles,
   CAST(end_date >= DATE '2000-01-01' AS BIGINT) AS current_tenure,
   CASE WHEN end_date >= DATE '2000-01-01' THEN date_diff('day', eff_date, DATE '2000-01-01')
        ELSE date_diff('day', eff_date, end_date) END AS tenure_length
  FROM b JOIN tt ON b.company = tt.company AND b.unit_id = tt.unit_id AND b.person_id = tt.person_id AND b.gid = tt.gid)"""
AS_OF = "2000-01-01"
PREV_MGR = """pm AS (SELECT t.company, t.unit_id, t.person_id, t.eff_date, p.person_id AS pid, p.tenure_length AS plen
  FROM ten t JOIN ten p ON p.company = t.company AND p.unit_id = t.unit_id AND p.end_date <= t.eff_date AND p.person_id <> t.person_id
  QUALIFY row_number() OVER (PARTITION BY t.company, t.unit_id, t.person_id, t.eff_date
    ORDER BY p.end_date DESC, p.eff_date, p.person_id) = 1)"""
PREV_UNIT = """pu AS (SELECT t.company, t.unit_id, t.person_id, t.eff_date, p.unit_id AS puid, p.tenure_length AS plen
  FROM ten t JOIN ten p ON p.company = t.company AND p.person_id = t.person_id AND p.end_date < t.eff_date
  QUALIFY row_number() OVER (PARTITION BY t.company, t.unit_id, t.person_id, t.eff_date
    ORDER BY p.end_date DESC, p.unit_id, p.eff_date) = 1)"""
BACK = "x.company = t.company AND x.unit_id = t.unit_id AND x.person_id = t.person_id AND x.eff_date = t.eff_date"


@query("e09_manager_titles", f"""
WITH {MGR} SELECT company, unit_id, person_id, CAST(eff_date AS VARCHAR) AS eff_date, CAST(end_date AS VARCHAR) AS end_date,
 job_title_cd FROM mgr""", STAFF)
def e09(t):
    return T.manager_titles(t.v_staff)


@query("e10_gap_sessions", f"""
WITH {TEN} SELECT company, unit_id, person_id, CAST(eff_date AS VARCHAR) AS eff_date, CAST(end_date AS VARCHAR) AS end_date FROM ten""", STAFF)
def e10(t):
    return T.gap_tenures(T.manager_titles(t.v_staff)).drop("job_title_cd")


@query("e11_tenures", f"""
WITH {TEN} SELECT company, unit_id, person_id, CAST(eff_date AS VARCHAR) AS eff_date, CAST(end_date AS VARCHAR) AS end_date,
 titles AS job_title_cd FROM ten""", STAFF)
def e11(t):
    return T.gap_tenures(T.manager_titles(t.v_staff))


@query("e12_tenure_length", f"""
WITH {TEN} SELECT company, unit_id, person_id, CAST(eff_date AS VARCHAR) AS eff_date, CAST(end_date AS VARCHAR) AS end_date,
 titles AS job_title_cd, current_tenure, tenure_length FROM ten""", STAFF)
def e12(t):
    return T.manager_tenures(t.v_staff, AS_OF)


@query("e13_previous_manager", f"""
WITH {TEN}, {PREV_MGR} SELECT t.company, t.unit_id, t.person_id, CAST(t.eff_date AS VARCHAR) AS eff_date,
 x.pid AS previous_manager_id, x.plen AS previous_manager_tenure FROM ten t LEFT JOIN pm x ON {BACK}""", STAFF)
def e13(t):
    return T.with_previous_manager(T.manager_tenures(t.v_staff, AS_OF)).select(
        "company", "unit_id", "person_id", "eff_date", "previous_manager_id", "previous_manager_tenure")


@query("e14_previous_unit", f"""
WITH {TEN}, {PREV_UNIT} SELECT t.company, t.unit_id, t.person_id, CAST(t.eff_date AS VARCHAR) AS eff_date,
 x.puid AS new_manager_previous_store, x.plen AS new_manager_previous_store_tenure FROM ten t LEFT JOIN pu x ON {BACK}""", STAFF)
def e14(t):
    return T.with_previous_unit(T.manager_tenures(t.v_staff, AS_OF)).select(
        "company", "unit_id", "person_id", "eff_date", "new_manager_previous_store", "new_manager_previous_store_tenure")


@query("e15_management_changes", f"""
WITH {TEN}, {PREV_MGR}, {PREV_UNIT} SELECT t.company, t.person_id AS new_manager_id, t.unit_id AS current_store,
 CAST(t.eff_date AS VARCHAR) AS start_date, x.pid AS previous_manager_id, x.plen AS previous_manager_tenure,
 y.puid AS new_manager_previous_store, y.plen AS new_manager_previous_store_tenure
FROM ten t LEFT JOIN pm x ON {BACK} LEFT JOIN pu y ON {BACK.replace('x.', 'y.')}""", STAFF)
def e15(t):
    return T.management_changes(T.manager_tenures(t.v_staff, AS_OF))


@query("e13_active_managers", f"""
WITH {TEN} SELECT t.company, t.unit_id, t.person_id, CAST(t.eff_date AS VARCHAR) AS eff_date, p.person_id AS with_person, CAST(p.eff_date AS VARCHAR) AS with_since
FROM ten t JOIN ten p ON p.company = t.company AND p.unit_id = t.unit_id AND p.eff_date <= t.eff_date AND (p.end_date IS NULL OR p.end_date >= t.eff_date)
WHERE p.person_id <> t.person_id""", STAFF)
def e13_active(t):
    tenures = cut_lineage(T.manager_tenures(t.v_staff, AS_OF))
    met = S.active_at(tenures, tenures, ["company", "unit_id"], "eff_date", "eff_date", "end_date").filter("interval.person_id <> person_id")
    return met.selectExpr("company", "unit_id", "person_id", "eff_date", "interval.person_id as with_person", "interval.eff_date as with_since")


STINTS_SQL = fold(MID, 1)


@query("e07_headcount", f"""
{STINTS_SQL}, times AS ({STINT_OUT}), ev AS (SELECT company, CAST(stint_start AS DATE) AS day FROM times UNION SELECT company, CAST(stint_end AS DATE) + 1 FROM times WHERE stint_end IS NOT NULL)
SELECT ev.company, CAST(ev.day AS VARCHAR) AS day, count(*) FILTER (CAST(st.stint_start AS DATE) = ev.day) AS arrivals,
 count(*) FILTER (CAST(st.stint_end AS DATE) + 1 = ev.day) AS departures,
 count(*) FILTER (CAST(st.stint_start AS DATE) <= ev.day AND (st.stint_end IS NULL OR CAST(st.stint_end AS DATE) >= ev.day)) AS headcount
FROM ev LEFT JOIN times st ON st.company = ev.company GROUP BY 1, 2, ev.day""", EMP)
def e07_headcount(t):
    return S.headcount(E.employment_stints(t.v_employment, MID), ["company"], "stint_start", "stint_end")
