"""Independent SQL statements of the carbon results (DuckDB dialect, kilograms as integer millionths)."""

from __future__ import annotations

from ledgerleaf import dims
from ledgerleaf.oracle.ledger import values_cte

LIB = values_cte(
    "lib",
    "no, fid, scope, cat, act, region, f, unit, method",
    [
        (i, r[0], r[1], r[2], r[3], r[4], round(float(r[5]) * 1000000), r[6].split("/")[-1], r[8])
        for i, r in enumerate(dims.FACTORS)
    ],
)
NAMES = values_cte("catnames", "cat, nm", list(dims.CATEGORY_NAMES))
SCORES = values_cte("scores", "method, score", list(dims.METHOD_SCORES))
CATS = values_cte("cats", "CategoryID, Scope, CategoryName, MethodOrReason, Status", list(dims.CATEGORIES))

ACTIVITY = (
    LIB
    + """,
act AS (SELECT date_trunc('month', l_shipdate) AS d, n_name AS site, n_nationkey AS nk, CAST(l_partkey % 50 AS INTEGER) AS no, CAST(sum(l_quantity) AS BIGINT) AS q
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2, 3, 4),
rows AS (SELECT CAST(d AS TIMESTAMP) AS d, site, nk, a.no, q, scope, CASE WHEN scope = 'Scope 3' THEN cat END AS cat, unit,
  CASE WHEN a.no = 49 THEN 'Unlisted activity' WHEN a.no % 7 = 3 THEN substr(act, 1, 12) || ' (site)' ELSE act END AS activity
  FROM act a JOIN lib l ON a.no = l.no),
actnames AS (SELECT DISTINCT activity FROM rows),
hits AS (SELECT activity, min(CASE WHEN lower(act) = lower(activity) THEN no END) AS ex,
  min(CASE WHEN contains(lower(act), substr(lower(activity), 1, 12)) THEN no END) AS pre FROM actnames CROSS JOIN lib GROUP BY 1),
resolved AS (SELECT r.*, coalesce(ex, pre) AS hit, CASE WHEN ex IS NOT NULL THEN 'exact' WHEN pre IS NOT NULL THEN 'prefix' END AS how
  FROM rows r JOIN hits h ON r.activity = h.activity)"""
)

FACT = (
    ACTIVITY
    + ", "
    + NAMES
    + ", "
    + SCORES
    + """,
fact AS (SELECT r.d, r.site, r.scope, coalesce(r.cat, l.cat) AS cat, r.activity, r.q, l.fid, l.f, l.method, coalesce(s.score, 3) AS score,
  CAST(r.q * l.f AS HUGEINT) AS loc,
  CAST(r.q * CASE WHEN r.scope = 'Scope 2' AND r.nk % 2 = 0 THEN l.f * 65 // 100 ELSE l.f END AS HUGEINT) AS v,
  CAST(year(r.d) AS INTEGER) AS y, strftime(r.d, '%Y-%m') AS ym
  FROM resolved r JOIN lib l ON r.hit = l.no LEFT JOIN scores s ON l.method = s.method),
inv AS (SELECT f.*, nm, CASE WHEN scope = 'Scope 3' THEN 'Cat ' || substr(f.cat, 3) || ' · ' || nm ELSE scope END AS label
  FROM fact f LEFT JOIN catnames c ON f.cat = c.cat),
drv AS (SELECT coalesce(a.y, b.y) AS y, rev, units FROM (SELECT CAST(year(o_orderdate) AS INTEGER) AS y,
   CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 100000000 AS rev FROM orders GROUP BY 1) a FULL JOIN
   (SELECT CAST(year(l_shipdate) AS INTEGER) AS y, sum(l_quantity) AS units FROM lineitem GROUP BY 1) b ON a.y = b.y),
acts AS (SELECT y, {t12} AS a12, {t3} AS a3 FROM inv GROUP BY y),
tot AS (SELECT y, {s1} AS s1, {s2} AS s2, {s3} AS s3, {all} AS tt FROM inv GROUP BY y),
base AS (SELECT {t12} AS b12, {t3} AS b3 FROM inv WHERE y = 1995),
path AS (SELECT CAST(yy AS INTEGER) AS y, round(b12 * (1 - CAST(0.42 AS DOUBLE) * ((yy - 1995) / CAST(10 AS DOUBLE))), 6) AS p12,
   round(b3 * (1 - CAST(0.25 AS DOUBLE) * ((yy - 1995) / CAST(10 AS DOUBLE))), 6) AS p3 FROM base, range(1995, 2006) AS g(yy))"""
)


def t(expr: str) -> str:
    """Millionths of a kilogram to tonnes with six places, half up."""
    return f"CAST(sign({expr}) * ((abs({expr}) + 500) // 1000) AS DOUBLE) / 1000000"


def t_sum(cond: str = "true", col: str = "v") -> str:
    return t(f"CAST(sum(CASE WHEN {cond} THEN {col} END) AS HUGEINT)")


_12, _3 = "scope IN ('Scope 1', 'Scope 2')", "scope = 'Scope 3'"
FACT = FACT.format(
    t12=t_sum(_12), t3=t_sum(_3), s1=f"coalesce({t_sum(chr(39).join(['scope = ', 'Scope 1', '']))}, 0)",
    s2="coalesce(" + t_sum("scope = 'Scope 2'") + ", 0)", s3="coalesce(" + t_sum(_3) + ", 0)", all=t_sum(),
)

RAW = (
    ACTIVITY
    + """,
dirty AS (SELECT r.d AS month, CASE WHEN month(r.d) % 2 = 1 AND month(r.d) < 10 OR month(r.d) = 11 THEN 'fact-b' ELSE 'fact-a' END AS src,
  CASE WHEN r.no % 13 <> 5 THEN r.d END AS d, site, l.scope, l.cat, activity, CASE WHEN r.no % 10 = 9 THEN 0 ELSE q END AS q, q AS rawq, l.fid,
  CASE WHEN r.no % 11 <> 0 THEN l.f END AS f, CASE WHEN r.no % 17 = 5 THEN l.f * 3 WHEN r.no % 11 <> 0 THEN l.f END AS m,
  CASE WHEN r.no % 6 <> 0 THEN l.method ELSE 'Unspecified' END AS method,
  CASE r.no % 7 WHEN 1 THEN 5 WHEN 2 THEN 2 WHEN 3 THEN 1 WHEN 5 THEN 4 ELSE 3 END AS score, r.no % 3 = 0 AS given, r.no
  FROM rows r JOIN lib l ON r.no = l.no),
em AS (SELECT *, CASE WHEN src = 'fact-a' THEN CAST(q * f AS HUGEINT) WHEN given THEN CAST(rawq AS HUGEINT) * 1000000000 + 500000000 END AS loc FROM dirty),
em2 AS (SELECT *, coalesce(CAST(q * m AS HUGEINT), loc) AS mkt FROM em)"""
)


def f(select: str, *more: str) -> str:
    return "WITH " + ", ".join([FACT, *more]) + "\n" + select


def raw(select: str) -> str:
    return f"WITH {RAW}\n{select}"


SITES = """sites AS (SELECT n_name AS SiteID, 'Site ' || n_name AS SiteName, r_name AS Country,
  CASE WHEN n_nationkey % 3 = 0 THEN 'Office' ELSE 'Manufacturing' END AS SiteType, CAST(n_nationkey * 10 + 5 AS INTEGER) AS Employees,
  (['TH', 'VN', 'DE', 'US'])[n_nationkey % 4 + 1] AS GridRegion FROM nation JOIN region ON n_regionkey = r_regionkey)"""

PARETO = f"""
sums AS (SELECT activity, CAST(sum(v) AS HUGEINT) AS v FROM inv WHERE y = 2000 GROUP BY 1),
cums AS (SELECT activity, v, CAST(sum(v) OVER (ORDER BY v DESC, activity ROWS UNBOUNDED PRECEDING) AS HUGEINT) AS c, CAST(sum(v) OVER () AS HUGEINT) AS tt FROM sums),
pareto AS (SELECT activity AS ActivityType, {t('v')} AS tCO2e, round(({t('c')}) / ({t('tt')}), 6) AS Cumulative, round(({t('v')}) / ({t('tt')}), 6) AS Share FROM cums)"""

S3 = f"""
s3 AS (SELECT cat, {t_sum()} AS tt FROM inv WHERE y = 2000 AND {_3} GROUP BY 1),
all15 AS (SELECT c.cat AS CategoryID, 'Cat ' || substr(c.cat, 3) || ' · ' || nm AS ScopeCategory, coalesce(tt, 0) AS tCO2e,
  CASE WHEN tt IS NULL THEN 'Not applicable / not reported' ELSE 'Included' END AS Status,
  round(coalesce(tt, 0) / round(greatest(sum(coalesce(tt, 0)) OVER (), 1), 6), 6) AS Share
  FROM catnames c LEFT JOIN s3 ON c.cat = s3.cat WHERE c.cat LIKE '3.%')"""

STATUS = """
ly AS (SELECT max(y) AS y FROM acts WHERE a12 IS NOT NULL),
st AS (SELECT 'Scope 1+2' AS Target, ly.y, coalesce(a12, 0) AS a, p12 AS p, (SELECT p12 FROM path WHERE y = 2005) AS g, (SELECT a12 FROM acts WHERE y = 1995) AS b
   FROM ly LEFT JOIN acts ON acts.y = ly.y LEFT JOIN path ON path.y = ly.y
  UNION ALL SELECT 'Scope 3', ly.y, coalesce(a3, 0), p3, (SELECT p3 FROM path WHERE y = 2005), (SELECT a3 FROM acts WHERE y = 1995)
   FROM ly LEFT JOIN acts ON acts.y = ly.y LEFT JOIN path ON path.y = ly.y)"""
BAND = """
bd AS (SELECT 'Scope 1+2' AS Target, path.y, coalesce(a12, 0) AS a, p12 AS p FROM path LEFT JOIN acts ON acts.y = path.y WHERE path.y = 2000
  UNION ALL SELECT 'Scope 3', path.y, coalesce(a3, 0), p3 FROM path LEFT JOIN acts ON acts.y = path.y WHERE path.y = 2000)"""
INTENSITY = """
inten AS (SELECT tot.y AS Year, tt AS Total, rev AS RevenueUSDm, units AS UnitsSold, round(tt / rev, 6) AS tCO2e_per_USDm,
  round(coalesce(a12, 0) * 1000 / units, 6) AS kgCO2e_per_unit FROM tot LEFT JOIN acts USING (y) LEFT JOIN drv USING (y))"""
DQ = f"""
dq AS (SELECT {t_sum(col='score * loc')} AS w, {t_sum(col='loc')} AS l FROM inv WHERE y = 2000)"""
KPIS = INTENSITY + "," + DQ + """,
kpi AS (SELECT c.s1 AS Scope1, c.s2 AS Scope2, c.s3 AS Scope3, c.tt AS Total, round(c.s1 - p.s1, 6) AS Scope1_Change, round(c.s2 - p.s2, 6) AS Scope2_Change,
  round(c.s3 - p.s3, 6) AS Scope3_Change, round(c.tt - p.tt, 6) AS Total_Change, round(c.s3 / c.tt, 6) AS Scope3Share, i.tCO2e_per_USDm,
  round(i.tCO2e_per_USDm - j.tCO2e_per_USDm, 6) AS tCO2e_per_USDm_Change, i.kgCO2e_per_unit, (SELECT round(w / greatest(l, 1), 6) FROM dq) AS WeightedDQ
  FROM tot c LEFT JOIN tot p ON p.y = 1999 LEFT JOIN inten i ON i.Year = 2000 LEFT JOIN inten j ON j.Year = 1999 WHERE c.y = 2000)"""
GAP = f"""
gap AS (SELECT {t_sum(col='loc')} AS Location, {t_sum()} AS Market FROM inv WHERE y = 2000 AND scope = 'Scope 2')"""


def _reports() -> dict[str, str]:
    by = lambda cols, where="true": f(f"SELECT {cols}, {t_sum()} AS tCO2e FROM inv WHERE {where} GROUP BY ALL")
    fact_row = "site AS SiteID, scope AS Scope, cat AS CategoryID, activity AS ActivityType, CAST(q AS DOUBLE) AS Quantity"
    change = "CASE fid WHEN 'EF_NG' THEN 2 WHEN 'EF_EL_TH' THEN 3 WHEN 'EF_SP_STEEL' THEN 4 ELSE 1 END"
    supplied = FACT.split("fact AS (")[0] + f"""
      own AS (SELECT *, CASE WHEN no % 5 = 0 THEN (SELECT CAST(l.f AS BIGINT) * 2 FROM lib l WHERE l.no = resolved.no) END AS o FROM resolved)
      SELECT r.d AS Date, r.site AS SiteID, r.scope AS Scope, CASE WHEN o IS NOT NULL THEN r.cat ELSE coalesce(r.cat, l.cat) END AS CategoryID,
        r.activity AS ActivityType, CAST(r.q AS DOUBLE) AS Quantity, CASE WHEN o IS NULL THEN l.fid END AS FactorID,
        CAST(coalesce(o, l.f) AS DOUBLE) / 1000000 AS EmissionFactor, CASE WHEN o IS NULL THEN l.method END AS Method,
        CAST(CASE WHEN o IS NULL THEN coalesce(s.score, 3) ELSE 3 END AS INTEGER) AS DataQualityScore
      FROM own r LEFT JOIN lib l ON r.hit = l.no LEFT JOIN scores s ON l.method = s.method WHERE coalesce(o, l.f) IS NOT NULL"""
    return {
        "ghg_fact_schema": raw("SELECT site AS SiteID, scope AS Scope, activity AS ActivityType, CAST(NULL AS TIMESTAMP) AS Date, CAST(NULL AS INTEGER) AS DataQualityScore, "
            + ", ".join(f"CAST(NULL AS VARCHAR) AS {c}" for c in ("CategoryID", "Unit", "FactorID", "FactorUnit", "Method", "DataSource", "Note")) + ", "
            + ", ".join(f"CAST(NULL AS DOUBLE) AS {c}" for c in ("Quantity", "EmissionFactor", "EmissionFactorMarket", "tCO2e_Location", "tCO2e_Market")) + " FROM dirty"),
        "ghg_fact_clean": raw(f"SELECT d AS Date, {fact_row}, fid AS FactorID, CAST(f AS DOUBLE) / 1000000 AS EmissionFactor, method AS Method, CAST(score AS INTEGER) AS DataQualityScore, strftime(d, '%Y-%m') AS YearMonth, src AS SourceFile FROM dirty"),
        "ghg_emissions": raw(f"SELECT src AS SourceFile, site AS SiteID, activity AS ActivityType, strftime(d, '%Y-%m') AS YearMonth, {t('loc')} AS tCO2e_Location, {t('mkt')} AS tCO2e_Market FROM em2"),
        "ghg_labels": f("SELECT scope AS Scope, cat AS CategoryID, nm AS CategoryName, label AS ScopeCategory, count(*) AS Rows FROM inv GROUP BY ALL"),
        "ghg_site_names": f("SELECT i.site AS SiteID, coalesce(SiteName, i.site) AS SiteName, count(*) AS Rows FROM inv i LEFT JOIN sites s ON i.site = s.SiteID AND Employees % 20 = 5 GROUP BY ALL", SITES),
        "ghg_slice": f(f"SELECT scope AS Scope, cat AS CategoryID, site AS SiteName, count(*) AS Rows, {t_sum(col='loc')} AS tCO2e FROM inv WHERE scope IN ('Scope 1', 'Scope 3') AND cat <> '3.11' GROUP BY ALL"),
        "ghg_resolve_factors": f"WITH {ACTIVITY} SELECT activity AS ActivityType, hit AS lib_no, how AS MatchedBy, count(*) AS Rows FROM resolved GROUP BY ALL",
        "ghg_resolve_factors_region": f"""WITH {ACTIVITY}, {SITES}, regional AS (SELECT r.*, (SELECT min(no) FROM lib l WHERE lower(l.act) = lower(r.activity) AND l.region = s.GridRegion) AS reg
            FROM (SELECT site, activity, hit, how, count(*) AS n FROM resolved GROUP BY ALL) r JOIN sites s ON r.site = s.SiteID)
            SELECT site AS SiteID, activity AS ActivityType, coalesce(reg, hit) AS lib_no, how AS MatchedBy, n AS Rows FROM regional""",
        "ghg_unmatched": f"WITH {ACTIVITY} SELECT activity AS ActivityType, count(*) AS Rows FROM resolved WHERE hit IS NULL GROUP BY 1",
        "ghg_activity_to_fact": f(f"SELECT d AS Date, {fact_row}, fid AS FactorID, CAST(f AS DOUBLE) / 1000000 AS EmissionFactor, method AS Method, CAST(score AS INTEGER) AS DataQualityScore FROM fact"),
        "ghg_activity_to_fact_supplied": "WITH " + supplied,
        "ghg_reprice": raw(f"""SELECT site AS SiteID, activity AS ActivityType, strftime(d, '%Y-%m') AS YearMonth, fid AS FactorID, CAST(nf AS DOUBLE) / 1000000 AS EmissionFactor,
            CAST(nm AS DOUBLE) / 1000000 AS EmissionFactorMarket, coalesce({t('CAST(q * nf AS HUGEINT)')}, {t('loc')}) AS tCO2e_Location, coalesce({t('CAST(q * nm AS HUGEINT)')}, {t('mkt')}) AS tCO2e_Market
            FROM (SELECT *, f * {change} AS nf, CASE WHEN f IS NULL THEN m WHEN f > 0 THEN (f * {change}) * (m // f) ELSE f * {change} END AS nm FROM em2)"""),
        "ghg_site_table": f(
            "SELECT 'Site ' || site AS SiteName, scope AS Scope, "
            + ", ".join(f"coalesce({t_sum(f'y = {y}')}, 0) AS \"{y}\"" for y in range(1995, 2002))
            + f", Country, SiteType, Employees FROM inv JOIN sites ON site = SiteID WHERE {_12} GROUP BY ALL", SITES,
        ),
        "ghg_target_years": f("SELECT y AS Year, rev AS RevenueUSDm, units AS UnitsSold FROM drv"),
        "ghg_slice_values": f("SELECT DISTINCT 'Year' AS Field, CAST(y AS VARCHAR) AS Value FROM inv UNION ALL SELECT DISTINCT 'SiteName', site FROM inv"),
        "ghg_scope_year": f('SELECT y AS Year, s1 AS "Scope 1", s2 AS "Scope 2", s3 AS "Scope 3", tt AS Total FROM tot'),
        "ghg_month_scope": by("ym AS YearMonth, scope AS Scope"),
        "ghg_site_activity": by("site AS SiteName, activity AS ActivityType", f"y = 2000 AND {_12}"),
        "ghg_scope2_month": f(f"SELECT ym AS YearMonth, {t_sum(col='loc')} AS tCO2e_Location, {t_sum()} AS tCO2e_Market FROM inv WHERE scope = 'Scope 2' GROUP BY 1"),
        "ghg_scope1_month": by("ym AS YearMonth, activity AS ActivityType", "scope = 'Scope 1'"),
        "ghg_scope3_all_categories": f("SELECT * FROM all15", S3),
        "ghg_category_status": f("SELECT c.*, tCO2e, Share FROM cats c LEFT JOIN all15 USING (CategoryID) WHERE Scope = 'Scope 3'", S3, CATS),
        "ghg_scope3_trend": by("y AS Year, label AS ScopeCategory", _3),
        "ghg_actuals": f("SELECT y AS Year, a12 AS Scope12_Actual, a3 AS Scope3_Actual FROM acts"),
        "ghg_base_year": f("SELECT b12 AS Scope12_Base, b3 AS Scope3_Base FROM base"),
        "ghg_target_path": f("SELECT y AS Year, p12 AS Scope12_Target, p3 AS Scope3_Target FROM path"),
        "ghg_target_vs_actual": f("SELECT y AS Year, p12 AS Scope12_Target, p3 AS Scope3_Target, a12 AS Scope12_Actual, a3 AS Scope3_Actual FROM path LEFT JOIN acts USING (y)"),
        "ghg_target_status": f("SELECT Target, y AS LatestYear, a AS Actual, p AS Pathway, round(a - p, 6) AS Gap, g AS TargetValue, round(a - g, 6) AS CutStillNeeded, CASE WHEN a > 0 AND g > 0 THEN round(1 - pow(g / a, CAST(1 AS DOUBLE) / greatest(2005 - y, 1)), 6) END AS RequiredAnnualCut, CASE WHEN b <> 0 THEN round(a / b - 1, 6) END AS ChangeSinceBase FROM st", STATUS),
        "ghg_target_band": f("SELECT y AS Year, Target, a AS Actual, p AS Pathway, CASE WHEN a < p * CAST(0.9 AS DOUBLE) THEN 'ahead' WHEN a <= p * CAST(1.1 AS DOUBLE) THEN 'near' ELSE 'behind' END AS Band FROM bd", BAND),
        "ghg_data_quality": f(f"SELECT *, round(tCO2e * (WeightedDQ - 1), 6) AS ImprovementPotential FROM (SELECT label AS ScopeCategory, {t_sum()} AS tCO2e, round(({t_sum(col='score * loc')}) / greatest({t_sum(col='loc')}, 1), 6) AS WeightedDQ FROM inv WHERE y = 2000 GROUP BY 1)"),
        "ghg_method_share": f(f"SELECT *, round(tCO2e / round(sum(tCO2e) OVER (PARTITION BY Year), 6), 6) AS Share FROM (SELECT y AS Year, method AS Method, {t_sum()} AS tCO2e FROM inv GROUP BY 1, 2)"),
        "ghg_scope2_basis_gap": f("SELECT *, round(abs(Location - Market) / nullif(Location, 0), 6) AS RelativeGap, coalesce(abs(Location - Market) / nullif(Location, 0) > 0.02, false) AS IsReported FROM gap", GAP),
        "ghg_sum_category": by("label AS ScopeCategory, y AS Year"),
        "ghg_sum_site": by("site AS SiteName, scope AS Scope, y AS Year"),
        "ghg_hierarchy": f(
            f"""SELECT scope AS Scope, label AS ScopeCategory, activity AS ActivityType, CAST(CASE grouping(scope, label, activity) WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 3 THEN 1 ELSE 0 END AS INTEGER) AS Depth,
            {t_sum()} AS tCO2e, round(({t_sum()}) / (SELECT {t_sum()} FROM leaves), 6) AS Share FROM leaves GROUP BY ROLLUP (scope, label, activity)""",
            "leaves AS (SELECT scope, label, activity, CAST(sum(v) AS HUGEINT) AS v FROM inv WHERE y = 2000 GROUP BY 1, 2, 3 HAVING sum(v) > 0)",
        ),
        "ghg_pareto": f("SELECT *, (SELECT count(*) FROM pareto WHERE Cumulative <= 0.8) + 1 AS N80 FROM pareto", PARETO),
        "ghg_top10": f("SELECT * FROM pareto ORDER BY tCO2e DESC, ActivityType LIMIT 10", PARETO),
        "ghg_yoy_by_category": f(f"SELECT a.*, b.tCO2e AS Previous, round(a.tCO2e - b.tCO2e, 6) AS Change, round(a.tCO2e / nullif(b.tCO2e, 0) - 1, 6) AS ChangeRate FROM cy a LEFT JOIN cy b ON a.ScopeCategory = b.ScopeCategory AND a.Year = b.Year + 1", f"cy AS (SELECT label AS ScopeCategory, y AS Year, {t_sum()} AS tCO2e FROM inv GROUP BY 1, 2)"),
        "ghg_change_bridge": f(f"SELECT 0 AS Step, '1999' AS Label, {t_sum('y = 1999')} AS tCO2e FROM two UNION ALL SELECT 2, '2000', {t_sum('y = 2000')} FROM two UNION ALL SELECT 1, label, {t('CAST(sum(CASE WHEN y = 2000 THEN v ELSE -v END) AS HUGEINT)')} FROM two GROUP BY label", f"two AS (SELECT * FROM inv WHERE {_3} AND y IN (1999, 2000))"),
        "ghg_intensity": f("SELECT * FROM inten", INTENSITY),
        "ghg_kpis": f("SELECT * FROM kpi", KPIS),
        "ghg_findings": f(
            f"""SELECT 1 AS Rank, 'scope3_share' AS Code, CAST(NULL AS VARCHAR) AS Subject, coalesce(Scope3Share, 0) AS Value, Scope3 AS SecondValue FROM kpi
            UNION ALL SELECT * FROM (SELECT 2, 'top_scope3_category', ScopeCategory, round(tCO2e / greatest((SELECT Scope3 FROM kpi), 1), 6), tCO2e FROM all15 ORDER BY tCO2e DESC, ScopeCategory LIMIT 1)
            UNION ALL SELECT 3, 'change_to_previous_year', NULL, round(Total_Change / (Total - Total_Change), 6), round(tCO2e_per_USDm_Change / (tCO2e_per_USDm - tCO2e_per_USDm_Change), 6) FROM kpi
            UNION ALL SELECT 4, 'gap_to_path_scope12', NULL, round(a12 / p12 - 1, 6), CAST(42 AS DOUBLE) FROM path JOIN acts USING (y) WHERE y = 2000
            UNION ALL SELECT 5, 'weighted_data_quality', NULL, WeightedDQ, (SELECT round(coalesce({t_sum("method = 'Spend-based'")}, 0) / greatest({t_sum()}, 1), 6) FROM inv WHERE y = 2000 AND {_3}) FROM kpi
            UNION ALL SELECT 6, 'contractual_instruments', NULL, round(1 - Market / Location, 6), Market FROM gap WHERE abs(Location - Market) / nullif(Location, 0) > 0.02""",
            KPIS, GAP, S3,
        ),
        "snk_inventory_marts": f(
            """SELECT 'by_scope' AS Mart, (SELECT count(*) FROM tot) AS Rows UNION ALL SELECT 'by_category', (SELECT count(*) FROM (SELECT DISTINCT label, y FROM inv))
            UNION ALL SELECT 'by_site', (SELECT count(*) FROM (SELECT DISTINCT site, scope, y FROM inv)) UNION ALL SELECT 'targets', 11
            UNION ALL SELECT 'factors_used', 50 UNION ALL SELECT 'findings', 6""",
        ),
    }


def statements() -> dict[str, str]:
    out = _reports()
    marts = {"by_category": "ghg_sum_category", "by_site": "ghg_sum_site", "targets": "ghg_target_vs_actual", "findings": "ghg_findings"}
    out |= {f"snk_inventory_{mart}": out[name] for mart, name in marts.items()}
    renamed = ", ".join(f'"Scope {n}" AS Scope{n}' for n in (1, 2, 3))
    out["snk_inventory_by_scope"] = f"SELECT Year, {renamed}, Total FROM ({out['ghg_scope_year']})"
    return out
