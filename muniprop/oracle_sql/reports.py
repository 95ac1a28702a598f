"""DuckDB oracle SQL for the report operators (K01-K28), over the fx-props fixture."""

from __future__ import annotations

from muniprop.fixtures import FX_PROPS_SQL, duck_fixture
from muniprop.operators.reports import QUALITY_FIELDS, QUALITY_GAP_BELOW, SCORE_FIELDS


def pct(a: str, b: str, d: int = 2) -> str:
    return f"ROUND(100.0 * CAST({a} AS DOUBLE) / NULLIF(CAST({b} AS DOUBLE), 0), {d})"


def rank(order: str, part: str = "kommune_key") -> str:
    return f"CAST(row_number() OVER (PARTITION BY {part} ORDER BY {order}) AS INTEGER)"


BASE = f"""WITH properties AS ({duck_fixture(FX_PROPS_SQL)}),
p AS (
  SELECT *,
    lower(trim(replace(replace(kommune, ' Kommune', ''), ' kommune', ''))) AS kommune_key,
    COALESCE(bruksareal_totalt, 0.0) AS area,
    COALESCE(adresse, adressenavn, '-') AS address_label
  FROM properties
)"""

PROBLEM = "(" + " OR ".join(
    f"lower(COALESCE(bygningsstatus, '')) LIKE '%{t}%'" for t in ("riving", "brenning", "kondemn", "ikke godkjent")
) + ")"

HERITAGE = "(COALESCE(har_sefrakminne, 0) = 1 OR COALESCE(har_kulturminne, 0) = 1 OR COALESCE(skjermingsverdig, 0) = 1)"

OCC = """occ AS (
  SELECT kommune_key, forenklet_bygningskategori AS occupancy_category,
         COUNT(*) AS building_count, SUM(area) AS total_bruksareal
  FROM p WHERE forenklet_bygningskategori IS NOT NULL AND trim(forenklet_bygningskategori) <> ''
  GROUP BY 1, 2
)"""

METRICS = """m AS (
  SELECT kommune_key,
    COUNT(*) AS total_properties,
    SUM(area) AS total_bruksareal,
    SUM(CASE WHEN COALESCE(har_sefrakminne, 0) = 1 THEN 1 ELSE 0 END)::BIGINT AS sefrak_count,
    SUM(CASE WHEN COALESCE(har_kulturminne, 0) = 1 THEN 1 ELSE 0 END)::BIGINT AS kulturminne_count,
    SUM(CASE WHEN COALESCE(skjermingsverdig, 0) = 1 THEN 1 ELSE 0 END)::BIGINT AS skjermingsverdig_count,
    SUM(CASE WHEN """ + HERITAGE + """ THEN 1 ELSE 0 END)::BIGINT AS any_flag_total,
    SUM(CASE WHEN COALESCE(antall_underenheter, 0) > 0 THEN 1 ELSE 0 END)::BIGINT AS with_tenants_count,
    SUM(CASE WHEN COALESCE(antall_underenheter, 0) > 0 THEN area ELSE 0.0 END) AS with_tenants_area,
    MAX(COALESCE(antall_underenheter, 0)) AS max_underenheter,
    SUM(CASE WHEN COALESCE(antall_eiere, 0) > 1 THEN 1 ELSE 0 END)::BIGINT AS multi_owner_count,
    SUM(CASE WHEN area > 0 THEN 1 ELSE 0 END)::BIGINT AS area_valid,
    SUM(CASE WHEN adresse IS NOT NULL AND trim(adresse) <> '' THEN 1 ELSE 0 END)::BIGINT AS address_present,
    SUM(CASE WHEN lat IS NOT NULL AND lon IS NOT NULL THEN 1 ELSE 0 END)::BIGINT AS geo_present,
    SUM(CASE WHEN vannforsynings_kode_id IS NOT NULL AND avlops_kode_id IS NOT NULL THEN 1 ELSE 0 END)::BIGINT AS utilities_present,
    SUM(CASE WHEN oppvarmings_kode_ids IS NOT NULL OR energikilde_kode_ids IS NOT NULL THEN 1 ELSE 0 END)::BIGINT AS heating_energy_present,
    SUM(CASE WHEN bygningsstatus IS NOT NULL AND trim(bygningsstatus) <> '' THEN 1 ELSE 0 END)::BIGINT AS status_present,
    SUM(CASE WHEN tek_standard IS NOT NULL AND trim(tek_standard) <> '' THEN 1 ELSE 0 END)::BIGINT AS tek_present
  FROM p GROUP BY 1
)"""


def q(*ctes: str, select: str) -> str:
    return BASE + "".join(f",\n{c}" for c in ctes) + "\n" + select


# ---------------------------------------------------------------- building-block CTEs

K01 = OCC + """,
k01 AS (
  SELECT * FROM (
    SELECT kommune_key, """ + rank("total_bruksareal DESC, occupancy_category") + """ AS rank,
      occupancy_category, building_count, total_bruksareal,
      """ + pct("total_bruksareal", "SUM(total_bruksareal) OVER (PARTITION BY kommune_key)") + """ AS share_percent
    FROM occ) WHERE rank <= 30
)"""

K02 = """k02 AS (
  SELECT kommune_key, occupancy_category, total_bruksareal, building_count FROM (
    SELECT *, """ + rank("total_bruksareal DESC, building_count DESC, occupancy_category") + """ AS rn FROM occ
  ) WHERE rn = 1
)"""

K04 = METRICS + """,
k04 AS (
  SELECT kommune_key,
    total_properties AS selected_properties,
    ROUND(total_bruksareal, 1) AS selected_bruksareal,
    ROUND(100.0 * CAST(total_properties AS DOUBLE) / GREATEST(SUM(total_properties) OVER (), 1), 2) AS property_share_percent,
    ROUND(100.0 * total_bruksareal / GREATEST(SUM(total_bruksareal) OVER (), 1.0), 2) AS area_share_percent,
    CAST(SUM(total_properties) OVER () AS BIGINT) AS portfolio_total_properties,
    ROUND(SUM(total_bruksareal) OVER (), 1) AS portfolio_total_bruksareal
  FROM m
)"""

K05 = """k05g AS (
  SELECT kommune_key, kommune, COUNT(*) AS property_count, SUM(area) AS total_bruksareal FROM p GROUP BY 1, 2
),
k05 AS (
  SELECT * FROM (
    SELECT kommune_key, """ + rank("total_bruksareal DESC, property_count DESC, kommune") + """ AS rank,
      kommune, property_count, total_bruksareal,
      """ + pct("property_count", "SUM(property_count) OVER ()") + """ AS property_share_percent,
      """ + pct("total_bruksareal", "SUM(total_bruksareal) OVER ()") + """ AS area_share_percent,
      regexp_replace(lower(trim(regexp_replace(COALESCE(kommune, ''), '\\s+', ' ', 'g'))), ' kommune$', '')
        = regexp_replace(lower(trim(regexp_replace(kommune_key, '\\s+', ' ', 'g'))), ' kommune$', '') AS is_selected
    FROM k05g)
)"""

K06 = """k06r AS (
  SELECT * FROM (SELECT kommune_key, area, row_number() OVER (PARTITION BY kommune_key ORDER BY area DESC) AS rn FROM p)
  WHERE rn <= 10
),
k06 AS (
  SELECT t.kommune_key,
    ROUND(t.top5, 1) AS top5_area,
    COALESCE(ROUND(""" + pct("t.top5", "m.total_bruksareal") + """, 2), 0.0) AS top5_share_percent,
    ROUND(t.top10, 1) AS top10_area,
    COALESCE(ROUND(""" + pct("t.top10", "m.total_bruksareal") + """, 2), 0.0) AS top10_share_percent
  FROM (SELECT kommune_key, SUM(CASE WHEN rn <= 5 THEN area ELSE 0.0 END) AS top5, SUM(area) AS top10
        FROM k06r GROUP BY 1) t JOIN m USING (kommune_key)
)"""

K07 = """k07 AS (
  SELECT r.kommune_key, rank, kommune, address_label, occupancy_category, bygningsstatus, tek_standard, r.total_bruksareal,
    """ + pct("r.total_bruksareal", "m.total_bruksareal") + """ AS area_share_percent
  FROM (
    SELECT kommune_key, kommune, address_label, forenklet_bygningskategori AS occupancy_category,
      COALESCE(bygningsstatus, 'MISSING') AS bygningsstatus, COALESCE(tek_standard, 'MISSING') AS tek_standard,
      area AS total_bruksareal, """ + rank("area DESC, address_label, id") + """ AS rank
    FROM p
  ) r JOIN m USING (kommune_key) WHERE rank <= 10
)"""

K09 = OCC + """,
k09 AS (
  SELECT * FROM (
    SELECT kommune_key, """ + rank("total_bruksareal DESC, occupancy_category") + """ AS rank,
      occupancy_category, building_count, total_bruksareal,
      """ + pct("building_count", "SUM(building_count) OVER (PARTITION BY kommune_key)") + """ AS count_share_percent,
      """ + pct("total_bruksareal", "SUM(total_bruksareal) OVER (PARTITION BY kommune_key)") + """ AS area_share_percent
    FROM occ) WHERE rank <= 30
)"""

K11 = """k11 AS (
  SELECT * FROM (
    SELECT *, """ + rank("building_count DESC, total_bruksareal DESC, rank") + """ AS count_rank FROM k09
  ) WHERE count_rank <= 10
)"""


def _dist(name: str, expr: str) -> str:
    return f"""{name}g AS (
  SELECT kommune_key, {expr} AS val, COUNT(*) AS property_count, SUM(area) AS total_bruksareal FROM p GROUP BY 1, 2
),
{name} AS (
  SELECT * FROM (
    SELECT kommune_key, {rank("total_bruksareal DESC, val")} AS rank, val,
      property_count, total_bruksareal,
      {pct("property_count", "SUM(property_count) OVER (PARTITION BY kommune_key)")} AS property_share_percent,
      {pct("total_bruksareal", "SUM(total_bruksareal) OVER (PARTITION BY kommune_key)")} AS area_share_percent
    FROM {name}g)
)"""


K12 = _dist("k12", "COALESCE(tek_standard, 'MISSING')")
K14 = _dist("k14", "COALESCE(bygningsstatus, 'MISSING')")

AGE_BAND = """CASE WHEN tek_standard IN ('TEK17', 'TEK10') THEN '2010+'
       WHEN tek_standard IN ('TEK07', 'TEK97') THEN '1997-2009'
       WHEN tek_standard LIKE 'BF%' THEN 'Pre-1997' ELSE 'Unknown' END"""

K13 = """k13g AS (
  SELECT kommune_key, """ + AGE_BAND + """ AS age_band, COUNT(*) AS property_count, SUM(area) AS total_bruksareal
  FROM p GROUP BY 1, 2
),
k13 AS (
  SELECT kommune_key,
    CAST(CASE age_band WHEN 'Pre-1997' THEN 1 WHEN '1997-2009' THEN 2 WHEN '2010+' THEN 3 ELSE 4 END AS INTEGER) AS band_order,
    age_band, property_count, total_bruksareal,
    """ + pct("total_bruksareal", "SUM(total_bruksareal) OVER (PARTITION BY kommune_key)") + """ AS area_share_percent
  FROM k13g
)"""

K15 = """k15 AS (
  SELECT kommune_key, bygningsstatus, """ + rank("bygningsstatus") + """ AS rank FROM (
    SELECT DISTINCT kommune_key, regexp_replace(val, '^\\s+|\\s+$', '', 'g') AS bygningsstatus FROM k14
    WHERE lower(val) LIKE '%riving%' OR lower(val) LIKE '%brenning%' OR lower(val) LIKE '%kondemn%' OR lower(val) LIKE '%ikke godkjent%'
  )
)"""

DETAIL = """kommune_key, kommune, address_label, forenklet_bygningskategori AS occupancy_category,
      bygningsstatus, tek_standard, area AS total_bruksareal"""

K16 = """k16 AS (
  SELECT * FROM (SELECT """ + DETAIL + """, """ + rank("area DESC, address_label, id") + """ AS rank
    FROM p WHERE """ + PROBLEM + """) WHERE rank <= 50
)"""

K17 = """k17 AS (
  SELECT * FROM (SELECT """ + DETAIL + """, """ + rank("area DESC, forenklet_bygningskategori NULLS LAST, address_label, id") + """ AS rank
    FROM p) WHERE rank <= 20
)"""

K19 = """k19 AS (
  SELECT * FROM (
    SELECT kommune_key, kommune, address_label, forenklet_bygningskategori AS occupancy_category, area AS total_bruksareal,
      COALESCE(har_sefrakminne, 0) AS har_sefrakminne, COALESCE(har_kulturminne, 0) AS har_kulturminne,
      COALESCE(skjermingsverdig, 0) AS skjermingsverdig, """ + rank("area DESC, address_label, id") + """ AS rank
    FROM p WHERE """ + HERITAGE + """) WHERE rank <= 50
)"""

K21 = """k21 AS (
  SELECT * FROM (
    SELECT kommune_key, kommune, address_label, forenklet_bygningskategori AS occupancy_category,
      COALESCE(antall_underenheter, 0) AS antall_underenheter, area AS total_bruksareal,
      COALESCE(antall_eiere, 0) AS antall_eiere, COALESCE(underenheter, '') AS underenheter,
      """ + rank("COALESCE(antall_underenheter, 0) DESC, area DESC, address_label, id") + """ AS rank
    FROM p WHERE COALESCE(antall_underenheter, 0) > 0) WHERE rank <= 20
)"""

_den = "GREATEST(total_properties, 1)"
K22 = """k22 AS (
""" + "\n  UNION ALL\n".join(
    f"  SELECT kommune_key, CAST({i} AS INTEGER) AS field_order, '{f}' AS field, '{label}' AS label, {f} AS present_count,"
    f" {_den} - {f} AS missing_count, ROUND(100.0 * CAST({f} AS DOUBLE) / {_den}, 2) AS completeness_percent FROM m"
    for i, (f, label) in enumerate(QUALITY_FIELDS, start=1)
) + "\n)"

K23 = """k23 AS (
  SELECT kommune_key, ROUND((""" + " + ".join(
    f"ROUND(100.0 * CAST({f} AS DOUBLE) / {_den}, 2)" for f, _ in QUALITY_FIELDS[:SCORE_FIELDS]
) + f") / {float(SCORE_FIELDS)}, 2) AS score_percent, total_properties FROM m\n)"

K20 = """k20 AS (
  SELECT kommune_key, total_properties, with_tenants_count,
    ROUND(100.0 * CAST(with_tenants_count AS DOUBLE) / """ + _den + """, 2) AS with_tenants_share_percent,
    ROUND(with_tenants_area, 1) AS with_tenants_area, max_underenheter, multi_owner_count
  FROM m
)"""

K18 = """k18 AS (
  SELECT kommune_key, sefrak_count, kulturminne_count, skjermingsverdig_count,
    LEAST(any_flag_total, CAST(50 AS BIGINT)) AS any_flag_count, any_flag_total FROM m
)"""


def _count(cte: str, name: str) -> str:
    return f"(SELECT kommune_key, COUNT(*) AS {name} FROM {cte} GROUP BY 1)"


SQL = {
    "k01_occupancy_distribution": q(K01, select="SELECT * FROM k01"),
    "k02_largest_occupancy": q(OCC, K02, select="SELECT * FROM k02"),
    "k03_portfolio_totals": q(select="SELECT COUNT(*) AS total_properties, ROUND(COALESCE(SUM(area), 0.0), 1) AS total_bruksareal FROM p"),
    "k04_selected_totals": q(K04, select="SELECT * FROM k04"),
    "k05_by_kommune": q(K05, select="SELECT * FROM k05"),
    "k06_concentration": q(METRICS, K06, select="SELECT * FROM k06"),
    "k07_top_properties": q(METRICS, K07, select="SELECT * FROM k07"),
    "k08_exposure_dashboard": q(
        K04, K05, K06, K07,
        select="""SELECT k04.*, top5_area, top5_share_percent, top10_area, top10_share_percent,
  CAST(COALESCE(b.n, 0) AS INTEGER) AS n_by_kommune, CAST(COALESCE(t.n, 0) AS INTEGER) AS n_top_properties, t.largest AS largest_property_address, b.labels AS labels
FROM k04 LEFT JOIN k06 USING (kommune_key)
LEFT JOIN (SELECT kommune_key, COUNT(*) AS n, string_agg(kommune, '|' ORDER BY rank) AS labels FROM k05 GROUP BY 1) b USING (kommune_key)
LEFT JOIN (SELECT kommune_key, COUNT(*) AS n, max(CASE WHEN rank = 1 THEN address_label END) AS largest FROM k07 GROUP BY 1) t USING (kommune_key)""",
    ),
    "k09_occupancy_mix": q(K09, select="SELECT * FROM k09"),
    "k10_top_by_area": q(K09, select="SELECT * FROM k09 WHERE rank <= 10"),
    "k11_top_by_count": q(K09, K11, select="SELECT * FROM k11"),
    "k12_tek_distribution": q(K12, select="SELECT kommune_key, rank, val AS tek_standard, property_count, total_bruksareal, property_share_percent, area_share_percent FROM k12"),
    "k13_age_bands": q(K13, select="SELECT * FROM k13"),
    "k14_status_distribution": q(K14, select="SELECT kommune_key, rank, val AS bygningsstatus, property_count, total_bruksareal, property_share_percent, area_share_percent FROM k14"),
    "k15_problem_statuses": q(K14, K15, select="SELECT * FROM k15"),
    "k16_problem_properties": q(K16, select="SELECT * FROM k16"),
    "k17_large_risks": q(K17, select="SELECT * FROM k17"),
    "k18_heritage_summary": q(METRICS, K18, select="SELECT * FROM k18"),
    "k19_heritage_rows": q(K19, select="SELECT * FROM k19"),
    "k20_tenant_summary": q(METRICS, K20, select="SELECT * FROM k20"),
    "k21_tenant_top": q(K21, select="SELECT * FROM k21"),
    "k22_quality_fields": q(METRICS, K22, select="SELECT * FROM k22"),
    "k23_quality_score": q(METRICS, K23, select="SELECT * FROM k23"),
    "k24_quality_gaps": q(METRICS, K22, select=f"SELECT * FROM k22 WHERE completeness_percent < {QUALITY_GAP_BELOW}"),
    "k25_lists": q(
        METRICS, K09, K12, K14, K16, K17, K19, K21, K22,
        select="\nUNION ALL\n".join(
            f"SELECT kommune_key, '{name}' AS list, CAST({rank} AS BIGINT) AS rank, concat_ws('|', {fields}) AS content FROM {cte}"
            for name, cte, rank, fields in (
                ("problematic_properties", "k16", "rank", "kommune, address_label, occupancy_category, bygningsstatus, tek_standard, CAST(total_bruksareal AS BIGINT)"),
                ("large_risk_schedule", "k17", "rank", "kommune, address_label, occupancy_category, bygningsstatus, tek_standard, CAST(total_bruksareal AS BIGINT)"),
                ("heritage_rows", "k19", "rank", "kommune, address_label, occupancy_category, CAST(total_bruksareal AS BIGINT), har_sefrakminne, har_kulturminne, skjermingsverdig"),
                ("tenant_top_rows", "k21", "rank", "kommune, address_label, occupancy_category, antall_underenheter, CAST(total_bruksareal AS BIGINT), antall_eiere, underenheter"),
                ("quality_fields", "k22", "field_order", "field, label, present_count, missing_count"),
                ("quality_gaps", f"k22 WHERE completeness_percent < {QUALITY_GAP_BELOW}", "field_order", "field, label"),
                ("top_categories_by_area", "k09 WHERE rank <= 10", "rank", "occupancy_category, building_count, CAST(total_bruksareal AS BIGINT)"),
                ("by_category", "k09", "rank", "occupancy_category, building_count, CAST(total_bruksareal AS BIGINT)"),
                ("status_distribution", "k14", "rank", "val, property_count, CAST(total_bruksareal AS BIGINT)"),
                ("tek_distribution", "k12", "rank", "val, property_count, CAST(total_bruksareal AS BIGINT)"),
            )
        ),
    ),
    "k27_cumulative_share": q(
        METRICS, K07,
        select="""SELECT kommune_key, rank, address_label, total_bruksareal,
  LEAST(ROUND(SUM(COALESCE(area_share_percent, 0.0)) OVER (PARTITION BY kommune_key ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2), 100.0)
    AS cumulative_share_percent FROM k07""",
    ),
    "k28_portfolio_summary": q(select="SELECT kommune, SUM(area) AS total_bruksareal FROM p GROUP BY 1"),
    "k26_insights_package": q(
        K01, K02,
        select="""SELECT d.kommune_key, d.rank, d.occupancy_category, d.building_count, d.total_bruksareal,
  CASE WHEN SUM(d.total_bruksareal) OVER (PARTITION BY d.kommune_key) <= 0 THEN 0.0
       ELSE ROUND(100.0 * d.total_bruksareal / SUM(d.total_bruksareal) OVER (PARTITION BY d.kommune_key), 2) END AS share_percent,
  k02.occupancy_category AS largest_category, k02.total_bruksareal AS largest_bruksareal, k02.building_count AS largest_building_count
FROM k01 d LEFT JOIN k02 USING (kommune_key)""",
    ),
}

SQL["k25_underwriting_package"] = q(
    K04, K05, K06, K07, K09, K11, K12, K13, K14, K15, K16, K17, K18, K19, K20, K21, K22, K23,
    select="""SELECT k04.kommune_key, selected_properties, selected_bruksareal, property_share_percent, area_share_percent,
  portfolio_total_properties, portfolio_total_bruksareal, top5_area, top5_share_percent, top10_area, top10_share_percent,
  sefrak_count, kulturminne_count, skjermingsverdig_count, any_flag_count,
  with_tenants_count, with_tenants_share_percent, with_tenants_area, max_underenheter, multi_owner_count,
  score_percent,
  (SELECT COUNT(*) FROM k22 WHERE k22.kommune_key = k04.kommune_key AND completeness_percent < """ + str(QUALITY_GAP_BELOW) + """)::INTEGER AS quality_gap_count,
""" + ",\n".join(
        f"  COALESCE((SELECT COUNT(*) FROM {cte} x WHERE x.kommune_key = k04.kommune_key), 0)::INTEGER AS n_{name}"
        for cte, name in [
            ("k05", "by_kommune"),
            ("k07", "top_properties_by_area"),
            ("k09", "by_category"),
            ("k11", "top_categories_by_count"),
            ("k12", "tek_distribution"),
            ("k13", "age_band_distribution"),
            ("k14", "status_distribution"),
            ("k15", "problematic_statuses"),
            ("k16", "problematic_properties"),
            ("k17", "large_risk_schedule"),
            ("k19", "heritage_rows"),
            ("k21", "tenant_top_rows"),
        ]
    ) + """,
  (SELECT address_label FROM k07 x WHERE x.kommune_key = k04.kommune_key AND rank = 1) AS largest_property_address,
  (SELECT occupancy_category FROM k09 x WHERE x.kommune_key = k04.kommune_key AND rank = 1) AS largest_category,
  (SELECT occupancy_category FROM k11 x WHERE x.kommune_key = k04.kommune_key AND count_rank = 1) AS most_common_category,
  (SELECT address_label FROM k17 x WHERE x.kommune_key = k04.kommune_key AND rank = 1) AS largest_risk_address
FROM k04 LEFT JOIN k06 USING (kommune_key) LEFT JOIN k18 USING (kommune_key) LEFT JOIN k20 USING (kommune_key)
LEFT JOIN k23 USING (kommune_key)""",
)
