"""Registration of queries together with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placemetrics.queries import tables as t

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, build: Callable[[SparkSession, str], DataFrame],
             sql: str | None = None, needs: Sequence[str] = ()) -> None:
    if name in QUERIES:
        raise ValueError(f"query {name} is already registered")
    QUERIES[name] = build
    if sql is not None:
        SQL[name] = with_tables(sql, needs)


def rounded(df: DataFrame, *columns: str, digits: int = 9) -> DataFrame:
    """Round columns whose last digits depend on the order of additions."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


def with_tables(sql: str, needs: Sequence[str]) -> str:
    wanted: list[str] = []

    def visit(name: str) -> None:
        for dependency in TABLES[name][0]:
            visit(dependency)
        if name not in wanted:
            wanted.append(name)

    for name in needs:
        visit(name)
    if not wanted:
        return sql
    return "WITH " + ",\n".join(f"{n} AS ({TABLES[n][1]})" for n in wanted) + "\n" + sql


def quoted(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def literal_rows(table: dict, columns: str) -> str:
    def row(key, value):
        values = value if isinstance(value, tuple) else (value,)
        return "(" + ", ".join(str(v) if isinstance(v, (int, float)) else quoted(v)
                               for v in (key, *values)) + ")"
    return f"SELECT * FROM (VALUES {', '.join(row(k, v) for k, v in table.items())}) v({columns})"


def title_sql(text: str) -> str:
    """Title case in DuckDB: token list, neighbours by position."""
    from placemetrics.functions.text import SMALL_WORDS, UNTOUCHED_WORDS
    small = ", ".join(quoted(w) for w in SMALL_WORDS)
    kept = ", ".join(quoted(w) for w in UNTOUCHED_WORDS)
    tokens = f"regexp_extract_all({text}, '[ \\-/\"()\n\t]|[^ \\-/\"()\n\t]+')"
    return f"""(CASE WHEN {text} IS NOT NULL THEN array_to_string(list_transform({tokens}, lambda w, i: CASE
      WHEN lower(w) IN ({small}) AND i > 1
           AND NOT (coalesce({tokens}[i - 1] = ' ' AND i > 2
                    AND regexp_matches({tokens}[greatest(i - 2, 1)], '[-:]$'), false)
                    OR coalesce({tokens}[i - 1] = '"', false)) THEN lower(w)
      WHEN regexp_matches(w, '^[A-Za-z].*[A-Z]') OR length(w) = 1 OR w IN ({kept})
           OR regexp_matches(w, '^''.*''$') THEN w
      WHEN regexp_matches(w, '^[a-z]') THEN upper(w[1]) || w[2:] ELSE w END), '') END)"""


def _list_sql(name: str) -> str:
    items = ", ".join(f"CASE WHEN {cond} THEN {quoted(label)} END"
                      for label, cond in t.OPTIONS[name].items())
    packed = f"list_filter([{items}], lambda x: x IS NOT NULL)"
    return f"CASE WHEN len({packed}) > 0 THEN {packed} END AS {name}"


_ANSWERS = ",\n".join(f"{sql} AS {name}" for name, sql in t.ANSWERS.items())
_LISTS = ",\n".join(_list_sql(name) for name in t.OPTIONS)

_ROLE_ROWS = {(k, r): None for k, v in t.ROLES.items() for r in (*v, "all developers")}

MEDIAN = "round(median({}), 6)"

# Name -> (tables it needs, SQL).  The first ones restate the derived tables, the
# later ones results that several queries share.
TABLES: dict[str, tuple[Sequence[str], str]] = {
    "a": ((), f"""SELECT {_ANSWERS}, {_LISTS}
        FROM orders JOIN customer ON o_custkey = c_custkey
        JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""),
    "e": (("a",), """SELECT *,
        CASE WHEN pro_experience = 'less than a year' THEN 0
             ELSE TRY_CAST(nullif(regexp_extract(pro_experience, '^[0-9]+'), '') AS DOUBLE)
             END AS low_year,
        CASE WHEN pro_experience = 'less than a year' THEN 1
             WHEN pro_experience = '20 or more years' THEN 20
             ELSE TRY_CAST(trim(nullif(regexp_extract(pro_experience, ' [0-9]+'), '')) AS DOUBLE)
             END AS high_year FROM a"""),
    "r": (("e",), """SELECT *, (low_year + high_year) / 2 AS mid_year,
        CASE WHEN low_year >= 0 AND low_year < 5 THEN 'Under 5'
             WHEN low_year >= 5 AND low_year < 10 THEN '5 to 10'
             WHEN low_year >= 10 AND low_year < 15 THEN '10 to 15'
             WHEN low_year >= 15 AND low_year < 20 THEN '15 to 20'
             WHEN low_year >= 20 AND low_year < 25 THEN 'Over 20' END AS bin,
        coalesce(low_year >= 15 AND low_year < 25, false) AS above_15,
        CASE WHEN country IS NULL THEN NULL WHEN country = 'canada' THEN 'Canada'
             WHEN country = 'united states' THEN 'US' WHEN is_eu THEN 'EU' ELSE 'ROW' END AS region,
        CASE WHEN country IS NULL THEN NULL WHEN country = 'canada' THEN 'Canada'
             ELSE 'ROW' END AS carow,
        salary_usd * 1.32 AS salary_cad,
        salary_usd * local_currency_per_usd AS salary_local,
        CASE WHEN country_currency_code = local_currency_code
             THEN salary_usd * local_currency_per_usd
                  / nullif(local_currency_per_intl_dollar, 0) END AS salary_intl
        FROM e"""),
    "home": (("r",), """SELECT * FROM r
        WHERE year = 2017 AND country = 'canada' AND pro_status = 'pro dev'"""),
    "devs": (("r",), "SELECT * FROM r WHERE year = 2017 AND pro_status = 'pro dev'"),
    "pop": ((), """SELECT CASE lower(n_name) WHEN 'nation_24' THEN 'united states'
        WHEN 'nation_1' THEN 'canada' ELSE lower(n_name) END AS country,
        count(*) AS population_2016 FROM customer JOIN nation ON c_nationkey = n_nationkey
        GROUP BY 1"""),
    "cy": (("r", "pop"), """SELECT s.*, population_2016,
        respondents / population_2016 AS respondents_per_capita
        FROM (SELECT year, country, region, carow AS region_carow_label,
              count(*) AS respondents,
              count(*) / sum(count(*)) OVER (PARTITION BY year) AS respondents_share
              FROM r WHERE country IS NOT NULL GROUP BY 1, 2, 3, 4) s
        LEFT JOIN pop USING (country)"""),
    "ry": (("r",), """SELECT year, region, count(*) AS respondents,
        count(*) / sum(count(*)) OVER (PARTITION BY year) AS respondents_share
        FROM r WHERE country IS NOT NULL GROUP BY 1, 2"""),
    "pd": (("r",), f"""SELECT *,
        median_salary_cad_females / median_salary_cad_males - 1 AS salary_pc_diff_females_males
        FROM (SELECT year, country, region, carow AS region_carow_label,
        count(*) AS respondents,
        CAST(sum(CAST(salary_cad AS DECIMAL(28,8))) AS DOUBLE) / nullif(count(salary_cad), 0)
            AS mean_salary_cad,
        CAST(sum(CAST(salary_usd AS DECIMAL(28,8))) AS DOUBLE) / nullif(count(salary_usd), 0)
            AS mean_salary_usd,
        count(salary_cad) AS n_salary_responses,
        count(salary_intl) AS n_salary_intl_dollar_responses,
        round(avg(mid_year), 9) AS mean_pro_experience_years,
        CAST(count(*) FILTER (above_15) AS DOUBLE) / nullif(count(bin), 0)
            AS respondents_share_pro_experience_bin_above_15,
        count(salary_cad) FILTER (gender = 'male') AS n_salary_responses_males,
        count(salary_cad) FILTER (gender = 'female') AS n_salary_responses_females,
        median(salary_cad) AS median_salary_cad, median(salary_usd) AS median_salary_usd,
        median(salary_intl) AS median_salary_intl_dollar,
        median(mid_year) AS median_pro_experience_years,
        median(salary_cad) FILTER (gender = 'male') AS median_salary_cad_males,
        median(salary_cad) FILTER (gender = 'female') AS median_salary_cad_females,
        count(*) / sum(count(*)) OVER (PARTITION BY year) AS respondents_share
        FROM r WHERE country IS NOT NULL AND pro_status = 'pro dev' GROUP BY 1, 2, 3, 4)"""),
    # traffic
    "role_rows": ((), "SELECT * FROM (VALUES " + ", ".join(
        f"({quoted(k)}, {quoted(r)})" for k, r in _ROLE_ROWS) + ") v(p_type, dev_role)"),
    "tv": (("role_rows",), """SELECT dev_role, s_nationkey, CAST(sum(n) AS BIGINT) AS visitors
        FROM (SELECT p_type, s_nationkey, count(*) AS n FROM lineitem
              JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey
              GROUP BY ALL) JOIN role_rows USING (p_type) GROUP BY ALL"""),
    "place": ((), "SELECT * FROM (VALUES " + ", ".join(
        f"({i}, {quoted(p)}, {quoted(t.CONSOLIDATED_PROVINCES.get(p))}, "
        f"{quoted(t.CONSOLIDATED_CITIES.get(p))}, {quoted(t.STATISTICAL_CITIES.get(p))})"
        for i, p in enumerate([*t.PROVINCES, *t.CITIES]))
        + ") v(nationkey, place, province, city, stat_name)"),
    "nat": (("tv",), "SELECT dev_role, CAST(sum(visitors) AS BIGINT) AS national FROM tv GROUP BY 1"),
    "lab": ((), literal_rows(t.ROLE_LABELS, "dev_role, dev_role_label")),
    "prov_emp": (("place",), """SELECT place, avg(n) * 100 AS employees FROM (
        SELECT place, c_mktsegment, CAST(count(*) AS DOUBLE) AS n FROM customer
        JOIN place ON c_nationkey = nationkey WHERE province IS NOT NULL GROUP BY ALL)
        GROUP BY 1"""),
    "prov": (("tv", "place", "prov_emp"), """SELECT *,
        visitors / sum(visitors) OVER () AS visitors_share,
        employees / sum(employees) OVER () AS employees_share
        FROM (SELECT province AS province_consolidated, CAST(sum(visitors) AS BIGINT) AS visitors,
              CASE WHEN count(employees) = count(*) THEN sum(employees) END AS employees
              FROM tv JOIN place ON s_nationkey = nationkey LEFT JOIN prov_emp USING (place)
              WHERE province IS NOT NULL AND dev_role = 'all developers' GROUP BY 1)"""),
    "city_names": ((), literal_rows(t.STATISTICAL_NAMES, "stat_name, city_consolidated")),
    "stat": (("place",), """SELECT stat_name, CAST(count(*) FILTER (c_acctbal > 2000) AS DOUBLE) * 1000
        AS employees, CAST(count(*) AS DOUBLE) AS population FROM customer
        JOIN place ON c_nationkey = nationkey
        WHERE stat_name IS NOT NULL AND NOT regexp_matches(stat_name, '(?i)(ontario|quebec) part')
        GROUP BY 1"""),
    "cities": (("tv", "place", "prov", "nat", "stat", "city_names"), """
        SELECT *, visitors_share_scaled / employees_share AS visitor_employee_ratio FROM (
        SELECT city_consolidated, visitors, visitors * scale AS visitors_scaled,
        visitors * scale / national AS visitors_share_scaled, employees, population,
        employees / (SELECT CAST(count(*) FILTER (c_acctbal > 2000) AS DOUBLE) * 1000 FROM customer)
            AS employees_share
        FROM (SELECT city AS city_consolidated, CAST(sum(visitors) AS BIGINT) AS visitors FROM tv
              JOIN place ON s_nationkey = nationkey
              WHERE city IS NOT NULL AND dev_role = 'all developers' GROUP BY 1)
        JOIN (SELECT city_consolidated, sum(employees) AS employees, sum(population) AS population
              FROM stat JOIN city_names USING (stat_name) GROUP BY 1) USING (city_consolidated)
        CROSS JOIN (SELECT national, CAST(national AS DOUBLE)
                    / (SELECT sum(visitors) FROM prov) AS scale FROM nat
                    WHERE dev_role = 'all developers'))"""),
    "lq": (("tv", "place", "nat", "lab", "cities"), """SELECT *,
        visitors_share / national_share AS location_quotient FROM (
        SELECT c.dev_role, c.city_consolidated, c.visitors, t.visitors AS total,
        n.national / (SELECT national FROM nat WHERE dev_role = 'all developers') AS national_share,
        c.visitors / t.visitors AS visitors_share, dev_role_label
        FROM (SELECT dev_role, city AS city_consolidated, CAST(sum(visitors) AS BIGINT) AS visitors
              FROM tv JOIN place ON s_nationkey = nationkey
              WHERE city IS NOT NULL AND dev_role <> 'qa engineers' GROUP BY 1, 2) c
        JOIN cities t USING (city_consolidated) JOIN nat n ON n.dev_role = c.dev_role
        LEFT JOIN lab ON lab.dev_role = c.dev_role)"""),
    "ilq": (("tv",), """SELECT *, visitors_share_city / visitors_share_country AS location_quotient
        FROM (SELECT dev_role, lower(n_name) AS city, lower(r_name) AS country,
        visitors AS visitors_city, visitors / max(visitors) FILTER (dev_role = 'all developers')
            OVER (PARTITION BY n_name) AS visitors_share_city,
        CAST(sum(visitors) OVER (PARTITION BY dev_role, r_name) AS BIGINT) AS visitors_country,
        (sum(visitors) OVER (PARTITION BY dev_role, r_name))
          / sum(visitors) FILTER (dev_role = 'all developers') OVER (PARTITION BY r_name)
            AS visitors_share_country
        FROM tv JOIN nation ON s_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey)"""),
    "parent": ((), """SELECT * FROM (VALUES ('all developers', '-', '-'),
        ('mobile developers', 'All Developers', 'All Developers'),
        ('web developers', 'All Developers', 'All Developers'),
        ('other kinds of developers', 'All Developers', 'All Developers'),
        ('android developers', 'Mobile Developers', 'Mobile Developers'),
        ('ios developers', 'Mobile Developers', 'Mobile Developers'),
        ('back-end web', 'Web Developers', 'Other Kinds of Developers'),
        ('front-end web', 'Web Developers', 'Other Kinds of Developers'),
        ('desktop developers', 'Other Kinds of Developers', 'Other Kinds of Developers'),
        ('qa engineers', 'Other Kinds of Developers', 'Other Kinds of Developers'))
        v(dev_role, parent, published_parent)"""),
    "plq": (("tv", "place", "nat", "lab", "parent"), """SELECT place AS province,
        CASE dev_role WHEN 'all developers' THEN 'All Developers'
             WHEN 'other kinds of developers' THEN 'Other Kinds of Developers'
             WHEN 'web developers' THEN 'Web Developers (Front-End, Back-End, or Full-Stack)'
             WHEN 'mobile developers' THEN 'Mobile Developers'
             ELSE dev_role_label || 's' END AS dev_role,
        parent, published_parent, visitors,
        visitors / total AS province_visitors_share,
        (visitors / total) / (national / (SELECT national FROM nat
            WHERE dev_role = 'all developers')) AS location_quotient
        FROM (SELECT dev_role, place, visitors, max(visitors) FILTER (dev_role = 'all developers')
              OVER (PARTITION BY place) AS total
              FROM tv JOIN place ON s_nationkey = nationkey WHERE province IS NOT NULL)
        JOIN nat USING (dev_role) LEFT JOIN lab USING (dev_role) JOIN parent USING (dev_role)
        WHERE dev_role <> 'qa engineers'"""),
    "exp": (("lq", "ilq", "lab", "parent"), """SELECT city, region,
        CASE dev_role WHEN 'all developers' THEN 'All Developers'
             WHEN 'other kinds of developers' THEN 'Other Kinds of Developers'
             WHEN 'web developers' THEN 'Web Developers (Front-End, Back-End, or Full-Stack)'
             WHEN 'mobile developers' THEN 'Mobile Developers'
             ELSE dev_role_label || 's' END AS dev_role,
        parent AS dev_role_parent_group, visitors, city_visitors_share, location_quotient
        FROM (SELECT city_consolidated AS city, 'canada' AS region, dev_role, dev_role_label,
              visitors, visitors_share AS city_visitors_share, location_quotient FROM lq
              UNION ALL
              SELECT city, 'international', dev_role, dev_role_label, visitors_city,
              visitors_share_city, location_quotient FROM ilq LEFT JOIN lab USING (dev_role))
        JOIN parent USING (dev_role)"""),
    "cyr": ((), """SELECT s_suppkey, CASE WHEN s_suppkey = 3 THEN 'toronto' ELSE lower(s_name) END AS city,
        CASE WHEN s_suppkey = 3 OR n_regionkey = 1 THEN 'canada' ELSE lower(n_name) END AS country
        FROM supplier JOIN nation ON s_nationkey = n_nationkey
        WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem)"""),
    "cty": (("cyr",), """SELECT city, country, CAST(y + 16 AS INTEGER) AS year, count(l_suppkey) AS visitors
        FROM cyr CROSS JOIN (SELECT DISTINCT year(l_shipdate) AS y FROM lineitem)
        LEFT JOIN lineitem ON l_suppkey = s_suppkey AND year(l_shipdate) = y
        GROUP BY s_suppkey, city, country, y"""),
    # languages
    "lang": ((), literal_rows(t.LANGUAGE_LABELS, "language, language_label")),
    "lr": (("devs", "lang"), """SELECT language, carow AS region_carow_label, respondents,
        language_label, total_respondents, respondents / total_respondents AS respondents_share
        FROM (SELECT language, carow, count(*) AS respondents FROM (
                SELECT unnest(languages) AS language, carow FROM devs WHERE carow IS NOT NULL)
              GROUP BY 1, 2)
        JOIN (SELECT carow, count(*) AS total_respondents FROM devs
              WHERE carow IS NOT NULL AND languages IS NOT NULL GROUP BY 1) USING (carow)
        LEFT JOIN lang USING (language)"""),
    "ly": (("r", "lang"), """SELECT *,
        respondents_share / first_value(respondents_share) OVER w * 100 AS respondents_share_ind,
        respondents_share / lag(respondents_share) OVER w - 1 AS respondents_share_pc_growth_yoy
        FROM (SELECT language, year, respondents, total_respondents,
              respondents / total_respondents AS respondents_share, language_label
              FROM (SELECT language, year, count(*) AS respondents FROM (
                      SELECT unnest(languages) AS language, year FROM r WHERE country = 'canada')
                    GROUP BY 1, 2)
              JOIN (SELECT year, count(*) AS total_respondents FROM r
                    WHERE country = 'canada' AND languages IS NOT NULL GROUP BY 1) USING (year)
              LEFT JOIN lang USING (language))
        WINDOW w AS (PARTITION BY language ORDER BY year)"""),
    "la": (("ly",), """SELECT language, language_label,
        round(avg(respondents_share), 9) AS avg_respondents_share, count(*) AS survey_years
        FROM ly GROUP BY 1, 2"""),
    "lw": (("la",), """SELECT * FROM la WHERE survey_years = (SELECT max(survey_years) FROM la)
        AND avg_respondents_share >= 0.1"""),
    "nl": (("home",), """SELECT respondent_id, len(languages) AS n_languages FROM home
        WHERE languages IS NOT NULL"""),
    # workplaces
    "ctl": ((), literal_rows(t.COMPANY_TYPE_LABELS, "company_type, company_type_label")),
    "ct": (("devs", "ctl"), """SELECT region_carow_label, company_type, respondents,
        n_salary_responses, median_salary_cad, respondents_share,
        CASE WHEN company_type LIKE '%non-profit%'
             THEN 'Non-profit/non-governmental organization' || chr(10)
                  || 'or private school/university'
             WHEN company_type LIKE '%government agency%'
             THEN 'Government agency' || chr(10) || 'or public school/university'
             WHEN company_type LIKE '%proprietorship%'
             THEN 'Sole proprietorship or partnership,' || chr(10) || 'not in startup mode'
             WHEN company_type LIKE '%privately-held%'
             THEN 'Privately-held limited company,' || chr(10) || 'not in startup mode'
             ELSE company_type_label END AS company_type_label
        FROM (SELECT carow AS region_carow_label,
              CASE company_type WHEN 'something else: ' THEN 'other' ELSE company_type END
                AS company_type, count(*) AS respondents,
              count(salary_cad) AS n_salary_responses,
              round(median(salary_cad), 6) AS median_salary_cad,
              count(*) / sum(count(*)) OVER (PARTITION BY carow) AS respondents_share
              FROM devs WHERE carow IS NOT NULL AND company_type <> 'i don''t know'
              GROUP BY 1, 2) LEFT JOIN ctl USING (company_type)"""),
    "cs": (("devs",), """SELECT region, company_size,
        count(*) AS respondents,
        count(*) / sum(count(*)) OVER (PARTITION BY region) AS respondents_share,
        CASE company_size WHEN 'fewer than 10' THEN 1 WHEN '10 to 19' THEN 2
             WHEN '20 to 99' THEN 3 WHEN '100 to 499' THEN 4 WHEN '500 to 999' THEN 5
             WHEN '1,000 to 4,999' THEN 6 WHEN '5,000 to 9,999' THEN 7
             WHEN '10,000 or more' THEN 8 END AS size_ord
        FROM devs WHERE region IS NOT NULL
        AND company_size NOT IN ('i don''t know', 'i prefer not to answer') GROUP BY 1, 2"""),
    "ind": (("devs",), f"""SELECT *,
        CASE WHEN regexp_matches(industry_original, 'advertising')
             THEN 'Media, Advertising,' || chr(10) || 'Publishing, or Entertainment'
             WHEN regexp_matches(industry_original, 'finance')
             THEN 'Finance, Banking,' || chr(10) || 'or Insurance'
             WHEN regexp_matches(industry_original, 'military')
             THEN 'Government' || chr(10) || '(Including Military)'
             WHEN regexp_matches(industry_original, 'other') THEN 'Other'
             ELSE {title_sql("industry_original")} END AS industry_original_label
        FROM (SELECT carow AS region_carow_label, industry_original, count(*) AS respondents,
              count(salary_cad) AS n_salary_responses,
              round(median(salary_cad), 6) AS median_salary_cad,
              count(*) / sum(count(*)) OVER (PARTITION BY carow) AS respondents_share
              FROM devs WHERE carow IS NOT NULL AND industry_original IS NOT NULL GROUP BY 1, 2)"""),
    "iw": (("ind",), """SELECT industry_original_label,
        max(respondents_share) FILTER (region_carow_label = 'Canada') AS respondents_share_ca,
        max(respondents_share) FILTER (region_carow_label = 'ROW') AS respondents_share_row,
        max(respondents) FILTER (region_carow_label = 'Canada') AS respondents_ca,
        max(respondents) FILTER (region_carow_label = 'ROW') AS respondents_row,
        max(median_salary_cad) FILTER (region_carow_label = 'Canada') AS median_salary_cad_ca,
        max(median_salary_cad) FILTER (region_carow_label = 'ROW') AS median_salary_cad_row
        FROM ind GROUP BY 1"""),
    "iy": (("r",), """SELECT *, respondents_share / first_value(respondents_share)
        OVER (PARTITION BY industry_consolidated ORDER BY year) * 100 AS respondents_share_ind
        FROM (SELECT year, industry_consolidated, count(*) AS respondents,
              count(*) / sum(count(*)) OVER (PARTITION BY year) AS respondents_share
              FROM r WHERE year >= 2015 AND country = 'canada'
              AND industry_consolidated IS NOT NULL GROUP BY 1, 2)"""),
    "stable": (("iy",), """SELECT industry_consolidated FROM iy GROUP BY 1
        HAVING min(respondents) >= 20 AND count(*) = 3
        AND industry_consolidated NOT IN ('consulting', 'manufacturing', 'government', 'other')"""),
    "es": (("home",), """SELECT employment_status_original, count(*) AS respondents,
        count(*) / sum(count(*)) OVER () AS respondents_share,
        CASE employment_status_original WHEN 'employed full-time' THEN 1
        WHEN 'independent contractor, freelancer, or self-employed' THEN 2
        WHEN 'employed part-time' THEN 3 WHEN 'not employed, but looking for work' THEN 4
        WHEN 'not employed, and not looking for work' THEN 5 END AS status_ord
        FROM home WHERE employment_status_original IS NOT NULL
        AND employment_status_original NOT IN ('retired', 'i prefer not to say') GROUP BY 1"""),
    # people
    "seek": (("home",), """SELECT * EXCLUDE (employment_status_original),
        CASE WHEN employment_status_original LIKE '%not employed%' THEN 'unemployed'
             ELSE employment_status_original END AS employment_status_original
        FROM home WHERE job_seeking_status IS NOT NULL
        AND (employment_status_original LIKE '%not employed%' OR employment_status_original IN (
          'employed full-time', 'employed part-time',
          'independent contractor, freelancer, or self-employed'))"""),
    "jc": (("home",), f"""SELECT job_discovery_channel, count(*) AS respondents,
        count(*) / sum(count(*)) OVER () AS respondents_share,
        CASE WHEN job_discovery_channel LIKE '%job board%' THEN 'Job Board'
             WHEN job_discovery_channel LIKE '%friend%'
             THEN 'Friend, family member,' || chr(10) || 'or former colleague'
             WHEN job_discovery_channel LIKE '%someone at the company%'
             THEN 'Contacted directly by' || chr(10) || 'someone at the company'
             WHEN job_discovery_channel LIKE '%career fair%'
             THEN 'Career fair or' || chr(10) || 'on-campus recruiting event'
             WHEN job_discovery_channel LIKE '%headhunter%'
             THEN 'External recruiter or headhunter'
             WHEN job_discovery_channel LIKE '%web site%'
             THEN 'Job listing on company''s website'
             WHEN job_discovery_channel LIKE '%other%' THEN 'Other'
             ELSE {title_sql("job_discovery_channel")} END AS job_discovery_channel_label
        FROM home WHERE job_discovery_channel IS NOT NULL GROUP BY 1"""),
    "ed": (("devs",), """SELECT educ_level_group_label, region, count(*) AS respondents,
        CAST(sum(CAST(salary_cad AS DECIMAL(28,8))) AS DOUBLE) / nullif(count(salary_cad), 0)
            AS mean_salary_cad,
        count(salary_cad) AS n_salary_responses,
        round(median(salary_cad), 6) AS median_salary_cad,
        count(*) / sum(count(*)) OVER (PARTITION BY region) AS respondents_share,
        CASE educ_level_group_label WHEN 'High School or Lower' THEN 1 WHEN 'Some College' THEN 2
          WHEN 'Bachelor''s Degree' THEN 3 WHEN 'Graduate Degree' THEN 4 END AS educ_ord
        FROM devs WHERE region IS NOT NULL AND educ_level_group_label IS NOT NULL GROUP BY 1, 2"""),
    "ie": (("home",), """SELECT informal_educ, count(*) AS respondents,
        count(*) / (SELECT count(*) FROM home) AS respondents_share
        FROM (SELECT unnest(coalesce(informal_educ, [NULL])) AS informal_educ FROM home)
        GROUP BY 1"""),
    "g": (("r",), """SELECT year, country, carow AS region_carow_label, gender,
        count(*) AS respondents, count(*) / sum(count(*)) OVER (PARTITION BY year, country)
        AS respondents_share FROM r WHERE country IS NOT NULL AND gender IS NOT NULL
        AND gender <> 'prefer not to disclose' GROUP BY 1, 2, 3, 4"""),
    "gl": (("g",), """SELECT country FROM g WHERE year = 2017 GROUP BY 1
        HAVING sum(respondents) >= 20"""),
    "gtop": (("g", "gl"), """SELECT country FROM g SEMI JOIN gl USING (country)
        WHERE year = 2017 AND gender = 'female'
        QUALIFY rank() OVER (ORDER BY respondents_share DESC) <= 10"""),
    "gx": (("home",), """SELECT gender, bin AS pro_experience_bin,
        above_15 AS pro_experience_bin_above_15, count(*) AS respondents,
        count(*) / sum(count(*)) OVER (PARTITION BY gender) AS respondents_share
        FROM home WHERE gender IS NOT NULL AND gender <> 'prefer not to disclose'
        AND bin IS NOT NULL GROUP BY 1, 2, 3"""),
    "eth": (("r",), """SELECT respondent_id, packed FROM (SELECT respondent_id,
        regexp_replace(regexp_replace(regexp_replace(array_to_string(ethnicities, ';'),
          '(I don.t know|I prefer not to say)', '', 'g'), '^;|;$', '', 'g'), ';+', ';', 'g')
          AS packed FROM r WHERE year = 2017 AND country = 'canada')
        WHERE regexp_matches(packed, '[A-Za-z]')"""),
    "eths": (("eth",), """SELECT ethnicity, count(*) AS respondents,
        count(*) / (SELECT count(*) FROM eth) AS respondents_share
        FROM (SELECT unnest(string_split(packed, ';')) AS ethnicity FROM eth) GROUP BY 1"""),
}
