"""The report's results on the derived survey and traffic tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placemetrics.operators.measures import PARENT_ROLES_AS_PUBLISHED
from placemetrics.plans.common import LATEST_YEAR
from placemetrics.plans import country, languages, maps, people, places, roles, salary, workplaces
from placemetrics.queries import tables as t
from placemetrics.queries.registry import quoted, register, rounded, title_sql
from placemetrics.sources.files import feature_lines


# --- inputs ---------------------------------------------------------------------

def countries(spark: SparkSession, folder: str) -> DataFrame:
    return country.country_years(t.respondents(spark, folder), t.population(spark, folder),
                                 t.country_names(spark))


def developers(*medians: str, year: int | None = LATEST_YEAR):
    """Salaries per country, of the year that the report shows unless another is named."""
    return lambda spark, folder: country.country_years_prodevs(
        t.respondents(spark, folder, year), medians)


CAD, PPP = "median_salary_cad", "median_salary_intl_dollar"
BY_GENDER = ["median_salary_cad_males", "median_salary_cad_females"]


def role_labels(spark: SparkSession) -> DataFrame:
    return t.pairs(spark, t.ROLE_LABELS, "dev_role string, dev_role_label string")


def city_names(spark: SparkSession) -> DataFrame:
    return t.pairs(spark, t.CONSOLIDATED_CITIES, "city_in_traffic string, city_consolidated string")


def provinces(spark: SparkSession, folder: str, sheet: DataFrame | None = None) -> DataFrame:
    sheet = t.national_sheet(spark, folder) if sheet is None else sheet
    employment = places.province_employment(*t.employment_tables(spark, folder))
    consolidations = t.pairs(spark, t.CONSOLIDATED_PROVINCES,
                             "province_original string, province_consolidated string")
    return places.province_shares(sheet, employment, consolidations)


def cities(spark: SparkSession, folder: str, sheet: DataFrame | None = None) -> DataFrame:
    sheet = t.national_sheet(spark, folder) if sheet is None else sheet
    statistics = places.city_statistics(*t.city_tables(spark, folder))
    names = t.pairs(spark, t.STATISTICAL_NAMES, "city_in_statistics string, city_consolidated string")
    return places.city_table(sheet, statistics, city_names(spark), names,
                             provinces(spark, folder, sheet))


def quotients(spark: SparkSession, folder: str) -> DataFrame:
    sheet = t.national_sheet(spark, folder)
    return roles.role_city_quotients(sheet, cities(spark, folder, sheet), city_names(spark),
                                     role_labels(spark))


def abroad(spark: SparkSession, folder: str) -> DataFrame:
    return roles.international_quotients(t.international_sheet(spark, folder),
                                         t.city_countries(spark, folder))


def world_cities(spark: SparkSession, folder: str) -> DataFrame:
    return places.city_years(t.city_sheet(spark, folder))


def language_labels(spark: SparkSession) -> DataFrame:
    return t.pairs(spark, t.LANGUAGE_LABELS, "language string, language_label string")


def language_regions(spark: SparkSession, folder: str) -> DataFrame:
    return languages.language_regions(t.respondents(spark, folder), language_labels(spark))


def language_years(spark: SparkSession, folder: str) -> DataFrame:
    return languages.language_years(t.respondents(spark, folder), language_labels(spark))


def company_type_labels(spark: SparkSession) -> DataFrame:
    return t.pairs(spark, t.COMPANY_TYPE_LABELS, "company_type string, company_type_label string")


def company_types(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(workplaces.company_types(t.respondents(spark, folder),
                                            company_type_labels(spark)), CAD, digits=6)


def company_type_shares(spark: SparkSession, folder: str) -> DataFrame:
    return workplaces.company_types(t.respondents(spark, folder), company_type_labels(spark),
                                    with_salary=False)


def company_sizes(spark: SparkSession, folder: str) -> DataFrame:
    return workplaces.company_sizes(t.respondents(spark, folder))


def industries(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(workplaces.industries(t.respondents(spark, folder)), "median_salary_cad",
                   digits=6)


def industry_shares(spark: SparkSession, folder: str) -> DataFrame:
    return workplaces.industries(t.respondents(spark, folder), with_salary=False)


def industry_years(spark: SparkSession, folder: str) -> DataFrame:
    return workplaces.industry_years(t.respondents(spark, folder))


def genders(spark: SparkSession, folder: str) -> DataFrame:
    return people.gender_country_years(t.respondents(spark, folder))


def education(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(people.education_regions(t.respondents(spark, folder)), "median_salary_cad",
                   digits=6)


def on(build, plan):
    """A query that applies a plan to one derived table."""
    return lambda spark, folder: plan(build(spark, folder))


def scale_factor(spark: SparkSession, folder: str) -> DataFrame:
    sheet = t.national_sheet(spark, folder)
    return places.scale_factor(sheet, provinces(spark, folder, sheet))


# --- country --------------------------------------------------------------------

register("country_years", countries, "SELECT * FROM cy", ["cy"])
register("country_prodev_summary",
         on(developers(*country.MEDIANS, year=None), lambda df: rounded(rounded(
             df, *[c for c in df.columns if c.startswith("median")], digits=6),
             "mean_pro_experience_years", "salary_pc_diff_females_males")),
         """SELECT * REPLACE (
            round(median_salary_cad, 6) AS median_salary_cad,
            round(median_salary_usd, 6) AS median_salary_usd,
            round(median_salary_intl_dollar, 6) AS median_salary_intl_dollar,
            round(median_pro_experience_years, 6) AS median_pro_experience_years,
            round(median_salary_cad_males, 6) AS median_salary_cad_males,
            round(median_salary_cad_females, 6) AS median_salary_cad_females,
            round(salary_pc_diff_females_males, 9) AS salary_pc_diff_females_males)
            FROM pd""", ["pd"])
register("region_years", on(t.respondents, country.region_years), "SELECT * FROM ry", ["ry"])
register("top_countries_with_ties", on(countries, country.top_countries),
         f"""SELECT country, {title_sql('country')} AS country_label, region_carow_label,
         respondents, respondents_share FROM cy WHERE year = 2017
         QUALIFY rank() OVER (ORDER BY respondents_share DESC) <= 10""", ["cy"])
register("country_sample_size", on(countries, country.sample_size),
         "SELECT CAST(sum(respondents) AS BIGINT) AS respondents FROM cy WHERE year = 2017", ["cy"])
register("per_capita_relative_to_home",
         on(countries, lambda df: country.per_capita_relative(df, minimum=20, n=21)),
         """SELECT country, region_carow_label, respondents_per_capita,
         respondents_per_capita / max(respondents_per_capita) FILTER (country = 'canada') OVER ()
         AS respondents_per_capita_ind FROM (SELECT * FROM cy WHERE year = 2017
         AND respondents >= 20 QUALIFY rank() OVER (ORDER BY respondents_per_capita DESC) <= 21)""",
         ["cy"])
register("countries_with_enough_respondents", on(countries, country.n_countries),
         "SELECT count(*) AS countries FROM cy WHERE year = 2017 AND respondents >= 50", ["cy"])
register("region_share_index",
         lambda s, d: country.region_index(country.region_years(t.respondents(s, d))),
         """SELECT *, respondents_share / first_value(respondents_share)
         OVER (PARTITION BY region ORDER BY year) * 100 AS respondents_share_ind,
         CASE region WHEN 'ROW' THEN 1 WHEN 'EU' THEN 2 WHEN 'US' THEN 3 WHEN 'Canada' THEN 4 END
         AS region_ord FROM ry""", ["ry"])
register("growth_of_leading_countries", on(countries, country.growth_of_leading_countries),
         """SELECT country, arg_max(respondents_share, year) / arg_min(respondents_share, year) - 1
         AS respondents_share_pc_change FROM cy
         WHERE year IN (2015, 2017) AND country IN (SELECT country FROM
           (SELECT country, avg(respondents_share) AS m FROM cy WHERE year >= 2015 GROUP BY 1)
           QUALIFY rank() OVER (ORDER BY m DESC) <= 15) GROUP BY 1""", ["cy"])

# --- provinces and cities -------------------------------------------------------

register("province_employment",
         lambda s, d: rounded(places.province_employment(*t.employment_tables(s, d)), "employees"),
         "SELECT place AS province, round(employees, 9) AS employees FROM prov_emp", ["prov_emp"])
_PROVINCES = """SELECT province_consolidated, visitors, round(employees, 6) AS employees,
    visitors_share, round(employees_share, 9) AS employees_share,
    round(visitors_share / employees_share, 9) AS visitor_employee_ratio"""
register("province_concentration",
         lambda s, d: rounded(provinces(s, d), "employees", "employees_share",
                              "visitor_employee_ratio").withColumn(
                                  "employees", F.round("employees", 6)),
         _PROVINCES + " FROM prov", ["prov"])
register("provinces_in_fixed_order",
         lambda s, d: places.provinces_in_order(provinces(s, d)).select(
             "province_consolidated", "province_label", "province_ord", "visitors_share"),
         f"""SELECT province_consolidated, {title_sql('province_consolidated')} AS province_label,
         CASE province_consolidated WHEN 'territories' THEN 1 WHEN 'british columbia' THEN 2
         WHEN 'alberta' THEN 3 WHEN 'saskatchewan' THEN 4 WHEN 'manitoba' THEN 5
         WHEN 'ontario' THEN 6 WHEN 'quebec' THEN 7 WHEN 'atlantic canada' THEN 8 END
         AS province_ord, visitors_share FROM prov""", ["prov"])
register("city_scale_factor",
         scale_factor,
         """SELECT (SELECT national FROM nat WHERE dev_role = 'all developers')
         / sum(visitors) AS scale_factor FROM prov""", ["nat", "prov"])
register("city_statistics",
         lambda s, d: places.city_statistics(*t.city_tables(s, d)),
         """SELECT CASE stat_name WHEN 'Ottawa-Gatineau, Ontario/Quebec' THEN 'ottawa  -  gatineau'
            WHEN 'Montréal, Quebec' THEN 'montreal' WHEN 'Québec, Quebec' THEN 'quebec city'
            WHEN 'Kitchener-Cambridge-Waterloo, Ontario'
            THEN 'Kitchener  -  Cambridge  -  Waterloo'
            ELSE regexp_replace(stat_name, ',.*', '') END AS city, employees, population FROM stat
         UNION ALL SELECT 'Canada', CAST(count(*) FILTER (c_acctbal > 2000) AS DOUBLE) * 1000,
            CAST(count(*) AS DOUBLE) FROM customer""", ["stat"])
_CITY_COLUMNS = """visitors, round(visitors_scaled, 9) AS visitors_scaled,
    round(visitors_share_scaled, 9) AS visitors_share_scaled, employees, employees_share,
    round(visitor_employee_ratio, 9) AS visitor_employee_ratio"""
register("city_table",
         lambda s, d: rounded(places.city_export(cities(s, d)), "visitors_scaled",
                              "visitors_share_scaled", "visitor_employee_ratio"),
         f"SELECT city_consolidated AS city, {_CITY_COLUMNS} FROM cities", ["cities"])
for _by in ("visitors_share_scaled", "visitor_employee_ratio"):
    register(f"cities_by_{_by}",
             lambda s, d, by=_by: rounded(places.cities_sorted(cities(s, d), by), by),
             f"""SELECT city_consolidated,
             {title_sql("replace(city_consolidated, '_', '-')")} AS city_label,
             round({_by}, 9) AS {_by} FROM cities""", ["cities"])
register("most_populous_cities_share",
         lambda s, d: rounded(places.most_populous_share(cities(s, d)), "visitors_share_scaled",
                              "employees_share"),
         """SELECT round(sum(visitors_share_scaled), 9) AS visitors_share_scaled,
         round(sum(employees_share), 9) AS employees_share FROM (SELECT * FROM cities
         QUALIFY rank() OVER (ORDER BY population DESC) <= 3)""", ["cities"])
register("world_city_years", world_cities,
         "SELECT city, country, year, visitors FROM cty", ["cty"])
register("world_city_comparison",
         lambda s, d: places.global_city_comparison(world_cities(s, d)),
         f"""SELECT city, country, city_group,
         CASE WHEN position <= 20 THEN position || '. ' || label ELSE label END AS city_label,
         visitors, visitors_ind, format('{{:,.2f}}x', round_even(visitors_ind, 2)) AS text
         FROM (SELECT *, visitors / (SELECT visitors FROM cty WHERE year = 2017 AND city = 'toronto'
           AND country = 'canada') AS visitors_ind
         FROM (SELECT *, {title_sql('city')} AS label,
               row_number() OVER (ORDER BY visitors DESC, city, country) AS position
               FROM (SELECT city, country, visitors, CASE WHEN rk <= 20
                     THEN 'Top 20 Cities Globally' ELSE 'Other Canadian Cities' END AS city_group
                     FROM (SELECT *, rank() OVER (ORDER BY visitors DESC) AS rk FROM cty
                           WHERE year = 2017) WHERE rk <= 20 OR country = 'canada')))""", ["cty"])
register("world_city_ranks", on(world_cities, places.city_ranks),
         """SELECT * FROM (SELECT *, CAST(rank() OVER (ORDER BY visitors DESC) AS INTEGER) AS rank
         FROM cty WHERE year = 2017) WHERE country = 'canada'""", ["cty"])
register("world_city_growth", on(world_cities, lambda df: places.city_growth(df, minimum=90)),
         f"""SELECT city, country, visitors_first, visitors_last,
         visitors_last / visitors_first - 1 AS pc_growth, {title_sql('city')} AS city_label
         FROM (SELECT city, country, max(visitors) FILTER (year = 2016) AS visitors_first,
               max(visitors) FILTER (year = 2017) AS visitors_last FROM cty GROUP BY 1, 2)
         WHERE visitors_first >= 90""", ["cty"])

# --- status and roles -----------------------------------------------------------

register("professional_status", on(t.respondents, roles.status_shares),
         """SELECT *, CASE pro_status WHEN 'ex-pro dev' THEN 'Ex-Professional Developer'
         WHEN 'pro dev' THEN 'Professional Developer'
         WHEN 'pro non-dev' THEN 'Professional Non-Developer' WHEN 'pure hobbyist' THEN 'Other'
         WHEN 'student' THEN 'Student' END AS pro_status_label
         FROM (SELECT pro_status, count(*) AS respondents,
               count(*) / sum(count(*)) OVER () AS respondents_share
               FROM r WHERE year = 2017 AND country = 'canada' GROUP BY 1)
         WHERE pro_status IS NOT NULL""", ["r"])
_ROLE_SHARES = """SELECT dev_role, count(*) AS respondents, count(*) / (SELECT
    count(DISTINCT respondent_id) FROM home WHERE dev_roles IS NOT NULL) AS respondents_share
    FROM (SELECT unnest(dev_roles) AS dev_role FROM home) GROUP BY 1"""
register("role_shares", on(t.respondents, roles.role_shares), _ROLE_SHARES, ["home"])
register("role_shares_labelled",
         lambda s, d: roles.role_shares_labelled(
             roles.role_shares(t.respondents(s, d)),
             t.pairs(s, t.DEV_ROLE_LABELS, "dev_role string, dev_role_label string")),
         "SELECT *, CASE dev_role " + " ".join(
             f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in {
                 **t.DEV_ROLE_LABELS,
                 "dev w/ stats/math": "Developer with a Statistics\nor Mathematics Background",
                 "embedded": "Embedded Applications/\nDevices Developer",
                 "web developer": "Web Developer (Front-End,\nBack-End, or Full-Stack)",
                 "mobile developer": "Mobile Developer\n(Android, iOS, etc.)"}.items())
         + f" END AS dev_role_label FROM ({_ROLE_SHARES})", ["home"])
register("respondents_with_roles", on(t.respondents, roles.n_with_roles),
         """SELECT count(DISTINCT respondent_id) AS respondents FROM home
         WHERE dev_roles IS NOT NULL""", ["home"])
register("desktop_or_mobile_share", on(t.respondents, roles.any_role_share),
         """SELECT CAST(count(*) FILTER (hit) AS DOUBLE) / count(*) AS respondents_share
         FROM (SELECT respondent_id, bool_or(regexp_matches(dev_role, 'desktop|mobile')) AS hit
         FROM (SELECT respondent_id, unnest(dev_roles) AS dev_role FROM home) GROUP BY 1)""",
         ["home"])
register("several_roles_share", on(t.respondents, roles.several_roles_share),
         """SELECT CAST(count(*) FILTER (len(dev_roles) > 1) AS DOUBLE) / count(*)
         AS respondents_share FROM home WHERE dev_roles IS NOT NULL""", ["home"])
register("web_roles", on(t.respondents, roles.web_roles),
         f"""SELECT *, {title_sql("replace(web_dev_role, 'full stack', 'full-stack')")}
         AS web_dev_role_label FROM (SELECT web_dev_role, count(*) AS respondents,
         count(*) / sum(count(*)) OVER () AS respondents_share FROM home
         WHERE web_dev_role IS NOT NULL GROUP BY 1)""", ["home"])
register("web_role_sample_size", on(t.respondents, roles.n_web_roles),
         "SELECT count(web_dev_role) AS respondents FROM home", ["home"])
register("role_city_quotients", quotients,
         """SELECT dev_role, city_consolidated, visitors, total, national_share, visitors_share,
         location_quotient, dev_role_label FROM lq""", ["lq"])
register("top_cities_per_role", on(quotients, lambda df: roles.top_cities_per_role(df).select(
             "dev_role", "city_consolidated", "city_label", "location_quotient", "role_ord")),
         f"""SELECT dev_role, city_consolidated,
         {title_sql("replace(city_consolidated, '_', '-')")} AS city_label, location_quotient,
         CASE dev_role_label WHEN 'Front-End Web Developer' THEN 1
         WHEN 'Back-End Web Developer' THEN 2 WHEN 'Android Mobile Developer' THEN 4
         WHEN 'iOS Mobile Developer' THEN 5 WHEN 'Desktop Developer' THEN 6 END AS role_ord
         FROM (SELECT * FROM lq WHERE dev_role NOT IN ('all developers', 'mobile developers',
           'web developers', 'other kinds of developers')
           QUALIFY rank() OVER (PARTITION BY dev_role ORDER BY location_quotient DESC) <= 5)""",
         ["lq"])
register("international_quotients", abroad,
         """SELECT dev_role, city, country, visitors_city, visitors_share_city, visitors_country,
         visitors_share_country, location_quotient FROM ilq""", ["ilq"])
register("role_city_export",
         lambda s, d: roles.role_city_export(quotients(s, d), abroad(s, d), role_labels(s)),
         "SELECT * FROM exp", ["exp"])
register("role_province_export",
         lambda s, d: roles.role_province_export(t.national_sheet(s, d), role_labels(s)),
         """SELECT province, dev_role, parent AS dev_role_parent_group, visitors,
         province_visitors_share, location_quotient FROM plq""", ["plq"])
register("role_province_export_as_published",
         lambda s, d: roles.role_province_export(t.national_sheet(s, d), role_labels(s),
                                                 PARENT_ROLES_AS_PUBLISHED),
         """SELECT province, dev_role, published_parent AS dev_role_parent_group, visitors,
         province_visitors_share, location_quotient FROM plq""", ["plq"])

# --- languages ------------------------------------------------------------------

register("language_regions", language_regions, "SELECT * FROM lr", ["lr"])
register("top_languages", on(language_regions, lambda df: languages.top_languages(df, n=5)),
         """SELECT language_label, "Canada", "ROW", canada_rank, row_rank FROM (
         SELECT *, rank() OVER (ORDER BY "Canada" DESC NULLS LAST)
           + (count(*) OVER (PARTITION BY "Canada") - 1) / 2 AS canada_rank,
         rank() OVER (ORDER BY "ROW" DESC NULLS LAST)
           + (count(*) OVER (PARTITION BY "ROW") - 1) / 2 AS row_rank
         FROM (SELECT language_label,
           max(respondents_share) FILTER (region_carow_label = 'Canada') AS "Canada",
           max(respondents_share) FILTER (region_carow_label = 'ROW') AS "ROW"
           FROM lr GROUP BY 1)) QUALIFY rank() OVER (ORDER BY canada_rank) <= 5""", ["lr"])
register("top_language_shares",
         on(language_regions, lambda df: languages.top_language_shares(df, n=5)),
         """SELECT language_label, region_carow_label, respondents_share, canada_rank FROM lr
         JOIN (SELECT language_label, rank() OVER (ORDER BY respondents_share DESC)
           + (count(*) OVER (PARTITION BY respondents_share) - 1) / 2 AS canada_rank
           FROM lr WHERE region_carow_label = 'Canada' QUALIFY rank() OVER (
             ORDER BY respondents_share DESC) <= 5) USING (language_label)""", ["lr"])
register("language_sample_size", on(language_regions, languages.n_language_respondents),
         """SELECT DISTINCT total_respondents FROM lr
         WHERE region_carow_label = 'Canada'""", ["lr"])
register("share_of_one_language",
         on(language_regions, lambda df: languages.one_language(df, "javascript")),
         """SELECT respondents_share FROM lr WHERE region_carow_label = 'Canada'
         AND language = 'javascript'""", ["lr"])
register("languages_per_person", on(t.respondents, languages.language_count_histogram),
         """SELECT n_languages, count(*) / sum(count(*)) OVER () AS n_languages_share FROM nl
         GROUP BY 1""", ["nl"])
register("language_answers", on(t.respondents, languages.n_language_answers),
         "SELECT count(languages) AS respondents FROM home", ["home"])
register("languages_over_limit", on(t.respondents, lambda df: languages.n_over_limit(df, 4.5)),
         "SELECT count(*) AS respondents FROM nl WHERE n_languages > 4.5", ["nl"])
register("at_least_two_languages",
         on(t.respondents, lambda df: rounded(languages.at_least_languages(df),
                                              "respondents_share")),
         """SELECT round(count(*) FILTER (n_languages >= 2) / count(*), 9) AS respondents_share
         FROM nl""", ["nl"])
register("language_years", language_years,
         """SELECT language, language_label, year, respondents, total_respondents,
         respondents_share, respondents_share_ind, respondents_share_pc_growth_yoy FROM ly""",
         ["ly"])
register("language_averages", on(language_years, lambda df: rounded(
             languages.language_averages(df), "avg_respondents_share")), "SELECT * FROM la", ["la"])
register("widely_used_languages", on(language_years, lambda df: rounded(
             languages.widely_used(df), "avg_respondents_share")), "SELECT * FROM lw", ["lw"])
register("widely_used_language_years",
         on(language_years, lambda df: languages.widely_used_years(df).select(
             "language_label", "year", "respondents_share_ind")),
         """SELECT language_label, year, respondents_share_ind FROM ly
         WHERE language IN (SELECT language FROM lw)""", ["ly", "lw"])
register("latest_language_growth", on(language_years, languages.latest_growth),
         """SELECT language, respondents_share, respondents_share_pc_growth_yoy FROM ly
         WHERE language IN (SELECT language FROM lw) AND year = 2017""", ["ly", "lw"])
register("language_home_to_world_ratio",
         lambda s, d: languages.home_to_world_ratio(language_regions(s, d), minimum=20),
         """SELECT c.language, c.respondents_share AS "Canada", w.respondents_share AS "ROW",
         c.respondents_share / w.respondents_share AS carow_ratio, c.language_label,
         format('{:,.2f}x', round_even(c.respondents_share / w.respondents_share, 2)) AS text
         FROM lr c LEFT JOIN lr w ON c.language = w.language AND w.region_carow_label = 'ROW'
         WHERE c.region_carow_label = 'Canada' AND c.respondents >= 20""", ["lr"])

# --- companies, industries, employment --------------------------------------------

register("company_types", company_types, "SELECT * FROM ct", ["ct"])
register("company_types_sorted", on(company_type_shares, workplaces.company_types_sorted),
         """SELECT company_type_label, region_carow_label, respondents_share FROM ct
         WHERE company_type <> 'other'""", ["ct"])
register("company_types_side_by_side", on(company_type_shares, workplaces.company_types_wide),
         """SELECT company_type,
         max(respondents_share) FILTER (region_carow_label = 'Canada') AS "Canada",
         max(respondents_share) FILTER (region_carow_label = 'ROW') AS "ROW"
         FROM ct GROUP BY 1""", ["ct"])
register("company_sizes", company_sizes, "SELECT * FROM cs", ["cs"])
_BY_REGION = ", ".join(f"max(v) FILTER (region = '{r}') AS \"{r}\"" for r in workplaces.REGIONS)
register("company_sizes_running_share",
         on(company_sizes, lambda df: rounded(workplaces.company_sizes_running(df),
                                              *workplaces.REGIONS)),
         f"""SELECT company_size, size_ord, {_BY_REGION} FROM (SELECT *,
         round(sum(respondents_share) OVER (PARTITION BY region ORDER BY size_ord), 9) AS v FROM cs)
         GROUP BY 1, 2""", ["cs"])
register("company_sizes_by_region", on(company_sizes, workplaces.company_sizes_wide),
         f"""SELECT company_size, size_ord, {_BY_REGION} FROM
         (SELECT *, respondents_share AS v FROM cs) GROUP BY 1, 2""", ["cs"])
register("industries", industries, "SELECT * FROM ind", ["ind"])
register("top_industries", on(industry_shares, lambda df: workplaces.top_industries(df, n=4)),
         """SELECT industry_original, industry_original_label, respondents_share FROM ind
         WHERE region_carow_label = 'Canada' AND industry_original_label IN (
           SELECT industry_original_label FROM ind WHERE region_carow_label = 'Canada'
           QUALIFY rank() OVER (ORDER BY respondents_share DESC) <= 4)""", ["ind"])
register("industry_sample_size", on(industry_shares, workplaces.n_industry_respondents),
         """SELECT CAST(sum(respondents) AS BIGINT) AS respondents FROM ind
         WHERE region_carow_label = 'Canada'""", ["ind"])
register("software_and_web_share",
         on(industry_shares, lambda df: rounded(workplaces.industry_subset_share(df),
                                           "respondents_share")),
         """SELECT round(sum(respondents_share), 9) AS respondents_share FROM ind
         WHERE region_carow_label = 'Canada'
         AND industry_original IN ('software', 'internet or web services')""", ["ind"])
register("other_leading_industries", on(industry_shares, workplaces.industry_subset),
         """SELECT industry_original, respondents_share FROM ind
         WHERE region_carow_label = 'Canada' AND industry_original IN (
           'finance, banking, or insurance', 'health care services', 'consulting',
           'media, advertising, publishing, or entertainment')""", ["ind"])
register("industry_comparison",
         on(industries, lambda df: rounded(workplaces.industry_comparison(df),
                                           "pc_diff_median_salary_carow",
                                           "diff_median_salary_carow", "pp_diff_carow",
                                           "pc_diff_carow", digits=6)),
         """SELECT *, respondents_ca + respondents_row AS respondents_total,
         round(respondents_share_ca / respondents_share_row - 1, 6) AS pc_diff_carow,
         round(respondents_share_ca - respondents_share_row, 6) AS pp_diff_carow,
         round(median_salary_cad_ca / median_salary_cad_row - 1, 6) AS pc_diff_median_salary_carow,
         round(median_salary_cad_ca - median_salary_cad_row, 6) AS diff_median_salary_carow
         FROM iw""", ["iw"])
register("industry_home_to_world_ratio",
         on(industries, lambda df: workplaces.industry_ratio(workplaces.industry_comparison(df),
                                                             minimum=15)),
         """SELECT industry_original_label, respondents_share_ca / respondents_share_row
         AS carow_ratio FROM iw WHERE respondents_ca >= 15
         AND industry_original_label NOT LIKE '%Other%'""", ["iw"])
register("industry_years", industry_years, "SELECT * FROM iy", ["iy"])
register("stable_industries", on(industry_years, workplaces.stable_industries),
         "SELECT * FROM stable", ["stable"])
register("stable_industry_years", on(industry_years, workplaces.stable_industry_years),
         f"""SELECT *, {title_sql('industry_consolidated')} AS industry_label FROM iy
         WHERE industry_consolidated IN (SELECT industry_consolidated FROM stable)""",
         ["iy", "stable"])
register("industry_growth", on(industry_years, workplaces.industry_growth),
         """SELECT industry_consolidated, s17 / s16 - 1 AS growth_year, s17 / s15 - 1
         AS growth_period FROM (SELECT industry_consolidated,
           max(respondents_share) FILTER (year = 2015) AS s15,
           max(respondents_share) FILTER (year = 2016) AS s16,
           max(respondents_share) FILTER (year = 2017) AS s17 FROM iy GROUP BY 1)""", ["iy"])
register("industry_growth_other_mapping",
         lambda s, d: workplaces.industry_growth_alternative(
             t.respondents(s, d), t.pairs(s, t.INDUSTRY_CONSOLIDATIONS,
                                          "industry_original string, industry_consolidated string")),
         """SELECT * FROM (SELECT *, respondents_share / lag(respondents_share) OVER (
             PARTITION BY industry_consolidated ORDER BY year) - 1 AS respondents_share_pc_growth
         FROM (SELECT year, CASE industry_original
             WHEN 'internet or web services' THEN 'internet or web services'
             WHEN 'finance, banking, or insurance' THEN 'finance'
             WHEN 'media, advertising, publishing, or entertainment' THEN 'media and advertising'
             WHEN 'health care services' THEN 'health care'
             WHEN 'government (including military)' THEN 'government'
             WHEN 'other (please specify)' THEN 'other' WHEN 'student' THEN 'n/a' END
             AS industry_consolidated, count(*) AS respondents,
             count(*) / sum(count(*)) OVER (PARTITION BY year) AS respondents_share
           FROM r WHERE year >= 2015 AND country = 'canada' AND industry_original IS NOT NULL
           GROUP BY 1, 2)) WHERE industry_consolidated = 'health care' AND year = 2017""", ["r"])
register("employment_statuses", on(t.respondents, workplaces.employment_statuses),
         "SELECT * FROM es", ["es"])
register("employment_sample_size",
         lambda s, d: workplaces.n_employment_statuses(
             workplaces.employment_statuses(t.respondents(s, d))),
         "SELECT CAST(sum(respondents) AS BIGINT) AS respondents FROM es", ["es"])

# --- salaries -------------------------------------------------------------------

_MONEY = "format('C${:,.0f}', round_even(median_salary_cad, 0))"
_ENOUGH = "year = 2017 AND n_salary_responses >= 20"
_ENOUGH_PPP = _ENOUGH + " AND n_salary_intl_dollar_responses >= 20"
register("top_salary_countries",
         on(developers(CAD), lambda df: rounded(salary.top_salary_countries(df, n=10),
                                           "median_salary_cad", digits=6)),
         f"""SELECT country, {title_sql('country')} AS country_label,
         round(median_salary_cad, 6) AS median_salary_cad,
         {_MONEY} AS text FROM pd WHERE {_ENOUGH}
         QUALIFY rank() OVER (ORDER BY median_salary_cad DESC) <= 10""", ["pd"])
register("salary_countries", on(developers(), salary.n_salary_countries),
         f"SELECT count(*) AS countries FROM pd WHERE {_ENOUGH}", ["pd"])
register("home_salary_rank",
         on(developers(CAD), lambda df: rounded(salary.salary_rank(df), "median_salary_cad", digits=6)),
         f"""SELECT country, rank, round(median_salary_cad, 6) AS median_salary_cad,
         n_salary_responses FROM (SELECT *, CAST(rank() OVER (ORDER BY median_salary_cad DESC)
         AS INTEGER) AS rank FROM pd WHERE {_ENOUGH}) WHERE country = 'canada'""", ["pd"])
register("one_country_salary",
         on(developers(CAD), lambda df: rounded(salary.one_country_salary(df), "median_salary_cad",
                                           digits=6)),
         """SELECT country, mean_salary_cad, round(median_salary_cad, 6) AS median_salary_cad,
         n_salary_responses FROM pd WHERE year = 2017 AND country = 'united states'""", ["pd"])
register("salary_ranks_market_and_ppp",
         on(developers(CAD, PPP), lambda df: rounded(
             salary.market_and_ppp(df, minimum=15, n=10), "median_salary_ind")),
         f"""SELECT country, region_carow_label, currency, round(ind, 9) AS median_salary_ind,
         median_salary_rank, regexp_replace(CAST(median_salary_rank AS VARCHAR), '\\.0$', '')
           || '. ' || {title_sql('country')} AS country_label
         FROM (SELECT *, rank() OVER (PARTITION BY currency ORDER BY ind DESC)
           + (count(*) OVER (PARTITION BY currency, ind) - 1) / 2 AS median_salary_rank
         FROM (SELECT country, region_carow_label, 'Market Exchange Rates' AS currency,
           median_salary_cad / (SELECT median_salary_cad FROM pd WHERE year = 2017
             AND country = 'canada') AS ind FROM pd WHERE year = 2017
             AND n_salary_responses >= 15 AND n_salary_intl_dollar_responses >= 15
         UNION ALL SELECT country, region_carow_label, 'PPP Exchange Rates',
           median_salary_intl_dollar / (SELECT median_salary_intl_dollar FROM pd
             WHERE year = 2017 AND country = 'canada') FROM pd WHERE year = 2017
             AND n_salary_responses >= 15 AND n_salary_intl_dollar_responses >= 15)
         QUALIFY rank() OVER (PARTITION BY currency ORDER BY ind DESC) <= 10)""", ["pd"])
register("ppp_countries", on(developers(), lambda df: salary.n_salary_countries(df, ppp=True)),
         f"SELECT count(*) AS countries FROM pd WHERE {_ENOUGH_PPP}", ["pd"])
register("home_ppp_rank", on(developers(PPP), salary.ppp_rank),
         f"""SELECT rk AS median_salary_intl_dollar_rank FROM (SELECT country,
         rank() OVER (ORDER BY median_salary_intl_dollar DESC)
         + (count(*) OVER (PARTITION BY median_salary_intl_dollar) - 1) / 2 AS rk
         FROM pd WHERE {_ENOUGH_PPP}) WHERE country = 'canada'""", ["pd"])
register("currency_mismatch", on(t.respondents, salary.currency_mismatch),
         """SELECT CAST(count(*) FILTER (country_currency_code IS NULL
           OR local_currency_code IS NULL OR country_currency_code <> local_currency_code)
           AS DOUBLE) / count(*) AS mismatch_ratio FROM r
         WHERE year = 2017 AND salary_usd IS NOT NULL AND country IS NOT NULL""", ["r"])
register("salary_by_industry",
         on(industries, lambda df: salary.salary_by(df, "industry_original_label", minimum=10,
                                                    key="industry_original",
                                                    left_out=["other (please specify)"])),
         f"""SELECT industry_original_label, median_salary_cad, n_salary_responses, {_MONEY} AS text FROM ind
         WHERE region_carow_label = 'Canada' AND n_salary_responses >= 10
         AND industry_original <> 'other (please specify)'""", ["ind"])
register("salary_by_company_type",
         on(company_types, lambda df: salary.salary_by(df, "company_type_label", minimum=10)),
         f"""SELECT company_type_label, median_salary_cad, n_salary_responses, {_MONEY} AS text FROM ct
         WHERE region_carow_label = 'Canada' AND n_salary_responses >= 10""", ["ct"])

# --- people ---------------------------------------------------------------------

register("job_seeking_by_status",
         on(t.respondents, lambda df: people.seeking_by_status(df)),
         """SELECT employment_status_original, job_seeking_status, count(*) AS respondents,
         count(*) / sum(count(*)) OVER (PARTITION BY employment_status_original)
           AS respondents_share,
         CASE job_seeking_status WHEN 'i am actively looking for a job'
           THEN 'Actively looking for a job'
           WHEN 'i''m not actively looking, but i am open to new opportunities'
           THEN 'Not actively looking for a job,' || chr(10) || 'but open to new opportunities'
           WHEN 'i am not interested in new job opportunities'
           THEN 'Not interested in new job opportunities' END AS seeking_label,
         CASE employment_status_original WHEN 'employed full-time' THEN 'Employed full-time'
           WHEN 'independent contractor, freelancer, or self-employed'
           THEN 'Independent contractor, freelancer,' || chr(10) || 'or self-employed'
           WHEN 'employed part-time' THEN 'Employed part-time'
           WHEN 'unemployed' THEN 'Unemployed' END AS employment_label,
         CASE job_seeking_status WHEN 'i am actively looking for a job' THEN 1
           WHEN 'i am not interested in new job opportunities' THEN 3 ELSE 2 END AS seeking_ord,
         CASE employment_status_original WHEN 'employed full-time' THEN 1
           WHEN 'employed part-time' THEN 3 WHEN 'unemployed' THEN 4 ELSE 2 END AS employment_ord
         FROM seek GROUP BY 1, 2""", ["seek"])
register("job_seeking_sample_size", on(t.respondents, people.n_seekers),
         """SELECT employment_status_original, count(*) AS respondents FROM seek GROUP BY 1""",
         ["seek"])
register("job_channels", on(t.respondents, people.job_channels), "SELECT * FROM jc", ["jc"])


def job_channels(spark: SparkSession, folder: str) -> DataFrame:
    return people.job_channels(t.respondents(spark, folder))


register("job_channels_merged",
         on(job_channels, lambda df: rounded(people.job_channels_merged(df), "respondents_share")),
         """SELECT job_discovery_channel_label, round(sum(respondents_share), 9)
         AS respondents_share FROM jc GROUP BY 1""", ["jc"])
register("job_channel_sample_size", on(job_channels, people.n_job_channels),
         "SELECT CAST(sum(respondents) AS BIGINT) AS respondents FROM jc", ["jc"])
register("job_board_channels", on(job_channels, people.channels_matching),
         """SELECT job_discovery_channel FROM jc
         WHERE job_discovery_channel LIKE '%job board%'""", ["jc"])
register("contacted_by_recruiter_share",
         on(job_channels, lambda df: rounded(people.channel_share_matching(df),
                                             "respondents_share")),
         """SELECT round(sum(respondents_share), 9) AS respondents_share FROM jc
         WHERE regexp_matches(job_discovery_channel, 'recruiter|contacted directly')""", ["jc"])
register("education_by_region", education, "SELECT * FROM ed", ["ed"])
register("some_college_or_more",
         on(education, lambda df: rounded(people.some_college_or_more(df), "respondents_share")),
         """SELECT region, round(sum(respondents_share), 9) AS respondents_share FROM ed
         WHERE educ_level_group_label <> 'High School or Lower' GROUP BY 1""", ["ed"])
register("salary_by_education", on(education, people.education_salaries),
         """SELECT educ_level_group_label, educ_ord, median_salary_cad, n_salary_responses FROM ed
         WHERE region = 'Canada'""", ["ed"])
register("informal_education", on(t.respondents, people.informal_education),
         "SELECT * FROM ie", ["ie"])
register("informal_education_labelled",
         lambda s, d: people.informal_education_labelled(
             people.informal_education(t.respondents(s, d))),
         """SELECT *, CASE informal_educ
         WHEN 'Part-time/evening course' THEN 'Part-time/' || chr(10) || 'evening course'
         WHEN 'Open source contrib' THEN 'Open source' || chr(10) || 'contribution'
         WHEN 'Industry certification' THEN 'Industry' || chr(10) || 'certification'
         ELSE informal_educ END AS informal_educ_label FROM ie
         WHERE informal_educ IS NOT NULL""", ["ie"])
register("self_taught_by_education", on(t.respondents, people.self_taught_by_education),
         """SELECT educ_level_group_label, CASE WHEN coalesce(list_contains(informal_educ,
           'Self-taught'), false) THEN 'Partially Self-Taught' ELSE 'Not Partially Self-Taught' END
           AS is_self_taught, count(*) AS respondents,
         count(*) / sum(count(*)) OVER (PARTITION BY educ_level_group_label) AS respondents_share
         FROM home WHERE educ_level_group_label IS NOT NULL GROUP BY 1, 2""", ["home"])
_BOOTCAMP = """FROM r WHERE year = 2017 AND country = 'canada'
    AND unemployed_time_post_bootcamp IS NOT NULL"""
register("bootcamp_outcomes", on(t.respondents, people.bootcamp_outcomes),
         f"""SELECT CASE
         WHEN unemployed_time_post_bootcamp LIKE '%already had a job%'
         THEN 'Had a job prior to bootcamp'
         WHEN unemployed_time_post_bootcamp LIKE '%haven''t gotten a job%'
         THEN 'Haven''t gotten a job since bootcamp'
         ELSE 'Got a job since starting bootcamp' END AS bootcamp_group, count(*) AS respondents,
         count(*) / sum(count(*)) OVER () AS respondents_share {_BOOTCAMP} GROUP BY 1""", ["r"])
register("bootcamp_sample_size", on(t.respondents, people.n_bootcamp),
         f"SELECT count(*) AS respondents {_BOOTCAMP}", ["r"])
register("gender_country_years", genders, "SELECT * FROM g", ["g"])
register("gender_at_home", on(genders, people.gender_at_home),
         """SELECT gender, respondents, respondents_share FROM g
         WHERE country = 'canada' AND year = 2017""", ["g"])
register("genders_of_most_female_countries",
         on(genders, lambda df: people.genders_of_most_female(df, minimum=20, n=10)),
         """SELECT country, gender, CASE gender WHEN 'male' THEN 'Male' WHEN 'female' THEN 'Female'
           WHEN 'transgendered or non-conforming' THEN 'Transgendered' || chr(10) || 'or non-conforming'
           END AS gender_label, respondents, respondents_share FROM g SEMI JOIN gtop
         USING (country) WHERE year = 2017""", ["g", "gtop"])
register("gender_countries", on(genders, lambda df: people.n_gender_countries(df, minimum=20)),
         "SELECT count(*) AS countries FROM gl", ["gl"])
register("home_female_rank", on(genders, lambda df: people.female_rank(df, minimum=20)),
         """SELECT country, respondents, respondents_share, rank FROM (
         SELECT *, rank() OVER (ORDER BY respondents_share DESC)
           + (count(*) OVER (PARTITION BY respondents_share) - 1) / 2 AS rank
         FROM g SEMI JOIN gl USING (country) WHERE year = 2017 AND gender = 'female')
         WHERE country = 'canada'""", ["g", "gl"])
register("male_female_ratio",
         on(genders, lambda df: people.male_female_ratio(df)),
         """SELECT *, male / female AS male_female_ratio,
         format('{:,.1f}:1', round_even(male / female, 1)) AS text FROM (
         SELECT year, region_carow_label,
         CAST(sum(respondents) FILTER (gender = 'male') AS BIGINT) AS male,
         CAST(sum(respondents) FILTER (gender = 'female') AS BIGINT) AS female
         FROM g GROUP BY 1, 2)""", ["g"])
register("pay_gap",
         on(developers(*BY_GENDER), lambda df: rounded(people.pay_gap(df, minimum=8), *[
             "median_salary_cad_males", "median_salary_cad_females",
             "salary_pc_diff_females_males"], digits=6)),
         f"""SELECT country, {title_sql('country')} AS country_label,
         round(median_salary_cad_males, 6) AS median_salary_cad_males,
         round(median_salary_cad_females, 6) AS median_salary_cad_females,
         round(salary_pc_diff_females_males, 6) AS salary_pc_diff_females_males
         FROM pd WHERE year = 2017 AND n_salary_responses_males >= 8
         AND n_salary_responses_females >= 8""", ["pd"])
register("pay_at_home",
         on(developers(*BY_GENDER), lambda df: rounded(people.pay_at_home(df), "median_salary_cad_males",
                                           "median_salary_cad_females", digits=6)),
         """SELECT year, country, round(median_salary_cad_males, 6) AS median_salary_cad_males,
         round(median_salary_cad_females, 6) AS median_salary_cad_females
         FROM pd WHERE year = 2017 AND country = 'canada'""", ["pd"])
register("gender_and_experience", on(t.respondents, people.gender_experience),
         "SELECT * FROM gx", ["gx"])
register("genders_under_five_years",
         on(t.respondents, lambda df: people.experience_bin(people.gender_experience(df))),
         "SELECT * FROM gx WHERE pro_experience_bin = 'Under 5'", ["gx"])
register("genders_above_fifteen_years",
         on(t.respondents, lambda df: rounded(people.long_experience(
             people.gender_experience(df)), "respondents_share")),
         """SELECT gender, round(sum(respondents_share), 9) AS respondents_share FROM gx
         WHERE pro_experience_bin_above_15 GROUP BY 1""", ["gx"])
register("ethnicity_rows", on(t.respondents, people.n_ethnicity_rows),
         "SELECT count(*) AS respondents FROM eth", ["eth"])
register("ethnicity_respondents", on(t.respondents, people.n_ethnicity_respondents),
         "SELECT count(DISTINCT respondent_id) AS respondents FROM eth", ["eth"])
register("ethnicities", on(t.respondents, people.ethnicities), "SELECT * FROM eths", ["eths"])
register("ethnicities_sorted",
         lambda s, d: people.ethnicities_sorted(people.ethnicities(t.respondents(s, d))),
         """SELECT *, CASE WHEN ethnicity LIKE '%Native%'
         THEN 'Native American, Pacific Islander' || chr(10) || 'or Indigenous Australian'
         ELSE replace(ethnicity, 'descent', 'Descent') END AS ethnicity_label FROM eths""",
         ["eths"])
register("asian_share",
         lambda s, d: rounded(people.ethnicity_share_matching(
             people.ethnicities(t.respondents(s, d))), "respondents_share"),
         """SELECT round(sum(respondents_share), 9) AS respondents_share FROM eths
         WHERE ethnicity ILIKE '%asian%'""", ["eths"])

# --- maps -----------------------------------------------------------------------

_MAP_ROLE = " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in maps.MAP_ROLE_NAMES.items())


def _place_points(spark: SparkSession) -> DataFrame:
    rows = {c: (c.replace("_", " ").upper(), *point) for c, point in t.COORDINATES.items()}
    return t.pairs(spark, rows, "city string, cities string, lat double, long double")


def map_cities(spark: SparkSession, folder: str) -> DataFrame:
    exported = roles.role_city_export(quotients(spark, folder), abroad(spark, folder),
                                      role_labels(spark))
    return maps.city_attributes(exported, _place_points(spark))


def map_provinces(spark: SparkSession, folder: str) -> DataFrame:
    exported = roles.role_province_export(t.national_sheet(spark, folder), role_labels(spark))
    names = t.pairs(spark, {p: p.replace("_", " ").upper() for p in t.PROVINCES},
                    "province string, name string")
    return maps.province_attributes(exported, names)


_POINTS = "(VALUES " + ", ".join(f"({quoted(c)}, {lat}::DOUBLE, {lon}::DOUBLE)"
                                 for c, (lat, lon) in t.COORDINATES.items()) + ") p(city, lat, lon)"
_MAP_CITIES = f"""(SELECT city, upper(replace(city, '_', ' ')) AS cities, lat, lon,
    CASE dev_role {_MAP_ROLE} ELSE dev_role END AS dev_role, visitors,
    city_visitors_share AS share, location_quotient AS loc_quo
    FROM exp JOIN {_POINTS} USING (city) WHERE city IN ({", ".join(
        quoted(c) for c in maps.MAP_CITIES)}))"""
_MAP_PROVINCES = f"""(SELECT province, upper(replace(province, '_', ' ')) AS name,
    CASE dev_role {_MAP_ROLE} ELSE dev_role END AS dev_role, parent AS dev_role_parent_group,
    visitors, province_visitors_share AS share, location_quotient AS loc_quo FROM plq)"""
register("map_city_attributes", map_cities, f"SELECT * FROM {_MAP_CITIES}", ["exp"])
register("map_province_attributes", map_provinces, f"SELECT * FROM {_MAP_PROVINCES}", ["plq"])


def _layer_sql(source: str, role: str, metric: str, bins: int, text: str, name: str,
               radius: bool) -> str:
    extra = f", round(pow({metric} / mean * 100, 0.55), 6) AS radius" if radius else ""
    return f"""SELECT * EXCLUDE (low, high, mean, cell, base, step)
        REPLACE (round({metric}, 9) AS {metric}),
        round(least(floor({metric} / step + 1e-10), ceil(high / step - 1e-10) - 1) * step, 9)
          AS bin_low,
        round((least(floor({metric} / step + 1e-10), ceil(high / step - 1e-10) - 1) + 1) * step, 9)
          AS bin_high,
        {name} || ' - {maps.METRIC_LABELS[metric]}: ' || {text} AS label{extra}
        FROM (SELECT *, CASE WHEN 10 * base - cell < 1.5 * (cell - 5 * base) THEN 10 * base
              WHEN 5 * base - cell < 2.75 * (cell - 2 * base) THEN 5 * base
              WHEN 2 * base - cell < 1.5 * (cell - base) THEN 2 * base ELSE base END AS step
        FROM (SELECT *, pow(10.0, floor(log10(cell))) AS base
        FROM (SELECT *, (high - low) / {bins} AS cell
        FROM (SELECT *, CAST(min({metric}) OVER () AS DOUBLE) AS low,
              CAST(max({metric}) OVER () AS DOUBLE) AS high, avg({metric}) OVER () AS mean
              FROM {source} WHERE dev_role = {quoted(role)}))))"""


def layer(build, plan, role: str, metric: str, digits: tuple[str, ...]):
    return lambda s, d: rounded(plan(build(s, d), role, metric), metric, *digits).withColumns(
        {"radius": F.round("radius", 6)} if plan is maps.city_layer else {})


register("map_layer_cities_quotient",
         layer(map_cities, maps.city_layer, "Web - Back-End", "loc_quo", ("bin_low", "bin_high")),
         _layer_sql(_MAP_CITIES, "Web - Back-End", "loc_quo", 4,
                    "format('{:.2f}', round_even(loc_quo, 2))", "cities", True), ["exp"])
register("map_layer_cities_visitors",
         lambda s, d: layer(map_cities, maps.city_layer, "All Developers", "visitors",
                            ("bin_low", "bin_high"))(s, d),
         _layer_sql(_MAP_CITIES, "All Developers", "visitors", 4,
                    "format('{:,}', visitors)", "cities", True), ["exp"])
register("map_layer_provinces_share",
         layer(map_provinces, maps.province_layer, "Web - Back-End", "share",
               ("bin_low", "bin_high")),
         _layer_sql(_MAP_PROVINCES, "Web - Back-End", "share", 7,
                    "format('{:.2f}', round_even(share * 100, 2)) || '%'", "name", False), ["plq"])
register("map_single_roles", on(map_cities, maps.single_roles),
         f"""SELECT DISTINCT dev_role FROM {_MAP_CITIES} WHERE dev_role NOT IN ('All Developers',
         'Mobile Developers', 'Web Developers', 'Other Kinds of Developers')""", ["exp"])
register("map_city_features",
         on(map_cities, lambda df: feature_lines(df, ["city", "dev_role", "visitors"])),
         f"""SELECT '{{"type":"Feature","geometry":{{"type":"Point","coordinates":['
         || lon || ',' || lat || ']}},"properties":{{"city":"' || city || '","dev_role":"'
         || dev_role || '","visitors":' || visitors || '}}}}' AS value FROM {_MAP_CITIES}""",
         ["exp"])
