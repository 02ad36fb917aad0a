"""Survey and traffic tables derived from the star-schema test tables.

The survey files themselves are not public, so each survey question is read off
whole columns of the given tables: an order is a respondent, a customer's nation
the country, a line item a visit, a part type a role and a supplier's nation a
place.  The column expressions are plain SQL text, because the SQL counterparts of
the queries start from the same derived tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placemetrics.functions.semantics import if_known
from placemetrics.operators.measures import normalise_salary, parse_experience
from placemetrics.operators.reshape import pack_options
from placemetrics.plans.places import ALL_ROLES
from placemetrics.plans.survey import HOME, REST_OF_WORLD, region_of
from placemetrics.sources.files import inline_table

FIRST_YEAR_SHIFT = 16

# Answers with one value per respondent.
ANSWERS = {
    "respondent_id": "o_orderkey",
    "year": f"CAST(year(o_orderdate) AS INTEGER) + {FIRST_YEAR_SHIFT}",
    "country": "CASE WHEN c_acctbal < -900 THEN NULL WHEN r_name = 'AMERICA' THEN 'canada' "
               "WHEN n_name = 'NATION_24' THEN 'united states' ELSE lower(n_name) END",
    "is_eu": "r_name = 'EUROPE'",
    "gender": "CASE WHEN o_orderstatus = 'F' THEN 'female' WHEN o_orderstatus = 'O' THEN 'male' "
              "WHEN o_orderpriority = '1-URGENT' THEN 'prefer not to disclose' "
              "WHEN o_orderpriority = '2-HIGH' THEN NULL "
              "ELSE 'transgendered or non-conforming' END",
    "pro_status": "CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY', 'FURNITURE') THEN 'pro dev' "
                  "WHEN c_mktsegment = 'AUTOMOBILE' THEN 'student' WHEN c_acctbal < 0 THEN NULL "
                  "WHEN o_orderstatus = 'F' THEN 'ex-pro dev' "
                  "WHEN o_orderstatus = 'O' THEN 'pro non-dev' ELSE 'pure hobbyist' END",
    "salary_usd": "CASE WHEN o_totalprice >= 50000 THEN o_totalprice END",
    "country_currency_code": "CASE WHEN n_name <> 'NATION_0' THEN lower(substring(r_name, 1, 3)) END",
    "local_currency_code": "CASE WHEN c_acctbal > 9000 THEN NULL WHEN c_acctbal < 500 THEN 'usd' "
                           "ELSE lower(substring(r_name, 1, 3)) END",
    "local_currency_per_usd": "1.0E0 + n_nationkey * 0.25E0",
    "local_currency_per_intl_dollar": "0.5E0 + n_regionkey * 0.125E0",
    "web_dev_role": "CASE WHEN day(o_orderdate) <= 10 THEN 'full stack web developer' "
                    "WHEN day(o_orderdate) <= 18 THEN 'back-end web developer' "
                    "WHEN day(o_orderdate) <= 25 THEN 'front-end web developer' END",
    "company_size": "CASE CAST(floor(o_totalprice / 50000) AS INTEGER) WHEN 0 THEN 'fewer than 10' "
                    "WHEN 1 THEN '10 to 19' WHEN 2 THEN '20 to 99' WHEN 3 THEN '100 to 499' "
                    "WHEN 4 THEN '500 to 999' WHEN 5 THEN '1,000 to 4,999' "
                    "WHEN 6 THEN '5,000 to 9,999' WHEN 7 THEN '10,000 or more' "
                    "WHEN 8 THEN 'i don''t know' ELSE 'i prefer not to answer' END",
    "company_type": "CASE WHEN day(o_orderdate) <= 4 THEN 'publicly-traded corporation' "
                    "WHEN day(o_orderdate) <= 9 THEN 'privately-held limited company' "
                    "WHEN day(o_orderdate) <= 13 THEN 'venture-funded startup' "
                    "WHEN day(o_orderdate) <= 17 THEN 'government agency or public school' "
                    "WHEN day(o_orderdate) <= 21 THEN 'non-profit or private school' "
                    "WHEN day(o_orderdate) <= 24 THEN 'sole proprietorship or partnership' "
                    "WHEN day(o_orderdate) <= 27 THEN 'something else: ' "
                    "WHEN day(o_orderdate) <= 29 THEN 'i don''t know' END",
    "industry_original": "CASE month(o_orderdate) WHEN 1 THEN 'software' "
                         "WHEN 2 THEN 'internet or web services' "
                         "WHEN 3 THEN 'finance, banking, or insurance' "
                         "WHEN 4 THEN 'media, advertising, publishing, or entertainment' "
                         "WHEN 5 THEN 'health care services' "
                         "WHEN 6 THEN 'pharmaceuticals and/or medical devices' "
                         "WHEN 7 THEN 'telecommunications' WHEN 8 THEN 'consulting' "
                         "WHEN 9 THEN 'government (including military)' "
                         "WHEN 10 THEN 'other (please specify)' WHEN 11 THEN 'student' END",
    "industry_consolidated": "CASE month(o_orderdate) WHEN 1 THEN 'software' "
                             "WHEN 2 THEN 'internet or web services' WHEN 3 THEN 'finance' "
                             "WHEN 4 THEN 'media and advertising' WHEN 5 THEN 'health care' "
                             "WHEN 6 THEN 'health care' WHEN 7 THEN 'telecommunications' "
                             "WHEN 8 THEN 'consulting' WHEN 9 THEN 'government' "
                             "WHEN 10 THEN 'other' END",
    "employment_status_original":
        "CASE WHEN o_orderpriority = '1-URGENT' THEN 'not employed, but looking for work' "
        "WHEN o_orderpriority = '2-HIGH' "
        "THEN 'independent contractor, freelancer, or self-employed' "
        "WHEN o_orderpriority = '3-MEDIUM' THEN 'employed part-time' "
        "WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'employed full-time' "
        "WHEN o_orderstatus = 'P' THEN 'retired' "
        "WHEN o_orderstatus = 'F' THEN 'not employed, and not looking for work' END",
    "job_seeking_status":
        "CASE WHEN o_totalprice < 150000 THEN 'i am actively looking for a job' "
        "WHEN o_totalprice < 300000 "
        "THEN 'i''m not actively looking, but i am open to new opportunities' "
        "WHEN o_totalprice < 450000 THEN 'i am not interested in new job opportunities' END",
    "job_discovery_channel":
        "CASE month(o_orderdate) WHEN 1 THEN 'a general-purpose job board' "
        "WHEN 2 THEN 'a tech-specific job board' "
        "WHEN 3 THEN 'a friend, family member, or former colleague told me' "
        "WHEN 4 THEN 'i was contacted directly by someone at the company (e.g. recruiter)' "
        "WHEN 5 THEN 'a career fair or on-campus recruiting event' "
        "WHEN 6 THEN 'an external recruiter or headhunter' "
        "WHEN 7 THEN 'i visited the company''s web site' WHEN 8 THEN 'other' "
        "WHEN 9 THEN 'a hackathon or a meetup' END",
    "educ_level_group_label":
        "CASE WHEN c_acctbal < 0 THEN 'High School or Lower' WHEN c_acctbal < 3000 "
        "THEN 'Some College' WHEN c_acctbal < 7000 THEN 'Bachelor''s Degree' "
        "WHEN c_acctbal < 9500 THEN 'Graduate Degree' END",
    "unemployed_time_post_bootcamp":
        "CASE WHEN o_orderpriority <> '5-LOW' THEN NULL "
        "WHEN day(o_orderdate) <= 10 THEN 'i already had a job as a developer' "
        "WHEN day(o_orderdate) <= 20 THEN 'i haven''t gotten a job as a developer yet' "
        "ELSE 'immediately upon graduating' END",
    "pro_experience":
        "CASE WHEN c_acctbal < 0 THEN 'less than a year' WHEN c_acctbal >= 9000 "
        "THEN '20 or more years' WHEN c_acctbal >= 8900 THEN NULL ELSE concat("
        "CAST(CAST(floor(c_acctbal / 450) AS INTEGER) AS STRING), ' to ', "
        "CAST(CAST(floor(c_acctbal / 450) AS INTEGER) + 1 AS STRING), ' years') END",
}

# Multi-select answers: the condition under which a respondent ticked each option.
OPTIONS = {
    "dev_roles": {
        "web developer": "day(o_orderdate) <= 20", "mobile developer": "month(o_orderdate) <= 4",
        "desktop": "o_totalprice > 250000", "dba": "o_orderpriority = '1-URGENT'",
        "sys admin": "o_orderpriority = '2-HIGH'", "embedded": "o_orderstatus = 'F'",
        "dev w/ stats/math": "c_acctbal > 8000"},
    "languages": {
        "javascript": "o_totalprice > 100000", "sql": "o_orderstatus = 'F'",
        "java": "o_orderstatus = 'O'", "python": "day(o_orderdate) >= 12",
        "c#": "o_orderpriority = '3-MEDIUM'", "r": "c_acctbal > 5000",
        "go": "o_totalprice > 400000", "c++": "c_mktsegment = 'MACHINERY'",
        "rust": "year(o_orderdate) >= 1999 AND c_mktsegment = 'BUILDING'"},
    "informal_educ": {
        "Self-taught": "o_totalprice < 200000", "Part-time/evening course": "day(o_orderdate) < 8",
        "Open source contrib": "c_acctbal > 6000",
        "Industry certification": "o_orderpriority = '1-URGENT'"},
    "ethnicities": {
        "White or of European descent": "o_totalprice > 200000",
        "I don't know": "o_orderpriority = '5-LOW'", "East Asian": "day(o_orderdate) < 6",
        "South Asian": "month(o_orderdate) = 3",
        "Native American, Pacific Islander, or Indigenous Australian": "c_acctbal < -500",
        "I prefer not to say": "o_orderpriority = '5-LOW' AND day(o_orderdate) > 15"},
}

# Part types as roles, with the group a role's traffic also counts towards.
ROLES = {
    "STANDARD": ("back-end web", "web developers"),
    "MEDIUM": ("front-end web", "web developers"),
    "PROMO": ("android developers", "mobile developers"),
    "LARGE": ("ios developers", "mobile developers"),
    "SMALL": ("desktop developers", "other kinds of developers"),
    "ECONOMY": ("qa engineers", "other kinds of developers"),
}
ROLE_LABELS = {
    "all developers": "Developer", "mobile developers": "Mobile Developer",
    "android developers": "Android Mobile Developer", "ios developers": "iOS Mobile Developer",
    "web developers": "Web Developer", "back-end web": "Back-End Web Developer",
    "front-end web": "Front-End Web Developer", "desktop developers": "Desktop Developer",
    "other kinds of developers": "Other Developer", "qa engineers": "Quality Assurance Engineer",
}

# Nations as provinces and cities of the national traffic sheet, in sheet order.
PROVINCES = ["alberta", "british_columbia", "manitoba", "new_brunswick",
             "newfoundland_and_labrador", "northwest_territories", "nova_scotia", "nunavut",
             "ontario", "prince_edward_island", "quebec", "saskatchewan", "yukon"]
CITIES = ["calgary", "vancouver_city", "guelph_area", "hamilton_burlington", "london_ontario",
          "montreal", "ottawa", "quebec_city_metro", "toronto_plus_immediate_area",
          "brampton_area", "waterloo_kitchener_cambridge", "victoria_bc"]
TERRITORIES = ["northwest_territories", "nunavut", "yukon"]
CONSOLIDATED_PROVINCES = {
    **{p: p.replace("_", " ") for p in PROVINCES},
    **{p: "atlantic canada" for p in ("new_brunswick", "newfoundland_and_labrador", "nova_scotia",
                                      "prince_edward_island")},
    **{p: "territories" for p in TERRITORIES},
}
CONSOLIDATED_CITIES = {
    "calgary": "calgary", "vancouver_city": None, "guelph_area": "guelph",
    "hamilton_burlington": "hamilton", "london_ontario": "london", "montreal": "montreal",
    "ottawa": "ottawa", "quebec_city_metro": "quebec city",
    "toronto_plus_immediate_area": "toronto", "brampton_area": "toronto",
    "waterloo_kitchener_cambridge": "kitchener_waterloo", "victoria_bc": "victoria",
}
# The statistical agency's names of the same cities; one of them only as a half.
STATISTICAL_CITIES = {
    "calgary": "Calgary, Alberta", "guelph_area": "Guelph, Ontario",
    "hamilton_burlington": "Hamilton, Ontario", "london_ontario": "London, Ontario",
    "montreal": "Montréal, Quebec", "ottawa": "Ottawa-Gatineau, Ontario/Quebec",
    "vancouver_city": "Ottawa-Gatineau, Ontario part, Ontario/Quebec",
    "quebec_city_metro": "Québec, Quebec", "toronto_plus_immediate_area": "Toronto, Ontario",
    "waterloo_kitchener_cambridge": "Kitchener-Cambridge-Waterloo, Ontario",
    "victoria_bc": "Victoria, British Columbia",
}
STATISTICAL_NAMES = {
    "Calgary, Alberta": "calgary", "Guelph, Ontario": "guelph", "Hamilton, Ontario": "hamilton",
    "London, Ontario": "london", "Montréal, Quebec": "montreal",
    "Ottawa-Gatineau, Ontario/Quebec": "ottawa", "Québec, Quebec": "quebec city",
    "Toronto, Ontario": "toronto",
    "Kitchener-Cambridge-Waterloo, Ontario": "kitchener_waterloo",
    "Victoria, British Columbia": "victoria",
}
COORDINATES = {"calgary": (51.0, -114.0), "guelph": (43.5, -80.2), "hamilton": (43.3, -79.9),
               "london": (43.0, -81.2), "montreal": (45.5, -73.6), "ottawa": (45.4, -75.7),
               "quebec city": (46.8, -71.2), "toronto": (43.7, -79.4),
               "kitchener_waterloo": (43.4, -80.5), "victoria": (48.4, -123.4)}

COMPANY_TYPE_LABELS = {
    "publicly-traded corporation": "Publicly-traded corporation",
    "privately-held limited company": "Privately-held limited company",
    "venture-funded startup": "Venture-funded startup", "other": "Other",
    "government agency or public school": "Government agency or public school",
    "non-profit or private school": "Non-profit or private school",
}
LANGUAGE_LABELS = {"javascript": "JavaScript", "sql": "SQL", "java": "Java", "python": "Python",
                   "c#": "C#", "r": "R", "go": "Go", "c++": "C++", "rust": "Rust"}
DEV_ROLE_LABELS = {
    "web developer": "Web Developer (Front-End, Back-End, or Full-Stack)",
    "mobile developer": "Mobile Developer (Android, iOS, etc.)",
    "desktop": "Desktop Applications Developer", "dba": "Database Administrator",
    "sys admin": "Systems Administrator",
    "embedded": "Embedded Applications/Devices Developer",
    "dev w/ stats/math": "Developer with a Statistics or Mathematics Background",
}
INDUSTRY_CONSOLIDATIONS = {
    "internet or web services": "internet or web services",
    "finance, banking, or insurance": "finance",
    "media, advertising, publishing, or entertainment": "media and advertising",
    "health care services": "health care",
    "pharmaceuticals and/or medical devices": "health care",
    "government (including military)": "government", "other (please specify)": "other",
    "student": "n/a",
}


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def pairs(spark: SparkSession, table: dict, columns: str) -> DataFrame:
    """A lookup table from a literal mapping."""
    return inline_table(spark, [(k, *(v if isinstance(v, tuple) else (v,)))
                                for k, v in table.items()], columns)


def from_mapping(column: str, mapping: dict) -> Column:
    literal = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.try_element_at(literal, F.col(column))


def ordered_in(year: int) -> Column:
    """Orders of one calendar year, as a range that reaches the scan (``year(...)`` does not)."""
    start, end = (F.lit(f"{y}-01-01").cast("timestamp") for y in (year, year + 1))
    return (F.col("o_orderdate") >= start) & (F.col("o_orderdate") < end)


def answers(spark: SparkSession, folder: str, year: int | None = None) -> DataFrame:
    """Orders with their customer, nation and region: one row per respondent (of one survey year)."""
    orders, customer = read(spark, folder, "orders"), read(spark, folder, "customer")
    if year is not None:
        orders = orders.filter(ordered_in(year - FIRST_YEAR_SHIFT))
    nation, region = read(spark, folder, "nation"), read(spark, folder, "region")
    places = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    customers = customer.join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))


def _option_list(options: dict[str, str]) -> Column:
    return pack_options([F.expr(f"CASE WHEN {test} THEN '{label.replace(chr(39), chr(39) * 2)}' END")
                         for label, test in options.items()])


def respondents(spark: SparkSession, folder: str, year: int | None = None) -> DataFrame:
    """The harmonised table of respondents, of one survey year if given."""
    df = answers(spark, folder, year).select(
        *[F.expr(sql).alias(name) for name, sql in ANSWERS.items()],
        *[_option_list(options).alias(name) for name, options in OPTIONS.items()])
    df = df.withColumns({
        "region": region_of(F.col("country"), F.col("is_eu")),
        "region_carow_label": if_known(F.col("country") == "canada", F.lit(HOME),
                                       F.lit(REST_OF_WORLD))})
    return normalise_salary(parse_experience(df))


def population(spark: SparkSession, folder: str) -> DataFrame:
    """Customers per country as its inhabitants, under the nation's own name."""
    customers = read(spark, folder, "customer").groupBy("c_nationkey").agg(
        F.count(F.lit(1)).alias("n"))
    named = customers.join(read(spark, folder, "nation"),
                           F.col("c_nationkey") == F.col("n_nationkey"))
    return named.select(F.col("n_name").alias("country"), F.col("n").alias("population_2016"))


def country_names(spark: SparkSession) -> DataFrame:
    """Two countries go by another name in the population table."""
    return pairs(spark, {"nation_24": "united states", "nation_1": "canada"},
                 "country_in_population string, country_in_survey string")


def role_visits(spark: SparkSession, folder: str) -> DataFrame:
    """Visits per role and nation; a visit also counts for its group and for all roles."""
    visits = read(spark, folder, "lineitem").select("l_partkey", "l_suppkey")
    suppliers = read(spark, folder, "supplier").select("s_suppkey", "s_nationkey")
    parts = read(spark, folder, "part").select("p_partkey", "p_type")
    counts = (visits.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
              .join(parts, F.col("l_partkey") == F.col("p_partkey"))
              .groupBy("p_type", "s_nationkey").agg(F.count(F.lit(1)).alias("visitors")))
    def of(place: int) -> Column:
        known = from_mapping("p_type", {k: v[place] for k, v in ROLES.items()})
        return F.coalesce(known, F.raise_error(F.concat(F.lit("no role for part type "), "p_type")))

    role, group = of(0), of(1)
    return (counts.withColumn("dev_role", F.explode(F.array(role, group, F.lit(ALL_ROLES))))
            .groupBy("dev_role", "s_nationkey").agg(F.sum("visitors").alias("visitors")))


def national_sheet(spark: SparkSession, folder: str) -> DataFrame:
    """Roles by provinces, cities and the nation, in wide form."""
    places = [*PROVINCES, *CITIES]
    cells = [F.sum(F.when(F.col("s_nationkey") == i, F.col("visitors"))).alias(place)
             for i, place in enumerate(places)]
    beyond = F.count_if(~F.col("s_nationkey").between(0, len(places) - 1))
    return role_visits(spark, folder).groupBy("dev_role").agg(
        *cells, F.when(beyond > 0, F.raise_error("a nation has no place in the sheet"))
        .otherwise(F.sum("visitors")).alias("canada"))


def international_sheet(spark: SparkSession, folder: str) -> DataFrame:
    """Roles by nations as cities and world regions as countries, in wide form."""
    visits = role_visits(spark, folder).join(
        read(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    # The sheet's columns are the names in the two small dimensions.
    cities = [F.sum(F.when(F.col("n_name") == r["n_name"], F.col("visitors"))).alias(r["n_name"].lower())
              for r in read(spark, folder, "nation").orderBy("n_nationkey").collect()]
    countries = [F.sum(F.when(F.col("n_regionkey") == r["r_regionkey"], F.col("visitors")))
                 .alias(r["r_name"].lower())
                 for r in read(spark, folder, "region").orderBy("r_regionkey").collect()]
    return visits.groupBy("dev_role").agg(*cities, *countries)


def city_countries(spark: SparkSession, folder: str) -> DataFrame:
    nation, region = read(spark, folder, "nation"), read(spark, folder, "region")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.lower("n_name").alias("city"), F.lower("r_name").alias("country"))


def _customer_counts(spark: SparkSession, folder: str) -> DataFrame:
    names = pairs(spark, dict(enumerate([*PROVINCES, *CITIES])), "nation int, place string")
    return read(spark, folder, "customer").join(names, F.col("c_nationkey") == F.col("nation"))


def employment_tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Employment of provinces and of territories, several figures for each."""
    counts = _customer_counts(spark, folder).groupBy("place", "c_mktsegment").agg(
        F.count(F.lit(1)).cast("double").alias("Value"))
    label = F.initcap(F.replace("place", F.lit("_"), F.lit(" ")))
    provinces = counts.filter(F.col("place").isin(PROVINCES) & ~F.col("place").isin(TERRITORIES))
    territories = counts.filter(F.col("place").isin(TERRITORIES))
    return (provinces.select(label.alias("GEOGRAPHY"), "Value"),
            territories.select(label.alias("GEO"), "Value"))


def city_tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Employment and population of cities and of the nation."""
    def table(value: Column) -> DataFrame:
        rows = read(spark, folder, "customer")
        named = _customer_counts(spark, folder).withColumn(
            "GEO", from_mapping("place", STATISTICAL_CITIES))
        cities = named.filter(F.col("GEO").isNotNull()).groupBy("GEO").agg(value.alias("Value"))
        nation = rows.agg(value.alias("Value")).withColumn("GEO", F.lit("Canada"))
        return cities.unionByName(nation)

    return (table(F.count_if(F.col("c_acctbal") > 2000).cast("double")),
            table(F.count(F.lit(1)).cast("double")))


def city_sheet(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers as cities of the world with one column of visits per year.

    The sheet's columns are the years that lie in the data: one small aggregate finds them.
    """
    visits = read(spark, folder, "lineitem").select("l_suppkey", F.year("l_shipdate").alias("y"))
    years = sorted(r["y"] for r in visits.filter("y IS NOT NULL").select("y").distinct().collect())
    visits = visits.groupBy("l_suppkey").agg(*[
        F.count_if(F.col("y") == y).alias(f"Developers{y + FIRST_YEAR_SHIFT}") for y in years])
    named = (visits.join(read(spark, folder, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
             .join(read(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey")))
    toronto = F.col("s_suppkey") == 3
    country = F.when(toronto | (F.col("n_regionkey") == 1), "Canada").otherwise(F.col("n_name"))
    return named.select(
        F.when(toronto, "Toronto").otherwise(F.col("s_name")).alias("CityName"),
        country.alias("CountryName"),
        *[f"Developers{y + FIRST_YEAR_SHIFT}" for y in years])
