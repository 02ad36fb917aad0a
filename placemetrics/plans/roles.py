"""Professional status and developer roles, from the survey and from traffic."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placemetrics.functions.semantics import (divide, matches, not_in, recode, recode_by_pattern,
                                              share_of_rows)
from placemetrics.functions.text import title_case
from placemetrics.operators.joins import join_null_safe, keep_members, lookup, scalar
from placemetrics.operators.measures import (PARENT_ROLES, add_role_parents, location_quotient,
                                             member_share, relative_to, share_of_group)
from placemetrics.operators.ranking import arrange, top_n
from placemetrics.operators.reshape import (select_between, stack_tables, to_long,
                                            with_literal_order)
from placemetrics.plans.common import HOME_COUNTRY, LATEST_YEAR, latest, pro_devs_at_home, row_count
from placemetrics.plans.places import (ALL_ROLES, PROVINCE_RANGE, all_roles_row, city_traffic)

# Labels of the professional statuses.
STATUS_LABELS = {
    "ex-pro dev": "Ex-Professional Developer",
    "pro dev": "Professional Developer",
    "pro non-dev": "Professional Non-Developer",
    "pure hobbyist": "Other",
    "student": "Student",
}

# Role labels broken into two lines, by pattern.
ROLE_LABEL_RULES = [
    ("statistics", "Developer with a Statistics\nor Mathematics Background"),
    ("embedded", "Embedded Applications/\nDevices Developer"),
    ("web developer", "Web Developer (Front-End,\nBack-End, or Full-Stack)"),
    ("mobile developer", "Mobile Developer\n(Android, iOS, etc.)"),
]

# Roles whose traffic figures are not used.
UNUSABLE_ROLES = ["biz intel developers", "highly technical designers",
                  "highly technical product managers", "qa engineers"]

# Order of the single roles in results.
ROLE_ORDER = ["Front-End Web Developer", "Back-End Web Developer", "Full-Stack Web Developer",
              "Android Mobile Developer", "iOS Mobile Developer", "Desktop Developer",
              "Database Administrator", "Systems Administrator", "Embedded Developer",
              "Graphics Programmer", "Data Scientist", "Machine Learning Specialist"]

# Labels of the role groups; all other roles take a plural.
GROUP_LABELS = {
    "all developers": "All Developers",
    "other kinds of developers": "Other Kinds of Developers",
    "web developers": "Web Developers (Front-End, Back-End, or Full-Stack)",
    "mobile developers": "Mobile Developers",
}


def status_shares(respondents: DataFrame, year: int = LATEST_YEAR) -> DataFrame:
    """Shares count every status, missing ones too; only labelled ones are shown."""
    shares = share_of_group(latest(respondents, year=year, country=HOME_COUNTRY), ["pro_status"])
    labelled = shares.withColumn("pro_status_label",
                                 recode("pro_status", STATUS_LABELS, F.lit(None)))
    return labelled.filter(F.col("pro_status_label").isNotNull())


def respondents_with_roles(respondents: DataFrame) -> DataFrame:
    return pro_devs_at_home(respondents, "dev_roles").select("respondent_id", "dev_roles")


def role_shares(respondents: DataFrame) -> DataFrame:
    """Role counts over distinct respondents, not over answers."""
    rows = respondents_with_roles(respondents)
    n = scalar(rows, F.count_distinct("respondent_id"))
    return member_share(rows, "dev_roles", into="dev_role", entity_total=n)


def role_shares_labelled(shares: DataFrame, labels: DataFrame) -> DataFrame:
    joined = lookup(shares, labels, "dev_role", ["dev_role_label"])
    joined = joined.withColumn("dev_role_label", recode_by_pattern(
        "dev_role_label", ROLE_LABEL_RULES, F.col("dev_role_label"), ignore_case=True))
    return arrange(joined, "respondents_share")


def n_with_roles(respondents: DataFrame) -> DataFrame:
    return respondents_with_roles(respondents).agg(
        F.count_distinct("respondent_id").alias("respondents"))


def any_role_share(respondents: DataFrame, pattern: str = "desktop|mobile") -> DataFrame:
    """Share of respondents with at least one role matching a pattern."""
    rows = respondents_with_roles(respondents).filter(F.size("dev_roles") > 0)
    per_person = rows.groupBy("respondent_id").agg(
        F.bool_or(F.exists("dev_roles", lambda role: matches(role, pattern))).alias("has_role"))
    return per_person.agg(share_of_rows(F.col("has_role")).alias("respondents_share"))


def several_roles_share(respondents: DataFrame) -> DataFrame:
    rows = respondents_with_roles(respondents).filter(F.size("dev_roles") > 0)
    per_person = rows.groupBy("respondent_id").agg(F.sum(F.size("dev_roles")).alias("n_dev_roles"))
    return per_person.agg(share_of_rows(F.col("n_dev_roles") > 1).alias("respondents_share"))


def web_roles(respondents: DataFrame) -> DataFrame:
    shares = share_of_group(pro_devs_at_home(respondents, "web_dev_role"), ["web_dev_role"])
    label = title_case(F.regexp_replace("web_dev_role", "full stack", "full-stack"))
    return arrange(shares.withColumn("web_dev_role_label", label), "respondents_share")


def n_web_roles(respondents: DataFrame) -> DataFrame:
    return row_count(pro_devs_at_home(respondents, "web_dev_role"))


def _national(sheet: DataFrame, nation: str) -> DataFrame:
    return sheet.select("dev_role", F.col(nation).alias("national"))


def role_city_quotients(sheet: DataFrame, cities: DataFrame, city_names: DataFrame,
                        role_labels: DataFrame, nation: str = "canada") -> DataFrame:
    """Location quotient of every usable role in every city."""
    cells = city_traffic(sheet.filter(not_in("dev_role", UNUSABLE_ROLES)), city_names)
    totals = cities.select("city_consolidated", F.col("visitors").alias("total"))
    quotients = location_quotient(cells, "city_consolidated", "dev_role", "visitors", totals,
                                  _national(sheet, nation), ALL_ROLES)
    return lookup(quotients, role_labels, "dev_role", ["dev_role_label"])


def top_cities_per_role(quotients: DataFrame, n: int = 5) -> DataFrame:
    single = quotients.filter(F.col("dev_role_label").isin(ROLE_ORDER))
    top = top_n(single, n, "location_quotient", within=["dev_role"])
    top = top.withColumns({
        "city_label": title_case(F.regexp_replace("city_consolidated", "_", "-")),
        "role_ord": with_literal_order("dev_role_label", ROLE_ORDER)})
    return arrange(top, "role_ord", "location_quotient")


def international_quotients(sheet: DataFrame, city_countries: DataFrame) -> DataFrame:
    """City share of a role over the share in the city's own country."""
    long = to_long(sheet, "place", "visitors", ids=["dev_role"])

    def shares(column: str) -> DataFrame:
        places = city_countries.select(F.col(column).alias("place")).distinct()
        rows = relative_to(keep_members(long, places, ["place"]), "visitors",
                           F.col("dev_role") == ALL_ROLES, "visitors_share", within=["place"])
        return rows.withColumnRenamed("place", column)

    city = join_null_safe(shares("city"), city_countries, ["city"], "inner").withColumnsRenamed(
        {"visitors": "visitors_city", "visitors_share": "visitors_share_city"})
    country = shares("country").withColumnsRenamed(
        {"visitors": "visitors_country", "visitors_share": "visitors_share_country"})
    both = join_null_safe(city, country, ["dev_role", "country"], "inner")
    return both.withColumn("location_quotient",
                           divide("visitors_share_city", "visitors_share_country"))


def role_label(role: Column, label: Column) -> Column:
    return F.coalesce(recode(role, GROUP_LABELS, F.lit(None)), F.concat(label, F.lit("s")))


def _with_role_columns(df: DataFrame, parents: Mapping[str, str]) -> DataFrame:
    df = add_role_parents(df, "dev_role", "__parent", parents)
    parent_label = F.when(F.col("__parent") == ALL_ROLES, "All Developers").otherwise(
        title_case("__parent"))
    return df.withColumns({"__label": role_label(F.col("dev_role"), F.col("dev_role_label")),
                           "dev_role_parent_group": parent_label})


def role_city_export(home: DataFrame, abroad: DataFrame, role_labels: DataFrame,
                     parents: Mapping[str, str] = PARENT_ROLES) -> DataFrame:
    """Role by city for home and abroad in one table."""
    abroad = lookup(abroad, role_labels, "dev_role", ["dev_role_label"])
    rows = stack_tables(
        home.withColumnRenamed("city_consolidated", "city").withColumn("region", F.lit("canada")),
        abroad.withColumnsRenamed({"visitors_share_city": "visitors_share",
                                   "visitors_city": "visitors"})
        .withColumn("region", F.lit("international")))
    rows = _with_role_columns(rows, parents).select(
        "city", "region", F.col("__label").alias("dev_role"), "dev_role_parent_group",
        "visitors", F.col("visitors_share").alias("city_visitors_share"), "location_quotient")
    return arrange(rows, "region", "city", "dev_role_parent_group", "dev_role")


def role_province_export(sheet: DataFrame, role_labels: DataFrame,
                         parents: Mapping[str, str] = PARENT_ROLES, nation: str = "canada",
                         columns: Sequence[str] = PROVINCE_RANGE) -> DataFrame:
    """Role by province with shares and location quotients."""
    def long(rows: DataFrame, value: str) -> DataFrame:
        return to_long(select_between(rows, *columns, ids=["dev_role"]), "province", value,
                       ids=["dev_role"])

    cells = long(sheet.filter(not_in("dev_role", UNUSABLE_ROLES)), "visitors")
    totals = long(all_roles_row(sheet), "total").drop("dev_role")
    quotients = location_quotient(cells, "province", "dev_role", "visitors", totals,
                                  _national(sheet, nation), ALL_ROLES)
    quotients = lookup(quotients, role_labels, "dev_role", ["dev_role_label"])
    rows = _with_role_columns(quotients, parents).select(
        "province", F.col("__label").alias("dev_role"), "dev_role_parent_group", "visitors",
        F.col("visitors_share").alias("province_visitors_share"), "location_quotient")
    return arrange(rows, "province", "dev_role_parent_group", "dev_role")
