"""Attributes, points and layers of the role map."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame

from placemetrics.functions.semantics import is_in, not_in, recode
from placemetrics.functions.text import comma_label, percent_label, title_case
from placemetrics.operators.joins import lookup
from placemetrics.operators.measures import map_layer
from placemetrics.operators.ranking import arrange

# Short role names on the map.
MAP_ROLE_NAMES = {
    "Ios Developers": "Mobile - iOS",
    "iOS Developers": "Mobile - iOS",
    "Android Developers": "Mobile - Android",
    "Desktop Developers": "Desktop",
    "Embedded Developers": "Embedded",
    "all Developers": "All Developers",
    "Web Developers (Front-End, Back-End, or Full-Stack)": "Web Developers",
    "Front-End Web Developers": "Web - Front-End",
    "Back-End Web Developers": "Web - Back-End",
    "Full-Stack Web Developers": "Web - Full Stack",
}

# Roles and cities the map leaves out or shows.
ROLES_LEFT_OUT = ["Business Intelligence Developers", "Highly Technical Designers",
                  "Highly Technical Product Managers", "Quality Assurance Engineers"]
MAP_CITIES = ["calgary", "edmonton", "guelph", "halifax", "hamilton", "kitchener_waterloo",
              "london", "montreal", "ottawa", "quebec city", "regina", "saskatoon", "toronto",
              "vancouver", "victoria", "winnipeg", "nyc_metro_area", "sf_silicon_valley"]

# Role groups listed before the single roles.
ROLE_GROUPS = ["All Developers", "Mobile Developers", "Web Developers",
               "Other Kinds of Developers"]

# Metrics a layer can show, with the visitors' label given by the caller.
METRIC_LABELS = {
    "visitors": "Visitors",
    "share": "Share of local visitors in role",
    "loc_quo": "Location quotient",
}
CITY_BINS = 4
PROVINCE_BINS = 7


def map_role(column: Column | str) -> Column:
    return recode(title_case(column), MAP_ROLE_NAMES)


def province_attributes(roles: DataFrame, names: DataFrame) -> DataFrame:
    """Role rows per province with display names; boundaries are joined elsewhere."""
    return (lookup(roles, names, "province", ["name"])
            .withColumnsRenamed({"province_visitors_share": "share",
                                 "location_quotient": "loc_quo"})
            .withColumn("dev_role", map_role("dev_role")))


def city_attributes(roles: DataFrame, places: DataFrame,
                    cities: Sequence[str] = MAP_CITIES) -> DataFrame:
    """Role rows per mapped city with name and coordinates."""
    rows = lookup(roles, places, "city", {"cities": "cities", "lat": "lat", "long": "lon"})
    rows = rows.withColumnsRenamed({"city_visitors_share": "share", "location_quotient": "loc_quo"})
    rows = rows.filter(not_in("dev_role", ROLES_LEFT_OUT) & is_in("city", cities))
    rows = rows.drop("region", "dev_role_parent_group").withColumn("dev_role", map_role("dev_role"))
    return arrange(rows, "dev_role", "city")


def metric_text(metric: str, share_digits: int) -> Column:
    """Visitors whole, shares in percent, quotients with two decimals."""
    return {"visitors": comma_label("visitors", 0), "share": percent_label("share", share_digits),
            "loc_quo": comma_label("loc_quo", 2)}[metric]


def city_layer(cities: DataFrame, role: str, metric: str) -> DataFrame:
    """Markers of one role: cities without the metric are left out."""
    return map_layer(cities, role, metric, METRIC_LABELS[metric], "cities",
                     metric_text(metric, 1), CITY_BINS)


def province_layer(provinces: DataFrame, role: str, metric: str) -> DataFrame:
    """Areas of one role: every province stays, also without the metric."""
    return map_layer(provinces, role, metric, METRIC_LABELS[metric], "name",
                     metric_text(metric, 2), PROVINCE_BINS, require_metric=False,
                     with_radius=False)


def single_roles(cities: DataFrame) -> DataFrame:
    """Roles to choose from that are not groups."""
    return cities.select("dev_role").distinct().filter(not_in("dev_role", ROLE_GROUPS))
