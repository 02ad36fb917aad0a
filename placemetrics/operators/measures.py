"""Measures over places, members and periods.

A window here always runs over an aggregate that has one row per member of a
dimension (a country, role or industry within a year, say), never over raw rows.
Where members can be as many as the entities themselves, ``members="many"``
replaces the window by an aggregate that is joined back.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placemetrics.functions.bins import half_open_bin, pretty_bin, pretty_step, raw_cell
from placemetrics.functions.semantics import (as_column, divide, first_match, growth, if_known,
                                              is_in, to_number)
from placemetrics.operators.joins import join_null_safe, scalar
from placemetrics.operators.ranking import whole_table

__all__ = [
    "add_share", "share_of_group", "member_share", "members_per_entity", "count_histogram",
    "relative_to", "index_to_base", "growth_on_previous", "growth_between_ends",
    "running_share", "location_quotient", "concentration", "scaled_share", "compare_members",
    "normalise_salary", "parse_experience", "add_role_parents", "map_layer",
    "PARENT_ROLES", "PARENT_ROLES_AS_PUBLISHED",
]


# --- shares -----------------------------------------------------------------

def add_share(df: DataFrame, value: str, into: str, within: Sequence[str] = (),
              members: str = "few") -> DataFrame:
    """``value`` over its total in the group (rule W1), or over the grand total."""
    if members == "few":
        return df.withColumn(into, divide(value, F.sum(value).over(whole_table(*within))))
    if not within:
        return df.withColumn(into, divide(value, scalar(df, F.sum(value))))
    totals = df.groupBy(*within).agg(F.sum(value).alias("__total"))
    return (join_null_safe(df, totals, within, "left")
            .withColumn(into, divide(value, "__total")).drop("__total"))


def share_of_group(df: DataFrame, keys: Sequence[str], within: Sequence[str] = (),
                   count: str = "respondents", share: str = "respondents_share",
                   members: str = "few") -> DataFrame:
    """M-1: rows per key combination and their share of the enclosing group."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(count))
    return add_share(counts, count, share, within, members)


def member_share(df: DataFrame, members: str, by: Sequence[str] = (), into: str | None = None,
                 entities: str = "answered", entity_total: Column | None = None,
                 keep_missing: bool = False, count: str = "respondents",
                 share: str = "respondents_share",
                 total: str = "total_respondents", size: str = "few") -> DataFrame:
    """M-3: how many entities name each member, over a count of entities.

    The denominator counts the entities of the same ``by`` group that have a list
    (``entities="answered"``) or all of them (``"all"``); another one can be given as
    ``entity_total``.  Every entity adds one marker row to its exploded members, so
    members and entities are counted in a single pass over the data.  With
    ``size="many"`` (members as many as the entities) the group's count is joined to
    its members instead of meeting them in one window partition.
    """
    into = into or members
    item = F.transform(members, lambda m: F.struct(F.lit(False).alias("entity"), m.alias("member")))
    nothing = F.array(F.struct(F.lit(False).alias("entity"),
                               F.lit(None).cast("string").alias("member")))
    marker = F.array(F.struct(F.lit(True).alias("entity"),
                              F.lit(None).cast("string").alias("member")))
    items = F.coalesce(item, nothing) if keep_missing else F.coalesce(
        item, F.slice(nothing, 1, 0))
    counted = F.col(members).isNotNull() if entities == "answered" else F.lit(True)
    tagged = F.when(counted, F.concat(marker, items)).otherwise(items)
    counts = (df.select(*by, F.explode(tagged).alias("__i"))
              .groupBy(F.col("__i.member").alias(into), F.col("__i.entity").alias("__entity"), *by)
              .agg(F.count(F.lit(1)).alias(count)))
    if entity_total is not None:
        return counts.filter(~F.col("__entity")).drop("__entity").withColumn(
            share, divide(count, entity_total))
    if size == "many":
        named = counts.filter(~F.col("__entity")).drop("__entity")
        entities_of = counts.filter("__entity").select(*by, F.col(count).alias(total))
        joined = (join_null_safe(named, entities_of, list(by), "left") if by
                  else named.withColumn(total, scalar(entities_of, F.max(total))))
        return joined.withColumn(share, divide(count, total))
    whole = F.max(F.when(F.col("__entity"), F.col(count))).over(whole_table(*by))
    return (counts.withColumn(total, whole).filter(~F.col("__entity")).drop("__entity")
            .withColumn(share, divide(count, total)))


def members_per_entity(df: DataFrame, entity: Sequence[str], into: str) -> DataFrame:
    return df.groupBy(*entity).agg(F.count(F.lit(1)).alias(into))


def count_histogram(df: DataFrame, count: str, entities: str = "respondents",
                    share: str = "respondents_share") -> DataFrame:
    """Second level of a two-level count: entities per count, with their share."""
    return share_of_group(df, [count], (), entities, share)


# --- comparisons ------------------------------------------------------------

def relative_to(df: DataFrame, value: str, is_reference: Column, into: str,
                within: Sequence[str] = ()) -> DataFrame:
    """M-5: ratio to the reference member; NULL where there is none (rule N14)."""
    reference = F.max(F.when(is_reference, F.col(value))).over(whole_table(*within))
    return df.withColumn(into, divide(value, reference))


def index_to_base(df: DataFrame, value: str, member: Sequence[str], period: str,
                  into: str) -> DataFrame:
    """M-6: 100 at the member's own first period (rule N13)."""
    base = F.min_by(value, period).over(Window.partitionBy(*member))
    return df.withColumn(into, divide(value, base) * 100)


def growth_on_previous(df: DataFrame, value: str, member: Sequence[str], period: str,
                       into: str) -> DataFrame:
    """M-7: change on the member's previous present period (rule N12)."""
    previous = F.lag(value).over(Window.partitionBy(*member).orderBy(period))
    return df.withColumn(into, growth(value, previous))


def growth_between_ends(df: DataFrame, value: str, member: Sequence[str], period: str,
                        into: str) -> DataFrame:
    """Change from each member's first to its last period, one row per member."""
    return df.groupBy(*member).agg(
        growth(F.max_by(value, period), F.min_by(value, period)).alias(into))


def running_share(df: DataFrame, value: str, order: str, into: str,
                  within: Sequence[str]) -> DataFrame:
    """Running total of a share along a category order."""
    window = (Window.partitionBy(*within).orderBy(order)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumn(into, F.sum(value).over(window))


def compare_members(df: DataFrame, ids: Sequence[str], key: str, value: str, first: str,
                    second: str, names: Mapping[str, str] | None = None) -> DataFrame:
    """M-8: two members side by side with ratio, relative and point difference."""
    names = names or {}
    a, b = names.get(first, first), names.get(second, second)
    pair = df.groupBy(*ids).agg(F.max(F.when(F.col(key) == first, F.col(value))).alias(a),
                                F.max(F.when(F.col(key) == second, F.col(value))).alias(b))
    return pair.withColumns({"ratio": divide(a, b), "pc_diff": growth(a, b),
                             "pp_diff": F.col(a) - F.col(b)})


# --- concentration ----------------------------------------------------------

def location_quotient(cells: DataFrame, place: str, member: str, value: str,
                      place_totals: DataFrame, national: DataFrame, all_member: str,
                      share: str = "visitors_share") -> DataFrame:
    """M-4: a member's share in a place over its share in the nation.

    ``place_totals`` has (place, ``total``); ``national`` has (member, ``national``).
    The national total is the nation's own figure for ``all_member``, not a sum of
    places, because the places need not cover the nation.
    """
    shares = relative_to(national, "national", F.col(member) == all_member,
                         "national_share").select(member, "national_share")
    joined = join_null_safe(cells, place_totals, [place], "inner")
    joined = join_null_safe(joined, shares, [member], "inner")
    return (joined.withColumn(share, divide(value, "total"))
            .withColumn("location_quotient", divide(share, "national_share")))


def concentration(df: DataFrame, first: str, second: str, into: str,
                  first_share: str, second_share: str) -> DataFrame:
    """M-10: a place's share of one total over its share of another."""
    df = add_share(add_share(df, first, first_share), second, second_share)
    return df.withColumn(into, divide(first_share, second_share))


def scaled_share(df: DataFrame, value: str, national: Column, covered: Column,
                 scaled: str, share: str) -> DataFrame:
    """M-9: places scaled so that the covered places add up to the nation."""
    return (df.withColumn(scaled, F.col(value) * divide(national, covered))
            .withColumn(share, divide(scaled, national)))


# --- respondent-level measures ------------------------------------------------

# Fixed value: Canadian dollars per US dollar.
CAD_PER_USD = 1.32


def normalise_salary(df: DataFrame, cad_per_usd: float = CAD_PER_USD) -> DataFrame:
    """M-13: salary in national, local and purchasing-power units.

    The purchasing-power figure exists only where the salary is in the currency
    of the respondent's own country.
    """
    local = F.col("salary_usd") * F.col("local_currency_per_usd")
    own_currency = F.col("country_currency_code") == F.col("local_currency_code")
    return df.withColumns({
        "salary_cad": F.col("salary_usd") * F.lit(cad_per_usd),
        "salary_local_currency": local,
        "salary_intl_dollar": if_known(
            own_currency, divide(local, "local_currency_per_intl_dollar"),
            F.lit(None).cast("double")),
    })


# Experience bins in years, closed on the left.
EXPERIENCE_EDGES = [0, 5, 10, 15, 20, 25]
EXPERIENCE_BINS = ["Under 5", "5 to 10", "10 to 15", "15 to 20", "Over 20"]
EXPERIENCE_BINS_ABOVE_15 = ["15 to 20", "Over 20"]


def parse_experience(df: DataFrame, column: str = "pro_experience") -> DataFrame:
    """M-14: low, high and middle year, five-year bin and an above-15 flag."""
    text = F.col(column)
    low = if_known(text == "less than a year", F.lit(0.0), to_number(first_match(text, r"^\d+")))
    high = (F.when(text == "less than a year", 1.0).when(text == "20 or more years", 20.0)
            .when(text.isNotNull(), to_number(F.trim(first_match(text, r" \d+")))))
    return (df.withColumns({"pro_experience_low_year": low, "pro_experience_high_year": high})
            .withColumns({
                "pro_experience_mid_year":
                    (F.col("pro_experience_low_year") + F.col("pro_experience_high_year")) / 2,
                "pro_experience_bin":
                    half_open_bin("pro_experience_low_year", EXPERIENCE_EDGES, EXPERIENCE_BINS)})
            .withColumn("pro_experience_bin_above_15",
                        is_in("pro_experience_bin", EXPERIENCE_BINS_ABOVE_15)))


# --- roles --------------------------------------------------------------------

# The group each role belongs to.
PARENT_ROLES = {
    "all developers": "-",
    "mobile developers": "all developers",
    "web developers": "all developers",
    "other kinds of developers": "all developers",
    "android developers": "mobile developers",
    "ios developers": "mobile developers",
    "back-end web": "web developers",
    "front-end web": "web developers",
    "full-stack web": "web developers",
}

# The same as in tables already published, which have the single
# web roles among the other kinds.
PARENT_ROLES_AS_PUBLISHED = {
    role: parent for role, parent in PARENT_ROLES.items() if not role.endswith(" web")
}

PARENT_OF_THE_REST = "other kinds of developers"


def add_role_parents(df: DataFrame, role: str, into: str,
                     parents: Mapping[str, str] = PARENT_ROLES,
                     rest: str = PARENT_OF_THE_REST) -> DataFrame:
    """M-15: the parent group of each role, from a hierarchy given as data."""
    known = F.create_map(*[F.lit(x) for pair in parents.items() for x in pair])
    return df.withColumn(into, F.coalesce(F.try_element_at(known, F.col(role)), F.lit(rest)))


# --- maps -----------------------------------------------------------------------

# Fixed value: exponent that turns relative size into a marker radius.
RADIUS_POWER = 0.55


def map_layer(places: DataFrame, role: str, metric: str, metric_label: str, name: str,
              metric_text: Column, bins: int, require_metric: bool = True,
              with_radius: bool = True) -> DataFrame:
    """M-12: the rows of one role with marker size, colour bin and label.

    Provinces stay without a metric, cities do not (``require_metric``).
    """
    rows = places.filter(F.col("dev_role") == role)
    if require_metric:
        rows = rows.filter(F.col(metric).isNotNull())
    # A layer has one row per place, so its extremes and mean come from a window; each
    # step towards the bin width is worked out once.
    layer = whole_table()
    rows = (rows.withColumns({
        "__low": F.min(metric).over(layer).cast("double"),
        "__high": F.max(metric).over(layer).cast("double"), "__mean": F.avg(metric).over(layer)})
        .withColumn("__cell", raw_cell("__low", "__high", bins))
        .withColumn("__step", pretty_step("__cell")))
    value = F.col(metric).cast("double")
    low_edge, high_edge = pretty_bin(value, "__high", "__step")
    added = {
        "bin_low": low_edge, "bin_high": high_edge,
        "label": F.concat(as_column(name), F.lit(f" - {metric_label}: "),
                          F.coalesce(metric_text, F.lit("NA"))),
    }
    if with_radius:
        added["radius"] = F.pow(divide(value, F.col("__mean")) * 100, F.lit(RADIUS_POWER))
    return rows.withColumns(added).drop("__low", "__high", "__mean", "__cell", "__step")
