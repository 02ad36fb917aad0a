"""Single operators on the star-schema tables, over whole tables and whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placemetrics.functions.bins import half_open_bin
from placemetrics.functions.semantics import (count_present, divide, first_match, growth, if_known,
                                              matches, money_mean, money_sum, not_in,
                                              recode_by_pattern, share_of_rows, strict_sum,
                                              to_number)
from placemetrics.functions.text import (clean_packed, comma_label, drop_parenthesised, money_label,
                                         percent_label, replace_all, slug, title_case, to_ascii)
from placemetrics.operators.distinct import distinct_counts, member_shares, with_missing_dims
from placemetrics.operators.distribution import median_of_column, medians
from placemetrics.operators.joins import (drop_members, full_join, keep_members,
                                          lookup, recode_by_lookup, scalar)
from placemetrics.operators.measures import (add_share, compare_members, concentration,
                                             count_histogram, growth_between_ends, member_share,
                                             members_per_entity, normalise_salary, share_of_group)
from placemetrics.operators.ranking import add_rank, arrange, keep_maximum, rank_of, top_n
from placemetrics.operators.reshape import (explode_packed, keep_first, pack_coded_options,
                                            pack_options, stack_tables, to_long, to_wide)
from placemetrics.queries import tables as t
from placemetrics.queries.registry import register, rounded, title_sql


def table(name: str):
    return lambda spark, folder: t.read(spark, folder, name)


def nations(spark: SparkSession, folder: str) -> DataFrame:
    nation, region = t.read(spark, folder, "nation"), t.read(spark, folder, "region")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))


def customers(spark: SparkSession, folder: str) -> DataFrame:
    return t.read(spark, folder, "customer").join(
        nations(spark, folder), F.col("c_nationkey") == F.col("n_nationkey"))


# --- reshaping ------------------------------------------------------------------

_MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def unpivot_measures(spark, folder):
    long = to_long(t.read(spark, folder, "lineitem"), "measure", "value", _MEASURES,
                   ids=["l_returnflag"])
    return long.groupBy("l_returnflag", "measure").agg(
        F.count("value").alias("n"), money_sum("value").alias("total"))


register("unpivot_measures", unpivot_measures, """SELECT l_returnflag, measure, count(value) AS n,
    CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total
    FROM (UNPIVOT (SELECT l_returnflag, l_quantity, l_extendedprice, l_discount, l_tax
          FROM lineitem) ON l_quantity, l_extendedprice, l_discount, l_tax
          INTO NAME measure VALUE value) GROUP BY 1, 2""")


def pivot_counts(spark, folder):
    counts = t.read(spark, folder, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"))
    # A status that never occurs still gets its column, filled with NULL.
    return to_wide(counts, ["l_returnflag"], "l_linestatus", "n", ["F", "O", "X"])


register("pivot_counts", pivot_counts, """SELECT l_returnflag,
    nullif(count(*) FILTER (l_linestatus = 'F'), 0) AS "F",
    nullif(count(*) FILTER (l_linestatus = 'O'), 0) AS "O", CAST(NULL AS BIGINT) AS "X"
    FROM lineitem GROUP BY 1""")

register("pack_options",
         lambda s, d: t.read(s, d, "lineitem").select(F.array_join(pack_options({
             "bulk": F.col("l_quantity") > 40, "cheap": F.col("l_extendedprice") < 1000,
             "discounted": F.col("l_discount") > 0.05, "returned": F.col("l_returnflag") == "R",
         }), ";").alias("traits")).groupBy("traits").agg(F.count(F.lit(1)).alias("n")),
         """SELECT CASE WHEN len(l) > 0 THEN array_to_string(l, ';') END AS traits, count(*) AS n
         FROM (SELECT list_filter([CASE WHEN l_quantity > 40 THEN 'bulk' END,
           CASE WHEN l_extendedprice < 1000 THEN 'cheap' END,
           CASE WHEN l_discount > 0.05 THEN 'discounted' END,
           CASE WHEN l_returnflag = 'R' THEN 'returned' END], lambda x: x IS NOT NULL) AS l
         FROM lineitem) GROUP BY 1""")


def pack_coded(spark, folder):
    """Option columns hold codes; a layout table made of the region table names them."""
    coded = customers(spark, folder).select("c_custkey", *[
        F.when((F.col("n_regionkey") == i) | (F.col("c_acctbal") > 2000 * i), "Selected")
        .otherwise("Not selected").alias(f"q29_{i}") for i in range(5)])
    layout = t.read(spark, folder, "region").select(
        F.concat(F.lit("q29_"), F.col("r_regionkey").cast("string")).alias("Variable"),
        F.col("r_name").alias("Label"))
    packed = pack_coded_options(coded, [f"q29_{i}" for i in range(5)], ["Selected"], layout,
                                "Variable", "Label", "regions")
    return packed.select("c_custkey", F.array_join("regions", ";").alias("regions"))


register("pack_coded_options", pack_coded, """SELECT c_custkey, CASE WHEN len(l) > 0
    THEN array_to_string(l, ';') END AS regions FROM (SELECT c_custkey, list_filter([""" + ", ".join(
        f"CASE WHEN n_regionkey = {i} OR c_acctbal > {2000 * i} THEN "
        f"(SELECT r_name FROM region WHERE r_regionkey = {i}) END" for i in range(5))
    + """], lambda x: x IS NOT NULL) AS l FROM customer JOIN nation ON c_nationkey = n_nationkey)""")


def explode_urls(spark, folder):
    """Address parts of pages as members; empty members stay."""
    pages = t.read(spark, folder, "pages").select("page_id", "url")
    members = explode_packed(pages, "url", "part", separator="/")
    return members.groupBy("part").agg(F.count(F.lit(1)).alias("n"),
                                       F.count_distinct("page_id").alias("pages"))


register("explode_packed", explode_urls, """SELECT part, count(*) AS n,
    count(DISTINCT page_id) AS pages
    FROM (SELECT page_id, unnest(string_split(url, '/')) AS part FROM pages) GROUP BY 1""")


def union_missing(spark, folder):
    accounts = stack_tables(
        t.read(spark, folder, "customer").select(
            F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"),
            F.col("c_acctbal").alias("balance")),
        t.read(spark, folder, "supplier").select(
            F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")))
    return accounts.groupBy("segment").agg(F.count(F.lit(1)).alias("accounts"),
                                           money_sum("balance").alias("balance"))


register("union_with_missing_columns", union_missing, """SELECT segment, count(*) AS accounts,
    CAST(sum(CAST(balance AS DECIMAL(18,2))) AS DOUBLE) AS balance FROM (
    SELECT c_name AS name, c_mktsegment AS segment, c_acctbal AS balance FROM customer
    UNION ALL BY NAME SELECT s_name AS name, s_acctbal AS balance FROM supplier) GROUP BY 1""")


def first_by_source(spark, folder):
    """Dearest parts and all parts of one brand; a part in both stays with the dearest."""
    parts = t.read(spark, folder, "part").select("p_partkey", "p_brand", "p_retailprice")
    dearest = top_n(parts, 200, "p_retailprice").withColumns(
        {"source": F.lit(1), "label": F.lit("dearest")})
    brand = parts.filter(F.col("p_brand") == "Brand#3").withColumns(
        {"source": F.lit(2), "label": F.lit("brand")})
    return keep_first(stack_tables(dearest, brand), ["p_partkey"], ["source"]).drop("source")


register("keep_first_by_source", first_by_source, """SELECT p_partkey, p_brand, p_retailprice,
    CASE WHEN rk <= 200 THEN 'dearest' ELSE 'brand' END AS label FROM (SELECT *,
    rank() OVER (ORDER BY p_retailprice DESC) AS rk FROM part)
    WHERE rk <= 200 OR p_brand = 'Brand#3'""")

# --- members --------------------------------------------------------------------


def named_parts(spark, folder):
    return t.read(spark, folder, "part").select(
        "p_partkey", "p_brand", F.split("p_name", " ", -1).alias("words"))


register("member_share_of_entities",
         lambda s, d: member_share(named_parts(s, d), "words", into="word", entity_total=scalar(
             named_parts(s, d), F.count_distinct("p_partkey")), count="parts",
             share="parts_share"),
         """SELECT word, count(*) AS parts, count(*) / (SELECT count(DISTINCT p_partkey) FROM part)
         AS parts_share FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part)
         GROUP BY 1""")


def member_share_by_brand(spark, folder):
    return member_share(named_parts(spark, folder), "words", by=["p_brand"], into="word",
                        count="parts", share="parts_share", total="total")


register("member_share_by_group", member_share_by_brand,
         """SELECT word, p_brand, parts, total, parts / total AS parts_share
         FROM (SELECT word, p_brand, count(*) AS parts FROM (
           SELECT unnest(string_split(p_name, ' ')) AS word, p_brand FROM part) GROUP BY 1, 2)
         JOIN (SELECT p_brand, count(*) AS total FROM part GROUP BY 1) USING (p_brand)""")


def priorities_per_customer(spark, folder):
    kinds = t.read(spark, folder, "orders").select("o_custkey", "o_orderpriority").distinct()
    return members_per_entity(kinds, ["o_custkey"], "n_priorities")


_PRIORITIES = """(SELECT o_custkey, count(DISTINCT o_orderpriority) AS n_priorities FROM orders
    GROUP BY 1)"""
register("members_per_entity_histogram",
         lambda s, d: count_histogram(priorities_per_customer(s, d), "n_priorities", "customers",
                                      "customers_share"),
         f"""SELECT n_priorities, count(*) AS customers, count(*) / sum(count(*)) OVER ()
         AS customers_share FROM {_PRIORITIES} GROUP BY 1""")
register("members_at_least_k",
         lambda s, d: priorities_per_customer(s, d).agg(
             share_of_rows(F.col("n_priorities") >= 4).alias("customers_share")),
         f"""SELECT CAST(count(*) FILTER (n_priorities >= 4) AS DOUBLE) / count(*)
         AS customers_share FROM {_PRIORITIES}""")
register("any_match_per_entity",
         lambda s, d: t.read(s, d, "events").groupBy("user_id").agg(
             F.bool_or(matches("props", '"k": 9', ignore_case=True)
                       & matches("event_type", "ERR", ignore_case=True)).alias("any_error")),
         """SELECT user_id, bool_or(regexp_matches(props, '(?i)"k": 9')
         AND regexp_matches(event_type, '(?i)ERR')) AS any_error FROM events GROUP BY 1""")
register("ordered_string_aggregate",
         lambda s, d: t.read(s, d, "events").groupBy("user_id").agg(F.array_join(F.sort_array(
             F.collect_set("event_type")), ";").alias("event_types")),
         """SELECT user_id, string_agg(event_type, ';' ORDER BY event_type) AS event_types
         FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY 1""")

# --- shares and ranks -------------------------------------------------------------

register("weighted_concentration",
         lambda s, d: concentration(
             t.read(s, d, "supplier").groupBy(F.col("s_nationkey").alias("nation"))
             .agg(F.count(F.lit(1)).alias("suppliers")).join(
                 t.read(s, d, "customer").groupBy(F.col("c_nationkey").alias("nation"))
                 .agg(F.count(F.lit(1)).alias("customers")), "nation"),
             "suppliers", "customers", "ratio", "suppliers_share", "customers_share"),
         """SELECT *, suppliers_share / customers_share AS ratio FROM (SELECT *,
         suppliers / sum(suppliers) OVER () AS suppliers_share,
         customers / sum(customers) OVER () AS customers_share
         FROM (SELECT s_nationkey AS nation, count(*) AS suppliers FROM supplier GROUP BY 1)
         JOIN (SELECT c_nationkey AS nation, count(*) AS customers FROM customer GROUP BY 1)
         USING (nation))""")


def share_cross_tab(spark, folder):
    rows = t.answers(spark, folder)
    return share_of_group(rows, ["r_name", "o_orderstatus", "o_orderpriority"], ["r_name"],
                          "orders", "orders_share")


register("share_cross_tab", share_cross_tab, """SELECT r_name, o_orderstatus, o_orderpriority,
    count(*) AS orders, count(*) / sum(count(*)) OVER (PARTITION BY r_name) AS orders_share
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, 3""")


def orders_per_customer(spark, folder):
    counts = t.read(spark, folder, "orders").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("orders"), money_sum("o_totalprice").alias("spent"))
    named = counts.join(t.read(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return named.select("c_custkey", "c_nationkey", "orders", "spent")


_PER_CUSTOMER = """(SELECT c_custkey, c_nationkey, count(*) AS orders,
    CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS spent
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"""
register("share_with_many_members",
         lambda s, d: add_share(orders_per_customer(s, d).drop("spent"), "orders", "orders_share",
                                ["c_nationkey"], members="many"),
         f"""SELECT c_custkey, c_nationkey, orders, orders / sum(orders) OVER (
         PARTITION BY c_nationkey) AS orders_share FROM {_PER_CUSTOMER}""")
register("rank_with_many_members",
         lambda s, d: add_rank(orders_per_customer(s, d).drop("spent"), "orders", "average_rank",
                               ["c_nationkey"], members="many"),
         f"""SELECT c_custkey, c_nationkey, orders, rank() OVER (
         PARTITION BY c_nationkey ORDER BY orders DESC) + (count(*) OVER (
           PARTITION BY c_nationkey, orders) - 1) / 2 AS average_rank FROM {_PER_CUSTOMER}""")
register("rank_over_whole_table",
         lambda s, d: add_rank(orders_per_customer(s, d).drop("spent"), "orders", "min_rank",
                               ties="min", members="many"),
         f"""SELECT c_custkey, c_nationkey, orders,
         CAST(rank() OVER (ORDER BY orders DESC) AS INTEGER) AS min_rank FROM {_PER_CUSTOMER}""")
register("top_n_per_group_with_ties",
         lambda s, d: top_n(orders_per_customer(s, d).drop("spent"), 3, "orders", ["c_nationkey"]),
         f"""SELECT c_custkey, c_nationkey, orders FROM {_PER_CUSTOMER}
         QUALIFY rank() OVER (PARTITION BY c_nationkey ORDER BY orders DESC) <= 3""")
register("bottom_n_with_ties",
         lambda s, d: top_n(orders_per_customer(s, d).drop("spent"), 5, "orders", smallest=True),
         f"""SELECT c_custkey, c_nationkey, orders FROM {_PER_CUSTOMER}
         QUALIFY rank() OVER (ORDER BY orders) <= 5""")
register("rank_of_one_member",
         lambda s, d: rank_of(orders_per_customer(s, d), "spent", F.col("c_custkey") == 5),
         f"""SELECT * FROM (SELECT *, CAST(rank() OVER (ORDER BY spent DESC) AS INTEGER) AS rank
         FROM {_PER_CUSTOMER}) WHERE c_custkey = 5""")
register("average_rank",
         lambda s, d: add_rank(t.read(s, d, "supplier").groupBy("s_nationkey").agg(
             F.count(F.lit(1)).alias("suppliers")), "suppliers", "rank"),
         """SELECT *, rank() OVER (ORDER BY suppliers DESC) + (count(*) OVER (
         PARTITION BY suppliers) - 1) / 2 AS rank FROM (SELECT s_nationkey,
         count(*) AS suppliers FROM supplier GROUP BY 1)""")
register("keep_maximum",
         lambda s, d: keep_maximum(orders_per_customer(s, d).drop("spent"), "orders",
                                   members="many"),
         f"""SELECT c_custkey, c_nationkey, orders FROM {_PER_CUSTOMER}
         QUALIFY orders = max(orders) OVER ()""")

# --- aggregates -------------------------------------------------------------------

register("medians_per_group",
         lambda s, d: rounded(medians(t.read(s, d, "lineitem"), {
             "price": "l_extendedprice", "quantity": "l_quantity"}, ["l_returnflag"]),
             "price", "quantity", digits=6),
         """SELECT l_returnflag, round(median(l_extendedprice), 6) AS price,
         round(median(l_quantity), 6) AS quantity FROM lineitem GROUP BY 1""")
register("median_of_column",
         lambda s, d: rounded(medians(t.read(s, d, "orders"), {"median_price": "o_totalprice"}),
                              "median_price", digits=6),
         "SELECT round(median(o_totalprice), 6) AS median_price FROM orders")


def nullable_prices(spark, folder):
    return t.answers(spark, folder).select("n_name", "o_orderstatus", F.when(
        (F.col("o_totalprice") >= 1500) | (F.col("r_name") != "ASIA"),
        F.col("o_totalprice").cast("decimal(18,2)")).alias("price"))


register("strict_and_lenient_sum",
         lambda s, d: nullable_prices(s, d).groupBy("n_name").agg(
             strict_sum("price").cast("double").alias("strict"),
             F.sum("price").cast("double").alias("lenient"),
             count_present("price").alias("present"), money_mean("price").alias("mean")),
         """SELECT n_name, CASE WHEN count(price) = count(*) THEN CAST(sum(price) AS DOUBLE) END
         AS strict, CAST(sum(price) AS DOUBLE) AS lenient, count(price) AS present,
         CAST(sum(price) AS DOUBLE) / count(price) AS mean FROM (SELECT n_name,
         CASE WHEN o_totalprice >= 1500 OR r_name <> 'ASIA'
              THEN CAST(o_totalprice AS DECIMAL(18,2)) END AS price
         FROM orders JOIN customer ON o_custkey = c_custkey
         JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
         GROUP BY 1""")
register("summed_columns",
         lambda s, d: t.read(s, d, "lineitem").groupBy("l_linestatus").agg(
             *[money_sum(c).alias(c) for c in _MEASURES]),
         "SELECT l_linestatus, " + ", ".join(
             f"CAST(sum(CAST({c} AS DECIMAL(18,2))) AS DOUBLE) AS {c}" for c in _MEASURES)
         + " FROM lineitem GROUP BY 1")
register("growth_between_ends",
         lambda s, d: growth_between_ends(
             t.answers(s, d).groupBy("n_name", F.year("o_orderdate").alias("year")).agg(
                 F.count(F.lit(1)).alias("orders")), "orders", ["n_name"], "year", "growth"),
         """SELECT n_name, arg_max(orders, year) / arg_min(orders, year) - 1 AS growth FROM (
         SELECT n_name, year(o_orderdate) AS year, count(*) AS orders FROM orders
         JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
         GROUP BY 1, 2) GROUP BY 1""")


def segments_of_two_regions(spark, folder):
    shares = share_of_group(customers(spark, folder), ["r_name", "c_mktsegment"], ["r_name"],
                            "customers", "share")
    return rounded(compare_members(shares, ["c_mktsegment"], "r_name", "share", "ASIA", "EUROPE",
                                   {"ASIA": "asia", "EUROPE": "europe"}),
                   "pc_diff", "pp_diff")


register("compare_two_members", segments_of_two_regions, """SELECT c_mktsegment, asia, europe,
    asia / europe AS ratio, round(asia / europe - 1, 9) AS pc_diff,
    round(asia - europe, 9) AS pp_diff FROM (
    SELECT c_mktsegment, max(share) FILTER (r_name = 'ASIA') AS asia,
    max(share) FILTER (r_name = 'EUROPE') AS europe FROM (SELECT r_name, c_mktsegment,
      count(*) / sum(count(*)) OVER (PARTITION BY r_name) AS share FROM customer
      JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
      GROUP BY 1, 2) GROUP BY 1)""")
register("growth_without_base",
         lambda s, d: t.read(s, d, "events").groupBy("user_id").agg(
             growth(F.count_if(F.col("event_type") == "purchase"),
                    F.count_if((F.col("event_type") == "signup") & (F.col("value") > 15)))
             .alias("growth")),
         """SELECT user_id, count(*) FILTER (event_type = 'purchase') / nullif(count(*) FILTER (
         event_type = 'signup' AND value > 15), 0) - 1 AS growth FROM events GROUP BY 1""")

# --- joins ------------------------------------------------------------------------

_CORRECTIONS = {"nation_1": "first land", "nation_2": "second land", "nation_99": "no land"}
register("correction_lookup",
         lambda s, d: recode_by_lookup(
             customers(s, d).select("c_custkey", F.lower("n_name").alias("country")),
             t.pairs(s, _CORRECTIONS, "old string, new string"), "country", "old", "new"),
         """SELECT c_custkey, CASE n_name WHEN 'NATION_1' THEN 'first land'
         WHEN 'NATION_2' THEN 'second land' ELSE lower(n_name) END AS country
         FROM customer JOIN nation ON c_nationkey = n_nationkey""")


def currency_by_rate(spark, folder):
    """Some countries have no rate, and neither have some of their respondents."""
    rows = customers(spark, folder).select(
        "c_custkey", "n_name", F.when(F.col("c_acctbal") > 0, F.lit(1.5)).alias("rate"))
    rates = nations(spark, folder).select(
        "n_name", F.when(F.col("n_regionkey") > 1, F.lit(1.5)).alias("rate"),
        F.lower(F.substring("r_name", 1, 3)).alias("code"))
    return lookup(rows, rates, ["n_name", "rate"])


register("null_safe_two_key_join", currency_by_rate, """SELECT c_custkey, c.n_name, c.rate, code
    FROM (SELECT c_custkey, n_name, CASE WHEN c_acctbal > 0 THEN 1.5::DOUBLE END AS rate
          FROM customer JOIN nation ON c_nationkey = n_nationkey) c
    LEFT JOIN (SELECT n_name, CASE WHEN n_regionkey > 1 THEN 1.5::DOUBLE END AS rate,
          lower(substring(r_name, 1, 3)) AS code FROM nation
          JOIN region ON n_regionkey = r_regionkey) n
    ON c.n_name IS NOT DISTINCT FROM n.n_name AND c.rate IS NOT DISTINCT FROM n.rate""")
register("full_outer_join",
         lambda s, d: full_join(
             t.read(s, d, "customer")
             .groupBy((F.col("c_nationkey") + 1).alias("nation")).agg(F.count(F.lit(1)).alias("customers")),
             t.read(s, d, "supplier")
             .groupBy(F.col("s_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("suppliers")),
             "nation"),
         """SELECT coalesce(c.nation, s.nation) AS nation, customers, suppliers
         FROM (SELECT c_nationkey + 1 AS nation, count(*) AS customers FROM customer GROUP BY 1) c
         FULL JOIN (SELECT s_nationkey AS nation, count(*) AS suppliers FROM supplier GROUP BY 1) s ON c.nation = s.nation""")
register("semi_join",
         lambda s, d: keep_members(t.read(s, d, "documents").select("doc_id", "lang", "source"),
                                   t.read(s, d, "labels"), ["doc_id"]),
         "SELECT doc_id, lang, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
register("anti_join",
         lambda s, d: drop_members(t.read(s, d, "documents").select("doc_id", "lang", "source"),
                                   t.read(s, d, "labels"), ["doc_id"]),
         """SELECT doc_id, lang, source FROM documents
         WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")


def not_in_keeps_missing(spark, folder):
    rows = t.read(spark, folder, "orders").select(F.when(
        F.col("o_totalprice") > 100000, F.col("o_orderstatus")).alias("status"))
    return rows.filter(not_in("status", ["F"])).groupBy("status").agg(
        F.count(F.lit(1)).alias("orders"))


register("not_in_keeps_missing", not_in_keeps_missing, """SELECT status, count(*) AS orders
    FROM (SELECT CASE WHEN o_totalprice > 100000 THEN o_orderstatus END AS status FROM orders)
    WHERE status IS NULL OR status <> 'F' GROUP BY 1""")

# --- scalar functions -------------------------------------------------------------

register("coalesce_cascade",
         lambda s, d: t.answers(s, d).select("o_orderkey", F.coalesce(
             F.when(F.col("o_orderstatus") == "F", F.lower("o_orderstatus")),
             if_known(F.col("c_acctbal") > 5000, F.lower("c_mktsegment"), F.lit(None).cast("string")),
             F.when(F.length("o_orderpriority") == 5, F.col("o_orderpriority"))).alias("code")),
         """SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus = 'F' THEN lower(o_orderstatus) END,
         CASE WHEN c_acctbal > 5000 THEN lower(c_mktsegment) END,
         CASE WHEN length(o_orderpriority) = 5 THEN o_orderpriority END) AS code
         FROM orders JOIN customer ON o_custkey = c_custkey""")
register("normalise_salary",
         lambda s, d: normalise_salary(t.respondents(s, d).select(
             "respondent_id", "salary_usd", "local_currency_per_usd",
             "local_currency_per_intl_dollar", "country_currency_code", "local_currency_code"))
         .select("respondent_id", "salary_cad", "salary_local_currency", "salary_intl_dollar"),
         """SELECT respondent_id, salary_cad, salary_local AS salary_local_currency,
         salary_intl AS salary_intl_dollar FROM r""", ["r"])
register("parse_experience",
         lambda s, d: t.respondents(s, d).groupBy(
             "pro_experience", "pro_experience_low_year", "pro_experience_high_year",
             "pro_experience_mid_year", "pro_experience_bin", "pro_experience_bin_above_15").agg(
                 F.count(F.lit(1)).alias("respondents")),
         """SELECT pro_experience, low_year AS pro_experience_low_year,
         high_year AS pro_experience_high_year, mid_year AS pro_experience_mid_year,
         bin AS pro_experience_bin, above_15 AS pro_experience_bin_above_15,
         count(*) AS respondents FROM r GROUP BY ALL""", ["r"])
register("half_open_bins",
         lambda s, d: t.read(s, d, "lineitem").groupBy(half_open_bin(
             F.when(F.col("l_discount") > 0.0, F.col("l_quantity")), [0, 10, 20, 30, 40],
             ["Under 10", "10 to 20", "20 to 30", "30 to 40"]).alias("bin")).agg(
                 F.count(F.lit(1)).alias("lines")),
         """SELECT CASE WHEN l_discount > 0 THEN CASE WHEN l_quantity < 0 THEN NULL
         WHEN l_quantity < 10 THEN 'Under 10' WHEN l_quantity < 20 THEN '10 to 20'
         WHEN l_quantity < 30 THEN '20 to 30' WHEN l_quantity < 40 THEN '30 to 40' END END AS bin,
         count(*) AS lines FROM lineitem GROUP BY 1""")
register("parse_leading_number",
         lambda s, d: t.read(s, d, "orders").select(
             to_number(first_match("o_orderpriority", r"^\d+")).alias("level"),
             to_number(F.substring("o_orderpriority", 3, 20)).alias("no_number"),
             first_match("o_orderpriority", r"^[A-Z]+").alias("no_match")).groupBy(
                 "level", "no_number", "no_match").agg(F.count(F.lit(1)).alias("orders")),
         """SELECT TRY_CAST(regexp_extract(o_orderpriority, '^[0-9]+') AS DOUBLE) AS level,
         CAST(NULL AS DOUBLE) AS no_number, CAST(NULL AS VARCHAR) AS no_match, count(*) AS orders
         FROM orders GROUP BY 1""")
register("canonical_labels",
         lambda s, d: t.read(s, d, "part").select("p_partkey", replace_all("p_name", [
             ("b.*t", "bolt - nut"), ("-", " - "), (" g.*", ""), ("small", "s")])
             .alias("name")),
         """SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(regexp_replace(
         p_name, 'b.*t', 'bolt - nut', 'g'), '-', ' - ', 'g'), ' g.*', '', 'g'), 'small', 's', 'g')
         AS name FROM part""")
register("clean_packed_list",
         lambda s, d: t.read(s, d, "documents").select("doc_id", F.md5(clean_packed(
             F.regexp_replace("text", " ", ";"), "(?:the|an)")).alias("cleaned")),
         """SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(
         replace(text, ' ', ';'), '(?:the|an)', '', 'g'), '^;|;$', '', 'g'), ';+', ';', 'g'))
         AS cleaned FROM documents""")
register("fold_to_ascii",
         lambda s, d: t.read(s, d, "documents").select("doc_id", to_ascii("text").alias("plain")).select(
             "doc_id", F.md5("plain").alias("folded"),
             F.length("plain").cast("bigint").alias("n_chars")),
         """SELECT doc_id, md5(a) AS folded, length(a) AS n_chars FROM (SELECT doc_id,
         replace(replace(replace(strip_accents(text), 'ß', 'ss'), 'œ', 'oe'), 'æ', 'ae') AS a
         FROM documents)""")
register("title_case",
         lambda s, d: stack_tables(
             t.read(s, d, "part").select(F.col("p_name").alias("text")),
             t.read(s, d, "orders").select(F.lower("o_orderpriority").alias("text")),
             t.read(s, d, "benchmark").select("text")).groupBy("text").agg(
                 F.count(F.lit(1)).alias("n")).withColumn("title", title_case("text")),
         f"""SELECT text, count(*) AS n, {title_sql('text')} AS title FROM (
         SELECT p_name AS text FROM part UNION ALL SELECT lower(o_orderpriority) FROM orders
         UNION ALL SELECT text FROM benchmark) GROUP BY 1""")
register("text_helpers",
         lambda s, d: t.read(s, d, "supplier").select(
             "s_suppkey", slug(F.concat_ws(" ", "s_name", F.lit("Inc"))).alias("slug"),
             drop_parenthesised(F.concat("s_name", F.lit(" (retired)"))).alias("name"),
             F.length("s_name").alias("letters"),
             recode_by_pattern("s_name", [("[05]$", "round"), ("9$", "last")], F.lit("other"))
             .alias("ending")),
         """SELECT s_suppkey, lower(replace(s_name || ' Inc', ' ', '_')) AS slug, s_name AS name,
         CAST(length(s_name) AS INTEGER) AS letters, CASE WHEN regexp_matches(s_name, '[05]$')
         THEN 'round' WHEN regexp_matches(s_name, '9$') THEN 'last' ELSE 'other' END AS ending
         FROM supplier""")
register("number_labels",
         lambda s, d: t.read(s, d, "customer").select(
             "c_custkey", comma_label("c_acctbal", 0).alias("whole"),
             money_label("c_acctbal").alias("money"),
             percent_label(divide("c_nationkey", F.lit(8)), 1).alias("percent")),
         """SELECT c_custkey, format('{:,}', CAST(round_even(c_acctbal, 0) AS BIGINT)) AS whole,
         'C$' || format('{:,}', CAST(round_even(c_acctbal, 0) AS BIGINT)) AS money,
         format('{:.1f}', round_even(c_nationkey / 8 * 100, 1)) || '%' AS percent FROM customer""")
register("sorted_missing_last",
         lambda s, d: arrange(t.read(s, d, "orders").groupBy(F.when(
             F.col("o_totalprice") > 250000, F.col("o_orderpriority")).alias("priority")).agg(
                 F.count(F.lit(1)).alias("orders")), "-priority"),
         """SELECT CASE WHEN o_totalprice > 250000 THEN o_orderpriority END AS priority,
         count(*) AS orders FROM orders GROUP BY 1""")


def shares_by_bucket(spark, folder):
    counts = t.read(spark, folder, "orders").groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("orders"))
    shares = add_share(counts, "orders", "orders_share")
    bucket = recode_by_pattern("o_orderpriority", [("URGENT|HIGH", "soon"), ("LOW", "late")],
                               F.lit("any time"))
    return rounded(shares.groupBy(bucket.alias("bucket")).agg(
        F.sum("orders_share").alias("orders_share")), "orders_share")


register("merged_labels", shares_by_bucket, """SELECT CASE
    WHEN regexp_matches(o_orderpriority, 'URGENT|HIGH') THEN 'soon'
    WHEN o_orderpriority LIKE '%LOW%' THEN 'late' ELSE 'any time' END AS bucket,
    round(count(*) / (SELECT count(*) FROM orders), 9) AS orders_share FROM orders GROUP BY 1""")

# --- distinct entities of several groupings from one pass --------------------------

def _yearly_orders(spark, folder):
    return t.read(spark, folder, "orders").select(
        "o_custkey", F.year("o_orderdate").alias("year"), "o_orderpriority",
        F.when(F.col("o_totalprice") > 100000, F.array_compact(F.array(
            F.col("o_orderstatus"), F.when(F.col("o_totalprice") > 300000, F.lit("large")))))
        .alias("kinds"))


def customers_by_groupings(spark, folder):
    groupings = [[], ["year"], ["o_orderpriority"], ["year", "o_orderpriority"]]
    return with_missing_dims(distinct_counts(
        _yearly_orders(spark, folder), "o_custkey", groupings, "customers"), ["year", "o_orderpriority"])


register("customers_by_groupings", customers_by_groupings,
         """SELECT CAST(year(o_orderdate) AS INTEGER) AS year, o_orderpriority,
         CAST(CASE grouping(year(o_orderdate)) * 2 + grouping(o_orderpriority)
           WHEN 3 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END AS INTEGER) AS level,
         count(DISTINCT o_custkey) AS customers FROM orders GROUP BY CUBE (year(o_orderdate), o_orderpriority)""")


def kinds_of_customers(spark, folder):
    groupings = [[], ["year"], ["o_orderpriority"]]
    return with_missing_dims(member_shares(
        _yearly_orders(spark, folder), "o_custkey", "kinds", groupings, "kind", "customers",
        "customers_share", "total_customers"), ["year", "o_orderpriority"])


_KINDS = """SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS year, o_orderpriority,
    unnest(list_filter([o_orderstatus, CASE WHEN o_totalprice > 300000 THEN 'large' END],
      lambda x: x IS NOT NULL)) AS kind FROM orders WHERE o_totalprice > 100000"""
register("kinds_of_customers", kinds_of_customers, f"WITH k AS ({_KINDS}) " + " UNION ALL ".join(
    f"""SELECT c.*, total_customers, customers / total_customers AS customers_share FROM
    (SELECT {year} AS year, {priority} AS o_orderpriority, kind, CAST({level} AS INTEGER) AS level,
      count(DISTINCT o_custkey) AS customers FROM k GROUP BY ALL) c
    JOIN (SELECT {year} AS year, {priority} AS o_orderpriority, count(DISTINCT o_custkey) AS total_customers
      FROM k GROUP BY ALL) n ON c.year IS NOT DISTINCT FROM n.year
      AND c.o_orderpriority IS NOT DISTINCT FROM n.o_orderpriority"""
    for level, (year, priority) in enumerate([
        ("CAST(NULL AS INTEGER)", "CAST(NULL AS VARCHAR)"), ("year", "CAST(NULL AS VARCHAR)"),
        ("CAST(NULL AS INTEGER)", "o_orderpriority")])))
