"""Operators against brute force and hand-made results, and properties that must hold."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from placemetrics.operators import distribution
from placemetrics.operators import (
    add_position, add_rank, add_share, approximate_medians, drop_members, explode_packed, full_join,
    growth_on_previous, in_ranges, index_to_base, join_null_safe, keep_first, keep_members, location_quotient,
    lookup, map_layer, medians, member_share, numbered, pack_coded_options, pack_options, rank_of,
    running_share, scaled_share, select_between, share_of_group, stack_tables, summarise,
    suppress_small, to_long, to_wide, top_n, total_before, unique_keys, value_positions, with_literal_order)
from placemetrics.storage import written_once


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def numbers(spark):
    """One group holds most rows, many of them equal; one group is tiny; some are missing."""
    source = random.Random(7)
    data = [("hot", float(source.randint(0, 400))) for _ in range(3000)]
    data += [("even", x) for x in (1.0, 2.0, 10.0, 20.0)] + [("one", 5.0)]
    data += [("hot", None)] * 20 + [("none", None)] * 3 + [(None, 4.0), (None, 6.0)]
    return data, spark.createDataFrame(data, "k string, x double").repartition(5)


def test_medians_are_exact(numbers):
    data, df = numbers
    found = {r["k"]: r["m"] for r in medians(df, {"m": "x", "other": F.col("x") * 2},
                                             ["k"]).collect()}
    for key in {k for k, _ in data}:
        values = [x for k, x in data if k == key and x is not None]
        assert found[key] == (statistics.median(values) if values else None)


def test_medians_do_not_depend_on_the_sketch(numbers, monkeypatch):
    """A much coarser sketch only widens the bracket."""
    data, df = numbers
    monkeypatch.setattr(distribution, "ACCURACY", 50)
    values = [x for k, x in data if k == "hot" and x is not None]
    found = {r["k"]: r["m"] for r in medians(df, {"m": "x"}, ["k"]).collect()}
    assert found["hot"] == statistics.median(values) and found["even"] == 6.0


@pytest.mark.parametrize("shift", [-0.2, 0.2])
def test_a_bracket_that_misses_is_widened(numbers, monkeypatch, shift):
    """The first bracket lies beside the middle; the counts show it and a wider one follows."""
    data, df = numbers
    right = distribution._bracket

    def beside(i, width):
        if width >= 0.1:
            return right(i, width)
        cut = f"percentile_approx(__v{i}, array({0.5 + shift - 0.01}D, {0.5 + shift + 0.01}D), 10000)"
        return f"named_struct('n', count(__v{i}), 'low', get({cut}, 0), 'high', get({cut}, 1)) AS __b{i}"

    monkeypatch.setattr(distribution, "_bracket", beside)
    found = {r["k"]: r["m"] for r in medians(df, {"m": "x"}, ["k"]).collect()}
    for key in {k for k, _ in data}:
        values = [x for k, x in data if k == key and x is not None]
        assert found[key] == (statistics.median(values) if values else None)
    values = [x for _, x in data if x is not None]
    assert medians(df, {"m": "x"}).first()["m"] == statistics.median(values)


@pytest.mark.parametrize("shape", ["spread", "ties"])
def test_large_groups_are_cut_until_few_values_are_left(spark, monkeypatch, shape):
    """Two million rows of one group: no window holds more than DISTINCT of its values."""
    monkeypatch.setattr(distribution, "DISTINCT", 70)
    plain, seen = distribution._narrowed, []

    def watched(counts, keys):
        before = counts.groupBy(*keys, "measure").agg(F.count("value").alias("d")).agg(F.max("d")).first()[0]
        out = plain(counts, keys)
        seen.append((before, out.groupBy(*keys, "measure").agg(F.count("value").alias("d")).agg(F.max("d")).first()[0]))
        return out

    monkeypatch.setattr(distribution, "_narrowed", watched)
    value = (F.col("id") * 7919 % 2_000_003).cast("double")
    if shape == "ties":
        value = F.when(F.col("id") % 3 == 0, F.lit(1_000_000.5)).otherwise(value)
    df = spark.range(2_000_000).select(F.lit("hot").alias("k"), value.alias("x")).union(
        spark.range(9).select(F.lit("small"), F.col("id").cast("double")))
    found = {r["k"]: r["m"] for r in medians(df, {"m": "x", "n": -F.col("x")}, ["k"]).collect()}
    values = sorted(r["x"] for r in df.filter("k = 'hot'").select("x").collect())
    assert found == {"hot": (values[999_999] + values[1_000_000]) / 2, "small": 4.0}
    assert all(after <= 70 for _, after in seen)
    assert shape == "ties" or any(before > 70 for before, _ in seen)


@pytest.mark.parametrize("within", [["k"], []])
def test_totals_before_a_row(numbers, within):
    """Ranges of five rows, a group over many of them and many groups in one."""
    data, df = numbers
    counts = written_once(df.groupBy(*(within or ["k"]), "x").agg(F.count(F.lit(1)).alias("n"))
                          if within else df.groupBy("x").agg(F.count(F.lit(1)).alias("n")))
    order = lambda v: (v is not None, v or 0)
    for r in total_before(counts, "n", "b", ["x"], within, rows=5).collect():
        mates = [x for k, x in data if not within or k == r["k"]]
        assert r["b"] == sum(order(x) < order(r["x"]) for x in mates)


def test_positions_of_many_rows(spark):
    """Ties of two thirds of the rows are numbered in ranges, every number once."""
    df = spark.range(3000).select((F.col("id") % 7).alias("t"), F.when(F.col("id") % 3 == 0, F.col("id")).alias("w"))
    few = {r["p"]: (r["w"], r["t"]) for r in add_position(df, "w", "p", ["t"]).collect()}
    many = {r["p"]: (r["w"], r["t"]) for r in numbered(df, "p", F.col("w").desc_nulls_last(), F.col("t").asc(), rows=100).collect()}
    assert many == few and len(many) == 3000
    largest = in_ranges(written_once(df.withColumn("h", F.xxhash64("t"))), F.col("w").desc(), F.col("h"), rows=300)
    assert largest.select("__range").distinct().count() > 3


def test_ranges_follow_the_number_of_values(spark):
    """No window over a whole group: every one is of a range, or of one row per range."""
    df = spark.range(50_000).select((F.col("id") % 2).alias("k"), F.col("id").alias("x"))
    plan = value_positions(df, "x", ["k"], rows=1000)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("__range" in line for line in windows)
    ranks = add_rank(df, "x", "r", ["k"], members="many")
    assert ranks.filter("r <> (49998 + k - x) / 2 + 1").count() == 0
    assert {r["r"] for r in ranks.filter("x >= 49998").collect()} == {1.0}


@pytest.mark.parametrize("members", ["few", "many"])
def test_top_n_of_few_and_many_members_agree(numbers, members):
    _, df = numbers
    best = top_n(df, 3, "x", ["k"], members=members)
    assert rows(best) == rows(top_n(df, 3, "x", ["k"]))
    assert best.filter("k = 'hot'").count() >= 3


def test_top_n_does_not_gather_ties(spark):
    df = spark.range(20_000).select((F.col("id") % 3).alias("k"), F.when(F.col("id") % 5 > 0, 1).otherwise(F.col("id")).alias("w"))
    best = top_n(df, 5, "w", smallest=True)
    assert best.count() == 16_001 and {r["w"] for r in best.select("w").distinct().collect()} == {0, 1}
    plan = best._jdf.queryExecution().executedPlan().toString()
    gathered = [line for line in plan.splitlines() if "SinglePartition" in line]
    assert len(gathered) <= 1  # of the distinct weights, five from each partition
    grouped = top_n(df, 2, "w", ["k"])
    assert sorted(r["k"] for r in grouped.collect()) == [0, 0, 1, 1, 2, 2]


def test_summary_with_and_without_groups(numbers):
    data, df = numbers
    found = summarise(df, [], [F.count("x").alias("n")], {"m": "x"}).first()
    values = [x for _, x in data if x is not None]
    assert (found["n"], found["m"]) == (len(values), statistics.median(values))
    near = approximate_medians(df, {"m": "x"}, ["k"]).filter("k = 'one'").first()
    assert near["m"] == 5.0


def test_shares_of_many_members_have_no_window(spark):
    df = spark.createDataFrame([("x", ["a", "b"]), ("x", ["a"]), ("y", []), (None, ["c"]), ("y", None)], "g string, l array<string>")
    for by in ([], ["g"]):
        few = member_share(df, "l", by, into="m")
        many = member_share(df, "l", by, into="m", size="many")
        assert rows(many.select(few.columns)) == rows(few)
        assert "Window" not in many._jdf.queryExecution().executedPlan().toString()


def test_repeated_lookup_keys_are_an_error(spark):
    table = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "k string, v int")
    assert rows(unique_keys(table, "k")) == rows(table)
    with pytest.raises(Exception, match="several rows for key"):
        unique_keys(table.union(table.limit(1)), "k").collect()


@pytest.mark.parametrize("per_range", [20, 100_000])
def test_value_positions(numbers, per_range):
    data, df = numbers
    for r in value_positions(df, "x", ["k"], per_range).collect():
        values = [x for k, x in data if k == r["k"] and x is not None]
        assert r["n_below"] == sum(v < r["x"] for v in values)
        assert r["n_equal"] == values.count(r["x"]) and r["n_group"] == len(values)


@pytest.mark.parametrize("ties", ["average", "min"])
@pytest.mark.parametrize("within", [["k"], []])
@pytest.mark.parametrize("descending", [True, False])
def test_rank_for_few_and_many_members_agree(numbers, ties, within, descending):
    _, df = numbers
    few, many = (rows(add_rank(df, "x", "r", within, descending, ties, True, members)
                      .select("k", "x", F.col("r").cast("double"))) for members in ("few", "many"))
    assert few == many


def test_average_rank(spark):
    df = spark.createDataFrame([(3,), (3,), (1,), (None,)], "x int")
    ranks = {r["x"]: r["r"] for r in add_rank(df, "x", "r", missing_last=True).collect()}
    assert ranks == {3: 1.5, 1: 3.0, None: 4.0}
    assert rank_of(df, "x", F.col("x") == 1).first()["rank"] == 3


def test_top_n_keeps_ties_and_drops_missing(spark):
    df = spark.createDataFrame([("a", 5), ("b", 5), ("c", 4), ("d", None)], "k string, x int")
    assert rows(top_n(df, 1, "x")) == [("a", 5), ("b", 5)]
    assert rows(top_n(df, 1, "x", smallest=True)) == [("c", 4)]


def test_keep_first(spark):
    df = spark.createDataFrame([("k", "second", 2), ("k", "first", 1), ("j", "only", 2)],
                               "k string, v string, o int")
    assert rows(keep_first(df, ["k"], ["o"]).select("k", "v")) == [("j", "only"), ("k", "first")]


def test_null_safe_join_and_memberships(spark):
    left = spark.createDataFrame([(1, None), (2, 3.1), (3, 9.0)], "id int, rate double")
    right = spark.createDataFrame([("j", None), ("z", 3.1)], "code string, rate double")
    assert rows(lookup(left, right, "rate").select("id", "code")) == [
        (1, "j"), (2, "z"), (3, None)]
    assert rows(keep_members(left, right, ["rate"]).select("id")) == [(1,), (2,)]
    assert rows(drop_members(left, right, ["rate"]).select("id")) == [(3,)]
    assert join_null_safe(left, right, ["rate"], "inner").count() == 2
    both = full_join(left.select("id"), spark.createDataFrame([(3, "x"), (4, "y")],
                                                              "id int, v string"), "id")
    assert rows(both) == [(1, None), (2, None), (3, "x"), (4, "y")]


def test_reshaping_round_trip(spark):
    df = spark.createDataFrame([("a", 1, None), ("b", 3, 4)], "id string, x int, y int")
    long = to_long(df, "k", "v", ids=["id"])
    assert long.count() == 4
    assert rows(to_wide(long, ["id"], "k", "v", ["x", "y"])) == rows(df)
    assert select_between(df, "x", "y", ids=["id"]).columns == ["id", "x", "y"]


def test_multi_select(spark):
    df = spark.createDataFrame([(1, "Selected", "0"), (2, "0", "0"), (3, "Selected", "Selected")],
                               "id int, q1 string, q2 string")
    layout = spark.createDataFrame([("q1", "SQL"), ("q2", "R"), ("q9", "C")], "code string, label string")
    packed = pack_coded_options(df, ["q1", "q2"], ["Selected"], layout, "code", "label", "l")
    assert [r["l"] for r in packed.orderBy("id").collect()] == [["SQL"], None, ["SQL", "R"]]
    same = df.withColumn("l", pack_options({"SQL": F.col("q1") == "Selected",
                                            "R": F.col("q2") == "Selected"}))
    assert rows(same.select("id", "l")) == rows(packed.select("id", "l"))


def test_packed_text_keeps_empty_members(spark):
    df = spark.createDataFrame([(1, "A;B"), (2, "A;"), (3, None)], "id int, x string")
    assert rows(explode_packed(df, "x")) == [(1, "A"), (1, "B"), (2, ""), (2, "A"), (3, None)]


def test_member_share_denominators(spark):
    df = spark.createDataFrame([("g", ["a", "b"]), ("g", ["a"]), ("g", None), ("h", ["b"])],
                               "g string, l array<string>")
    answered = {(r["g"], r["l"]): r["respondents_share"]
                for r in member_share(df, "l", by=["g"]).collect()}
    assert answered == {("g", "a"): 1.0, ("g", "b"): 0.5, ("h", "b"): 1.0}
    everyone = {r["l"]: (r["respondents"], r["respondents_share"]) for r in member_share(
        df, "l", entities="all", keep_missing=True).collect()}
    assert everyone == {"a": (2, 0.5), "b": (2, 0.5), None: (1, 0.25)}
    given = member_share(df, "l", entity_total=F.lit(8)).filter("l = 'a'").first()
    assert given["respondents_share"] == 0.25


@pytest.mark.parametrize("members", ["few", "many"])
def test_shares_sum_to_one(spark, members):
    df = spark.range(1000).select((F.col("id") % 7).alias("a"), (F.col("id") % 3).alias("b"))
    shares = share_of_group(df, ["a", "b"], ["b"], members=members)
    sums = shares.groupBy("b").agg(F.sum("respondents_share").alias("s")).collect()
    assert all(abs(r["s"] - 1) < 1e-12 for r in sums)
    whole = add_share(shares.drop("respondents_share"), "respondents", "s", members=members)
    assert abs(whole.agg(F.sum("s")).first()[0] - 1) < 1e-12


def test_index_and_growth_use_present_periods(spark):
    df = spark.createDataFrame([("a", 2015, 0.2), ("a", 2017, 0.3), ("b", 2014, 0.5)],
                               "k string, y int, x double")
    indexed = index_to_base(df, "x", ["k"], "y", "i")
    assert {(r["k"], r["y"]): round(r["i"], 9) for r in indexed.collect()} == {
        ("a", 2015): 100.0, ("a", 2017): 150.0, ("b", 2014): 100.0}
    grown = growth_on_previous(df, "x", ["k"], "y", "g").filter("g IS NOT NULL").collect()
    assert [(r["k"], r["y"], round(r["g"], 9)) for r in grown] == [("a", 2017, 0.5)]


def test_running_share_ends_at_one(spark):
    df = spark.createDataFrame([("r", "b", 0.3), ("r", "a", 0.5), ("r", "c", 0.2)],
                               "r string, s string, x double")
    df = df.withColumn("o", with_literal_order("s", ["a", "b", "c"]))
    found = {r["s"]: round(r["t"], 9) for r in running_share(df, "x", "o", "t", ["r"]).collect()}
    assert found == {"a": 0.5, "b": 0.8, "c": 1.0}


def test_location_quotient_uses_the_national_figure(spark):
    cells = spark.createDataFrame([("p", "all", 200), ("p", "m", 30)],
                                  "place string, role string, v int")
    totals = spark.createDataFrame([("p", 200)], "place string, total int")
    national = spark.createDataFrame([("all", 1000), ("m", 100)], "role string, national int")
    found = location_quotient(cells, "place", "role", "v", totals, national, "all")
    assert {r["role"]: round(r["location_quotient"], 9) for r in found.collect()} == {
        "all": 1.0, "m": 1.5}


def test_published_scale(spark):
    """National figure 609940, provinces adding up to 624884, one city with 25185."""
    df = spark.createDataFrame([(25185,)], "v int")
    found = scaled_share(df, "v", F.lit(609940), F.lit(624884), "scaled", "share").first()
    assert abs(found["scaled"] - 24582.704790009026) < 1e-9
    assert abs(found["share"] - 0.04030348032594849) < 1e-15


def test_map_layer(spark):
    df = spark.createDataFrame(
        [("x", "a", 0.72), ("x", "b", 1.9), ("x", "c", None), ("y", "d", 5.0)],
        "dev_role string, n string, v double")
    text = F.format_number("v", 2)
    layer = map_layer(df, "x", "v", "Value", "n", text, 4).orderBy("n").collect()
    assert [(r["n"], r["bin_low"], r["bin_high"], r["label"]) for r in layer] == [
        ("a", 0.5, 1.0, "a - Value: 0.72"), ("b", 1.5, 2.0, "b - Value: 1.90")]
    assert abs(layer[0]["radius"] - (0.72 / 1.31 * 100) ** 0.55) < 1e-9
    kept = map_layer(df, "x", "v", "Value", "n", text, 4, require_metric=False, with_radius=False)
    assert kept.count() == 3 and "radius" not in kept.columns


def test_stack_and_suppress(spark):
    a = spark.createDataFrame([(1, "x")], "n int, s string")
    b = spark.createDataFrame([(5,)], "n int")
    assert rows(stack_tables(a, b)) == [(1, "x"), (5, None)]
    assert rows(suppress_small(stack_tables(a, b), 5, "n")) == [(5, None)]
