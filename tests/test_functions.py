"""One small fixture per rule on missing values, ties, rounding and text."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from placemetrics.functions import text
from placemetrics.functions import (
    bin_index, clean_packed, comma_label, divide, drop_parenthesised, first_match, growth,
    half_even, half_open_bin, if_known, matches, money_label, money_mean, money_sum, not_in,
    percent_label, pretty_step, raw_cell, rank_label, ratio_label, ratio_of_counts, recode,
    replace_all, slug, slug_names, strict_sum, times_label, title_case, to_ascii, to_number)
from placemetrics.functions.text import CITY_RULES


def values(df, column):
    return [row[0] for row in df.select(column).collect()]


def table(spark, rows, schema):
    return spark.createDataFrame([(r,) if not isinstance(r, tuple) else r for r in rows], schema)


def test_condition_stays_missing(spark):
    df = table(spark, [True, False, None], "c boolean")
    assert values(df, if_known(F.col("c"), F.lit("a"), F.lit("b"))) == ["a", "b", None]


def test_match_and_membership_are_false_for_missing(spark):
    df = table(spark, ["a", "b", None], "x string")
    assert values(df, matches("x", "a|b")) == [True, True, False]
    assert values(df.filter(not_in("x", ["a"])), "x") == ["b", None]
    assert values(df, matches("x", "A", ignore_case=True)) == [True, False, False]


def test_division_by_zero_is_missing(spark):
    df = table(spark, [(1, 0), (0, 5), (3, 2)], "a int, b int")
    assert values(df, divide("a", "b")) == [None, 0.0, 1.5]
    assert values(df, growth("a", "b")) == [None, -1.0, 0.5]


def test_text_to_number_and_first_match(spark):
    df = table(spark, ["12 to 13", "many", None], "x string")
    assert values(df, first_match("x", r"^\d+")) == ["12", None, None]
    assert values(df, to_number(first_match("x", r"^\d+"))) == [12.0, None, None]


def test_strict_and_exact_sums(spark):
    df = table(spark, [("a", 0.1), ("a", 0.2), ("b", None), ("b", 1.0)], "k string, x double")
    rows = df.groupBy("k").agg(strict_sum("x").alias("s"), F.sum("x").alias("l"),
                               money_sum("x").alias("m"), money_mean("x").alias("mean")).collect()
    found = {r["k"]: r for r in rows}
    assert found["a"]["m"] == 0.3 and found["a"]["mean"] == 0.15
    assert found["b"]["s"] is None and found["b"]["l"] == 1.0


def test_ratio_of_counts(spark):
    df = table(spark, [(1, True), (2, False), (None, True)], "x int, f boolean")
    ratio = df.agg(ratio_of_counts(F.col("f"), F.col("x").isNotNull())).first()[0]
    assert ratio == 1.0


def test_rounding_half_even(spark):
    df = table(spark, [2.5, 3.5], "x double")
    assert values(df, half_even("x", 0)) == [2.0, 4.0]


def test_recode_keeps_other_values(spark):
    df = table(spark, ["a", "z", None], "x string")
    assert values(df, recode("x", {"a": "A"})) == ["A", "z", None]
    assert values(df, recode("x", {"a": "A"}, F.lit(None))) == ["A", None, None]


def test_half_open_bins(spark):
    df = table(spark, [0.0, 4.9, 5.0, 20.0, 25.0, None], "x double")
    labels = ["Under 5", "5 to 10", "10 to 15", "15 to 20", "Over 20"]
    edges = [0, 5, 10, 15, 20, 25]
    assert values(df, half_open_bin("x", edges, labels)) == [
        "Under 5", "Under 5", "5 to 10", "Over 20", None, None]
    assert values(df, bin_index("x", edges)) == [1, 1, 2, 5, None, None]
    with pytest.raises(ValueError):
        half_open_bin("x", edges, labels[1:])


@pytest.mark.parametrize("low, high, bins, step", [
    (0.0, 10.0, 4, 2.0), (0.72, 1.9, 4, 0.5), (3.0, 97.0, 7, 10.0), (0.0, 650000.0, 7, 100000.0),
    (5.0, 5.0, 4, 5.0)])
def test_pretty_steps(spark, low, high, bins, step):
    df = table(spark, [(low, high)], "l double, h double").withColumn(
        "cell", raw_cell("l", "h", bins))
    assert values(df, pretty_step("cell")) == [step]


def test_title_case(spark):
    cases = {
        "android developers": "Android Developers",
        "all Developers": "all Developers",
        "iOS developers": "iOS Developers",
        "web developers (front-end, back-end, or full-stack)":
            "Web Developers (Front-End, Back-End, or Full-Stack)",
        "health care services": "Health Care Services",
        "the end of it": "The End of it",
        "front-end web: the end": "Front-End Web: The End",
        "1,000 to 4,999": "1,000 to 4,999",
    }
    df = table(spark, list(cases), "x string")
    assert values(df, title_case("x")) == list(cases.values())
    assert values(table(spark, [None], "x string"), title_case("x")) == [None]


def test_ascii(spark):
    df = table(spark, ["Québec Straße", "Œuvre Łódź", "ñandú æon"], "x string")
    assert values(df, to_ascii("x")) == ["Quebec Strasse", "OEuvre Lodz", "nandu aeon"]
    cases = {"i don’t know": "i don't know", "“a” – b—c…": '"a" - b-c...', "©®×÷«x»": "(C)(R)*/<<x>>",
             "Que\u0301bec n\u0303": "Quebec n", "日本": "日本", "a\u00a0b": "a b"}
    assert values(table(spark, list(cases), "x string"), to_ascii("x")) == list(cases.values())


def test_every_latin_letter_has_its_plain_form(spark):
    """All Latin blocks: by decomposition, or by the base letter in the Unicode name."""
    expected = {}
    for code in [c for first, last in text.LATIN_BLOCKS for c in range(first, last + 1)]:
        letter, name = chr(code), unicodedata.name(chr(code), "")
        base = "".join(c for c in unicodedata.normalize("NFKD", letter) if not unicodedata.combining(c))
        words = name.split()
        if letter in text.PLAIN_FORMS:
            expected[letter] = text.PLAIN_FORMS[letter]
        elif base.isascii() and base.isalpha():
            expected[letter] = base
        elif words[:1] == ["LATIN"] and words[2:3] == ["LETTER"] and len(words) > 4 and words[4] == "WITH" and len(words[3]) == 1:
            expected[letter] = words[3] if words[1] == "CAPITAL" else words[3].lower()
    assert len(expected) > 800
    df = table(spark, [f"x{c}-{c}" for c in expected], "x string")
    assert values(df, to_ascii("x")) == [f"x{p}-{p}" for p in expected.values()]
    whole = table(spark, ["".join(expected), None, "Ǆ ﬁ ᴀ Ɓ Ꜳ ｆ日"], "x string")
    assert values(whole, to_ascii("x")) == ["".join(expected.values()), None, "DZ fi A B AA f日"]


def test_city_spelling(spark):
    cases = {"Montréal, Quebec": "montreal", "Québec, Quebec": "quebec city",
             "Ottawa-Gatineau, Ontario/Quebec": "ottawa  -  gatineau",
             "Calgary, Alberta": "Calgary"}
    df = table(spark, list(cases), "x string")
    assert values(df, replace_all(to_ascii("x"), CITY_RULES)) == list(cases.values())


def test_clean_list(spark):
    cases = {"A;I don't know;I prefer not to say": "A;", "I don't know;A": "A",
             "A;I don't know;B": "A;B", "I don't know": "", "A": "A"}
    df = table(spark, list(cases), "x string")
    assert values(df, clean_packed("x")) == list(cases.values())


def test_names_and_labels(spark):
    assert slug_names(["Dev Role", "Québec  City ", "dev role", "2017"]) == [
        "dev_role", "quebec_city", "dev_role1", "x2017"]
    df = table(spark, [1234.5], "x double")
    assert values(df, comma_label("x", 0)) == ["1,234"]
    assert values(df, money_label("x")) == ["C$1,234"]
    assert values(df, percent_label(F.lit(0.12345), 1)) == ["12.3%"]
    assert values(df, times_label(F.lit(1.505))) == ["1.50x"]
    assert values(df, ratio_label(F.lit(8.25))) == ["8.2:1"]
    assert values(df, rank_label(F.lit(3), F.lit("Paris"))) == ["3. Paris"]
    assert values(df, slug(F.lit("Nova Scotia"))) == ["nova_scotia"]
    assert values(df, drop_parenthesised(F.lit("euros (E)"))) == ["euros"]


def test_means_are_of_the_amounts_themselves(spark):
    amounts = [x * 1.32 for x in (50_000.01, 61_234.57, 70_000.99)] + [None]
    df = table(spark, [(a,) for a in amounts], "x double")
    found = df.agg(money_mean("x").alias("m"), F.avg("x").alias("avg")).first()
    assert abs(found["m"] - found["avg"]) < 1e-7


def test_folding_leaves_quotes_backslashes_and_other_scripts(spark):
    cases = {"it's \\ Œ'": "it's \\ OE'", "ß\nǆ\tﬁ😀ﬂ": "ss\ndz\tfi😀fl", "…¼": "... 1/4", "日本 Æther": "日本 AEther",
             "plain $1 \\u00e9": "plain $1 \\u00e9", "": ""}
    assert values(table(spark, list(cases), "x string"), to_ascii("x")) == list(cases.values())
