"""Job search, education, gender and ethnicity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from placemetrics.functions.semantics import (count_present, divide, is_in, matches, money_mean,
                                              recode, recode_by_pattern)
from placemetrics.functions.text import clean_packed, ratio_label, title_case
from placemetrics.operators.distribution import summarise
from placemetrics.operators.measures import add_share, member_share, share_of_group
from placemetrics.operators.ranking import add_rank, arrange, suppress_small
from placemetrics.operators.reshape import to_wide, with_literal_order
from placemetrics.plans.common import (HOME_COUNTRY, LATEST_YEAR, PRO_DEV, latest, present,
                                       pro_devs_at_home, row_count, total)
from placemetrics.plans.survey import EDUCATION_LABELS, HOME

# Job-seeking statuses in order, with labels.
SEEKING_LABELS = {
    "i am actively looking for a job": "Actively looking for a job",
    "i'm not actively looking, but i am open to new opportunities":
        "Not actively looking for a job,\nbut open to new opportunities",
    "i am not interested in new job opportunities": "Not interested in new job opportunities",
}

# Employment statuses in order, with labels.
EMPLOYMENT_LABELS = {
    "employed full-time": "Employed full-time",
    "independent contractor, freelancer, or self-employed":
        "Independent contractor, freelancer,\nor self-employed",
    "employed part-time": "Employed part-time",
    "unemployed": "Unemployed",
}

# Job discovery channels, by pattern; the first match decides.
CHANNEL_RULES = [
    ("job board", "Job Board"),
    ("friend", "Friend, family member,\nor former colleague"),
    ("someone at the company", "Contacted directly by\nsomeone at the company"),
    ("career fair", "Career fair or\non-campus recruiting event"),
    ("headhunter", "External recruiter or headhunter"),
    ("web site", "Job listing on company's website"),
    ("other", "Other"),
]

# Labels of informal education shown in two lines.
INFORMAL_LABELS = {
    "Part-time/evening course": "Part-time/\nevening course",
    "Open source contrib": "Open source\ncontribution",
    "Industry certification": "Industry\ncertification",
}

# Time to a job after a bootcamp, by pattern, in order.
BOOTCAMP_RULES = [("already had a job", "Had a job prior to bootcamp"),
                  ("haven't gotten a job", "Haven't gotten a job since bootcamp")]
BOOTCAMP_REST = "Got a job since starting bootcamp"

NO_GENDER = "prefer not to disclose"

# Genders in result order, with labels.
GENDER_LABELS = {
    "male": "Male",
    "transgendered or non-conforming": "Transgendered\nor non-conforming",
    "female": "Female",
}


# --- job search -----------------------------------------------------------------

def _seekers(respondents: DataFrame) -> DataFrame:
    merged = F.when(matches("employment_status_original", "not employed"), "unemployed").otherwise(
        F.col("employment_status_original"))
    rows = respondents.withColumn("employment_status_original", merged)
    return pro_devs_at_home(rows, "job_seeking_status").filter(
        is_in("employment_status_original", EMPLOYMENT_LABELS))


def seeking_by_status(respondents: DataFrame) -> DataFrame:
    shares = share_of_group(_seekers(respondents),
                            ["employment_status_original", "job_seeking_status"],
                            ["employment_status_original"])
    return shares.withColumns({
        "seeking_label": recode("job_seeking_status", SEEKING_LABELS, F.lit(None)),
        "seeking_ord": with_literal_order("job_seeking_status", list(SEEKING_LABELS)),
        "employment_label": recode("employment_status_original", EMPLOYMENT_LABELS, F.lit(None)),
        "employment_ord": with_literal_order("employment_status_original",
                                             list(EMPLOYMENT_LABELS))})


def n_seekers(respondents: DataFrame) -> DataFrame:
    return _seekers(respondents).groupBy("employment_status_original").agg(
        F.count(F.lit(1)).alias("respondents"))


def job_channels(respondents: DataFrame) -> DataFrame:
    shares = share_of_group(pro_devs_at_home(respondents, "job_discovery_channel"),
                            ["job_discovery_channel"])
    return shares.withColumn("job_discovery_channel_label", recode_by_pattern(
        "job_discovery_channel", CHANNEL_RULES, title_case("job_discovery_channel")))


def job_channels_merged(channels: DataFrame) -> DataFrame:
    """Shares added up under the labels that several channels share."""
    return arrange(channels.groupBy("job_discovery_channel_label").agg(
        F.sum("respondents_share").alias("respondents_share")), "respondents_share")


def n_job_channels(channels: DataFrame) -> DataFrame:
    return total(channels, "respondents", "respondents")


def channels_matching(channels: DataFrame, pattern: str = "job board") -> DataFrame:
    return channels.filter(matches("job_discovery_channel", pattern)).select(
        "job_discovery_channel")


def channel_share_matching(channels: DataFrame,
                           pattern: str = "recruiter|contacted directly") -> DataFrame:
    return total(channels.filter(matches("job_discovery_channel", pattern)), "respondents_share",
                 "respondents_share")


# --- education ------------------------------------------------------------------

EDUCATION_KEYS = ["educ_level_group_label", "region"]


def education_regions(respondents: DataFrame) -> DataFrame:
    rows = latest(respondents, "region", "educ_level_group_label", pro_status=PRO_DEV)
    counts = summarise(rows, EDUCATION_KEYS, [
        F.count(F.lit(1)).alias("respondents"), money_mean("salary_cad").alias("mean_salary_cad"),
        count_present("salary_cad").alias("n_salary_responses"),
    ], {"median_salary_cad": "salary_cad"})
    shares = add_share(counts, "respondents", "respondents_share", ["region"])
    return shares.withColumn("educ_ord", with_literal_order("educ_level_group_label",
                                                            list(EDUCATION_LABELS.values())))


def some_college_or_more(education: DataFrame) -> DataFrame:
    """Per region: the shares are still those of a region when they are added up."""
    levels = ["Some College", "Bachelor's Degree", "Graduate Degree"]
    return education.filter(is_in("educ_level_group_label", levels)).groupBy("region").agg(
        F.sum("respondents_share").alias("respondents_share"))


def education_salaries(education: DataFrame, region: str = HOME) -> DataFrame:
    return education.filter(F.col("region") == region).select(
        "educ_level_group_label", "educ_ord", "median_salary_cad", "n_salary_responses")


def informal_education(respondents: DataFrame) -> DataFrame:
    """Members over all professional developers at home, non-answerers included."""
    shares = member_share(pro_devs_at_home(respondents), "informal_educ", entities="all",
                          keep_missing=True)
    return shares.drop("total_respondents")


def informal_education_labelled(shares: DataFrame) -> DataFrame:
    named = shares.filter(present("informal_educ"))
    return arrange(named.withColumn("informal_educ_label", recode("informal_educ",
                                                                  INFORMAL_LABELS)),
                   "-respondents_share")


def self_taught_by_education(respondents: DataFrame) -> DataFrame:
    """A respondent without any informal education counts as not self-taught."""
    rows = pro_devs_at_home(respondents, "educ_level_group_label")
    taught = matches(F.array_join("informal_educ", ";"), "self-taught", ignore_case=True)
    rows = rows.withColumn("is_self_taught", F.when(taught, "Partially Self-Taught").otherwise(
        "Not Partially Self-Taught"))
    return share_of_group(rows, ["educ_level_group_label", "is_self_taught"],
                          ["educ_level_group_label"])


def bootcamp_outcomes(respondents: DataFrame) -> DataFrame:
    rows = latest(respondents, "unemployed_time_post_bootcamp", country=HOME_COUNTRY)
    group = recode_by_pattern("unemployed_time_post_bootcamp", BOOTCAMP_RULES,
                              F.lit(BOOTCAMP_REST))
    return share_of_group(rows.withColumn("bootcamp_group", group), ["bootcamp_group"])


def n_bootcamp(respondents: DataFrame) -> DataFrame:
    return row_count(latest(respondents, "unemployed_time_post_bootcamp", country=HOME_COUNTRY))


# --- gender ---------------------------------------------------------------------

def gender_country_years(respondents: DataFrame) -> DataFrame:
    """Shares within country and year, the keys left over after the last was counted."""
    rows = respondents.filter(present("country", "gender") & (F.col("gender") != NO_GENDER))
    keys = ["year", "country", "region_carow_label"]
    return share_of_group(rows, [*keys, "gender"], keys)


def gender_at_home(genders: DataFrame, year: int = LATEST_YEAR) -> DataFrame:
    return genders.filter((F.col("country") == HOME_COUNTRY) & (F.col("year") == year)).select(
        "gender", "respondents", "respondents_share")


def _large_countries(genders: DataFrame, minimum: int, year: int) -> DataFrame:
    """One year's rows of the countries with enough respondents over all genders."""
    country = F.sum("respondents").over(Window.partitionBy("country"))
    return (genders.filter(F.col("year") == year).withColumn("__country", country)
            .filter(F.col("__country") >= minimum).drop("__country"))


def genders_of_most_female(genders: DataFrame, minimum: int = 50, n: int = 20,
                           year: int = LATEST_YEAR) -> DataFrame:
    """All genders of the n countries with the largest share of women, ties kept."""
    share = F.max(F.when(F.col("gender") == "female", F.col("respondents_share"))).over(
        Window.partitionBy("country"))
    rows = _large_countries(genders, minimum, year).withColumn("__female", share)
    # Countries are ranked by their one row for women; the others follow their country.
    women = F.when(F.col("gender") == "female", F.col("respondents_share"))
    rows = add_rank(rows.withColumn("__women", women), "__women", "__rank", ties="min")
    place = F.min("__rank").over(Window.partitionBy("country"))
    rows = rows.withColumn("__place", place).filter(F.col("__place") <= n)
    return arrange(rows.select("country", "gender", recode("gender", GENDER_LABELS, F.lit(None))
                               .alias("gender_label"), "respondents", "respondents_share",
                               "__female"), "__female").drop("__female")


def n_gender_countries(genders: DataFrame, minimum: int = 50,
                       year: int = LATEST_YEAR) -> DataFrame:
    return _large_countries(genders, minimum, year).agg(
        F.count_distinct("country").alias("countries"))


def female_rank(genders: DataFrame, country: str = HOME_COUNTRY, minimum: int = 50,
                year: int = LATEST_YEAR) -> DataFrame:
    women = _large_countries(genders, minimum, year).filter(F.col("gender") == "female")
    ranked = add_rank(women, "respondents_share", "rank")
    return ranked.filter(F.col("country") == country).select(
        "country", "respondents", "respondents_share", "rank")


def male_female_ratio(genders: DataFrame) -> DataFrame:
    counts = genders.filter(is_in("gender", ["male", "female"])).groupBy(
        "year", "region_carow_label", "gender").agg(F.sum("respondents").alias("respondents"))
    wide = to_wide(counts, ["year", "region_carow_label"], "gender", "respondents",
                   ["male", "female"])
    ratio = divide("male", "female")
    return wide.withColumns({"male_female_ratio": ratio, "text": ratio_label(ratio)})


def pay_gap(countries: DataFrame, minimum: int = 20, year: int = LATEST_YEAR) -> DataFrame:
    """Median salary of women relative to men where both samples are large enough."""
    rows = suppress_small(countries.filter(F.col("year") == year), minimum,
                          "n_salary_responses_males", "n_salary_responses_females")
    return arrange(rows.select("country", title_case("country").alias("country_label"),
                               "median_salary_cad_males", "median_salary_cad_females",
                               "salary_pc_diff_females_males"), "-salary_pc_diff_females_males")


def pay_at_home(countries: DataFrame, year: int = LATEST_YEAR) -> DataFrame:
    return countries.filter((F.col("year") == year) & (F.col("country") == HOME_COUNTRY)).select(
        "year", "country", "median_salary_cad_males", "median_salary_cad_females")


def gender_experience(respondents: DataFrame) -> DataFrame:
    rows = pro_devs_at_home(respondents, "gender", "pro_experience_bin").filter(
        F.col("gender") != NO_GENDER)
    return share_of_group(rows, ["gender", "pro_experience_bin", "pro_experience_bin_above_15"],
                          ["gender"])


def experience_bin(table: DataFrame, bin: str = "Under 5") -> DataFrame:
    return table.filter(F.col("pro_experience_bin") == bin)


def long_experience(table: DataFrame) -> DataFrame:
    return table.filter("pro_experience_bin_above_15").groupBy("gender").agg(
        F.sum("respondents_share").alias("respondents_share"))


# --- ethnicity ------------------------------------------------------------------

def _with_ethnicities(respondents: DataFrame) -> DataFrame:
    """Respondents at home with anything left after declined answers are removed."""
    packed = clean_packed(F.array_join("ethnicities", ";"))
    rows = latest(respondents, country=HOME_COUNTRY).withColumn("packed", packed)
    return rows.filter(matches("packed", r"\p{Alpha}"))


def n_ethnicity_rows(respondents: DataFrame) -> DataFrame:
    return row_count(_with_ethnicities(respondents))


def n_ethnicity_respondents(respondents: DataFrame) -> DataFrame:
    return _with_ethnicities(respondents).agg(F.count_distinct("respondent_id")
                                              .alias("respondents"))


def ethnicities(respondents: DataFrame) -> DataFrame:
    rows = _with_ethnicities(respondents).select(F.split("packed", ";", -1).alias("ethnicity"))
    return member_share(rows, "ethnicity").drop("total_respondents")


def ethnicities_sorted(shares: DataFrame) -> DataFrame:
    label = F.when(matches("ethnicity", "Native"),
                   "Native American, Pacific Islander\nor Indigenous Australian").otherwise(
        F.col("ethnicity"))
    return arrange(shares.withColumn("ethnicity_label",
                                     F.regexp_replace(label, "descent", "Descent")),
                   "respondents_share")


def ethnicity_share_matching(shares: DataFrame, pattern: str = "asian") -> DataFrame:
    return total(shares.filter(matches("ethnicity", pattern, ignore_case=True)),
                 "respondents_share", "respondents_share")
