"""Near copies among many pages of one form, which share prefixes without being linked."""

import random

import numpy as np
import pytest

from placemetrics.llm import lsh_forest
from placemetrics.llm.common import shingle_set


def form_pages(values, n, copies):
    """``n`` pages with nine fields of ``values`` shared values each, and copies with other values in four."""
    r = random.Random(values)
    words = [f"t{k}" for k in range(300)]
    fields = [[r.randrange(values) for _ in range(9)] for _ in range(n)]
    for k in r.sample(range(n), copies):
        other = list(fields[k])
        for f in r.sample(range(9), 4):
            other[f] = r.randrange(values)
        fields.append(other)
    out = []
    for page in fields:
        text = list(words)
        for f, v in enumerate(page):
            text[15 + 30 * f] = f"field{f}is{v}"
        out.append(" ".join(text))
    return out


def components_by_hand(texts):
    sets = [shingle_set(t.encode()) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            common = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
            if 100 * common >= 85 * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return [find(k) for k in range(len(texts))]


@pytest.mark.parametrize("cell", [128, 16])
def test_copies_among_form_pages(spark, monkeypatch, cell):
    monkeypatch.setattr(lsh_forest, "CELL", cell)
    texts = form_pages(12, 300, 100)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in lsh_forest.near_duplicates(docs).collect()}
    expected = components_by_hand(texts)
    assert got == dict(enumerate(expected)) and len(set(expected)) > 100


def test_a_form_that_no_sample_shows_is_ordered_by_counts(spark, monkeypatch):
    """Words of a form that the sample does not tell would put all its pages into cells together."""
    monkeypatch.setattr(lsh_forest, "CELL", 16)
    monkeypatch.setattr(lsh_forest, "common_shingles", lambda *_: np.zeros(0, np.uint64))
    shared, store = [], lsh_forest.stored

    def noting(df, name):
        table = store(df, name)
        if name == "shared":
            shared.append([r.rows for r in table.collect()])
        return table

    monkeypatch.setattr(lsh_forest, "stored", noting)
    texts = form_pages(12, 300, 60)
    rows = [*enumerate(texts), (0, texts[0]), (5, "another text of that id"), (None, texts[3])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in lsh_forest.near_duplicates(docs).filter("n_shingles > 9 and doc_id is not null").collect()}
    assert got == dict(enumerate(components_by_hand(texts)))
    before, after = ([n * -(-n // 16) for n in rows] for rows in shared)
    assert sum(after) < sum(before) / 4 and max(shared[1]) < max(shared[0]) / 4


def test_texts_of_a_few_nodes_leave_the_others_where_they_are(spark, monkeypatch):
    """Joins that ask for few texts do not deal out all of them, though no table's size is known ahead."""
    monkeypatch.setattr(lsh_forest, "CELL", 16)
    monkeypatch.setattr(lsh_forest, "common_shingles", lambda *_: np.zeros(0, np.uint64))
    plans, store = {}, lsh_forest.stored

    def noting(df, name):
        plans.setdefault(name, []).append(df._jdf.queryExecution().executedPlan().toString())
        return store(df, name)

    monkeypatch.setattr(lsh_forest, "stored", noting)
    counted, shingles = [], lsh_forest._shingles

    def counting(bodies, size):
        counted.append(bodies._jdf.queryExecution().executedPlan().toString())
        return shingles(bodies, size)

    monkeypatch.setattr(lsh_forest, "_shingles", counting)
    texts = form_pages(12, 200, 40)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "64KB")
    try:
        got = {r.doc_id: r.component_id for r in lsh_forest.near_duplicates(docs).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == dict(enumerate(components_by_hand(texts)))
    assert counted and len(plans["texts"]) > 1
    assert not any("SortMergeJoin" in plan for plan in counted + plans["texts"])


def test_a_few_crowded_shingles_are_not_counted(spark, monkeypatch):
    """A passage of few pages makes few rows in cells; counting all their shingles would move far more."""
    monkeypatch.setattr(lsh_forest, "CELL", 4)
    monkeypatch.setattr(lsh_forest, "common_shingles", lambda *_: np.zeros(0, np.uint64))
    counted, by_frequency = [], lsh_forest.by_frequency
    monkeypatch.setattr(lsh_forest, "by_frequency", lambda *args: counted.append(args) or by_frequency(*args))
    r = random.Random(3)
    texts = [" ".join(["one", "form", "of", "five", "words"] + [f"p{k}w{r.randrange(99)}" for _ in range(9)]) for k in range(40)]
    for k in range(300):  # pairs of pages that differ in two words of sixty
        words = [f"q{k // 2}w{j}" for j in range(60)]
        words[(k % 2) * 30 + 5] = f"x{k}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in lsh_forest.near_duplicates(docs).collect()}
    assert got == dict(enumerate(components_by_hand(texts)))
    assert not counted


def test_bitmaps_rule_out_texts_that_differ_and_no_others(spark):
    """Bitmaps of unlike width are folded; of pairs beyond the limit few are left to be compared in full."""
    r = random.Random(11)
    texts, pairs = [], []
    for k in range(60):
        words = [f"a{k}w{j}" for j in range(r.choice([5, 70, 125, 140, 3000]))]
        other = list(words)
        for j in range(r.randrange(3)):
            other[r.randrange(len(other))] = f"b{k}w{j}"
        other += [f"c{k}w{j}" for j in range(r.randrange(max(1, len(words) // 9)))]
        texts += [" ".join(words), " ".join(other)]
        pairs += [(2 * k, 2 * k + 1)] + ([(2 * j, 2 * k) for j in range(k) if len(texts[2 * j].split()) == len(words)])
    bodies = spark.createDataFrame([(k, t.encode()) for k, t in enumerate(texts)], "node bigint, body binary")
    left = {tuple(row) for row in lsh_forest._reachable(spark.createDataFrame(pairs, "a bigint, b bigint"), bodies, 5, 85).collect()}
    sets = [shingle_set(t.encode()) for t in texts]
    linked = {(a, b) for a, b in pairs if lsh_forest._alike(sets[a], sets[b], 85)}
    assert len(linked) > 10 and linked <= left <= set(pairs)
    assert len(left - linked) < len(set(pairs) - linked) / 10
