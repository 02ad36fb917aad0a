"""What the learned models reach on rows they have not seen, and their scores against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from placemetrics.llm import catalogue, kernel_langid, quality_gam

FOLDER = "/root/testdata/sf0.01"


def area_under_curve(score, label):
    order = np.argsort(score, kind="stable")
    score, label = np.array(score)[order], np.array(label)[order]
    _, first, count = np.unique(score, return_index=True, return_counts=True)
    ranks = np.repeat(first + (count + 1) / 2, count)
    good = label.sum()
    return (ranks[label == 1].sum() - good * (good + 1) / 2) / (good * (len(label) - good))


def test_quality_of_held_out_rows(spark):
    got = catalogue.QUERIES["op1_quality_gam"](spark, FOLDER).filter("held_out")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    rows = got.join(labels, "doc_id").select("score", "quality", "predicted").collect()
    assert len(rows) > 50
    assert area_under_curve([r.score for r in rows], np.array([r.quality for r in rows])) > 0.97
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.9


def test_language_of_held_out_rows(spark):
    got = catalogue.QUERIES["op7_kernel_langid"](spark, FOLDER).filter("held_out")
    truth = spark.read.parquet(f"{FOLDER}/documents.parquet").filter("lang is not null").select("doc_id", "lang")
    rows = got.join(truth, "doc_id").filter("lang_pred <> 'und'").collect()
    assert len(rows) > 200 and np.mean([r.lang_pred == r.lang for r in rows]) > 0.97


def test_additive_score_is_the_sum_of_its_tables():
    """Looked up one by one, table by table."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, len(quality_gam.FEATURES)))
    model = quality_gam.fit(x, (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(float))
    assert ((model.scores(x) >= 0.5) == (x[:, 0] + x[:, 1] * x[:, 2] > 0)).mean() > 0.85
    twice = model.scores(np.repeat(x[:7], 2, axis=0))
    assert np.allclose(twice[::2], twice[1::2]) and np.allclose(twice[::2], model.scores(x)[:7])


def test_kernel_scores_are_the_plain_regression():
    """The folded matrix against the Nyström features and weights worked out one by one."""
    texts = ["the cat and the dog", "the house of the man", "der hund und die katze", "das haus und der mann"] * 3
    labels = ["en", "en", "de", "de"] * 3
    seen = np.stack([kernel_langid.presence(t + f" w{k}") for k, t in enumerate(texts)])
    model = kernel_langid.fit(seen, labels)

    def kernel(a, b):
        return (a & b).sum() / np.sqrt(a.sum() * b.sum())

    order = [k for name in ("de", "en") for k in [k for k, x in enumerate(labels) if x == name][: kernel_langid.LANDMARKS]]
    between = np.array([[kernel(seen[i], seen[j]) for j in order] for i in order])
    values, vectors = np.linalg.eigh(between)
    good = values > 1e-6 * values.max()
    z = np.array([[kernel(s, seen[j]) for j in order] for s in seen]) @ (vectors[:, good] / np.sqrt(values[good]))
    y = np.array([[1 if x == name else -1 for name in ("de", "en")] for x in labels], float)
    weight = np.full((len(texts), 1), 1 / 6)
    ridge = kernel_langid.RIDGE * 2 / z.shape[1] * np.eye(z.shape[1])
    plain = z @ np.linalg.solve(z.T @ (weight * z) + ridge, z.T @ (weight * y))
    assert model.languages == ["de", "en"] and np.allclose(model.margins(seen), plain, atol=1e-3)


@pytest.mark.parametrize("text", ["½²", "Ⅷ", "12 ³ ¼", "①", "__", None, "", "٣"])
def test_numbers_are_no_letters(spark, text):
    model = kernel_langid.fit(np.stack([kernel_langid.presence("the cat"), kernel_langid.presence("der hund")]), ["en", "de"])
    docs = spark.createDataFrame([(1, text), (2, "the " + (text or ""))], "doc_id int, text string")
    rows = {r.doc_id: r for r in kernel_langid.identified(docs, model).collect()}
    assert rows[1].lang_pred == "und" and rows[1].score == 0 and rows[2].lang_pred == "en"


def test_candidates_of_a_language_meet_in_bounded_numbers(spark, monkeypatch):
    monkeypatch.setattr(kernel_langid, "SALTS", 4)
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("the cat").alias("text"), F.lit("en").alias("lang")).repartition(20)
    assert kernel_langid.train(docs, per_language=30).languages == ["en"]


def test_clashing_columns_change_nothing(spark, odd):
    from placemetrics.llm import rule_ledger

    names = ["n", "salt", "h", "lang_pred", "failures", "words", "n_words", "kept", "seen"]
    wide = odd.select("*", *[F.lit(f"old {n}").alias(n) for n in names])
    model = kernel_langid.train(wide)
    assert sorted(map(repr, kernel_langid.identified(wide, model).collect())) == sorted(map(repr, kernel_langid.identified(odd, model).collect()))
    assert rule_ledger.ledger(wide).count() == odd.count()
