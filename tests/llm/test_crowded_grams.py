"""A passage that very many documents share: rows stay in proportion to blocks, and nothing is lost."""

import random
from collections import Counter

import pytest

from placemetrics.llm import suffix_dedup
from test_queries_on_odd_rows import removed_by_brute_force


def noise(draw, n):
    return bytes(draw.randrange(33, 126) for _ in range(n)).decode()


def one_passage(n, draw):
    passage = noise(draw, 700)
    return [(k, noise(draw, draw.randrange(0, 300)) + passage + noise(draw, draw.randrange(0, 300))) for k in range(n)]


def near_copies(n, draw):
    """Copies of one text with one to three letters changed each."""
    text, out = noise(draw, 1500), []
    for k in range(n):
        letters = list(text)
        for _ in range(draw.randrange(1, 4)):
            letters[draw.randrange(len(letters))] = chr(draw.randrange(33, 126))
        out.append((k, "".join(letters)))
    return out


@pytest.mark.parametrize("made", [one_passage, near_copies])
def test_rows_stay_in_proportion_to_blocks(spark, monkeypatch, made):
    monkeypatch.setattr(suffix_dedup, "CROWDED", 40)
    rows = made(400, random.Random(4))
    counts, plain = {}, suffix_dedup.stored

    def counted(df, name):
        out = plain(df, name)
        counts[name] = counts.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(suffix_dedup, "stored", counted)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = suffix_dedup.without_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert Counter(map(tuple, out)) == removed_by_brute_force([(i, t.encode()) for i, t in rows], 400)
    assert counts["halves"] > 0  # the gram was crowded
    n = {name: counts[name] / counts["blocks"] for name in ("halves", "left")}
    print(n, counts)
    body = suffix_dedup.text_bytes().alias("body")
    found = suffix_dedup.repeated_starts(docs.select(suffix_dedup.F.unhex(suffix_dedup.F.md5(body)).alias("row"), body)).count()
    assert found < 5 * counts["blocks"]


def test_rows_are_named_by_128_bits(spark):
    docs = spark.createDataFrame([(None, None), (None, None), (1, "x" * 900), (1, "x" * 900)], "doc_id bigint, text string")
    out = suffix_dedup.without_repeats(docs).select("doc_id", "n_bytes", "n_removed").collect()
    assert Counter(map(tuple, out)) == {(None, 0, 0): 2, (1, 900, 900): 2}
