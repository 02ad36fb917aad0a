"""Fingerprints follow the corpus's common words, and grow in texts that have none of them."""

import numpy as np

from placemetrics.llm import spot_signatures
from placemetrics.llm.common import word_edges, word_hashes

NONE = np.zeros(0, np.uint64)


def hashes(*words):
    return np.concatenate([word_hashes(w.encode()) for w in words])


def test_signatures_grow_with_the_text():
    words = [f"слово{k}" for k in range(400)]
    for common in (NONE, hashes("the", "of")):
        for joined in (" ".join(words), " | ".join(words), " ".join(w.upper() + "!!" for w in words)):
            assert len(spot_signatures.fingerprint(joined, common)) > 20
        changed = words[:200] + [f"иное{k}" for k in range(200)]
        alike = spot_signatures.likeness(*(spot_signatures.fingerprint(" ".join(w), common) for w in (words, changed)))
        assert 0.1 < alike < 0.7


def test_punctuation_does_not_choose_anchors():
    def bare(text):
        return spot_signatures._bare(*word_edges(text.encode()), word_hashes(text.encode()))

    words = [f"word{k}" for k in range(200)]
    assert (bare(" ".join(words)) == bare(" ".join(f'"{w},' for w in words))).all()
    assert len(spot_signatures.fingerprint("|| !! --", NONE)) > 0


def test_common_words_are_counted_over_all_rows(spark, monkeypatch):
    monkeypatch.setattr(spot_signatures, "COUNTED", 50)
    rows = [("The, the the " + f"w{k} " * 3 + ("often " if k % 2 else "") + ('"rare"' if k % 50 == 0 else ""),) for k in range(500)] + [(None,), ("",)]
    found = spot_signatures.common_words(spark.createDataFrame(rows, "text string").repartition(4))
    assert found[:3].tolist() == hashes("the", "often", "rare").tolist() and len(found) == spot_signatures.COMMON


def test_chains_follow_anchors():
    """One anchor, no line but the first: two signatures, whatever stands behind the chain."""
    common = hashes("the", "of")
    short = spot_signatures.fingerprint("the of stone river", common)
    assert len(short) == 3  # behind the line's start, "the" and "of"
    assert set(short) <= set(spot_signatures.fingerprint("the of stone river cloud window paper", common))
