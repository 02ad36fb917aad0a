"""The order of the mix in the sequences that the pipeline writes."""

import corpus_pipeline
from placemetrics.llm import pfair_mixing, swap_packing


def test_first_sequences_have_the_target_shares(spark, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "MIXED_TOKENS", 10_000)
    monkeypatch.setattr(pfair_mixing, "BLOCK_DOCS", 1)  # several whole frames of a small table
    rows = [(k, ("big", "mid", "small")[(k % 16 > 9) + (k % 16 > 14)], f"word{k} " * 30) for k in range(4800)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    got = corpus_pipeline.packing(spark, docs, "").toPandas()
    assert len(got) == len(rows) and sorted(got.sequence_id.unique()) == list(range(got.sequence_id.nunique()))
    got["source"] = got.doc_id.map(dict((r[0], r[1]) for r in rows))
    counts = {"big": 3000, "mid": 1500, "small": 300}
    target = {s: n**pfair_mixing.TEMPERING for s, n in counts.items()}
    first = got[got.sequence_id < got.sequence_id.nunique() // 4].groupby("source")["length"].sum()
    for s in counts:  # until a source ends, shares follow the weights and not the rows
        assert abs(first[s] / first.sum() - target[s] / sum(target.values())) < 0.06


def test_sequences_follow_the_order(spark):
    rows = spark.createDataFrame([(k, 0, 0, 100 + 37 * k % 900, k, k // 4) for k in range(3000)],
                                 "doc_id bigint, piece int, start long, length long, ids_crc32 long, slot long")
    got = swap_packing.packed(rows, 4096, 50_000, "slot").toPandas()
    assert len(got) == 3000 and "slot" not in got and got.groupby("sequence_id")["length"].sum().max() <= 4096
    assert got["sequence_id"].nunique() <= -(-got["length"].sum() // 4096) + 2
    means = got.groupby("sequence_id")[["doc_id", "length"]].apply(lambda g: (g.doc_id // 4 * g.length).sum() / g.length.sum())
    assert means.is_monotonic_increasing
