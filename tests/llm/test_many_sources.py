"""More sources than one schedule takes: weights of the small ones hold."""

from placemetrics.llm import pfair_mixing


def test_pooled_sources_get_their_weights(spark, monkeypatch):
    monkeypatch.setattr(pfair_mixing, "MAX_SOURCES", 6)
    monkeypatch.setattr(pfair_mixing, "BLOCK_DOCS", 1)
    counts = {f"big{k}": 4500 for k in range(5)} | {f"s{k:02}": 500 for k in range(40)}
    weights = {s: 1.0 for s in counts} | {"s07": 10.0, "s19": 5.0}
    rows = [(k, s) for s, n in counts.items() for k in range(n)]
    docs = spark.createDataFrame([(n, s) for n, (_, s) in enumerate(rows)], "doc_id bigint, source string")
    got = pfair_mixing.mixed(docs, weights).toPandas()
    assert len(got) == len(rows) and sorted(got.slot) == list(range(len(rows)))
    assert ((got.release <= got.slot) & (got.slot < got.deadline)).all()
    for s, n in counts.items():
        assert sorted(got[got.source == s].source_block) == list(range(n))
    first = got[got.slot < 1024].groupby("source").size()
    total = sum(weights.values())
    for s, w in (("s07", 10.0), ("s19", 5.0)):
        assert abs(first[s] - 1024 * w / total) < 0.2 * 1024 * w / total
