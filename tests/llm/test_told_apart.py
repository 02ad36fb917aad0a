"""Keys and words whose short hashes agree are still told apart; ablations of all policies in one query."""

import duckdb
import numpy as np

from placemetrics.llm import line_index, rule_ledger
from placemetrics.llm.common import mix, word_hashes

MASK = (1 << 64) - 1


def unmixed(x):
    """The value that ``mix`` turns into ``x``."""
    for shift, factor in ((31, 0x94D049BB133111EB), (27, 0xBF58476D1CE4E5B9), (30, None)):
        y = x
        for _ in range(64 // shift + 1):
            y = x ^ (y >> shift)
        x = y * pow(factor, -1, 1 << 64) & MASK if factor else y
    return x


def test_keys_equal_in_their_64_bits_keep_their_own_counts():
    assert int(mix(np.array([unmixed(12345)], np.uint64))[0]) == 12345
    rng = np.random.default_rng(8)
    halves = [int(x) for x in rng.integers(0, 1 << 62, 50)]
    low = np.array([(unmixed(x ^ top) - 1) & MASK for x in halves for top in (0, 1 << 63)], np.uint64).view(np.int64)
    high = np.full(100, 99, np.int64)
    assert len(np.unique(line_index.PerfectHash.join(high, low))) == 50
    shard = line_index.Shard(high, low, np.arange(1, 101))
    assert (shard.lookup(high, low) == np.arange(1, 101)).all()
    assert (shard.lookup(high + 1, low) == 0).all()


def test_long_words_of_two_letters_differ():
    word = "a"
    for _ in range(12):
        word += word.translate(str.maketrans("ab", "ba"))
        other = word.translate(str.maketrans("ab", "ba"))
        a, b, c = word_hashes(f"{word} {other} {word.upper()}".encode())
        assert a != b and a == c


def test_ablations_of_all_policies(spark, folder, empty_folder):
    got = rule_ledger.rule_ablations(spark, folder)
    sql = duckdb.connect()
    sql.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
    expected = sql.sql(rule_ledger.ABLATIONS_SQL)
    assert sorted(tuple(r) for r in got.select(expected.columns).collect()) == sorted(expected.fetchall())
    assert got.count() == sum(len(p.rules) for p in rule_ledger.POLICIES.values())
    assert rule_ledger.rule_ablations(spark, empty_folder).count() == 0
