"""The parts of the text operators against plain versions."""

import math
import random

import numpy as np
import pytest

from placemetrics.llm import components, induced_sort, kernel_langid, line_index, pfair_mixing, quality_gam, rule_ledger, spot_signatures, surrogates, swap_packing


def brute_suffixes(text):
    def key(i):
        out = []
        for j in range(i, len(text)):
            if text[j] == 0:
                return [*out, (0, j)]
            out.append((int(text[j]), 0))
        return out

    keys = [key(i) for i in range(len(text))]
    order = sorted(range(len(text)), key=keys.__getitem__)
    common = [0]
    for a, b in zip(order, order[1:], strict=False):
        n = 0
        while keys[a][n] == keys[b][n]:
            n += 1
        common.append(n)
    return order, common


@pytest.mark.parametrize("seed", range(60))
def test_induced_sort(seed):
    r = random.Random(seed)
    base = [r.randint(1, r.choice([1, 2, 3, 8])) for _ in range(r.randint(1, 40))]
    parts = [base[r.randrange(len(base)):] + [r.randint(1, 3) for _ in range(r.randint(0, 4))] + [0] for _ in range(r.randint(1, 6))]
    text = np.array([x for p in parts for x in p], np.uint16)
    limit = r.choice([3, 10, 1000])
    order, common = brute_suffixes(text)
    for memory, in_memory in ((64, 0), (64, 2), (1 << 20, 1000)):  # on disk and recursive, or in memory
        with induced_sort.Workspace(memory) as space:
            got, values = induced_sort.suffix_order(text, space, in_memory, limit)
            assert list(got) == order
            inner = [k for k in range(len(text)) if text[order[k]] and (k == 0 or text[order[k - 1]])]
            assert [int(values[k]) for k in inner] == [min(common[k], limit) for k in inner]


def test_perfect_hash_is_minimal_and_perfect():
    rng = np.random.default_rng(3)
    high, low = rng.integers(-(1 << 62), 1 << 62, (2, 5000))
    high[:100] = 7  # one half of the hash in common
    index = line_index.PerfectHash(high, low)
    assert sorted(index.places(high, low)) == list(range(5000))
    shard = line_index.Shard(high, low, np.arange(5000))
    assert (shard.lookup(high, low) == np.arange(5000)).all()

    class Flat(line_index.PerfectHash):
        MAX_LEVELS = 1  # most keys go to the sorted rest

    flat = Flat(high, low)
    assert sorted(flat.places(high, low)) == list(range(5000))
    none = line_index.Shard(high[:0], low[:0], np.zeros(0))
    assert (none.lookup(high[:3], low[:3]) == 0).all()


def test_additive_model_learns_pairs():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)  # no feature tells anything alone
    model = quality_gam.fit(x[:2000], y[:2000])
    assert ((model.scores(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95
    assert model.pairs[0][:2] == (0, 1)
    assert quality_gam.fit(x[:5], np.ones(5)).scores(x[:2]) == pytest.approx([0.99, 0.99])


def test_packing_never_gets_worse_and_keeps_items():
    r = random.Random(2)
    for low, high in ((500, 3000), (1000, 2500), (1, 4096), (2049, 4096)):
        lengths = [r.randint(low, high) for _ in range(400)]
        first = swap_packing.best_fit(lengths, 4096)
        bins = swap_packing.improve([list(b) for b in first], lengths, 4096)
        assert sorted(k for b in bins for k in b) == list(range(400))
        assert len(bins) <= len(first) and max(sum(lengths[k] for k in b) for b in bins) <= 4096
    assert len(swap_packing.pack_group([3, 3, 2, 2, 2], 6)) == 2  # best fit alone needs three


def test_groups_are_packed_again_together(spark):
    rows = spark.createDataFrame([(k, 0, 0, 100 + k % 900, k) for k in range(3000)], "doc_id bigint, piece int, start long, length long, ids_crc32 long")
    got = swap_packing.packed(rows, 4096, 100_000).toPandas()
    assert len(got) == 3000 and got.groupby("sequence_id")["length"].sum().max() <= 4096
    assert got["sequence_id"].nunique() <= -(-got["length"].sum() // 4096) + 2


def test_tokens_equal_the_tokenizer():
    tokens = swap_packing.Tokens(swap_packing.tokenizer_path())
    texts = ["", "a.b", "don't stop, it's. ok,", "x.,", "É, ÀÉ.", "1, 2.", "<|endoftext|> a", "Ünï.\x0bcode", "ΑΣ ΑΣ, σ", "日本, 語.", "'s, 't.", "ab'll, cd", "IİI"]
    assert list(tokens.ids(texts)) == tokens.whole(texts) == list(tokens.ids(texts))


def schedule(spark, blocks, weights):
    rows = pfair_mixing.timetable(spark, [pfair_mixing.phases(blocks, weights)]).collect()
    assert sorted(r.slot for r in rows) == list(range(sum(blocks.values())))
    for s, n in blocks.items():
        assert sorted(r.block for r in rows if r.key == s) == list(range(n))
    assert all(r.release <= r.slot < r.deadline for r in rows)
    return [r.key for r in sorted(rows, key=lambda r: r.slot)]


@pytest.mark.parametrize(("n", "heavy"), [(20, 0.9), (20, 0.0), (256, 0.9), (256, 0.0)])
def test_sources_are_less_than_a_block_from_their_target(spark, n, heavy):
    """At every slot of several frames, against the target weights themselves, while all have blocks."""
    draw = random.Random(n)
    light = [draw.random() ** 3 for _ in range(n)]
    if heavy:
        light[0] = sum(light[1:]) * heavy / (1 - heavy)
    weights = {f"s{k:03}": w for k, w in enumerate(light)}
    total, slots = sum(light), 3000
    blocks = {s: math.ceil(w / total * slots) + 1 for s, w in weights.items()}
    order = schedule(spark, blocks, weights)[:slots]
    share = np.array([w / total for w in weights.values()])
    done, place = np.zeros(n), {s: k for k, s in enumerate(weights)}
    for t, s in enumerate(order, 1):
        done[place[s]] += 1
        assert np.abs(done - t * share).max() < 1 + 1e-6


def test_sources_that_end_leave_their_slots_to_others(spark):
    blocks = {"a": 1, "b": 7, "c": 2000, "d": 300, "e": 1}
    schedule(spark, blocks, {"a": 5.0, "b": 0.001, "c": 1.0, "d": 1.0, "e": 1e-9})
    assert schedule(spark, {"x": 3}, {"x": 2.0}) == ["x"] * 3


def test_tables_of_any_size_have_few_frames():
    plan = pfair_mixing.phases({"big": 3_000_000, "mid": 1_000_000, "small": 50_000}, {"big": 7.0, "mid": 2.5, "small": 0.5})
    assert sum(len(p.frames) for p in plan) <= pfair_mixing.FRAMES + 6
    assert all((q >= 0).all() for p in plan for _, _, q in p.frames)


def test_many_sources_are_pooled_and_weights_hold(spark):
    rows = [(k, f"s{k % 400}" if k % 3 else "big", "t") for k in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    got = pfair_mixing.mixed(docs, {"big": 3.0, "s1": 1.0})
    assert got.count() == 4000 and got.select("slot", "place").distinct().count() == 4000
    assert sorted(r.doc_id for r in pfair_mixing.in_slots(got).collect()) == list(range(4000))


def test_native_operators_have_no_python(spark, odd):
    for plan in (pfair_mixing.mixed(odd), rule_ledger.ledger(odd)):
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert not any(x in text for x in ("Python", "Pandas", "Arrow"))


def test_policies_and_ablations_read_bits(spark):
    docs = spark.createDataFrame([(1, "a " * 100), (2, "#$ " * 60), (3, " ".join(f"w{k}" for k in range(60))), (4, None)], "doc_id int, text string")
    ledger = rule_ledger.ledger(docs)
    policy = rule_ledger.POLICIES["web-1"]
    kept = {r.doc_id: r.kept for r in rule_ledger.apply_policy(ledger, policy).collect()}
    assert kept == {1: False, 2: False, 3: True, 4: False}
    report = {r.rule: (r.n_failed, r.n_only_this) for r in rule_ledger.ablations(ledger, policy).collect()}
    bits = [r.failures for r in ledger.collect()]
    for rule in policy.rules:
        b = rule_ledger.bit(rule)
        assert report[rule] == (sum(x & b != 0 for x in bits), sum(x & policy.mask == b for x in bits))


def test_near_pairs_of_fingerprints(spark):
    rng = random.Random(4)
    sets = []
    for k in range(60):
        base = sets[-1] if k % 3 and sets else [rng.randrange(1 << 30) for _ in range(rng.randint(2, 60))]
        sets.append(sorted({*base[: max(1, len(base) - rng.randint(0, 4))], *(rng.randrange(1 << 30) for _ in range(rng.randint(0, 3)))}))
    sets.append([])
    rows = [(k, spot_signatures.as_text(np.array(s, np.uint32))) for k, s in enumerate(sets)]
    got = {(r.a, r.b): r.likeness for r in spot_signatures.near_pairs(spark.createDataFrame(rows, "doc_id bigint, fingerprint string")).collect()}
    first = {}
    for k, s in enumerate(sets):
        first.setdefault(tuple(s), k)
    expected = {}
    for a in first.values():
        for b in first.values():
            x, y = set(sets[a]), set(sets[b])
            if a < b and x and y and len(x & y) / len(x | y) >= 0.8:
                expected[a, b] = len(x & y) / len(x | y)
    assert got == pytest.approx(expected) and expected


def test_components_match_union_find(spark):
    r = random.Random(9)
    for edges in ([(k, k + 1) for k in range(60)], [(0, k) for k in range(1, 50)], [(r.randrange(80), r.randrange(80)) for _ in range(60)]):
        parent = list(range(100))

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in edges:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
        got = {(n.node, n.component) for n in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
        linked = {n for e in edges if e[0] != e[1] for n in e}
        assert got == {(n, find(n)) for n in linked}


def test_language_model_on_clear_texts():
    texts = {"en": "the river and the bridge over the water of this town", "fr": "la rivière et le pont sur l'eau de cette ville",
             "de": "der fluss und die brücke über das wasser dieser stadt"}
    seen = np.stack([kernel_langid.presence(t * k) for t in texts.values() for k in (1, 2)])
    model = kernel_langid.fit(seen, [x for x in texts for _ in (1, 2)])
    for language, text in texts.items():
        margins = model.margins(kernel_langid.presence(" ".join(text.split()[2:]))[None])
        assert model.languages[int(margins.argmax())] == language
    long = "The river, " * 300_000  # several blocks of characters
    assert (kernel_langid.presence(long) == kernel_langid.presence("The river, the river ")).all()


def test_surrogates_keep_form_and_stay_apart():
    key = b"k" * 32
    text = ("Dr. Maria Lopez met Mr. Smith; Lopez wrote to maria.lopez@mail7.example.com, +1 (974) 555-3436, "
            'card 4417744280351547 at 10.0.0.7 and 97.51.17.173. token = "908038b7daaf91e730d2f64001c52934d43d9336"')
    new, log = surrogates.replaced(text, key)
    kinds = [k for k, _, _ in log]
    assert kinds == ["name", "name", "name", "name", "email", "phone", "card", "ip", "ip", "secret"]
    assert not any(old in new for _, old, _ in log)
    found = dict((old, s) for _, old, s in log)
    assert found["Lopez"] in new and new.count(found["Lopez"]) == 2 and found["Maria"] in surrogates.FIRST_NAMES["latin", "f"]
    assert found["10.0.0.7"].startswith("10.") and found["+1 (974) 555-3436"].startswith("+1 (")
    assert surrogates.replaced(text, key)[0] == new and surrogates.replaced(text, b"j" * 32)[0] != new
    cards = {f"{k:016}": surrogates._card(f"{k:016}", key, "card") for k in range(2000)}
    assert len(set(cards.values())) == 2000
    luhn = lambda d: surrogates._luhn(d[:-1]) == int(d[-1])
    assert all(luhn(a) == luhn(b) for a, b in cards.items())
    assert sorted(surrogates.permuted(k, 1000, key, "x") for k in range(1000)) == list(range(1000))
    assert sorted(surrogates.reformed(f"{k:02}", key, "y") for k in range(100)) == [f"{k:02}" for k in range(100)]


@pytest.mark.parametrize("text, kinds", [
    ("call 555-123-4567 or (555) 123-4567", ["phone", "phone"]), ("id 123-45-6789", ["social"]), ("version 1.2.3 of 2024", []),
    ("DE89 3704 0044 0532 0130 00", ["account"]), ("password: hunter2hunter2", ["secret"]), ("fe80:0:0:0:1:2:3:4", ["ip"]),
    ("Frau Helga Müller", ["name", "name"]), ("Иван Петров", ["name", "name"]), ("the Don said", []), ("", [])])
def test_what_counts_as_personal(text, kinds):
    assert [k for _, _, k, _ in surrogates.entities(text)] == kinds
