"""Operators 11 to 13 against brute force, on small blocks, copies, nulls and clashing columns."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from placemetrics.llm import bitmap_manifest, catalogue, host_reputation, weighted_whitening

LOWER = str.maketrans(bitmap_manifest.UPPER, bitmap_manifest.LOWER)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row, text):
    values = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][k : k + 8])) for k in range(0, len(levels[-1]), 8)])
    return levels


def brute_manifest(rows):
    groups = {}
    for row in rows:
        leaf = leaf_of(row, row["text"])
        hit = row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 3 == 0
        other = leaf_of(row, row["text"].translate(LOWER)) if hit and row["text"] is not None else leaf
        groups.setdefault(row["lang"], []).append((row["doc_id"], leaf, other))
    langs = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for lang in langs:
        groups[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees[lang] = tree_of([leaf for _, leaf, _ in groups[lang]])
    top = tree_of([trees[lang][-1][0] for lang in langs])
    out = []
    for number, lang in enumerate(langs):
        for place, (doc_id, leaf, other) in enumerate(groups[lang]):
            proof, here = "", other
            for levels, at in ((trees[lang], place), (top, number)):
                for level in levels[:-1]:
                    first = at - at % 8
                    run = level[first : first + 8]
                    proof += "".join(run[: at - first] + run[at - first + 1 :])
                    here = sha("".join([*run[: at - first], here, *run[at - first + 1 :]]))
                    at //= 8
            root = top[-1][0]
            out.append((doc_id, leaf, trees[lang][-1][0], root, sha(proof), here, here == root))
    return sorted(map(repr, out))


@pytest.mark.parametrize(("at_once", "rows_per_range", "copies"), [(4, None, 10_000), (1, 7, 2)])
def test_op11_is_the_brute_force_tree(spark, odd, monkeypatch, at_once, rows_per_range, copies):
    monkeypatch.setattr(bitmap_manifest, "COPIES", copies)
    if rows_per_range:
        plain = bitmap_manifest.total_before
        monkeypatch.setattr(bitmap_manifest, "total_before", lambda *a: plain(*a, rows=rows_per_range))
    extra = spark.createDataFrame(
        [(i, f"Text {i} A", "xx", "s", 8) for i in (-1, -64, -65, 2**62, 2**62 + 1, 63, 64, 1 << 40)] + [(5, "Same", "xx", "s", 4)] * 23,
        "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs = odd.unionByName(extra).withColumns({c: F.lit("old") for c in ("word", "leaf", "pos", "tree", "first", "n", "total", "node")})
    mine = sorted(repr(tuple(r)) for r in bitmap_manifest.manifest(docs, at_once).collect())
    assert mine == brute_manifest([r.asDict() for r in docs.collect()])


def test_op11_depth():
    assert [bitmap_manifest.depth(n) for n in (0, 1, 2, 8, 9, 64, 65)] == [0, 0, 1, 1, 2, 2, 3]


URLS = [None, "", "no scheme", "http://", "https://WWW.Example.com/en/1", "http://example.com/en/1", "http://a.example.com/en", "http://com",
        "http://com/", "http://x.net/es/1?a=http://y", "http://x.net/FR/1", "http://x.net/fr/", "http://notexample.com/en/2#x", "a://b://c/d?e#f",
        "http://u@h.co.uk:80/x/7.html", "http://1.2.3.4/en/3", "http://[::1]/en/4", "HTTP://ÄÉ.Org/ü", "http://ends.com./en/5/"]


@pytest.fixture(scope="module")
def urls(spark, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("urls"))
    draw = random.Random(5)
    rows = list(enumerate(URLS)) + [(3, URLS[4]), (None, URLS[5])]
    rows += [(1000 + k, f"http://h{draw.randrange(30)}.{draw.choice(['good', 'bad', 'mixed'])}.org/en/{k}") for k in range(900)]
    bad = [k for k in range(900) if "bad" in rows[len(URLS) + 2 + k][1] and k % 10]
    rows += [(5000 + k, f"http://hot.bad.org/en/{bad[k % len(bad)]}") for k in range(500)]
    rows += [(9000, "http://fresh.bad.org/x"), (9001, "http://fresh.good.org/x")]
    spark.createDataFrame([(i, u, "<html>", "old", "old") for i, u in rows], "page_id bigint, url string, html string, host string, rate string"
                          ).write.parquet(f"{where}/pages.parquet")
    labels = [(k, None if k % 7 == 0 else int(k not in bad), 0) for k in range(900)] + [(1, 0, 0), (1, 1, None), (None, 1, 0)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return where, rows, labels


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.partition("://")[2]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    tail = rest[end:]
    return rest[:end].translate(LOWER), tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]


def test_op12_rules_are_the_longest_that_fit(spark, urls):
    where, rows, _ = urls
    rules = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}
    mine = sorted(map(repr, [(r.page_id, r.host, r.path, r.rule) for r in catalogue.QUERIES["op12_host_reputation"](spark, where).collect()]))
    expected = []
    for page_id, url in rows:
        host, path = plain_parts(url)
        fits = [r for r in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.partition("/")[2])]
        expected.append((page_id, host, path, max(fits, key=len, default=None)))
    assert mine == sorted(map(repr, expected))


@pytest.mark.parametrize("heavy", [1e-4, 0.1, 2.0])
def test_op12_blocks_hosts_of_bad_domains_only(spark, urls, monkeypatch, heavy):
    monkeypatch.setattr(host_reputation, "HEAVY", heavy)
    where, rows, _ = urls
    out = catalogue.QUERIES["op12_host_reputation"](spark, where).collect()
    free = [r for r in out if r.rule is None and ".org" in r.host]
    assert len(out) == len(rows)
    assert {r.verdict for r in free if ".bad.org" in r.host} == {"block"}  # a host without pages of its own labelled, too
    assert {r.verdict for r in free if ".good.org" in r.host or ".mixed.org" in r.host} == {"allow"}


def test_op12_posterior_is_the_beta_binomial(spark):
    counts = spark.createDataFrame([("a.x.org", 10, 9), ("b.x.org", 10, 1), ("c.x.org", 0, 0), ("a.y.com", 40, 20)], "host string, n bigint, good bigint")
    rows = {r.host: r for r in host_reputation.shrunk(counts).collect()}

    def kappa(parts):
        noise = sum(q * (1 - q) for _, _, q in parts)
        spread = sum((g - n * q) ** 2 / n for n, g, q in parts)
        share = (spread - noise) / sum((n - 1) * q * (1 - q) for n, _, q in parts)
        return 1000.0 if share <= 0 else min(1000.0, max(1.0, (1 - share) / share))

    q = 0.5
    k = kappa([(20, 10, q), (40, 20, q)])
    org, com = (k * q + 10) / (k + 20), (k * q + 20) / (k + 40)
    k = kappa([(20, 10, org), (40, 20, com)])
    x, y = (k * org + 10) / (k + 20), (k * com + 20) / (k + 40)
    k = kappa([(10, 9, x), (10, 1, x), (40, 20, y)])
    for host, n, good, q in (("a.x.org", 10, 9, x), ("b.x.org", 10, 1, x), ("c.x.org", 0, 0, x), ("a.y.com", 40, 20, y)):
        rate = (k * q + good) / (k + n)
        assert rows[host].rate == pytest.approx(rate)
        assert rows[host].upper == pytest.approx(min(1, rate + 1.645 * math.sqrt(rate * (1 - rate) / (k + n + 1))))


def test_op12_without_labels_allows(spark, urls):
    pages = spark.read.parquet(f"{urls[0]}/pages.parquet")
    none = spark.createDataFrame([], "item bigint, n bigint, good bigint")
    rows = host_reputation.judged(pages, none, F.lit(1).cast("bigint")).collect()
    assert len(rows) == len(urls[1]) and {r.verdict for r in rows if r.rule is None} == {"allow"}


def vectors(kind):
    draw = np.random.default_rng(3)
    base = draw.normal(size=(300, 40)) * np.linspace(0.2, 3, 40)
    rows = [(k, base[k].tolist()) for k in range(300)] + [(1000 + k, base[0].tolist()) for k in range(150)]
    odd = [(400, None), (401, []), (402, [1.0] * 39 + [None]), (403, [1.0] * 39 + [math.nan]), (404, [math.inf] + [1.0] * 39), (405, [1.0, 2.0])]
    wide = [(500, [5e9 * (-1) ** k for k in range(40)])] if kind == "wide" else []
    return rows + odd + [(7, base[7].tolist()), (None, base[8].tolist())] + wide


@pytest.mark.parametrize(("kind", "heavy", "weighted"), [("plain", 1e-3, True), ("plain", 0.1, True), ("wide", 0.1, True), ("plain", 2.0, False)])
def test_op13_is_the_brute_force_whitening(spark, monkeypatch, kind, heavy, weighted):
    monkeypatch.setattr(weighted_whitening, "HEAVY", heavy)
    monkeypatch.setattr(weighted_whitening, "VALUES", 200)
    rows = vectors(kind)
    table = spark.createDataFrame([(i, v, "old", "old") for i, v in rows], "vec_id bigint, embedding array<double>, key string, x string")
    out = weighted_whitening.whitened(table.repartition(5), weighted=weighted).collect()
    usable = [(i, [math.floor(64 * c) + 1000000 for c in v]) for i, v in rows if v and len(v) == 40 and all(c is not None and math.isfinite(c) for c in v)]
    fit = [x for _, x in usable] if weighted else [list(x) for x in {tuple(x) for _, x in usable}]
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    apart = np.array([[float(c - s // n) - (s % n) / n for c, s in zip(x, sums, strict=True)] for x in fit])
    covariance = apart.T @ apart / n
    values = np.linalg.eigvalsh(covariance)[::-1]
    found = {}
    for r in out:
        found.setdefault(r.vec_id, []).append(r)
    assert sorted(map(repr, found)) == sorted({repr(i) for i, _ in usable})
    # beside one vector of 2^37 no other component is above rounding error
    shown = 32 if kind == "plain" else 1
    assert len(out) == len(usable) * shown and {r.component for r in out} == set(range(1, shown + 1))
    for i, x in usable:
        deviation = sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True))
        for r in found[i]:
            assert r.n == n and int(r.deviation) == deviation
            assert r.explained == pytest.approx(values[r.component - 1] / np.trace(covariance), rel=1e-4)
            assert r.identity_error <= 1e-4
    if kind == "plain":
        vector = np.array([r.whitened for r in sorted(found[3], key=lambda r: r.component)])
        _, axes = np.linalg.eigh(covariance)
        mine = np.array([float(c) - s / n for c, s in zip(dict(usable)[3], sums, strict=True)]) @ axes[:, ::-1][:, :32] / np.sqrt(values[:32])
        assert np.abs(vector) == pytest.approx(np.abs(mine), abs=1e-6)


def test_op13_equal_vectors_have_no_component(spark):
    same = spark.createDataFrame([(k, [1.0, 2.0]) for k in range(5)], "vec_id bigint, embedding array<float>")
    assert weighted_whitening.whitened(same).collect() == []
    one = spark.createDataFrame([(1, [1.0, 2.0]), (2, [2.0, 4.0])], "vec_id bigint, embedding array<float>")
    assert [(r.component, round(abs(r.whitened), 9)) for r in weighted_whitening.whitened(one).collect()] == [(1, 1.0), (1, 1.0)]
