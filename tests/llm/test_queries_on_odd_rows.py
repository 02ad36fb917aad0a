"""Every registered text query on nulls, empty, long and repeated rows, and on empty tables."""

import hashlib
import re
import string
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from placemetrics.llm import catalogue, lsh_forest, spot_signatures, suffix_dedup, swap_packing
from placemetrics.llm import common as common_module

SPACES = re.compile(r"[^\x20\x09-\x0D]+")


def collect(spark, folder, name):
    return [tuple(r) for r in catalogue.QUERIES[name](spark, folder).collect()]


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_empty_tables_give_no_rows(spark, empty_folder, name):
    assert catalogue.QUERIES[name](spark, empty_folder).collect() == []


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_sql_counterparts_agree(spark, folder, name):
    con = duckdb.connect()
    for table in ("documents", "labels", "pages"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    mine = catalogue.QUERIES[name](spark, folder)
    theirs = con.sql(catalogue.SQL[name])
    columns = sorted(mine.columns)
    assert columns == sorted(theirs.columns)
    left = sorted(map(repr, map(tuple, mine.select(columns).collect())))
    right = sorted(map(repr, theirs.select(", ".join(columns)).fetchall()))
    assert left == right


def test_op1_scores_every_row(spark, folder, odd_rows):
    rows = collect(spark, folder, "op1_quality_gam")
    assert Counter(r[0] for r in rows) == Counter(i for i, _ in odd_rows)
    for doc_id, held, score, predicted, *_ in rows:
        assert held == (zlib.crc32(str("" if doc_id is None else doc_id).encode()) % 5 == 0)
        assert 0 <= score <= 1 and predicted == int(score >= 0.3)


def bare(word):
    return word.strip(string.punctuation) or word


def one_hash(word):
    return int(common_module.word_hashes(word.encode())[0])


def plain_common(texts):
    """Hashes of the words most texts have, by counting sets of words."""
    counts = Counter(w for t in texts for w in {bare(w) for w in words(t)})
    ranked = sorted(((-n, np.uint64(one_hash(w)).astype(np.int64)) for w, n in counts.items()))
    return [int(np.int64(h).astype(np.uint64)) for _, h in ranked[: spot_signatures.COMMON]]


def plain_fingerprint(text, common):
    """Signatures word by word, from the definition alone."""
    found, stop, anchors, chain = set(), set(common), set(common[: spot_signatures.ANCHORS]), spot_signatures.CHAIN
    lines, all_words = [words(line) for line in text.split("\n")], words(text)
    if not all_words:
        return np.zeros(0, np.uint32)
    starts, n = {0}, 0
    for line in lines:
        starts.add(n)
        n += len(line)
    hashes, bares = [one_hash(w) for w in all_words], [one_hash(bare(w)) for w in all_words]
    content = [k for k in range(n) if bares[k] not in stop] or list(range(n))
    chosen = [b in anchors for b in bares]
    if sum(chosen) * spot_signatures.SPARSE < n:
        chosen = [c or b % spot_signatures.EVERY == 0 for c, b in zip(chosen, bares, strict=True)]
    places, mask = [int(x) for x in common_module._PLACES], (1 << 64) - 1
    heads = [(hashes[k], [c for c in content if c > k]) for k in range(n) if chosen[k]]
    heads += [(int(spot_signatures._LINE), [c for c in content if c >= k]) for k in starts if k < n]
    for head, rest in heads:
        total = head * places[0]
        for k in range(chain):
            total += (hashes[rest[k]] if k < len(rest) else 0) * places[k + 1]
        found.add(int(common_module.mix(np.array([total & mask], np.uint64))[0]) >> 32)
    return np.array(sorted(found), np.uint32)


@pytest.mark.parametrize("ids", ["wide", "null", "equal", "text", "one"])
def test_op2_order_of_unusual_ids(spark, ids):
    """Ids beyond 2^53, null ids only, one id, texts as ids, a single row."""
    made = {"wide": [2**60 + k for k in range(40)], "null": [None] * 5, "equal": [7] * 5, "text": [f"id{k:02}" for k in range(9)], "one": [1]}[ids]
    rows = [(i, f"number {k} of all words " * 5) for k, i in enumerate(made)]
    docs = spark.createDataFrame(rows, f"doc_id {'string' if ids == 'text' else 'bigint'}, text string")
    if ids == "text":
        docs = docs.withColumn("doc_id", F.substring("doc_id", 3, 2).cast("decimal(20,0)"))
        rows = [(int(i[2:]), t) for i, t in rows]
    got = spot_signatures.compared(docs.repartition(3)).collect()
    assert len(got) == len(rows)
    if ids in ("wide", "text", "one"):
        order = sorted(rows, reverse=True)
        expected = {i: order[(k + 1) % len(order)][1] for k, (i, _) in enumerate(order)}
        for r in got:
            text, other = dict(rows)[int(r.doc_id)], expected[int(r.doc_id)]
            new = text[: len(text) - len(text) // 2] + other[: len(text) // 2]
            assert r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()


def test_op2_in_one_partition(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        docs = spark.createDataFrame([(k, f"the text {k} here") for k in range(9)], "doc_id bigint, text string")
        assert spot_signatures.compared(docs).count() == 9
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_op2_edits_and_fingerprints(spark, folder, odd_rows):
    order = sorted(odd_rows, key=lambda r: -r[0] if r[0] is not None else float("inf"))
    rows, common = {}, plain_common([t for _, t in odd_rows])
    for r in spot_signatures.op2_spot_signatures(spark, folder).collect():
        rows.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, rows.values())) == len(odd_rows)
    ids = [i for i, _ in order]
    prints = {}
    for k, (doc_id, text) in enumerate(order):
        for r in rows[doc_id]:
            prints.setdefault(r.n_chars, set())
        following = order[(k + 1) % len(order)]
        if ids.count(doc_id) > 1 or ids.count(following[0]) > 1:
            continue  # the order of rows with one id is open
        text, other = text or "", following[1] or ""
        r = rows[doc_id][0]
        new = text[: len(text) - len(text) // 2] + other[: len(text) // 2]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        a, b, c = (plain_fingerprint(t, common) for t in (text, new, other))
        assert r.fingerprint == spot_signatures.as_text(a) and r.edited_fingerprint == spot_signatures.as_text(b)
        jaccard = lambda x, y: 1.0 if not len(x) and not len(y) else len(set(x) & set(y)) / len(set(x) | set(y))
        assert r.near_edited == pytest.approx(jaccard(a.tolist(), b.tolist()))
        assert r.near_next == pytest.approx(jaccard(a.tolist(), c.tolist()))
    assert rows[50][0].fingerprint == rows[53][0].fingerprint


def removed_by_brute_force(rows, width):
    seen = Counter()
    for _, data in rows:
        seen.update(data[p : p + width] for p in range(len(data) - width + 1))
    out = []
    for doc_id, data in rows:
        marks = np.zeros(len(data) + 1, int)
        for p in range(len(data) - width + 1):
            if seen[data[p : p + width]] > 1:
                marks[p] += 1
                marks[p + width] -= 1
        hit = np.cumsum(marks)[:-1] > 0
        kept = bytes(np.frombuffer(data, np.uint8)[~hit])
        out.append((doc_id, len(data), int(hit.sum()), int((np.diff(np.r_[0, hit.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("crowded", [4096, 1])
def test_op3_removes_what_brute_force_removes(spark, folder, odd_rows, monkeypatch, crowded):
    monkeypatch.setattr(suffix_dedup, "CROWDED", crowded)
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 20_000)
    expected = removed_by_brute_force([(i, (t or "").encode()) for i, t in odd_rows], 400)
    assert Counter(collect(spark, folder, "op3_suffix_dedup")) == expected
    assert sum(r[2] for r in expected) > 0


def words(text):
    return [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in SPACES.findall(text or "")]


def test_op4_components_are_exact(spark, folder, odd_rows):
    sets = defaultdict(list)
    for doc_id, text in odd_rows:
        w = words(text)
        sets[doc_id].append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    ids = [i for i in sets if i is not None]
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and any(x and 100 * len(x & y) >= 85 * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    rows = collect(spark, folder, "op4_lsh_forest")
    assert len(rows) == len(odd_rows)
    for doc_id, n, component, kept in rows:
        assert n in [len(s) for s in sets[doc_id]]
        if doc_id is None:
            assert kept and component is None
        else:
            assert component == find(doc_id) and kept == (component == doc_id)


def test_op5_pieces_are_the_documents(spark, folder, odd_rows):
    rows = swap_packing.op5_swap_packing(spark, folder).collect()
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(swap_packing.tokenizer_path())
    expected = Counter()
    for doc_id, text in odd_rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        for n, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            expected[doc_id, n, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter(tuple(r)[:5] for r in rows) == expected
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for members in bins.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(bins) == -(-sum(r.length for r in rows) // 4096)


def test_op7_predicts_every_row(spark, folder, odd_rows):
    rows = collect(spark, folder, "op7_kernel_langid")
    assert Counter(r[0] for r in rows) == Counter(i for i, _ in odd_rows)
    by_id = {r[0]: r for r in rows}
    assert by_id[40][2:] == ("und", 0.0) and by_id[42][2] == "und" and by_id[1][2] in ("en", "de")
    assert all(0 <= r[3] <= 1 and r[1] == (zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 3 == 1) for r in rows)


def test_op8_gives_every_row_one_place(spark, folder, odd_rows):
    rows = collect(spark, folder, "op8_pfair_mixing")
    assert Counter(r[0] for r in rows) == Counter(i for i, _ in odd_rows)
    assert len({(r[4], r[3]) for r in rows}) == len(rows)
    assert all(r[5] <= r[4] < r[6] for r in rows)


def test_op9_keeps_nulls_and_rows(spark, folder, odd_rows):
    rows = collect(spark, folder, "op9_surrogates")
    assert Counter(r[:2] for r in rows) == Counter(odd_rows)  # nothing personal in them


def test_extra_columns_with_clashing_names(spark, odd):
    from placemetrics.llm import line_index, pfair_mixing, quality_gam, surrogates
    names = ["score", "n_lines", "n_dropped", "slot", "place", "n_entities", "row", "key", "bucket", "high", "node"]
    wide = odd.select("*", *[F.lit(f"old {n}").alias(n) for n in names])
    n = wide.count()
    model = quality_gam.fit(np.zeros((0, len(quality_gam.FEATURES))), np.zeros(0))
    assert quality_gam.scored(wide, model).filter("score = 0.5 and bucket = 'old bucket'").count() == n
    assert line_index.dedup_lines(wide).filter("n_lines >= 1 and high = 'old high'").count() == n
    assert pfair_mixing.mixed(wide).filter("slot >= 0 and key = 'old key'").count() == n
    assert surrogates.with_surrogates(wide, "k").filter("n_entities = 0 and row = 'old row'").count() == n
    assert lsh_forest.near_duplicates(wide).count() == n
    assert spot_signatures.compared(wide).count() == n
    assert suffix_dedup.without_repeats(wide).count() == n
    assert swap_packing.pieces(wide).filter("piece = 0").count() == n


def test_word_hashes_follow_words():
    text = "A b\tc\x0bD  é é \x0c z"
    assert len(common_module.word_hashes(text.encode())) == len(words(text))
    assert (common_module.word_hashes(b"THE cat") == common_module.word_hashes(b" the\ncat ")).all()
