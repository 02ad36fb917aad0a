"""Merkle manifest of a dataset, leaves placed by ranks in bitmaps of their ids.

Every group (language) is a tree: its leaves ascend by doc_id, every eight consecutive nodes
become one, until one is left.  Where a leaf stands is a rank query, not a sort: the ids of a
group form a bitmap kept as its non-empty 64-bit words, a directory holds the popcount of all
words before each, and a leaf's place is that count plus the bits below its own.  Places key
slot arrays of 4,096 nodes, each reduced four levels at once.

Defined results: a null id comes first, null languages form a group that comes first, equal
ids follow their leaves' digests and repeated rows follow one another; a null id is never
tampered with; an empty table gives no rows; a lone leaf is its tree's root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placemetrics.llm.common import documents, stored
from placemetrics.operators.joins import join_null_safe
from placemetrics.operators.ordering import total_before

FAN = 8
#: Levels reduced at once, in blocks of FAN to that power.
LEVELS = 4
#: Copies of one row that one step writes out.
COPIES = 10_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PATHS = "tree bigint, pos bigint, node string, path string, subroot string"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_digest(fields: dict[str, Column]) -> Column:
    """Hash of the fields in their order, each with its length ahead; ``-`` for a null."""
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(c.cast("string")), F.lit(":"), c.cast("string")), F.lit("-"))
                             for c in fields.values()]).cast("binary"), 256)


def with_leaves(docs: DataFrame) -> DataFrame:
    """Per row its group ``lang``, doc_id, leaf, and the leaf after tampering where that applies."""
    fields = {c: F.col(c) for c in FIELDS}
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    other = leaf_digest(fields | {"text": F.translate("text", UPPER, LOWER)})
    return docs.select("lang", "doc_id", leaf_digest(fields).alias("leaf"), F.when(hit, other).alias("tampered"))


def id_words(docs: DataFrame) -> DataFrame:
    """The non-empty words of each group's bitmap, and the rows behind each word."""
    return docs.select("lang", "doc_id").groupBy("lang", F.expr("shiftright(doc_id, 6)").alias("word")).agg(
        F.expr("coalesce(bit_or(shiftleft(1L, cast(doc_id & 63 AS int))), 0L)").alias("bits"),
        F.count(F.lit(1)).alias("n"))


def placed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every leaf with its tree and its place in it, and the trees (tree, lang, total).

    A word is crowded if an id in it is null or repeated.  Its rows are added up and ordered
    by id and digest in ranges, so that no group of copies meets in one task.
    """
    words = stored(id_words(docs), "words")
    groups = stored(words.groupBy("lang").agg(F.sum("n").alias("total"), F.lit(1).alias("one")), "groups")
    trees = stored(total_before(groups, "one", "tree", ["lang"]).select(F.col("tree").cast("bigint"), "lang", "total"), "trees")
    directory = total_before(words, "n", "first", ["word"], ["lang"]).withColumn("crowded", F.expr("n > bit_count(bits)"))
    directory = join_null_safe(directory, trees, ["lang"], "inner").drop("n")
    rows = with_leaves(docs).withColumn("word", F.expr("shiftright(doc_id, 6)"))
    ranked = stored(join_null_safe(rows, directory, ["lang", "word"], "inner").select(
        "tree", "total", "crowded", "first", "doc_id", "leaf", "tampered",
        F.expr("first + bit_count(bits & ~shiftleft(-1L, cast(doc_id & 63 AS int)))").alias("pos")), "ranked")
    columns = ["tree", "total", "pos", "doc_id", "leaf", "tampered"]
    leaves = ranked.filter("NOT crowded").select(columns)
    if words.filter("n > bit_count(bits)").isEmpty():
        return leaves, trees
    alike = stored(ranked.filter("crowded").groupBy("tree", "total", "first", "doc_id", "leaf", "tampered")
                   .agg(F.count(F.lit(1)).alias("n")), "alike")
    again = (total_before(alike, "n", "earlier", ["doc_id", "leaf"], ["tree", "first"])
             .withColumn("step", F.explode(F.expr(f"sequence(0L, n - 1, {COPIES}L)")))
             .repartition("tree", "first", "doc_id", "leaf", "step")
             .withColumn("copy", F.explode(F.expr(f"sequence(step, least(step + {COPIES - 1}, n - 1))")))
             .withColumn("pos", F.expr("first + earlier + copy")))
    return leaves.unionByName(again.select(columns)), trees


def depth(total: int) -> int:
    """Levels above the leaves of a tree."""
    levels = 0
    while total > 1:
        total, levels = -(-total // FAN), levels + 1
    return levels


def reduced(nodes: list[str], total: int, at_once: int) -> list[list[str]]:
    """The levels of one block, its own nodes first; all that are left if the tree has no more."""
    levels = [nodes]
    for _ in range(min(at_once, depth(total))):
        below = levels[-1]
        levels.append([digest("".join(below[k : k + FAN])) for k in range(0, len(below), FAN)])
    return levels


def slots(table: pa.Table, column: str) -> tuple[pa.Table, list[str]]:
    """The rows of a block in the order of their slots, and their nodes."""
    table = table.sort_by("pos")
    return table, table.column(column).to_pylist()


def lines_of(levels: list[list[str]]) -> Iterator[list[str]]:
    """For every node of a block the runs above it, siblings around a star for the node itself."""
    cut = [[(("".join(level[k - k % FAN : k])), "".join(level[k + 1 : k - k % FAN + FAN])) for k in range(len(level))]
           for level in levels[:-1]]
    for k in range(len(levels[0])):
        yield ["*".join(pairs[k // FAN**up]) for up, pairs in enumerate(cut)]


def _risen(table: pa.Table, at_once: int) -> pa.Table:
    tree, total, pos = (table.column(c)[0].as_py() for c in ("tree", "total", "pos"))
    table, nodes = slots(table, "node")
    return pa.table({"tree": pa.array([tree], pa.int64()), "total": pa.array([-(-total // FAN**at_once)], pa.int64()),
                     "pos": pa.array([pos // FAN**at_once], pa.int64()), "node": [reduced(nodes, total, at_once)[-1][0]]})


def climbed(nodes: DataFrame, most: int, at_once: int) -> list[DataFrame]:
    """Tables of nodes (tree, total, pos, node), from the given one to one node per tree.

    ``most`` is the number of nodes of the largest tree; each step divides it by a block's.
    """
    block = FAN**at_once
    tables = [nodes]
    while True:
        last = tables[-1].select("tree", "total", "pos", "node")
        tables.append(stored(last.groupBy("tree", F.expr(f"pos div {block}")).applyInArrow(
            lambda t: _risen(t, at_once), "tree bigint, total bigint, pos bigint, node string"), "nodes"))
        most = -(-most // block)
        if most <= 1:
            return tables


def _paths(own: pa.Table, above: pa.Table, at_once: int) -> pa.Table:
    """Per node of a block its runs up to the root."""
    own, nodes = slots(own, "node")
    rest, root = (above.column(c)[0].as_py() for c in ("path", "subroot"))
    paths = ["".join(f"{line}\n" for line in lines) + rest for lines in lines_of(reduced(nodes, own.column("total")[0].as_py(), at_once))]
    return pa.table({"tree": own.column("tree"), "pos": own.column("pos"), "node": nodes, "path": paths,
                     "subroot": pa.array([root] * len(nodes), pa.string())})


def _proofs(own: pa.Table, above: pa.Table, at_once: int) -> pa.Table:
    """Per leaf of a block the hash of its siblings and the root folded from them."""
    own, nodes = slots(own, "node")
    rest, root = (above.column(c)[0].as_py() for c in ("path", "subroot"))
    upper = rest.split("\n")[:-1]
    siblings = "".join(upper).replace("*", "")
    proofs, folded = [], []
    tampered = own.column("tampered").to_pylist()
    for leaf, other, lines in zip(nodes, tampered, lines_of(reduced(nodes, own.column("total")[0].as_py(), at_once)), strict=True):
        proofs.append(digest("".join(lines).replace("*", "") + siblings))
        here = other or leaf
        for line in lines:
            here = digest(line.replace("*", here))
        for line in upper:
            here = digest(line.replace("*", here))
        folded.append(here)
    return pa.table({"doc_id": own.column("doc_id"), "leaf": nodes, "subroot": pa.array([root] * len(nodes), pa.string()),
                     "proof_sha256": proofs, "folded_root": folded})


def descended(tables: list[DataFrame], above: DataFrame, at_once: int) -> DataFrame:
    """``above`` for the nodes of ``tables[0]``: per block of it (tree, block) the path from there on."""
    for nodes in tables[:0:-1]:
        above = _met(nodes, above, _paths, PATHS, at_once).withColumnRenamed("pos", "block")
    return above


def _met(nodes: DataFrame, above: DataFrame, step: Callable[..., pa.Table], schema: str, at_once: int) -> DataFrame:
    blocks = nodes.withColumn("block", F.expr(f"pos div {FAN**at_once}"))
    return blocks.groupBy("tree", "block").cogroup(above.groupBy("tree", "block")).applyInArrow(
        lambda own, upper: step(own, upper, at_once), schema)


def manifest(docs: DataFrame, at_once: int = LEVELS) -> DataFrame:
    """Per row: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    One shuffle brings digests and bitmap words together, two more the nodes of a block;
    texts stay where they are read.  The driver sees the number of languages, the largest
    tree's size and the root.
    """
    leaves, trees = placed(docs)
    leaves = stored(leaves.withColumnRenamed("leaf", "node"), "leaves")
    n_trees, most = trees.agg(F.count(F.lit(1)), F.max("total")).first()
    tables = climbed(leaves, most or 0, at_once)
    subroots = tables[-1].select(F.lit(0).cast("bigint").alias("tree"), F.lit(n_trees).cast("bigint").alias("total"),
                                 F.col("tree").alias("pos"), "node")
    forest = climbed(subroots, n_trees, at_once)
    top = forest[-1].select("tree", F.lit(0).cast("bigint").alias("block"), F.lit("").alias("path"), F.lit("").alias("subroot"))
    roots = _met(forest[0], descended(forest[:-1], top, at_once), _paths, PATHS, at_once)
    above = stored(roots.select(F.col("pos").alias("tree"), F.lit(0).cast("bigint").alias("block"), "path",
                                F.col("node").alias("subroot")), "roots")
    root = forest[-1].first()
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = _met(tables[0], descended(tables[:-1], above, at_once), _proofs,
                f"doc_id {id_type}, leaf string, subroot string, proof_sha256 string, folded_root string", at_once)
    whole = F.lit(root.node if root else None).cast("string")
    return rows.select("doc_id", "leaf", "subroot", whole.alias("root"), "proof_sha256", "folded_root",
                       (F.col("folded_root") == whole).alias("verified"))


def op11_bitmap_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return manifest(documents(spark, folder))


_BYTES = "list_transform(string_split(cast(doc_id AS varchar), ''), lambda c: ascii(c)::bigint)"
_CRC = f"""xor(list_reduce([4294967295::bigint] || {_BYTES}, lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)), 4294967295)"""
_FIELD = "coalesce(octet_length(encode({0}::varchar)) || ':' || {0}, '-')"


def _sql_leaf(text: str) -> str:
    return f"sha256({' || '.join(_FIELD.format(c) for c in (*FIELDS[:-1], text))})"


OP11_SQL = f"""
WITH RECURSIVE hashed AS (
  SELECT lang, doc_id, {_sql_leaf('text')} AS leaf,
    CASE WHEN {_CRC} % 3 = 0 THEN {_sql_leaf(f"translate(text, '{UPPER}', '{LOWER}')")} END AS tampered
  FROM documents),
leaves AS (
  SELECT dense_rank() OVER (ORDER BY lang NULLS FIRST) AS tree, doc_id, leaf, tampered,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
    count(*) OVER (PARTITION BY lang) AS total
  FROM hashed),
nodes AS (
  SELECT tree, 0 AS lvl, pos, leaf AS node, total FROM leaves
  UNION ALL
  SELECT tree, lvl + 1, pos // 8, sha256(string_agg(node, '' ORDER BY pos)), (any_value(total) + 7) // 8
  FROM nodes WHERE total > 1 GROUP BY tree, lvl, pos // 8),
subroots AS (SELECT tree, lvl AS depth, node FROM nodes WHERE total = 1),
tops AS (
  SELECT 0 AS lvl, tree - 1 AS pos, node, (SELECT count(*) FROM subroots) AS total FROM subroots
  UNION ALL
  SELECT lvl + 1, pos // 8, sha256(string_agg(node, '' ORDER BY pos)), (any_value(total) + 7) // 8
  FROM tops WHERE total > 1 GROUP BY lvl, pos // 8),
steps AS (
  SELECT l.tree, l.pos AS leaf_pos, n.lvl, n.pos, n.node, n.pos = l.pos // (8 ** n.lvl)::bigint AS own
  FROM leaves l JOIN nodes n ON n.tree = l.tree AND n.total > 1
    AND n.pos // 8 = l.pos // (8 ** (n.lvl + 1))::bigint
  UNION ALL
  SELECT l.tree, l.pos, s.depth + n.lvl, n.pos, n.node, n.pos = (l.tree - 1) // (8 ** n.lvl)::bigint
  FROM leaves l JOIN subroots s USING (tree) JOIN tops n ON n.total > 1
    AND n.pos // 8 = (l.tree - 1) // (8 ** (n.lvl + 1))::bigint),
proofs AS (
  SELECT tree, leaf_pos, sha256(coalesce(string_agg(node, '' ORDER BY lvl, pos) FILTER (NOT own), '')) AS proof
  FROM steps GROUP BY tree, leaf_pos),
folds AS (
  SELECT tree, pos AS leaf_pos, 0 AS lvl, coalesce(tampered, leaf) AS here FROM leaves
  UNION ALL
  SELECT f.tree, f.leaf_pos, f.lvl + 1, sha256(string_agg(CASE WHEN own THEN here ELSE node END, '' ORDER BY s.pos))
  FROM folds f JOIN steps s ON s.tree = f.tree AND s.leaf_pos = f.leaf_pos AND s.lvl = f.lvl
  GROUP BY f.tree, f.leaf_pos, f.lvl),
folded AS (SELECT tree, leaf_pos, arg_max(here, lvl) AS folded_root FROM folds GROUP BY tree, leaf_pos),
whole AS (SELECT node AS root FROM tops WHERE total = 1)
SELECT doc_id, leaf, s.node AS subroot, root, coalesce(proof, sha256('')) AS proof_sha256, folded_root,
  folded_root = root AS verified
FROM leaves l JOIN subroots s USING (tree) CROSS JOIN whole
JOIN folded f ON f.tree = l.tree AND f.leaf_pos = l.pos
LEFT JOIN proofs p ON p.tree = l.tree AND p.leaf_pos = l.pos
"""
