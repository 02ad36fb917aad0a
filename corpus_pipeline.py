"""A training corpus from ``documents``: filter, clean, deduplicate, mix and pack.

Each stage takes (spark, docs, sf_dir) and gives a table that is written as Parquet and read
again as the next one's ``docs``.  All but the last keep the columns of ``docs``, whatever their
names; extra columns are carried along.  Null texts count as empty, an empty table gives an
empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placemetrics.llm.common import documents, importable, stored
from placemetrics.llm.line_index import dedup_lines
from placemetrics.llm.lsh_forest import near_duplicates
from placemetrics.llm.pfair_mixing import in_slots, mixed, row_hash
from placemetrics.llm.quality_gam import THRESHOLD, read_labels, scored, train
from placemetrics.llm.swap_packing import MIXED_TOKENS, packed, pieces


def _beside(docs: DataFrame, names: tuple[str, ...], step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``step`` over ``docs``, whose own columns named like the step's are put aside meanwhile."""
    free = {n: f"{n}_" + "_" * max(map(len, docs.columns)) for n in names if n in docs.columns}
    return step(docs.withColumnsRenamed(free)).select(
        *[F.col(f"`{free.get(c, c)}`").alias(c) for c in docs.columns])


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the additive model scores THRESHOLD or more; it learns from ``labels``."""
    importable(spark)
    model = train(docs, read_labels(spark, sf_dir))
    return _beside(docs, ("score",), lambda d: scored(d, model).filter(F.col("score") >= THRESHOLD))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that ten documents or more have; ``n_chars`` follows the text."""
    cleaned = _beside(docs, ("n_lines", "n_dropped"), dedup_lines)
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cleaned


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id; equal rows once."""
    kept = near_duplicates(docs).filter("kept").select(F.col("doc_id").alias("kept_id")).distinct()

    def only_kept(rows: DataFrame) -> DataFrame:
        return rows.join(kept, F.col("doc_id").eqNullSafe(F.col("kept_id")), "left_semi")

    return _beside(docs, ("kept_id",), only_kept).dropDuplicates(["doc_id", "text"])


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, dealt and sorted so that the files hold the sources interleaved by target weight."""
    added = ("source_block", "place", "slot", "release", "deadline")
    return _beside(docs, added, lambda d: in_slots(mixed(d)))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequence and place in it, sequences in the order of the mix.

    Mixing keeps every document, so the slots worked out again are those the files are sorted by.
    """
    own = docs.select("doc_id", "text", "source", row_hash(docs).alias("_hash"), F.monotonically_increasing_id().alias("_row"))
    rows = stored(pieces(own, carried=("source", "_hash", "_row")), "pieces")
    slots = mixed(rows.filter("piece = 0").select("doc_id", "source", "_hash", "_row"), hashed="_hash").select("_row", "slot")
    dealt = stored(rows.join(slots, "_row").drop("source", "_hash", "_row"), "dealt")
    return packed(dealt, group_tokens=MIXED_TOKENS, order="slot")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("source_mixing", source_mixing),
    ("packing", packing),
]

#: The classifier and the tokenizer have no SQL form; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
