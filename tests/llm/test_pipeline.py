"""The pipeline's stages on the odd rows, each against what it should keep."""

import corpus_pipeline
from placemetrics.llm import lsh_forest, swap_packing
from placemetrics.llm.common import stored


def test_stages(spark, folder, odd_rows):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(stored(stage(spark, tables[-1], folder), name))
    good, clean, single, mixed, packed = tables[1:]
    for table in (good, clean, single, mixed):
        assert table.dtypes == docs.dtypes
    assert good.exceptAll(docs).isEmpty()
    assert clean.count() == good.count() and clean.filter("lower(text) like '%shared line here%'").isEmpty()
    assert clean.filter("n_chars <> length(text)").isEmpty()
    assert single.exceptAll(clean).isEmpty()
    rows = lsh_forest.near_duplicates(clean)
    assert single.filter("doc_id is not null").select("doc_id").distinct().count() == rows.filter("kept and doc_id is not null").select("doc_id").distinct().count()
    assert lsh_forest.near_duplicates(single).filter("not kept").isEmpty()
    assert mixed.exceptAll(single).isEmpty() and mixed.count() == single.count()
    pieces = swap_packing.pieces(mixed).select("doc_id", "piece", "start", "length", "ids_crc32")
    assert packed.select(pieces.columns).exceptAll(pieces).isEmpty() and packed.count() == pieces.count()


def test_empty_tables(spark, empty_folder):
    assert corpus_pipeline.run(spark, empty_folder).collect() == []


def test_extra_columns_with_clashing_names_are_carried(spark, odd, folder):
    from pyspark.sql import functions as F

    names = ["score", "n_lines", "n_dropped", "slot", "place", "row", "kept_id", "component_id"]
    wide = odd.select("*", *[F.lit(f"old {n}").alias(n) for n in names])
    docs = wide
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, folder), name)
        assert docs.dtypes == wide.dtypes
    assert docs.count() == docs.filter(" and ".join(f"{n} = 'old {n}'" for n in names)).count() > 0
