import pytest

WORDS = ("the of and river stone cloud window paper garden silver yellow quiet engine market bridge "
         "winter summer letter number forest island candle mirror basket").split()


def prose(seed: int, n: int) -> str:
    """Deterministic words, some of them common, no two seeds alike."""
    out, x = [], seed * 7919 + 13
    for k in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[x % len(WORDS)] if x % 3 else f"w{x % 5000}")
        if k % 11 == 10:
            out[-1] += ".\n" if k % 2 else ","
    return " ".join(out)


@pytest.fixture(scope="session")
def odd_rows():
    """(doc_id, text): nulls, empty and very long texts, copies, ties, repeated rows, odd spaces."""
    base = prose(1, 120)
    rows = [(k, prose(k + 10, 40 + 7 * k)) for k in range(30)]
    rows += [(40, None), (41, ""), (42, "   \n\t \n"), (43, "one"), (44, "One  two\tthree"), (45, "one two THREE")]
    rows += [(50 + k, base) for k in range(4)] + [(60 + k, base + f" tail{k}") for k in range(4)]
    rows += [(70, prose(99, 30_000)), (71, "x" * 50_000), (72, "ha " * 3000), (73, "line\n" * 400)]
    rows += [(80 + k, f"{prose(200 + k, 30)}\n Shared LINE here \n{prose(300 + k, 20)}") for k in range(12)]
    rows += [(100, "é ü ß 日本語 語   x\x0by\x0cz"), (101, prose(5, 60)), (101, prose(5, 60)), (102, "a b c d e f"), (102, "g h i j k l"),
             (None, "no id here"), (None, None)]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The odd rows with the other columns of documents, all null in places."""
    rows = [(i, t, [None, "en", "de"][k % 3], [None, "hot", "hot", "s1"][k % 4], None if t is None else len(t))
            for k, (i, t) in enumerate(odd_rows)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")


@pytest.fixture(scope="session")
def folder(spark, odd, tmp_path_factory):
    """The odd rows and labels as a table folder."""
    where = str(tmp_path_factory.mktemp("tables"))
    odd.write.parquet(f"{where}/documents.parquet")
    labels = [(k, int(k % 3 != 0), 0) for k in range(0, 75)] + [(None, 1, 0), (3, None, None), (3, 1, 0), (999, 0, 0)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    pages = [(k, f"http://h{k % 9}.d{k % 4}.org/en/{k}") for k in range(60)] + [(3, "http://www.example.com/en/1"), (None, None), (4, "")]
    spark.createDataFrame(pages, "page_id bigint, url string").write.parquet(f"{where}/pages.parquet")
    vectors = [(k, [float(k % 5), float(k * k % 7), k / 3]) for k in range(40)] + [(None, None), (7, [])]
    spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>").write.parquet(f"{where}/embeddings.parquet")
    return where


@pytest.fixture(scope="session")
def empty_folder(spark, odd, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("empty"))
    odd.limit(0).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame([], "page_id bigint, url string").write.parquet(f"{where}/pages.parquet")
    spark.createDataFrame([], "vec_id bigint, embedding array<float>").write.parquet(f"{where}/embeddings.parquet")
    return where
