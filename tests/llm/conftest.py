import pytest


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet").cache()


@pytest.fixture(scope="session")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}


#: Columns whose names could clash with what operators add, and every kind of awkward row.
AWKWARD = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, rejected boolean, kept string, copies int, class_id string, `start` int"


@pytest.fixture(scope="session")
def awkward(spark):
    long = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
    texts = [None, "", "   ", "\n\n\n", "a", "é ñ 漢字 🙂", long, long, "x" * 50_000, "same text here for all of us\nand a second line of it", "same text here for all of us\nand a second line of it", "1 2 3"]
    rows = [(i if i != 3 else None, t, None if i % 3 else "en", None if i % 4 == 0 else "s", None, 1, 0.5, True, "k", 3, "c", 0) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[9], rows[9]], AWKWARD)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], AWKWARD)
