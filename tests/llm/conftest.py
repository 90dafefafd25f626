import pytest

SF = "/root/testdata/sf0.001"

LONG = " ".join(f"word{i % 97}x{i}" for i in range(3000))
EDGE_TEXTS = [None, "", " \n\t ", "a", "one two three four", "Grüße an alle, liebe Leute 漢字 ▁ mark  end", LONG, LONG, "same text here again and again now", "same text here again and again now"]


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in any column, empty and long texts, ties and repeated rows, extra columns with clashing names."""
    rows = [
        (None if i == 4 else i, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else "src0", None if t is None else len(t), "x", 1.5, 7)
        for i, t in enumerate(EDGE_TEXTS)
    ]
    rows.append(rows[8])
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, key string, score double, ids int"
    )


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(0, 1, 0), (1, None, None), (3, 0, 1), (6, 1, 0), (6, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
