import pytest

LONG = " ".join(f"word{i % 977}x{i}" for i in range(60_000)) + "."
ROWS = [
    (0, "One two three four five six seven eight nine ten eleven."),
    (1, None), (2, ""), (3, " \n\t "), (4, "single"),
    (5, "Öl und ß sind da, sagte Zoë; 12 Äpfel kosten 3 €.\nZweite Zeile hier, mit acht Wörtern im Satz."),
    (6, "One two three four five six seven eight nine ten eleven."),
    (6, "One two three four five six seven eight nine ten eleven."),
    (None, "a row without an id"), (None, None), (7, LONG), (8, "x" * 200_000),
]
CLASHES = "score double, kept boolean, ids array<int>, value long, rep long, n long, term string"


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls, empty and very long texts, repeated rows, extra columns with clashing names."""
    return spark.createDataFrame([(i, t, "en", "s", None, 0.5, True, [1], 1, 1, 1, "t")
                                  for i, t in ROWS],
                                 "doc_id long, text string, lang string, source string,"
                                 " n_chars long, " + CLASHES)


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)


@pytest.fixture(scope="session")
def small(spark):
    return "/root/testdata/sf0.001"
