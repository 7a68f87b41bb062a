import pytest

#: Texts that operators must take: null, empty, blank, very long, one long word, odd white space and letters, ties.
ODD = [
    (1, None, "a", 1), (2, "", "a", 2), (3, " \n\t\x0b ", None, None), (4, "one", "b", 4), (5, "same text here", "b", 5),
    (6, "same text here", "c", 6), (6, "same text here", "c", 6), (None, "no id at all", "c", 7), (7, "word " * 40_000, "d", 8),
    (8, "x" * 200_000, "d", 9), (9, "Ünï çödé 日本語 \x1c \xa0 İ K ſ 'S", "e", 10), (10, "line\nline\n\nline \r\nother", None, 11),
    (11, "A\x00b\x7fc", "e", 12),
]
SCHEMA = "doc_id long, text string, source string, n_words long"  # n_words clashes with results


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(spark):
    """Odd texts under names that operators use themselves, and names with dots and backticks."""
    rows = [(*r, 1, 2, 3, 4, 5, 6, "x", "y", 9) for r in ODD]
    return spark.createDataFrame(rows, SCHEMA + ", _lines int, _removed int, _tokens int, _epoch int, _block int, _block_rank int, `a.b` string, "
                                                "`c``d` string, doc int")
