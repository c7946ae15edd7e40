import pytest

#: Rows with every oddity: nulls, empty and blank texts, copies, a repeated row, a long text, odd characters.
LONG = " ".join(f"word{i % 97} run{i % 31} tail{i}" for i in range(4000))
ODD = [
    (1, "The cat sat on the mat and then the cat sat on the mat again while rain fell."),
    (2, None),
    (3, ""),
    (4, " \t\n "),
    (5, "The cat sat on the mat and then the cat sat on the mat again while rain fell."),
    (6, "THE CAT sat on the mat and then the cat sat on the mat again while rain fell."),
    (7, "é" * 40 + " naïve 東京 😀\u2028x"),
    (8, LONG),
    (9, "a"),
    (9, "a"),
    (10, "no no no no no no # * $ % & | < > !!!"),
    (11, "line one\nline two\nline one\n\n  \nline one"),
    (12, "x" * 3000),
    (13, "<|endoftext|> and <|startoftext|> are text  here\r\n"),
    (None, "a row without an id, quite short"),
    (-5, "a negative id " * 30),
]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, bucket string, key int, fp string, w string, mark double"


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame([(i, t, None, None, None, "b", 1, "f", "w", 0.5) for i, t in ODD], COLUMNS)


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.where("1 = 0").coalesce(1)


@pytest.fixture(scope="session")
def real(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
