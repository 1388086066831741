import pytest

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words string"

WORDS = [f"w{i}" for i in range(60)]
PASSAGE = " ".join(WORDS)
ROWS = [
    (1, PASSAGE + " alpha beta", "en", "a", 1, "x"),
    (2, "start\t" + PASSAGE.replace(" ", "\n"), "en", "a", 1, "x"),
    (3, PASSAGE + " alpha beta", "en", None, 1, "x"),
    (4, None, None, None, None, None),
    (5, "", "en", "a", 0, None),
    (6, "   \n\t ", "en", "a", 1, None),
    (7, "one", "en", "a", 1, None),
    (8, "Ünïcode ß 字漢     tail<|endoftext|>x <|startoftext|> don't I'LL 12345 ?!... \r\n\r\n  end  ", "de", "b", 1, None),
    (9, " ".join(f"t{i % 977}x{i}" for i in range(30_000)), "en", "b", 1, None),
    (9, "repeated id", "en", "b", 1, None),
    (10, "x y " * 40, "es", "b", 1, None),
    (None, "no id here at all", "fr", "b", 1, None),
    (11, "repeated row", "fr", "b", 1, None),
    (11, "repeated row", "fr", "b", 1, None),
    (12, "\U0001f600" * 50 + "é́ ͸՘ a՘b \x1c\x85 z", "en", "b", 1, None),
    (13, "z" * 5000, "en", "b", 1, None),
]


@pytest.fixture(scope="session")
def rows():
    return ROWS


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
