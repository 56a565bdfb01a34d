import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, score string, spans int, n_words string, kept string, _of long, lang string, ids string, _words string, `a b` string, `x.y:z` string, Score int"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty, blank and very long texts, ties, repeated rows, signs and many alphabets."""
    passage = "an old story that is told here word by word over and over until somebody else writes it down again and keeps the paper in a box"
    texts = {
        1: None,
        2: "",
        3: " \n\t ",
        4: "one",
        5: passage,
        6: passage,
        7: "before it all " + passage + " and after",
        8: "▁x <|endoftext|> \x00 é 日本語 😀 \u2028 </turn> ### \\l",
        9: ("very long words " + "abcdefgh" * 50 + " ") * 400,
        10: "a" * 20_000,
        11: "\n".join(["The same line of words stands here."] * 60),
    }
    rows = [(k, v, "s", k, "n", "k", 7, None, "i", "w", "b", "z", 3) for k, v in texts.items()]
    return [*rows, rows[4], rows[4], (None, passage, *[None] * 11), (None, *[None] * 12)]


def _frame(spark, rows):
    # names that differ in case only can be had by position
    return spark.createDataFrame(rows, SCHEMA.replace("Score int", "_last int")).toDF(*[x.strip(" `") for x in SCHEMA.replace(" string", "").replace(" long", "").replace(" int", "").split(",")])


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return _frame(spark, odd_rows).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return _frame(spark, [])


@pytest.fixture(scope="session")
def texts(spark, sf):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
