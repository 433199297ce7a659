import pytest

#: What any operator must take: nulls everywhere, empty, long, repeated and odd texts, clashing columns.
TEXTS = [
    (1, "one two three four five", "a"),
    (2, "one two  three\nfour\tfive", "a"),
    (3, None, "a"),
    (4, "", None),
    (5, " \n\t ", "b"),
    (6, "wörd ß 漢字 🙂 nbsp\u00a0here \x1c fs", "b"),
    (7, "one two three four five", "a"),
    (7, "one two three four five", "a"),
    (None, "one two three four five", None),
    (8, "x" * 3000, "c"),
    (9, " ".join(f"w{i % 701} the" for i in range(40_000)), "c"),
    (10, "<|endoftext|> & <|im_end|> &lt;| a  b\n\nc", "c"),
    (11, "word", "b"),
    (12, "two words", "b"),
    (None, None, None),
]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(d, t, s, i, -i, "x", i, "l", i) for i, (d, t, s) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size int, shard int, host string, row int, lines string, fp int")


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
