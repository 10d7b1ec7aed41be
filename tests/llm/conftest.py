import random

import pytest

CLASHES = ("id", "row", "size", "score", "kept", "n_words", "group_", "anchor", "__row", "__key", "c0", "pieces", "DOC")


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(vocabulary)] if vocabulary else []
    return " ".join(r.choice(words) for _ in range(n))


@pytest.fixture(scope="session")
def edges(spark):
    """Null, empty, word-less, short and very long texts, repeated rows, equal texts, a null id, and columns with clashing names."""
    long = prose(1, 30_000)
    text = prose(2, 120)
    rows = [
        (0, None, "en", None), (1, "", "en", "a"), (2, " \n\t ", None, "b"), (3, "word", "fr", "a"), (4, long, "en", "a"), (5, text, "en", "b"), (5, text, "en", "b"), (6, text, "fr", "a"),
        (7, text.upper(), "fr", None), (8, text + " tail", "en", "b"), (9, prose(3, 200), "fr", "c"), (None, prose(4, 60), None, None), (10, "é ¿? 日本 \x00 x", "fr", "c"), (11, "a <|endoftext|> b<|ENDOFTEXT|>c", "en", "c"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.selectExpr("*", "length(text) AS n_chars", *[f"'{c}' AS `{c}`" for c in CLASHES])


@pytest.fixture(scope="session")
def folder(spark, edges, tmp_path_factory):
    """A folder with the edge rows as documents, and one with empty tables."""
    full, empty = tmp_path_factory.mktemp("edges"), tmp_path_factory.mktemp("empty")
    edges.write.parquet(f"{full}/documents.parquet")
    edges.limit(0).write.parquet(f"{empty}/documents.parquet")
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "<s>[x] \x1be"), (1, 1, "assistant", "<s>[x] \x1be"), (2, None, None, None), (None, 0, "system", "é")]
    chats = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS conv", "2 AS turn_no")
    chats.write.parquet(f"{full}/conversations.parquet")
    chats.limit(0).write.parquet(f"{empty}/conversations.parquet")
    pages = [(1, "HTTP://Example.NET/en/x?q", None), (2, None, "<a href=x>"), (3, "nothing", "<a href='//b.org/x'>"), (3, "nothing", "<a href='//b.org/x'>"), (4, "http://a.com", '<a HREF="https://b.org">')]
    web = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "'h' AS host", "'t' AS trust")
    web.write.parquet(f"{full}/pages.parquet")
    web.limit(0).write.parquet(f"{empty}/pages.parquet")
    return str(full), str(empty)
