import pytest


@pytest.fixture(scope="session")
def docs_frame(spark):
    """Builds a frame of documents; columns that clash with names used inside are added."""

    def build(rows, schema="doc_id long, text string, lang string, source string, n_chars long"):
        frame = spark.createDataFrame([r + (None,) * (5 - len(r)) for r in rows], schema)
        for name in ("size", "shard", "key", "prob", "chunk", "length", "n", "value", "_range", "_text", "_email", "pii", "_key", "_id", "_first", "rows", "all", "_words", "low"):
            frame = frame.selectExpr("*", f"'extra' as {name}")
        return frame

    return build


ODD = [
    (1, None, "en", "a"),
    (2, "", "en", None),
    (None, "some words here", None, "b"),
    (None, "some words here", None, "b"),
    (3, " \t\n", "en", "a"),
    (4, "x" * 70_000 + " y" * 30_000, "en", "b"),
    (5, "été naïve 10 µm \U0001f600 é ﬁn dash\x1c! it's", "fr", "a"),
    (6, "some words here", "en", "b"),
    (6, "some words here", "en", "b"),
    (7, "<|endoftext|> and <|startoftext|>", "en", "c"),
]


@pytest.fixture(scope="session")
def odd(docs_frame):
    """Nulls, empty and very long texts, repeated rows, odd characters."""
    return docs_frame(ODD)
