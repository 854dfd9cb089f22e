import pytest


@pytest.fixture(scope="session")
def spark():
    from tessera.session import local_session
    return local_session(4, shuffle_partitions=8, app="tessera-llm-tests")


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text, lang, source) rows, with columns that clash with internal names."""
    def build(rows):
        full = [(*r, *[None] * (4 - len(r)), 1, "x", 2.0, "y") for r in rows]
        return spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string, "
                                           "size int, t string, d double, found string")
    return build


def odd_rows():
    """NULLs in any column, empty and blank texts, repeated rows, equal ids with other texts, a very
    long text and ordinary ones."""
    words = [f"w{i}" for i in range(60)]
    passage = " ".join(words)
    return [
        (1, passage, "en", "a"), (1, passage, "en", "a"), (1, "another text of the same id", "fr", "a"),
        (2, None, "en", "b"), (3, "", "de", None), (4, " \n\t ", None, "b"), (None, passage + " end", "en", "a"),
        (None, None, None, None), (5, "start " + passage, "en", "c"), (6, "word", "en", "c"),
        (7, " ".join(f"x{i % 977}" for i in range(20_000)), "en", "a"), (8, "élève Straße 中文 \U0001f600 " * 30, "fr", "b"),
        (9, passage, "en", "b"), (10, "a" * 5000, "en", "c"), (11, "one two three four five", "en", "c"),
    ]
