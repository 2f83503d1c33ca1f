import pytest


@pytest.fixture
def documents(spark):
    """Rows with nulls, ties, repeats, empty texts and an extra column."""
    long = " ".join(f"w{i % 400}x{i // 7}" for i in range(3000))
    passage = " ".join(f"passage{i}word" for i in range(60))
    rows = [
        (1, "the cat sat on the mat and looked at the big dog today", "en", "a", 1), (2, "the cat sat on the mat and looked at the big dog today", "en", "a", 2),
        (3, "", "en", "b", 3), (4, None, None, None, 4), (5, long, "de", "b", 5), (6, long + " tail", "de", None, 6), (None, "no id here at all", "fr", "a", 7),
        (7, "one two\nthree four\nthree four\n# * $", "en", "c", 8), (7, "one two\nthree four\nthree four\n# * $", "en", "c", 8),
        (8, f"first {passage} end of the first text", "en", "a", 9), (9, f"second thing before {passage} and another end", "en", "c", 10), (10, "café über naïve 😀 x" * 30, "fr", "b", 11),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, __text_extra long")
