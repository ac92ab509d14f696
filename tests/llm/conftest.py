import pytest
from hypothesis import settings

settings.register_profile("spark", deadline=None, max_examples=25, derandomize=True)
settings.load_profile("spark")

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, key long, kept string, shard int, n_words int"

PROSE = (
    "the quick brown fox jumps over the lazy dog while seven wise owls watch from an old oak tree near the quiet river bank "
    "and a tired miller counts his sacks of grain before the evening bell rings out across the valley to call the people home "
    "from their fields where barley and rye have grown tall under a long warm summer that nobody in the village will forget"
)


@pytest.fixture()
def odd_docs(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, clashing extra columns."""
    long_text = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
    rows = [
        (1, PROSE, "en", "a"),
        (2, PROSE, "en", "a"),
        (2, PROSE, "en", "a"),
        (3, PROSE + " at last", "en", "b"),
        (4, None, "en", "a"),
        (5, "", None, "a"),
        (6, " \n\t ", "en", None),
        (None, PROSE, "en", "b"),
        (None, None, None, None),
        (None, None, None, None),
        (7, long_text, "de", "c"),
        (8, long_text + " end", "de", "c"),
        (9, "one", "en", "b"),
        (10, "Ünïcödé \U0001f600 wörds ärë fïne here\x1f too", "de", "b"),
        (11, "a\nb\na\n\na", "en", "b"),
        (7, "another text under an id that is taken", "en", "c"),
    ]
    return spark.createDataFrame([(*r, 5, "x", 6, "y", 7, 8) for r in rows], DOC_SCHEMA)


@pytest.fixture()
def no_docs(spark):
    return spark.createDataFrame([], DOC_SCHEMA)
