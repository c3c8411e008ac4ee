import pytest

#: Texts that are awkward for every operator: null, empty, blank, very long, repeated, other scripts, rare characters.
AWKWARD = [None, "", "   \n\t ", "x" * 100_000, "word " * 20_000, "Hello there.", "Hello there.", "Привет мир 你好 世界", "a b c  d\r\n", "emoji 😀😀 é", "#### !!!! ....", "0123456789 " * 50]


@pytest.fixture
def awkward(spark):
    """The awkward texts with ids, and columns of clashing names."""
    rows = [(i, t, "en", "src0", len(t or ""), "clash", 1.5) for i, t in enumerate(AWKWARD)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id string, score double")


@pytest.fixture
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
