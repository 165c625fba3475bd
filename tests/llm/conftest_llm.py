import pytest

#: Rows that every operator over documents must bear: nulls, empty and blank texts, ties, repeated rows, one very long text.
ODD = [
    (5, "The cat sat on the mat. The dog, too.\nA second line here.", "en", "a"),
    (3, None, "en", "a"),
    (9, "", None, None),
    (2, "   \n\n  ", "de", "b"),
    (7, "The cat sat on the mat. The dog, too.\nA second line here.", "en", "a"),
    (7, "The cat sat on the mat. The dog, too.\nA second line here.", "en", "a"),
    (11, "Éa ñ ß 漢字 \U0001f600 don't  stop\tit's 3,4 a.b ...", "es", "c"),
    (1, "word " * 30_000, "en", "c"),
    (4, "x", "en", "c"),
    (8, "<|endoftext|> a <|endoftext|>", "en", "b"),
    (12, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen", "en", "d"),
    (13, "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen", "en", "d"),
]


@pytest.fixture
def odd(spark):
    """Documents with an extra column whose name clashes with those the operators use."""
    return spark.createDataFrame([(i, t, l, s, None if t is None else len(t), "extra", 1) for i, t, l, s in ODD], "doc_id long, text string, lang string, source string, n_chars long, start string, h long").repartition(5)


@pytest.fixture
def none(odd):
    return odd.limit(0)


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.select(*cols).collect()), key=lambda r: tuple((x is None, x) for x in r))


SF = "/root/testdata/sf0.001"
