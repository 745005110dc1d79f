import pytest

WORDS = "the of and to in ering tion hend ated wh ly onre esha blend nter thing oran aned sh re".split()


def prose(r, n):
    return " ".join(r.choice(WORDS) + r.choice(["", "", "er", "ing", "th"]) for _ in range(n))


ODD_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, f long, copy string, quality_score string, `salt` int, anchor string, extra array<int>"


def odd(spark, texts, first=0):
    """Documents with further columns whose names the operators use inside."""
    rows = [(None if i is None else i, t, "en", "s", len(t or ""), 1, "c", "q", 3, "a", [1]) for i, t in texts]
    return spark.createDataFrame(rows, ODD_SCHEMA)


@pytest.fixture(scope="session")
def edge(spark):
    """Null, empty, blank, one-word and very long texts, repeated rows, equal doc_ids with different texts, a null doc_id, odd characters."""
    import random

    r = random.Random(1)
    long = prose(r, 30_000)
    texts = [(0, None), (1, ""), (2, " \n\t "), (3, "word"), (4, long), (5, long + " end"), (6, prose(r, 50)), (6, prose(r, 60)), (7, "x y z"), (7, "x y z"), (8, "é　ß\x1c 漢字 \U0001f600 İ 'll <|endoftext|>"), (None, "no name here"), (9, "a" * 50_000)]
    return odd(spark, texts)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], ODD_SCHEMA)


def rows(df, *names):
    return [tuple(r[n] for n in names) for r in df.collect()]
