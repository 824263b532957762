import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, slot string, quality int, doc string, x binary"
LONG = " ".join(f"wort{i % 997} the and" for i in range(40_000))


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and further columns of clashing names."""
    en = "the cat and the dog went to the old house of the king"
    rows = [
        (1, f"{en} with some bread and a jug of water for the long day", "en", "a"),
        (2, f"{en} with some bread and a jug of water for the long day", "en", "a"),
        (3, "der hund und die katze gehen in das alte haus und der mann ist nicht da", "de", "b"),
        (4, None, "en", "a"),
        (5, "", None, None),
        (6, " \n\t ", "de", None),
        (7, "12345 !!! ???", "en", "b"),
        (8, LONG, "en", "a"),
        (9, "mail bob@example.org or call +1 (988) 555-2485 now, 10.0.0.1, 4111 1111 1111 1111", None, "b"),
        (3, "der hund und die katze gehen in das alte haus und der mann ist nicht da", "de", "b"),
        (None, "eine zeile ohne nummer und der hund ist da", "de", "a"),
        (None, None, None, None),
        (10, "é" * 70 + " 日本語 \U0001f600 á", "xx", "c"),
    ]
    return spark.createDataFrame([(i, t, y, s, None, 0.5, "s", 1, "d", b"x") for i, t, y, s in rows], SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
