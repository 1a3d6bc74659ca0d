import pytest

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score double, fp long, k long, block int"
LINE = "This work is licensed under the GNU General Public License, version 3. "
LONG = " ".join(f"word{i % 977} and, {i}" for i in range(9000))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in any column, empty and very long texts, repeated rows and ids, and columns named like internal ones."""
    rows = [
        (5, None, "en", "a"), (6, "", None, None), (7, "   \n\t ", "en", "b"), (8, "!!! ... 123", "de", "b"),
        (9, LINE * 3 + "All rights reserved.", "en", "a"), (10, LINE * 3 + "all Rights\nRESERVED", "en", "a"),
        (11, LONG, "en", "a"), (12, LONG + " tail", "en", "a"), (13, "x" * 5000, "en", "a"), (14, "ab" * 300, "en", "c"),
        (15, "Éa straße ñandú 中文 текст 😀 é", "fr", None), (16, "same text as the next one, word for word, and so on", "en", "a"),
        (17, "same text as the next one, word for word, and so on", "en", "a"), (18, "repeated row", "en", "a"),
        (18, "repeated row", "en", "a"), (19, "one id, two texts: the first", "en", "a"), (19, "one id, two texts: the second", None, "a"),
        (None, "no id at all", "en", "a"), (20, "licensed under cc by nc 4.0 and cc-by again", "en", "z"),
    ]
    return [(d, t, lang, src, None if t is None else len(t), 0.5, 1, 2, 3) for d, t, lang, src in rows]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    return spark.createDataFrame(odd_rows, COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def sample(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
