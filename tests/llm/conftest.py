import pytest

from lodestrata.ship import ship

#: Columns of other tables with names that operators use inside.
CLASHES = {"id": "x", "row": "y", "row_": "z", "bucket": 1, "class": 2, "v": 3, "hash": 4, "hash_": 5, "label": 6, "range": 7, "recipe": "r", "key": "k", "part": 8, "lang_pred": "q", "score": 0.5, "digest": "d", "file": 9, "host": "h", "deal": 1}


@pytest.fixture(scope="session")
def llm_spark(spark):
    return ship(spark)


@pytest.fixture
def documents(llm_spark):
    """Makes documents (doc_id, text) with nulls in any column and columns whose names clash."""

    def make(rows, clash=True):
        from pyspark.sql import functions as F

        df = llm_spark.createDataFrame([(i, t) for i, t in rows], "doc_id bigint, text string").repartition(3)
        return df.withColumns({k: F.lit(v) for k, v in CLASHES.items()}) if clash else df

    return make


LONG = " ".join(f"word{i % 977}x{i}" for i in range(60_000))
SENTENCE = "the quick brown fox jumps over the lazy dog near the river bank at dawn while birds sing loudly above"
ROWS = [
    (1, SENTENCE), (2, None), (3, ""), (4, SENTENCE), (None, SENTENCE), (5, "  spaced \t\n out  "), (6, " spaced out "), (7, LONG), (8, LONG + " end"), (8, LONG + " end"),
    (9, "!!! ???"), (10, "Ünïcödé ßtraße ΑΣ 日本語 😀"), (11, "a"), (12, "\x00\x01"), (13, SENTENCE.upper() + "!"),
]


@pytest.fixture
def rows():
    return list(ROWS)
