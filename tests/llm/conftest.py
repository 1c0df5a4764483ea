import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the river ran past an old mill and into the quiet town where people met to talk of rain and harvest every evening".split()


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty and long texts, ties and repeated rows, clashing extra columns."""
    long = " ".join(WORDS[i % 20] + str(i % 977) for i in range(30_000))
    rows = [
        (0, "The river ran. " * 3, "en", "a", 45), (1, None, "en", "a", None), (2, "", None, None, 0), (3, long, "en", "b", len(long)),
        (4, " ".join(WORDS) + "\n" + " ".join(reversed(WORDS)) * 3, "fr", "b", 1), (4, " ".join(WORDS) + "\n" + " ".join(reversed(WORDS)) * 3, "fr", "b", 1),
        (None, "null id text 12345", "xx", "c", 1), (7, " ".join(WORDS), "en", "a", 2), (8, "\t \n", "de", "c", 3),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def clashing(docs):
    """docs with further columns whose names operators use inside."""
    from pyspark.sql import functions as F

    return docs.withColumns({c: F.lit(1) for c in ("score", "fp", "ids", "entities", "clashes", "findings", "q_words", "m_size", "d_id", "c_last", "key")})


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("1 = 0")


@pytest.fixture
def tables(tmp_path):
    def write(df, name="documents"):
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return write
