import pytest

#: Columns whose names the operators use inside.
EXTRA = "n long, w string, key long, bucket long, id long, block long, row long, items string, g string, part int"


@pytest.fixture(scope="session")
def make(spark):
    def build(rows):
        """documents from (doc_id, text) or (doc_id, text, lang) rows, with clashing extra columns."""
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", 1, *[None] * 10) for r in rows]
        return spark.createDataFrame(full, f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}")

    return build


@pytest.fixture(scope="session")
def samples():
    """Some whole texts of the smallest table."""
    import duckdb

    return [(r[0], r[1]) for r in duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.001/documents.parquet' ORDER BY doc_id").fetchall()]


ODD = [None, "", " ", "\n\n", "a", "a b", "one  two\tthree\n\nfour", "x" * 3000, "word " * 2000, "é ñ 한국 😀", "\u0000\x1c\x85　"]
