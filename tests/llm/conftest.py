import datetime as dt

import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Rows -> documents with clashing extra columns; text may be null."""

    def make(rows):
        full = [(i, t, None, "s", None, 7, "x", dt.date(2024, 1, 1), None) for i, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, leaks int, score string, predicted date, removed_lines int")

    return make
