"""What a Python worker gets of long texts at once is bounded."""

import pytest

from interlace.operators import extraction, pages


@pytest.mark.parametrize("query", [extraction.plain_documents, pages.page_tables])
def test_batches_of_long_texts_are_bounded(spark, query):
    """A batch had ten thousand rows, whatever their length."""
    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    for name in names:
        spark.conf.unset(name)
    try:
        query(spark, "/root/testdata/sf0.001")
        assert int(spark.conf.get(names[0])) <= 500 and int(spark.conf.get(names[1])) <= 8 << 20
    finally:
        for name in names:
            spark.conf.unset(name)
