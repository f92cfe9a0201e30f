import pytest


@pytest.fixture
def texts(spark):
    """documents-like rows with clashing extra columns from (doc_id, text) pairs."""
    def make(*pairs):
        return spark.createDataFrame([(i, t, "node", 1, "en", "src1") for i, t in pairs],
                                     "doc_id long, text string, node string, n long, lang string, source string")
    return make
