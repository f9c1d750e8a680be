import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from tests_llm_text import prose  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty texts, copies, repeated rows, ties, a long text, and columns with clashing names."""
    rows = [(k, prose(k), "en", f"src{k % 3}", None) for k in range(1, 13)]
    rows += [
        (13, prose(1), "en", "src0", 5), (14, prose(2) + " tail", None, None, 5), (15, None, "en", "src1", None), (16, "", "de", "src1", 0), (17, "?! 12", "de", "src1", 5),
        (None, prose(99), "en", "src0", 1), (None, None, None, None, None), (18, prose(18), "en", "src2", 1), (18, prose(18), "en", "src2", 1), (18, prose(19), "en", "src2", 1),
        (19, "é" * 70 + prose(3, 40), "fr", "src2", 1), (20, prose(20, 9000), "en", "src0", 1), (21, "one", "en", "src0", 3), (22, "ONE", "en", "src0", 3),
    ]
    docs = spark.createDataFrame(rows, SCHEMA)
    clash = ["score", "fp", "h", "c", "_batch", "size", "target", "predicted", "lang_pred", "n_removed", "u", "word", "item_id"]
    from pyspark.sql import functions as F

    return docs.withColumns({name: F.lit("x") for name in clash})


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
