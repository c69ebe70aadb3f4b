import os
import sys

import pytest
from pyspark.sql import types as T

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)
# workers import the package too
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def docs(spark):
    """A documents table from (doc_id, text) pairs; other columns are null."""

    def make(rows, extra=()):
        schema = T.StructType([*DOCS.fields, *(T.StructField(c, T.StringType()) for c in extra)])
        return spark.createDataFrame([(i, t, None, None, None, *("x" for _ in extra)) for i, t in rows], schema)

    return make


#: Columns that operators use inside, as extra columns of their input.
CLASHING = ("th", "seed", "row", "words", "n_words", "id", "component", "gram", "score", "held_out", "pieces", "ids", "bucket", "spans", "flat", "h")
