import pytest
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

DOCS = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()),
                   StructField("source", StringType()), StructField("n_chars", LongType())])


@pytest.fixture(scope="session")
def docs_of(spark):
    """(id, text) pairs -> a documents table over several partitions."""
    def make(rows, parts=3):
        full = [(i, t, "en", "src0", None if t is None else len(t)) for i, t in rows]
        return spark.createDataFrame(full, DOCS).repartition(parts)
    return make


@pytest.fixture(scope="session")
def real_texts(spark):
    """(id, text) of the documents of the small driver table."""
    return [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]


@pytest.fixture(scope="session")
def labels_of(spark):
    schema = StructType([StructField("doc_id", LongType()), StructField("quality", IntegerType()), StructField("toxic", IntegerType())])
    return lambda rows: spark.createDataFrame([(i, 1, t) for i, t in rows], schema)
