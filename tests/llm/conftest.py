import pytest
from pyspark.sql import functions as F

from ..conftest import SF_DIR

LONG = " ".join(f"word{k % 977} and{k % 13}" for k in range(30_000))
EDGES = [
    (900_001, None, None, None),
    (900_002, "", "en", "src0"),
    (900_003, " \t\n\x0b ", None, "src0"),
    (900_004, LONG, "en", None),
    (900_005, LONG + " tail", "en", "src1"),
    (900_006, "one two", "en", "src1"),
    (900_007, "one two", "en", "src2"),
    (900_008, "ONE two", "en", "src2"),
    (900_009, "é 日本 ünï " * 40, "xx", "src3"),
    (900_010, "1234 5678 !!! ???", "en", "src3"),
    (None, "a row without an id", "en", "src4"),
]


@pytest.fixture(scope="session")
def corpus(spark):
    """The smallest documents with odd rows and columns whose names operators use themselves."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text", "lang", "source")
    odd = spark.createDataFrame(EDGES, docs.schema)
    clash = {c: F.lit(7) for c in ("n", "key", "keys", "size", "shard", "slot", "row", "spans", "words", "w", "h1", "cluster", "component", "kept", "hash", "score", "name", "start")}
    return docs.union(odd).withColumns(clash).cache()


@pytest.fixture(scope="session")
def empty(corpus):
    return corpus.limit(0)


@pytest.fixture(scope="session")
def texts(corpus):
    return {r.doc_id: r.text or "" for r in corpus.where("doc_id is not null").collect()}
