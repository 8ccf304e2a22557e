from siftline.functions.ngrams import gram_hash, spans
from siftline.functions.register import register


def test_sql_functions(spark):
    register(spark)
    row = spark.sql("SELECT sparse_ngrams(cast('Hello world' AS BINARY)) a, covering_ngrams(cast('hello' AS BINARY)) c, sparse_ngrams(cast(null AS BINARY)) n").first()
    assert set(row["a"]) == {gram_hash(b"hello world"[i:j]) for i, j in spans(b"hello world")}
    assert row["c"] and set(row["c"]) <= set(row["a"]) and row["n"] == []
