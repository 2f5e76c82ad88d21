import pytest


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def rows(docs):
    return docs.orderBy("doc_id").collect()


@pytest.fixture(scope="session")
def path():
    from sightline.llm.queries import tokenizer_path

    return tokenizer_path()


@pytest.fixture(scope="session")
def hard(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns named like the operators' own."""
    long = "the quick brown fox jumps over it " * 3000
    data = [
        (1, "The quick brown fox, a@b.co +1 555 123 4567.", "en", 1),
        (1, "The quick brown fox, a@b.co +1 555 123 4567.", "en", 1),
        (2, None, None, None),
        (3, "", "en", 3),
        (4, " \n\t ", "de", 4),
        (5, long, "en", 5),
        (6, long + "x", None, 6),
        (None, "Ein kurzer Text mit \U0001f600 und ÄÖÜ", "de", 7),
        (7, "<|endoftext|> 1234 </s> 10.0.0.1 and 4111 1111 1111 1111", "de", 8),
    ]
    schema = "doc_id long, text string, lang string, n_chars long"
    df = spark.createDataFrame(data, schema)
    from pyspark.sql import functions as F

    clash = ("fp", "spans", "hits", "items", "n_words", "score", "size", "key", "rejected", "row_", "kept", "N_TOKENS")
    return df.select("*", *(F.lit("clash").alias(c) for c in clash))
