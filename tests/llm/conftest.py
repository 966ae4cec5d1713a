import pytest

LONG = " ".join(f"word{i % 977} other{i % 1009}" for i in range(40_000))


@pytest.fixture(scope="session")
def edge(spark):
    """Documents with nulls, ties, repeated rows, very long texts and columns named like internal ones."""
    rows = [
        (1, "a  b\tc", "x"), (2, "a b c", None), (2, "a b c", None), (3, None, "x"), (4, "", "x"), (5, " \n ", "x"), (None, "a b c", "x"), (None, None, None),
        (6, LONG, "x"), (7, LONG + " end", "x"), (8, "É ñ 1.2.3.4, x@y.example +1 (212) 555-0100 4111 1111 1111 1111", "x"), (9, "A B C", "x"), (10, "one", "x"),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    from pyspark.sql import functions as F

    for name in ("kept", "n", "data", "score", "set", "row", "component_id", "__rate", "pos"):
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="session")
def nothing(edge):
    return edge.filter("false")
