import pytest
from pyspark.sql import types as T

#: documents with extra columns whose names clash with those that the operators make.
SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    + [T.StructField(n, T.StringType()) for n in ("fp", "key", "row", "line", "h", "size", "score", "component_id", "start", "before")]
)


def base_texts():
    words = [f"word{i % 37}x{i % 11}" for i in range(400)]
    long = " ".join(words[i * 7 % 400] for i in range(30_000))
    near = " ".join(words[:120])
    return [
        (1, near, "src0"),
        (2, near + " more", "src0"),
        (3, near, "src1"),
        (3, near, "src1"),
        (4, None, "src2"),
        (5, "", None),
        (6, " \n\t ", "src0"),
        (None, "a short one", "src0"),
        (7, "one\nTwo three\none\nTWO  THREE!\n---\n---", None),
        (8, long, "src0"),
        (9, "é ñ <s>[INST] \\ #*$ ▁▁ 日本語 \x00", "src1"),
        (None, None, None),
        (10, "x", "src3"),
        (11, "Two three", "src3"),
    ]


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows):
        full = [(i, t, "en", s, None if t is None else len(t), *["clash"] * 10) for i, t, s in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture(scope="session")
def rows():
    return base_texts()


@pytest.fixture(scope="session")
def docs(make_docs, rows):
    return make_docs(rows).cache()


@pytest.fixture(scope="session")
def no_docs(make_docs):
    return make_docs([])
