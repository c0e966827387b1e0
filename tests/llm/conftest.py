import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows(texts, start=0):
    return [(start + i, t, "en", f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def table(spark, tmp_path_factory):
    """Writes rows as a documents table, in several files, and reads it back."""

    def make(data, schema=SCHEMA, files=3):
        path = f"file://{tmp_path_factory.mktemp('docs')}/documents.parquet"
        spark.createDataFrame(data, schema).repartition(files).write.parquet(path)
        return spark.read.schema(schema).parquet(path)

    return make


@pytest.fixture(scope="session")
def clash(table):
    """A table whose further columns have names that operators use themselves."""
    schema = "doc_id long, text string, shard int, h long, fp long, id long, words string, at int, `a.b` string, source string"

    def make(texts):
        return table([(i, t, 1, 2, 3, 4, "w", 5, "x", None) for i, t in enumerate(texts)], schema)

    return make
