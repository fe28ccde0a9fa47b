import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make_docs(spark):
    """Documents from (doc_id, text[, lang, source]) tuples."""

    def make(rows, extra=False):
        rows = [(*r, *[None] * (4 - len(r)), None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(rows, SCHEMA)
        if extra:  # names that the operators use themselves
            for name in ("size", "kept", "hash", "k", "shard", "words", "class_id", "copies", "cell", "target"):
                df = df.selectExpr("*", f"'x' as {name}")
        return df

    return make
