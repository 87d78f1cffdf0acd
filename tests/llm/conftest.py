import pytest


@pytest.fixture(scope="session", autouse=True)
def shared(spark, tmp_path_factory):
    """A shared folder for written intermediate results, if the session names none."""
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")


@pytest.fixture
def frame(spark):
    """Documents from (doc_id, text) pairs, with the other columns and one of a clashing name."""
    def make(rows, **more):
        names = {"lang": "string", "source": "string", "n_chars": "long", "row": "string", "items": "string", "score": "string"}
        schema = "doc_id long, text string, " + ", ".join(f"{k} {v}" for k, v in names.items())
        return spark.createDataFrame(
            [(i, t, "en", "s", None if t is None else len(t), "x", "y", "z") for i, t in rows], schema)
    return make
