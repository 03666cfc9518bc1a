"""Every query of the engine against its SQL, over the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from folia.plans import documents, geometry

SF = "/root/testdata/sf0.001"
QUERIES = geometry.QUERIES | documents.QUERIES
ORACLES = geometry.ORACLES | documents.ORACLES
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def shown(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    return sorted(tuple("" if pd.isna(v) else f"{v:.9g}" if isinstance(v, float) else str(v) for v in row) for row in frame.itertuples(index=False))


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{name}')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    ours, theirs = QUERIES[name](spark, SF).toPandas(), db.execute(ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert shown(ours) == shown(theirs)


def test_entry_without_the_optional_subpackage(monkeypatch):
    """The registered queries are there with and without the subpackage."""
    import sys

    import __spark_entry__ as entry

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    assert set(entry.queries()) == set(QUERIES) and set(entry.oracle_sql()) == set(ORACLES)


def test_entry_with_the_optional_subpackage_deleted(tmp_path):
    """Without both folders and the pipeline's file the other queries are there; a missing library is an error, not fewer queries."""
    import shutil
    import subprocess
    import sys

    import __spark_entry__ as entry

    root = os.path.dirname(os.path.abspath(entry.__file__))
    shutil.copytree(os.path.join(root, "folia"), tmp_path / "folia", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    run = lambda code, cwd: subprocess.run([sys.executable, "-c", code], cwd=cwd, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True)
    assert run(code, tmp_path).stdout.split() == [str(len(QUERIES)), str(len(ORACLES))]
    if os.path.isdir(os.path.join(root, "folia", "llm")):
        gone = run("import sys; sys.modules['xxhash'] = None; " + code, root)
        assert gone.returncode and "xxhash" in gone.stderr


def test_titles_are_whole_texts(spark, monkeypatch):
    """metadata writes the whole text of each document as its title, and whole titles are read."""
    from folia.plans import corpora
    from folia.sources.tables import Corpus

    seen, titled = [], corpora.titled
    monkeypatch.setattr(documents.corpora, "titled", lambda df: seen.append(df) or titled(df))
    assert documents.metadata(spark, SF).where("length(title) > 40").count() == 0
    texts = {str(r.doc_id): r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect() if r.text}
    found = {r.doc_id: r.title for r in Corpus(titled(seen[0])).documents.select("doc_id", "metadata.title").collect() if r.doc_id in texts}
    assert max(map(len, texts.values())) > 10_000 and found == texts
