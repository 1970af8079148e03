"""Every query of the library against its SQL, on whole tables."""

from __future__ import annotations

import duckdb
import pytest

from lectern.plans.queries import ORACLES, QUERIES, flagship

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(round(r[i], 9) if isinstance(r[i], float) else r[i] for i in order) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, db, sf_dir, name):
    df, expected = QUERIES[name](spark, sf_dir), db.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(expected.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(expected.columns, expected.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_best_decodings_are_argmax(spark, sf_dir):
    """The decoding kept for each document is the first with the highest score among all its candidates."""
    from pyspark.sql import functions as F

    from lectern.operators import decoding

    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.encode("text", "UTF-8").alias("data"), F.lit(65001).alias("code_page"))
    best = {}
    for r in decoding.decoding_candidates(rows).select("doc_id", "prio", "score", "text").collect():
        best[r["doc_id"]] = max(best.get(r["doc_id"], (-9, 0, "")), (r["score"], -r["prio"], r["text"]))
    got = {r["doc_id"]: r["text"] for r in decoding.best_decoding(rows).collect()}
    assert got == {d: b[2] for d, b in best.items()}


def test_flagship(spark, sf_dir):
    assert flagship(spark, sf_dir).count() > 0


def test_entry_without_training_operators(monkeypatch):
    """Where the optional subpackage is gone, its queries are absent and all others stay."""
    import builtins
    import sys

    import __spark_entry__

    real = builtins.__import__

    def gone(name, *args, **kwargs):
        if name.startswith(("lectern.llm", "corpus_pipeline")):
            raise ModuleNotFoundError(name, name=name)
        return real(name, *args, **kwargs)

    for m in [m for m in sys.modules if m.startswith("lectern.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, m)
    monkeypatch.setattr(builtins, "__import__", gone)
    assert set(__spark_entry__.queries()) == set(QUERIES)
