"""The pipeline and the queries against SQL, and the pipeline on odd rows."""

import os

import duckdb
import pytest
from conftest import DOCS, PROSE

import corpus_pipeline
from veilframe.llm import queries
from veilframe.llm.oracles import oracle_queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in ("documents", "benchmark", "labels", "conversations"):
        con.sql(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


def shown(value):
    return repr(round(value, 9)) if isinstance(value, float) else repr(value)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", [*sorted(oracle_queries()), "pipeline"])
def test_query_equals_its_sql(spark, db, name):
    query = corpus_pipeline.run if name == "pipeline" else queries.all_queries()[name]
    want = db.sql(corpus_pipeline.ORACLE_SQL if name == "pipeline" else oracle_queries()[name])
    got = query(spark, SF)
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns
    order = [want.columns.index(c) for c in columns]
    left = sorted(tuple(shown(r[c]) for c in columns) for r in got.collect())
    right = sorted(tuple(shown(r[i]) for i in order) for r in want.fetchall())
    assert left == right


@pytest.fixture
def tables(spark, tmp_path):
    """A folder with documents and a benchmark of one item."""

    def write(rows):
        full = [(*r, *[None] * (4 - len(r)), 7, "own", "own", "own") for r in rows]
        spark.createDataFrame(full, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
        item = " ".join(f"item{i}" for i in range(20))
        spark.createDataFrame([(1, item), (None, None)], "item_id long, text string").write.parquet(
            str(tmp_path / "benchmark.parquet")
        )
        return str(tmp_path), item

    return write


def test_stages_on_odd_rows(spark, tables, odd, tmp_path):
    item = " ".join(f"item{i}" for i in range(20))
    copies = [(100 + i, "Copy of one text, the same as all the others here.", "en", "a") for i in range(30)]
    rows = [*odd, *copies, (50, f"look {item} here", "en", "b"), (51, PROSE.upper(), "en", "b")]
    sf_dir, _ = tables(rows)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        path = str(tmp_path / f"stage{i}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        kept[name] = [(r["doc_id"], r["text"]) for r in docs.collect()]
        assert set(columns) <= set(docs.columns)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
            assert {r["size"] for r in docs.select("size").collect()} == {"own"}
    lettered = [(r[0], r[1]) for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    key = lambda r: (str(r[0]), r[1])
    assert sorted(kept["language_id"], key=key) == sorted(lettered, key=key)
    near = {r[0] for r in kept["near_duplicates"]}
    # of the prose, its copies, its upper case and the one with a tail only the first stays
    assert near == {1, 7, 8, 9, 50, 100} and len(kept["near_duplicates"]) == 6
    assert {r[0] for r in kept["decontamination"]} == near - {50}
    assert {r[0] for r in kept["sharding"]} <= near - {50}
    assert {r["size"] for r in docs.select("size").collect()} == {"own"}


def test_pipeline_of_an_empty_table(spark, tables):
    sf_dir, _ = tables([])
    assert corpus_pipeline.run(spark, sf_dir).count() == 0
