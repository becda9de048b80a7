"""Every registered query against its SQL, and the pipeline stage by stage."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lumenbox.llm import exact_dedup, mixing, ngram_join, queries, toxicity

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    a, b = queries.QUERIES[name](spark, DATA).toArrow(), con.sql(queries.ORACLES[name]).to_arrow_table()
    cols = sorted(a.column_names)
    assert cols == sorted(b.column_names)
    show = lambda v: float(v) if isinstance(v, (int, float)) else v
    rows = lambda t: sorted(([show(r[c]) for c in cols] for r in t.to_pylist()), key=repr)
    assert rows(a) == rows(b)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    ids = lambda d: sorted(r[0] for r in d.select("doc_id").collect())
    out = {}
    d = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        d = stage(spark, d, DATA).cache()
        assert d.columns == docs.columns
        out[name] = d
    toxic = {r.doc_id for r in toxicity.toxicity(docs, labels).where("predicted = 1").collect()}
    assert ids(out["toxicity"]) == [i for i in ids(docs) if i not in toxic]
    kept = {r.doc_id for r in exact_dedup.exact_duplicates(out["toxicity"]).where("kept").collect()}
    assert ids(out["exact dedup"]) == sorted(kept)
    near = {r.doc_id for r in ngram_join.ngram_join(out["exact dedup"]).where("doc_id = component_id").collect()}
    assert ids(out["n-gram Jaccard join"]) == sorted(near)
    copies = {r.doc_id: r.copies for r in mixing.mix(out["n-gram Jaccard join"]).collect()}
    assert {r.doc_id: r.n for r in out["mixing"].groupBy("doc_id").agg(F.count("*").alias("n")).collect()} == {k: v for k, v in copies.items() if v}
    last = corpus_pipeline.STAGES[-1][1](spark, out["mixing"], DATA)
    assert ids(last) == ids(out["mixing"])


def _through(spark, docs, folder):
    """Each stage's rows in turn, and the last one's; every table is written and read again."""
    out = []
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, DATA)
        if n < len(corpus_pipeline.STAGES) - 1:
            docs.write.parquet(f"{folder}/{n}")
            docs = spark.read.parquet(f"{folder}/{n}")
        out.append(docs)
    return out


def test_pipeline_edges(spark, tmp_path):
    """Null ids, texts and sources, repeated rows, a very long text, and columns named like those that the stages make."""
    near = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty "
    rows = [(None, None, None), (None, "a text without an id", None), (1, "", "a"), (2, None, "a"), (3, near * 3, "a"), (4, near * 3 + "x", "b"), (3, near * 3, "a"), (5, "word " * 200_000, "a"), (6, "a text without an id", "b"), (7, "Ünïcode ‘text’", None)]
    more = {c: 777 for c in ("score", "predicted", "row", "body", "id", "y", "x", "h", "key", "u", "v", "s", "c", "owner", "cid", "rid", "n", "source_size", "__row", "__source", "__u", "__scored")}
    schema = "doc_id long, text string, source string, " + ", ".join(f"{c} int" for c in more)
    docs = spark.createDataFrame([(*r, *more.values()) for r in rows], schema)
    *kept, last = _through(spark, docs, tmp_path)
    for d in kept:
        assert d.columns == docs.columns and d.where(" or ".join(f"{c} <> 777" for c in more)).count() == 0
    exact = {(r.doc_id, r.text) for r in kept[1].select("doc_id", "text").collect()}
    toxic = {(r.doc_id, r.text) for r in kept[0].select("doc_id", "text").collect()}
    assert {i for i, _ in exact} == {i for i, _ in toxic if i not in (2, None)} or not {1, 2, 6} <= {i for i, _ in toxic}
    assert {r.doc_id for r in kept[2].collect()} == {i for i, _ in exact} - ({4} if {3, 4} <= {i for i, _ in exact} else set())
    assert last.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and last.count() == kept[3].count()


def test_pipeline_of_nothing(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    assert [d.count() for d in _through(spark, docs, tmp_path)] == [0] * 5


def test_sources_do_not_reach_in():
    here = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for top, _, names in os.walk(os.path.join(here, "lumenbox")):
        if os.sep + "llm" not in top:
            for n in names:
                if n.endswith(".py"):
                    assert ".llm" not in open(os.path.join(top, n)).read()
