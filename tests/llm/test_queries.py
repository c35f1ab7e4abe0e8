"""Registered queries against their SQL, and the pipeline stage by stage."""

import duckdb
import pytest

import corpus_pipeline
from vesselflow.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(SQL[name]).df()
    got = QUERIES[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    assert sorted(map(repr, got[cols].itertuples(index=False, name=None))) == sorted(map(repr, want[cols].itertuples(index=False, name=None)))


def test_ngram_stage(spark):
    """The stage against all pairs: five-word shingles, similarity 0.8; edits that four-word shingles at 0.85 miss among them."""
    rows = []
    for size in (30, 49, 50, 52, 60, 90):
        words = [f"t{size}w{i}" for i in range(size)]
        for k, edits in enumerate(((), (size // 2,), (10, 20))):
            rows.append((size * 10 + k, " ".join(f"e{k}" if i in edits else w for i, w in enumerate(words))))
    sets = {d: {tuple(w[i:i + 5]) for i in range(len(w) - 4)} for d, w in ((d, t.split()) for d, t in rows)}
    root = {d: d for d in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((root[a], root[b]))
                root = {k: x if v == y else v for k, v in root.items()}
    assert root[491] == 490 and root[301] == 301
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [r.doc_id for r in dict(corpus_pipeline.STAGES)["ngram_jaccard_join"](spark, docs, SF).collect()]
    assert sorted(got) == sorted(set(root.values()))


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "ngram_jaccard_join", "mix_sources", "best_fit_packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).schema.names == docs.columns
    out = corpus_pipeline.run(spark, SF).toPandas()
    assert len(out) and out.groupby("sequence_id").length.sum().max() <= 2048
