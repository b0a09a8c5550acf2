from collections import Counter
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from routestats.llm import queries
from routestats.llm.mixing import repetitions
from routestats.llm.near_duplicates import near_duplicates
from routestats.llm.pieces import read_pieces
from routestats.llm.quality import score_quality

def test_stages_act_on_what_the_one_before_kept(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {}
    for at, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / name))
        kept[name] = spark.read.parquet(str(tmp_path / name))
        if at < len(corpus_pipeline.STAGES) - 1:
            assert kept[name].columns == docs.columns
            docs = kept[name]
    first = spark.read.parquet(f"{sf}/documents.parquet")
    good = score_quality(first, spark.read.parquet(f"{sf}/labels.parquet")).where("predicted = 1")
    ids = lambda df: sorted(r[0] for r in df.select("doc_id").collect())
    assert ids(kept["quality"]) == ids(good) and len(ids(good)) < first.count()
    assert ids(kept["near_duplicates"]) == ids(near_duplicates(kept["quality"]).where("kept"))
    assert ids(kept["pseudonyms"]) == ids(kept["near_duplicates"])
    means = {r.source: r["mean"] for r in repetitions(kept["pseudonyms"]).collect()}
    assert abs(sum(means[r.source] for r in kept["pseudonyms"].collect()) / kept["mixing"].count() - 1) < 0.2
    texts = dict(kept["mixing"].select("doc_id", "text").collect())
    model = read_pieces()
    rows = kept["pieces"].collect()
    assert Counter(r.doc_id for r in rows) == Counter(ids(kept["mixing"]))
    assert all(model.decode(r.ids) == texts[r.doc_id] and r.decoded_matches for r in rows)


def test_run_is_the_stages_in_order(spark, sf):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "pseudonyms", "mixing", "pieces"]
    assert corpus_pipeline.run(spark, sf).where(~F.col("decoded_matches")).count() == 0


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_against_sql(spark, sf, name):
    con = duckdb.connect()
    for table in ("documents", "labels", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    rows = con.execute(queries.SQL[name])
    columns = [c[0] for c in rows.description]
    want = Counter(rows.fetchall())
    assert Counter(map(tuple, queries.QUERIES[name](spark, sf).select(*columns).collect())) == want


def test_every_operator_has_a_query(spark, sf):
    numbers = {int(name[2:].split("_")[0]) for name in queries.QUERIES}
    assert numbers == set(range(1, 11))
    for name, query in queries.QUERIES.items():
        assert query(spark, sf).columns, name


def test_entry_registers_them_only_here():
    import __spark_entry__

    assert {*queries.QUERIES, "pipeline"} <= set(__spark_entry__.queries())
    package = Path(corpus_pipeline.__file__).parent / "routestats"
    others = [p for p in package.rglob("*.py") if "llm" not in p.relative_to(package).parts]
    assert others and not [p for p in others if "llm" in p.read_text()]
