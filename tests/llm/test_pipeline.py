import duckdb

import corpus_pipeline
from lectern.llm import queries


def test_pipeline_runs_and_keeps_columns(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    assert docs.count() > 0 and {"sequence_id", "offset"} <= set(docs.columns)


def test_pipeline_of_nothing(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.count() == 0


def test_sql_agrees(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        df = queries.QUERIES[name](spark, sf)
        cur = con.execute(sql)
        assert sorted(c[0] for c in cur.description) == sorted(df.columns)
        order = [c[0] for c in cur.description]
        assert sorted(map(str, cur.fetchall())) == sorted(str(tuple(r)) for r in df.select(*order).collect()), name


def test_pipeline_of_odd_rows(spark, sf, tmp_path):
    """Null and empty texts, repeated rows, null ids and columns whose names clash with inner ones pass every stage."""
    good = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 40").select("doc_id", "text", "lang", "source", "n_chars")
    odd = [(9001, None), (9002, ""), (9003, "My SSN is 123-45-6789."), (9003, "My SSN is 123-45-6789."), (None, "No id here, yet a text."), (None, None)]
    odd = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in odd], good.schema)
    names = ("_found", "_key", "_hit", "_row", "_words", "found", "doc", "key", "id", "runs", "made", "score", "_quality", "row", "bucket", "class_id", "d1")
    docs = good.unionByName(odd).selectExpr("*", *[f"'{n}' as {n}" for n in names])
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        rows = docs.collect()
        assert rows and docs.columns == [*good.columns, *names]
        assert all(r[n] == n for r in rows for n in names), name
        assert all(r.n_chars == len(r.text or "") for r in rows)
    assert not any("123-45-6789" in (r.text or "") for r in rows)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert sum(p.start == 0 for p in pieces) == len(rows)
