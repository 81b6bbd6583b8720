"""The pipeline, stage by stage, against brute force over the rows that each stage is given."""

import corpus_pipeline
import text_cases as cases
from pyspark.sql import functions as F

from stratapanel.llm import compression_rules, decontamination


def test_stages(spark, tmp_path):
    docs = cases.given_docs(spark)
    given = docs.schema.names
    bench = [r.text for r in spark.read.parquet(f"{cases.SF}/benchmark.parquet").collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, cases.SF).write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        rows, left = cases.rows_of(docs), {r.doc_id for r in after.select("doc_id").collect()}
        assert k == 4 or after.schema.names == given
        if k == 0:
            failed = {key for key, t in rows if cases.brute_measures(t)[-1]}
            assert failed and not failed & left
            judged = {r.doc_id for r in compression_rules.judge(docs).filter("kept").collect()}
            assert left == judged and len(left) > 0.95 * (len(rows) - len(failed))
        if k == 1:
            assert left == {min(rows[m][0] for m in members) for _, members in cases.brute_components(rows, 80)}
        if k == 2:
            leaked = {key for key, t in rows if any(x in t for x in bench)}
            scored = {r.doc_id for r in decontamination.matches(docs, spark.read.parquet(f"{cases.SF}/benchmark.parquet")).collect()}
            assert leaked <= scored and left == {key for key, _ in rows} - scored
        if k == 3:
            assert left == {key for key, _ in rows}
            assert not any(s.startswith(("email", "card")) for _, t in cases.rows_of(after) for s in cases.brute_spans(t))
            same = {key: t for key, t in rows if not cases.brute_spans(t)}
            now = dict(cases.rows_of(after))
            assert sum(now[key] == t for key, t in same.items()) >= len(same) - 2
        if k == 4:
            assert left == {key for key, _ in rows}
            assert after.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 2048").count() == 0
        docs = after


def test_run_and_awkward_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, cases.SF).select("doc_id").distinct().count() > 100
    for name, rows in (("edges", cases.edge_rows()), ("empty", [])):
        spark.createDataFrame(rows, cases.SCHEMA).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(0, cases.PROSE), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        got = corpus_pipeline.run(spark, f"{tmp_path}/{name}").count()
        assert (got > 0) == bool(rows)
