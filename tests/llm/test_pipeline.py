import corpus_pipeline as P
from pyspark.sql import functions as F

from quilldex.llm.common import Work


def test_stages_keep_the_columns_and_clean_documents(spark, docs):
    work, rows = Work(spark, "t"), docs.withColumn("node", F.lit("clash"))
    sizes = []
    for name, stage in P.STAGES:
        rows = work.keep(stage(spark, rows, None), name)
        sizes.append(rows.count())
        if name != P.STAGES[-1][0]:
            assert rows.columns == [*docs.columns, "node"]
        if name == "near_duplicates":
            assert rows.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").count() == 0
    assert sizes[0] == docs.filter("text rlike '[a-zA-Z]'").count() and sizes[1] < sizes[0] and sizes[2] == sizes[1]
    assert sizes[3] == sizes[4] > 0 and [n for n, _ in P.STAGES] == ["language", "near_duplicates", "personal_data", "mixture", "tokens"]


def test_empty_documents(spark, no_docs):
    rows = no_docs
    for _, stage in P.STAGES:
        rows = stage(spark, rows, None)
    assert rows.count() == 0


def test_run_leaves_only_its_result(spark, docs, tmp_path):
    docs.limit(30).write.parquet(f"{tmp_path}/documents.parquet")
    before = len(Work.open)
    assert P.run(spark, str(tmp_path)).count() > 0
    assert len(Work.open) == before + 1


def test_working_tables_can_be_removed(spark):
    from pathlib import Path

    work = Work(spark, "t")
    kept = work.keep(spark.range(5), "five")
    folder = Path(work.root.removeprefix("file:"))
    assert kept.count() == 5 and folder.exists()
    work.close()
    assert not folder.exists() and work not in Work.open
