import shutil

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def test_stages_in_order(spark, tmp_path):
    """Each stage on what the one before wrote: columns, ids, and what it must and must not drop."""
    from interlace.llm import quality

    from .test_nearcopies import slow_groups

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_dedup", "suffix_dedup", "mixing", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    frames = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, frames[-1], SF).write.parquet(f"{tmp_path}/{name}")
        frames.append(spark.read.parquet(f"{tmp_path}/{name}"))
    for f in frames[:-1]:
        assert f.columns == docs.columns
    ids = [[r.doc_id for r in f.select("doc_id").collect()] for f in frames]
    judged = {r.doc_id for r in quality.judge(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect() if r.kept}
    assert sorted(ids[1]) == sorted(judged)
    rows = sorted((r.doc_id, r.text) for r in frames[1].select("doc_id", "text").collect())
    assert sorted(ids[2]) == sorted({rows[i][0] for i in slow_groups([t for _, t in rows])})
    assert sorted(ids[3]) == sorted(ids[2])
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").filter("toxic = 1").collect()}
    gone = set(ids[3]) - set(ids[4])
    assert not gone - toxic
    texts = {r.doc_id: r.n for r in frames[4].groupBy("doc_id").count().withColumnRenamed("count", "n").collect()}
    wholes = {r.doc_id: r.n for r in frames[5].filter("start = 0").groupBy("doc_id").count().withColumnRenamed("count", "n").collect()}
    assert wholes == texts


def test_odd_rows_go_through_all_stages(spark, tmp_path):
    """Null and repeated ids, null and very long texts, a column of a clashing name; and an empty table."""
    from .cases import LONG, documents, empty

    docs = documents(spark, LONG[::-1], "the other text of an id that comes twice " + LONG[9000:14000])
    twice = docs.filter("doc_id = 12").selectExpr("2L AS doc_id", *docs.columns[1:])
    nameless = docs.filter("doc_id = 11").selectExpr("CAST(NULL AS LONG) AS doc_id", *docs.columns[1:])
    for name, rows in (("some", docs.unionByName(twice).unionByName(nameless)), ("none", empty(spark))):
        rows.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(2, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        if name == "none":
            assert not out
        else:  # of the long texts, the copies without an id of their own go
            assert {r.doc_id for r in out} == {2, 11}
            for key in (2, 11):
                pieces = [r for r in out if r.doc_id == key]
                assert sum(r.length for r in pieces) == sum(r.doc_tokens for r in pieces if r.start == 0)


def test_entry_works_without_the_corpus_folders(tmp_path):
    """The rest of the repository imports and answers when the corpus folders and the pipeline are deleted."""
    import subprocess
    import sys
    from pathlib import Path

    root = Path(corpus_pipeline.__file__).parent
    shutil.copytree(root / "interlace", tmp_path / "interlace", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op1_') for n in q) and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
