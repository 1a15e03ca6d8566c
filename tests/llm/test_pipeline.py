import sys

import corpus_pipeline
from glyphmill.llm import near_dedup, secrets


def test_stages(spark):
    """Each stage keeps the columns and takes effect; the rows equal those of the stages one by one."""
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    n = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, d)
        docs = spark.createDataFrame(docs.toPandas(), docs.schema).coalesce(2)
        assert docs.columns == columns, name
        n.append(docs.count())
    assert n[0] > n[1] > n[2] >= n[3] == n[4] > 0
    assert all(r.kept for r in near_dedup.near_groups(docs).collect())
    assert not any(r.n_assign or r.n_access or r.n_hex for r in secrets.find_secrets(docs).collect())
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, d)
    key = lambda df: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in df.collect())
    assert key(packed) == key(corpus_pipeline.run(spark, d))


def test_edges(spark, tmp_path):
    """Nulls, repeated rows, clashing columns, empty texts and a long one; then an empty table."""
    good = lambda i: f"the nation number {i} of things " + " ".join(f"word{i}x{k}" for k in range(40))
    rows = [(i, good(i), "en", "web", len(good(i)), 1.0, "x") for i in range(30)]
    rows += [rows[0], (100, None, None, None, None, None, None), (101, "", "en", "web", 0, 0.0, ""), (None, good(200), "en", "web", 5, 0.0, "y")]
    rows += [(102, "first " + " ".join(f"long{k}" for k in range(100_000)), "en", "web", 7, 0.0, "z"), (103, good(3) + " more", "en", "web", 9, 0.0, "k")]
    rows += [(104, good(50) + " the benchmark says this and no other thing", "en", "web", 9, 0.0, "b"), (105, good(51) + " password=hunter2hunter2", "en", "web", 9, 0.0, "s")]
    names = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string"
    spark.createDataFrame(rows, names).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "the benchmark says this and no other thing"), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    counts = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        docs = spark.createDataFrame(stage(spark, docs, str(tmp_path)).collect(), docs.schema).coalesce(2)
        assert docs.columns == columns
        counts.append(docs.count())
    # the repeated row and the near copy go, then the document with the benchmark passage
    assert counts == [len(rows), len(rows) - 2, len(rows) - 3, len(rows) - 3]
    text = {r.doc_id: (r.text, r.n_chars, r.kept) for r in docs.collect()}
    assert text[100] == (None, None, None) and text[101][0] == "" and text[105][0].endswith(" [assign]") and text[105][1] == len(text[105][0])
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(text)
    (tmp_path / "none").mkdir()
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(str(tmp_path / f"{name}.parquet")).limit(0).write.parquet(str(tmp_path / "none" / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).collect() == []


def test_entry_works_without_the_subpackage(tmp_path):
    import os
    import shutil
    import subprocess

    root = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    for name in ("__spark_entry__.py", "glyphmill"):
        source = os.path.join(root, name)
        (shutil.copytree if os.path.isdir(source) else shutil.copy)(source, tmp_path / name)
    shutil.rmtree(tmp_path / "glyphmill" / "llm")
    code = "import __spark_entry__ as e; assert 'token_counts' in e.queries() and not any(k.startswith('op') and k[2].isdigit() for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, check=True)
