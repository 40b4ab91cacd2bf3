"""The pipeline, stage by stage against plain versions, and over odd tables."""

from collections import Counter

import corpus_pipeline as cp
from terraspan.llm import quality
from tests.llm.test_operators import check_pieces, id_key, near_groups, removed, rows_of, tokenizer  # noqa: F401

SF = "/root/testdata/sf0.001"


def stage(spark, docs, name, sf_dir=SF):
    return dict(cp.STAGES)[name](spark, docs, sf_dir)


def texts(docs):
    return Counter((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())


def test_stages_in_turn(spark, some, tokenizer):  # noqa: F811
    assert [n for n, _ in cp.STAGES] == ["quality", "exact", "near", "substring", "packing"]
    docs = stage(spark, some, "quality").cache()
    model = quality.fit(some, spark.read.parquet(f"{SF}/labels.parquet"))
    assert texts(docs) == texts(quality.scored(some, model).where("score >= 0.5")) and 0 < docs.count() < some.count()
    rows = rows_of(docs)
    keep = {}
    for i, t in rows:
        keep[t] = max(i, keep.get(t, i))
    docs = stage(spark, docs, "exact").cache()
    rows = sorted((i, t) for t, i in keep.items())
    assert texts(docs) == Counter(rows)
    root = near_groups(rows)
    rows = [rows[k] for k in sorted(set(root))]
    docs = stage(spark, docs, "near").cache()
    assert texts(docs) == Counter(rows)
    rows = [(i, b" ".join(x for k, x in enumerate(w) if k not in g).decode() if g else t) for (i, t), (w, g) in zip(rows, removed(rows, 20), strict=True)]
    docs = stage(spark, docs, "substring").cache()
    assert texts(docs) == Counter(rows) and docs.columns == some.columns
    out = stage(spark, docs, "packing").collect()
    check_pieces(out, rows, tokenizer, 4096)
    assert Counter((r.doc_id, r.start, r.length) for r in cp.run(spark, SF).collect()) and {r.doc_id for r in cp.run(spark, SF).select("doc_id").collect()} == {i for i, _ in rows}


def test_odd_and_empty_tables(spark, odd, empty, tmp_path):
    labels = spark.createDataFrame([(0, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for table in (odd, empty):
        docs = table
        for name, _ in cp.STAGES[:-1]:
            docs = stage(spark, docs, name, str(tmp_path))
            assert docs.columns == table.columns
        stage(spark, docs, "packing").collect()
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    assert cp.run(spark, str(tmp_path)).collect() == []


def test_clean_documents_pass_unchanged(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([(i, f"document  number {i}\nhas {' '.join(str(i * 1000 + k) for k in range(50))}", "en") for i in range(40)], "doc_id long, text string, lang string")
    out = docs
    for name, _ in cp.STAGES[:-1]:
        out = stage(spark, out, name, str(tmp_path))
    assert texts(out) == texts(docs) and id_key(None) < id_key(-1)
