import corpus_pipeline as P
from conftest import ODD

import __spark_entry__ as entry
from inkstone.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_every_operator_is_registered():
    names = entry.queries()
    assert set(QUERIES) | {"pipeline"} <= set(names)
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
    assert [n for n, _ in P.STAGES] == ["quality_classifier", "line_dedup", "minhash_near_dedup", "benchmark_decontamination", "sentencepiece"]


def test_stages_hand_on_what_they_keep(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    counts = [docs.count()]
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, SF)
        if k < len(P.STAGES) - 1:
            assert out.columns == docs.columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes]
        out.write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        ids = [r.doc_id for r in out.select("doc_id").collect()]
        assert len(ids) == len(set(ids)) and set(ids) <= {r.doc_id for r in docs.select("doc_id").collect()}
        counts.append(len(ids))
        if name == "line_dedup":
            assert any(r.text != texts[r.doc_id] for r in out.collect())
        docs = out
    assert counts[1] < counts[0] and counts[3] < counts[2] and counts[5] == counts[4] > counts[0] / 3
    assert sorted(r.doc_id for r in P.run(spark, SF).collect()) == sorted(ids)


def test_stages_take_odd_rows(spark, make):
    cols = ["doc_id", "text", "lang", "source", "n_chars"]
    docs = make([(i, t) for i, t in enumerate(ODD)] + [(None, "some text here"), (None, None)]).select(cols)
    for _, stage in P.STAGES:
        assert stage(spark, docs, SF).count() >= 0
        assert stage(spark, docs.limit(0), SF).count() == 0
