import zlib

import numpy as np
from conftest import ODD

from inkstone.llm import hd_language as H


def test_bundles_follow_the_definition():
    text = "Ab, cé"
    s = " ab cé "
    vec = lambda c: H.letter(ord(c)).astype(int)
    want = sum(np.roll(vec(s[i]), 2) * np.roll(vec(s[i + 1]), 1) * vec(s[i + 2]) for i in range(len(s) - 2))
    assert (H.bundle(*H.trigrams(text)) == want).all()


def test_prototypes_do_not_depend_on_partitions(make):
    rows = [(i, t, k) for i, (t, k) in enumerate([("the house", "x"), ("das haus", "y"), ("the home", "x"), (None, "x"), ("zzz", None), ("", "y")] * 5)]
    a, b = H.profiles(make(rows).repartition(7)), H.profiles(make(rows).coalesce(1))
    assert list(a) == list(b) == ["x", "y"] and all((a[k] == b[k]).all() for k in a)
    raw = {k: sum(H.bundle(*H.trigrams(t)) for _, t, m in rows if m == k and t) for k in "xy"}
    unit = {k: v / np.linalg.norm(v) for k, v in raw.items()}
    centred = unit["x"] - (unit["x"] + unit["y"]) / 2
    assert np.allclose(a["x"], centred / np.linalg.norm(centred))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = H.identify(docs).join(docs.select("doc_id", "lang", "n_chars"), "doc_id").where("held_out AND n_chars > 40").collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.99


def test_odd_rows(make):
    rows = [(i, t, "en") for i, t in enumerate(ODD)] + [(50, "the the", "en"), (51, "le la", "fr"), (None, "le", None), (51, "le la", "fr"), (60, "123 !?", "fr")]
    got = H.identify(make(rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 4 == 2) and 0 <= r.score <= 1
    by = {r.doc_id: r.lang_pred for r in got}
    assert by[0] == by[1] == by[2] == by[60] == "und"
    assert [(r.lang_pred, r.score) for r in H.identify(make([(1, "a b", None)])).collect()] == [("und", 0.0)]
    assert H.identify(make([])).count() == 0
