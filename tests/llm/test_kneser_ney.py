import math
from collections import Counter

from conftest import ODD

from inkstone.llm import kneser_ney as K


def discounts(table):
    m = Counter(c for c in table.values() if c <= 4)
    n1, n2, n3, n4 = (m[i] for i in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
    raw = [i - (i + 1) * y * hi / lo if lo else 0.5 * i for i, lo, hi in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return [min(0.95 if i == 1 else i - 0.05, max(0.05, r)) for i, r in zip((1, 2, 3), raw)]


def brute(texts):
    """p(last | rest) of the interpolated model, straight from its definition."""
    n = K.ORDER
    tables = {n: Counter()}
    for t in texts:
        t = chr(K.PAD) * (n - 1) + " ".join((t or "").split())
        tables[n].update(t[i:i + n] for i in range(len(t) - n + 1))
    for k in range(n - 1, 0, -1):
        tables[k] = Counter(g[1:] for g in tables[k + 1])
    d = {k: discounts(tables[k]) for k in tables}
    unseen = 1 / (len(tables[1]) + 1)

    def p(g):
        if not g:
            return unseen
        k = len(g)
        follow = {x: c for x, c in tables[k].items() if x[:-1] == g[:-1]}
        if not follow:
            return p(g[1:])
        total = sum(follow.values())
        cut = lambda c: d[k][min(c, 3) - 1]
        own = max(0, follow[g] - cut(follow[g])) / total if g in follow else 0
        return own + sum(map(cut, follow.values())) / total * p(g[1:])

    return p


def test_probabilities_match_the_definition(spark, make):
    train = ["the cat sat on the mat", "the dog sat  on\nthe log", None, ""]
    test = ["the cat on the log", "zebra", "a", ""]
    rows = K.model(K.count_ngrams(make([(i, t) for i, t in enumerate(train)]))).cache()
    unseen = rows.where("key = 0").first().value
    got = {r.doc_id: r for r in K.perplexities(make([(i, t) for i, t in enumerate(test)]), rows, unseen).collect()}
    p = brute(train)
    for i, t in enumerate(test):
        x = chr(K.PAD) * (K.ORDER - 1) + t
        want = sum(math.log(p(x[k:k + K.ORDER])) for k in range(len(t)))
        assert got[i].n_chars == len(t) and math.isclose(got[i].logp, want, rel_tol=1e-9, abs_tol=1e-9)


def test_follow_up_probabilities_sum_to_one(make):
    p = brute(["abab", "abc"])
    seen = set("abc") | {chr(K.PAD)}
    assert math.isclose(sum(p("xab"[:3] + c) for c in sorted(seen - {chr(K.PAD)})) + 1 / 4 * 0, sum(p("xab" + c) for c in "abc"))


def test_rejects_junk_keeps_clean_and_every_row(spark, make, samples):
    labels = spark.createDataFrame([(i, 1, 0) for i, t in samples if "###" not in t and "!!" not in t and "|" not in t] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    rows = samples + [(1000 + i, t, None) for i, t in enumerate(ODD)] + [(None, "the"), (3, "x" * 50), (2000, "Qx## zz!! ***& kq|| " * 40)]
    got = K.classify(make(rows), labels).collect()
    assert len(got) == len(rows)
    kept = {r.doc_id: r.kept for r in got}
    assert not kept[2000] and not kept[1001]
    good = [r.kept for r in got if r.doc_id in {x.doc_id for x in labels.collect()} and r.doc_id is not None]
    assert sum(good) / len(good) > 0.9


def test_without_labels_everything_stays(spark, make):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.kept for r in K.classify(make([(1, "a"), (2, None)]), none).collect()] == [True, True]
    assert K.classify(make([]), none).count() == 0


def test_every_trusted_document_of_the_training_half_trains(spark, monkeypatch):
    seen = []
    count = K.count_ngrams
    monkeypatch.setattr(K, "TRAIN_DOCS", 3, raising=False)  # a bound of earlier versions
    monkeypatch.setattr(K, "count_ngrams", lambda docs: seen.extend(r[0] for r in docs.select("doc_id").collect()) or count(docs))
    docs = spark.createDataFrame([(i, f"text number {i} of some", "en") for i in range(40)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    K.verdicts(docs, labels).collect()
    assert sorted(seen) == sorted(r["doc_id"] for r in K.trusted_ids(labels).where("trains").collect()) and len(seen) > 3
