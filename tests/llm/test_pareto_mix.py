import math
import re
from collections import defaultdict

import pytest
from conftest import ODD
from pyspark.sql import functions as F

from inkstone.llm import pareto_mix as M

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def build(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, 2, "x", 0.1, "k") for i, t, s in rows], "doc_id long, text string, source string, size long, row int, key string, u double, target string")


def taken(spark, rows, **more):
    return [r.asDict() for r in M.mix(build(spark, rows), **more).collect()]


def targets(rows, weights=(5, 2, 1), budget=1.5, most=2):
    words = defaultdict(int)
    for _, t, s in rows:
        words[s] += len(WORD.findall(t or ""))
    order = sorted(words, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    capped, total = set(), budget * sum(words.values())
    while True:
        rest = total - sum(most * words[s] for s in capped)
        w = sum(weight[s] for s in order if s not in capped)
        level = rest / w if w else 0
        over = {s for s in order if s not in capped and weight[s] * level > most * words[s]}
        if not over:
            return {s: (words[s], float(most * words[s]) if s in capped else weight[s] * level) for s in order}
        capped |= over


def corpus(n=900):
    return [(i, "w " * (1 + (i * 37) % 90 + (3000 if i % 97 == 0 else 0)), "big" if i % 3 == 0 else None if i % 17 == 0 else f"s{i % 7}") for i in range(n)]


def check(rows, got, slack):
    want = targets(rows)
    assert len(got) == len(rows)
    words = defaultdict(int)
    for r in got:
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 2
        assert r["source_size"] == want[r["source"]][0] and math.isclose(r["target"], want[r["source"]][1], abs_tol=1e-6)
        words[r["source"]] += r["taken"]
    for s, (_, t) in want.items():
        assert abs(words[s] - t) <= slack(t), (s, t, words[s])


def test_targets_and_taken_words(spark):
    rows = corpus()
    check(rows, taken(spark, rows), lambda t: 0.01 * t + 1)


def test_reruns_and_partitions_agree(spark):
    rows = corpus(500)
    a = M.mix(build(spark, rows).repartition(7)).select("doc_id", "taken")
    b = M.mix(build(spark, rows).coalesce(1)).select("doc_id", "taken")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_runs_are_prefixes_of_the_ranks(spark):
    rows = [("a" if i % 4 else "b", 1000 + i, i, (i * 7919 % 997) / 997 + 1e-4 * (i % 3), 1 + i % 13) for i in range(800)]
    df = spark.createDataFrame(rows, "key string, row long, doc_id long, v double, size long").where("v < 1")
    rest = spark.createDataFrame([("a", 1500.5), ("b", 7.0)], "key string, rest double")
    live = [tuple(r) for r in df.collect()]
    for buckets in (1, 16, 1000):
        got = {r["row"] for r in M.runs(df, rest, buckets, 2).collect()}
        want = set()
        for key, most in (("a", 1500.5), ("b", 7.0)):
            total = 0
            for r in sorted((r for r in live if r[0] == key), key=lambda r: (r[3], r[2], r[4])):
                total += r[4]
                if total > most:
                    break
                want.add(r[1])
        assert got == want


def test_inclusion_follows_the_odds(spark):
    """Over many seeds a document's mean copies come near its expected ones, more for short texts."""
    n = 3000
    rows = [(i, "a " * (8 if i % 2 else 200), "s") for i in range(n)]
    got = taken(spark, rows, budget=0.5)
    words = n // 2 * 208
    level = 0.5 * words / (n // 2 * (8 + 200 / 2))
    by = {size: sum(r["copies"] for r in got if r["size"] == size) / (n // 2) for size in (8, 200)}
    assert by[8] == pytest.approx(level, abs=0.05) and by[200] == pytest.approx(level / 2, abs=0.05)


def test_odd_rows(spark):
    rows = [(i, t, s) for i, t in enumerate([*ODD, "w " * 300_000]) for s in ("a", None)] + [(None, "a b c", "a"), (None, "a b c", "a"), (1, "x", ""), (1, "x", ""), (2, None, "empty"), (3, "", "empty")]
    got = taken(spark, rows)
    check(rows, got, lambda t: 700_000)
    assert all(r["taken"] == 0 for r in got if r["size"] == 0)
    assert taken(spark, []) == []
    assert [(r["target"], r["taken"]) for r in taken(spark, [(1, None, None)])] == [(0.0, 0)]


def test_whole_targets_take_everything_twice(spark):
    rows = [(i, "a b c", "one") for i in range(50)]
    assert all(r["copies"] == 2 for r in taken(spark, rows, budget=2.0))


def test_uniform_numbers_are_spread(spark):
    u = [r[0] for r in M.words(build(spark, [(i, "t", "s") for i in range(2000)])).select("u").collect()]
    assert 0 < min(u) and max(u) < 1 and abs(sum(u) / len(u) - 0.5) < 0.03
    assert M.words(build(spark, [])).agg(F.count("*")).first()[0] == 0
