import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from conftest import ODD
from pyspark.sql import functions as F

from inkstone.llm import context_tree as T


def brute(train, text):
    """log10 probability of a text: trees as dictionaries, weights by recursion, bit by bit."""
    def steps(t):
        b = b"\xff" * T.DEPTH + (t or "").encode().lower() + b"\xff"
        for i in range(T.DEPTH, len(b)):
            for j in range(8):
                yield b[i - T.DEPTH:i][::-1], b[i] >> 8 - j | 1 << j, b[i] >> 7 - j & 1

    n, longer = Counter(), {}
    for t in train:
        for ctx, heap, bit in steps(t):
            for d in range(T.DEPTH + 1):
                n[ctx[:d], heap, bit] += 1
                if d:
                    longer.setdefault((ctx[:d - 1], heap), set()).add((ctx[:d], heap))
    kt, memo = {}, {}

    def log_kt(s):
        if s not in kt:
            a, b = n[(*s, 0)], n[(*s, 1)]
            kt[s] = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)
        return kt[s]

    def log_w(s):
        if s not in memo:
            x = log_kt(s)
            if len(s[0]) < T.DEPTH:
                y = sum(map(log_w, longer.get(s, ())))
                m = max(x, y)
                x = m + math.log((math.exp(x - m) + math.exp(y - m)) / 2)
            memo[s] = x
        return memo[s]

    total = 0.0
    for ctx, heap, bit in steps(text):
        p = None
        for d in range(T.DEPTH, -1, -1):
            s = (ctx[:d], heap)
            own = (n[(*s, bit)] + 0.5) / (n[(*s, 0)] + n[(*s, 1)] + 1)
            a = 1.0 if d == T.DEPTH else 0.5 * math.exp(log_kt(s) - log_w(s))
            p = own if p is None else a * own + (1 - a) * p
        total += math.log10(p)
    return total


def base(train, text):
    c = Counter(w for t in train for w in [*(t or "").encode().lower().split(), None])
    n, v = sum(c.values()), len(c)
    tokens = [*(text or "").encode().lower().split(), None]
    return len(tokens), sum(c[w] > 0 for w in tokens), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)


def check(got, rows):
    held = lambda i: zlib.crc32(str(i if i is not None else "").encode()) % 10 == 0
    train = [t for i, t in rows if not held(i)]
    want = sorted(((i, held(i), *base(train, t), brute(train, t)) for i, t in rows), key=repr)
    out = sorted((tuple(r) for r in got), key=repr)
    assert len(out) == len(want)
    for a, b in zip(out, want):
        assert a[:5] == b[:5] and all(math.isclose(x, y, rel_tol=1e-8) for x, y in zip(a[5:], b[5:]))


def test_matches_the_definition(make):
    rows = [(i, t) for i, t in enumerate(["The cat sat on the mat", "the dog sat", "a cat", "The DOG ran\nfast", "été 한", "the log sat on"] * 4)]
    rows += [(100 + i, (t or "")[:60] if t is not None else None) for i, t in enumerate(ODD)] + [(None, "the"), (3, "the dog sat")]
    check(T.cross_validated(make(rows)).collect(), rows)


def test_blocks_do_not_change_scores(make, samples, monkeypatch):
    rows = samples[:30]
    one = {r.doc_id: r.score for r in T.cross_validated(make(rows)).collect()}
    monkeypatch.setattr(T, "BLOCK_CHARS", 5000)
    monkeypatch.setattr(T, "PIECE_BYTES", 1000)
    for r in T.cross_validated(make(rows)).collect():
        assert math.isclose(r.score, one[r.doc_id], rel_tol=1e-9)


def test_better_than_words_on_held_out_rows(spark):
    got = T.cross_validated(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").agg({"score": "sum", "base_score": "sum"}).first()
    assert got["sum(score)"] > got["sum(base_score)"]


def test_empty_and_untrained(make):
    assert T.cross_validated(make([])).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    r = T.cross_validated(make([(held, "ab")])).first()
    assert r.held_out and r.n_known == 0 and r.train_tokens == 0 and math.isclose(r.score, 24 * math.log10(0.5)) and math.isclose(r.base_score, 0, abs_tol=1e-12)


def test_blocks_keep_texts_compressed(spark, make, samples):
    """Texts are written once in compressed pieces; a block is bounded, and small scan tasks share one."""
    rows = [(i, (t or "") * 40) for i, t in samples[:40]] + [(None, None)]
    d = make(rows).withColumn("train", F.lit(True)).coalesce(1)
    got = d.mapInArrow(T.pack, "block long, docs binary").collect()
    assert sum(len(r.docs) for r in got) < sum(len(t.encode()) for _, t in rows if t) / 2
    back = [t for r in got for t in T.unpack(bytes(r.docs)).column("text").to_pylist()]
    assert sorted(back, key=repr) == sorted((t for _, t in rows), key=repr)
    assert "text" not in T.cross_validated(make(rows))._jdf.queryExecution().executedPlan().toString()


def test_words_of_a_piece_are_searched_at_once(monkeypatch):
    texts = [" ".join(f"word{i}x{k}" for k in range(200)) for i in range(10)] + ["", None]
    docs = pa.table({"doc_id": list(range(12)), "text": pa.array(texts, pa.string()), "train": [i % 3 != 0 for i in range(12)]})
    keys, counts = T.counted(iter([docs]))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, docs.schema) as out:
        out.write_table(docs)
    held = pa.table({"docs": pa.array([sink.getvalue().to_pybytes()], pa.binary())})
    searches, plain = [], np.searchsorted

    def counting(*args, **more):
        searches.append(args)
        return plain(*args, **more)

    monkeypatch.setattr(T.np, "searchsorted", counting)
    got = T.answer(held, pa.table({"key": keys, "value": counts.astype(float)})).to_pydict()
    assert len(searches) < 10  # one for each of the 2,000 words before
    assert got["n_tokens"] == [201] * 10 + [1, 1]
    assert got["n_known"] == [1 if i % 3 == 0 else 201 for i in range(10)] + [1, 1]
