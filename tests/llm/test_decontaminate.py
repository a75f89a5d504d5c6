import random

import pytest
from conftest import ODD

from inkstone.llm import decontaminate as D

WORDS = "the cat ran over green hills while seven birds sang loudly near cold rivers and bright stars fell".split()


def text(rnd, n):
    return " ".join("".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 9))) if rnd.random() < 0.6 else rnd.choice(WORDS) for _ in range(n))


def edited(rnd, t, edits):
    t = list(t)
    for _ in range(edits):
        k = rnd.randrange(len(t))
        what = rnd.randrange(3)
        if what == 0:
            t[k] = "z"
        elif what == 1:
            del t[k]
        else:
            t.insert(k, "q")
    return "".join(t)


def holds(piece, x, k):
    """Whether a substring of x is within k edits of the piece: the whole table."""
    row = [0] * (len(x) + 1)
    for c in piece:
        new = [row[0] + 1]
        for j, y in enumerate(x):
            new.append(min(row[j] + (c != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row) <= k


def brute(items, t):
    x = D.squash(t)
    out = set()
    for item, b in items:
        one = D.Index([(item, b)])
        if any(holds(p, x, int(k)) for p, k in zip(one.text, one.edits)):
            out.add(item)
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_matches_full_alignment(seed):
    rnd = random.Random(seed)
    items = [(i, text(rnd, 14 + 4 * i)) for i in range(6)] + [(9, None), (10, "short")]
    index = D.Index(items)
    texts = [text(rnd, 80) for _ in range(6)] + ODD
    for i in range(6):
        for edits in (0, 3, 5, 12):
            b = items[i][1]
            texts.append(text(rnd, 20) + " " + edited(rnd, b, edits).upper() + "\n" + text(rnd, 20))
            texts.append(text(rnd, 9) + edited(rnd, b[:70], edits // 3))
    assert [index.items(t) for t in texts] == [brute(items, t) for t in texts]


def test_every_row_once_and_blocks_agree(spark, make, monkeypatch):
    rnd = random.Random(5)
    b = [(i, text(rnd, 20)) for i in range(5)]
    bench = spark.createDataFrame(b + [(None, None)], "item_id long, text string")
    rows = [(1, b[0][1]), (1, b[0][1]), (2, None), (None, "x " + b[3][1] + " y " + b[4][1]), (4, "clean text")]
    want = sorted([(1, 1, [0], False)] * 2 + [(2, 0, [], True), (None, 2, [3, 4], False), (4, 0, [], True)], key=repr)
    assert sorted((tuple(r) for r in D.decontaminate(make(rows), bench).collect()), key=repr) == want
    monkeypatch.setattr(D, "INDEX_CHARS", 150)
    assert sorted((tuple(r) for r in D.decontaminate(make(rows), bench).collect()), key=repr) == want
    assert all(r.kept for r in D.decontaminate(make(rows), bench.limit(0)).collect())
    assert D.decontaminate(make([]), bench).count() == 0
