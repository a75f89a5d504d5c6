import random

from conftest import ODD

from inkstone.llm import chosen_path as C
from inkstone.llm import links


def shingles(text, width):
    w = (text or "").encode().lower().split()
    return {tuple(w)} if 0 < len(w) < width else {tuple(w[i:i + width]) for i in range(len(w) - width + 1)}


def brute(rows, width, threshold):
    """component of every id: all pairs."""
    sets = [(i, shingles(t, width)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and y and 100 * len(x & y) >= threshold * len(x | y):
                p, q = sorted((root(i), root(j)))
                parent[q] = p
    return {i: root(i) for i in parent}


def corpus(seed):
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    rows, n = [], 0
    for _ in range(25):
        base = [rnd.choice(words) for _ in range(rnd.choice((3, 12, 60, 150)))]
        for _ in range(rnd.choice((1, 2, 5, 40))):
            t = list(base)
            for _ in range(rnd.choice((0, 0, 1, 2, len(t) // 12, len(t) // 7))):
                t[rnd.randrange(len(t))] = rnd.choice(words)
            rows.append((n, " ".join(t)))
            n += 1
    rnd.shuffle(rows)
    return rows


def check(make, rows, width, threshold):
    got = C.near_duplicates(make(rows), width, threshold).collect()
    assert len(got) == len(rows)
    want = brute(rows, width, threshold)
    sizes = {i: len(shingles(t, width)) for i, t in rows}
    for r in got:
        assert r.component_id == (None if r.doc_id is None else want[r.doc_id])
        assert r.kept == (r.doc_id is None or r.doc_id == r.component_id)
        if r.doc_id is not None:
            assert r.n_shingles == sizes[r.doc_id]


def test_matches_all_pairs(make):
    check(make, corpus(1), 2, 80)


def test_five_words_and_odd_rows(make):
    rows = corpus(2)[:150]
    rows += [(1000 + i, t) for i, t in enumerate(ODD)] + [(None, rows[0][1]), (None, None), (2000, "A b"), (2001, "a B"), rows[3], rows[3]]
    check(make, rows, 5, 80)


def test_large_nodes_and_pivots(make, monkeypatch):
    monkeypatch.setattr(C, "SMALL", 3)
    check(make, corpus(3), 2, 80)


def test_empty(make):
    assert C.near_duplicates(make([])).count() == 0
    assert C.near_duplicates(make([(5, None)])).first().component_id == 5


def variants(n, changes):
    """A text and ``n`` copies with some words changed: most are linked to the text, many not to each other."""
    rnd = random.Random(9)
    base = [f"w{k}" for k in range(120)]
    rows = [(0, " ".join(base))]
    for i in range(1, n):
        t = list(base)
        for k in rnd.sample(range(len(t)), rnd.choice(changes)):
            t[k] = f"v{rnd.randrange(40)}"
        rows.append((i, " ".join(t)))
    return rows


def test_large_nodes_match_all_pairs(make, monkeypatch):
    monkeypatch.setattr(links, "LARGE", 2)
    check(make, corpus(3), 2, 80)
    check(make, [(i + 1000, t) for i, t in variants(150, (5, 8, 12, 14, 16, 30))], 2, 80)


def test_large_nodes_compare_few_pairs(make, monkeypatch):
    compared, store = [], C.store

    def counted(df, name):
        out = store(df, name)
        if name == "candidates":
            compared.append(out.count())
        return out

    monkeypatch.setattr(C, "store", counted)
    rows = variants(400, (3, 5, 14, 15))
    check(make, rows, 2, 80)
    assert sum(compared) < 8 * len(rows)
