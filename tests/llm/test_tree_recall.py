import numpy as np

from inkstone.llm import chosen_path as C


def missed(n, depth, seed=1, threshold=80):
    """How many of n pairs at the threshold meet in no tree at ``depth``; each pair's tokens agree with the threshold's chance."""
    rnd = np.random.default_rng(seed)
    a = rnd.integers(0, 1 << 32, (n, C.TOKENS), dtype=np.uint64)
    b = np.where(rnd.random((n, C.TOKENS)) * 100 < threshold, a, rnd.integers(0, 1 << 32, (n, C.TOKENS), dtype=np.uint64))
    at = np.repeat(np.arange(n), C.TREES)
    paths = np.tile(C.mix(np.arange(1, C.TREES + 1, dtype=np.uint64) * C._M2), n)
    for _ in range(depth):
        pick, x = C.branch(paths, a[at], threshold)
        _, y = C.branch(paths, b[at], threshold)
        both = x == y
        at, paths = at[pick][both], x[both]
    return n - len(np.unique(at))


def test_pairs_of_large_nodes_meet():
    assert missed(20_000, C.DEPTH) <= 10
