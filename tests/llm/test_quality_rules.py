import re

from conftest import ODD

from inkstone.llm import quality_rules as Q


def brute(text):
    t = text or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
    grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    hit = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)} if len(grams) < 3000 else {i + k for i, g in enumerate(grams) if grams[0] == g for k in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)


def test_measurements_match_brute_force(make, samples):
    rows = [(i, t) for i, t in enumerate(ODD + [t for _, t in samples[:60]] + ["a b c a b c", "a a a a", "x\nx\n x\n", "# | * a"])] + [(None, "a b c"), (1, "again")]
    got = Q.measure(make(rows)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
    want = sorted(((r[0], *brute(r[1])) for r in rows), key=repr)
    assert sorted((tuple(r) for r in got), key=repr) == want


def test_policies_and_ablation_read_only_bits(make, samples):
    led = Q.ledger(make(samples[:80] + [(900, None), (901, "# " * 80)])).cache()
    bits = [r.failed_bits for r in led.collect()]
    m = Q.mask(Q.POLICIES["web-2"])
    assert led.transform(lambda d: Q.apply_policy(d, "web-2")).where("kept").count() == sum(b & m == 0 for b in bits)
    for r in Q.ablation(led, "web-2").collect():
        bit = 1 << list(Q.RULES).index(r.rule)
        assert (r.n_failed, r.n_only, r.n_kept_without) == (sum(b & bit > 0 for b in bits), sum(b & m == bit for b in bits), sum(b & m & ~bit == 0 for b in bits))


def test_native_plan(make):
    plan = Q.ledger(make([(1, "a")]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert Q.ledger(make([])).count() == 0
