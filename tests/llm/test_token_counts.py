import random

import public_tokenizers
import pytest
from conftest import ODD
from tokenizers import Tokenizer

from inkstone.llm import token_counts as T

PATH = public_tokenizers.path("byte_bpe_50k.json")
ALPHABET = " \n\t  abcdlst'''eér.!|*0123é한 　▁́\x1c\x85"


@pytest.fixture(scope="module")
def lib():
    return Tokenizer.from_file(PATH)


def texts():
    rnd = random.Random(3)
    odd = ["a   b", "don't we'll I'l 'l 'lll", "x<|endoftext|>y  <|endoftext|>", "<|endoftext", " 'tra", "\r\n\r\nx", "日本語 テキスト"]
    return odd + [t or "" for t in ODD] + ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(1, 40))) for _ in range(600)]


def test_totals_match_the_library(lib, samples):
    c = T.counter(PATH)
    all_texts = texts() + [t for _, t in samples[:60]]
    assert [n for n, _ in c.texts(all_texts)] == [len(e.ids) for e in lib.encode_batch(all_texts, add_special_tokens=False)]


def test_every_prefix_matches_the_library(lib, samples):
    c = T.counter(PATH)
    for t in [x[:80] for x in texts()[:200]] + [t[:120] for _, t in samples[:20]]:
        counts = T.unpack(c.text(t)[1]).tolist()
        assert counts == [len(lib.encode(t[:i], add_special_tokens=False).ids) for i in range(len(t) + 1)]


def test_wide_steps_survive_packing():
    counts = [0, 1, 2, 300, 1, 2]
    assert T.unpack(T.pack(counts)).tolist() == counts


def test_budget_questions(lib, make, samples):
    rows = samples[:10] + [(100, None), (100, ""), (None, "abc def")]
    table = T.prefix_table(make(rows), PATH)
    got = {(r.doc_id, r.n_tokens): r.n_bytes for r in table.collect()}
    assert (100, 0) in got and len(table.collect()) == len(rows)
    for r in T.truncate_at(table, 50).collect():
        t = dict(rows).get(r.doc_id) or ""
        ok = [i for i in range(min(len(t), 400) + 1) if len(lib.encode(t[:i], add_special_tokens=False).ids) <= 50]
        assert r.n_keep == ok[-1]
    for r in T.tokens_before(table, 33).collect():
        assert r.n_tokens == len(lib.encode((dict(rows).get(r.doc_id) or "")[:33], add_special_tokens=False).ids)
    assert T.prefix_table(make([]), PATH).count() == 0
