import hashlib
import random

import public_tokenizers
import sentencepiece
from conftest import ODD

from inkstone.llm import piece_table as P

PATH = public_tokenizers.path("piece_bpe_32k.model")


def test_matches_the_library(make, samples):
    lib = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rnd = random.Random(2)
    odd = ["".join(rnd.choice("  \n\tabcABC'st.!09é한▁́　\x85<s></s>") for _ in range(rnd.randint(1, 40))) for _ in range(500)] + ["▁", " ▁ ", "trail  ", "a "]
    rows = [(i, t) for i, t in enumerate(ODD + odd + [t for _, t in samples[:60]])] + [(None, "a b"), (1, "again")]
    want = []
    for i, t in rows:
        ids = lib.encode(t or "")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids))))
    assert sorted((tuple(r) for r in P.round_trip(make(rows), PATH).collect()), key=repr) == sorted(want, key=repr)
    encoded = P.encode(make(rows), PATH)
    assert sorted(((r.doc_id, r.ids) for r in encoded.collect()), key=repr) == sorted(((i, lib.encode(t or "")) for i, t in rows), key=repr)
    assert sorted(((r.doc_id, r.text) for r in P.decode(encoded, PATH).collect()), key=repr) == sorted(((i, lib.decode(lib.encode(t or ""))) for i, t in rows), key=repr)


def test_small_table_and_empty(make, samples, monkeypatch):
    whole = P.round_trip(make(samples[:20]), PATH).collect()
    monkeypatch.setattr(P, "CACHE", 10)
    assert sorted(P.round_trip(make(samples[:20]), PATH).collect()) == sorted(whole)
    assert P.round_trip(make([]), PATH).count() == 0
