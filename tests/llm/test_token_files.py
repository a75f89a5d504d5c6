import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from conftest import ODD
from tokenizers import Tokenizer

from inkstone.llm import token_files as F

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 1000])
@pytest.mark.parametrize("most", [0, 1, 300, 49407, (1 << 32) - 1])
def test_blocks_round_trip(n, most):
    rnd = random.Random(n + most)
    ids = np.array([rnd.randint(0, most) if rnd.random() < 0.9 else rnd.randint(0, (1 << 32) - 1) for _ in range(n)], np.uint32)
    payload, starts = F.encode_blocks(ids)
    assert (F.decode_blocks(payload, starts) == ids).all()
    assert len(starts) == 4 * -(-n // F.BLOCK)


def test_files_match_the_library(spark, make, samples, monkeypatch):
    monkeypatch.setattr(F, "SEGMENT", 2000)
    rnd = random.Random(1)
    odd = ["".join(rnd.choice(" \n\tabcABC'st.!09é한İΣς́　\x85\xa0") for _ in range(30)) for _ in range(200)] + ["a<|startoftext|>b <|endoftext|>"]
    rows = [(i, t) for i, t in enumerate(ODD + odd + [t for _, t in samples[:50]])]
    rnd.shuffle(rows)
    folder = F.fresh_folder(spark)
    F.write(make(rows), PATH, 2, folder)
    lib, start = Tokenizer.from_file(PATH), 0
    got = {r.doc_id: r for r in F.digests(spark, folder).collect()}
    ids = {r.doc_id: r for r in F.ids_of(spark, folder).collect()}
    for i, t in sorted(rows):
        want = lib.encode(t or "", add_special_tokens=False).ids + [2]
        assert ids[i].ids == want and ids[i].start == start
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
        start += len(want)


def test_null_ids_repeated_rows_and_empty(spark, make):
    folder = F.fresh_folder(spark)
    F.write(make([(2, "b"), (None, "a"), (2, "b"), (1, None)]), PATH, 2, folder)
    assert [(r.doc_id, r.start, r.n_tokens) for r in sorted(F.digests(spark, folder).collect(), key=lambda r: r.start)] == [(None, 0, 2), (1, 2, 1), (2, 3, 2), (2, 5, 2)]
    folder = F.fresh_folder(spark)
    F.write(make([]), PATH, 2, folder)
    assert F.digests(spark, folder).count() == 0
