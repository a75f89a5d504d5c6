"""Language identification with hyperdimensional profiles.

Every letter has a fixed random vector of +1 and -1 drawn from its code point. The vectors of three letters in a row,
rotated by their place, are bound by multiplication into the vector of the trigram; the trigrams of a text are bundled
by addition; a language's prototype is the bundle of its training texts, less the mean of all prototypes. A text gets
the language whose prototype has the largest cosine with it; ties go to the smaller name.

Defined cases: a null text or one without a letter is ``und`` with score 0, and so is every text when nothing can be
learned; texts with a null language teach nothing; null ids count as an empty id; repeated rows keep a row each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.llm.common import id_remainder, slices

DIM = 512
GAP = ord(" ")
CACHE = 200_000
SHIFT = 21  # bits of a code point

_VECTORS: dict[int, np.ndarray] = {}
_IS_LETTER: list[np.ndarray] = []


def is_letter() -> np.ndarray:
    if not _IS_LETTER:
        _IS_LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _IS_LETTER[0]


def letter(code: int) -> np.ndarray:
    return np.random.Generator(np.random.Philox(key=code)).integers(0, 2, DIM, dtype=np.int8) * 2 - 1


def trigram(code: int) -> np.ndarray:
    got = _VECTORS.get(code)
    if got is None:
        a, b, c = code >> 2 * SHIFT, code >> SHIFT & (1 << SHIFT) - 1, code & (1 << SHIFT) - 1
        got = np.roll(letter(a), 2) * np.roll(letter(b), 1) * letter(c)
        if len(_VECTORS) > CACHE:
            _VECTORS.clear()
        _VECTORS[code] = got
    return got


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigrams of letters of a text in lower case, words apart by one gap, and their counts."""
    x = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    ok = is_letter()[x]
    if not ok.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    x = np.where(ok, x, GAP)
    x = np.concatenate([[GAP], x[ok | np.concatenate([[False], ok[:-1]])], [GAP]])
    return np.unique((x[:-2] << 2 * SHIFT) | (x[1:-1] << SHIFT) | x[2:], return_counts=True)


def bundle(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    total = np.zeros(DIM, np.float64)
    for at in range(0, len(codes), 4096):
        block = np.stack([trigram(c) for c in codes[at:at + 4096].tolist()]).astype(np.float32)
        total += counts[at:at + 4096].astype(np.float32) @ block
    return total


def profiles(docs: DataFrame) -> dict[str, np.ndarray]:
    """Language -> prototype. Trigram counts are added up by language in Spark; what reaches the driver is one vector per language.

    Counts are whole numbers, so neither the order of rows nor lost tasks change a prototype.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def merged(parts):
            codes, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return codes, np.bincount(back, np.concatenate([p[1] for p in parts]), len(codes)).astype(np.int64)

        def out():
            for lang, parts in held.items():
                codes, counts = merged(parts)
                if len(codes):
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(counts)], names=["lang", "code", "n"])

        for b in slices(batches):
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                held.setdefault(lang, []).append(trigrams(text))
            for lang, parts in held.items():
                if len(parts) > 1:
                    held[lang] = [merged(parts)]
            if sum(len(p[0][0]) for p in held.values()) > 2_000_000:
                yield from out()
                held = {}
        yield from out()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            langs = np.array(b.column("lang").to_pylist(), object)
            codes, n = b.column("code").to_numpy(), b.column("n").to_numpy()
            for lang in set(langs):
                pick = langs == lang
                sums[lang] = sums.get(lang, 0) + bundle(codes[pick], n[pick])
        for lang, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * DIM, pa.string()), pa.array(range(DIM), pa.int32()), pa.array(np.rint(v).astype(np.int64))], names=["lang", "k", "v"])

    counts = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text").mapInArrow(count, "lang string, code long, n long")
    total = counts.groupBy("lang", "code").agg(F.sum("n").alias("n"))
    rows = total.mapInArrow(add, "lang string, k int, v long").groupBy("lang", "k").agg(F.sum("v").alias("v"))
    vectors: dict[str, np.ndarray] = {}
    for r in rows.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("k", "v"))).alias("v")).toLocalIterator():
        v = np.array([x["v"] for x in r["v"]], np.float64)
        if np.any(v):
            vectors[r["lang"]] = v / np.linalg.norm(v)
    if len(vectors) > 1:
        mean = sum(vectors[k] for k in sorted(vectors)) / len(vectors)
        vectors = {k: v - mean for k, v in vectors.items()}
        vectors = {k: v / (np.linalg.norm(v) or 1) for k, v in vectors.items()}
    return {k: vectors[k] for k in sorted(vectors)}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray]) -> DataFrame:
    """(doc_id, lang_pred, score) of whole texts; the score is the cosine, 0 where it is negative."""
    names = list(prototypes)
    matrix = np.stack([prototypes[n] for n in names]) if names else np.zeros((0, DIM))

    def one(text: str | None) -> tuple[str, float]:
        codes, counts = trigrams(text) if text and names else ((), ())
        if not len(codes):
            return "und", 0.0
        v = bundle(codes, counts)
        size = np.linalg.norm(v)
        cosine = np.round(matrix @ v / size, 12) if size else np.zeros(len(names))
        k = int(np.argmax(cosine))
        return names[k], float(min(1.0, max(0.0, cosine[k])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            got = [one(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())],
                                             names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): prototypes from the other folds' rows only, predictions for all rows."""
    fold = id_remainder("doc_id", folds)
    prototypes = profiles(docs.where(fold != held))
    return predict(docs, prototypes).select("doc_id", (fold == held).alias("held_out"), "lang_pred", "score")
