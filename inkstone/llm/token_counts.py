"""Token counts of every prefix by dynamic programming over byte-pair tokens.

The encoding of a prefix ends in exactly one token that may follow the encoding before it, so
``count[i] = count[i - len(token)] + 1`` walks a word once instead of encoding each prefix. A text is cut into units
(white space with the word after it) whose tokens never join; each distinct unit is walked once and its counts are
joined back by position. Stored is one signed byte per character: the change of the count at that prefix.

Defined cases: a null text is an empty text (0 bytes, 0 tokens, no deltas); null ids and repeated rows keep a row each.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.llm.common import no_collection, slices

SCHEMA = "doc_id long, n_bytes long, n_tokens long, deltas binary"
#: A prefix count that falls by more than a byte can say is stored as this mark and a 4-byte number.
WIDE = -128
CACHE = 400_000
#: Fixed value: pre-tokenizer pattern of the byte-level vocabulary.
#: White space is spelled out, because libraries differ about the control characters 1C to 1F.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounter:
    """Prefix token counts for one byte-level BPE file."""

    def __init__(self, path: str):
        import regex

        spec = json.load(open(path, encoding="utf-8"))
        back = byte_alphabet()
        raw = lambda s: bytes(back[c] for c in s)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.vocab = {raw(s): i for s, i in spec["model"]["vocab"].items() if s not in self.special}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        #: (left, right) -> rank of their merge; token -> (rank, left, right) of the merge that makes it
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}
        for k, (x, y) in enumerate(pairs):
            left, right = self.vocab[raw(x)], self.vocab[raw(y)]
            self.rank[left, right] = k
            self.made.setdefault(self.vocab[raw(x) + raw(y)], (k, left, right))
        self.longest = max(map(len, self.vocab))
        self.fits: dict[tuple[int, int], bool] = {(-1, t): self.whole(t) for t in self.vocab.values()}
        self.chunk_cache: dict[str, tuple[bytes, int]] = {}
        self.unit_cache: dict[str, tuple[bytes, int]] = {}
        self.next_chunk = regex.compile(PATTERN)
        self.units = regex.compile(rf"[{SPACE}]*(?:(?<! )(?:'s|'t|'re|'ve|'m|'ll|'d)|\p{{L}}+|\p{{N}}+|[^{SPACE}\p{{L}}\p{{N}}]+)|[{SPACE}]+")
        self.lead = regex.compile(rf"[{SPACE}]*")
        self.odd_blank = regex.compile(rf"[{SPACE}]{{2}}|[^\S \n]")
        self.splitter = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None

    def whole(self, token: int) -> bool:
        """Whether merging the bytes of a token gives that token back."""
        if token not in self.made:
            return True
        _, left, right = self.made[token]
        return self.whole(left) and self.whole(right) and not self.crossed(left, right, self.made[token][0])

    def crossed(self, left: int, right: int, until: int) -> bool:
        """Whether a merge across the border of two tokens comes before both are complete and before rank ``until``.

        The tokens' own merges at the border are undone from the last to the first; at each step the two parts that
        meet there stand from the rank of the later undone merge on, up to ``limit``.
        """
        limit = until
        while True:
            rank = self.rank.get((left, right))
            if rank is not None and rank < limit:
                return True
            a, b = self.made.get(left), self.made.get(right)
            if a is None and b is None:
                return False
            # of equal ranks the left one is merged first
            if b is None or (a is not None and a[0] > b[0]):
                limit, left = min(limit, a[0]), a[2]
            else:
                limit, right = min(limit, b[0] + 1), b[1]

    def follows(self, last: int, token: int) -> bool:
        """Whether a text that ends in ``last`` goes on with ``token`` as its next token."""
        ok = self.fits[-1, token] and (last < 0 or not self.crossed(last, token, 1 << 60))
        if len(self.fits) > 3_000_000:
            self.fits = {k: v for k, v in self.fits.items() if k[0] < 0}
        self.fits[last, token] = ok
        return ok

    def learn_chunks(self, pieces: set[str]) -> None:
        """Walk the new chunks in order of their bytes, each from where it leaves the one before it."""
        vocab, longest = self.vocab, self.longest
        before, counts, last = b"", [0], [-1]
        for data, piece in sorted((p.encode(), p) for p in pieces):
            k, most = 0, min(len(before), len(data))
            while k < most and before[k] == data[k]:
                k += 1
            del counts[k + 1:], last[k + 1:]
            for i in range(k + 1, len(data) + 1):
                fits = self.fits
                for j in range(i - longest if i > longest else 0, i):
                    token = vocab.get(data[j:i])
                    if token is not None:
                        ok = fits.get((last[j], token))
                        if ok or (ok is None and self.follows(last[j], token)):
                            counts.append(counts[j] + 1)
                            last.append(token)
                            break
            before = data
            if len(piece) == len(data):
                ends = counts
            else:
                ends, at = [0], 0
                for ch in piece:
                    at += len(ch.encode())
                    ends.append(counts[at])
            self.chunk_cache[piece] = (pack(ends), ends[-1])

    def chunk(self, piece: str) -> tuple[bytes, int]:
        got = self.chunk_cache.get(piece)
        if got is None:
            self.learn_chunks({piece})
            got = self.chunk_cache[piece]
        return got

    def pieces(self, unit: str) -> list[str]:
        """The chunks of a unit; words with at most one mark behind them need no pattern."""
        body = unit[1:] if unit[0] == " " else unit
        if body.isalpha():
            return [unit]
        if body and body[-1] in ".,;:!?|" and body[:-1].isalpha():
            return [unit[:-1], unit[-1]]
        return self.next_chunk.findall(unit)

    def plain_counts(self, unit: str) -> list[int]:
        """counts[i] of the first i characters of a unit without special strings: blanks and the one chunk after them."""
        out, base = [0], 0
        for piece in self.next_chunk.findall(unit):
            ends = unpack(self.chunk(piece)[0]).tolist()
            if piece[0] == "'" and len(piece) == 3 and piece[1:].isalpha():
                ends[2] = 2  # a part of a contraction is not one yet: the mark and the letter stand alone
            out.extend(base + c for c in ends[1:])
            base += ends[-1]
        blanks = self.lead.match(unit).end()
        if 1 < blanks < len(unit):  # a prefix that ends in the blanks takes them all as one chunk
            out[1:blanks + 1] = unpack(self.chunk(unit[:blanks])[0]).tolist()[1:]
        return out

    def text_counts(self, text: str) -> list[int]:
        """counts[i] of the first i characters of any text, unit by unit."""
        out, base, at, fixed = [0], 0, 0, 0
        special = [(m.start(), m.end()) for m in self.splitter.finditer(text)] if self.splitter and "<|" in text else []
        for start, end in [*special, (len(text), len(text))]:
            for m in self.units.finditer(text, at, start) if start > at else ():
                counts = self.plain_counts(m.group())
                out.extend(base + c for c in counts[1:])
                base += counts[-1]
            if end > start:  # whole, a special string is one token; cut off, ordinary text
                inner = self.text_counts(text[at:end - 1])
                out.extend(fixed + c for c in inner[start - at + 1:])
                base += 1
                out.append(base)
            at, fixed = end, base
        return out

    def learn_units(self, units: set[str]) -> None:
        plain, odd = {}, []
        for u in units:
            if "'" in u or "<|" in u:
                odd.append(u)
            else:
                plain[u] = self.pieces(u)
        self.learn_chunks({p for ps in plain.values() for p in ps if p not in self.chunk_cache})
        get = self.chunk_cache
        for u, ps in plain.items():
            if len(ps) == 1:
                self.unit_cache[u] = get[ps[0]]
            else:
                got = [get[p] for p in ps]
                self.unit_cache[u] = (b"".join([g[0] for g in got]), sum([g[1] for g in got]))
        for u in odd:
            counts = self.text_counts(u)
            self.unit_cache[u] = (pack(counts), counts[-1])

    def texts(self, texts: list[str]) -> list[tuple[int, bytes]]:
        """(tokens, deltas) of each text. Where all blanks are single spaces or line feeds they separate units; other texts are walked by the pattern."""
        if len(self.unit_cache) > CACHE or len(self.chunk_cache) > CACHE:
            self.unit_cache.clear()
            self.chunk_cache.clear()
        cut: list[list[str] | None] = []
        for text in texts:
            if not text or text[0] in " \n" or self.odd_blank.search(text):
                cut.append(None)
            else:
                cut.append(cut_units(text))
        self.learn_units({u for row in cut if row for u in row if u not in self.unit_cache})
        get, out = self.unit_cache.__getitem__, []
        for text, row in zip(texts, cut):
            if row is None:
                counts = self.text_counts(text) if text else [0]
                out.append((counts[-1], pack(counts)))
            else:
                deltas, counts = zip(*map(get, row))
                out.append((sum(counts), b"".join(deltas)))
        return out

    def text(self, text: str) -> tuple[int, bytes]:
        return self.texts([text])[0]


def cut_units(text: str) -> list[str]:
    """Words with the space before them, and line feeds, of a text whose blanks all stand alone."""
    out: list[str] = []
    for k, line in enumerate(text.split("\n")):
        if k:
            out.append("\n")
        if line:
            first, *rest = line.split(" ")
            if first:
                out.append(first)
            out.extend([" " + w for w in rest])
    return out


def pack(counts: list[int]) -> bytes:
    steps = [b - a for a, b in zip(counts, counts[1:])]
    if all(-127 <= s <= 127 for s in steps):
        return bytes(s & 255 for s in steps)
    return b"".join(bytes([s & 255]) if -127 <= s <= 127 else bytes([WIDE & 255]) + int(s).to_bytes(4, "little", signed=True) for s in steps)


def unpack(deltas: bytes) -> np.ndarray:
    """counts[i] of the first i characters, from the stored changes."""
    steps = np.frombuffer(deltas, np.int8).astype(np.int64)
    if (steps == WIDE).any():
        out, at = [], 0
        while at < len(steps):
            if steps[at] == WIDE:
                out.append(int.from_bytes(deltas[at + 1:at + 5], "little", signed=True))
                at += 5
            else:
                out.append(int(steps[at]))
                at += 1
        steps = np.array(out, np.int64)
    return np.concatenate([[0], np.cumsum(steps)])


_COUNTERS: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """One counter per Python worker and file, so distinct units stay known from task to task."""
    if path not in _COUNTERS:
        _COUNTERS[path] = PrefixCounter(path)
    return _COUNTERS[path]


def prefix_table(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, deltas) of whole texts; ``path`` is the vocabulary file on every worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for b in slices(batches, chars=4_000_000):
            texts = [t or "" for t in b.column("text").to_pylist()]
            with no_collection():
                got = c.texts(texts)
            yield pa.RecordBatch.from_arrays([
                b.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()),
                pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.binary())],
                names=["doc_id", "n_bytes", "n_tokens", "deltas"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def _each(table: DataFrame, schema: str, fn) -> DataFrame:
    names = [p.split()[0] for p in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "deltas"):
            rows = list(chain(zip(b.column("doc_id").to_pylist(), map(fn, map(unpack, b.column("deltas").to_pylist())))))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(2)], names=names)

    return table.select("doc_id", "deltas").mapInArrow(run, schema)


def truncate_at(table: DataFrame, budget: int) -> DataFrame:
    """(doc_id, n_keep): length in characters of the longest prefix of at most ``budget`` tokens, from stored counts."""
    return _each(table, "doc_id long, n_keep long", lambda counts: int(np.flatnonzero(counts <= budget)[-1]))


def tokens_before(table: DataFrame, offset: int) -> DataFrame:
    """(doc_id, n_tokens): tokens of the first ``offset`` characters (of all, in shorter texts)."""
    return _each(table, "doc_id long, n_tokens long", lambda counts: int(counts[min(offset, len(counts) - 1)]))
