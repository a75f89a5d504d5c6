"""SentencePiece encoding and decoding through a table of distinct chunks.

No piece of the model holds a white-space marker behind another character, so a text falls into chunks (markers and
the characters up to the next marker) that are segmented on their own. A task segments each distinct chunk of its rows
once and joins ids and decoded bytes back by position; rows need no shuffle.

Defined cases: a null text is an empty text (no ids, empty decoded text); null ids and repeated rows keep a row each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.llm.common import no_collection, slices

MARK = "▁"
CACHE = 500_000
DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class PieceTable:
    """Distinct chunks of one model file: ids as text and the decoded string, both from the library."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece crosses a white-space marker: chunks can't be segmented on their own")
        self.known: dict[str, tuple[list[int], str, str]] = {}

    def chunks(self, text: str) -> list[str]:
        """The text behind each chunk's first marker: '' of blanks joins the chunk that follows."""
        words = text.replace(MARK, " ").split(" ")
        if "" not in words:
            return words
        out, blanks = [], 0
        for w in words[:-1]:
            if w:
                out.append(" " * blanks + w)
                blanks = 0
            else:
                blanks += 1
        out.append(" " * blanks + words[-1])
        return out

    def learn(self, chunks: set[str]) -> None:
        new = [c for c in chunks if c not in self.known]
        if len(self.known) + len(new) > CACHE:
            self.known.clear()
            new = list(chunks)
        if not new:
            return
        lead = self.model.encode("x")
        for c, ids in zip(new, self.model.encode(new, num_threads=1)):
            if not c:  # a lone marker, which the library leaves out of an empty text
                ids = [self.model.piece_to_id(MARK)]
            text = self.model.decode(lead + ids)[1:]
            self.known[c] = (ids, ",".join(map(str, ids)), text)

    def rows(self, texts: list[str]) -> list[list[tuple[list[int], str, str]]]:
        cut = [self.chunks(t) if t else [] for t in texts]
        self.learn({c for row in cut for c in row})
        get = self.known.__getitem__
        return [list(map(get, row)) for row in cut]


_TABLES: dict[str, PieceTable] = {}


def table(path: str) -> PieceTable:
    if path not in _TABLES:
        _TABLES[path] = PieceTable(path)
    return _TABLES[path]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) of whole texts, without begin and end ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table(path)
        for b in slices(batches):
            rows = t.rows([x or "" for x in b.column("text").to_pylist()])
            ids = [[i for chunk in row for i in chunk[0]] for row in rows]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return _texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of any id lists, as the library decodes them; null lists decode to an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = table(path).model
        for b in slices(batches, "ids"):
            texts = [model.decode(ids) if ids else "" for ids in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of the ids and of the text they decode to."""
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table(path)
        for b in slices(batches):
            with no_collection():
                rows = t.rows([x or "" for x in b.column("text").to_pylist()])
            n = [sum(len(c[0]) for c in row) for row in rows]
            ids = [sha(",".join([c[1] for c in row])) for row in rows]
            # the marker in front of the first chunk is the one the library adds and takes away
            texts = [sha("".join([c[2] for c in row])[1:]) for row in rows]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())],
                                             names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _texts(docs).mapInArrow(run, DIGEST)
