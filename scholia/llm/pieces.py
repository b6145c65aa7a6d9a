"""SentencePiece encoding and decoding by an Aho-Corasick automaton.

One pass over a text feeds the automaton of all pieces. At each position its output links name every piece
that ends there, longest first; each relaxes the best score at its end from the best score at its start. The
best path, read backwards, is the segmentation of highest total score. A character that is no piece falls
back to its UTF-8 bytes. No piece holds a space mark after another character, so a text can be cut where a
space follows one and the parts' best paths joined are the text's; a part seen before is not searched again.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from scholia.llm.common import Shared, column, session, texts

#: The mark that stands for a space in pieces.
MARK = "▁"
#: Below the lowest score, for a character that is no piece.
PENALTY = 10.0
#: Parts remembered by one task.
MEMORY = 100_000


@dataclass
class Vocabulary:
    """Ordinary pieces with ids and scores, and the ids of the 256 byte pieces."""

    pieces: list[tuple[str, int, float]]
    byte_ids: list[int]
    size: int
    prefix: bool

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """Read a model file whose normaliser changes nothing but spaces."""
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("only models with the identity normaliser are supported")
        ordinary = [(p.piece, i, p.score) for i, p in enumerate(model.pieces) if p.type == pb.ModelProto.SentencePiece.NORMAL]
        if any(re.search(f"[^{MARK}]{MARK}", p) for p, _, _ in ordinary):
            raise ValueError("a piece crosses a space, so texts can't be cut there")
        by_byte = {p.piece: i for i, p in enumerate(model.pieces) if p.type == pb.ModelProto.SentencePiece.BYTE}
        return cls(ordinary, [by_byte[f"<0x{b:02X}>"] for b in range(256)], len(model.pieces), spec.add_dummy_prefix)


class Coder:
    """Encodes and decodes with one vocabulary; made once in each task."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        import ahocorasick

        self.own = vocabulary
        self.automaton = ahocorasick.Automaton()
        for piece, i, score in vocabulary.pieces:
            self.automaton.add_word(piece, (len(piece), i, score))
        self.automaton.make_automaton()
        self.single = {p for p, _, _ in vocabulary.pieces if len(p) == 1}
        self.unknown = min(s for _, _, s in vocabulary.pieces) - PENALTY
        self.parts = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
        self.known: dict[str, tuple[tuple[int, ...], float]] = {}
        self.table = [b""] * vocabulary.size
        for piece, i, _ in vocabulary.pieces:
            self.table[i] = piece.replace(MARK, " ").encode()
        for b, i in enumerate(vocabulary.byte_ids):
            self.table[i] = bytes([b])

    def best(self, text: str) -> tuple[tuple[int, ...], float]:
        """Ids and score of the best path; of equal paths the one whose last pieces are longest."""
        n, single, unknown = len(text), self.single, self.unknown
        best, back, piece = [float("-inf")] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0], done = 0.0, 0
        for end, (size, i, score) in self.automaton.iter(text):
            while done <= end:  # characters up to here that are no piece
                if text[done] not in single and best[done] + unknown > best[done + 1]:
                    best[done + 1], back[done + 1], piece[done + 1] = best[done] + unknown, done, -1
                done += 1
            at = end + 1
            if (total := best[at - size] + score) > best[at]:
                best[at], back[at], piece[at] = total, at - size, i
        while done < n:
            if text[done] not in single and best[done] + unknown > best[done + 1]:
                best[done + 1], back[done + 1], piece[done + 1] = best[done] + unknown, done, -1
            done += 1
        out, at = [], n
        while at:
            if piece[at] < 0:
                out += [self.own.byte_ids[b] for b in reversed(text[back[at] : at].encode())]
            else:
                out.append(piece[at])
            at = back[at]
        return tuple(reversed(out)), best[n]

    def encode(self, text: str) -> tuple[array, float]:
        if not text:
            return array("i"), 0.0
        text = text.replace(" ", MARK)
        ids, total, known = array("i"), 0.0, self.known
        for part in self.parts.findall(MARK + text if self.own.prefix else text):
            found = known.get(part)
            if found is None:
                if len(known) >= MEMORY:
                    known.clear()
                found = self.best(part)
                if len(part) <= 64:
                    known[part] = found
            ids.extend(found[0])
            total += found[1]
        return ids, total

    def decode(self, ids) -> str:
        data = b"".join(map(self.table.__getitem__, ids))
        return (data[1:] if self.own.prefix and data[:1] == b" " else data).decode("utf-8", "replace")


def _mapped(docs: DataFrame, vocabulary: Vocabulary, make, schema: pa.Schema, ddl: str) -> DataFrame:
    held = Shared(session(docs), vocabulary)  # the size of the vocabulary, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(held.value)
        for batch in batches:
            rows = [make(coder, doc, text) for doc, text in zip(column(batch, "doc_id"), column(batch, "text"), strict=True)]
            yield pa.RecordBatch.from_pydict({k: [r[j] for r in rows] for j, k in enumerate(schema.names)}, schema=schema)

    return texts(docs).mapInArrow(run, ddl)


def encode(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """One row for each row of docs: doc_id, ids (array<int>), score (of the best path), n_pieces, and
    round_trip: whether decoding gives the text back (a text that holds the space mark itself, U+2581, reads
    back with spaces, so it doesn't). A null text has null ids; an empty one has none."""

    def make(coder: Coder, doc, text):
        if text is None:
            return doc, None, 0.0, 0, True
        ids, score = coder.encode(text)
        return doc, memoryview(ids).tolist(), score, len(ids), coder.decode(ids) == text

    kind = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("score", pa.float64()), ("n_pieces", pa.int64()), ("round_trip", pa.bool_())])
    return _mapped(docs, vocabulary, make, kind, "doc_id long, ids array<int>, score double, n_pieces long, round_trip boolean")


def digest(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """encode() with the SHA-256 of the ids (32-bit little-endian) in place of the ids, and n_bytes of the text."""

    def make(coder: Coder, doc, text):
        ids, score = coder.encode(text or "")
        return doc, len((text or "").encode()), len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), score, coder.decode(ids) == (text or "")

    kind = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_pieces", pa.int64()), ("ids_sha256", pa.string()), ("score", pa.float64()), ("round_trip", pa.bool_())])
    return _mapped(docs, vocabulary, make, kind, "doc_id long, n_bytes long, n_pieces long, ids_sha256 string, score double, round_trip boolean")


def decode(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids); null ids give a null text. Unfinished byte runs decode to U+FFFD."""
    held = Shared(session(encoded), vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(held.value)
        for batch in batches:
            out = [None if x is None else coder.decode(x) for x in column(batch, "ids")]
            yield pa.RecordBatch.from_pydict({"doc_id": column(batch, "doc_id"), "text": out}, schema=pa.schema([("doc_id", pa.int64()), ("text", pa.string())]))

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
