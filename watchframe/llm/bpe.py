"""Operator 3, BPE encoding and decoding, merged by segment trees (see ``merges``).

A text is cut at its special strings, then into pieces at single spaces and line ends, where
the pre-token pattern always cuts; texts with any other white space are cut by the pattern
alone.  Each distinct piece is merged once per bounded memory of a task.  Row-local: no
shuffle, no state between rows, so a lost executor costs its tasks only.

Null text counts as empty: no ids, empty decoded text.  Repeated rows each give a row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from watchframe.llm.common import batches, kept, texts
from watchframe.llm.merges import SPLIT_BYTES, Vocabulary, encode_many

#: Pieces a task remembers; beyond it the memory starts anew.
MEMORY = 300_000


def plain_spacing(text: str) -> bool:
    """Whether all white space is single spaces and line ends inside the text."""
    return " ".join(text.split()) == text.replace("\n", " ")


def pieces_of(text: str) -> list[str]:
    """Pieces of a plainly spaced text; "\\n" leads those after a line end, others follow a space.

    The first piece follows nothing and is marked with "\\0 ".
    """
    out = text.replace("\n", " \n").split(" ")
    out[0] = "\0 " + out[0]
    return out


class Encoder:
    """Encodes and decodes with one vocabulary; remembers up to ``memory`` pieces."""

    def __init__(self, voc: Vocabulary, memory: int = MEMORY):
        self.voc, self.memory = voc, memory
        self.split = regex.compile(SPLIT_BYTES)
        self.known: dict[str, bytes] = {}
        self.special = {w: i.to_bytes(4, "little") for w, i in voc.special.items()}

    def _merge(self, strings: Iterable[str]) -> dict[str, bytes]:
        words = list(strings)
        return dict(zip(words, encode_many(self.voc, [w.encode() for w in words]), strict=True))

    def learn(self, pieces: set[str]) -> None:
        """Merge the pieces that are not remembered."""
        new = pieces.difference(self.known)
        if not new:
            return
        if len(self.known) + len(new) > self.memory:
            self.known = {p: self.known[p] for p in pieces if p in self.known}
        cut: dict[str, list[str]] = {}
        for p in new:
            s = p[2:] if p.startswith("\0 ") else p if p[0] == "\n" else " " + p
            if p.isalpha():
                cut[p] = [s]
            elif p[:-1].isalpha() and p[-1] in ".,":
                cut[p] = [s[:-1], p[-1]]
            else:
                cut[p] = self.segments(s)
        merged = self._merge(set().union(*cut.values()))
        merged.update(self.special)
        for p, parts in cut.items():
            self.known[p] = merged[parts[0]] if len(parts) == 1 else b"".join([merged[w] for w in parts])

    def segments(self, text: str) -> list[str]:
        """Pre-tokens and special strings; no pre-token equals a special string, as those are cut out."""
        if "<|" not in text:
            return self.split.findall(text)
        out = []
        for k, part in enumerate(self.voc.special_pattern.split(text)):
            out += [part] if k % 2 else self.split.findall(part)
        return out

    def encode(self, docs: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        plain = [pieces_of(t) if t and plain_spacing(t) else None for t in docs]
        self.learn({p for ps in plain if ps for p in ps})
        out = []
        for text, ps in zip(docs, plain, strict=True):
            if ps:
                out.append(b"".join([self.known[p] for p in ps]))
            else:
                parts = self.segments(text)
                merged = self._merge(set(parts))
                merged.update(self.special)
                out.append(b"".join([merged[w] for w in parts]))
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join([self.voc.bytes_of[i] for i in ids]).decode("utf-8", "replace")


def encoder(path: str) -> Encoder:
    """One encoder a Python worker, kept between its tasks of a stage."""
    return kept(f"bpe {path}", lambda: Encoder(Vocabulary(path)))


def encode(docs: DataFrame, path: str, text: str = "text", id: str = "doc_id") -> DataFrame:
    """doc_id and ids (array<int>) of every whole text; ``path`` is the vocabulary file on the executors."""
    def run(stream):
        enc = encoder(path)
        for batch, values in batches(stream, raw=False):
            coded = enc.encode(values)
            ends = np.cumsum([0, *(len(c) // 4 for c in coded)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(coded), "<i4")))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["doc_id", "ids"])

    return texts(docs, text=text, id=id).mapInArrow(run, "doc_id bigint, ids array<int>")


def decode(coded: DataFrame, path: str, ids: str = "ids", id: str = "doc_id") -> DataFrame:
    """doc_id and the decoded text, special strings included; null ids decode to the empty text."""
    def run(stream):
        enc = encoder(path)
        for batch in stream:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([enc.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())],
                ["doc_id", "text"])

    return coded.select(id, ids).toDF("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")


def round_trip(docs: DataFrame, path: str, text: str = "text", id: str = "doc_id") -> DataFrame:
    """Encoded, then decoded from the ids: doc_id, n_tokens, ids_sha256, decoded_sha256, same_text."""
    def run(stream):
        enc = encoder(path)
        for batch, values in batches(stream, raw=False):
            counts, coded, decoded, same = [], [], [], []
            for value, raw in zip(values, enc.encode(values), strict=True):
                ids = np.frombuffer(raw, "<u4").tolist()
                back = enc.decode(ids)
                counts.append(len(ids))
                coded.append(hashlib.sha256(",".join([enc.voc.digits[i] for i in ids]).encode()).hexdigest())
                decoded.append(hashlib.sha256(back.encode()).hexdigest())
                same.append(back == value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(coded, pa.string()),
                 pa.array(decoded, pa.string()), pa.array(same, pa.bool_())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "same_text"])

    return texts(docs, text=text, id=id).mapInArrow(
        run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, same_text boolean")
