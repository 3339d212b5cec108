"""Operator 5, token counts with the whole-token shortcut.

Before any text is read, every vocabulary string is merged from its bytes; those that give
back their one id, and are one pre-token in normal form, are proved to encode alone as one
token.  Pre-tokens in that set count one without a merge; only the rest is merged (segment
trees, ``merges``), each distinct one once per bounded memory of a task.  Row-local.

Null text counts as empty (0 bytes, 0 tokens).  Repeated rows each give a row.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from watchframe.llm.common import batches, texts
from watchframe.llm.merges import SPACE, SPLIT_WORDS, Vocabulary, encode_many, vocabulary

#: Pieces a task remembers.
MEMORY = 300_000


def normal(text: str) -> str:
    """Composed form, lower-cased letter by letter (a final sigma is not special)."""
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def whole_tokens(voc: Vocabulary) -> frozenset[str]:
    """Vocabulary strings proved to be one normalised pre-token that encodes alone as one token."""
    split, names = regex.compile(SPLIT_WORDS), []
    for name, i in voc.names.items():
        if name.endswith(voc.end) and i < len(voc.bytes_of):
            try:
                word = voc.bytes_of[i].decode()
            except UnicodeDecodeError:
                continue
            if word and normal(word) == word and split.findall(word) == [word]:
                names.append((word, i))
    coded = encode_many(voc, [w.encode() for w, _ in names])
    return frozenset(w for (w, i), ids in zip(names, coded, strict=True) if ids == i.to_bytes(4, "little"))


class Counter:
    """Token counts of texts by one vocabulary of whole words."""

    def __init__(self, voc: Vocabulary, memory: int = MEMORY):
        self.voc, self.memory = voc, memory
        self.split, self.whole = regex.compile(SPLIT_WORDS), whole_tokens(voc)
        self.known: dict[str, int] = {}
        self.odd, self.blank = re.compile("[\x1c-\x1f]"), regex.compile(f"[{SPACE}]+")

    def _learn(self, pieces: set[str]) -> None:
        new = pieces.difference(self.known)
        if len(self.known) + len(new) > self.memory:
            self.known = {p: self.known[p] for p in pieces if p in self.known}
        rest: dict[str, list[str]] = {}
        for p in new:
            n, words = 0, []
            for k, part in enumerate(self.voc.special_pattern.split(p) if "<|" in p else [p]):
                if k % 2:
                    n += 1
                    continue
                part = normal(part)
                for w in [part] if part.isalpha() or part in self.whole else self.split.findall(part):
                    if w in self.whole:
                        n += 1
                    else:
                        words.append(w)
            self.known[p] = n
            if words:
                rest[p] = words
        distinct = list({w for ws in rest.values() for w in ws})
        lengths = {w: len(ids) // 4 for w, ids in zip(distinct, encode_many(self.voc, [w.encode() for w in distinct]), strict=True)}
        for p, words in rest.items():
            self.known[p] += sum(lengths[w] for w in words)

    def count(self, docs: list[str]) -> list[int]:
        pieces = [self.blank.split(t) if self.odd.search(t) else t.split() for t in docs]
        self._learn(set().union(*pieces))
        return [sum([self.known[p] for p in ps]) for ps in pieces]


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(vocabulary(path))


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, text: str = "text", id: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every whole text; ``path`` is a word vocabulary on the executors."""
    def run(stream):
        made = counter(path)
        for batch, values in batches(stream, raw=False):
            counts = made.count(values)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pc.binary_length(batch.column(1)).cast(pa.int64()), pa.array(counts, pa.int64()),
                 pa.array([n > limit for n in counts], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return texts(docs, text=text, id=id).mapInArrow(
        run, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
