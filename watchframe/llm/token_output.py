"""Operator 1, token ids as binary files with a minimal perfect hash index.

Payload: ``ids/<shard>.ids`` holds the raw ids of a range of documents in ascending doc_id
order (repeats of an id by their text), little-endian, two bytes an id where the vocabulary
allows, else four.  Index: ``index/<file>.npz`` holds, for the keys (doc_id, copy) that hash
to that file, a minimal perfect hash and per slot a 32-bit fingerprint, shard, offset and
length, so a key is found in constant time: hash to a file, hash to a slot, compare the
fingerprint, read one range of one payload.  Documents without an id come first and are
indexed under their copy number.

Tasks write under a temporary name and move the finished file into place; a task that is run
again writes the same bytes.  No task holds more than a few megabytes of text or one index file.

Null text counts as empty (the end id alone); an empty table gives no files and no rows.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchframe.llm.common import new_folder, slices, texts, written
from watchframe.llm.merges import vocabulary


def _files(folder: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(folder)


def _put(folder: str, name: str, parts) -> None:
    """Write a file under another name, then move it into place."""
    store, root = _files(folder)
    store.create_dir(root, recursive=True)
    made = f"{root}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(made) as out:
        for part in parts:
            out.write(part)
    store.move(made, f"{root}/{name}")


#: Any white space but single spaces and line ends inside a text.
NOT_PLAIN = (r"\A\z|\A[ \n]|[ \n]\z|[ \n][ \n]|[\t\x0b-\r\x1c-\x1f\x{85}\x{a0}\x{1680}"
             r"\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
#: Letters and digits after which the pre-token pattern cuts before a mark.
LETTERS = r"0-9A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}\x{400}-\x{481}\x{48a}-\x{52f}"
MARKS = "!\"#$%&'()*+,-./:;=?@[\\]^_`{}~"


class LibraryEncoder:
    """Texts encoded by the tokenizers library, which gets each distinct piece once while it is remembered.

    Plainly spaced texts are cut at single spaces and line ends, and marks at the end of a word are cut off.
    A piece after a line end starts with it, and so does the first of a text, whose line end is taken off
    again; marks follow nothing, the other pieces a space.
    """

    def __init__(self, path: str, memory: int = 600_000):
        from tokenizers import Tokenizer
        self.memory = memory
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        voc = vocabulary(path)
        #: Ids that begin a piece: those whose bytes start with a space or a line end.
        self.leads = np.array([b[:1] in (b" ", b"\n") for b in voc.bytes_of])
        self.marks = "".join(c for c in MARKS if not any(c in w for w in voc.special))
        self.ended = f"[{LETTERS}][{''.join(f'\\x{{{ord(c):x}}}' for c in self.marks)}]+\\z"
        self._start()

    def _start(self) -> None:
        """The row of each piece; a row has a range of ``pool`` and the number of slices it was in.  Row 0 is no ids."""
        self.known: dict[str, int] = {}
        self.pool, self.n_ids = np.zeros(1 << 16, np.uint32), 0
        self.starts, self.sizes, self.seen = np.zeros((3, 0), np.int64)
        self._add([""], np.zeros(0, np.uint32), np.zeros(1, np.int64))

    def _add(self, pieces: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        """Remember pieces that are not known, with ``sizes`` ids each."""
        self.known.update(zip(pieces, range(len(self.known), len(self.known) + len(pieces)), strict=True))
        end = self.n_ids + len(ids)
        if end > len(self.pool):
            self.pool = np.concatenate([self.pool[:self.n_ids], np.zeros(end, np.uint32)])
        self.pool[self.n_ids:end] = ids
        self.starts = np.append(self.starts, self.n_ids + np.cumsum(sizes) - sizes)
        self.sizes = np.append(self.sizes, sizes)
        self.seen = np.append(self.seen, np.zeros(len(sizes), np.int64))
        self.n_ids = end

    def _ids(self, rows: np.ndarray) -> np.ndarray:
        """The ids of the rows, one after the other."""
        sizes = self.sizes[rows]
        at = np.repeat(self.starts[rows] - np.cumsum(sizes) + sizes, sizes)
        at += np.arange(len(at))
        return self.pool[at]

    def _call(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all strings, and how many each has."""
        coded = [np.array(e.ids, np.uint32) for e in self.library.encode_batch_fast(strings, add_special_tokens=False)]
        return np.concatenate(coded), np.fromiter(map(len, coded), np.int64, len(coded))

    def _forget(self) -> None:
        """Keep the pieces that were in several slices, if they are at most half of the memory."""
        keep = self.seen > 1
        if 2 * keep.sum() > self.memory or 2 * self.sizes[keep].sum() > 16 * self.memory:
            keep[:] = False
        keep[0] = False  # a new start has it
        pieces, rows = list(compress(self.known, keep.tolist())), np.flatnonzero(keep)
        ids, sizes = self._ids(rows), self.sizes[rows]
        self._start()
        self._add(pieces, ids, sizes)

    def _call_spaced(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same of pieces after their space, many in one string: each begins with the id of a space or line end."""
        coded = []
        for s in range(0, len(pieces), 2000):
            strings = [p if p[0] == "\n" else " " + p for p in pieces[s:s + 2000]]
            ids = self._call(["".join(strings)])[0]
            starts = np.flatnonzero(self.leads[ids])
            if len(starts) == len(strings) and starts[0] == 0:
                coded.append((ids, np.diff(starts, append=len(ids))))
            else:
                coded.append(self._call(strings))
        ids, sizes = zip(*coded, strict=True)
        return np.concatenate(ids), np.concatenate(sizes)

    def _rows(self, pieces: pa.Array, call: Callable) -> np.ndarray:
        """The row of each piece; ``call`` encodes those that are not known."""
        coded = pieces.dictionary_encode()
        strings = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        rows = np.fromiter(map(self.known.get, strings, repeat(-1)), np.int64, len(strings))
        new = np.flatnonzero(rows < 0)
        if len(new):
            rows[new] = np.arange(len(self.known), len(self.known) + len(new))
            names = [strings[k] for k in new.tolist()]
            self._add(names, *call(names))
        self.seen[rows] += 1
        return rows[coded.indices.to_numpy()]

    def encode_array(self, docs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each led by the id of a line end, and how many each has with it."""
        if len(self.known) > self.memory or self.n_ids > 16 * self.memory:
            self._forget()
        docs = docs.cast(pa.large_string())
        empty, line_end = pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string())
        odd = pc.match_substring_regex(docs, NOT_PLAIN)
        plain = pc.replace_substring(pc.if_else(odd, empty, docs), "\n", " \n")
        lists = pc.split_pattern(pc.binary_join_element_wise(line_end, plain, empty), " ")
        pieces = lists.flatten().dictionary_encode()
        distinct = pieces.dictionary
        ended = pc.match_substring_regex(distinct, self.ended)
        pairs = np.zeros((len(distinct), 2), np.int64)
        pairs[:, 0] = self._rows(pc.if_else(ended, pc.utf8_rtrim(distinct, characters=self.marks), distinct), self._call_spaced)
        marks = pc.replace_substring_regex(distinct.filter(ended), f"(?s)\\A.*[{LETTERS}]", " ")
        pairs[ended.to_numpy(zero_copy_only=False), 1] = self._rows(marks, lambda new: self._call([m[1:] for m in new]))
        rows = pairs[pieces.indices.to_numpy()]
        ids, sizes = self._ids(rows.ravel()), self.sizes[rows].sum(1)
        lengths = np.add.reduceat(sizes, lists.offsets.to_numpy()[:-1])
        if not pc.any(odd).as_py():
            return ids, lengths
        # the place of an odd text has a line end alone; its ids go after it
        spots = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        extra, more = self._call(docs.filter(odd).to_pylist())
        ids = np.insert(ids, np.repeat(np.cumsum(lengths)[spots], more), extra)
        lengths[spots] += more
        return ids, lengths

    def encode(self, docs: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        if not docs:
            return []
        ids, lengths = self.encode_array(pa.array(docs, pa.string()))
        return [part[1:].astype("<u4").tobytes() for part in np.split(ids, np.cumsum(lengths)[:-1])]


_encoders: dict[str, LibraryEncoder] = {}


def _encoder(path: str) -> LibraryEncoder:
    import os
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    if path not in _encoders:
        _encoders[path] = LibraryEncoder(path)
    return _encoders[path]


# --- minimal perfect hash -------------------------------------------------------------------

def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def key_hash(ids: np.ndarray, copies: np.ndarray, seed: int) -> np.ndarray:
    step = np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    return _mix(_mix(ids.astype(np.int64).view(np.uint64) + step) ^ (copies.astype(np.int64).view(np.uint64) + step))


LEVELS = 64


def build_hash(ids: np.ndarray, copies: np.ndarray) -> dict[str, np.ndarray]:
    """Levels of bits: at each, the keys alone at their place settle there, the others go on.

    A key's slot is the number of set bits before its own, over all levels in a row.
    """
    sizes, bits, left = [], [], np.arange(len(ids))
    while len(left):
        if len(sizes) == LEVELS:
            raise ValueError("keys repeat")
        size = max(64, -(-2 * len(left) // 64) * 64)
        spot = (key_hash(ids[left], copies[left], len(sizes)) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(spot, minlength=size) == 1
        sizes.append(size)
        bits.append(alone)
        left = left[~alone[spot]]
    flat = np.concatenate(bits) if bits else np.zeros(0, bool)
    return {"sizes": np.array(sizes, np.int64), "bits": np.packbits(flat, bitorder="little"),
            "ranks": np.concatenate([[0], np.cumsum(flat.reshape(-1, 64).sum(1))[:-1]]).astype(np.int64)
            if len(flat) else np.zeros(0, np.int64)}


def slots(index: dict[str, np.ndarray], ids: np.ndarray, copies: np.ndarray) -> np.ndarray:
    """The slot of each key; -1 where no level knows it."""
    out, left, base = np.full(len(ids), -1, np.int64), np.arange(len(ids)), 0
    words = index["bits"].view("<u8")
    for level, size in enumerate(index["sizes"].tolist()):
        spot = (key_hash(ids[left], copies[left], level) % np.uint64(size)).astype(np.int64) + base
        word, bit = words[spot >> 6], (spot & 63).astype(np.uint64)
        hit = (word >> bit) & np.uint64(1) == 1
        below = word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
        out[left[hit]] = index["ranks"][spot[hit] >> 6] + np.bitwise_count(below)
        left, base = left[~hit], base + size
    return out


def fingerprint(ids: np.ndarray, copies: np.ndarray) -> np.ndarray:
    return (key_hash(ids, copies, LEVELS + 1) >> np.uint64(32)).astype(np.uint32)


# --- jobs -----------------------------------------------------------------------------------

@dataclass
class TokenFiles:
    """The written files: entries (doc_id, copy, shard, offset, n_tokens, start), payloads and index."""
    folder: str
    width: int
    entries: DataFrame
    index_files: int


def write_ids(docs: DataFrame, path: str, end_id: int | None = 2, text: str = "text", id: str = "doc_id",
              keys_per_file: int = 8192) -> TokenFiles:
    """Encode every whole text with the library, append ``end_id``, write payloads and index.

    ``path`` is the vocabulary file on the executors.  ``keys_per_file`` sizes the index files.
    """
    spark = docs.sparkSession
    folder = new_folder(spark, "token-ids")
    top = max(len(vocabulary(path).bytes_of) - 1, end_id or 0)
    width = 2 if top < 1 << 16 else 4

    def write(stream):
        shard, kept = TaskContext.get().partitionId(), []

        def parts():
            enc, at = _encoder(path), 0
            for batch in slices(stream):
                ids, lengths = enc.encode_array(batch.column(1))
                firsts = np.cumsum(lengths) - lengths
                if end_id is None:
                    ids, lengths = np.delete(ids, firsts), lengths - 1
                    firsts = np.cumsum(lengths) - lengths
                else:  # a line end that leads a text becomes the end of the text before
                    ids[firsts] = end_id
                    ids = np.roll(ids, -1)
                kept.append((batch.column(0), at + firsts, lengths))
                at += len(ids)
                yield ids.astype(f"<u{width}").tobytes()

        _put(f"{folder}/ids", f"{shard}.ids", parts())
        place = 0
        for ids, offsets, lengths in kept:
            n = len(ids)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(np.full(n, shard, np.int32)), pa.array(place + np.arange(n, dtype=np.int64)),
                 pa.array(offsets), pa.array(lengths)], ["doc_id", "shard", "place", "offset", "n_tokens"])
            place += n

    tie = F.xxhash64("text")
    rows = (texts(docs, text=text, id=id).repartitionByRange(F.col("doc_id").asc_nulls_first(), tie)
            .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), tie, "text"))
    entries = written(rows.mapInArrow(write, "doc_id bigint, shard int, place bigint, offset bigint, n_tokens bigint"), "entries")
    # one row a shard on the driver: ids and documents before it
    totals = sorted(entries.groupBy("shard").agg(F.sum("n_tokens"), F.count("*")).collect())
    before, shards = [0, 0], []
    for shard, n, k in totals:
        shards.append((shard, *before))
        before = [before[0] + n, before[1] + k]
    manifest = spark.createDataFrame(shards, "shard int, first_id bigint, first_row bigint")
    numbered = (entries.join(F.broadcast(manifest), "shard")  # a row a shard
                .select("doc_id", "shard", "offset", "n_tokens", (F.col("first_id") + F.col("offset")).alias("start"),
                        (F.col("first_row") + F.col("place")).alias("row")))
    repeated = written(numbered.groupBy("doc_id").agg(F.min("row").alias("first"), F.count("*").alias("n"))
                       .where("n > 1").select("doc_id", "first"), "repeated")
    nulls = numbered.where("doc_id IS NULL").withColumn("copy", -1 - F.col("row"))
    known = (numbered.where("doc_id IS NOT NULL").join(repeated, "doc_id", "left")
             .withColumn("copy", F.coalesce(F.col("row") - F.col("first"), F.lit(0))))
    columns = ["doc_id", "copy", "shard", "offset", "n_tokens", "start"]
    made = TokenFiles(folder, width, written(known.select(columns).unionByName(nulls.select(columns)), "entries"),
                      max(1, -(-before[1] // keys_per_file)))
    build_index(made)
    return made


def _with_file(rows: DataFrame, n: int) -> DataFrame:
    return rows.withColumn("file", F.pmod(F.xxhash64("doc_id", "copy"), F.lit(n)).cast("int"))


def _columns(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return (table["doc_id"].fill_null(0).to_numpy(zero_copy_only=False),
            table["copy"].to_numpy(zero_copy_only=False))


def _by_value(stream, column: str):
    """Tables of the rows of one value each, from batches sorted by the column."""
    held: list[pa.RecordBatch] = []
    for batch in stream:
        if not batch.num_rows:
            continue
        v = batch.column(batch.schema.get_field_index(column)).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(v)) + 1).tolist(), len(v)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if held and held[0].column(held[0].schema.get_field_index(column))[0].as_py() != v[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def build_index(made: TokenFiles) -> None:
    """Write the index files, one per hash of the keys."""
    folder, n = made.folder, made.index_files

    def build(stream):
        done = []
        for table in _by_value(stream, "file"):
            ids, copies = _columns(table)
            index = build_hash(ids, copies)
            order = np.empty(len(ids), np.int64)
            order[slots(index, ids, copies)] = np.arange(len(ids))
            out = io.BytesIO()
            np.savez(out, **index, fingerprints=fingerprint(ids, copies)[order],
                     **{c: table[c].to_numpy()[order] for c in ("shard", "offset", "n_tokens")})
            file = table["file"][0].as_py()
            _put(f"{folder}/index", f"{file}.npz", [out.getvalue()])
            done.append((file, len(ids)))
        yield pa.RecordBatch.from_pydict({"file": pa.array([f for f, _ in done], pa.int32()),
                                          "n": pa.array([k for _, k in done], pa.int64())})

    rows = _with_file(made.entries.select("doc_id", "copy", "shard", "offset", "n_tokens"), n)
    rows.repartition(n, "file").sortWithinPartitions("file").mapInArrow(build, "file int, n bigint").agg(F.sum("n")).collect()


def lookup(made: TokenFiles, keys: DataFrame) -> DataFrame:
    """Keys (doc_id, copy) with their shard, offset and n_tokens by the index; unknown keys have nulls."""
    folder, n = made.folder, made.index_files

    def find(stream):
        store, root = _files(folder)
        for table in _by_value(stream, "file"):
            ids, copies = _columns(table)
            name = f"{root}/index/{table['file'][0].as_py()}.npz"
            found, got = np.zeros(len(ids), bool), {}
            if store.get_file_info(name).is_file:
                with store.open_input_file(name) as f:
                    index = dict(np.load(io.BytesIO(f.read())))
                spot = slots(index, ids, copies)
                found = spot >= 0
                found[found] = index["fingerprints"][spot[found]] == fingerprint(ids[found], copies[found])
                got = {c: index[c][np.maximum(spot, 0)] for c in ("shard", "offset", "n_tokens")}
            for batch in pa.table(
                    [table["doc_id"], table["copy"],
                     *(pa.array(got.get(c, np.zeros(len(ids))), t, mask=~found) for c, t in
                       (("shard", pa.int32()), ("offset", pa.int64()), ("n_tokens", pa.int64())))],
                    ["doc_id", "copy", "shard", "offset", "n_tokens"]).to_batches():
                yield batch

    rows = _with_file(keys.select("doc_id", F.col("copy").cast("bigint").alias("copy")), n)
    return rows.repartition(n, "file").sortWithinPartitions("file").mapInArrow(
        find, "doc_id bigint, copy bigint, shard int, offset bigint, n_tokens bigint")


def read_ids(made: TokenFiles, located: DataFrame, size: int = 4 << 20) -> DataFrame:
    """Located keys with ``ids``: their ids from the payload, as little-endian 32-bit integers.

    Each shard is read front to back in ranges of about ``size`` bytes.
    """
    folder, width = made.folder, made.width

    def read(stream):
        store, root = _files(folder)
        for table in _by_value(stream, "shard"):
            offsets, lengths = table["offset"].to_numpy(), table["n_tokens"].to_numpy()
            ends = np.cumsum(lengths)
            with store.open_input_file(f"{root}/ids/{table['shard'][0].as_py()}.ids") as f:
                a = 0
                while a < len(offsets):
                    b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + size // width, "right")))
                    start, stop = int(offsets[a]), int((offsets[a:b] + lengths[a:b]).max())
                    if (stop - start) * width > 4 * size:  # far apart: one by one
                        b, stop = a + 1, int(offsets[a] + lengths[a])
                    f.seek(start * width)
                    raw = np.frombuffer(f.read((stop - start) * width), f"<u{width}").astype("<u4").tobytes()
                    ids = [raw[4 * (o - start):4 * (o - start + k)] for o, k in
                           zip(offsets[a:b].tolist(), lengths[a:b].tolist(), strict=True)]
                    part = table.slice(a, b - a)
                    yield from part.append_column("ids", pa.array(ids, pa.binary())).combine_chunks().to_batches()
                    a = b

    names = ["doc_id", "copy", "shard", "offset", "n_tokens"]
    rows = located.where("shard IS NOT NULL").select(names)
    return (rows.repartition("shard").sortWithinPartitions("shard", "offset")
            .mapInArrow(read, "doc_id bigint, copy bigint, shard int, offset bigint, n_tokens bigint, ids binary"))


def digests(made: TokenFiles) -> DataFrame:
    """Per document, found by the index and read back from the files: doc_id, start, n_tokens, ids_crc32."""
    spark = made.entries.sparkSession
    read = read_ids(made, lookup(made, made.entries.select("doc_id", "copy")))
    totals = sorted(made.entries.groupBy("shard").agg(F.min(F.col("start") - F.col("offset"))).collect())
    manifest = spark.createDataFrame([tuple(r) for r in totals], "shard int, first_id bigint")
    return read.join(F.broadcast(manifest), "shard").select(
        "doc_id", (F.col("first_id") + F.col("offset")).alias("start"),
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
