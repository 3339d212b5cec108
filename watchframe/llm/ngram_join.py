"""Operator 11, the Jaccard join of word n-gram sets by PartEnum signatures.

Tasks make the signatures of their texts (``signatures``), sort them and cut them into blocks by
range, so what is shuffled are compressed arrays and not rows.  A block keeps the signatures that
several sets have; its parts stream one by one, first the tokens alone, of which each distinct one is held, then the
entries of those that came more than once, one of each held.  Most sets have
no partner: what their places without a common signature must differ by exceeds what a partner
may differ by.  They go, signatures that they alone shared go with them, and of the rest each set
keeps only those without which its allowance would be exceeded, rarest first.  That is exact: of
the signatures that two similar sets share, both keep the rarest.

What is left names pairs.  Every signature first names two leaders, members are verified against
them on full sets and joined into components and wider families; pairs within a family are found
by their differences from its core, pairs across families by the signatures again, and only
members outside the largest family of a signature look for partners.  No pairs of copies are
made: texts with the same set form one class.

Words are split at ASCII white space after A-Z are lower-cased.  A text with fewer words than a
shingle has its whole sequence as one; null, empty and blank texts have none and no links.  Rows
without an id are linked with nothing and keep a null component.  Rows that repeat an id with
another text count as two texts of one document, which links to what either is like.  Sets are
known by 63-bit hashes of shingles and texts.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from watchframe.llm import near_dedup
from watchframe.llm.common import batches, bitmap, discard, in_bitmap, sorted_out, texts, unused, written
from watchframe.llm.components import components
from watchframe.llm.near_dedup import set_key, shingle_sets
from watchframe.llm.signatures import signatures
from watchframe.llm.words import WordHashes

#: Bytes of text that a task turns into signatures at once, and bytes of text to a part of a block of signatures.
CHUNK, BLOCK = 4 << 20, 8 << 20
#: Parts of a block.  They share its tables of owners and are taken one after the other, so more parts shuffle less in the
#: same memory; a block waits compressed, beyond so many bytes in a file of the task.
PARTS, WAITING = 4, 64 << 20
#: Blocks that one shuffle cuts at most; more are cut in two steps, so arrays stay long.
CUTS = 4096
#: Tokens that a block counts at once, repeated signatures that it takes in at once, and signatures that the second step gathers before it cuts.
COUNTED, TAKEN, GATHERED = 1 << 20, 1 << 18, 1 << 21
#: The owner of a signature: set, 2 * band + level, need.
OWNER = np.dtype([("c", "<i8"), ("kind", "<i4"), ("need", "<i4")])
#: One signature on its way: token, owner, place and cost.
ENTRY = np.dtype([("token", "<u8"), ("c", "<i8"), ("kind", "<i4"), ("need", "<i4"), ("place", "<i4"), ("cost", "<i4")])
BLOB = "block int, blob binary, doc_id array<bigint>, n array<bigint>, c array<bigint>"
FOUND = "doc_id bigint, n bigint, c bigint, token bigint, kind int, need int, place int, cost int"
ROUNDS = 1
#: Bits of a signature that are shuffled: 44, as two that only look equal make a candidate and no link.
KEPT_BITS = np.uint64((1 << 64) - (1 << 20))


def _planes(columns: list[np.ndarray]) -> bytes:
    return b"".join(c.view(np.uint8).reshape(len(c), c.itemsize).T.tobytes() for c in columns)


def _columns(raw: bytes, kinds: list) -> list[np.ndarray]:
    widths = [np.dtype(k).itemsize for k in kinds]
    n, at, out = len(raw) // sum(widths), 0, []
    for kind, width in zip(kinds, widths, strict=True):
        out.append(np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T.copy().view(kind).reshape(n))
        at += n * width
    return out


def _pack(tokens: np.ndarray, owners: np.ndarray, spots: np.ndarray, table: np.ndarray, ends: list[int] | None = None) -> bytes:
    """The table of the owners that occur, then the entries up to each of ``ends``: tokens, and owners as steps in the table with spots.

    Bytes lie by place for the codec, and each piece is compressed on its own.
    """
    used = np.zeros(len(table), bool)
    used[owners] = True
    number = (np.cumsum(used) - 1)[owners]
    pieces, start = [_planes([table[name][used] for name in OWNER.names])], 0
    for end in ends or [len(tokens)]:
        steps = np.diff(number[start:end].astype("<u4"), prepend=np.uint32(0))  # modulo 2**32
        pieces += [_planes([tokens[start:end]]), _planes([steps, spots[start:end].astype("<u4")])]
        start = end
    packed = [pa.compress(p, "zstd", asbytes=True) if p else b"" for p in pieces]
    return b"".join([np.array([len(packed), *map(len, pieces), *map(len, packed)], "<i8").tobytes(), *packed])


def _piece(blob: bytes, i: int) -> bytes:
    count = int(np.frombuffer(blob, "<i8", 1)[0])
    raw, packed = np.frombuffer(blob, "<i8", 2 * count, 8).reshape(2, count).tolist()
    at = 8 + 16 * count + sum(packed[:i])
    return pa.decompress(blob[at:at + packed[i]], raw[i], "zstd", asbytes=True) if raw[i] else b""


def _tokens(blob: bytes, part: int = 0) -> np.ndarray:
    """The tokens of one part."""
    return _columns(_piece(blob, 1 + 2 * part), ["<u8"])[0]


def _unpack(blob: bytes, part: int = 0, among: _Among | None = None) -> np.ndarray:
    """The entries of one part, or those whose token is among some."""
    tokens = _tokens(blob, part)
    some = among(tokens) if among else np.arange(len(tokens))
    out = np.empty(len(some), ENTRY)
    if len(some):
        steps, spots = _columns(_piece(blob, 2 + 2 * part), ["<u4", "<u4"])
        number, spots = np.cumsum(steps, dtype=np.uint32)[some], spots[some]
        out["token"], out["place"], out["cost"] = tokens[some], spots >> 1, (spots & 1) + 1
        for name, column in zip(OWNER.names, _columns(_piece(blob, 0), [OWNER[x] for x in OWNER.names]), strict=True):
            out[name] = column[number]
    return out


class _Among:
    """Finds tokens that are among some sorted ones."""

    def __init__(self, some: np.ndarray):
        self.some, self.maybe = some, np.zeros(1 << 20, bool)
        self.maybe[self._slot(some)] = True

    def _slot(self, tokens: np.ndarray) -> np.ndarray:
        return (tokens >> np.uint64(20) & np.uint64(len(self.maybe) - 1)).astype(np.int64)

    def __call__(self, tokens: np.ndarray) -> np.ndarray:
        """Their positions."""
        spots = np.flatnonzero(self.maybe[self._slot(tokens)])
        return spots[self.some[np.searchsorted(self.some, tokens[spots]).clip(max=len(self.some) - 1)] == tokens[spots]] if len(spots) else spots


def _blobs(tokens: np.ndarray, owners: np.ndarray, spots: np.ndarray, table: np.ndarray, blocks: int) -> Iterator[tuple[int, bytes]]:
    """The signatures of each of ``blocks`` equal ranges of tokens that has any, those of an owner side by side."""
    fine = (((tokens >> np.uint64(32)) * np.uint64(blocks * PARTS)) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(fine * len(table) + owners)
    tokens, owners, spots, fine = tokens[order], owners[order], spots[order], fine[order]
    block = fine // PARTS
    first = np.flatnonzero(np.diff(block, prepend=-1))
    ends = np.append(first[1:], len(tokens))[:len(first)]
    for b, start, end in zip(block[first].tolist(), first.tolist(), ends.tolist(), strict=True):
        cuts = np.searchsorted(fine[start:end], b * PARTS + np.arange(1, PARTS + 1)).tolist()
        yield b, _pack(tokens[start:end], owners[start:end], spots[start:end], table, cuts)


def _emit(words: int, percent: int, blocks: int):
    """A map from texts to the signatures of their distinct sets, one array a block, and the sizes of all sets."""
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch, values in batches(stream, size=CHUNK):
            sets = shingle_sets(values, words, hashes)
            keys = np.array([set_key(s) for s in sets], np.int64)
            ids = batch.column(0)
            linked = np.flatnonzero(np.array([len(s) > 0 for s in sets]) & ids.is_valid().to_numpy(zero_copy_only=False))
            linked = linked[np.unique(keys[linked], return_index=True)[1]]
            owner, made = signatures([sets[i] for i in linked.tolist()], percent)
            table = np.empty(len(owner["set"]), OWNER)
            table["c"], table["need"] = keys[linked][owner["set"]], owner["need"]
            table["kind"] = owner["band"] * 2 + owner["level"]
            spots = made["place"] << 1 | made["cost"] - 1
            parts = dict(_blobs(made["token"] & KEPT_BITS, made["owner"], spots, table, blocks))
            rows = np.array_split(np.arange(len(sets)), blocks)
            some = [b for b in range(blocks) if b in parts or len(rows[b])]
            column = lambda x: pa.array([x.take(pa.array(rows[b])) for b in some], pa.list_(pa.int64()))  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays(
                [pa.array(some, pa.int32()), pa.array([parts.get(b) for b in some], pa.binary()),
                 column(ids), column(pa.array([len(s) for s in sets], pa.int64())), column(pa.array(keys))],
                ["block", "blob", "doc_id", "n", "c"])

    return run


def _recut(blocks: int):
    """A map from signatures of coarse blocks (rows come sorted by block) to those of ``blocks`` finer ones."""
    def cut(parts):
        every = np.concatenate(parts)
        owners, number = np.unique(every[list(OWNER.names)], return_inverse=True)
        spots = every["place"].astype(np.int64) << 1 | every["cost"] - 1
        rows = list(_blobs(every["token"], number, spots, owners.astype(OWNER), blocks))
        none = pa.nulls(len(rows), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary()), none, none, none],
                                          ["block", "blob", "doc_id", "n", "c"])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in stream:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.nulls(batch.num_rows, pa.binary()), *batch.columns[2:]],
                                             ["block", "blob", "doc_id", "n", "c"])
            for blob in batch.column(1).drop_null():
                packed = blob.as_py()
                parts += [_unpack(packed, p) for p in range(PARTS)]
                size += sum(map(len, parts[-PARTS:]))
                if size > GATHERED:
                    yield cut(parts)
                    parts, size = [], 0
        if parts:
            yield cut(parts)

    return run


class _Seen:
    """The distinct tokens of a part of a block, and which of them came more than once."""

    def __init__(self):
        self.tokens, self.twice = np.zeros(0, np.uint64), np.zeros(0, bool)

    def add(self, parts: list[np.ndarray]) -> None:
        every = np.concatenate([self.tokens, self.tokens[self.twice], *parts])
        every.sort()
        first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.zeros(0, np.int64)
        self.tokens, self.twice = every[first], np.diff(first, append=len(every)) > 1


class _Repeated:
    """Entries of the tokens of a block that several owners have; holds one entry a token."""

    def __init__(self):
        self.held, self.given = np.zeros(0, ENTRY), np.zeros(0, bool)

    def add(self, parts: list[np.ndarray]) -> np.ndarray:
        """What is known to be repeated by now and was not returned before; a pair may come again from another chunk."""
        every = np.concatenate([self.held, *parts])
        given = np.concatenate([self.given, np.zeros(len(every) - len(self.held), bool)])
        order = np.argsort(every["token"], kind="stable")  # the held one first
        every, given = every[order], given[order]
        token = every["token"]
        new = np.concatenate([[True], token[1:] != token[:-1]]) if len(every) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        run = np.cumsum(new) - 1
        other = (every["c"] != every["c"][first][run]) | (every["kind"] != every["kind"][first][run])
        several = np.bincount(run, other, len(first)) > 0
        several |= given[first]
        out = every[several[run] & ~given]
        self.held, self.given = every[first], several
        return out


def _repeated(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The entries of repeated tokens, block by block (rows come sorted by block), and the sizes of all sets."""
    fields = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("c", pa.int64()), ("token", pa.int64()), ("kind", pa.int32()),
                        ("need", pa.int32()), ("place", pa.int32()), ("cost", pa.int32())])

    def entries(found):
        return pa.RecordBatch.from_arrays(
            [pa.nulls(len(found), pa.int64()), pa.nulls(len(found), pa.int64()), pa.array(found["c"]), pa.array(found["token"].view(np.int64)),
             *(pa.array(found[x]) for x in ("kind", "need", "place", "cost"))], schema=fields)

    def of_block(waiting, sizes):
        def gathered(made, most):
            waiting.seek(0)
            parts, size = [], 0
            for length in sizes:
                parts.append(made(waiting.read(length)))
                size += len(parts[-1])
                if size > most:
                    yield parts
                    parts, size = [], 0
            if size:
                yield parts

        for p in range(PARTS):
            seen = _Seen()
            for parts in gathered(lambda blob: _tokens(blob, p), COUNTED):  # noqa: B023
                seen.add(parts)
            among, block = _Among(seen.tokens[seen.twice]), _Repeated()
            del seen
            for parts in gathered(lambda blob: _unpack(blob, p, among), TAKEN):  # noqa: B023
                yield entries(block.add(parts))
        waiting.close()

    now, waiting, lengths = None, None, []
    for batch in stream:
        sizes = [batch.column(i).flatten() for i in (2, 3, 4)]
        yield pa.RecordBatch.from_arrays([*sizes, *(pa.nulls(len(sizes[0]), t) for t in fields.types[3:])], schema=fields)
        for b, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if not blob.is_valid:
                continue
            if b != now:
                if lengths:
                    yield from of_block(waiting, lengths)
                now, waiting, lengths = b, tempfile.SpooledTemporaryFile(WAITING), []
            lengths.append(waiting.write(blob.as_py()))
    if lengths:
        yield from of_block(waiting, lengths)


def _surviving(entries: DataFrame) -> DataFrame:
    """The entries of sets whose common places can cost what a partner needs, with the number of sets that have the token."""
    own = Window.partitionBy("c", "kind")
    first = F.row_number().over(Window.partitionBy("c", "kind", "place").orderBy("token")) == 1
    rows = entries.drop("m").repartition("c").distinct()  # a set is in one task, so that one shuffle does for all
    rows = rows.withColumn("counts", F.when(first, F.col("cost")).otherwise(0)).withColumn("costs", F.sum("counts").over(own))
    left = written(rows.where("costs >= need").drop("counts", "costs"), "alive")
    tokens = left.groupBy("token").agg(F.count("*").alias("m")).where("m > 1")
    out = written(left.join(tokens, "token"), "surviving")
    discard(left)
    return out


def _kept(entries: DataFrame) -> DataFrame:
    """token, c: a token goes if the places of its set without a rarer one alone cost what a partner needs.

    The rarest token that two similar sets share: places whose tokens are all rarer are not
    shared, so what is left of the costs is at least the need, on both sides.
    """
    own = Window.partitionBy("c", "kind")
    last = F.row_number().over(Window.partitionBy("c", "kind", "place").orderBy(F.desc("m"), F.desc("token"))) == 1
    before = own.orderBy("m", "token").rowsBetween(Window.unboundedPreceding, -1)
    rows = entries.repartition("c").withColumn("closes", F.when(last, F.col("cost")).otherwise(0))
    rows = rows.withColumns({"costs": F.sum("closes").over(own), "rarer": F.coalesce(F.sum("closes").over(before), F.lit(0))})
    return rows.where("costs - rarer >= need").select("token", "c")


def _full_sets(docs: DataFrame, classes: DataFrame, words: int) -> DataFrame:
    """c and items (all shingle hashes) of the classes, from their texts."""
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(classes.select(F.xxhash64("doc_id").alias("h")), "h"))  # 8 MB

    def sets(stream):
        found, hashes = np.frombuffer(bits.value, np.uint8), WordHashes()
        for batch in stream:
            batch = batch.filter(pa.array(in_bitmap(found, batch.column(2).to_numpy())))
            for part, values in batches([batch]):
                made = shingle_sets(values, words, hashes)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([set_key(s) for s in made], pa.int64()), near_dedup._lists(made)],
                                                 ["doc_id", "c", "items"])

    full = docs.where("doc_id IS NOT NULL").withColumn("h", F.xxhash64("doc_id")).mapInArrow(
        sets, "doc_id bigint, c bigint, items array<bigint>")
    one = classes.select("c", "doc_id")
    # a repeated row gives its set again, which only makes the same pairs again
    return written(full.join(one, ["doc_id", "c"], "left_semi").drop("doc_id"), "sets")


def _counted(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, na, nb and common of pairs of classes, on full sets."""
    both = F.size(F.array_intersect("ia", "ib"))
    # only sets of a pair are shuffled
    sets = sets.join(pairs.select(F.explode(F.array("a", "b")).alias("c")).distinct(), "c", "left_semi")
    counted = pairs.join(sets.toDF("a", "ia"), "a").join(sets.toDF("b", "ib"), "b").select(
        "a", "b", F.size("ia").cast("long").alias("na"), F.size("ib").cast("long").alias("nb"), both.cast("long").alias("common"))
    return written(counted, "counted")


def jaccard_groups(docs: DataFrame, words: int = 5, percent: int = 80, text: str = "text", id: str = "doc_id") -> DataFrame:
    """One row per row: doc_id, n_shingles, component_id, class_id (smallest id with the same set)."""
    rows = texts(docs, text=text, id=id)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(16, -(-size // (BLOCK * PARTS)))
    coarse = -(-blocks // CUTS)
    made = rows.mapInArrow(_emit(words, percent, blocks if coarse == 1 else coarse), BLOB)
    if coarse > 1:
        blocks = coarse * -(-blocks // coarse)
        made = made.repartition(coarse, "block").sortWithinPartitions("block").mapInArrow(_recut(blocks), BLOB)
    made = written(made.repartition(min(blocks, 1 << 20), "block").sortWithinPartitions("block").mapInArrow(_repeated, FOUND), "signatures")
    sized = made.where("token IS NULL").select("doc_id", "n", "c")
    named = sized.where("n > 0 AND doc_id IS NOT NULL")
    classes = written(named.groupBy("c").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n")), "classes")
    entries = made.where("token IS NOT NULL").select("token", "c", "kind", "place", "cost", "need")
    for _ in range(ROUNDS):
        entries = _surviving(entries)
    kept = written(_kept(entries).join(classes.select("c", "n"), "c"), "kept")
    discard(entries)
    lists = kept.groupBy("token").agg(F.count("*").alias("m"), F.min("c").alias("first"), F.max("c").alias("last")).where("m > 1")
    kept = written(kept.join(lists, "token"), "listed")
    sets = _full_sets(rows, written(kept.select("c").distinct().join(classes, "c"), "needed"), words)

    # an id that repeats with another text stands for both
    several = named.groupBy("doc_id").agg(F.min("c").alias("a"), F.max("c").alias("z")).where("a < z").select("doc_id", "a")
    links = written(named.select("doc_id", F.col("c").alias("b")).join(several, "doc_id").where("a < b").select("a", "b"), "same-id")
    led = [kept.where(f"c != {end}").select(F.least("c", end).alias("a"), F.greatest("c", end).alias("b")) for end in ("first", "last")]
    pairs = written(led[0].union(led[1]).distinct(), "leader-pairs")
    near = _counted(pairs, sets)
    similar = near_dedup._similar("common", "na", "nb", percent)
    links = links.unionByName(near.where(similar).select("a", "b"))
    loose = near.where(near_dedup._similar("common", "na", "nb", percent // 2)).select("a", "b")
    families = written(components(loose).select(F.col("node").alias("c"), F.col("component").alias("leader")), "members")
    leaders = families.select("leader").distinct().select(F.col("leader").alias("c"), "leader")
    families = written(families.unionByName(leaders), "families")
    links = links.unionByName(near_dedup._family_links(families, sets, links, percent))
    comp = components(links)
    left = kept.select(F.col("token").alias("value"), "c", "n", F.lit(1).alias("r"))
    pairs = written(near_dedup._list_pairs(left, families, comp, percent), "list-pairs")
    if not pairs.isEmpty():
        links = links.unionByName(_counted(pairs, sets).where(similar).select("a", "b"))
        comp = components(links)
    discard(kept, families, sets)
    return near_dedup._members(sized, classes, comp).drop("kept")


def deduplicated(docs: DataFrame, words: int = 5, percent: int = 80, text: str = "text", id: str = "doc_id") -> DataFrame:
    """The documents with the smallest id left of each component; columns as they were.

    Rows that repeat an id are one document and stay or go together.
    """
    groups = jaccard_groups(docs, words, percent, text, id)
    gone = unused(docs, "_gone")
    drop = written(groups.where("doc_id != component_id").select(F.col("doc_id").alias(gone)).distinct(), "drop")
    key = F.col(f"`{id}`").cast("long")
    maybe, left = sorted_out(docs, key, drop, gone)  # no text of a row that stays is shuffled
    return left.union(maybe.join(drop, key == F.col(gone), "left_anti"))
