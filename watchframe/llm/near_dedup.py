"""Operator 6, MinHash near-duplicates by bottom-k sketches.

One hash function maps a document's distinct word shingles to 64 bits; the ``k`` smallest are
its sketch.  Documents with the same set form a class, and only classes are compared.

Inverted lists.  Two sets with a similarity of t share at least s of their retained values
(all of ceil(t n) for sets kept whole; for larger ones a number missed with a probability
below 1e-5 a pair).  So at least r of them are among the rarest ``size - s + r`` of each
sketch, in any one order.  The order is by the number of classes that retain a value, in the
steps of ``STEPS``, then by value.  Bitmaps tell the step, so a task orders its sketches alone and
only the rarest are shuffled; a value that a bitmap takes for a more frequent one is so for all
classes.  Values that one class retains need no list, and values of common passages stay out.

Overlaps.  Every list first names two leaders: members that share r lists with one are estimated
on the union sketch, then verified on the full sets, and joined into components, so a group of
any size costs one pair per member and not all pairs.

What is left are pairs across components, and of those only the ones outside the largest
component of a list or family look for partners.  A family is what near pairs connect; its
core are the shingles of half its members or more, and a member is its differences from the
core: core values it misses and other values it has.  The overlap of two members follows from
the numbers of their differences and those they share.  Whoever is similar to a member without
sharing differences is similar to the member nearest to the core, so one pair each finds these;
all others share a certain number, and are found by lists of the rarest differences and
checked on the differences, which is exact.  Across families, a member of a list is a guest of
the larger families in it, one row a family however many members it has; guests that share r
lists with a family are compared inside it like its members.  Pairs of sets in no family are
estimated and verified like the first.
Nothing is cut off: a list of any length is shuffled by value, and adaptive execution splits it.

Words are split at ASCII white space after A-Z are lower-cased.  A text with fewer words than
a shingle has its whole sequence as one; null, empty and blank texts have none and no links.
Rows without an id are linked with nothing and keep a null component.  Rows that repeat an id
with another text count as two texts of one document, which links to what either is like.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from watchframe.llm.common import batches, bitmap, discard, in_bitmap, sorted_out, texts, unused, written
from watchframe.llm.components import components
from watchframe.llm.words import WordHashes, bounds, windows

K, SIGMAS, OVERLAP = 96, 4.5, 4
#: Numbers of classes that retain a value from which on it counts as more frequent.
STEPS = (2, 4, 16, 128)


def shingle_sets(values: list[bytes], words: int, hashes: WordHashes) -> list[np.ndarray]:
    """Sorted distinct shingle hashes (63 bits) of each text."""
    lists = [v.lower().split() for v in values]
    starts = bounds(lists)
    h = hashes([w for ws in lists for w in ws])
    every = (windows(h, words) >> np.uint64(1)).astype(np.int64)
    out = []
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(every[a:b - words + 1]))
        elif b > a:
            out.append((windows(h[a:b], b - a) >> np.uint64(1)).astype(np.int64))
        else:
            out.append(np.zeros(0, np.int64))
    return out


def set_key(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) >> 1


def sampled_share(k: int, percent: int) -> int:
    """How many of k retained values two similar sets share at least."""
    t = percent / 100
    return max(1, math.floor(k * t - SIGMAS * math.sqrt(k * t * (1 - t))))


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(bounds(arrays).astype(np.int32)), pa.array(flat, pa.int64()))


def sketches(docs: DataFrame, words: int, k: int = K) -> DataFrame:
    """doc_id, n (set size), c (hash of the whole set), sketch (k smallest hashes, sorted)."""
    def run(stream):
        hashes = WordHashes()
        for batch, values in batches(stream):
            sets = shingle_sets(values, words, hashes)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([set_key(s) for s in sets], pa.int64()), _lists([s[:k] for s in sets])],
                ["doc_id", "n", "c", "sketch"])

    return docs.mapInArrow(run, "doc_id bigint, n bigint, c bigint, sketch array<bigint>")


def _entries(classes: DataFrame, k: int, percent: int) -> DataFrame:
    """The inverted entries (value, c, n, r) of the rarest retained values of each class, single ones left out.

    A class of which fewer than s retained values are in another class has no partner and no entries.
    """
    spark = classes.sparkSession

    def values(stream):
        for batch in stream:
            yield pa.RecordBatch.from_arrays([batch.column(0).flatten()], ["value"])

    counts = written(classes.select("sketch").mapInArrow(values, "value bigint").groupBy("value")
                     .agg(F.count("*").alias("m")).where("m > 1"), "counts")
    steps = [spark.sparkContext.broadcast(bitmap(counts.where(F.col("m") >= m).select(F.xxhash64("value").alias("h")), "h"))
             for m in STEPS]  # 8 MB each
    discard(counts)
    share = sampled_share(k, percent)

    def listed(stream):
        bitmaps = [np.frombuffer(b.value, np.uint8) for b in steps]
        for batch in stream:
            c, n, sketch = batch.columns
            v, ends = sketch.flatten().to_numpy(), sketch.offsets.to_numpy()
            size, n = np.diff(ends), n.to_numpy()
            step, some, h = np.zeros(len(v), np.int64), np.arange(len(v)), spark_hash(v)
            for bits in bitmaps:
                some = some[in_bitmap(bits, h[some])]
                step[some] += 1
            s = np.minimum(-(-n * percent // 100), share)
            r = np.minimum(s, OVERLAP)
            row = np.repeat(np.arange(len(n)), size)
            order = np.lexsort((v, step, row))
            place = np.arange(len(v)) - (ends[:-1] - ends[0])[row]
            # single values come first and make no entries; whoever shares fewer values than any partner must have has none
            single = np.bincount(row, step == 0, len(n))
            keep = (place < (size - s + r)[row]) & (step[order] > 0) & (size - single >= s)[row]
            column = lambda x: pa.array(np.repeat(x, size)[keep])  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([pa.array(v[order][keep]), column(c.to_numpy()), column(n), column(r)], ["value", "c", "n", "r"])

    return classes.select("c", "n", "sketch").mapInArrow(listed, "value bigint, c bigint, n bigint, r bigint")


def spark_hash(values: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of 64-bit integers."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (
        0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda x, n: (x << np.uint64(n)) | (x >> np.uint64(64 - n))
    x = turn(values.view(np.uint64) * p2, 31) * p1
    h = turn((np.uint64(42) + p5 + np.uint64(8)) ^ x, 27) * p1 + p4
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    return (h ^ (h >> np.uint64(32))).view(np.int64)


def _near(pairs: DataFrame, classes: DataFrame, docs: DataFrame, words: int, k: int, percent: int,
          loose: bool = False, also: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b, na, nb, common) that the union sketch holds likely, counted on the full sets; and those sets.

    Pairs of sets kept whole in their sketches are likely only if they are similar.  ``loose`` takes
    pairs of half the similarity as well, which makes families wide.  The sets of ``also`` (c) come with the others.
    """
    spark = pairs.sparkSession
    paired, _ = sorted_out(classes, F.col("c"), pairs.select(F.explode(F.array("a", "b")).alias("c")).distinct(), "c")
    left = paired.select(F.col("c").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    right = paired.select(F.col("c").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k)
    both = F.size(F.array_intersect(union, F.array_intersect("sa", "sb")))
    t = percent / 100
    low = F.lit(t / 2) if loose else F.lit(t) - SIGMAS * F.sqrt(F.lit(t * (1 - t)) / F.size(union))
    whole = (F.col("na") <= k) & (F.col("nb") <= k) & F.lit(not loose)
    exact = F.size(F.array_intersect("sa", "sb")) * 100 >= percent * F.size(F.array_union("sa", "sb"))
    likely = written(pairs.join(left, "a").join(right, "b").where(F.when(whole, exact).otherwise(both >= low * F.size(union)))
                     .select("a", "b", "na", "nb"), "likely")
    ends = likely.select(F.col("a").alias("c")).unionByName(likely.select(F.col("b").alias("c")))
    ends = (ends if also is None else ends.unionByName(also)).distinct()
    needed = written(ends.join(classes.select("c", "doc_id"), "c"), "needed")
    bits, keys = (spark.sparkContext.broadcast(bitmap(needed.select(F.xxhash64(x).alias("h")), "h")) for x in ("doc_id", "c"))  # 8 MB each

    def sets(stream):
        found, wanted, hashes = np.frombuffer(bits.value, np.uint8), np.frombuffer(keys.value, np.uint8), WordHashes()
        for batch in stream:
            batch = batch.filter(pa.array(in_bitmap(found, batch.column(2).to_numpy())))
            for part, values in batches([batch]):
                made = shingle_sets(values, words, hashes)
                c = np.array([set_key(s) for s in made], np.int64)
                some = np.flatnonzero(in_bitmap(wanted, spark_hash(c)))
                yield pa.RecordBatch.from_arrays([pa.array(c[some]), _lists([made[i] for i in some.tolist()])], ["c", "items"])

    # a repeated row gives its set again, which only makes more candidates, and a set that bitmaps let through meets no pair
    full = written(docs.where("doc_id IS NOT NULL").withColumn("h", F.xxhash64("doc_id")).mapInArrow(
        sets, "c bigint, items array<bigint>"), "sets")
    sa, sb = full.toDF("a", "ia"), full.toDF("b", "ib")
    counted = likely.join(sa, "a").join(sb, "b").select("a", "b", "na", "nb", F.size(F.array_intersect("ia", "ib")).alias("common"))
    counted = written(counted, "near")
    discard(likely, needed)
    return counted, full


def _similar(overlap: str, a: str, b: str, percent: int) -> str:
    """Whether an overlap is enough for sets of these sizes."""
    return f"({overlap}) * {100 + percent} >= {percent} * ({a} + {b})"


def near_groups(docs: DataFrame, words: int = 5, percent: int = 80, k: int = K, text: str = "text", id: str = "doc_id") -> DataFrame:
    """One row per row: doc_id, n_shingles, component_id, kept, class_id (smallest id with the same set)."""
    rows = texts(docs, text=text, id=id)
    every = written(sketches(rows, words, k), "sketches")
    sketched = written(every.select("doc_id", "n", "c"), "sizes")
    named = every.where("n > 0 AND doc_id IS NOT NULL")
    repeated = written(named.groupBy("c").count().where("count > 1").select("c"), "repeated-sets")
    maybe, single = sorted_out(named, F.col("c"), repeated, "c")  # sketches of single sets stay where they are
    one = maybe.groupBy("c").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = written(single.select(one.columns).union(one), "classes")
    discard(every)  # sketches are kept once
    named = sketched.where("n > 0 AND doc_id IS NOT NULL")
    all_entries = written(_entries(classes, k, percent), "entries")
    entries = all_entries
    lists = entries.groupBy("value").agg(F.count("*").alias("m"), F.min("c").alias("first"), F.max("c").alias("last")).where("m > 1")
    lists = written(lists, "lists")
    entries = written(entries.join(lists, "value"), "listed")
    discard(all_entries, lists)

    # an id that repeats with another text stands for both
    several = named.groupBy("doc_id").agg(F.min("c").alias("a"), F.max("c").alias("z")).where("a < z").select("doc_id", "a")
    links = written(named.select("doc_id", F.col("c").alias("b")).join(several, "doc_id").where("a < b").select("a", "b"), "same-id")
    led = [entries.where(f"c != {end}").groupBy(F.least("c", end).alias("a"), F.greatest("c", end).alias("b"))
           .agg(F.count("*").alias("shared"), F.min("r").alias("r")).where("shared >= r").select("a", "b") for end in ("first", "last")]
    pairs = written(led[0].union(led[1]).distinct(), "leader-pairs")
    near, sets = _near(pairs, classes, rows, words, k, percent, loose=True)
    similar = _similar("common", "na", "nb", percent)
    links = links.unionByName(near.where(similar).select("a", "b"))
    families = written(components(near).select(F.col("node").alias("c"), F.col("component").alias("leader")), "members")
    leaders = families.select("leader").distinct().select(F.col("leader").alias("c"), "leader")
    families = written(families.unionByName(leaders), "families")
    discard(pairs)

    across = _across(entries, families, components(links), percent)
    pairs = across.where("size = 1").select(F.least("c", "leader").alias("a"), F.greatest("c", "leader").alias("b"))
    guests, full = across.where("size > 1").select("c", "leader"), sets
    if not across.isEmpty():
        alone = guests.select("c").distinct().join(families, "c", "left_anti")
        near, more = _near(pairs, classes, rows, words, k, percent, also=alone)
        links = links.unionByName(near.where(similar).select("a", "b"))
        full = sets.unionByName(more)
    named = written(classes.select("c", "doc_id"), "class-ids")
    discard(entries, classes)  # no sketch is read from here on
    links = links.unionByName(_family_links(families, full, links, percent, guests))
    comp = components(links)
    discard(families, sets, across)
    return _members(sketched, named, comp)


def _with_component(rows: DataFrame, comp: DataFrame) -> DataFrame:
    return rows.join(comp.withColumnRenamed("node", "c"), "c", "left").withColumn("component", F.coalesce("component", "c"))


def _contested(rows: DataFrame, key: list[str], name: str) -> DataFrame:
    """The rows of the groups that hold several components, with the largest one as ``main``."""
    several = (rows.groupBy(*key, "component").agg(F.count("*").alias("m"))
               .groupBy(*key).agg(F.max_by("component", F.struct("m", "component")).alias("main"), F.count("*").alias("parts"))
               .where("parts > 1").drop("parts"))
    return written(rows.join(written(several, f"several-{name}"), key), f"rest-{name}")


def _other(rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.select(*key, *[F.col(c).alias(f"{c}_b") for c in rows.columns if c not in key and c != "main"])


ACROSS = "component != component_b AND (component_b = main OR c < c_b)"


def _family_links(families: DataFrame, sets: DataFrame, links: DataFrame, percent: int,
                  guests: DataFrame | None = None) -> DataFrame:
    """Links (a, b) across components within families, by the members' differences from the core.

    ``guests`` (c, leader) are compared with the members of families they are not in; they are no part of the core.

    With M core values missed, O others had, and c core values, two members that share s
    differences overlap in c - M - M' + s; they are similar if (100 + p) s >= W + W' - (100 - p) c,
    where W = 100 M + p O.  First all are compared with the member of the least W; what is similar
    to any without sharing differences is similar to that one.
    """
    members = families.withColumn("guest", F.lit(False))
    if guests is not None:
        members = members.unionByName(guests.withColumn("guest", F.lit(True)))
    rest = _contested(_with_component(members, components(links)), ["leader"], "family")
    contested, _ = sorted_out(sets, F.col("c"), rest.select("c"), "c")  # the sets of other families are not shuffled
    rest = written(rest.join(contested, "c"), "family-sets")
    size = rest.where("NOT guest").groupBy("leader").agg(F.count("*").alias("size"))
    counts = rest.where("NOT guest").select("leader", F.explode("items").alias("value")).groupBy("leader", "value").agg(F.count("*").alias("m"))
    core = written(counts.join(size, "leader").where("2 * m >= size").groupBy("leader").agg(F.collect_list("value").alias("core")), "cores")
    none = F.array().cast("array<bigint>")
    missed, had = F.array_except("core", "items"), F.array_except("items", "core")
    cut = (rest.join(core, "leader", "left").withColumn("core", F.coalesce("core", none))
           .withColumns({"missed": missed, "had": had}).withColumn("w", F.size("missed") * 100 + F.size("had") * percent)
           .select("leader", "c", "guest", "component", "main", "w", F.size("core").alias("core"), F.concat("missed", "had").alias("diff")))
    cut = written(cut, "differences")
    discard(rest)
    near = written(cut.groupBy("leader").agg(F.min("w").alias("w_b"), F.min_by(F.struct("c", "diff"), F.struct("w", "c")).alias("nearest")), "nearest")
    direct = (cut.join(near, "leader").select("c", "w", "core", "diff", "w_b", F.col("nearest.c").alias("c_b"), F.col("nearest.diff").alias("diff_b"))
              .where("c != c_b"))
    enough = (F.size(F.array_intersect("diff", "diff_b")) * (100 + percent) >= F.col("w") + F.col("w_b") - (100 - percent) * F.col("core"))
    direct = written(direct.where(enough).select(F.col("c_b").alias("a"), F.col("c").alias("b")), "nearest-links")
    discard(core, near)
    comp = components(links.unionByName(direct))
    cut = _contested(_with_component(cut.drop("component", "main"), comp), ["leader"], "left")
    minor = F.col("component") != F.col("main")
    joined = cut.join(written(cut.groupBy("leader").agg(
        F.min("w").alias("w_all"), F.min(F.when(minor, F.col("w"))).alias("w_minor")), "least"), "leader")
    # t: differences that a member shares with any partner at least
    partner = F.when(minor, F.col("w_all")).otherwise(F.col("w_minor"))
    t = F.greatest(F.lit(1), F.ceil((F.col("w") + partner - (100 - percent) * F.col("core")) / (100 + percent)))
    each = (joined.withColumn("t", t).where("size(diff) >= t")
            .select("leader", "c", "guest", "component", "w", "core", "t", F.size("diff").alias("k"), F.explode("diff").alias("value")))
    each = written(each, "differing")
    many = written(each.groupBy("leader", "value").agg(F.count("*").alias("m")).where("m > 1"), "shared-differences")
    own = Window.partitionBy("leader", "c")
    some = (each.join(many, ["leader", "value"])
            .withColumns({"single": F.col("k") - F.count("*").over(own), "place": F.row_number().over(own.orderBy("m", "value"))})
            .where("place <= k - t + 1 - single").select("leader", "value", "c", "guest", "component", "w", "core", (F.col("k") - F.col("single")).alias("many")))
    some = _contested(written(some, "rarest"), ["leader", "value"], "differences")
    pairs = (some.where("component != main").join(_other(some, ["leader", "value"]), ["leader", "value"])
             .where(F.expr(f"{ACROSS} AND NOT (guest AND guest_b) AND least(many, many_b) * {100 + percent} >= w + w_b - {100 - percent} * core"))
             .select("leader", "c", "c_b").distinct())
    ends = cut.select("leader", "c", "w", "core", "diff")
    others = ends.select("leader", F.col("c").alias("c_b"), F.col("w").alias("w_b"), F.col("diff").alias("diff_b"))
    both = written(pairs, "family-pairs").join(ends, ["leader", "c"]).join(others, ["leader", "c_b"])
    found = written(direct.unionByName(both.where(enough).select(F.col("c").alias("a"), F.col("c_b").alias("b"))), "family-links")
    discard(direct, each, many)
    return found


def _across(entries: DataFrame, families: DataFrame, comp: DataFrame, percent: int) -> DataFrame:
    """c, leader and size of the larger families (a set in none is one of size 1) that c shares enough lists with.

    A list makes a row for each member and larger family, not for each pair of members.  What a family has
    in a list is known by the extremes of its members there; a family that is joined to c, or none of whose sizes
    there can be similar, does not count.
    """
    tables = []

    def kept(rows, name):
        tables.append(written(rows, name))
        return tables[-1]

    sized = families.join(families.groupBy("leader").agg(F.count("*").alias("size")), "leader")
    marked = _with_component(entries.select("value", "c", "n", "r"), comp).withColumnRenamed("component", "joined").join(sized, "c", "left")
    marked = kept(marked.withColumns({"leader": F.coalesce("leader", "c"), "size": F.coalesce("size", F.lit(1))}), "marked")
    groups = kept(marked.groupBy("value", "leader").agg(
        F.first("size").alias("size"), F.min("r").alias("r_b"), F.min("n").alias("least"), F.max("n").alias("most"),
        F.min("joined").alias("low"), F.max("joined").alias("high")), "list-families")
    several = groups.groupBy("value").agg(F.max_by("leader", F.struct("size", "leader")).alias("top"), F.count("*").alias("parts"))
    several = kept(several.where("parts > 1").drop("parts"), "several-lists")
    rest = marked.join(several, "value").where("leader != top").select("value", "c", "n", "r", "joined", F.col("leader").alias("own"), F.col("size").alias("own_size"))
    found = kept(rest, "rest-lists").join(groups, "value").where(F.expr(
        "(size > own_size OR size = own_size AND leader > own) AND NOT (low = joined AND high = joined) "
        f"AND 100 * most >= {percent} * n AND 100 * n >= {percent} * least"))
    found = (found.groupBy("c", "leader").agg(F.count("*").alias("shared"), F.min(F.least("r", "r_b")).alias("r"), F.first("size").alias("size"))
             .where("shared >= r").select("c", "leader", "size"))
    found = written(found, "across")
    discard(*tables)
    return found


def _list_pairs(entries: DataFrame, families: DataFrame, comp: DataFrame, percent: int) -> DataFrame:
    """Pairs across components and families that share enough lists, of sizes that can be similar.

    In each list only the members outside its largest family look for partners.
    """
    marked = _with_component(entries.select("value", "c", "n", "r"), comp).join(families.select("c", "leader"), "c", "left")
    marked = marked.withColumn("joined", F.col("component")).withColumn("component", F.coalesce("leader", "c")).drop("leader")
    rest = _contested(written(marked, "marked"), ["value"], "lists")
    apart = f"joined != joined_b AND 100 * least(n, n_b) >= {percent} * greatest(n, n_b)"
    return (rest.where("component != main").join(_other(rest, ["value"]), "value").where(F.expr(f"{ACROSS} AND {apart}"))
            .groupBy(F.least("c", "c_b").alias("a"), F.greatest("c", "c_b").alias("b"))
            .agg(F.count("*").alias("shared"), F.min(F.least("r", "r_b")).alias("r")).where("shared >= r").select("a", "b"))


def _members(sketched: DataFrame, classes: DataFrame, comp: DataFrame) -> DataFrame:
    """Every row with its class and component, both named by their smallest doc_id."""
    placed = written(_with_component(classes.select("c", "doc_id"), comp), "placed")
    least = placed.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = written(placed.join(written(least, "least-ids"), "component").select("c", F.col("doc_id").alias("class_id"), "component_id"), "named")
    found = sketched.where("n > 0 AND doc_id IS NOT NULL").join(named, "c")
    rest = sketched.where("n = 0 OR doc_id IS NULL").withColumns({"class_id": F.col("doc_id"), "component_id": F.col("doc_id")})
    rows = found.unionByName(rest.select(found.columns))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), "component_id",
                       F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "class_id")


def deduplicated(docs: DataFrame, words: int = 5, percent: int = 80, text: str = "text", id: str = "doc_id") -> DataFrame:
    """The documents with the smallest id left of each component; columns as they were.

    Rows that repeat an id are one document and stay or go together.
    """
    groups = near_groups(docs, words, percent, text=text, id=id)
    gone = unused(docs, "_gone")
    drop = written(groups.where("NOT kept").select(F.col("doc_id").alias(gone)).distinct(), "drop")
    key = F.col(f"`{id}`").cast("long")
    maybe, left = sorted_out(docs, key, drop, gone)  # no text of a row that stays is shuffled
    return left.union(maybe.join(drop, key == F.col(gone), "left_anti"))
