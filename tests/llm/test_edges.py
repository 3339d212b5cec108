"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns, for every operator."""

import glob
import hashlib
import itertools
import os
import random
import re
import tempfile
import time
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from watchframe.llm import (bpe, common, context_tree, decontamination, exact_dedup, near_dedup, quality,
                            token_count, token_output, toxicity, url_filter)

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
AZ = re.compile("[A-Z]")
KIND = "doc_id long, text string, component string, c long, a string, h long, tie string, label string, item string"


def lower(text):
    return AZ.sub(lambda m: m[0].lower(), text or "")


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "a", 2, "t", "l", "i") for i, t in rows], KIND)


TEXTS = ["", None, " ", "Ab", "aB", "ÀB", "àb", "one two three", "one  two\tthree\n", "a b", "x\x1cy", "<|endoftext|>", "it's <|endoftext|>mine",
         "word " * 3000, "z" * 20_000, "漢字 テスト 😀 é", "ΑΣ Σ", "tab\there", "trail \n"]
ROWS = [(i, t) for i, t in enumerate(TEXTS)] + [(3, "Ab"), (100, "ab"), (100, "ab"), (None, "ab"), (None, None), (7, "one two three"), (7, "other text")]


@pytest.fixture(scope="module")
def docs(spark):
    return docs_of(spark, ROWS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return docs_of(spark, ROWS).limit(0)


def key(row):
    return [(x is None, x) for x in row]


def test_round_trip_is_the_library(docs):
    tok = Tokenizer.from_file(BYTES)
    want = []
    for i, t in ROWS:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        back = tok.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    got = [tuple(r)[:4] for r in bpe.round_trip(docs, BYTES).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    coded = bpe.encode(docs, BYTES)
    assert sorted((tuple(r) for r in bpe.decode(coded, BYTES).collect()), key=key) == sorted(((i, t or "") for i, t in ROWS), key=key)


def test_random_texts_are_the_library():
    letters = ["a", "B", "é", "é", " ", "  ", "\n", "\t", " ", " ", "\x85", "\x1c", "'s", "'LL", "1", "²", "Σ", "İ", "ß",
               "<|endoftext|>", "<|startoftext|>", "<|endoftext", "漢字", "😀", "‍", "!?", "the ", " ing", "\r\n", "\0", "ﬁ", "　"]
    r = random.Random(3)
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 30))) for _ in range(3000)]
    enc, tok = bpe.encoder(BYTES), Tokenizer.from_file(BYTES)
    for t, raw in zip(texts, enc.encode(texts)):
        ids = np.frombuffer(raw, "<u4").tolist()
        assert ids == tok.encode(t, add_special_tokens=False).ids, t
        assert enc.decode(ids) == t
    tok, made = Tokenizer.from_file(WORDS), token_count.counter(WORDS)
    assert made.count(texts) == [len(tok.encode(t, add_special_tokens=False).ids) for t in texts]
    lib, tok = token_output._encoder(BYTES), Tokenizer.from_file(BYTES)
    assert lib.encode(texts) == [np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_marks_after_words_are_encoded_once():
    enc, sent = token_output.LibraryEncoder(BYTES), []
    library = enc.library

    class Counted:
        def encode_batch_fast(self, strings, **more):
            sent.extend(strings)
            return library.encode_batch_fast(strings, **more)

    enc.library = Counted()
    words = ["".join(w) for w in itertools.product("bdfghjkm", "aeiou", "lnprst", "aeiou")]
    got = enc.encode([" ".join(w + mark for w in words) for mark in ("", ".", ",", "!!", '?"', "...", "$$$", ";")])
    assert len({len(g) for g in got}) > 1
    # eight times the words before
    assert sum(map(len, sent)) < 2 * sum(len(w) + 1 for w in words)


def test_memory_of_pieces_is_bounded():
    r, tok = random.Random(2), Tokenizer.from_file(BYTES)
    enc = token_output.LibraryEncoder(BYTES, memory=40)
    for _ in range(60):
        texts = [" ".join(["the", "of."] + [r.choice("abcé") * r.randint(1, 30) + r.choice(["", ".", "'", "<|", "\nx"]) for _ in range(9)])
                 for _ in range(3)] + ["", "two  spaces"]
        r.shuffle(texts)
        assert enc.encode(texts) == [np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
        assert len(enc.known) < 40 + 2 * 40
    assert enc.encode([]) == []


def test_trees_merge_long_words_alike():
    from watchframe.llm.merges import encode_long, encode_many, vocabulary
    voc, r = vocabulary(BYTES), random.Random(1)
    words = ["".join(r.choice("ethans") for _ in range(r.randint(1, 128))).encode() for _ in range(400)] + [b"ab" * 400]
    for w, raw in zip(words, encode_many(voc, words)):
        assert np.frombuffer(raw, "<u4").tolist() == encode_long(voc, w)


def test_token_counts(docs, empty):
    tok = Tokenizer.from_file(WORDS)
    got = sorted((tuple(r) for r in token_count.count_tokens(docs, WORDS, limit=2).collect()), key=key)
    ns = [(i, len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids)) for i, t in ROWS]
    assert got == sorted(((*x, x[2] > 2) for x in ns), key=key)
    assert token_count.count_tokens(empty, WORDS).count() == 0


def test_whole_tokens_are_single_tokens():
    tok, made = Tokenizer.from_file(WORDS), token_count.counter(WORDS)
    for w in sorted(made.whole)[::97]:
        assert len(tok.encode(w, add_special_tokens=False).ids) == 1


def test_token_files(docs, empty):
    tok = Tokenizer.from_file(BYTES)
    made = token_output.write_ids(docs, BYTES, end_id=2, keys_per_file=4)
    got = token_output.digests(made).collect()
    assert len(got) == len(ROWS)
    by_start = sorted(got, key=lambda r: r.start)
    ids = [r.doc_id for r in by_start]
    assert ids == sorted(ids, key=lambda x: (x is not None, x))
    at = 0
    for r in by_start:
        assert r.start == at
        at += r.n_tokens
    want = sorted(((i, zlib.crc32(np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes())) for i, t in ROWS), key=key)
    assert sorted(((r.doc_id, r.ids_crc32) for r in got), key=key) == want
    assert token_output.digests(token_output.write_ids(empty, BYTES)).count() == 0


def test_token_files_without_end_id(docs):
    tok = Tokenizer.from_file(BYTES)
    got = token_output.digests(token_output.write_ids(docs, BYTES, end_id=None)).collect()
    want = [(i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, ids in
            ((i, tok.encode(t or "", add_special_tokens=False).ids) for i, t in ROWS) if ids]
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got if r.n_tokens), key=key) == sorted(want, key=key)
    assert len(got) == len(ROWS)


def test_index_knows_its_keys_only(spark, docs):
    made = token_output.write_ids(docs, BYTES, keys_per_file=8)
    keys = spark.createDataFrame([(i, 0) for i in range(-50, 50)], "doc_id long, copy long")
    found = {r.doc_id: r.n_tokens for r in token_output.lookup(made, keys).collect()}
    assert {i for i, n in found.items() if n is not None} == {i for i in range(19)}


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 20_000])
def test_perfect_hash(n):
    ids = np.random.default_rng(n).choice(1 << 40, n, replace=False).astype(np.int64)
    index = token_output.build_hash(ids, np.zeros(n, np.int64))
    assert sorted(token_output.slots(index, ids, np.zeros(n, np.int64)).tolist()) == list(range(n))


def exact_brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(lower(t), []).append(i)
    out = []
    for i, t in rows:
        g = groups[lower(t)]
        keep = max((x for x in g if x is not None), default=None)
        out.append((i, keep, len(g), i == keep, hashlib.sha256(lower(t).encode()).hexdigest()))
    return sorted(out, key=key)


def test_exact_groups(docs, empty):
    got = sorted((tuple(r) for r in exact_dedup.exact_groups(docs, digest=True).collect()), key=key)
    assert got == exact_brute(ROWS)
    few = exact_dedup.exact_groups(docs, prefix=2).collect()
    assert sorted((tuple(r)[:4] for r in few), key=key) == [r[:4] for r in exact_brute(ROWS)]
    assert exact_dedup.exact_groups(empty).count() == 0


def test_exact_dedup_leaves_one(spark, docs, empty):
    left = exact_dedup.deduplicated(docs)
    assert left.columns == docs.columns
    seen = [lower(r.text) for r in left.collect()]
    assert sorted(seen) == sorted({lower(t) for _, t in ROWS})
    unique = docs_of(spark, [(1, "A b"), (2, "a B"), (3, None), (4, "c")])
    assert sorted(r.doc_id for r in exact_dedup.deduplicated(unique).collect()) == [2, 3, 4]
    assert exact_dedup.deduplicated(empty).count() == 0


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return frozenset(tuple(w[j:j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def near_brute(rows, k):
    """Smallest id reachable over links between rows of other or equal texts."""
    sets = [(i, shingles(t, k)) for i, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for p, (i, a) in enumerate(sets):
        for q, (j, b) in enumerate(sets[:p]):
            if a and b and i is not None and j is not None and 100 * len(a & b) >= 80 * len(a | b):
                root[find(p)] = find(q)
    low = {}
    for p, (i, _) in enumerate(sets):
        if i is not None:
            low[find(p)] = min(low.get(find(p), i), i)
    return sorted(((i, len(a), low.get(find(p))) for p, (i, a) in enumerate(sets)), key=key)


def test_near_groups_edges(docs, empty):
    rows = [r for r in ROWS]
    got = sorted((tuple(r)[:3] for r in near_dedup.near_groups(docs, words=2).collect()), key=key)
    assert got == near_brute(rows, 2)
    assert near_dedup.near_groups(empty).count() == 0
    left = near_dedup.deduplicated(docs, words=2)
    assert left.columns == docs.columns


@pytest.mark.parametrize("words", [2, 5])
def test_near_groups_families(spark, words):
    """Families of near copies around the limit, with a passage that most documents share."""
    r = random.Random(words)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = [r.choice(vocabulary) for _ in range(60)]
    rows = []
    for _ in range(12):
        base = [r.choice(vocabulary) for _ in range(r.choice([3, 20, 150, 600]))]
        for _ in range(r.choice([1, 2, 9])):
            copy = [w if r.random() > r.choice([0, 0.01, 0.04, 0.1]) / words else r.choice(vocabulary) for w in base]
            if r.random() < 0.6:
                at = r.randint(0, len(copy))
                copy[at:at] = passage
            rows.append((len(rows), " ".join(copy)))
    got = sorted(tuple(x)[:3] for x in near_dedup.near_groups(docs_of(spark, rows).repartition(4), words=words).collect())
    assert got == near_brute(rows, words)


def test_scores_of_trees(docs, empty):
    got = context_tree.scores(docs, held_out=lambda c: F.pmod(c, F.lit(5)) == 1, stored=False).collect()
    assert len(got) == len(ROWS)
    assert all(r.score < 0 and r.base_score < 0 and r.n_tokens >= 1 for r in got)
    assert context_tree.scores(empty, held_out=lambda c: c == 1, stored=False).count() == 0


def test_trees_against_a_plain_one():
    """Weights and predictions equal a recursive context-tree weighting of single bits."""
    import math
    values, depth = [b"abab", b"abracadabra", b"", b"ba"], 3
    train = [True, True, True, False]
    keys, starts = context_tree.byte_runs(values, depth)
    found = context_tree.Distinct()
    found.add(keys, np.repeat(train, np.diff(starts)))
    runs, n = found.merged()
    sums = context_tree.top_sums(runs, n, depth)
    codes, to = np.unique(sums[0], return_inverse=True)
    a, b, log = (np.bincount(to, x, len(codes)) for x in sums[1:])
    top = context_tree.Top(codes, a.astype(np.int64), b.astype(np.int64), log)
    got = dict(zip(runs.tolist(), context_tree.log_probabilities(runs, n, depth, top).tolist()))

    data, every = [], {}
    for t, v in zip(train, values):
        full = b"\0" * depth + v + b"\0"
        for p in range(depth, len(full)):
            past, x = tuple(full[p - j] for j in range(1, depth + 1)), full[p]
            every[past, x] = None
            if t:
                data.append((past, x))

    def counts(context, bits):
        own = [x for past, x in data if past[:len(context)] == context and f"{x:08b}".startswith(bits)]
        ones = sum(f"{x:08b}"[len(bits)] == "1" for x in own)
        return len(own) - ones, ones

    def kt(zeros, ones):
        return math.lgamma(zeros + 0.5) + math.lgamma(ones + 0.5) - math.lgamma(zeros + ones + 1) - math.log(math.pi)

    def weighted(context, bits):
        own = kt(*counts(context, bits))
        if len(context) == depth:
            return own
        below = children(context, bits)
        return math.log(0.5) + np.logaddexp(own, below)

    def children(context, bits):
        nexts = {past[len(context)] for past, x in data if past[:len(context)] == context}
        seen = {past[len(context)] for past, x in every if past[:len(context)] == context and f"{x:08b}".startswith(bits)}
        return sum(weighted((*context, c), bits) for c in nexts | seen)

    def zero(context, past, bits):
        z, o = counts(context, bits)
        own = (z + 0.5) / (z + o + 1)
        if len(context) == depth:
            return own
        share = 1 / (1 + math.exp(children(context, bits) - kt(z, o)))
        return share * own + (1 - share) * zero(past[:len(context) + 1], past, bits)

    for past, x in every:
        total = 0.0
        for j in range(8):
            z = zero((), past, f"{x:08b}"[:j])
            total += math.log10(z if f"{x:08b}"[j] == "0" else 1 - z)
        k = 0
        for c in past:
            k = k << 8 | c
        assert got[k << 8 | x] == pytest.approx(total, rel=1e-9)


BENCH = [("q1", "The quick brown fox jumps over the lazy dog again, and again it jumps"), ("q2", "short Item"), ("q3", None), (None, "null id item"),
         ("q4", "..."), ("q2", "short item"), ("q5", "short item")]


def contamination_brute(rows, size):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    wins = {}
    for item, t in BENCH:
        w = words(t)
        for j in range(max(0, len(w) - size) + 1 if w else 0):
            wins.setdefault(tuple(w[j:j + size]), set()).add(item or "")
    out = []
    for i, t in rows:
        w, hit, items = words(t), set(), set()
        for g, its in wins.items():
            for p in range(len(w) - len(g) + 1):
                if tuple(w[p:p + len(g)]) == g:
                    hit |= set(range(p, p + len(g)))
                    items |= its
        out.append((i, len(w), len(hit), ",".join(sorted(items))))
    return sorted(out, key=key)


@pytest.mark.parametrize("block", [500_000, 3])
def test_contamination(spark, docs, empty, block):
    bench = spark.createDataFrame(BENCH, "item_id string, text string")
    more = [(200, "before: the QUICK brown fox jumps over the lazy dog again and again it! after"), (201, "short  item, short item null id item"),
            (202, "fox jumps over the lazy dog again and again it"), (203, "a short item.")]
    rows = ROWS + more
    frame = docs.unionByName(docs_of(spark, more))
    got = decontamination.contamination(frame, bench, size=10, block_windows=block).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, ",".join(r["items"])) for r in got), key=key) == contamination_brute(rows, 10)
    clean = decontamination.decontaminated(frame, bench, block_windows=block)
    assert clean.columns == frame.columns and clean.count() == len(ROWS)
    spans = {r.doc_id: r.text for r in decontamination.decontaminated(frame, bench, remove="spans", block_windows=block).where("doc_id >= 200").collect()}
    assert spans == {200: "before: ! after", 201: "", 202: "", 203: "a ."}
    assert decontamination.contamination(empty, bench).count() == 0
    assert decontamination.contamination(docs, bench.limit(0)).where("n_hit > 0").count() == 0


def test_urls(spark):
    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
    urls = [None, "", "nothing", "http://Example.ORG/es/x", "http://a.example.org/en/123?q", "http://example.org/en/2#f", "http://xexample.org/es/",
            "https://w.com/fr/", "https://com/de/a", "https://com", "http://example.org?/es/", "://org/", "http://a.b.c.example.org/es/?x", "http://org/\n",
            "http://example.org/es", "http://user@host.com:80/de/x"]
    pages = spark.createDataFrame([(n, u, "x", "y") for n, u in enumerate(urls)] + [(3, urls[3], "x", "y"), (None, urls[7], "x", "y")],
                                  "page_id long, url string, short string, verdict string")

    def judge(u):
        rest = re.split(r"[?#]", u.split("://", 1)[1], maxsplit=1)[0] if u and "://" in u else ""
        host = rest.split("/", 1)[0]
        path = rest[len(host):]
        host = lower(host)
        best = max(((len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)), default=None)
        return host, path, best[3] if best else None, best[4] if best else "allow"

    frame = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = sorted((tuple(r) for r in url_filter.judge_urls(pages, frame).select("page_id", "url", "host", "path", "rule", "verdict").collect()), key=key)
    assert got == sorted(((r.page_id, r.url, *judge(r.url)) for r in pages.collect()), key=key)
    assert url_filter.judge_urls(pages.limit(0), frame).count() == 0
    assert {r.verdict for r in url_filter.judge_urls(pages, frame.limit(0)).collect()} == {"allow"}
    plan = url_filter.judge_urls(pages, frame)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def labelled(spark, n=400):
    r = random.Random(4)
    plain = [f"{a}{b}" for a in ("th", "an", "er", "on") for b in ("ing", "ed", "ly", "or", "a", "e", "ish", "al", "ic", "um")]
    rows, labels = [], []
    for i in range(n):
        bad = i % 8 == 0
        words = [r.choice(plain) for _ in range(r.randint(20, 200))]
        for _ in range(4 if bad else 0):
            words[r.randrange(len(words))] = r.choice(["vilexa", "vilexor", "vilexing"])
        rows.append((i, " ".join(words) + (" | " * 30 if i % 5 == 0 else "")))
        labels.append((i, int(i % 5 != 0), int(bad)))
    return rows, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("score, label", [(quality.scores, "quality"), (toxicity.scores, "toxic")])
def test_classifiers(spark, docs, empty, score, label):
    rows, labels = labelled(spark)
    held = lambda c: F.pmod(c, F.lit(4)) == 2
    got = score(docs_of(spark, rows), labels, label, held, threshold=0.3).join(labels, "doc_id").where("held_out").collect()
    assert len(got) > 50
    assert sum(r.predicted == r[label] for r in got) >= 0.95 * len(got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    edge = score(docs, labels, label, held, threshold=0.3).collect()
    assert len(edge) == len(ROWS) and all(0 <= r.score <= 1 for r in edge)
    odd = labels.limit(3).unionByName(labels.limit(2)).unionByName(spark.createDataFrame([(None, 1, 1), (5, None, None)], labels.schema))
    assert score(docs, odd, label, held).count() == len(ROWS)
    assert score(docs, labels.limit(0), label, held).count() == len(ROWS)
    assert score(empty, labels, label, held).count() == 0


def brute_nearest(counts, queries, idf, other, k):
    """Sorted cosines over all features, and each example's cosine."""
    def unit(c):
        w = {f: (1 + np.log(n)) * (idf[f] if f < len(idf) else other) for f, n in c.items()}
        length = np.sqrt(sum(x * x for x in w.values()))
        return {f: x / length for f, x in w.items()} if length else {}

    every = [unit(c) for c in counts]
    for q in map(unit, queries):
        found = np.array([sum(x * e[f] for f, x in q.items() if f < len(idf) and f in e) for e in every])
        yield found, np.sort(found)[::-1][:k]


def test_nearest_examples_are_exact():
    r = np.random.default_rng(2)
    counts = [{int(f): int(r.integers(1, 4)) for f in r.choice(40, r.integers(0, 6), replace=False)} for _ in range(700)]
    queries = [c | ({40: 2, 41: 1} if i % 3 == 0 else {}) for i, c in enumerate(counts[:60])]
    idf = r.random(40) + 0.1
    found = toxicity.Examples(list(range(700)), [int(x) for x in r.integers(0, 2, 700)], toxicity.Counts.of(counts), idf, 0.7, k=10)
    got = list(found.nearest(toxicity.Counts.of(queries)))
    for (e, s), (every, want) in zip(got, brute_nearest(counts, queries, idf, 0.7, 10), strict=True):
        assert s == pytest.approx(want[want > 0]) and every[e] == pytest.approx(s) and len(set(e.tolist())) == len(e)
        for a, b in zip(range(len(e)), range(1, len(e))):
            assert s[a] > s[b] or e[a] < e[b]


def test_block_bounds_skip_blocks_and_lose_nothing():
    """Four kinds of examples, as languages are: blocks of other kinds are skipped, the nearest stay exact."""
    r = np.random.default_rng(9)
    share = 1 / np.arange(1, 401)
    def text():
        own = 400 * int(r.integers(0, 4))
        return {int(f) + own: int(r.integers(1, 4)) for f in r.choice(400, r.integers(5, 60), replace=False, p=share / share.sum())}
    counts, queries = [text() for _ in range(2000)], [text() for _ in range(150)]
    idf = r.random(1600) + 0.2
    found = toxicity.Examples(list(range(2000)), [0] * 2000, toxicity.Counts.of(counts), idf, 0.5, k=10)
    for (e, s), (every, want) in zip(found.nearest(toxicity.Counts.of(queries)), brute_nearest(counts, queries, idf, 0.5, 10), strict=True):
        assert s == pytest.approx(want[want > 0]) and every[e] == pytest.approx(s)
    assert found.skipped > found.scored


def test_feature_counts_are_those_of_the_words():
    texts = [b"the the Seen", b"", b" other  toxicity others \xc3\xa9cole\xc3\xa9 a b c", "漢字 ÉA x\0y".encode(), b"x" * 300 + b" " + b"y" * 70_000, b"  "] * 40
    split = [v.translate(toxicity.ALNUM).split() for v in texts]
    row, hashes = toxicity.Words()(texts)
    assert row.tolist() == [i for i, ws in enumerate(split) for _ in ws]
    known = dict(zip([w for ws in split for w in ws], hashes.tolist()))
    assert [known[w] for ws in split for w in ws] == hashes.tolist() and len(set(known.values())) == len(known)
    names = sorted([b"the", b"toxicity", b"a", b"x" * 300], key=known.__getitem__)
    for piece in (50, 1 << 21):
        toxicity.PIECE, was = piece, toxicity.PIECE
        got, at = toxicity.Features(np.array([known[w] for w in names], np.uint64))(texts), 0
        toxicity.PIECE = was
        for ws, size in zip(split, got.sizes.tolist(), strict=True):
            want = sorted((names.index(w) if w in names else len(names), ws.count(w)) for w in set(ws))
            assert sorted(zip(got.f[at:at + size].tolist(), got.n[at:at + size].tolist())) == want
            at += size


def test_toxic_documents_go(spark):
    rows, labels = labelled(spark)
    docs = docs_of(spark, rows + [(1000, None), (1001, "")])
    left = toxicity.without_toxic(docs, labels, "toxic", lambda c: F.pmod(c, F.lit(4)) == 2, threshold=0.3)
    assert left.columns == docs.columns
    ids = {r.doc_id for r in left.collect()}
    assert len(ids & {i for i, _ in rows if i % 8}) >= 340 and not ids & {i for i, _ in rows if i % 8 == 0} and {1000, 1001} <= ids


def test_nearest_examples_among_many_features_are_exact():
    r = np.random.default_rng(5)
    share = 1 / np.arange(1, 3001)  # more features than long lists
    counts = [{int(f): int(r.integers(1, 4)) for f in r.choice(3000, r.integers(0, 200), replace=False, p=share / share.sum())} for _ in range(500)]
    idf = r.random(3000) * np.where(np.arange(3000) % 50, 0.01, 1) + 1e-5
    found = toxicity.Examples(list(range(500)), [0] * 500, toxicity.Counts.of(counts), idf, 0.01, k=10)
    got = list(found.nearest(toxicity.Counts.of(counts[:80])))
    for (e, s), (every, want) in zip(got, brute_nearest(counts, counts[:80], idf, 0.01, 10), strict=True):
        assert s == pytest.approx(want[want > 0]) and every[e] == pytest.approx(s)


def test_the_index_is_built_in_little_more_than_its_own_memory():
    """A worker builds it beside another one and the JVM, so what building takes besides counts as much as the index."""
    r = np.random.default_rng(6)
    n, each = 4000, 300
    f = np.sort(r.integers(0, 100_000, (n, each)) ** 2 // 100_000, axis=1)
    counts = toxicity.Counts(np.full(n, each), f.ravel(), r.integers(1, 5, n * each))
    state = toxicity.Packed(np.arange(n), r.integers(0, 2, n).astype(float), counts, r.random(100_000) + 0.1, 0.5, 10).__reduce__()
    tracemalloc.start()
    found = state[0](*state[1])
    now, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert most - now < 16e6  # 10 MB; 55 MB when all counts were taken out at once
    plain = toxicity.Examples(*state[1][:2], counts, *state[1][4:])
    assert (found.wide == plain.wide).all() and (found.listed == plain.listed).all() and (found.weight == plain.weight).all()
    some = toxicity.Counts(counts.sizes[:50], counts.f[:50 * each], counts.n[:50 * each])
    assert [e[0] for e, _ in found.nearest(some)] == list(range(50))


def test_scores_are_the_votes_of_brute_force(spark):
    """Counts over several files, weights, neighbours and votes, worked out plainly."""
    rows, labels = labelled(spark, 240)
    rows += [(5000, "marked " + " ".join(f"unknown{i}" for i in range(500))), (5001, None)]
    held = lambda c: F.pmod(c, F.lit(4)) == 2
    got = {r.doc_id: r for r in toxicity.scores(docs_of(spark, rows).repartition(5), labels, "toxic", held).collect()}
    known = {r.doc_id: r.toxic for r in labels.collect() if r.toxic is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2}

    def features(t):
        words = (t or "").encode().translate(toxicity.ALNUM).split()
        return {w: words.count(w) for w in words}

    every = {i: features(t) for i, t in rows}
    learnt = sorted(i for i in known if i in every)
    names = {f for i in learnt for f in every[i]}
    df = {f: sum(f in c for c in every.values()) for f in names}
    distinct = {}
    for i in learnt:
        t = dict(rows)[i]
        distinct[t] = max(distinct.get(t, 0), known[i])
    n, ones = len(distinct), sum(distinct.values())
    share = ones / n
    weight = {}
    for f in names:
        has = [y for t, y in distinct.items() if f in features(t)]
        k, a = len(has), sum(has)
        marked = k >= 3 and (a - k * share) ** 2 / (k * share * (1 - share) * (1 - k / (n + 1))) >= 30
        weight[f] = (np.log((1 + len(rows)) / (1 + df[f])) + 1e-3) * (1 if marked else toxicity.REST)
    other = (np.log(1 + len(rows)) + 1e-3) * toxicity.REST

    def unit(c):
        w = {f: (1 + np.log(m)) * weight.get(f, other) for f, m in c.items()}
        length = np.sqrt(sum(x * x for x in w.values()))
        return {f: x / length for f, x in w.items()}

    units = {i: unit(every[i]) for i in learnt}
    lone = [known[i] for i in learnt if not every[i]]
    base = (sum(lone) + np.mean([known[i] for i in learnt])) / (len(lone) + 1)
    for i in [*list(every)[:60], 5000, 5001]:
        q = unit(every[i])
        near = sorted(((-sum(x * units[e].get(f, 0) for f, x in q.items()), e) for e in learnt))[:25]
        votes = [(s * s, known[e]) for s, e in near if s < -1e-12]
        want = (sum(v * y for v, y in votes) + 0.05 * base) / (sum(v for v, _ in votes) + 0.05)
        assert got[i].score == pytest.approx(want, abs=1e-6)


def test_samples_keep_their_bounds(spark):
    """An id that repeats counts once; bytes bound the sample like rows do."""
    from watchframe.llm.labelled import labelled_sample
    docs = docs_of(spark, [(1, f"text {i}") for i in range(50)] + [(i, "x" * 10) for i in range(2, 30)])
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    never = lambda c: c < 0
    got = labelled_sample(docs, labels, "toxic", never, 10).collect()
    assert len(got) == len({r.doc_id for r in got}) <= 10
    few = labelled_sample(docs, labels, "toxic", never, 100, max_bytes=75).collect()
    assert sum(len(r.text) for r in few) <= 75 and len(few) >= 7
    assert labelled_sample(docs, labels, "toxic", never, 100, max_bytes=1).count() == 0


def test_copies_of_toxic_texts_without_marker_words(spark):
    """A toxic example without a word that marks the label is found by its other words."""
    rows, labels = labelled(spark)
    held = lambda c: F.pmod(c, F.lit(4)) == 2
    out = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    learnt, copy = (next(i for i in range(5000, 6000) if out(i) == o) for o in (False, True))
    text = " ".join(f"only{n}here" for n in range(40)) + " " + rows[1][1]
    rows += [(learnt, text), (copy, text.upper())]
    labels = labels.unionByName(spark.createDataFrame([(learnt, 1, 1), (copy, 1, 1)], labels.schema))
    got = toxicity.scores(docs_of(spark, rows), labels, "toxic", held, threshold=0.3).where(F.col("doc_id") == copy).first()
    assert got.held_out and got.predicted == 1 and got.evidence[0].doc_id == learnt and got.evidence[0].cosine == pytest.approx(1)
    left = toxicity.without_toxic(docs_of(spark, rows), labels, "toxic", held, threshold=0.3)
    assert not left.where(F.col("doc_id") == copy).count()


def test_one_of_equal_rows_is_always_the_same(spark):
    rows = [(1, "Ab"), (1, "aB"), (1, "AB"), (2, "x")]
    for turn in (1, -1):
        left = exact_dedup.deduplicated(docs_of(spark, rows[::turn]).repartition(3)).collect()
        assert sorted((r.doc_id, r.text) for r in left) == [(1, "aB"), (2, "x")]


# ---------------------------------------------------------------- quality: tokens, vectors, pooling

SIGNS = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\s]+")


def some_texts(seed: int = 5) -> list[bytes]:
    r = np.random.default_rng(seed)
    return [b"", b" \n", *(bytes(r.choice(list(b"aB1 ,.;\n\t\x1c\xc3\xa9"), r.integers(0, 60)).astype(np.uint8)) for _ in range(200)), b"", b"x"]


def test_quality_tokens_are_those_of_the_pattern():
    values, tokens, seen = some_texts(), quality.Tokens(), {}
    slots, starts = tokens(values)
    assert len(starts) == len(values) + 1 and starts[-1] == len(slots)
    for value, a, z in zip(values, starts[:-1], starts[1:], strict=True):
        for word, slot in zip(SIGNS.findall(value.lower()), slots[a:z].tolist(), strict=True):
            assert seen.setdefault(word, slot) == slot and 0 <= slot < quality.SLOTS
    assert len(set(seen.values())) > 0.95 * len(seen)


def test_run_hashes_do_not_depend_on_pieces(monkeypatch):
    values = some_texts(7)
    whole = quality.Tokens()(values)[0]
    monkeypatch.setattr("watchframe.llm.words.PIECE", 16)
    assert (quality.Tokens()(values)[0] == whole).all()
    assert [quality.Tokens()([v])[0].tolist() for v in values if v] == [quality.Tokens()([v, b"y"])[0][:-1].tolist() for v in values if v]


def test_quality_vectors_and_means_against_brute_force(monkeypatch):
    values, tokens = some_texts(9), quality.Tokens()
    places, signs = quality.index_vectors()
    sums, seen = np.zeros((quality.SLOTS, quality.WIDTH)), np.zeros(quality.SLOTS, int)
    texts = [tokens([v])[0].tolist() for v in values]
    for slots in texts:
        for i, s in enumerate(slots):
            seen[s] += 1
            for near in slots[max(0, i - quality.REACH):i] + slots[i + 1:i + 1 + quality.REACH]:
                for place, sign in zip(places[near], signs[near], strict=True):
                    sums[s, place] += sign
    counted = quality.count_contexts([pa.RecordBatch.from_pydict({"text": pa.array(values, pa.binary())})])
    assert (counted[:-quality.SLOTS].reshape(sums.shape) == sums).all() and (counted[-quality.SLOTS:] == seen).all()
    vectors = quality.word_vectors(np.concatenate([sums.ravel().astype(int), seen]))
    monkeypatch.setattr(quality, "POOLED", 7)
    for got, slots in zip(quality.pooled(vectors, tokens, values), texts, strict=True):
        assert np.allclose(got, vectors[slots].astype(float).mean(0) if slots else 0)


def test_sorted_out_keeps_every_row(spark):
    """Rows whose key is listed are all in the first part, null keys among them; nothing is lost or shuffled."""
    rows = spark.createDataFrame([(i if i % 7 else None, f"t{i}") for i in range(200)], "doc_id bigint, _maybe string")
    keys = spark.createDataFrame([(i,) for i in range(0, 200, 3)] + [(None,)], "gone bigint")
    maybe, others = common.sorted_out(rows, F.col("doc_id"), keys, "gone")
    assert maybe.columns == others.columns == rows.columns
    first, second = maybe.collect(), others.collect()
    listed = {r.gone for r in keys.collect()}
    assert not [r for r in second if r.doc_id in listed]
    assert sorted(map(str, first + second)) == sorted(map(str, rows.collect()))
    assert "Exchange" not in others._jdf.queryExecution().executedPlan().toString()


def test_dedup_shuffles_no_text(spark):
    """Rows that stay are not dealt out to drop the others, whatever the number of those."""
    rows = docs_of(spark, [(i, f"text {i // 2} of some words more or less") for i in range(40)])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for left in (exact_dedup.deduplicated(rows), near_dedup.deduplicated(rows, words=2)):
            plan = left._jdf.queryExecution().optimizedPlan().toString()
            assert "Union" in plan.split("\n")[0] and left.count() == 20
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_sets_without_enough_common_values_make_no_entries(spark):
    """Short texts around a common line have too few values in common for a partner, so the line makes no pairs."""
    line = " ".join(f"c{i}" for i in range(12))
    rows = [(i, f"{line} " + " ".join(f"u{i}x{j}" for j in range(14))) for i in range(60)]
    rows += [(100 + i, f"{line} same words here {i}") for i in range(3)]
    docs = docs_of(spark, rows)
    sketched = near_dedup.sketches(near_dedup.texts(docs), 2)
    entries = near_dedup._entries(sketched, near_dedup.K, 80)
    assert {r.c for r in entries.select("c").distinct().collect()} == {r.c for r in sketched.where("doc_id >= 100").collect()}
    got = sorted(tuple(r)[:3] for r in near_dedup.near_groups(docs, words=2).collect())
    assert got == near_brute(rows, 2)


def test_strays_of_a_list_make_a_row_a_family(spark, monkeypatch):
    """A few texts beside a large family of near copies: rows by families of a list, not by its members; links are found."""
    r = random.Random(4)
    fresh = lambda n: [f"v{r.randrange(10**9)}" for _ in range(n)]
    base, rows = fresh(100), []
    for _ in range(120):  # a family in many components
        copy = list(base)
        for at in r.sample(range(100), r.choice([4, 16, 22])):
            copy[at:at + 1] = fresh(1)
        rows.append((len(rows), " ".join(copy)))
    for _ in range(8):  # strays that share half a text, and a near copy of each second one
        text = base[20:70] + fresh(20)
        rows.append((len(rows), " ".join(text)))
        if len(rows) % 2:
            rows.append((len(rows), " ".join(text[:-1] + fresh(1))))
    made, across = [], near_dedup._across

    def counted(*a):
        out = across(*a)
        made.append(out.count())
        return out

    monkeypatch.setattr(near_dedup, "_across", counted)
    got = sorted(tuple(x)[:3] for x in near_dedup.near_groups(docs_of(spark, rows).repartition(4), words=2).collect())
    assert got == near_brute(rows, 2)
    assert made and made[0] <= 8 * 20


def test_guests_are_compared_with_the_members_of_a_family(spark):
    """A guest of two families is linked with what it is similar to in either; guests are no part of a core."""
    sets = {c: list(range(100)) for c in range(1, 6)} | {6: list(range(70)) + list(range(200, 230))}
    sets |= {c: list(range(1000, 1100)) for c in (11, 12)}
    for c in (2, 3, 4, 5, 12):
        sets[c] = sets[c][:-2] + [10_000 + c, 20_000 + c]
    sets[21] = list(range(70)) + list(range(200, 225)) + list(range(3000, 3005))  # like 6 only
    sets[22] = list(range(1000, 1095)) + list(range(3000, 3005))  # like 11 and 12
    sets[23] = list(range(60)) + list(range(4000, 4040))  # like none
    table = spark.createDataFrame(list(sets.items()), "c long, items array<long>")
    families = spark.createDataFrame([(c, 1) for c in range(1, 7)] + [(11, 11), (12, 11)], "c long, leader long")
    links = spark.createDataFrame([(1, c) for c in (2, 3, 4, 5)] + [(11, 12)], "a long, b long")
    guests = spark.createDataFrame([(g, f) for g in (21, 22, 23) for f in (1, 11)], "c long, leader long")
    found = {frozenset(x) for x in near_dedup._family_links(families, table, links, 80, guests).collect()}
    similar = {frozenset((a, b)) for a in sets for b in sets if a < b
               and 100 * len({*sets[a]} & {*sets[b]}) >= 80 * len({*sets[a]} | {*sets[b]})}
    assert found <= similar
    linked = lambda pairs: {frozenset(x) for x in groups_of(sets, pairs)}
    assert linked(found | {frozenset(tuple(x)) for x in links.collect()}) == linked(similar)


def groups_of(nodes, pairs):
    root = {c: c for c in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in map(tuple, pairs):
        root[find(a)] = find(b)
    return [[c for c in nodes if find(c) == top] for top in {find(c) for c in nodes}]


def test_entries_are_chosen_without_a_shuffle(spark):
    """Tasks order their sketches alone, by one order for all, so similar sets share enough entries."""
    r = random.Random(8)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = []
    for _ in range(40):
        base = [r.choice(vocabulary) for _ in range(r.choice([4, 12, 40, 90]))]
        for _ in range(3):
            rows.append((len(rows), " ".join(w if r.random() > 0.03 else r.choice(vocabulary) for w in base)))
    sketched = near_dedup.sketches(near_dedup.texts(docs_of(spark, rows).repartition(5)), 2).dropDuplicates(["c"])
    sketched = common.written(sketched, "sketched")
    entries = near_dedup._entries(sketched, near_dedup.K, 80)
    assert "Exchange" not in entries._jdf.queryExecution().executedPlan().toString()
    of, least = {}, {}
    for e in entries.collect():
        of.setdefault(e.c, set()).add(e.value)
        least[e.c] = e.r
    sets = {x.c: {*x.sketch} for x in sketched.collect()}
    pairs = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert len(pairs) > 10 and max(map(len, sets.values())) <= near_dedup.K
    assert all(len(of[a] & of[b]) >= min(least[a], least[b]) for a, b in pairs)


def test_a_written_table_leaves_no_shuffle_files(spark):
    top = os.environ.get("SPARK_LOCAL_DIRS") or spark.conf.get("spark.local.dir", tempfile.gettempdir())
    files = lambda: {f for d in top.split(",") for f in glob.glob(f"{d}/blockmgr-*/*/shuffle_*.data") + glob.glob(f"{d}/spark-*/blockmgr-*/*/shuffle_*.data")}
    spark.range(99).repartition(3, "id").collect()
    before, setting = files(), spark.conf.get(common.CLEANED, None)
    assert before  # this is where they are
    table = common.written(spark.range(100_000).repartition(7, "id"), "cleaned")
    until = time.time() + 20
    while files() - before and time.time() < until:
        time.sleep(0.1)
    assert not files() - before and table.count() == 100_000 and spark.conf.get(common.CLEANED, None) == setting
