"""Operators 11 to 13 against brute force, with nulls, ties, repeats, empty tables and clashing names."""

import hashlib
import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from watchframe.llm import ngram_join, queries, vector_codes, whitening
from watchframe.llm.signatures import signatures

DOCS = "doc_id long, text string, c long, token long, kind int, n long, a string, component string"
VECTORS = "vec_id long, embedding array<float>, label int, x long, n long, of string, component int"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, 3, 4, "a", "c") for i, t in rows], DOCS)


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, y, 1, 2, "o", 3) for i, v, y in rows], VECTORS)


def shingles(text, words=5):
    ws = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\x1c", "\x1d")
          .translate({i: " " for i in (9, 10, 11, 12, 13)}).split(" ") if w]
    return {tuple(ws[i:i + words]) for i in range(max(1, len(ws) - words + 1))} if ws else set()


def groups(rows):
    """n_shingles and component of each row; ids that repeat are one document."""
    sets = [shingles(t) for _, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (i, a), (j, b) in itertools.combinations([(r[0], s) for r, s in zip(rows, sets) if r[0] is not None], 2):
        k = len(a & b)
        if a and b and 100 * k >= 80 * (len(a) + len(b) - k):
            x, y = sorted((root(i), root(j)))
            parent[y] = x
    return sorted(((i, len(s), root(i) if i is not None else None) for (i, _), s in zip(rows, sets)), key=lambda r: [(x is None, x) for x in r])


def changed(r, words, share):
    return [w if r.random() > share else f"new{r.randint(0, 60)}" for w in words]


def corpus():
    """A wide family of near copies, families that share a passage, exact copies, short and edge texts."""
    r = random.Random(11)
    word = lambda: f"w{r.randint(0, 3000)}"
    base, passage = [word() for _ in range(120)], [word() for _ in range(60)]
    out = [" ".join(changed(r, base, share)) for share in (0.005, 0.01, 0.02, 0.03, 0.05) for _ in range(30)]
    out += [" ".join(passage + [word() for _ in range(n)]) for n in (2, 5, 9, 14, 30, 60) for _ in range(12)]
    for _ in range(40):
        own = [word() for _ in range(r.randint(5, 90))]
        out += [" ".join(own), " ".join(changed(r, own, 0.02)), " ".join(own[:-r.randint(0, 4) or None])]
    out += ["Same Text here"] * 20 + ["same text here", "a", "A", "b c", "one two three four five", "one two three four six"]
    out += [" ".join(f"v{i}" for i in range(5000)), " ".join(f"v{i}" for i in range(4400))]
    rows = [(i, t) for i, t in enumerate(out)]
    return rows + [(900, None), (901, ""), (902, " \t\n"), (903, "À É"), (904, "à é"), (None, out[0]), (None, None), (3, out[-1]), (905, out[0]), (905, out[0])]


def test_join_equals_all_pairs(spark):
    rows = corpus()
    got = ngram_join.jaccard_groups(docs_of(spark, rows).repartition(7)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted((tuple(x) for x in got), key=lambda r: [(x is None, x) for x in r]) == groups(rows)


def test_join_cuts_in_two_steps(spark, monkeypatch):
    rows = corpus()[::3]
    monkeypatch.setattr(ngram_join, "CUTS", 5)
    got = ngram_join.jaccard_groups(docs_of(spark, rows).repartition(3)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted((tuple(x) for x in got), key=lambda r: [(x is None, x) for x in r]) == groups(rows)


def test_join_keeps_one_of_each_group_and_all_columns(spark):
    rows = [(5, "a b c d e f"), (2, "A b c d e f"), (7, "x"), (8, None), (9, None), (None, "a b c d e f")]
    left = ngram_join.deduplicated(docs_of(spark, rows))
    assert left.columns == [c.split()[0] for c in DOCS.split(", ")]
    assert sorted((r.doc_id for r in left.collect()), key=lambda i: (i is None, i)) == [2, 7, 8, 9, None]


def test_join_of_nothing(spark):
    for rows in ([], [(1, None), (2, "")]):
        got = ngram_join.jaccard_groups(docs_of(spark, rows)).collect()
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == [(i, 0, i) for i, _ in rows]


@pytest.mark.parametrize("percent", [80, 90])
def test_similar_sets_share_kept_signatures(percent):
    """Any two similar sets share a signature, and what their common places cost reaches the need of both."""
    r = np.random.default_rng(percent)
    for n in [1, 2, 3, 4, 5, 7, 8, 9, 15, 16, 17, 33, 63, 64, 100, 127, 128, 300, 1000]:
        for _ in range(12):
            a = np.unique(r.integers(0, 1 << 63, n, dtype=np.int64))
            drop = r.integers(0, n * (100 - percent) // 100 + 1)
            b = np.unique(np.concatenate([r.permutation(a)[drop:], r.integers(0, 1 << 63, r.integers(0, n // 4 + 1), dtype=np.int64)]))
            common = len(np.intersect1d(a, b))
            if 100 * common < percent * (len(a) + len(b) - common):
                continue
            owner, made = signatures([a, b], percent)
            shared = []
            for level in (0, 1):
                for j in np.unique(owner["band"]):
                    pair = [np.flatnonzero((owner["set"] == s) & (owner["band"] == j) & (owner["level"] == level)) for s in (0, 1)]
                    if all(len(p) for p in pair):
                        tokens = [set(made["token"][made["owner"] == p[0]].tolist()) for p in pair]
                        both = tokens[0] & tokens[1]
                        for p in pair:
                            mine = made["owner"] == p[0]
                            hit = mine & np.isin(made["token"], list(both))
                            place = dict(zip(made["place"][hit].tolist(), made["cost"][hit].tolist()))
                            if owner["band"][p[0]] == int(np.log2(max(len(a), len(b)))):
                                assert sum(place.values()) >= owner["need"][p[0]]
                        shared.append(bool(both))
            assert any(shared)


def test_repeated_tokens_stream_in_parts():
    r = np.random.default_rng(5)
    every = np.zeros(4000, ngram_join.ENTRY)
    every["token"], every["c"], every["kind"] = r.integers(0, 1500, 4000), r.integers(0, 40, 4000), r.integers(0, 2, 4000)
    block, got = ngram_join._Repeated(), set()
    for part in np.array_split(every, 9):
        got |= {(e["token"], e["c"], e["kind"]) for e in block.add([part])}
    owners = {}
    for e in every:
        owners.setdefault(e["token"], set()).add((e["c"], e["kind"]))
    assert got == {(t, *o) for t, some in owners.items() if len(some) > 1 for o in some}
    assert len(block.held) == len(owners)


def test_blobs_round_trip():
    table = np.zeros(3, ngram_join.OWNER)
    table["c"], table["kind"], table["need"] = [-5, 7, 1 << 62], [1, 2, 3], [0, -4, 9]
    tokens = np.array([0, 5, 5, 1 << 63, (1 << 64) - 1], np.uint64)
    got = ngram_join._unpack(ngram_join._pack(tokens, np.array([2, 0, 2, 0, 2]), np.array([0, 3, 5, 70001, 2]), table))
    assert got["token"].tolist() == tokens.tolist() and got["c"].tolist() == [1 << 62, -5, 1 << 62, -5, 1 << 62]
    assert got["place"].tolist() == [0, 1, 2, 35000, 1] and got["cost"].tolist() == [1, 2, 2, 2, 1] and got["need"].tolist() == [9, 0, 9, 0, 9]


NAN, INF = float("nan"), float("inf")
BAD = [(50, None, 1), (51, [1.0, None, 2.0], 1), (52, [NAN, 0.0, 1.0], 1), (53, [1.0, -INF, 0.0], None), (54, [], 1), (55, [1.0], 1)]


def some_vectors(n=70, d=3, seed=3):
    r = np.random.default_rng(seed)
    rows = [(int(i), [float(np.float32(x)) for x in r.normal(size=d) * [1, 0.3, 4, 2, 1, 1, 1][:d]], int(r.integers(0, 3)) or None) for i in r.permutation(n)]
    return rows + rows[:5] + [(None, rows[3][1], None), (None, rows[4][1], 2)]


def codes_of(rows):
    return np.floor(256 * np.array([v for _, v, _ in rows], float)).astype(np.int64)


def test_whitening_equals_eigenvectors(spark):
    rows = some_vectors()
    got = whitening.whitened(vectors_of(spark, rows + BAD).repartition(3), components=2).collect()
    x = codes_of(rows)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(0)
    c = fit - sums / n
    e, w = np.linalg.eigh(c.T @ c / n)
    order = np.argsort(-e)
    want = {i: ((x[k] - sums / n) @ w[:, order] / np.sqrt(e[order]), int(((n * x[k] - sums) ** 2).sum())) for k, (i, _, _) in enumerate(rows) if i is not None}
    assert len(got) == 2 * len(rows)
    signs = {}
    for r in got:
        assert r.n == n and abs(r.explained - e[order][r.component - 1] / e.sum()) < 1e-12 and r.identity_error < 1e-10
        if r.vec_id is not None:
            z, deviation = want[r.vec_id]
            assert r.deviation == deviation and abs(abs(r.whitened) - abs(z[r.component - 1])) < 1e-9
            signs.setdefault(r.component, set()).add(np.sign(r.whitened) * np.sign(z[r.component - 1]))
    assert all(len(s) == 1 for s in signs.values())


def test_whitening_of_dependent_columns(spark):
    rows = [(i, [v[0], v[1], v[0] + 1.0, 0.5], y) for i, v, y in some_vectors()]  # rank 2
    got = whitening.whitened(vectors_of(spark, rows)).collect()
    assert {r.component for r in got} == {1, 2}
    assert max(r.identity_error for r in got) < 1e-9 and abs(sum({r.component: r.explained for r in got}.values()) - 1) < 1e-12


def test_whitening_survives_ill_condition():
    """The factors find variances fourteen orders of magnitude apart, where the covariance itself has lost them."""
    r = np.random.default_rng(1)
    q, _ = np.linalg.qr(r.normal(size=(500, 5)))
    scale = np.array([1e7, 1e4, 1.0, 1e-2, 1e-5])
    turn, _ = np.linalg.qr(r.normal(size=(5, 5)))
    x = q * scale @ turn
    factors, g = whitening.triangular_factors(lambda f: (lambda y: y.T @ y)(whitening.solved(x, f)), 500, 5)
    assert len(factors) >= 2
    root = np.linalg.cholesky(g).T
    for f in reversed(factors):
        root = root @ f
    assert np.allclose(np.linalg.svd(root)[1][:4], scale[:4], rtol=1e-6)


def test_whitening_of_nothing(spark):
    for rows in ([], BAD[:4], [(1, [1.0, 2.0], 1), (2, [1.0, 2.0], 1)]):
        assert whitening.whitened(vectors_of(spark, rows)).count() == 0
    one = whitening.whitened(vectors_of(spark, [(1, [1.0, 2.0], 1), (2, [3.0, 2.0], None)])).collect()
    assert [(r.component, r.n, r.deviation) for r in one] == [(1, 2, 512 ** 2)] * 2 and all(abs(abs(r.whitened) - 1) < 1e-12 for r in one)


def test_large_deviations_stay_exact():
    model = whitening.Whitening(3, np.array([2 ** 31, 5]), np.eye(2), np.ones(2), 2.0)
    x = np.array([[2 ** 29, 1], [0, 0]])
    assert model.deviations(x).tolist() == [(3 * 2 ** 29 - 2 ** 31) ** 2 + 4, 2 ** 62 + 25]


def brute_codes(rows, parts, entries, rounds):
    x = codes_of(rows)
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, x[k].tolist()))
    books = x[order[:entries]].copy()
    cuts = vector_codes._cuts(x.shape[1], parts)

    def assign(cut):
        far = ((x[:, None, cut] - books[None, :, cut]) ** 2).sum(2)
        return far.argmin(1), far.min(1)

    for _ in range(rounds):
        after = books.copy()
        for cut in cuts:
            code, _ = assign(cut)
            for j in set(code.tolist()):
                after[j, cut] = [s // int((code == j).sum()) for s in x[code == j, cut].sum(0).tolist()]
        books = after
    found = [assign(cut) for cut in cuts]
    errors = sum(f[1] for f in found)
    text = ",".join(str(v) for cut in cuts for row in books[:, cut].tolist() for v in row)
    per_label = {}
    for (_, _, y), e in zip(rows, errors.tolist()):
        per_label[y] = per_label.get(y, 0) + e
    return sorted(((i, "".join(f"{int(f[0][k]):02x}" for f in found), int(errors[k]), per_label[y], hashlib.sha256(text.encode()).hexdigest())
                   for k, (i, _, y) in enumerate(rows)), key=lambda r: [(x is None, x) for x in r])


@pytest.mark.parametrize(("d", "parts", "entries"), [(3, 2, 5), (7, 3, 8), (2, 2, 256), (6, 6, 1)])
def test_codes_equal_brute_force(spark, d, parts, entries):
    rows = some_vectors(d=d)
    got = vector_codes.vector_codes(vectors_of(spark, rows + [b for b in BAD if b[1] != [1.0]]).repartition(4), parts=parts, entries=entries)
    assert sorted((tuple(r) for r in got.collect()), key=lambda r: [(x is None, x) for x in r]) == brute_codes(rows, parts, entries, 2)


def test_codes_of_nothing(spark):
    for rows in ([], BAD[:4]):
        assert vector_codes.vector_codes(vectors_of(spark, rows)).count() == 0


@pytest.mark.parametrize(("terms", "reach"), [(1, 2 ** 31 - 1), (4, 150), (64, 2 ** 27), (3000, 2 ** 24)])
def test_limb_products_are_exact(terms, reach):
    r = np.random.default_rng(terms)
    a, b = (r.integers(-reach, reach + 1, (9, terms)) for _ in range(2))
    a[0], b[0] = reach, -reach
    want = [[sum(int(x) * int(y) for x, y in zip(p, q)) for q in b] for p in a]
    assert vector_codes.exact_products(a, b).tolist() == want
    with pytest.raises(OverflowError):
        vector_codes.exact_products(a << 32, b << 31)


def test_whitening_query_on_the_table(spark, sf):
    rows = [(r.vec_id, r.embedding, None) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = queries.op12_whitening(spark, sf).collect()
    x = codes_of(rows)
    fit = np.unique(x, axis=0)
    c = fit - fit.mean(0)
    e, w = np.linalg.eigh(c.T @ c / len(fit))
    e, w = e[::-1], w[:, ::-1]
    at = {i: k for k, (i, _, _) in enumerate(rows)}
    z = np.zeros((len(rows), 4))
    for r in got:
        z[at[r.vec_id], r.component - 1] = r.whitened
        assert abs(r.explained - e[r.component - 1] / e.sum()) < 1e-12
    want = (x - fit.mean(0)) @ w[:, :4] / np.sqrt(e[:4])
    assert np.abs(z * np.sign((z * want).sum(0)) - want).max() < 1e-9


def test_blocks_send_an_owner_once():
    """The bytes of a signature grow little with the number of parts, which share the table of their owners."""
    r = np.random.default_rng(7)
    owners = np.repeat(np.arange(4000), 40)
    tokens = r.integers(0, 1 << 63, len(owners), dtype=np.int64).view(np.uint64) << np.uint64(1) & ngram_join.KEPT_BITS
    table = np.zeros(4000, ngram_join.OWNER)
    table["c"], table["kind"], table["need"] = r.integers(0, 1 << 62, 4000), 14, 30
    spots = r.integers(0, 80, len(owners))
    cut = list(ngram_join._blobs(tokens, owners, spots, table, 8))
    assert sum(len(b) for _, b in cut) < 9 * len(tokens)
    got = np.concatenate([ngram_join._unpack(b, p) for _, b in cut for p in range(ngram_join.PARTS)])
    assert sorted(zip(got["token"].tolist(), got["c"].tolist())) == sorted(zip(tokens.tolist(), table["c"][owners].tolist()))


def test_blocks_hold_entries_of_repeated_signatures_only(monkeypatch):
    r = np.random.default_rng(8)
    table = np.zeros(50, ngram_join.OWNER)
    table["c"], table["kind"], table["need"] = np.arange(50), 14, 30
    blobs, owned, taken = [], {}, []
    for chunk in range(6):  # the sets of one come again in another, as copies do
        owners = np.repeat(np.arange(50), 30) if chunk < 5 else np.repeat(np.arange(10), 30)
        table["c"] = np.arange(50) + (50 * chunk if chunk < 5 else 0)
        tokens = r.integers(1, 1 << 43, len(owners)).astype(np.uint64) << np.uint64(20)
        tokens[::25] = r.integers(1, 9, len(tokens[::25])).astype(np.uint64) << np.uint64(61)
        blobs += [b for _, b in ngram_join._blobs(tokens, owners, np.arange(len(owners)), table, 1)]
        for t, c in zip(tokens.tolist(), table["c"][owners].tolist()):
            owned.setdefault(t, set()).add(c)
    none = pa.nulls(len(blobs), pa.list_(pa.int64()))
    batch = pa.RecordBatch.from_arrays([pa.array([0] * len(blobs), pa.int32()), pa.array(blobs, pa.binary()), none, none, none],
                                       ["block", "blob", "doc_id", "n", "c"])
    add = ngram_join._Repeated.add
    monkeypatch.setattr(ngram_join._Repeated, "add", lambda self, parts: taken.append(sum(map(len, parts))) or add(self, parts))
    monkeypatch.setattr(ngram_join, "TAKEN", 20)
    found = pa.Table.from_batches(ngram_join._repeated(iter([batch])))
    got = {(t % (1 << 64), c) for t, c in zip(found["token"].to_pylist(), found["c"].to_pylist()) if t is not None}
    assert got == {(t, c) for t, some in owned.items() if len(some) > 1 for c in some}
    assert sum(taken) == sum(len(t) for t in [[x for x in ngram_join._tokens(b, p).tolist() if len(owned[x]) > 1] for b in blobs for p in range(ngram_join.PARTS)])
