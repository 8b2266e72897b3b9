"""ns-bounds clustering, hard negatives and BPE against brute force and the library, with odd rows."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from loomstat.llm import clustering, merges, negatives

VECTORS = "vec_id long, embedding array<float>, label int, cluster int, node string, v array<long>, h long"
NAN = float("nan")


def vector_table(spark, rows):
    """Rows with columns named like internal ones."""
    return spark.createDataFrame([(i, e, l, 1, "x", [1], 2) for i, e, l in rows], VECTORS)


def vectors(n, d=64, groups=7, seed=3):
    rng = np.random.default_rng(seed)
    X = rng.normal(size=(groups, d))[rng.integers(groups, size=n)] + rng.normal(size=(n, d)) * 0.6
    return (X / np.linalg.norm(X, axis=1, keepdims=True)).astype(np.float32)


def odd_rows(d=64):
    """A null vector, a null and a non-finite component, another length, an empty vector."""
    plain = [0.125] * (d - 1)
    return [(900, None, 1), (950, [*plain, None], 1), (1000, [*plain, NAN], 2), (1050, [*plain, float("inf")], 2), (1100, plain, 3), (1150, [], 3)]


def plain_clusters(rows, k, rounds):
    kept = [(i, np.floor(np.array(e, np.float32).astype(float) * 256).astype(np.int64)) for i, e in rows if e is not None and len(e) == 64 and all(x is not None and np.isfinite(x) for x in e)]
    V = np.stack([v for _, v in kept])
    named = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v.tolist()) for i, v in kept if i is not None)
    C = np.array([v for _, v in named[:k]])
    for t in range(rounds + 1):
        D = ((V[:, None] - C[None]) ** 2).sum(2)
        at = D.argmin(1)
        if t < rounds:
            for c in set(at.tolist()):
                C[c] = V[at == c].sum(0) // (at == c).sum()
    return Counter((i, int(c), int(D[r, c]), int(D[at == c, c].sum()), int(D[np.arange(len(V)), at].sum()), hashlib.sha256(",".join(map(str, C[c].tolist())).encode()).hexdigest()) for r, ((i, _), c) in enumerate(zip(kept, at, strict=True)))


@pytest.mark.parametrize(("n", "k", "rounds"), [(700, 12, 5), (700, 12, 0), (9, 12, 3), (300, 1, 2)])
def test_clusters_are_those_of_a_full_scan(spark, n, k, rounds):
    X = vectors(n)
    rows = [(i, [float(x) for x in e], i % 5) for i, e in enumerate(X)]
    rows += [rows[0], (3, rows[1][1], None), (None, rows[2][1], 1)]  # a repeated row, a repeated id, no id
    rows += [(2000 + i, rows[4][1], 1) for i in range(40)]  # copies: ties everywhere
    rows += odd_rows()
    got = clustering.clusters(vector_table(spark, rows), k=k, rounds=rounds).collect()
    assert Counter(tuple(r) for r in got) == plain_clusters([(i, e) for i, e, _ in rows], k, rounds)


def test_clusters_of_nothing(spark):
    assert clustering.clusters(vector_table(spark, [])).count() == 0
    assert clustering.clusters(vector_table(spark, odd_rows())).count() == 0


def test_bounds_save_rescans_and_loosen_by_the_norm_of_the_sum():
    X = np.floor(vectors(3000, groups=20).astype(float) * 256).astype(np.int64)
    C = [X[:20].copy()]
    state = clustering.History(C).start(X)
    saved = []
    for _ in range(8):
        new = C[-1].copy()
        for c in np.unique(state["cluster"]):
            new[c] = X[state["cluster"] == c].sum(0) // (state["cluster"] == c).sum()
        C.append(new)
        history = clustering.History(C)
        state = history.assign(X, state)
        D = ((X[:, None] - new[None]) ** 2).sum(2)
        assert (state["cluster"] == D.argmin(1)).all() and (state["distance"] == D.min(1)).all()
        assert (state["lower"] - history.moved[state["seen"], np.arange(20)[None]] <= np.sqrt(D)).all()
        saved.append(1 - state["rescanned"].sum() / D.size)
    assert saved[-1] > 0.9
    # there and back again: the sum of the drifts is long, the norm of their sum is zero
    there = [np.zeros((1, 4), np.int64), np.full((1, 4), 9), np.zeros((1, 4), np.int64)]
    assert clustering.History(there).moved[0, 0] == 0


def plain_negatives(rows, d, every=50, positives=5, count=3, low=50, high=95):
    kept = [(i, l, np.floor(np.array(e, np.float32).astype(float) * 256).astype(np.int64)) for i, e, l in rows if i is not None and l is not None and e is not None and len(e) == d and all(x is not None and np.isfinite(x) for x in e)]
    out = Counter()
    for i, l, a in kept:
        if i % every:
            continue
        scored = sorted(((-int(a @ v), j, m == l) for j, m, v in kept if j != i))
        for s, p, _ in [x for x in scored if x[2]][:positives]:
            fit = [(n, j) for n, j, same in scored if not same and low * -s <= 100 * -n <= high * -s]
            for rank, (n, j) in enumerate(fit[:count], 1):
                out[(i, p, rank, j, -s, -n)] += 1
    return out


@pytest.mark.parametrize(("rows_per_block", "anchors_per_block"), [(4096, 512), (64, 4)])
def test_hard_negatives(spark, monkeypatch, rows_per_block, anchors_per_block):
    monkeypatch.setattr(negatives, "ROWS", rows_per_block)
    monkeypatch.setattr(negatives, "ANCHORS", anchors_per_block)
    monkeypatch.setattr(negatives, "FAN", 2)
    monkeypatch.setattr(negatives, "FIRST", 1)
    monkeypatch.setattr(negatives, "WIDER", 2)
    monkeypatch.setattr(negatives, "TOGETHER", 2)
    X = vectors(900, d=16, groups=9)
    rng = random.Random(5)
    rows = [(i, [float(x) for x in e], rng.choice([0, 0, 0, 1, 2, 7])) for i, e in enumerate(X)]
    rows += [(5000 + i, rows[50][1], rng.choice([0, 1])) for i in range(60)]  # copies: ties
    rows += [rows[3], (3, rows[7][1], 2), (None, rows[1][1], 1), (650 + 50 * 40, rows[9][1], None)]
    rows += [(i, e and e[:16], l) for i, e, l in odd_rows(16)] + [(8000, [9.0, *[0.0] * 15], 0), (8001, [-9.0, *[0.0] * 15], 1)]
    got = negatives.hard_negatives(vector_table(spark, rows)).collect()
    assert Counter(tuple(r) for r in got) == plain_negatives(rows, 16)


def test_hard_negatives_of_little(spark):
    one = [0.5, 0.25]
    for rows in ([], [(1, one, 1)], [(50, one, 1)], [(50, one, 1), (51, one, 1)], [(50, one, 1), (51, one, 2)], [(50, one, None), (51, one, 2)], [(0, one, 1), (1, one, 1), (2, [0.25, 0.25], 2)]):
        got = negatives.hard_negatives(vector_table(spark, rows)).collect()
        assert Counter(tuple(r) for r in got) == plain_negatives(rows, 2)


def test_large_products_are_whole():
    rng = np.random.default_rng(1)
    A, X = (rng.integers(-(2**28), 2**28, size=(5, 16)) for _ in range(2))
    assert negatives.products(A, X).tolist() == [[sum(int(a) * int(x) for a, x in zip(r, s, strict=True)) for s in X] for r in A]


@pytest.mark.parametrize(("dims", "bits"), [(2, 4), (3, 3), (4, 2)])
def test_the_curve_visits_every_cell_and_steps_to_a_neighbour(dims, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    place = negatives.hilbert(cells, bits)
    assert sorted(place.tolist()) == list(range(len(cells)))
    along = cells[np.argsort(place)]
    assert (np.abs(np.diff(along, axis=0)).sum(1) == 1).all()


def test_zone_maps_bound_products(spark):
    rng = np.random.default_rng(4)
    boxes = [np.sort(rng.integers(-50, 50, size=(2, 6)), axis=0) for _ in range(8)]
    rows = [(int(i), *(x.tolist() for x in (*boxes[i], *boxes[7 - i]))) for i in range(8)]
    df = spark.createDataFrame(rows, "i int, lo array<long>, hi array<long>, low array<long>, high array<long>")
    for r in df.withColumn("r", negatives.product_range("lo", "hi", "low", "high")).collect():
        a, b = (rng.integers(np.array(x), np.array(y) + 1, size=(500, 6)) for x, y in ((r["lo"], r["hi"]), (r["low"], r["high"])))
        assert (r["r"]["low"] <= (a * b).sum(1)).all() and ((a * b).sum(1) <= r["r"]["high"]).all()


def text_table(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, [1]) for i, t in rows], "doc_id long, text string, decoded string, n_tokens int, ids array<int>")


@pytest.fixture(scope="module")
def words():
    path = public_tokenizers.path("word_bpe_49k.json")
    return path, merges.Facts(path), merges.library(path)


def samples(seed=2, n=400):
    rng = random.Random(seed)
    common = "aabcdehinorst'ÉéßΣσςİıẞ\x00\x1c\x85  ñ漢字0123٣²½!!??\n\t-_ȩ́ﬁ😀"
    out = ["".join(rng.choices(common, k=rng.randint(0, 80))) for _ in range(n)]
    out += ["".join(chr(rng.choice([rng.randint(1, 0x2FFF), rng.randint(1, 0xD7FF), rng.randint(0xE000, 0x10FFFF)])) for _ in range(20)) for _ in range(n)]
    return [*out, "", " \n", "<|endoftext|>", "a<|endoftext|>b <|startoftext|><|startoftext|>", "<|ENDOFTEXT|> \x00\x01 \x00<|endoftext|>", "a" * 60_000, "ab cd's " * 20_000, "ΑΣ ΑΣ́ ΑΣΑ"]


def test_bpe_is_the_library(spark, words):
    path, _, tok = words
    rows = [*enumerate(samples()), (7, "again"), (7, "again"), (None, "no id"), (8, None)]
    want, encoded = Counter(), {}
    for i, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        text = tok.decode(ids, skip_special_tokens=False)
        encoded[t or ""] = (ids, text)
        want[(i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())] += 1
    docs = text_table(spark, rows)
    assert Counter(tuple(r) for r in merges.digests(docs, path).collect()) == want
    for r in merges.encode(docs, path).collect():
        assert (r["ids"], r["decoded"]) == encoded[r["text"] or ""]
    assert merges.digests(text_table(spark, []), path).count() == 0


def test_chunks_keep_whole_texts():
    texts = ["abc", "", "d" * 50, "e", "f" * 9]
    assert [t for c in merges.chunks(texts, 10) for t in c] == texts
    assert list(merges.chunks([], 10)) == []


def greedy(symbols, ranks, parts):
    """One pre-token alone: the lowest rank first, of equal ones the leftmost."""
    while True:
        found = [(ranks[p], k) for k, p in enumerate(zip(symbols, symbols[1:], strict=False)) if p in ranks]
        if not found:
            return symbols
        r, k = min(found)
        symbols = [*symbols[:k], parts[r][2], *symbols[k + 2 :]]


def test_pairs_that_rank_below_the_one_at_hand():
    """Random merges in random order: a merge often makes a pair of a lower rank, which must come first in its pre-token."""
    rng = random.Random(9)
    for _ in range(60):
        texts, parts, made = {c: i for i, c in enumerate("abc")}, [], ["a", "b", "c"]
        pairs = set()
        while len(parts) < 25:
            a, b = rng.choice(made), rng.choice(made)
            if (a, b) in pairs or len(a + b) > 8:
                continue
            pairs.add((a, b))
            if a + b not in texts:
                texts[a + b] = len(texts)
                made.append(a + b)
            parts.append((texts[a], texts[b], texts[a + b]))
        rng.shuffle(parts)
        ranks = {(a, b): r for r, (a, b, _) in enumerate(parts)}
        keys = {(a << merges.SYMBOL) | b: r for (a, b), r in ranks.items()}
        words = [[rng.randrange(3) for _ in range(rng.randint(0, 30))] for _ in range(30)]
        assert merges.PairIndex(keys, parts, [list(w) for w in words]).merged() == [greedy(w, ranks, parts) for w in words]


def test_pair_index_lists_every_occurrence():
    ranks, parts = {1: 0, 2 << merges.SYMBOL: 1}, [(0, 1, 2), (2, 0, 3)]
    index = merges.PairIndex(ranks, parts, [[0, 1, 0], [1, 0, 1], [], [0, 1, 0, 1]])
    assert index.places == {0: [0, 4, 6, 8]}
    assert index.merged() == [[3], [1, 2], [], [2, 2]]
