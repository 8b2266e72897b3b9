"""Each operator on small tables against brute force, and on nulls, empty and long texts, ties, repeats, empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from loomstat.llm import common, licences, mixing, neardups, pieces, quality, search, sharding, tokens, toxicity, vectors

DOCS = "doc_id long, text string, lang string, source string, n_chars long, rank int, node long, label int"
WORDS = "alpha beta gamma delta eps zeta eta theta iota kappa lam mu nu xi omi pi rho sigma tau ups phi chi psi omega".split()
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts(n=60, seed=3):
    rng = random.Random(seed)
    out = [" ".join(rng.choices(WORDS, k=rng.randint(5, 60))) for _ in range(n)]
    for k in range(0, n, 5):
        words = out[k].split()
        out.append(out[k])
        words[rng.randrange(len(words))] = "changed"
        out.append(" ".join(words))
    return [*out, "", None, "\x00 \n\t", "  two  words ", "one", "é" * 50, "▁ a▁b  <|endoftext|> </s> <0x41>", "word " * 30_000]


def table(spark, rows=None):
    """Rows with odd cases: a null id, a repeated row, null and empty columns, and columns named like internal ones."""
    if rows is None:
        rows = [(i, t, ["en", None, ""][i % 3], ["a", "b", None, ""][i % 4]) for i, t in enumerate(texts())]
        rows += [rows[0], (None, "no id at all here", None, None)]
    return spark.createDataFrame([(d, t, l, s, len(t or ""), 7, 8, 9) for d, t, l, s in rows], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def ids_of(df):
    return Counter(r["doc_id"] for r in df.select("doc_id").collect())


def test_mix(docs, empty):
    rows = mixing.mix(docs, mixing.cycling()).collect()
    assert len(rows) == docs.count()
    size = lambda t: len(WORD.findall(t or ""))
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
        assert 0 <= r["taken"] <= 3 * r["size"]
    sizes = {s: sum(r["size"] for r in rs) for s, rs in by.items()}
    total = sum(sizes.values())
    assert total == sum(size(r["text"]) for r in docs.collect())
    left, want, full = dict.fromkeys(sizes, 0.0), dict(zip(sorted(sizes, key=lambda s: (s is None, s or "")), (5, 2, 1, 5, 2, 1), strict=False)), set()
    for _ in range(10):
        rest = total - sum(3 * sizes[s] for s in full)
        weight = sum(want[s] for s in sizes if s not in full)
        left = {s: 3 * sizes[s] if s in full else rest * want[s] / weight for s in sizes}
        full |= {s for s in sizes if left[s] >= 3 * sizes[s]}
    for s, rs in by.items():
        assert rs[0]["target"] == pytest.approx(left[s]) and sum(r["taken"] for r in rs) == round(rs[0]["target"])
    assert mixing.mix(empty, mixing.cycling()).count() == 0
    mixed = mixing.mixed_documents(docs, mixing.cycling())
    assert mixed.columns == docs.columns
    taken = sum(r["taken"] for r in rows)
    got = sum(size(r["text"]) for r in mixed.collect())
    assert abs(got - taken) <= 2 * 60  # only the repeated row is met once for each of its copies


def test_licences(spark, empty):
    rows = [(1, "x All  rights, RESERVED y all rights reserved", None, None), (2, None, None, None), (3, "under CC-BY and the General Public\nLicense", None, None), (4, "Licensed under the Apache License, Version 2.0.", None, None),
            (5, "licensed through our apache license version 2 0", None, None), (6, "general public", None, None), (4, "Released under the MIT License", None, None), (None, "cc by", None, None), (7, "pad " * 20000 + "cc by nc 4 0", None, None)]
    got = {(r["doc_id"], r["n_words"]): r for r in licences.scan(table(spark, rows)).collect()}
    assert len(got) == len(rows)
    first = got[(1, 8)]
    assert (first["n_base"], first["first_word"], first["last_word"], first["base_labels"]) == (2, 1, 5, "reserved")
    assert got[(2, 0)]["labels"] == "" and got[(2, 0)]["first_word"] is None and got[(2, 0)]["score"] == 0
    assert got[(3, 8)]["base_labels"] == "cc-by,gpl"
    assert got[(4, 8)]["labels"] == "apache-2.0" and got[(4, 8)]["score"] == 1
    assert got[(5, 8)]["labels"] == "apache-2.0" and 0.7 <= got[(5, 8)]["score"] < 1
    assert got[(6, 2)]["labels"] == "" and got[(4, 5)]["labels"] == "mit" and got[(None, 2)]["base_labels"] == "cc-by"
    assert got[(7, 20005)]["labels"] == "cc-by,cc-by-nc-4.0" and got[(7, 20005)]["first_word"] == 20000
    assert licences.scan(empty).count() == 0


def test_token_counts(docs, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    got = tokens.count_tokens(docs, path)
    for r in docs.join(got, "doc_id").collect():
        assert r["n_tokens"] == len(tok.encode(r["text"] or "", add_special_tokens=False).ids)
        assert r["n_bytes"] == len((r["text"] or "").encode()) and r["over_limit"] == (r["n_tokens"] > 1024)
    assert got.count() == docs.count() and tokens.count_tokens(empty, path).count() == 0


def test_token_counts_of_odd_strings():
    path = public_tokenizers.path("byte_bpe_50k.json")
    counter = tokens.Counter(path, tokens.whole_tokens(path), tokens.odd_characters(path))
    rng = random.Random(1)
    pool = [" ", "  ", "\n", "'ll", "b's", "1", "²", "é", "日本", "<|endoftext|>", " ", "\x1c", "\x85", "😀", "՘", "<|endof"]
    for _ in range(3000):
        t = "".join(rng.choice(pool) if rng.random() < 0.7 else chr(rng.choice([rng.randrange(32, 0x3000), rng.randrange(0xE000, 0x20000)])) for _ in range(rng.randrange(14)))
        assert counter.one(t) == len(counter.tok.encode(t, add_special_tokens=False).ids), repr(t)


def test_pieces(docs, empty):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = pieces.digests(docs, path)
    for r in docs.join(got, "doc_id").collect():
        ids = sp.encode(r["text"] or "", add_eos=True)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids))), sha(sp.decode(ids)))
        assert r["covered_bytes"] == len((r["text"] or "").encode())
    assert got.count() == docs.count() and pieces.digests(empty, path).count() == 0
    for r in pieces.encode(docs.where("length(text) < 500"), path).collect():
        data = (r["text"] or "").encode()
        at = 0
        for p in r["pieces"]:
            assert p["start"] == at
            at = p["end"]
        assert at == len(data)


def test_normaliser_follows_a_character_map():
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    lib = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc", add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=True)
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(lib.serialized_model_proto())
    own, rng = pieces.Normaliser(proto.normalizer_spec), random.Random(4)
    for _ in range(1500):
        t = "".join(rng.choice([" ", "  ", "a", "ﬁ", "Ａ", "①", "が", "\t", "▁"]) if rng.random() < 0.6 else chr(rng.randrange(1, 0x3400)) for _ in range(rng.randrange(10)))
        norm, source = own(t)
        assert norm.decode() == lib.normalize(t) and len(source) == len(norm) + 1 and (np.diff(source) >= 0).all()


def test_pieces_of_a_model_with_a_character_map(spark, tmp_path):
    """The same pieces, with the public model's vocabulary behind a compiled map: longest prefixes, squeezed spaces, spans."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    proto, map_of = sentencepiece_model_pb2.ModelProto(), sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read())
    map_of.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto())
    proto.normalizer_spec.precompiled_charsmap = map_of.normalizer_spec.precompiled_charsmap
    proto.normalizer_spec.remove_extra_whitespaces = True
    path = tmp_path / "mapped.model"
    path.write_bytes(proto.SerializeToString())
    sp, codec, rng = sentencepiece.SentencePieceProcessor(model_file=str(path)), pieces.Codec(str(path)), random.Random(6)
    for _ in range(1500):
        t = "".join(rng.choice([" ", "  ", "a", "word", "ﬁ", "Ａ", "①", "が", "\t", "▁", "</s>"]) if rng.random() < 0.7 else chr(rng.randrange(1, 0x3400)) for _ in range(rng.randrange(12)))
        ids, bounds = codec.encode(t)
        assert ids == sp.encode(t), repr(t)
        assert (np.diff(bounds) >= 0).all() and bounds[-1] <= len(t.encode())
    rows = [(1, "ﬁne  Ａ① text ", None, None), (2, None, None, None)]
    got = {r["doc_id"]: r["pieces"] for r in pieces.encode(table(spark, rows), str(path)).collect()}
    assert [p["piece"] for p in got[1]] == sp.encode("ﬁne  Ａ① text ", out_type=str) and got[2] == []
    assert got[1][0]["start"] == 0 and got[1][-1]["end"] == len("ﬁne  Ａ① text".encode())


def test_shards(docs, empty):
    rows = sharding.shard_documents(docs.where("doc_id is null or length(text) < 1000 or text is null"), shards=5).collect()
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r)
    weight = [sum(r["size"] for r in rs) for rs in by.values()]
    assert set(by) <= set(range(5)) and max(weight) - min(weight) <= 2 * max(r["size"] for r in rows)
    assert all(sorted(r["slot"] for r in rs) == list(range(len(rs))) for rs in by.values())
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(r["text_crc32"] == zlib.crc32((text[r["doc_id"]] or "").encode()) and r["size"] == len((text[r["doc_id"]] or "").encode()) + 8 for r in rows)
    assert {r["law"] for r in rows} == {"bytes"} and all(r["grown_shard"] is None for r in rows)
    assert sharding.shard_documents(empty, shards=3).count() == 0
    assert sharding.shard_documents(docs, target_bytes=10_000).agg(F.max("shard")).first()[0] >= 1


def test_shards_keep_equal_texts_together(spark):
    """Groups of equal texts up to a shard stay whole, heavier ones and rows repeated in all columns are dealt out; sizes stay near equal."""
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices(WORDS, k=40)), rng.choice(["en", "de"]), f"alpha_source_{rng.randrange(6)}") for i in range(900)]
    for k, copies in enumerate((15, 16, 17, 60, 90)):
        rows += [(2000 + 100 * k + j, f"group {k} " + "same words " * 30, "en", f"alpha_source_{j % 6}") for j in range(copies)]
    rows += [(5000 + j, "heavy group " + "same words " * 30, "en", "alpha_source_1") for j in range(700)]
    rows += [(6000, "one row again " + "and again " * 30, None, None)] * 500
    got = sharding.shard_documents(table(spark, rows), shards=8).collect()
    weight, group = Counter(), defaultdict(set)
    for r in got:
        weight[r["shard"]] += r["size"]
        group[r["doc_id"] // 100].add(r["shard"])
    assert len(got) == len(rows) and len(weight) == 8
    assert max(weight.values()) < 1.05 * min(weight.values())
    assert all(len(group[20 + k]) == 1 for k in range(5)) and len(set().union(*(group[50 + k] for k in range(7)))) > 1 and len(group[60]) > 1
    for shard in weight:
        assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in got)))


def test_tree_against_brute_force(spark):
    """The same cuts as a k-d tree built from all units at once."""
    rng = random.Random(2)
    units = [(rng.getrandbits(62), rng.randint(50, 99), *((rng.random(), round(rng.random(), 1), rng.random() ** 3) if k % 3 else (0.0, 1.0, 0.5))) for k in range(400)]
    axes = ["axis0", "axis1", "axis2"]

    def key(u, axis):
        return min(int(u[2 + axis] * sharding.GRID), sharding.GRID - 1) * sharding.TIES + u[0] % sharding.TIES

    def cut(us, m):
        if m == 1:
            return [us]
        axis = max(range(3), key=lambda k: max(u[2 + k] for u in us) - min(u[2 + k] for u in us))
        us = sorted(us, key=lambda u: key(u, axis))
        goal, before = sum(u[1] for u in us) * (m // 2) / m, 0
        for n, u in enumerate(us):
            if before + u[1] >= goal:
                n += goal - before >= before + u[1] - goal
                break
            before += u[1]
        return cut(us[:n], m // 2) + cut(us[n:], m - m // 2)

    want = {u[0]: k for k, part in enumerate(cut(units, 7)) for u in part}
    leaves, none = sharding.tree(spark.createDataFrame(units, "unit long, weight long, axis0 double, axis1 double, axis2 double"), [], 7)
    assert {r["unit"]: r["shard"] for r in leaves.collect()} == want and not none.count()


def shingles(text, width):
    words = [w.lower() for w in WORD.findall(text or "")]
    return {tuple(words)} - {()} if len(words) < width else {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def brute_components(rows, width, percent):
    sets = {i: shingles(t, width) for i, t in rows}
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            both = len(sets[x] & sets[y])
            if x < y and both and 100 * both >= percent * len(sets[x] | sets[y]):
                a, b = sorted((top(x), top(y)))
                up[b] = a
    return {i: (len(sets[i]), top(i)) for i in ids}


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, docs, empty, width, percent):
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    rng = random.Random(9)
    base = rng.choices(WORDS, k=120)
    for k in range(120):  # a family whose members are near each other only here and there
        words = list(base)
        for _ in range(rng.randint(1, 5)):
            words[rng.randrange(120)] = f"w{rng.randrange(9)}"
        rows[1000 + k] = " ".join(words)
    rows.pop(None)
    want = brute_components(rows.items(), width, percent)
    more = table(spark, [(i, t, None, None) for i, t in rows.items()] + [(0, rows[0], None, None), (None, rows[0], None, None)])
    got = neardups.near_duplicates(more, width, percent).collect()
    assert len(got) == len(rows) + 2
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (*want[r["doc_id"]], want[r["doc_id"]][1] == r["doc_id"])
    assert neardups.near_duplicates(empty, width, percent).count() == 0


def test_near_duplicates_one_id_with_several_texts(spark, docs):
    """Rows of one doc_id are one document: whatever one of its texts is linked with, all are; none is taken for another."""
    a, b, c, d = (" ".join(random.Random(k).choices(WORDS, k=40)) for k in range(4))
    near_c = c + " more"
    rows = [(3, b), (5, a), (5, b), (5, b), (7, c), (7, d), (8, near_c), (9, d), (2, a), (11, "other words stand here alone"), (12, ""), (12, c)]
    got = neardups.near_duplicates(table(spark, [(i, t, None, None) for i, t in rows]), 3, 85).collect()
    want = {2: 2, 3: 2, 5: 2, 7: 7, 8: 7, 9: 7, 11: 11}
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] == 12:  # without words a row has no links
            assert r["component_id"] == (7 if r["n_shingles"] else 12)
        else:
            assert (r["component_id"], r["kept"]) == (want[r["doc_id"]], want[r["doc_id"]] == r["doc_id"])


def test_near_duplicates_long_lists(spark, monkeypatch):
    """Lists above a block go through pairs of blocks, and find what brute force finds."""
    monkeypatch.setattr(neardups, "SHORT_LIST", 4)
    monkeypatch.setattr(neardups, "BLOCK", 8)
    rng = random.Random(5)
    rows = {}
    for f in range(3):  # chains whose members are near only here and there, with one passage in common
        base = rng.choices(WORDS, k=60) + [f"rare{k}" for k in range(12)]
        for k in range(60):
            words = list(base)
            for _ in range(rng.randint(1, 4)):
                words[rng.randrange(60)] = f"w{rng.randrange(9)}"
            rows[100 * f + k] = " ".join(words)
    want = brute_components(rows.items(), 3, 85)
    got = neardups.near_duplicates(table(spark, [(i, t, None, None) for i, t in rows.items()]), 3, 85).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


def sets_frame(spark, sets):
    return spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "node long, shingles array<long>")


@pytest.mark.parametrize("percent", [50, 80, 85, 100])
def test_two_sided_prefixes_lose_no_pair(spark, percent):
    """Every pair of similar sets of different components meets in a list, those exactly at the threshold too."""
    rng, sets = random.Random(percent), {}
    for _ in range(40):  # sets around a core, of sizes on both sides of what the threshold allows
        core = rng.sample(range(400), rng.choice([10, 17, 20, 34, 40, 85]))
        sets[len(sets)] = set(core)
        for cut in (percent, percent + 3, percent - 4):
            sets[len(sets)] = set(core[: max(1, len(core) * cut // 100)])
        sets[len(sets)] = set(core) | set(rng.sample(range(400), 3))
    frame = sets_frame(spark, sets)
    labels = spark.createDataFrame([(i, i) for i in sets], "node long, component long")
    lists = neardups.sided(neardups.rare_shingles(frame, percent), labels, percent)
    sides = lists.collect()
    met = defaultdict(lambda: (set(), set()))
    for r in sides:
        met[r["key"], r["band"]][not r["index"]].add(r["node"])
    pairs = {(a, b) for few, many in met.values() for a in few for b in many}
    want = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    assert len(want) > 20 and all((a, b) in pairs or (b, a) in pairs for a, b in want)
    for r in sides:
        few, many = met[r["key"], r["band"]]
        assert (r["few"], r["many"]) == (len(few), len(many))
    for blocks in (2, 1000):  # whole lists in pairs of blocks reach what links reach
        neardups.BLOCK, was = blocks, neardups.BLOCK
        try:
            links = neardups.block_links(lists, frame, percent).collect()
        finally:
            neardups.BLOCK = was
        up = {i: i for i in sets}

        def top(i, up=up):
            while up[i] != i:
                i = up[i]
            return i

        for r in links:
            up[max(top(r["a"]), top(r["b"]))] = min(top(r["a"]), top(r["b"]))
        assert all(top(a) == top(b) for a, b in want)
        reach = {i: i for i in sets}
        for _ in range(len(sets)):
            for a, b in want:
                reach[a] = reach[b] = min(reach[a], reach[b])
        assert {i: top(i) for i in sets} == reach


def test_a_common_passage_makes_no_long_list(spark):
    """Sets that have a passage in common, but too much of their own to be linked, meet in no list however many they are."""
    n = 300
    sets = {i: set(range(80)) | {1000 + 12 * i + k for k in range(12)} for i in range(n)}
    frame = sets_frame(spark, sets)
    prefixes = neardups.rare_shingles(frame, 85)
    labels = spark.createDataFrame([(i, i) for i in sets], "node long, component long")
    assert prefixes.groupBy("key").count().where(f"count = {n}").count() > 0  # by prefixes of one length all would meet
    assert neardups.sided(prefixes, labels, 85).count() == 0


def test_tensored_collections_are_enough():
    for t in (0.8, 0.85, 0.9):
        m = neardups.collections(t, 3, 1e-3)
        q = t**3
        assert (1 - q) ** m + m * q * (1 - q) ** (m - 1) <= 1e-3 < (1 - q) ** (m - 1) + (m - 1) * q * (1 - q) ** (m - 2)


VECTORS = "vec_id long, embedding array<float>, label int, cls string, size int"


def some_vectors(n=400, d=16, seed=2):
    rng = np.random.default_rng(seed)
    X = rng.normal(size=(n, d))
    X[n // 2 : n // 2 + 90] = X[0] + rng.normal(size=(90, d)) * 0.05
    X[-30:] = X[1]
    return [(i, [float(np.float32(v)) for v in x], int(i % 3 if i < n // 2 else 0), "x", 1) for i, x in enumerate(X)]


def odd_vectors(n=400):
    return [(9001, None, 1, "x", 1), (9002, [float("nan")] * 16, 1, "x", 1), (9003, [0.0] * 16, 1, "x", 1), (9004, [1.0] * 3, 1, "x", 1), (9005, [1.0] * 16, None, "x", 1), (9020, [float("inf")] * 16, 0, "x", 1), (9040, [None] * 16, 0, "x", 1)]


def test_near_vectors(spark):
    good = some_vectors()
    df = spark.createDataFrame(good + odd_vectors(), VECTORS)
    X, labels = np.array([v for _, v, *_ in good]), np.array([r[2] for r in good])
    cosine = (X @ X.T) / np.outer(*[np.linalg.norm(X, axis=1)] * 2)
    link = (cosine >= 0.98) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(link, False)
    label = np.arange(len(X))
    for _ in range(50):
        label = np.minimum(label, np.where(link, label[None, :], len(X)).min(1))
    got = {r["vec_id"]: r for r in vectors.near_vectors(df, miss=1e-6).collect()}
    assert len(got) == len(good) + 7
    for i in range(len(X)):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (link[i].sum(), label[i], label[i] == i)
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in got if i > 9000)
    assert vectors.near_vectors(spark.createDataFrame([], VECTORS)).count() == 0


def test_recall_of_codes():
    """Pairs exactly at the threshold meet in a table at least nine times in ten."""
    rng = np.random.default_rng(0)
    X = rng.normal(size=(3000, 32))
    b, m = vectors.plan(3000, 0.98, 1e-3)
    codes = vectors.Codes(X, b * m)
    U = X / np.linalg.norm(X, axis=1, keepdims=True)
    N = rng.normal(size=X.shape)
    N -= (N * U).sum(1, keepdims=True) * U
    Y = 0.98 * U + math.sqrt(1 - 0.98**2) * N / np.linalg.norm(N, axis=1, keepdims=True)
    same = (codes(U).reshape(-1, m, b) == codes(Y).reshape(-1, m, b)).all(2).any(1)
    assert same.mean() > 0.98


@pytest.mark.parametrize(("share", "clusters", "n"), [(0.8, 1, 5000), (0.8, 1, 3_000_000), (0.9, 1, 50_000), (0.5, 20, 100_000)])
def test_recall_off_centre(share, clusters, n):
    """Around strong common directions, too, pairs at the threshold meet but for the share that production allows."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(clusters, 64))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    G = rng.normal(size=(6000, 64))
    X = math.sqrt(share) * centres[rng.integers(clusters, size=6000)] + math.sqrt(1 - share) * G / np.linalg.norm(G, axis=1, keepdims=True)
    codes, b, m = vectors.fitted(X[:3000], n, 0.98, 1e-3)
    U = X[3000:] / np.linalg.norm(X[3000:], axis=1, keepdims=True)
    N = rng.normal(size=U.shape)
    N -= (N * U).sum(1, keepdims=True) * U
    Y = 0.98 * U + math.sqrt(1 - 0.98**2) * N / np.linalg.norm(N, axis=1, keepdims=True)
    same = (codes(U).reshape(-1, m, b) == codes(Y).reshape(-1, m, b)).all(2).any(1)
    assert same.mean() > 0.995


def test_near_vectors_off_centre(spark):
    rng = np.random.default_rng(4)
    X = rng.normal(size=(300, 16))
    X = np.eye(16)[0] * math.sqrt(0.97) + X / np.linalg.norm(X, axis=1, keepdims=True) * math.sqrt(0.03)
    X = X.astype(np.float32).astype(float)
    U = X / np.linalg.norm(X, axis=1, keepdims=True)
    links = (U @ U.T >= 0.98).sum(1) - 1
    df = spark.createDataFrame([(i, x, 1, "x", 1) for i, x in enumerate(X.tolist())], VECTORS)
    assert links.sum() > 100
    assert [r["n_links"] for r in vectors.near_vectors(df).orderBy("vec_id").collect()] == links.tolist()


def test_near_vectors_dense(spark):
    """A cluster in which most pairs are just about linked, copies, a bucket of several blocks, and very small and large numbers."""
    rng = np.random.default_rng(12)
    X = rng.normal(size=(1500, 24))
    X[:900] = X[0] + rng.normal(size=(900, 24)) * 0.13 * np.linalg.norm(X[0]) / math.sqrt(24)
    X[900:950] = X[5]
    X = X.astype(np.float32).astype(float)
    U = X / np.linalg.norm(X, axis=1, keepdims=True)
    links = (U @ U.T >= 0.98).sum(1) - 1
    X[10:20] *= 2.0**-600
    X[20:30] *= 2.0**700
    rows = [(i, x, 1, "x", 1) for i, x in enumerate(X.tolist())]
    df = spark.createDataFrame(rows, VECTORS.replace("float", "double"))
    got = [r["n_links"] for r in vectors.near_vectors(df).orderBy("vec_id").collect()]
    assert links.sum() > 100_000 and sum(got) >= 0.999 * links.sum() and all(a <= b for a, b in zip(got, links.tolist(), strict=True))


def best_scores(rows, k=20):
    """By brute force: of every query id the best scores of all its rows with all rows of other ids."""
    want = defaultdict(list)
    whole = [(i, np.array([math.floor(64 * float(x)) for x in v])) for i, v, *_ in rows]
    for q, a in whole:
        if q % 20 == 0:
            want[q] += [(-int(a @ b), i) for i, b in whole if i != q]
    return {q: [(n + 1, i, -s) for n, (s, i) in enumerate(sorted(x)[:k])] for q, x in want.items()}


def found_scores(df, **options):
    got = defaultdict(list)
    for r in search.top_k(df, **options).orderBy("query_id", "rank", "vec_id").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    return got


def test_top_k(spark):
    good = some_vectors()
    df = spark.createDataFrame(good + [r for r in odd_vectors() if r[0] not in (9003, 9005)], VECTORS)
    assert found_scores(df, sample=64) == best_scores(good)
    assert search.top_k(spark.createDataFrame([], VECTORS)).count() == 0
    assert search.top_k(spark.createDataFrame(good[1:3], VECTORS)).count() == 0
    assert found_scores(spark.createDataFrame(good[:3], VECTORS)) == best_scores(good[:3])
    assert not found_scores(spark.createDataFrame(good[:1] * 2, VECTORS))


def test_top_k_in_many_blocks(spark, monkeypatch):
    """Several blocks and passes; repeated ids with different and equal vectors; a third of the rows are one vector."""
    for name, value in (("QUERY_BLOCK", 12), ("ROW_BLOCK", 80), ("CHAIN", 2), ("FAN", 4), ("DEALT", 64)):
        monkeypatch.setattr(search, name, value)
    rng = np.random.default_rng(6)
    X = np.concatenate([rng.normal(size=(3, 8))[rng.integers(3, size=200)] + rng.normal(size=(200, 8)) * 0.2, rng.normal(size=(100, 8))])
    rows = [(i, X[i].tolist(), 0, "x", 1) for i in range(300)] + [(i, X[7].tolist(), 0, "x", 1) for i in range(300, 450)]
    rows += [(1, X[2].tolist(), 0, "x", 1), (1, X[1].tolist(), 0, "x", 1), (0, X[50].tolist(), 0, "x", 1), (40, X[40].tolist(), 0, "x", 1)]
    rows = [(i, [float(np.float32(x)) for x in v], *more) for i, v, *more in rows]
    assert found_scores(spark.createDataFrame(rows, VECTORS), sample=100) == best_scores(rows)


def test_cover_tree():
    """Separation, covering and nesting at every node; points stand in their leaves."""
    rng = np.random.default_rng(8)
    X = np.floor(64 * np.concatenate([rng.normal(size=(5, 6))[rng.integers(5, size=200)] + rng.normal(size=(200, 6)) * 0.1, np.ones((9, 6))]))
    tree = search.CoverTree.grown(np.arange(209), np.zeros(209), X)
    assert sorted(tree.ids) == list(range(209)) and (X[tree.ids] == tree.X).all()
    for n in range(len(tree.radius)):
        far = np.linalg.norm(tree.X[tree.start[n] : tree.stop[n]] - tree.centre[n], axis=1)
        assert far.max() == pytest.approx(tree.radius[n])
        kids = np.arange(tree.child[n], tree.child[n] + tree.children[n])
        if len(kids):
            assert (tree.centre[kids[0]] == tree.centre[n]).all() and (tree.radius[kids] <= tree.radius[n] / 2 + 1e-9).all()
            gap = np.linalg.norm(tree.centre[kids][:, None] - tree.centre[kids][None], axis=2)[np.triu_indices(len(kids), 1)]
            assert (gap > tree.radius[n] / 2 - 1e-9).all()
            assert (tree.start[kids[0]], tree.stop[kids[-1]]) == (tree.start[n], tree.stop[n])
        else:
            assert tree.radius[n] == 0


def labelled(spark, n=600):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(n):
        words = rng.choices(WORDS, k=rng.randint(20, 80))
        bad, toxic = i % 5 == 0, i % 4 == 0
        if bad:
            words = [w + "$$$" for w in words]
        if toxic:
            at = rng.randrange(len(words))
            words[at:at] = rng.choices(["vile", "scum", "trash"], k=5)
        rows.append((i, " ".join(words), None, None))
        if rng.random() < 0.5:  # labelled at random, as the class prior's estimate supposes
            labels.append((i, int(not bad), int(toxic)))
    rows += [(None, "no id", None, None), (n, None, None, None), (n + 1, "", None, None), (3, "twice", None, None)]
    labels += [(None, 1, 1), (1, None, None), (2, 1, 0), (2, 1, 0)]
    return table(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality(spark, empty):
    docs, labels = labelled(spark)
    got = quality.classify(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 600 and r["held_out"]]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in held)
    assert np.mean([(r["predicted"] == 1) == (r["doc_id"] % 5 != 0) for r in held]) > 0.97
    assert quality.classify(empty, labels).count() == 0
    assert {r["score"] for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}


def test_quality_risk():
    """The fit against plain gradient descent on the risk as the papers write it, and the prior of a known mixture."""
    rng = np.random.default_rng(3)
    P, U = rng.normal(1, 1, (400, 3)), np.concatenate([rng.normal(1, 1, (700, 3)), rng.normal(-1, 1, (500, 3))])
    Z = np.column_stack([np.concatenate([P, U]), np.ones(1600)])
    positive, prior, decay = np.arange(1600) < 400, 0.55, 1e-2
    w = quality.fit(lambda w: quality.risk_sums(Z, positive, w), 4, prior, decay=decay)

    def risk(w):
        fp, fu = Z[positive] @ w, Z[~positive] @ w
        negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        return prior * np.logaddexp(0, -fp).mean() + max(0, negative) + decay * (w[:3] ** 2).sum() / 2

    v = np.zeros(4)
    for _ in range(4000):
        v -= 0.3 * np.array([(risk(v + e) - risk(v - e)) / 2e-5 for e in np.eye(4) * 1e-5])
    assert np.allclose(w, v, atol=0.02) and risk(w) <= risk(v) + 1e-5
    assert (quality.Risk.of(quality.risk_sums(Z, positive, w), w, prior, decay)).value == pytest.approx(risk(w), abs=1e-6)
    at = np.round(2000 - 50 * np.concatenate([rng.normal(3, 1, 50000), rng.normal(3, 1, 30000), rng.normal(-3, 1, 20000)])).astype(int)
    counts = [np.bincount(x, minlength=4001) for x in (at[50000:], at[:50000])]
    assert 0.6 <= quality.class_prior(*counts) < 0.63


def test_quality_with_one_id_on_many_rows(spark):
    docs, labels = labelled(spark)
    many = docs.union(table(spark, [(3, f"alpha beta gamma delta {k % 50}", None, None) for k in range(10_000)]))
    got = quality.classify(many, labels)
    assert got.count() == many.count() and got.where("doc_id = 3").select("score").distinct().count() <= 52


def test_toxicity(spark, empty):
    docs, labels = labelled(spark)
    got = toxicity.classify(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 600 and r["held_out"]]
    assert np.mean([(r["predicted"] == 1) == (r["doc_id"] % 4 == 0) for r in held]) > 0.97
    assert any(r["passages"] for r in held if r["predicted"])
    assert toxicity.classify(empty, labels).count() == 0
    assert toxicity.classify(docs, labels.limit(0)).count() == docs.count()


def test_chance_with_many_toxic_words(spark):
    """However many words are toxic, E[exp(lambda * s)] = 1 over the clean tokens that were counted."""
    words = [f"bad{k}" for k in range(1300)]
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 3 != 1]
    rows, labels, clean = [], [], Counter()
    for k, i in enumerate(ids):
        toxic = k % 2
        here = [w for j, w in enumerate(words) if toxic or (j + k // 2) % 12 == 0] + [f"plain{j}" for j in range(3000)]
        rows.append((i, " ".join(here), None, None))
        labels.append((i, 1, toxic))
        clean.update([] if toxic else here)
    model = toxicity.train(table(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert set(words) <= {w.decode() for w in model.gains}
    mean = sum(n * math.exp(model.decay * model.gains.get(w.encode(), -model.drift)) for w, n in clean.items()) / clean.total()
    assert abs(mean - 1) < 0.1
    assert model.scale > 1e-3


def test_every_word_scores(spark):
    """Words in few toxic documents count, clean ones count against, and how texts meet the words changes nothing."""
    docs, labels = labelled(spark)
    ids = [i for i in range(5000, 5200) if zlib.crc32(str(i).encode()) % 3 != 1]
    rows = [(i, f"alpha beta gamma {'rareslur' if k < 3 else 'kind'} delta", None, None) for k, i in enumerate(ids)]
    docs = docs.union(table(spark, rows))
    labels = labels.union(spark.createDataFrame([(i, 1, int(k < 3)) for k, i in enumerate(ids)], labels.schema))
    model, joined = toxicity.train(docs, labels), toxicity.train(docs, labels, most=0)
    assert model.gains[b"rareslur"] > 0 > -model.drift > model.gains[b"kind"]
    assert joined.table is not None and not joined.gains and np.allclose(joined.curve, model.curve)
    a, b = (sorted(map(str, toxicity.judged(docs.select("doc_id", "text"), m).collect())) for m in (model, joined))
    assert a == b


def test_packed_gains(spark):
    """Packed tokens are found as in a dictionary, those of equal hashes too, and a task hands tokens on in small parts."""
    import pickle

    rows = [(f"w{i}".encode(), i / 7 - 20) for i in range(300)]
    packed = toxicity.Gains.of(spark.createDataFrame(rows, "token binary, net double").repartition(3))
    assert dict(packed) == dict(rows) and len(packed) == 300 and b"x" not in packed
    words = [b"w3", b"x", b"w299", b"w3"]
    assert pickle.loads(pickle.dumps(packed)).net(words, -9.0).tolist() == [dict(rows).get(w, -9.0) for w in words]
    same = toxicity.Gains(np.full(2, 5, np.uint64), np.array([1.0, 2.0]), np.array([1, 2], np.int32), np.frombuffer(b"abc", np.uint8))
    assert list(same) == [b"a", b"bc"]
    assert toxicity.Gains.of(spark.createDataFrame([], "token binary, net double")).net(words, -9.0).tolist() == [-9.0] * 4


def test_texts_meet_tokens_in_small_parts(spark, monkeypatch):
    """What a task makes of a batch of long texts is handed on in parts of bounded size."""
    frames, plain = [], toxicity.pd.DataFrame
    monkeypatch.setattr(toxicity, "HANDED", 100)
    split = {}

    class Texts:
        def mapInPandas(self, f, schema):  # noqa: N802
            split["f"] = f
            raise StopIteration

    class Docs:
        columns = ["text"]
        withColumn = select = lambda self, *a: self
        dropDuplicates = lambda self, keys: Texts()  # noqa: E731, N815

    with pytest.raises(StopIteration):
        toxicity.with_gains(Docs(), toxicity.Model(table=spark.range(0)))
    batch = plain({"_key": [b"k"] * 50, "text": [" ".join(f"t{i}x{j}" for j in range(40)) for i in range(50)]})
    frames = list(split["f"](iter([batch])))
    assert sum(map(len, frames)) == 2000 and max(map(len, frames)) <= 140


def test_segments_against_brute_force():
    """All maximal scoring segments, by their definition: split at the best segment, then left and right of it."""
    rng = random.Random(7)

    def brute(s, off=0):
        best = max(((sum(s[i : j + 1]), -(j - i), i, j) for i in range(len(s)) for j in range(i, len(s))), default=None)
        if best is None or best[0] <= 0:
            return []
        _, _, i, j = best
        return brute(s[:i], off) + [(off + i, off + j)] + brute(s[j + 1 :], off + j + 1)

    for _ in range(300):
        n = rng.randint(1, 25)
        gains = {k: rng.uniform(0.5, 3) for k in range(n) if rng.random() < 0.4}
        drift = rng.uniform(0.3, 1.5)
        s = [gains.get(k, -drift) for k in range(n)]
        got = toxicity.segments(sorted(gains), [gains[k] for k in sorted(gains)], drift)
        assert [(i, j) for _, i, j in got] == brute(s)
        assert all(abs(v - sum(s[i : j + 1])) < 1e-9 for v, i, j in got)


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(k, k + 1) for k in range(300, 340)]
    up = {i: i for i in range(400)}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in pairs:
        x, y = sorted((top(a), top(b)))
        up[y] = x
    got = common.components(spark.range(400).withColumnRenamed("id", "node"), spark.createDataFrame(pairs, "a long, b long"))
    assert {r["node"]: r["component"] for r in got.collect()} == {i: top(i) for i in range(400)}


def test_queries_of_the_pipeline(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_dedup", "mix", "pieces"]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    sf = "/root/testdata/sf0.001"
    seen = docs
    for _, stage in corpus_pipeline.STAGES[:3]:
        kept = common.written(stage(spark, seen, sf))
        assert kept.columns == docs.columns and not ids_of(kept) - ids_of(seen)
        seen = kept
    rows = {r["doc_id"]: r["text"] for r in seen.collect()}
    assert all(i == c for i, (_, c) in brute_components(rows.items(), 5, 80).items())
    mixed = common.written(corpus_pipeline.mix_stage(spark, seen, sf))
    assert mixed.columns == docs.columns
    assert corpus_pipeline.pieces_stage(spark, mixed, sf).count() == mixed.count()
