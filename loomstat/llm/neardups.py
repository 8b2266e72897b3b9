"""MinHash near-duplicates by tensored banding: table keys are pairs of smaller hash collections; links are verified."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Ids that are broadcast at most; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000
#: Lists with up to the square of this many pairs are compared pair by pair, longer ones in blocks of BLOCK documents.
SHORT_LIST, BLOCK = 32, 256
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (two multiply-and-shift rounds)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """A text's set of word shingles, as sorted distinct 64-bit hashes.

    Words are runs of anything but ASCII white space, A-Z in small letters. Of fewer words than ``width`` the whole
    sequence is the one shingle; without words the set is empty.
    """

    def __init__(self, width: int):
        self.width, self.known = width, {}

    def word_hashes(self, words: list[bytes]) -> np.ndarray:
        import xxhash

        known = self.known
        try:
            return np.array([known[w] for w in words], np.uint64)
        except KeyError:
            if len(known) > 120_000:
                known.clear()
            for w in set(words):
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w)
            return np.array([known[w] for w in words], np.uint64)

    def __call__(self, text: str) -> np.ndarray:
        words = text.encode().translate(_LOWER).split()
        if not words:
            return np.zeros(0, np.uint64)
        h = self.word_hashes(words)
        width = min(self.width, len(h))
        last = len(h) - width + 1
        s = mixed(h[:last] + np.uint64(width))
        for k in range(1, width):
            s = mixed(s * _MULTIPLY + h[k : k + last])
        return np.unique(s)


def collections(threshold: float, rows: int, miss: float) -> int:
    """The least number of collections so that a pair at ``threshold`` shares fewer than two with probability ``miss`` at most."""
    q, m = threshold**rows, 2
    while (1 - q) ** m + m * q * (1 - q) ** (m - 1) > miss:
        m += 1
    return m


class Signer:
    """Codes of a set's hash collections: ``rows`` minhashes each."""

    def __init__(self, m: int, rows: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.m, self.rows = m, rows
        self.xor = rng.integers(0, 2**63, m * rows, dtype=np.uint64)[:, None]
        self.times = rng.integers(0, 2**63, m * rows, dtype=np.uint64)[:, None] * np.uint64(2) + np.uint64(1)

    def __call__(self, s: np.ndarray) -> np.ndarray:
        least = np.full(self.m * self.rows, np.iinfo(np.uint64).max, np.uint64)
        for k in range(0, len(s), 4096):  # long texts in slices
            np.minimum(least, ((s[k : k + 4096] ^ self.xor) * self.times).min(axis=1), out=least)
        codes = np.zeros(self.m, np.uint64)
        for part in least.reshape(self.m, self.rows).T:
            codes = mixed(codes * _MULTIPLY + part)
        return codes.view(np.int64)


def signatures(docs: DataFrame, width: int, m: int, rows: int) -> DataFrame:
    """(doc_id, n, f1, f2, codes): the size of each row's shingle set, 128 bits that stand for the set, its codes."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingle, signer = Shingler(width), Signer(m, rows)
        for pdf in batches:
            signed = []
            for t in pdf["text"]:  # one text's set at a time
                s = shingle(t)
                signed.append((len(s), *set_sums(s), signer(s) if len(s) else None))
            out = pd.DataFrame(signed, columns=["n", "f1", "f2", "codes"])
            out.insert(0, "doc_id", pdf["doc_id"].astype("Int64").array)
            yield out

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInPandas(sign, "doc_id long, n long, f1 long, f2 long, codes array<long>")


def set_sums(s: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set, as two longs."""
    return tuple(int(x.sum(dtype=np.uint64).view(np.int64)) for x in (s, mixed(s ^ _MULTIPLY)))


def shingle_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(node, shingles) of ``wanted`` (node, doc_id, n, f1, f2): of a document's texts only those whose set is the node's."""

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingle = Shingler(width)
        for pdf in batches:
            found = [shingle(t) for t in pdf["text"]]
            sums = pd.DataFrame([(len(s), *set_sums(s)) for s in found], columns=["n", "f1", "f2"])
            yield pd.concat([pdf[["doc_id"]], sums], axis=1).assign(shingles=[s.view(np.int64) for s in found])

    few = wanted.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    near = F.broadcast if few else lambda df: df
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    some = texts.join(near(wanted.select("doc_id").distinct()), "doc_id", "left_semi")
    all_ = some.mapInPandas(sets, "doc_id long, n long, f1 long, f2 long, shingles array<long>")
    return all_.join(near(wanted), ["doc_id", "n", "f1", "f2"]).select("node", "shingles")


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose full sets have 100 * intersection >= percent * union."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("_sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("_sb"))
    both = F.size(F.array_intersect("_sa", "_sb"))
    rows = pairs.join(left, "a").join(right, "b").select("a", "b", both.alias("i"), (F.size("_sa") + F.size("_sb") - both).alias("u"))
    return rows.where(F.col("i") * 100 >= F.col("u") * percent).select("a", "b").distinct()


def tables(nodes: DataFrame, m: int) -> DataFrame:
    """(key, node, n): a row for every pair of collections, keyed by both codes. A pair of rows meets in a bucket if
    any two of its collections agree: m minhash collections do the work of m * (m - 1) / 2 separate ones."""
    keys = F.array(*(F.xxhash64(F.lit(i * 64 + j), F.col("codes")[i], F.col("codes")[j]) for i, j in combinations(range(m), 2)))
    return nodes.select("node", "n", F.explode(keys).alias("key"))


def rare_shingles(sets: DataFrame, percent: int) -> DataFrame:
    """(key, node, n, index): the prefix of every set, its shingles from rare to common, without those that no other set has.

    Linked sets have at least t of the larger in common, and 2t / (1 + t) of the smaller, since the larger is no
    smaller. So the first n - ceil(t * n) + 1 shingles of the larger and the first n - ceil(2t / (1 + t) * n) + 1 of the
    smaller share one; ``index`` marks the latter. Sets that differ in more than their like could, but have a passage in
    common, don't bring it into their index part.
    """
    each = common.written(sets.select("node", F.size("shingles").alias("n"), F.explode("shingles").alias("key")), "shingle-rows")
    counts = common.written(each.groupBy("key").agg(F.count(F.lit(1)).alias("df")), "shingle-counts")
    rank = F.row_number().over(Window.partitionBy("node").orderBy("df", "key"))  # one document's shingles
    upto = lambda x, y: F.col("n") - F.expr(f"(n * {x}L + {y - 1}L) div {y}L") + 1
    ranked = each.join(counts, "key").withColumn("_rank", rank)
    kept = ranked.where((F.col("_rank") <= upto(percent, 100)) & (F.col("df") > 1))
    return kept.select("key", "node", "n", (F.col("_rank") <= upto(2 * percent, 100 + percent)).alias("index"))


def sided(prefixes: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """(key, band, node, n, component, index, few, many): lists whose index rows meet all rows of ``few`` x ``many``.

    A list is cut into bands of sizes, each 1 / t of the one before: a row of the list stands in the band of its own
    size; as an index row it also stands in every band in which a set no smaller may be linked with it. Lists without
    rows of both sides, or within one component, are left out.
    """
    at = F.log("n") / F.lit(-math.log(percent / 100)) if percent < 100 else F.col("n").cast("double")
    band = lambda x: F.floor(at + x).cast("int")
    own = prefixes.select("key", "node", "n", F.lit(False).alias("index"), band(0.0).alias("band"))
    reach = F.explode(F.sequence(band(-1e-9), band(1 + 1e-9)))
    rows = own.unionByName(prefixes.where("index").select("key", "node", "n", "index", reach.alias("band")))
    placed = common.written(rows.join(labels, "node"), "minhash-sided")
    sizes = placed.groupBy("key", "band").agg(
        F.min("component").alias("x"), F.max("component").alias("y"), F.count_if("index").alias("few"), F.count_if(~F.col("index")).alias("many")
    )
    spanning = common.written(sizes.where("x < y and few > 0 and many > 0").drop("x", "y"), "minhash-spanning")
    return placed.join(spanning, ["key", "band"])


def similar(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of the sets are linked, as a square of booleans: intersections are products of rows of zeros and ones."""
    sizes = np.array([len(s) for s in sets])
    values, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    shared = times > 1
    place = np.cumsum(shared) - 1
    row, column = row[shared[column]], place[column[shared[column]]]
    common_ = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for k in range(0, int(shared.sum()), 8192):
        i, j = np.searchsorted(column, [k, k + 8192])
        has = np.zeros((len(sets), 8192), np.float32)
        has[row[i:j], column[i:j] - k] = 1
        common_ += has @ has.T
    both = common_.astype(np.int64)
    np.fill_diagonal(both, 0)
    return both * 100 >= (sizes[:, None] + sizes[None, :] - both) * percent


def block_links(lists: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join what is linked within each pair of blocks of ``sided`` lists, one block of each side: a row
    for each node and pair at most."""

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("node").sort_values("node", ignore_index=True)
        same = similar(list(pdf["shingles"]), percent)
        label = np.arange(len(pdf))
        while True:
            near = np.minimum(label, np.where(same, label[None, :], len(pdf)).min(axis=1))
            near = near[near]
            if (near == label).all():
                break
            label = near
        out = pd.DataFrame({"a": pdf["node"].to_numpy()[label], "b": pdf["node"]})
        return out[out["a"] != out["b"]]

    few, many = (F.ceil(F.col(c) / BLOCK).cast("int") for c in ("few", "many"))
    own = lambda n: F.pmod(F.xxhash64("node", "key"), n).cast("int")
    place = lambda i, j: F.struct(i.alias("i"), j.alias("j"))
    across = F.transform(F.sequence(F.lit(0), many - 1), lambda j: place(own(few), j))
    down = F.transform(F.sequence(F.lit(0), few - 1), lambda i: place(i, own(many)))
    rows = lists.select("key", "band", "node", F.explode(F.when(F.col("index"), across).otherwise(down)).alias("p"))
    dealt = rows.join(sets, "node").groupBy("key", "band", "p.i", "p.j")
    return dealt.applyInPandas(compare, "a long, b long").distinct()


def one_document(able: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links (a, b) from the smallest node of every doc_id with several sets to its others."""
    of = F.struct("n", "f1", "f2")
    several = able.groupBy("doc_id").agg(F.min(of).alias("_x"), F.max(of).alias("_y")).where("_x <> _y").select("doc_id")
    several = common.written(several, "minhash-several")
    texts = able.join(several, "doc_id", "left_semi").select("doc_id", "n", "f1", "f2").distinct()
    held = common.written(texts.join(nodes.select("node", "n", "f1", "f2"), ["n", "f1", "f2"]).select("doc_id", "node"), "minhash-held")
    first = held.groupBy("doc_id").agg(F.min("node").alias("a"))
    return held.join(first, "doc_id").where("node > a").select("a", F.col("node").alias("b")).distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, rows: int = 3, miss: float = 1e-3) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text).

    Documents are linked if their shingle sets have 100 * intersection >= ``percent`` * union; a component is what
    links reach, named by its smallest doc_id, which is kept. A pair exactly at the threshold fails to meet in any
    table with probability ``miss``.

    1. One pass shingles whole texts and signs them. Equal sets, found by size and 128 bits, become one node with a
       number of its own. Different sets under one doc_id are nodes that are linked, as they are one document.
    2. Every bucket with several nodes links each of them to its smallest, checked on the full sets.
    3. Documents of buckets that still span components are joined exactly, by prefixes: with shingles ordered from
       rare to common among them, two sets that similar share one of the first n - ceil(t * n) + 1 of the larger and
       n - ceil(2t / (1 + t) * n) + 1 of the smaller. A list of documents with such a shingle is cut by size and
       compared only where it spans components: few pairs one by one, more in pairs of blocks, of which tasks return no
       more than a row for each document. So no link between nodes that meet is lost, and nothing that is written
       grows with the square of a group.

    Null and empty texts have an empty set and no links. A null doc_id is linked with nothing and kept, its
    component_id is null. Rows that share a doc_id are one document: what any of its
    texts is linked with, all of them are; n_shingles is the row's own. Other columns are not read.
    """
    m = collections(percent / 100, rows, miss)
    signed = common.written(signatures(docs, width, m, rows), "minhash-rows")
    able = signed.where("n > 0 and doc_id is not null")
    each = able.groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("doc_id"), F.min("codes").alias("codes"))
    nodes = common.written(each.withColumn("node", F.monotonically_increasing_id()), "minhash-nodes")
    same = common.written(one_document(able, nodes), "minhash-same")
    keyed = tables(nodes, m)
    shared = keyed.groupBy("key").agg(F.min("node").alias("first"), F.max("node").alias("last")).where("first < last").select("key", "first")
    members = common.written(keyed.join(shared, "key"), "minhash-buckets")
    ids = common.written(members.select("node").distinct(), "minhash-candidates")
    wanted = common.written(nodes.drop("codes").join(ids, "node", "left_semi"), "minhash-wanted")
    sets = common.written(shingle_sets(docs, wanted, width), "minhash-sets")
    if sets.count() > ids.count():  # rows that are repeated
        sets = common.written(sets.dropDuplicates(["node"]), "minhash-sets")
    sizes = members.select("node", "n").distinct()

    def possible(pairs: DataFrame) -> DataFrame:
        fits = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent
        return pairs.where("a < b").where(fits).select("a", "b").distinct()

    first = members.where("node > first").select(F.col("first").alias("a"), F.col("node").alias("b"), F.col("n").alias("nb"))
    tried = common.written(possible(first.distinct().join(sizes.select(F.col("node").alias("a"), F.col("n").alias("na")), "a")), "minhash-pairs")
    links = common.written(linked(tried, sets, percent), "minhash-links")
    links = links.unionByName(same)
    labels = common.written(common.components(ids, links), "minhash-components")
    # written, so that the joins with them can split a key that many rows hold
    spanning = members.join(labels, "node").groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y")
    spanning = common.written(spanning.select("key"), "minhash-spanning")
    rest = common.written(members.join(spanning, "key").select("node").distinct(), "minhash-rest")
    lists = common.written(rare_shingles(sets.join(rest, "node", "left_semi"), percent), "minhash-prefixes")
    parts = common.written(sided(lists, labels, percent), "minhash-lists")
    short = F.col("few") * F.col("many") <= SHORT_LIST**2
    sides = parts.where(short).select("key", "band", "index", "node", "n", "component")
    one, other = (sides.where(F.col("index") == (x == "a")).select("key", "band", *(F.col(c).alias(d + x) for c, d in (("node", ""), ("n", "n"), ("component", "c")))) for x in "ab")
    met = one.join(other, ["key", "band"]).where("na <= nb and ca <> cb")
    met = met.select(*(F.when(F.col("a") < F.col("b"), F.col(x)).otherwise(F.col(y)).alias(x) for x, y in (("a", "b"), ("b", "a"), ("na", "nb"), ("nb", "na"))))
    new = possible(met).join(tried, ["a", "b"], "left_anti")
    found = common.written(linked(common.written(new, "minhash-pairs"), sets, percent), "minhash-links")
    within = common.written(block_links(parts.where(~short), sets, percent), "minhash-links")
    linked_ = ids.unionByName(same.select(F.explode(F.array("a", "b")).alias("node"))).distinct()
    labels = common.components(linked_, links.unionByName(found).unionByName(within))
    placed = common.written(nodes.drop("codes").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node")), "minhash-placed")
    names = placed.groupBy("component").agg(F.min("doc_id").alias("_component"))
    of_node = placed.join(names, "component").select("n", "f1", "f2", "_component")
    out = signed.join(of_node, ["n", "f1", "f2"], "left")
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.col("_component")).otherwise(F.col("doc_id")).alias("component_id"),
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents; odd rows as ``near_duplicates`` says."""
    return near_duplicates(common.table(spark, sf_dir, "documents"), width=3, percent=85)
