"""Toxicity by maximum-scoring segments of token log-odds, calibrated as extreme values."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .learning import calibration, labelled, logistic, training_ids

#: Tokens are runs of ASCII letters and digits and of all bytes above ASCII, A-Z in small letters.
_TOKENS = bytes(c + 32 if 65 <= c <= 90 else c if chr(c).isalnum() and c < 128 or c >= 128 else 32 for c in range(256))


def tokens(text: str) -> list[bytes]:
    return text.encode().translate(_TOKENS).split()


def token_counts(docs: DataFrame) -> DataFrame:
    """(token, fold, toxic, clean, times): in how many toxic and clean documents of each fold of ``docs`` (text, label, fold)
    each token stands, and how often in clean ones.

    Log-odds come from documents, so that one document of a single repeated word weighs little; what chance puts into
    a scan comes from occurrences. Batches are summed before the shuffle.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from collections import Counter

        for pdf in batches:
            for fold, rows in pdf.groupby("fold"):
                by, times = (Counter(), Counter()), Counter()
                for text, label in zip(rows["text"], rows["label"], strict=True):
                    words = tokens(text)
                    by[label].update(set(words))
                    if not label:
                        times.update(words)
                words = by[0].keys() | by[1].keys()
                yield pd.DataFrame({"token": list(words), "fold": fold, "toxic": [by[1][w] for w in words], "clean": [by[0][w] for w in words], "times": [times[w] for w in words]})

    rows = docs.select(F.coalesce("text", F.lit("")).alias("text"), "label", "fold").where("label in (0, 1)")
    counts = rows.mapInPandas(count, "token binary, fold int, toxic long, clean long, times long")
    return counts.groupBy("token", "fold").agg(*(F.sum(c).alias(c) for c in ("toxic", "clean", "times")))


def log_odds(counts: DataFrame, prior: float = 0.05, shrink: float = 1.0) -> DataFrame:
    """(token, times, gain): every token's log-odds of being toxic, shrunk by ``shrink`` standard errors towards zero.

    Both classes get an informative Dirichlet prior: pseudo-tokens as many as ``prior`` of all tokens, dealt out as in
    all labelled documents. Gains stand on a grid of a thousandth. Tokens whose gain is zero are left out: they score
    as unknown ones do. No other token is, whatever its sign or frequency.
    """
    t, c = counts.agg(F.sum("toxic"), F.sum("clean")).first()
    if not t or not c:
        return counts.select("token", "times", F.lit(0.0).alias("gain")).limit(0)
    pseudo = prior * (t + c)
    share = F.lit(prior) * (F.col("toxic") + F.col("clean"))
    yt, yc = F.col("toxic") + share, F.col("clean") + share
    delta = F.log(yt / (t + pseudo - yt)) - F.log(yc / (c + pseudo - yc))
    gain = F.signum(delta) * F.greatest(F.abs(delta) - F.lit(shrink) * F.sqrt(1 / yt + 1 / yc), F.lit(0.0))
    return counts.select("token", "times", F.round(gain, 3).alias("gain")).where("gain <> 0")


def merged(before: list[float], after: list[float], places: list[int]) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, first, last place), in linear time.

    At ``places`` the running total rises from ``before`` to ``after``; in between it never does. Candidates are kept
    on a stack with the running totals before and after them; a new one is merged with those to its left that it
    extends to a higher total, found by following each candidate's link to the nearest one that starts lower.
    """
    stack: list[tuple[float, float, int, int, int]] = []  # total before, total after, first, last, link
    for left, total, place in zip(before, after, places, strict=True):
        first = place
        while True:
            link = len(stack) - 1
            while link >= 0 and stack[link][0] >= left:
                link = stack[link][4]
            if link < 0 or stack[link][1] >= total:
                stack.append((left, total, first, place, link))
                break
            left, first = stack[link][0], stack[link][2]
            del stack[link:]
    return [(b - a, i, j) for a, b, i, j, _ in stack]


def segments(places: list[int], gains: list[float], drift: float) -> list[tuple[float, int, int]]:
    """Maximal scoring segments of tokens at ``places`` that gain ``gains``; every other token costs ``drift``."""
    before, after, total, at = [], [], 0.0, -1
    for place, gain in zip(places, gains, strict=True):
        before.append(total - drift * (place - at - 1))
        total, at = before[-1] + gain, place
        after.append(total)
    return merged(before, after, places)


#: Words whose net a task remembers.
REMEMBERED = 120_000


class Gains(Mapping):
    """Tokens and what each adds, as four arrays in the order of the tokens' hashes: some 30 bytes a token, where a
    dictionary takes 150. A token is found by its hash and compared byte by byte."""

    def __init__(self, hashes: np.ndarray, nets: np.ndarray, sizes: np.ndarray, text: np.ndarray):
        order = np.argsort(hashes, kind="stable")
        ends = np.cumsum(sizes, dtype=np.int64)
        self.hashes, self.nets, self.ends, self.sizes = hashes[order], nets[order], ends[order], sizes[order]
        self.text, self.seen = text, {}

    @classmethod
    def of(cls, table: DataFrame) -> Gains:
        """The whole of ``table`` (token, net): tasks pack their tokens, the driver joins the packs."""

        def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            import xxhash

            for pdf in batches:
                words = list(map(bytes, pdf["token"]))
                hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)
                sizes = np.array([len(w) for w in words], np.int32)
                yield pd.DataFrame({"h": [hashes.tobytes()], "n": [pdf["net"].to_numpy(float).tobytes()], "s": [sizes.tobytes()], "t": [b"".join(words)]})

        packs = table.select("token", "net").mapInPandas(pack, "h binary, n binary, s binary, t binary").collect()
        joined = lambda c, kind: np.frombuffer(b"".join(bytes(r[c]) for r in packs), kind)
        return cls(joined("h", np.uint64), joined("n", float), joined("s", np.int32), joined("t", np.uint8))

    def __getstate__(self) -> dict:
        return self.__dict__ | {"seen": {}}

    def __len__(self) -> int:
        return len(self.hashes)

    def __iter__(self) -> Iterator[bytes]:
        return (self.text[end - size : end].tobytes() for end, size in zip(self.ends, self.sizes, strict=True))

    def __getitem__(self, word: bytes) -> float:
        if (net := self.get(word)) is None:
            raise KeyError(word)
        return net

    def get(self, word: bytes, otherwise: float | None = None) -> float | None:
        import xxhash

        h = xxhash.xxh3_64_intdigest(word)
        i = int(np.searchsorted(self.hashes, np.uint64(h)))
        while i < len(self.hashes) and int(self.hashes[i]) == h:
            if self.text[self.ends[i] - self.sizes[i] : self.ends[i]].tobytes() == word:
                return float(self.nets[i])
            i += 1
        return otherwise

    def net(self, words: list[bytes], otherwise: float) -> np.ndarray:
        """What each word adds, ``otherwise`` if it is unknown."""
        import xxhash

        try:
            return np.fromiter((self.seen[w] for w in words), float, len(words))
        except KeyError:
            if len(self.seen) > REMEMBERED:
                self.seen.clear()
            new = [w for w in set(words) if w not in self.seen]
            hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in new], np.uint64)
            known = np.zeros(len(new), bool)
            if len(self):
                known = self.hashes[np.minimum(np.searchsorted(self.hashes, hashes), len(self) - 1)] == hashes
            self.seen.update(dict.fromkeys(new, otherwise))
            for i in np.flatnonzero(known):
                self.seen[new[i]] = self.get(new[i], otherwise)
            return np.fromiter((self.seen[w] for w in words), float, len(words))


@dataclass
class Model:
    #: What each known token adds: its log-odds less the drift. Too many for one task: a table (token, net) instead.
    gains: Mapping[bytes, float] = field(default_factory=dict)
    table: DataFrame | None = None
    drift: float = 1.0
    decay: float = 1.0  # lambda of the extreme-value law
    scale: float = 0.1  # K of the extreme-value law
    level: float = 0.01  # expected chance segments per text below which a passage is significant
    curve: tuple[float, float] = (1.0, 0.0)

    def passages(self, text: str, gains: Mapping[bytes, float] | None = None) -> tuple[int, list[tuple[float, int, int]]]:
        """The number of tokens and the segments; unknown tokens cost the drift, as if their log-odds were zero."""
        words = tokens(text)
        known, cost = self.gains if gains is None else gains, -self.drift
        net = known.net(words, cost) if isinstance(known, Gains) else np.fromiter((known.get(w, cost) for w in words), float, len(words))
        up = np.flatnonzero(net > 0)
        if not len(up):
            return len(words), []
        total = np.cumsum(net)
        return len(words), merged((total[up] - net[up]).tolist(), total[up].tolist(), up.tolist())

    def expected(self, score: float, n: int) -> float:
        """How many segments of at least this score chance puts into a clean text of ``n`` tokens."""
        return self.scale * max(n, 1) * float(np.exp(-self.decay * score))

    def evidence(self, n: int, found: list[tuple[float, int, int]]) -> float:
        """Natural log of how unlikely chance makes the text's passages: the best one's, and the sum over significant ones."""
        logs = [self.decay * s - np.log(self.scale * max(n, 1)) for s, _, _ in found]
        if not logs:
            return 0.0
        kept = [x for x in logs if x > -np.log(self.level)]
        return float(max(max(logs), sum(kept), 0.0))

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return logistic(np.log1p(evidence) * self.curve[0] + self.curve[1])


def extreme_values(gains: np.ndarray, clean: np.ndarray, total: int, drift: float) -> tuple[float, float]:
    """(lambda, K): lambda > 0 solves E[exp(lambda * s)] = 1 over the tokens of clean texts; K is an upper bound of the
    Karlin-Altschul constant, the rate at which clean tokens open a segment in units of exp(-lambda * s), at most 1.

    ``clean`` of all ``total`` token occurrences in clean texts have the log-odds ``gains``, the others zero; each gain
    counts half an occurrence more.
    """
    if not len(gains):
        return 1.0, 0.1
    p = (clean + 0.5) / (total + 0.5 * len(gains))
    rest, s = max(1 - p.sum(), 0.0), gains - drift
    excess = lambda x: (p * np.exp(x * s)).sum() + rest * np.exp(-x * drift) - 1
    low, high = 1e-3, 1.0
    while excess(high) < 0 and high < 50:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if excess(mid) < 0 else (low, mid)
    return low, float(min(1.0, max(1e-4, (p * np.exp(low * s))[s > 0].sum())))


#: Scored tokens that every task holds at most, packed to some 60 MB; of more, those of a document are joined to it.
BROADCAST_TOKENS = 2_000_000
#: Of these, so many at most stand in a dictionary, which is larger and faster.
IN_DICTIONARY = 200_000
#: Tokens of texts that a task hands on at once.
HANDED = 50_000


#: The curve is fitted on evidence in steps of so much (of its logarithm).
STEP = 1e-3


#: Parts of the labelled texts; the evidence of each is found with the counts of all others.
FOLDS = 5
#: Chosen by the cross-fitted log loss of the rows that may be learned from, on sf0.1.
DRIFT, SHRINK = 0.25, 1.0


def counted(counts: DataFrame, drift: float, shrink: float, most: int) -> Model:
    """A model without a curve from counts (token, toxic, clean, times)."""
    counts = common.written(counts, "token-sums")
    scores = common.written(log_odds(counts, shrink=shrink), "token-scores")
    law = scores.groupBy("gain").agg(F.sum("times").alias("times"), F.count(F.lit(1)).alias("n")).toPandas()  # a row for each thousandth
    gains, times = law["gain"].to_numpy(float), law["times"].to_numpy(float)
    total = counts.agg(F.sum("times")).first()[0] or 0
    # the mean over clean tokens must be negative for segments to stay short
    model = Model(drift=max(drift, 2 * float(gains @ times) / max(total, 1)))
    net = scores.select("token", (F.col("gain") - model.drift).alias("net"))
    if law["n"].sum() <= most:
        packed = Gains.of(net)  # at most ``most``
        model.gains = packed if len(packed) > IN_DICTIONARY else dict(packed)
    else:
        model.table = net
    model.decay, model.scale = extreme_values(gains, times, total, model.drift)
    return model


def train(docs: DataFrame, labels: DataFrame, drift: float = DRIFT, shrink: float = SHRINK, most: int = BROADCAST_TOKENS) -> Model:
    """Counts tokens over all labelled documents that may be learned from, and fits the curve on cross-fitted evidence.

    A text's own words would count for it, so its evidence comes from a model whose counts its fold has no part in; equal
    texts share a fold. Evidence is counted by label in small steps: what comes to the driver does not grow with the
    documents. The last model counts all folds. ``most`` decides how texts meet the scored tokens, not which are scored.
    """
    known = labelled(docs, training_ids(docs, labels, "toxic"))
    known = known.withColumn("fold", F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(FOLDS)).cast("int"))
    counts = common.written(token_counts(known), "token-counts")
    sums = [F.sum(c).alias(c) for c in ("toxic", "clean", "times")]
    step = F.round(F.log1p("evidence") / STEP).cast("long").alias("step")

    def seen_by_others(fold: int) -> pd.DataFrame:  # their model is let go with the call
        others = counted(counts.where(F.col("fold") != fold).groupBy("token").agg(*sums), drift, shrink, most)
        own = evidence_rows(known.where(F.col("fold") == fold), others)
        return own.groupBy("label", step).agg(F.count(F.lit(1)).alias("n")).toPandas()

    seen = [seen_by_others(fold) for fold in range(FOLDS)]
    model, steps = counted(counts.groupBy("token").agg(*sums), drift, shrink, most), pd.concat(seen)
    model.curve = calibration(steps["step"].to_numpy(float) * STEP, steps["label"].to_numpy(float), steps["n"].to_numpy(float))
    return model


def with_gains(docs: DataFrame, model: Model) -> tuple[DataFrame, Model]:
    """Adds ``_words`` and ``_nets``, what the model knows of a text's tokens, null where every task holds the whole model;
    and the model without its table, for tasks.

    Each different text meets the table by its distinct tokens, so copies are joined once.
    """
    alone = replace(model, table=None)
    if model.table is None:
        return docs.withColumns({"_words": F.lit(None).cast("array<binary>"), "_nets": F.lit(None).cast("array<double>")}), alone

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keys, words = [], []
            for key, text in zip(pdf["_key"], pdf["text"], strict=True):
                own = set(tokens(text))
                keys += [key] * len(own)
                words += own
                if len(words) >= HANDED:
                    yield pd.DataFrame({"_key": keys, "token": words})
                    keys, words = [], []
            if words:
                yield pd.DataFrame({"_key": keys, "token": words})

    keyed = docs.withColumn("_key", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)))
    texts = keyed.select("_key", F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["_key"])
    met = texts.mapInPandas(split, "_key binary, token binary").join(model.table, "token")
    one = met.groupBy("_key").agg(F.collect_list(F.struct("token", "net")).alias("_met"))  # a text's own tokens
    one = common.written(one.select("_key", F.col("_met.token").alias("_words"), F.col("_met.net").alias("_nets")), "text-tokens")
    return keyed.join(one, "_key", "left").drop("_key").withColumns({c: F.coalesce(c, F.array().cast(t)) for c, t in (("_words", "array<binary>"), ("_nets", "array<double>"))}), alone


def found_in(model: Model, texts: pd.Series, words: pd.Series, nets: pd.Series) -> list[tuple[int, list[tuple[float, int, int]]]]:
    return [model.passages(t, None if w is None else dict(zip(map(bytes, w), n, strict=True))) for t, w, n in zip(texts, words, nets, strict=True)]


def evidence_rows(rows: DataFrame, model: Model) -> DataFrame:
    rows, alone = with_gains(rows, model)

    @F.pandas_udf("double")
    def evidence(texts: pd.Series, words: pd.Series, nets: pd.Series) -> pd.Series:
        return pd.Series([alone.evidence(*x) for x in found_in(alone, texts, words, nets)], dtype="float64")

    return rows.select("label", evidence(F.coalesce("text", F.lit("")), "_words", "_nets").alias("evidence"))


SCORED = "score double, passages array<struct<score:double,expected:double,first:int,last:int>>"


def judged(docs: DataFrame, model: Model) -> DataFrame:
    """Adds ``_toxic``: score and passages, every significant toxic one as first and last token.

    Each row's whole text is scanned once; nothing is shuffled if tasks hold all scored tokens.
    """
    columns = docs.columns
    docs, alone = with_gains(docs, model)

    @F.pandas_udf(SCORED)
    def score(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        m = alone
        for batch in batches:
            found = found_in(m, *batch)
            yield pd.DataFrame(
                {
                    "score": m.score(np.array([m.evidence(n, x) for n, x in found], float)),
                    "passages": [[{"score": s, "expected": e, "first": i, "last": j} for s, i, j in x if (e := m.expected(s, n)) <= m.level] for n, x in found],
                }
            )

    return docs.select(*columns, score(F.coalesce("text", F.lit("")), "_words", "_nets").alias("_toxic"))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted, passages for every row of ``docs`` (doc_id, text).

    A text without passages, null and empty ones too, has the curve's lowest score. Null ids are scored but never
    learned from; of repeated labels the largest counts, and a labelled document on several rows counts with each.
    Repeated rows stay, other columns are not read, an empty table gives an empty result; without labels no text has
    passages.
    """
    out = judged(docs.select("doc_id", "text"), train(docs, labels))
    score = F.col("_toxic.score")
    return out.select("doc_id", common.held_out(F.col("doc_id")).alias("held_out"), "_toxic.score", (score >= threshold).cast("int").alias("predicted"), "_toxic.passages")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents; odd rows as ``classify`` says."""
    return classify(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")).drop("passages")
