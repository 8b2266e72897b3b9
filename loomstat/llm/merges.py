"""BPE encoding and decoding with an index of pair occurrences over many pre-tokens at once."""

from __future__ import annotations

import hashlib
import json
import unicodedata
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .tokens import library

#: Characters of texts whose pre-tokens are indexed together, about (a text is never cut), and pre-tokens remembered.
CHUNK, REMEMBERED = 4_000_000, 300_000
#: Longer pre-tokens are not remembered.
SHORT = 64
#: A pair's key: its left symbol, moved up by so many bits, and its right one.
SYMBOL = 24


class PairIndex:
    """Where each mergeable pair stands in a set of pre-tokens, by rank.

    All symbols of all pre-tokens stand in one array with links to the next and the one before in their pre-token.
    ``places[r]`` lists where the left symbol of a pair of rank r stands; ``active`` is a heap of the ranks that have
    places. Ranks are applied in ascending order, each at all its places from left to right; a merge makes at most two
    new pairs, whose ranks get its place. Should one of them rank below the rank at hand, the pre-token's further places
    wait until that one is applied, so every pre-token goes through the same merges as alone.
    """

    def __init__(self, ranks: dict[int, int], parts: list[tuple[int, int, int]], words: list[list[int]]):
        self.ranks, self.parts = ranks, parts
        self.symbols = [s for w in words for s in w]
        self.starts = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(int).tolist()
        n = len(self.symbols)
        self.next, self.before = list(range(1, n + 1)), list(range(-1, n - 1))
        for a, b in zip(self.starts, self.starts[1:], strict=False):
            if b > a:
                self.before[a] = self.next[b - 1] = -1
        # all pairs of neighbours at once, also those across two pre-tokens, which are left out below
        flat = np.array(self.symbols, np.int64)
        self.places: dict[int, list[int]] = {}
        places, follows = self.places, self.next
        for p, r in enumerate(map(ranks.get, ((flat[:-1] << SYMBOL) | flat[1:]).tolist())):
            if r is not None and follows[p] >= 0:
                if r in places:
                    places[r].append(p)
                else:
                    places[r] = [p]
        self.active = list(self.places)
        heapify(self.active)

    def apply(self, rank: int) -> None:
        left, right, whole = self.parts[rank]
        symbols, nexts, befores, places, get = self.symbols, self.next, self.before, self.places, self.ranks.get
        waiting: set[int] = set()
        at = places.pop(rank)
        at.sort()
        for p in at:
            q = nexts[p]
            if symbols[p] != left or q < 0 or symbols[q] != right:
                continue  # an earlier merge took one of them
            if waiting and bisect_right(self.starts, p) in waiting:
                self.listed(rank, p)
                continue
            after, prior = nexts[q], befores[p]
            symbols[p], symbols[q] = whole, -1
            nexts[p] = after
            if after >= 0:
                befores[after] = p
                new = get((whole << SYMBOL) | symbols[after])
                if new is not None:
                    self.listed(new, p)
                    if new < rank:
                        waiting.add(bisect_right(self.starts, p))
            if prior >= 0:
                new = get((symbols[prior] << SYMBOL) | whole)
                if new is not None:
                    self.listed(new, prior)
                    if new < rank:
                        waiting.add(bisect_right(self.starts, p))

    def listed(self, rank: int, p: int) -> None:
        at = self.places.get(rank)
        if at is None:
            self.places[rank] = [p]
            heappush(self.active, rank)
        else:
            at.append(p)

    def merged(self) -> list[list[int]]:
        """All pre-tokens' tokens, after every merge that can be made."""
        while self.active:
            self.apply(heappop(self.active))
        return [[s for s in self.symbols[a:b] if s >= 0] for a, b in zip(self.starts, self.starts[1:], strict=False)]


class Facts:
    """What is read from a vocabulary file and proved once on the driver; sent to tasks, bound by the vocabulary."""

    def __init__(self, path: str):
        import regex

        tok = library(path)
        spec = json.loads(tok.to_str())
        model = spec["model"]
        self.vocabulary: dict[str, int] = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.parts = [(self.vocabulary[a], self.vocabulary[b], self.vocabulary[a + b]) for a, b in pairs]
        self.ranks = {(a << SYMBOL) | b: r for r, (a, b, _) in reversed(list(enumerate(self.parts)))}
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.odd = bytearray(0x110000)
        for c in {*self.split_otherwise(tok, regex), *self.normalised_otherwise(tok)}:
            self.odd[ord(c)] = 1

    @staticmethod
    def split_otherwise(tok, regex) -> Iterator[str]:
        """Characters that the library's pattern classes otherwise than the same pattern here.

        Characters of one class here must be one piece after a plain one of it, numbers and white space must part
        others; where a run of them is not, halves of it are tried.
        """
        pieces = lambda text: [text[a:b] for _, (a, b) in tok.pre_tokenizer.pre_tokenize_str(text)]
        runs = (
            (r"\p{L}", lambda run: len(pieces("a" + run)) == 1),
            (r"[^\s\p{L}\p{N}]", lambda run: len(pieces("!" + run)) == 1),
            (r"\p{N}", lambda run: pieces("".join(f"a{c}!{c}" for c in run)) == [x for c in run for x in ("a", c, "!", c)]),
            (r"\s", lambda run: pieces("".join(f"!{c}a{c}" for c in run)) == ["!", "a"] * len(run)),
        )
        every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF)
        for kind, alike in runs:
            chars = "".join(regex.findall(kind, every))
            todo = [chars[k : k + 8192] for k in range(0, len(chars), 8192)]
            while todo:
                run = todo.pop()
                if alike(run):
                    continue
                if len(run) == 1:
                    yield run
                else:
                    todo += [run[: len(run) // 2], run[len(run) // 2 :]]

    @staticmethod
    def normalised_otherwise(tok) -> Iterator[str]:
        """Characters that the library may normalise otherwise than ``normalised``.

        Those that the Unicode data here don't know; those that come out otherwise when alone; and marks that the
        library does not order, because its data don't know them. Others have the same decomposition, class and case
        in both, for Unicode does not change these once a character is assigned.
        """
        every = [c for c in map(chr, range(0x110000)) if not 0xD800 <= ord(c) <= 0xDFFF and not c.isspace()]
        yield from (c for c in every if unicodedata.category(c) == "Cn")
        known = [c for c in every if unicodedata.category(c) != "Cn"]
        for k in range(0, len(known), 4096):
            some = known[k : k + 4096]
            got = tok.normalizer.normalize_str(" ".join(some)).split(" ")
            if len(got) != len(some):
                got = [tok.normalizer.normalize_str(c) for c in some]
            yield from (c for c, x in zip(some, got, strict=True) if x != normalised(c))
        marks = [c for c in known if unicodedata.combining(c)]
        yield from (c for c in marks if tok.normalizer.normalize_str(f"a\u0345{c}") != normalised(f"a\u0345{c}"))


def normalised(text: str) -> str:
    """Composed characters (NFC), each in small letters by itself: a sigma at a word's end has no form of its own."""
    return unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3").lower()


class Codec:
    """Encodes whole texts and decodes ids, as the library does with a vocabulary of words that end in a suffix."""

    def __init__(self, path: str, facts: Facts):
        import regex

        self.facts, self.tok = facts, library(path)
        self.find = regex.compile(facts.pattern).findall
        special = sorted(facts.special, key=len, reverse=True)
        self.apart = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        alphabet = self.alphabet()
        ids = facts.vocabulary
        self.inner = [ids[c] for c in alphabet]
        self.last = [ids[c + facts.suffix] for c in alphabet]
        self.token = {i: t for t, i in ids.items()} | {i: t for t, i in facts.special.items()}
        self.known: dict[str, list[int]] = {}

    @staticmethod
    def alphabet() -> list[str]:
        """The printable character that stands for each byte: itself where it is printable Latin, the others from 256 on."""
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = iter(range(256, 512))
        return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]

    def words(self, text: str) -> list[str]:
        """The pre-tokens of a text without special strings.

        White space parts pre-tokens and is in none, so it needs no normalising. A text with characters that may be
        normalised or split otherwise by the library is normalised and split by the library.
        """
        odd = self.facts.odd
        if any(odd[ord(c)] for c in set(text)):
            text = self.tok.normalizer.normalize_str(text)
            return [text[a:b] for _, (a, b) in self.tok.pre_tokenizer.pre_tokenize_str(text)]
        return self.find(text.lower() if text.isascii() else normalised(text))

    def split(self, text: str) -> list[str]:
        """Pre-tokens; special strings stand among them behind a null character; no pre-token is like that, as none mixes letters with others."""
        if self.apart is None or "<" not in text or not any(s in text for s in self.facts.special):
            return self.words(text)
        out: list[str] = []
        for k, part in enumerate(self.apart.split(text)):
            out += ["\0" + part] if k % 2 else self.words(part)
        return out

    def symbols(self, word: str) -> list[int]:
        data = word.encode()
        return [*map(self.inner.__getitem__, data[:-1]), self.last[data[-1]]]

    def encoded(self, texts: Iterable[str]) -> list[list[Word]]:
        """Each text as what its pre-tokens are; those not known yet are merged together, each once."""
        if len(self.known) > REMEMBERED:
            self.known = {}
        split = [self.split(t) for t in texts]
        known = self.known
        new = list({w for words in split for w in words}.difference(known))
        if new:
            special = self.facts.special
            index = PairIndex(self.facts.ranks, self.facts.parts, [[special[w[1:]]] if w[0] == "\0" and w[1:] in special else self.symbols(w) for w in new])
            known.update((w, Word(ids, self.token)) for w, ids in zip(new, index.merged(), strict=True))
        out = [list(map(known.__getitem__, words)) for words in split]
        for w in new:
            if len(w) > SHORT:
                del known[w]
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """Without a decoder in the file, tokens are joined by spaces as they are in the vocabulary."""
        return " ".join(map(self.token.__getitem__, ids))


class Word:
    """A pre-token's ids as little-endian 32-bit numbers, and what they decode to."""

    __slots__ = ("data", "text")

    def __init__(self, ids: list[int], token: dict[int, str]):
        self.data, self.text = np.array(ids, "<u4").tobytes(), " ".join(map(token.__getitem__, ids))


def joined(words: list[Word]) -> tuple[bytes, str]:
    """A text's ids and what they decode to."""
    return b"".join([w.data for w in words]), " ".join([w.text for w in words])


def chunks(texts: list[str], most: int = CHUNK) -> Iterator[list[str]]:
    """Whole texts in order, in parts of about ``most`` characters."""
    part, size = [], 0
    for t in texts:
        if part and size + len(t) > most:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def encode(docs: DataFrame, path: str) -> DataFrame:
    """Adds ``ids`` and ``decoded`` to (doc_id, text) of every row of ``docs``; rules as in ``digests``."""
    facts = docs.sparkSession.sparkContext.broadcast(Facts(path))

    @F.pandas_udf("ids array<int>, decoded string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = Codec(path, facts.value)
        for texts in batches:
            rows = [(np.frombuffer(data, "<u4").astype(np.int32), text) for part in chunks(texts.to_list()) for data, text in map(joined, codec.encoded(part))]
            yield pd.DataFrame(rows, columns=["ids", "decoded"])

    return docs.select("doc_id", "text", run(F.coalesce("text", F.lit(""))).alias("x")).select("doc_id", "text", "x.*")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of little-endian 32-bit ids), decoded_sha256 for every row of ``docs`` (doc_id, text).

    Whole texts are encoded and decoded as the library does, without added special tokens; special strings inside texts
    are one token each. Texts are split by the vocabulary's pattern here; one that holds a character which the library
    classes otherwise is split by the library. A null text is an empty one: no ids. Repeated rows stay, other columns
    are not read, an empty table gives an empty result; nothing is shuffled.
    """
    facts = docs.sparkSession.sparkContext.broadcast(Facts(path))

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = Codec(path, facts.value)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for texts in batches:
            rows = [(len(data) // 4, sha(data), sha(text.encode())) for part in chunks(texts.to_list()) for data, text in map(joined, codec.encoded(part))]
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", run(F.coalesce("text", F.lit(""))).alias("x")).select("doc_id", "x.*")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all documents; odd rows as ``digests`` says."""
    import public_tokenizers

    return digests(common.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
