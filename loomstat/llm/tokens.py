"""Token counts with a whole-token shortcut."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Pre-tokens kept with their counts in a worker; when full, the memory starts anew.
REMEMBERED = 500_000


def library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def merger(path: str):
    """The library's merges alone: what it is given is one pre-token and is not split again."""
    from tokenizers import Tokenizer, pre_tokenizers

    spec = json.loads(library(path).to_str()) | {"added_tokens": [], "post_processor": None}
    merge = Tokenizer.from_str(json.dumps(spec))
    merge.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    return merge


def splitter():
    """The pre-tokens of a byte-level vocabulary, as its public pattern has them."""
    import public_tokenizers
    import regex

    return regex.compile(public_tokenizers.PATTERN)


def odd_characters(path: str) -> frozenset[str]:
    """Characters that the pattern here and the library's own pattern class differently, by trying all of them.

    Characters of one class here, after a plain one of it, are one pre-token for the library if it agrees on all of
    them; where it does not, halves are tried.
    """
    import regex

    split = library(path).pre_tokenizer.pre_tokenize_str

    def differ(first: str, chars: str) -> str:
        if len(split(first + chars)) == 1:
            return ""
        half = len(chars) // 2
        return chars if not half else differ(first, chars[:half]) + differ(first, chars[half:])

    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF)
    odd = []
    for first, kind in (("a", r"\p{L}"), ("1", r"\p{N}"), (" ", r"\s"), ("!", r"[^\s\p{L}\p{N}]")):
        chars = "".join(regex.findall(kind, every))
        odd += [differ(first, chars[k : k + 4096]) for k in range(0, len(chars), 4096)]
    return frozenset("".join(odd))


def whole_tokens(path: str) -> frozenset[str]:
    """The strings of the vocabulary that are proved to encode as one token.

    Each is decoded, must be valid text and one pre-token by itself, and is put through the merges: it stays only if
    they leave exactly one token. (A vocabulary string may not: merges in rank order can miss it.)
    """
    tok, merge, pattern = library(path), merger(path), splitter()
    texts = {t for i in range(tok.get_vocab_size()) if (t := tok.decode([i], skip_special_tokens=False)) and "�" not in t}
    special = {a.content for a in tok.get_added_tokens_decoder().values()}
    alone = sorted(t for t in texts - special if pattern.findall(t) == [t])
    return frozenset(t for t, e in zip(alone, merge.encode_batch(alone, add_special_tokens=False), strict=True) if len(e.ids) == 1)


class Counter:
    """Counts a text's tokens: proved pre-tokens count one each, the others are merged, once per distinct pre-token."""

    def __init__(self, path: str, proved: frozenset[str], odd: frozenset[str]):
        import regex

        self.tok, self.merge, self.split = library(path), merger(path), splitter()
        self.proved = proved
        self.special = [a.content for a in self.tok.get_added_tokens_decoder().values()]
        self.apart = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.odd = odd
        self.known: dict[str, int] = {}
        self.forget()

    def forget(self) -> None:
        self.known = dict.fromkeys(self.proved, 1)

    def texts(self, texts: list[str]) -> list[int]:
        return [self.one(t) for t in texts]

    def one(self, text: str) -> int:
        if not text.isascii() and not self.odd.isdisjoint(text):
            return len(self.tok.encode(text, add_special_tokens=False).ids)
        parts, more = [text], 0
        if self.apart and any(s in text for s in self.special):
            parts = self.apart.split(text)
            more = len(parts) - 1
        total, known = more, self.known
        for part in parts:
            pieces = self.split.findall(part)
            try:
                total += sum(map(known.__getitem__, pieces))
            except KeyError:
                new = [p for p in dict.fromkeys(pieces) if p not in known]
                lengths = {p: len(e.ids) for p, e in zip(new, self.merge.encode_batch(new, add_special_tokens=False), strict=True)}
                total += sum(known[p] if p in known else lengths[p] for p in pieces)
                if len(known) + len(new) > len(self.proved) + REMEMBERED:
                    self.forget()
                    known = self.known
                known.update((p, n) for p, n in lengths.items() if len(p) <= 64)
        return total


def token_counts(spark: SparkSession, path: str):
    """A column function: the number of tokens of a text column (null: empty), for a byte-level vocabulary at ``path``.

    What is proved offline is sent once; its size is bound by the vocabulary's.
    """
    facts = spark.sparkContext.broadcast((whole_tokens(path), odd_characters(path)))

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        counter = Counter(path, *facts.value)
        for texts in batches:
            yield pd.Series(counter.texts(texts.to_list()), dtype="int64")

    return lambda text: count(F.coalesce(text, F.lit("")))


def count_tokens(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs``; whole texts, null ones empty, no shuffle.

    Counts equal the library's without added begin or end tokens; special strings inside texts are one token each.
    Repeated rows stay, other columns are not read, an empty table gives an empty result.
    """
    text: Column = F.coalesce("text", F.lit(""))
    return docs.select(
        "doc_id", F.octet_length(text).cast("long").alias("n_bytes"), token_counts(docs.sparkSession, path)(text).alias("n_tokens")
    ).withColumn("over_limit", F.col("n_tokens") > limit)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents; odd rows as ``count_tokens`` says."""
    import public_tokenizers

    return count_tokens(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
