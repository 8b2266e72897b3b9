"""SentencePiece encoding and decoding that keeps every piece's place in the source text."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SPACE = "▁"


class CharacterMap:
    """The compiled character map of a model: a double-array trie over UTF-8 bytes, then the replacements.

    ``longest`` gives the replacement of the longest prefix that the map knows and how many bytes it takes; without
    one, the character itself.
    """

    def __init__(self, blob: bytes):
        self.units: tuple[int, ...] = ()
        if blob:
            (n,) = struct.unpack_from("<I", blob)
            self.units = struct.unpack_from(f"<{n // 4}I", blob, 4)
            self.texts = blob[4 + n :]

    def longest(self, data: bytes, at: int) -> tuple[bytes, int]:
        lead = data[at]
        found, taken = None, 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        if self.units:
            step = lambda u: (u >> 10) << ((u & 0x200) >> 6)
            node = step(self.units[0])
            for k in range(at, len(data)):
                node ^= data[k]
                if node >= len(self.units) or (unit := self.units[node]) & 0x800000FF != data[k]:
                    break
                node ^= step(unit)
                if unit & 0x100:
                    found, taken = self.units[node] & 0x7FFFFFFF, k + 1 - at
        return (data[at : at + taken] if found is None else self.texts[found : self.texts.index(b"\0", found)]), taken


class Normaliser:
    """Text to normalised UTF-8 bytes, and for each of them (and the end) the source byte where it comes from."""

    def __init__(self, spec):
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.dummy, self.squeeze = spec.add_dummy_prefix, spec.remove_extra_whitespaces
        self.space = SPACE.encode() if spec.escape_whitespaces else b" "

    def __call__(self, text: str) -> tuple[bytes, np.ndarray]:
        if self.map.units or self.squeeze:
            norm, source = self.by_prefix(text)
            return norm, np.array(source)
        # an empty map changes no character, so only spaces move what follows them
        data = text.encode()
        if not data:
            return b"", np.zeros(1, int)
        wide = len(self.space)
        source = np.arange(len(data) + 1)
        if wide > 1:
            source = np.repeat(source, np.where(np.frombuffer(data + b"\0", np.uint8) == 0x20, wide, 1))
        lead = self.space if self.dummy else b""
        return lead + data.replace(b" ", self.space), np.concatenate([np.zeros(len(lead), int), source])

    def by_prefix(self, text: str) -> tuple[bytes, list[int]]:
        data, at = text.encode(), 0
        out, source = bytearray(), []
        after_space = self.squeeze
        while at < len(data):
            new, taken = self.map.longest(data, at)
            if after_space:
                new = new.lstrip(b" ")
            if new:
                if not out and self.dummy:
                    out += self.space
                    source += [at] * len(self.space)
                shown = new.replace(b" ", self.space)
                out += shown
                source += [at] * len(shown)
                after_space = self.squeeze and new.endswith(b" ")
            elif not self.squeeze and not out and self.dummy:
                out += self.space
                source += [at] * len(self.space)
            at += taken
        end = len(data)
        while self.squeeze and out.endswith(self.space):
            end = source[len(out) - len(self.space)]
            del out[-len(self.space) :], source[-len(self.space) :]
        return bytes(out), [*source, end]


class Codec:
    """Encodes whole texts, places every piece in its source text, and decodes."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model.serialized_model_proto())
        kinds = [p.type for p in proto.pieces]
        self.normalise = Normaliser(proto.normalizer_spec)
        self.piece = [p.piece for p in proto.pieces]
        self.decimal = [str(i) for i in range(len(kinds))]
        # what an id gives back, and how many normalised bytes it stands for: one if it is a byte (kind 6)
        self.gives = [bytes([int(p[3:5], 16)]) if k == 6 else b"" if k == 3 else p.replace(SPACE, " ").encode() for p, k in zip(self.piece, kinds, strict=True)]
        self.takes = np.array([1 if k == 6 else len(p.encode()) for p, k in zip(self.piece, kinds, strict=True)])
        self.end, self.unknown, self.dummy = model.eos_id(), model.unk_id(), proto.normalizer_spec.add_dummy_prefix
        # the library's merges alone, for text that is normalised already
        spec = proto.normalizer_spec
        spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces = b"", False, False, False
        proto.trainer_spec.treat_whitespace_as_suffix = False
        self.merge = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())

    def encode(self, text: str) -> tuple[list[int], np.ndarray]:
        """The ids, without an end id, and the source bytes between which they stand: id k from bounds[k] to bounds[k + 1].

        The text is normalised, and the merges see normalised text only. Pieces follow each other in it; its alignment
        gives their places in the source. An id of the unknown piece takes what lies before the next known piece.
        """
        norm, source = self.normalise(text)
        ids = self.merge.encode(norm.decode())
        if self.unknown not in ids:
            ends = np.cumsum(self.takes[ids]) if ids else np.zeros(0, int)
        else:
            ends, at = [], 0
            for k, i in enumerate(ids):
                if i == self.unknown:
                    known = next((j for j in ids[k + 1 :] if j != self.unknown), None)
                    at = len(norm) if known is None else norm.index(self.piece[known].encode(), at + 1)
                else:
                    at += self.takes[i]
                ends.append(at)
        return ids, source[np.concatenate([[0], ends]).astype(int)] if ids else np.zeros(1, int)

    def decode(self, ids: list[int]) -> str:
        text = b"".join([self.gives[i] for i in ids]).decode(errors="replace")
        return text[1:] if self.dummy and text.startswith(" ") else text

    def spans(self, text: str) -> list[tuple[int, str, int, int]]:
        """(id, piece, first source byte, byte after the last) of all pieces."""
        ids, bounds = self.encode(text)
        return [(i, self.piece[i], int(a), int(b)) for i, a, b in zip(ids, bounds[:-1], bounds[1:], strict=True)]


SPANS = "array<struct<id:int,piece:string,start:int,end:int>>"


def encode(docs: DataFrame, path: str) -> DataFrame:
    """Adds ``pieces`` (id, piece, start, end: bytes of the source) to (doc_id, text), for every row and whole texts.

    Null and empty texts have no pieces. Rows that repeat stay; nothing is shuffled.
    """

    @F.pandas_udf(SPANS)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = Codec(path)
        for texts in batches:
            yield pd.Series([[dict(zip(("id", "piece", "start", "end"), s, strict=True)) for s in codec.spans(t)] for t in texts])

    return docs.select("doc_id", "text", run(F.coalesce("text", F.lit(""))).alias("pieces"))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and covered_bytes (the source byte where the last piece ends) of
    every row: whole texts encoded with an end id, then decoded.

    A null text is an empty one: the end id alone, decoded to nothing. Repeated rows stay; other columns are not read.
    """

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string, covered_bytes long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = Codec(path)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for texts in batches:
            rows = []
            for t in texts:
                ids, bounds = codec.encode(t)
                ids.append(codec.end)
                rows.append((len(ids), sha(" ".join([codec.decimal[i] for i in ids])), sha(codec.decode(ids)), int(bounds[-1])))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256", "covered_bytes"])

    return docs.select("doc_id", run(F.coalesce("text", F.lit(""))).alias("x")).select("doc_id", "x.*")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all documents; odd rows as ``digests`` says."""
    import public_tokenizers

    return digests(common.table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
