"""The public binary dosage format as a Spark data source: records are parsed in tasks, one input partition a range of variants."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .genotypes import DOSAGE_STEPS, MISSING_DOSAGE

#: Fixed values of the format: the first bytes, storage modes, variants of a block of the index, entries of a group of a
#: difference list, the mark of a missing dosage.
MAGIC = b"\x6c\x1b"
FIXED_CALLS, FIXED_DOSAGES, VARIABLE = 0x02, 0x03, 0x10
INDEXED, LISTED, NO_DOSAGE = 65536, 64, 65535
#: Parts of a record's type.
CALLS, MULTIALLELIC, PHASED, DOSAGES, PHASED_DOSAGES = 0x07, 0x08, 0x10, 0x60, 0x80
LIST, ALL, BITS = 0x20, 0x40, 0x60

SCHEMA = "variant_idx long, dosage array<float>"


class Broken(ValueError):
    """A file that is not what its header says."""


def opened(path: str):
    """A file by URI or absolute path, through the file system of its scheme."""
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    return system.open_input_file(at)


def exactly(f, at: int, n: int) -> bytes:
    f.seek(at)
    data = f.read(n)
    if len(data) != n:
        raise Broken(f"the file ends at byte {at + len(data)}, {n - len(data)} bytes too early")
    return data


def varint(data: bytes, at: int) -> tuple[int, int]:
    """A number in groups of seven bits, the lowest first, and where it ends."""
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def two_bits(data: bytes, n: int) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    return np.stack([raw >> s & 3 for s in (0, 2, 4, 6)], 1).ravel()[:n]


def one_bit(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[:n].astype(bool)


@dataclass
class Header:
    """What the first bytes say; ``blocks`` are where each index block's records start (variable records only)."""

    mode: int
    variants: int
    samples: int
    control: int
    blocks: list[int]
    size: int

    @classmethod
    def read(cls, f) -> Header:
        head = exactly(f, 0, 12)
        if head[:2] != MAGIC or head[2] not in (FIXED_CALLS, FIXED_DOSAGES, VARIABLE):
            raise Broken(f"not a dosage file, or of a kind that is not read: {head[:3].hex()}")
        variants, samples = (int.from_bytes(head[k : k + 4], "little") for k in (3, 7))
        out = cls(head[2], variants, samples, head[11], [], f.size())
        if out.mode == VARIABLE:
            if out.control & 15 > 7:
                raise Broken(f"record lengths of kind {out.control & 15} are not read")
            n = -(-variants // INDEXED)
            out.blocks = np.frombuffer(exactly(f, 12, 8 * n), "<u8").tolist()
            if any(b > out.size for b in out.blocks):
                raise Broken("the index points behind the end of the file")
        elif out.start + variants * out.width != out.size:
            raise Broken(f"{out.size} bytes; {variants} variants of {samples} samples take {out.start + variants * out.width}")
        return out

    @property
    def start(self) -> int:
        """Where records of one width start: behind the header and, if stored, a bit for each variant."""
        return 12 + (-(-self.variants // 8) if self.control >> 6 == 3 else 0)

    @property
    def width(self) -> int:
        return -(-self.samples // 4) + (2 * self.samples if self.mode == FIXED_DOSAGES else 0)

    def index(self, f, block: int) -> tuple[np.ndarray, np.ndarray]:
        """(types, places) of the records of an index block, and where the last one ends; only this block's index is read."""
        counts = [min(INDEXED, self.variants - b * INDEXED) for b in range(len(self.blocks))]
        wide, alleles, flagged = self.control & 15 >= 4, self.control >> 4 & 3, self.control >> 6 == 3
        length = (self.control & 3) + 1
        taken = [(n if wide else -(-n // 2)) + n * length + n * alleles + (-(-n // 8) if flagged else 0) for n in (INDEXED, counts[block])]
        at, n = 12 + 8 * len(self.blocks) + block * taken[0], counts[block]
        data = exactly(f, at, taken[1])
        raw = np.frombuffer(data, np.uint8)
        if wide:
            types, raw = raw[:n], raw[n:]
        else:
            half = -(-n // 2)
            types, raw = np.stack([raw[:half] & 15, raw[:half] >> 4], 1).ravel()[:n], raw[half:]
        lengths = raw[: n * length].reshape(n, length).astype(np.int64) @ (1 << 8 * np.arange(length, dtype=np.int64))
        places = self.blocks[block] + np.concatenate([[0], np.cumsum(lengths)])
        end = self.blocks[block + 1] if block + 1 < len(self.blocks) else self.size
        if places[-1] != end:
            raise Broken(f"records of block {block} end at byte {places[-1]}, not at {end}")
        return types, places


class Records:
    """Dosages of single variants of one open file."""

    def __init__(self, f, header: Header):
        self.f, self.header, self.n = f, header, header.samples
        self.id_bytes = (max(self.n, 1).bit_length() + 7) // 8
        self.block = -1
        self.base: np.ndarray | None = None  # calls of the last record that others may refer to
        self.base_at = -1

    def read(self, variant: int) -> np.ndarray:
        """A float for each sample, MISSING_DOSAGE where it has none: the stored dosage, else the call."""
        h = self.header
        if h.mode != VARIABLE:
            data = exactly(self.f, h.start + variant * h.width, h.width)
            calls = two_bits(data[: -(-self.n // 4)], self.n)
            return self.valued(calls, np.frombuffer(data[-(-self.n // 4) :], "<u2") if h.mode == FIXED_DOSAGES else None)
        if variant // INDEXED != self.block:
            self.block = variant // INDEXED
            self.types, self.places = h.index(self.f, self.block)
            self.base_at = -1
        k = variant % INDEXED
        data = exactly(self.f, int(self.places[k]), int(self.places[k + 1] - self.places[k]))
        try:
            return self.parsed(k, data)
        except (IndexError, ValueError) as e:
            raise e if isinstance(e, Broken) else Broken(f"variant {variant}: a record of {len(data)} bytes ends too early") from e

    def parsed(self, k: int, data: bytes) -> np.ndarray:
        kind = int(self.types[k])
        if kind & (MULTIALLELIC | PHASED_DOSAGES):
            raise Broken(f"records of type {kind:#x} (several alternative alleles or phased dosages) are not read")
        calls, at = self.calls(k, kind & CALLS, data)
        if kind & PHASED:
            at = self.behind_phases(calls, data, at)
        stored = kind & DOSAGES
        if stored == ALL:
            return self.valued(calls, np.frombuffer(data, "<u2", self.n, at))
        dosages = None
        if stored:
            if stored == BITS:
                who = np.flatnonzero(one_bit(data[at : at + -(-self.n // 8)], self.n))
                at += -(-self.n // 8)
            else:
                who, _, at = self.listed(data, at, False)
            dosages = np.full(self.n, NO_DOSAGE, np.uint16)
            dosages[who] = np.frombuffer(data, "<u2", len(who), at)
        return self.valued(calls, dosages)

    def valued(self, calls: np.ndarray, dosages: np.ndarray | None) -> np.ndarray:
        out = np.array([0, 1, 2, MISSING_DOSAGE], np.float32)[calls]
        return out if dosages is None else np.where(dosages != NO_DOSAGE, dosages.astype(np.float32) / np.float32(DOSAGE_STEPS), out)

    def calls(self, k: int, kind: int, data: bytes) -> tuple[np.ndarray, int]:
        """The calls (0, 1, 2 alternative alleles; 3: missing) of a record, and where they end."""
        n = self.n
        if kind == 0:
            calls, at = two_bits(data[: -(-n // 4)], n), -(-n // 4)
            if len(calls) != n:
                raise IndexError
        elif kind == 1:  # two common calls by a bit, others listed
            low, more = data[0] >> 2, data[0] & 3
            at = 1 + -(-n // 8)
            who, new, at = self.listed(data, at)
            calls = (low + one_bit(data[1 : 1 + -(-n // 8)], n) * more).astype(np.uint8)
            calls[who] = new
        elif kind in (2, 3):  # what differs from the last record of another kind; for 3, from it with alleles swapped
            who, new, at = self.listed(data, 0)
            calls = self.base_of(k).copy()
            calls[who] = new
            if kind == 3:
                calls = np.array([2, 1, 0, 3], np.uint8)[calls]
        elif kind in (4, 6, 7):  # one common call, others listed
            who, new, at = self.listed(data, 0)
            calls = np.full(n, kind - 4, np.uint8)
            calls[who] = new
        else:
            raise Broken(f"calls of kind {kind} are not read")
        if kind not in (2, 3):
            self.base, self.base_at = calls, k
        return calls, at

    def base_of(self, k: int) -> np.ndarray:
        """The calls of the last record before ``k`` that does not itself refer to another one."""
        at = k - 1
        while at >= 0 and int(self.types[at]) & CALLS in (2, 3):
            at -= 1
        if at < 0:
            raise Broken("a block starts with a record that refers to one before")
        if at != self.base_at:
            data = exactly(self.f, int(self.places[at]), int(self.places[at + 1] - self.places[at]))
            self.calls(at, int(self.types[at]) & CALLS, data)
        return self.base

    def listed(self, data: bytes, at: int, valued: bool = True) -> tuple[np.ndarray, np.ndarray, int]:
        """(samples, their calls, where it ends) of a difference list: its length; each group's first sample; groups' sizes;
        the calls, if it has them; then steps from sample to sample within groups."""
        length, at = varint(data, at)
        if not length:
            return np.zeros(0, int), np.zeros(0, np.uint8), at
        groups = -(-length // LISTED)
        firsts = np.frombuffer(data, np.uint8, groups * self.id_bytes, at).reshape(groups, -1).astype(np.int64) @ (1 << 8 * np.arange(self.id_bytes, dtype=np.int64))
        at += groups * (self.id_bytes + 1) - 1
        new = np.zeros(0, np.uint8)
        if valued:
            new = two_bits(data[at : at + -(-length // 4)], length)
            at += -(-length // 4)
        who = np.empty(length, np.int64)
        for g in range(groups):
            sample = int(firsts[g])
            for j in range(g * LISTED, min(length, (g + 1) * LISTED)):
                if j % LISTED:
                    step, at = varint(data, at)
                    sample += step
                who[j] = sample
        return who, new, at

    def behind_phases(self, calls: np.ndarray, data: bytes, at: int) -> int:
        """Phases do not matter for dosages: where they end."""
        half = 1 + int((calls == 1).sum()) // 8
        bits = one_bit(data[at : at + half], 8 * half)
        at += half
        return at + -(-(int(bits.sum()) - 1) // 8) if bits[0] else at


@dataclass
class Range(InputPartition):
    """Variants ``start`` to ``stop`` of a file, whose first variant has number ``first`` in the set."""

    path: str
    first: int
    start: int
    stop: int
    only: tuple[int, ...] | None = None


def files_of(path: str) -> list[str]:
    """A single file, or all of a folder's by name, which is the order of their variants."""
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    if system.get_file_info(at).type != fs.FileType.Directory:
        return [path]
    scheme = path.split("://")[0] + "://" if "://" in path else ""
    return sorted(scheme + i.path for i in system.get_file_info(fs.FileSelector(at)) if i.path.endswith(".pgen"))


class DosageReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.step = options["path"], int(options.get("variantsperpartition", 4096))
        self.samples = np.array(json.loads(options["samples"]), np.int64) if "samples" in options else None
        self.variants = sorted(set(json.loads(options["variants"]))) if "variants" in options else None

    def partitions(self) -> list[Range]:
        """Only headers are read here: 12 bytes a file and 8 for each 65,536 variants."""
        out, first = [], 0
        for path in files_of(self.path):
            with opened(path) as f:
                n = Header.read(f).variants
            for block in range(0, n, INDEXED):
                for start in range(block, min(block + INDEXED, n), self.step):
                    stop = min(start + self.step, block + INDEXED, n)
                    only = None if self.variants is None else tuple(v - first for v in self.variants if start <= v - first < stop)
                    if only is None or only:
                        out.append(Range(path, first, start, stop, only))
            first += n
        return out or [Range("", 0, 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("variant_idx", pa.int64()), ("dosage", pa.list_(pa.float32()))])
        if not part.path:
            return
        with opened(part.path) as f:
            records = Records(f, Header.read(f))
            if self.samples is not None and len(self.samples) and not 0 <= self.samples.min() <= self.samples.max() < records.n:
                raise Broken(f"{part.path} has {records.n} samples")
            wanted = range(part.start, part.stop) if part.only is None else part.only
            size = max(1, min(256, 4_000_000 // max(records.n, 1)))
            for k in range(0, len(wanted), size):
                some = wanted[k : k + size]
                rows = [records.read(v) for v in some]
                if self.samples is not None:
                    rows = [r[self.samples] for r in rows]
                flat = np.concatenate(rows) if rows else np.zeros(0, np.float32)
                ends = np.arange(len(rows) + 1, dtype=np.int32) * (len(rows[0]) if rows else 0)
                dosage = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.float32()))
                yield pa.RecordBatch.from_arrays([pa.array([part.first + v for v in some], pa.int64()), dosage], schema=schema)


class DosageSource(DataSource):
    """``spark.read.format("dosages").load(path)``: variant_idx, dosage (an array in sample order) of a binary dosage file, or
    of all .pgen files of a folder, whose variants follow each other by file name.

    Options: ``samples`` (a JSON list of sample numbers: only these, in this order), ``variants`` (a JSON list: only
    these), ``variantsPerPartition``. Records with several alternative alleles, phased dosages or a separate index are
    errors, as is a file that ends too early or whose index does not fit its size.
    """

    @classmethod
    def name(cls) -> str:
        return "dosages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DosageReader:
        return DosageReader(self.options)


def counts(path: str) -> tuple[int, int]:
    """(variants, samples) by the headers; files of a folder must agree on the samples."""
    variants, samples = 0, set()
    for one in files_of(path):
        with opened(one) as f:
            h = Header.read(f)
        variants += h.variants
        samples.add(h.samples)
    if len(samples) > 1:
        raise Broken(f"{path}: files of {sorted(samples)} samples")
    return variants, samples.pop() if samples else 0


def read_dosages(spark: SparkSession, path: str, samples: list[int] | None = None, variants: list[int] | None = None, step: int = 4096) -> DataFrame:
    """The packed form of a binary dosage file or folder; see ``DosageSource``."""
    spark.dataSource.register(DosageSource)
    reader = spark.read.format("dosages").option("variantsPerPartition", step)
    if samples is not None:
        reader = reader.option("samples", json.dumps(list(map(int, samples))))
    if variants is not None:
        reader = reader.option("variants", json.dumps(list(map(int, variants))))
    return reader.load(path)


def record(dosages: np.ndarray) -> tuple[int, bytes]:
    """(type, bytes) of a variant: calls by two bits each, then dosages that are not whole, as the shortest of the three
    forms, or nothing where all are whole."""
    d = np.asarray(dosages, np.float32)
    missing = np.isnan(d) | (d == MISSING_DOSAGE)
    steps = np.round(np.where(missing, 0, np.clip(d, 0, 2)) * DOSAGE_STEPS).astype(np.int64)
    near = np.round(steps / DOSAGE_STEPS).astype(np.int64)
    # a call is given where the dosage is within a tenth of it
    calls = np.where(missing | (np.abs(steps - near * DOSAGE_STEPS) > DOSAGE_STEPS // 10), 3, near).astype(np.uint8)
    padded = np.concatenate([calls, np.zeros(-len(calls) % 4, np.uint8)]).reshape(-1, 4)
    data = (padded << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8).tobytes()
    who = np.flatnonzero(~missing & (steps != near * DOSAGE_STEPS))
    if not len(who):
        return 0, data
    stored = steps[who].astype("<u2").tobytes()
    as_list = listing(who, len(d))
    if 2 * (len(d) - len(who)) <= min(-(-len(d) // 8), len(as_list)):
        return ALL, data + np.where(missing, NO_DOSAGE, steps).astype("<u2").tobytes()
    if len(as_list) < -(-len(d) // 8):
        return LIST, data + as_list + stored
    bits = np.zeros(len(d), bool)
    bits[who] = True
    return BITS, data + np.packbits(bits, bitorder="little").tobytes() + stored


def listing(who: np.ndarray, n: int) -> bytes:
    """A difference list without values."""

    def small(x: int) -> bytes:
        out = bytearray()
        while x > 127:
            out.append(x & 127 | 128)
            x >>= 7
        return bytes([*out, x])

    width = (max(n, 1).bit_length() + 7) // 8
    groups = [who[k : k + LISTED].tolist() for k in range(0, len(who), LISTED)]
    steps = [b"".join(small(b - a) for a, b in zip(g, g[1:], strict=False)) for g in groups]
    return small(len(who)) + b"".join(g[0].to_bytes(width, "little") for g in groups) + bytes(len(s) - (LISTED - 1) for s in steps[:-1]) + b"".join(steps)


def file_bytes(rows: list[np.ndarray], samples: int) -> bytes:
    """A whole file of variable records."""
    made = [record(r) for r in rows]
    blocks = [made[k : k + INDEXED] for k in range(0, len(made), INDEXED)]
    start = 12 + 8 * len(blocks) + 5 * len(made)
    places = np.cumsum([start] + [sum(len(d) for _, d in b) for b in blocks])[: len(blocks)]
    head = MAGIC + bytes([VARIABLE]) + len(made).to_bytes(4, "little") + samples.to_bytes(4, "little") + bytes([7 | 1 << 6])
    index = b"".join(bytes(t for t, _ in b) + b"".join(len(d).to_bytes(4, "little") for _, d in b) for b in blocks)
    return head + places.astype("<u8").tobytes() + index + b"".join(d for _, d in made)


def write_dosages(packed: DataFrame, folder: str, samples: int, per_file: int = 4096) -> None:
    """Writes packed dosages (variant_idx from 0 without gaps, dosage) as binary files of ``per_file`` variants each into
    ``folder``, from the tasks; a task that is run again writes the same file again."""
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder.removeprefix("file:"))
    system.create_dir(at)

    def write(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("variant_idx")["dosage"].to_list()
        system, at = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder.removeprefix("file:"))
        name = f"{at}/part-{key[0]:08d}"
        with system.open_output_stream(f"{name}.tmp") as f:
            f.write(file_bytes(rows, samples))
        system.move(f"{name}.tmp", f"{name}.pgen")
        return pd.DataFrame({"file": [key[0]]})

    parts = packed.select("variant_idx", "dosage").groupBy(F.floor(F.col("variant_idx") / per_file).cast("long").alias("file"))
    parts.applyInPandas(write, "file long").count()
