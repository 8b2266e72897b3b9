"""The binary dosage source: every kind of record it reads, subsets, folders, broken files."""

import numpy as np
import pytest

from loomstat.sources import binary

MISSING = binary.MISSING_DOSAGE


def two(calls):
    padded = np.concatenate([calls, np.zeros(-len(calls) % 4, np.uint8)]).astype(np.uint8).reshape(-1, 4)
    return (padded[:, 0] | padded[:, 1] << 2 | padded[:, 2] << 4 | padded[:, 3] << 6).astype(np.uint8).tobytes()


def one(bits):
    return np.packbits(np.asarray(bits, bool), bitorder="little").tobytes()


def difference(who, values, n):
    """A difference list with values, from the one without."""
    plain = binary.listing(np.asarray(who), n)
    if not len(who):
        return plain
    _, at = binary.varint(plain, 0)
    groups = -(-len(who) // 64)
    at += groups * ((n.bit_length() + 7) // 8 + 1) - 1
    return plain[:at] + two(np.asarray(values, np.uint8)) + plain[at:]


def file_of(records, n, control=7 | 1 << 6):
    made = [(k, d) for k, d in records]
    start = 12 + 8 + 5 * len(made)
    head = binary.MAGIC + bytes([binary.VARIABLE]) + len(made).to_bytes(4, "little") + n.to_bytes(4, "little") + bytes([control]) + start.to_bytes(8, "little")
    return head + bytes(k for k, _ in made) + b"".join(len(d).to_bytes(4, "little") for _, d in made) + b"".join(d for _, d in made)


def read(spark, path, **how):
    return {r["variant_idx"]: np.array(r["dosage"], float) for r in binary.read_dosages(spark, str(path), **how).collect()}


def test_every_kind_of_record(spark, tmp_path):
    rng = np.random.default_rng(3)
    n = 700
    records, want = [], []
    value = lambda calls: np.array([0, 1, 2, MISSING])[calls]

    def keep(kind, data, calls):
        records.append((kind, data))
        want.append(value(calls))

    base = rng.integers(0, 4, n)
    keep(0, two(base), base)
    who = np.sort(rng.choice(n, 150, replace=False))
    near = base.copy()
    near[who] = rng.integers(0, 4, 150)
    keep(2, difference(who, near[who], n), near)  # differs from the first
    swapped = np.array([2, 1, 0, 3])[near]
    keep(3, difference(who, near[who], n), swapped)  # the same, alleles swapped
    bits = rng.integers(0, 2, n).astype(bool)
    few = np.sort(rng.choice(n, 5, replace=False))
    calls = np.where(bits, 2, 0)
    calls[few] = 3
    keep(1, bytes([0 << 2 | 2]) + one(bits) + difference(few, [3] * 5, n), calls)
    for common in (0, 2, 3):
        calls = np.full(n, common)
        calls[few] = 1
        keep(4 + common, difference(few, [1] * 5, n), calls)
    keep(4, difference([], [], n), np.zeros(n, int))
    keep(2, difference([0, n - 1], [1, 2], n), np.r_[1, np.zeros(n - 2, int), 2])
    # dosages in their three forms, and behind phases
    steps = rng.integers(0, 32769, n)
    some = np.sort(rng.choice(n, 90, replace=False))
    dosed = value(base).astype(float)
    dosed[some] = steps[some] / 16384
    in_bits = np.zeros(n, bool)
    in_bits[some] = True
    listed = binary.listing(some, n) + steps[some].astype("<u2").tobytes()
    for kind, data in ((0x20, listed), (0x60, one(in_bits) + steps[some].astype("<u2").tobytes())):
        records.append((kind, two(base) + data))
        want.append(dosed)
    every = steps.copy()
    every[:7] = 65535
    records.append((0x40, two(base) + every.astype("<u2").tobytes()))
    want.append(np.where(every == 65535, value(base), every / 16384))
    het = int((base == 1).sum())
    records.append((0x30, two(base) + one(np.r_[False, np.ones(het, bool)]) + listed))
    want.append(dosed)
    present = np.r_[True, rng.integers(0, 2, het).astype(bool)]
    records.append((0x30, two(base) + one(present) + one(np.ones(int(present.sum()) - 1, bool)) + listed))
    want.append(dosed)
    path = tmp_path / "all.pgen"
    path.write_bytes(file_of(records, n))
    for step in (4096, 1, 2):  # a range may start at a record that refers to one before
        got = read(spark, path, step=step)
        assert sorted(got) == list(range(len(want)))
        for k, w in enumerate(want):
            np.testing.assert_allclose(got[k], w, atol=1e-6, err_msg=str(k))
    got = read(spark, path, samples=[5, 0, 699], variants=[2, 9])
    assert sorted(got) == [2, 9] and all(np.allclose(got[k], want[k][[5, 0, 699]]) for k in got)
    assert binary.counts(str(path)) == (len(want), n)


def test_fixed_width(spark, tmp_path):
    rng = np.random.default_rng(4)
    n, m = 13, 9
    calls, steps = rng.integers(0, 4, (m, n)), rng.integers(0, 32769, (m, n))
    steps[:, 3] = 65535
    head = lambda mode, control=0: binary.MAGIC + bytes([mode]) + m.to_bytes(4, "little") + n.to_bytes(4, "little") + bytes([control])
    value = np.array([0.0, 1, 2, MISSING])[calls]
    (tmp_path / "a.pgen").write_bytes(head(2, 3 << 6) + b"\0\0" + b"".join(two(c) for c in calls))
    (tmp_path / "b.pgen").write_bytes(head(3) + b"".join(two(c) + s.astype("<u2").tobytes() for c, s in zip(calls, steps, strict=True)))
    np.testing.assert_allclose(np.stack([v for _, v in sorted(read(spark, tmp_path / "a.pgen", step=4).items())]), value)
    np.testing.assert_allclose(np.stack([v for _, v in sorted(read(spark, tmp_path / "b.pgen").items())]), np.where(steps == 65535, value, steps / 16384), atol=1e-6)


def test_what_is_written_is_read(spark, tmp_path):
    rng = np.random.default_rng(5)
    n, rows = 300, []
    for v in range(23):
        d = rng.choice([0.0, 1.0, 2.0], n) if v % 3 else rng.integers(0, 32769, n) / 16384
        if v % 4 == 1:
            at = rng.choice(n, 4, replace=False)
            d[at] = rng.integers(0, 32769, 4) / 16384
        d[rng.choice(n, v, replace=False)] = MISSING
        rows.append((v, [float(x) for x in d]))
    packed = spark.createDataFrame(rows, "variant_idx long, dosage array<float>")
    binary.write_dosages(packed, str(tmp_path / "set"), n, per_file=5)
    got = read(spark, tmp_path / "set", step=3)
    assert sorted(got) == list(range(23))
    for v, d in rows:
        np.testing.assert_allclose(got[v], d, atol=1e-6)
    assert sorted(read(spark, tmp_path / "set", variants=[22, 4, 5])) == [4, 5, 22]
    assert sorted(read(spark, (tmp_path / "set").as_uri())) == list(range(23))
    kinds = {binary.record(np.array(d))[0] for _, d in rows}
    assert kinds == {0, binary.LIST, binary.ALL, binary.BITS} or kinds == {0, binary.LIST, binary.ALL}


def test_records_over_more_than_one_index_block(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(binary, "INDEXED", 4)
    rows = [np.array([v % 3, 0.5, MISSING, 2.0]) for v in range(11)]
    (tmp_path / "x.pgen").write_bytes(binary.file_bytes(rows, 4))
    with binary.opened(str(tmp_path / "x.pgen")) as f:
        h = binary.Header.read(f)
        records = binary.Records(f, h)
        assert len(h.blocks) == 3
        for v in (10, 3, 4, 0, 7):
            np.testing.assert_allclose(records.read(v), rows[v])


@pytest.mark.parametrize("harm", ["short", "magic", "index", "record", "alleles"])
def test_broken_files_are_errors(spark, tmp_path, harm):
    data = bytearray(binary.file_bytes([np.array([0.0, 0.3, 1.0, 2.0, 0.7, 0.1])] * 5, 6))
    if harm == "short":
        data = data[:-3]
    elif harm == "magic":
        data[0] = 0
    elif harm == "index":
        data[12] += 1
    elif harm == "record":
        data[20] = 0x60 if data[20] != 0x60 else 0x20
        data[21] = 0x05
    else:
        data[20] |= 8
    path = tmp_path / "bad.pgen"
    path.write_bytes(bytes(data))
    with pytest.raises(Exception, match="bytes|byte|dosage file|not read|ends"):
        read(spark, path)


def test_no_variants(spark, tmp_path):
    (tmp_path / "none.pgen").write_bytes(binary.file_bytes([], 6))
    assert read(spark, tmp_path / "none.pgen") == {}
    assert read(spark, tmp_path / "none.pgen", variants=[]) == {}
