"""Block files assembled by hand from the format's description."""

import struct
import zlib

import pyarrow as pa
import pytest

from lamella.operators import resolve as R
from lamella.sources.blockfile import BadFile, entries_of, read_blockfiles
from lamella.sources.table import write_table


def assembled(rows, per_block=20, compress=False):
    out, index = bytearray(struct.pack(">IHI", 0x58444231, 6, 16384).ljust(32, b"\0")), b""
    for b in range(0, len(rows), per_block):
        block, restarts = b"", []
        for i, (k, v) in enumerate(rows[b : b + per_block]):
            if i % 16 == 0:
                restarts.append(len(block))
            block += struct.pack(">HI", len(k), 1 << 31 if v is None else len(v)) + k + (v or b"")
        block += b"".join(struct.pack(">I", r) for r in restarts) + struct.pack(">H", len(restarts))
        stored, flags = block, 0
        if compress:
            stored, flags = struct.pack("<I", len(block)) + pa.Codec("lz4_raw").compress(block).to_pybytes(), 1
        first = rows[b][0]
        index += struct.pack(">H", len(first)) + first + struct.pack(">QIHH", len(out), len(stored) + 8, len(restarts), flags)
        out += stored + struct.pack(">II", len(block), zlib.crc32(stored))
    bloom = len(out)
    out += bytes(1024)
    foot = struct.pack(">QIQIQ", bloom, 1024, len(out), len(index), len(rows))
    return bytes(out + index + foot + struct.pack(">II", zlib.crc32(foot), 0x454E4458))


ROWS = [(f"key:{i:06}".encode(), None if i % 7 == 3 else b"" if i % 5 == 0 else f"value-of-{i}".encode() * 4) for i in range(100)]


@pytest.mark.parametrize("compress", [False, True])
def test_entries(compress):
    assert list(entries_of(assembled(ROWS, compress=compress))) == ROWS
    assert list(entries_of(assembled([]))) == []


def test_damage_is_told():
    good = assembled(ROWS)
    for bad in (good[:-1], good[: len(good) // 2], b"\xab" * 4096, good[:42] + bytes([good[42] ^ 1]) + good[43:], good[:-30] + bytes([good[-30] ^ 1]) + good[-29:], good[:4] + b"\0\5" + good[6:], assembled(ROWS[::-1])):
        with pytest.raises(BadFile):
            list(entries_of(bad))


def test_import(spark, tmp_path):
    (tmp_path / "a.tbl").write_bytes(assembled(ROWS, compress=True))
    (tmp_path / "b.tbl").write_bytes(assembled([(b"key:000001", b"new"), (b"key:000002", None)]))
    log = read_blockfiles(spark, [f"{tmp_path}/a.tbl", f"{tmp_path}/b.tbl"], rows=33)
    t = write_table(spark, f"{tmp_path}/t", R.resolve(log, keep_tombstones=True))
    want = dict(ROWS) | {b"key:000001": b"new", b"key:000002": None}
    assert {k: v for k, v in t} == want and t.check() == 100
