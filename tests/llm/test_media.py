import hashlib
import os
import struct
import zlib

import numpy as np
import pytest

from lodestar.llm import progressive_jpeg as J


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 384, 385, 5000, 70_000])
def test_payload_round_trip(n):
    payload = J.padded(os.urandom(n))
    assert len(payload) % 64 == 0 and len(payload) >= 64
    *_, comps, _, comment = J.read_coefficients(J.encode_payload(payload))
    assert J.read_payload(comps, comment) == payload


def test_array_and_bit_readers_agree(monkeypatch):
    media = J.encode_payload(J.padded(os.urandom(3000)))
    fast = J.read_coefficients(media)[2]
    monkeypatch.setattr(J, "_fixed_scan", lambda *a: None)
    slow = J.read_coefficients(media)[2]
    assert all((a.coef == b.coef).all() for a, b in zip(fast, slow))


class Bits:
    """Test encoder: every symbol has a code of eight bits."""

    def __init__(self, symbols):
        self.symbols, self.out = symbols, []

    def put(self, value, n):
        self.out += [(value >> (n - 1 - i)) & 1 for i in range(n)]

    def symbol(self, s):
        self.put(self.symbols.index(s), 8)

    def data(self):
        bits = self.out + [1] * (-len(self.out) % 8)
        return np.packbits(np.array(bits, np.uint8)).tobytes().replace(b"\xff", b"\xff\x00")


def size_of(v):
    return abs(v).bit_length()


def raw_of(v):
    return v if v >= 0 else v + (1 << size_of(v)) - 1


def grey_file(coef, width, height):
    """A one-component progressive file with two approximations of every band and EOB runs."""
    dc, ac = list(range(12)), [r << 4 | s for r in range(16) for s in range(11)] + [n << 4 for n in range(1, 15)]
    ac = sorted(set(ac))
    table = lambda kind, s: struct.pack(">BBH", 0xFF, 0xC4, 2 + 17 + len(s)) + bytes([kind << 4]) + bytes(0 if n != 8 else len(s) for n in range(1, 17)) + bytes(s)
    out = b"\xff\xd8" + J._segment(0xDB, b"\0" + b"\1" * 64) + J._segment(0xC2, struct.pack(">BHHB", 8, height, width, 1) + bytes([1, 0x11, 0])) + table(0, dc) + table(1, ac)
    b, last = Bits(dc), 0
    for row in coef:
        v = int(row[0]) >> 1
        b.symbol(size_of(v - last))
        b.put(raw_of(v - last), size_of(v - last))
        last = v
    out += J._scan(1, 0, 0, 0, 0, 1, b.data())
    b, run = Bits(ac), 0

    def flush():
        nonlocal run
        if run:
            n = run.bit_length() - 1
            b.symbol(n << 4)
            b.put(run - (1 << n), n)
            run = 0

    point = lambda v, al: (abs(v) >> al) * (1 if v >= 0 else -1)
    for row in coef:
        zeros = 0
        for k in range(1, 64):
            v = point(int(row[k]), 1)
            if not v:
                zeros += 1
                continue
            flush()
            while zeros > 15:
                b.symbol(0xF0)
                zeros -= 16
            b.symbol(zeros << 4 | size_of(v))
            b.put(raw_of(v), size_of(v))
            zeros = 0
        run += zeros > 0
    flush()
    out += J._scan(1, 0, 1, 63, 0, 1, b.data())
    b = Bits(dc)
    for row in coef:
        b.put(int(row[0]) & 1, 1)
    out += J._scan(1, 0, 0, 0, 1, 0, b.data())
    b = Bits(ac)
    for row in coef:
        zeros, held = 0, []
        for k in range(1, 64):
            v = int(row[k])
            if abs(v) > 1:
                held.append(abs(v) & 1)
                continue
            if v == 0:
                zeros += 1
                if zeros == 16 and np.any(np.abs(row[k + 1 :]) == 1):
                    b.symbol(0xF0)
                    for x in held:
                        b.put(x, 1)
                    zeros, held = 0, []
                continue
            b.symbol(zeros << 4 | 1)
            b.put(int(v > 0), 1)
            for x in held:
                b.put(x, 1)
            zeros, held = 0, []
        if zeros or held:
            b.symbol(0)
            for x in held:
                b.put(x, 1)
    return out + J._scan(1, 0, 1, 63, 1, 0, b.data()) + b"\xff\xd9"


def test_general_progressive_file():
    rng = np.random.default_rng(5)
    coef = np.where(rng.random((6, 64)) < 0.3, rng.integers(-40, 40, (6, 64)), 0)
    coef[2] = 0
    coef[:, 0] = rng.integers(-200, 200, 6)
    width, height, comps, quant, _ = J.read_coefficients(grey_file(coef, 24, 16))
    assert (comps[0].coef == coef).all()
    rgb = J.to_rgb(width, height, comps, quant)
    assert rgb.shape == (16, 24, 3)
    natural = np.zeros((6, 64))
    natural[:, J._NATURAL] = coef
    c = np.array([[np.sqrt((1 if u == 0 else 2) / 8) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])
    block = c.T @ natural[4].reshape(8, 8) @ c + 128
    assert np.abs(rgb[8:16, 8:16, 0] - np.clip(block, 0, 255)).max() <= 1


def test_report(spark):
    text = ["", None, "é" * 40, "abc", "abc", "x" * 100_000]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(text)], "doc_id long, text string, media int")
    rows = {r.doc_id: r for r in J.media_report(df).collect()}
    for i, t in enumerate(text):
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert rows[3][1:] == rows[4][1:] and rows[0].feature == rows[1].feature
    assert J.media_report(df.limit(0)).count() == 0
    for r in rows.values():  # the stored tensor gives the feature
        rgb = np.frombuffer(r.rgb, np.uint8).reshape(r.height, r.width, 3)
        assert r.feature == f"{r.width}x{r.height}:" + ",".join(str(int(rgb[:, :, k].sum())) for k in range(3))


def test_tensors_come_back_from_storage(spark, tmp_path):
    df = spark.createDataFrame([(i, "some text of a row " * i * i) for i in range(12)], "doc_id long, text string")
    J.media_report(df).write.parquet(f"file://{tmp_path}/media")
    back = {r.doc_id: r for r in spark.read.parquet(f"file://{tmp_path}/media").collect()}
    for i in range(12):
        media = J.encode_payload(J.padded(("some text of a row " * i * i).encode()))
        assert back[i].rgb == J.decode(media).tobytes() and back[i].media_sha256 == hashlib.sha256(media).hexdigest()


def test_strips_make_the_same_picture(monkeypatch):
    media = J.encode_payload(J.padded(os.urandom(40_000)))
    whole = J.decode(media)
    monkeypatch.setattr(J, "STRIP_BLOCKS", 1)
    assert (J.decode(media) == whole).all()


def test_malformed_files_give_nulls(spark):
    good = J.encode_payload(J.padded(b"text " * 90))
    bad = [b"", b"\xff", b"not a picture", good[:2], good[:200], good[: len(good) // 2], good[:-2], good[:40] + b"\0" * 40, good.replace(b"\xff\xc2", b"\xff\xc0", 1), b"\xff\xd8\xff\xd9", good.replace(b"payload", b"payload x", 1)]
    rows = [(i, m, 5) for i, m in enumerate([good, None, good, *bad])]
    got = {r.id: r for r in J.decode_media(spark.createDataFrame(rows, "id int, media binary, payload_bytes int"), tensors=True).collect()}
    assert got[0].payload == J.padded(b"text " * 90) and got[2].feature == got[0].feature
    assert all(got[i].payload is None and got[i].feature is None and got[i].rgb is None for i in (1, *range(3, 3 + len(bad))))
