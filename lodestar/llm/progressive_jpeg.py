"""Progressive JPEG media columns.

``decode`` reads any three- or one-component Huffman-coded progressive file
(SOF2): every scan, spectral selection or successive approximation, adds to the
coefficient arrays of its components; these are dequantised, inverse-transformed
in numpy, chroma is upsampled and the result is a full-resolution RGB tensor, which
is stored as a column.  Pictures are transformed in strips of rows.
Scans in which all codes have one width are read as arrays; any other scan goes
through a bit reader.

``encode_payload`` writes bytes losslessly: the format's unit is a quantised
coefficient, a block holds 64 of them, and a byte is a coefficient of fixed bit
length, sent as a first approximation and one refinement.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textarrays import pieces_of

BLOCK = 64
PIECE_BYTES = 4 << 20
OUT_BYTES = 16 << 20
STRIP_BLOCKS = 4096


def _zigzag() -> np.ndarray:
    """Natural index of each zigzag position, walked along the anti-diagonals."""
    cells = [(r, c) for r in range(8) for c in range(8)]
    cells.sort(key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))
    return np.array([8 * r + c for r, c in cells])


_NATURAL = _zigzag()
_k = np.arange(8)
_DCT = (np.sqrt(np.where(_k == 0, 1 / 8, 1 / 4))[:, None] * np.cos((2 * _k[None, :] + 1) * _k[:, None] * np.pi / 16)).astype(np.float32)


# ---- writing ---------------------------------------------------------------


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _table(kind: int, number: int, lengths: dict[int, list[int]]) -> bytes:
    """DHT body: symbols by code length."""
    counts = bytes(len(lengths.get(n, [])) for n in range(1, 17))
    return bytes([kind << 4 | number]) + counts + bytes(s for n in range(1, 17) for s in lengths.get(n, []))


def _scan(component: int, tables: int, ss: int, se: int, ah: int, al: int, data: bytes) -> bytes:
    return _segment(0xDA, bytes([1, component, tables, ss, se, ah << 4 | al])) + data


def _stuffed(data: np.ndarray) -> bytes:
    """A zero byte after each 0xFF."""
    return data.tobytes().replace(b"\xff", b"\xff\x00")


def _restarts(data: np.ndarray) -> bytes:
    """One byte per restart interval, RST markers between."""
    n = len(data)
    out = np.empty((n, 3), dtype=np.uint8)
    out[:, 0] = data
    out[:, 1] = 0xFF
    out[:, 2] = 0xD0 + np.arange(n) % 8
    return out.tobytes()[: 3 * n - 2]


def _bits(value: int, n: int) -> np.ndarray:
    return np.array([(value >> (n - 1 - i)) & 1 for i in range(n)], dtype=np.uint8)


def grid(blocks: int) -> tuple[int, int]:
    """Width and height in 16 x 16 units of six blocks that hold so many blocks."""
    units = max(1, -(-blocks // 6))
    wide = max(1, int(np.ceil(np.sqrt(units))))
    if wide > 4095:
        raise ValueError("payload too large for one picture")
    return wide, -(-units // wide)


def encode_payload(payload: bytes) -> bytes:
    """A 4:2:0 progressive JPEG whose coefficients are ``payload`` (a multiple of 64 bytes, not empty).

    Luma blocks come first, then Cb and Cr; blocks beyond the payload hold zero
    bytes.  A comment segment keeps the payload's length.
    """
    blocks = len(payload) // BLOCK
    wide, high = grid(blocks)
    units = wide * high
    data = np.zeros((6 * units, BLOCK), dtype=np.uint8)
    data[:blocks] = np.frombuffer(payload, dtype=np.uint8).reshape(-1, BLOCK)
    planes = (data[: 4 * units], data[4 * units : 5 * units], data[5 * units :])
    out = [
        b"\xff\xd8",
        _segment(0xFE, b"payload " + str(len(payload)).encode()),
        _segment(0xDB, b"\x00" + b"\x01" * 64),
        _segment(0xC2, struct.pack(">BHHB", 8, 16 * high, 16 * wide, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])),
        _segment(0xC4, _table(0, 0, {1: [7]}) + _table(1, 0, {1: [7]}) + _table(1, 1, {4: [n << 4 for n in range(15)]})),
        _segment(0xDD, struct.pack(">H", 1)),
    ]
    for c, x in enumerate(planes, 1):
        out.append(_scan(c, 0x00, 0, 0, 0, 1, _restarts(x[:, 0] >> 1)))
    out.append(_segment(0xDD, struct.pack(">H", 0)))
    for c, x in enumerate(planes, 1):
        for a, b in ((1, 5), (6, 63)):
            out.append(_scan(c, 0x00, a, b, 0, 1, (x[:, a : b + 1] >> 1).tobytes()))
    for c, x in enumerate(planes, 1):
        out.append(_scan(c, 0x00, 0, 0, 1, 0, _stuffed(_packed([x[:, 0] & 1]))))
    for c, x in enumerate(planes, 1):
        low = (x[:, 1:] & 1) ^ (x[:, 1:] < 128)
        parts, at = [], 0
        while at < len(x):
            run = min(len(x) - at, 32767)
            n = run.bit_length() - 1
            parts += [_bits(n, 4), _bits(run - (1 << n), n), low[at : at + run].ravel()]
            at += run
        out.append(_scan(c, 0x01, 1, 63, 1, 0, _stuffed(_packed(parts))))
    out.append(b"\xff\xd9")
    return b"".join(out)


def _packed(parts: list[np.ndarray]) -> np.ndarray:
    """Bits as bytes, filled up with ones."""
    bits = np.concatenate(parts).astype(np.uint8)
    return np.packbits(np.concatenate([bits, np.ones(-len(bits) % 8, dtype=np.uint8)]))


# ---- reading ---------------------------------------------------------------


class Component:
    def __init__(self, ident: int, h: int, v: int, quant: int):
        self.ident, self.h, self.v, self.quant = ident, h, v, quant
        self.wide = self.high = self.stride = self.rows = 0
        self.coef = np.zeros((0, 64), dtype=np.int16)


class _Reader:
    """Single bits of one entropy-coded interval."""

    def __init__(self, data: bytes):
        self.bits = np.unpackbits(np.frombuffer(data.replace(b"\xff\x00", b"\xff"), dtype=np.uint8)).tolist() if data else []
        self.at = 0

    def bit(self) -> int:
        x = self.bits[self.at] if self.at < len(self.bits) else 1
        self.at += 1
        return x

    def take(self, n: int) -> int:
        x = 0
        for _ in range(n):
            x = x << 1 | self.bit()
        return x

    def symbol(self, codes: dict[tuple[int, int], int]) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | self.bit()
            if (n, code) in codes:
                return codes[n, code]
        raise ValueError("bad Huffman code")


def _signed(raw: int, n: int) -> int:
    return raw if n == 0 or raw >> (n - 1) else raw - (1 << n) + 1


def _codes(body: bytes) -> tuple[dict[tuple[int, int], int], bytes]:
    """Canonical codes of one DHT table, and the rest of the segment."""
    counts, symbols = body[1:17], body[17 : 17 + sum(body[1:17])]
    out, code, at = {}, 0, 0
    for n in range(1, 17):
        for _ in range(counts[n - 1]):
            out[n, code] = symbols[at]
            code += 1
            at += 1
        code <<= 1
    return out, body[17 + at :]


def _intervals(data: bytes, end_of_scan: int, start: int) -> list[bytes]:
    """Entropy-coded bytes between restart markers."""
    raw = np.frombuffer(data, dtype=np.uint8, count=end_of_scan - start, offset=start)
    at = np.flatnonzero((raw[:-1] == 0xFF) & (raw[1:] >= 0xD0) & (raw[1:] <= 0xD7)) if len(raw) > 1 else []
    out, last = [], 0
    for p in at:
        out.append(raw[last:p].tobytes())
        last = p + 2
    out.append(raw[last:].tobytes())
    return out


def _scan_end(data: bytes, at: int) -> int:
    """Where the next marker stands that is neither stuffing nor a restart."""
    while True:
        at = data.index(b"\xff", at)
        if data[at + 1] != 0 and not 0xD0 <= data[at + 1] <= 0xD7:
            return at
        at += 2


def _only(codes: dict) -> tuple[int, int] | None:
    """Code width and symbol of a table with a single code."""
    return ((k := next(iter(codes)))[0], codes[k]) if len(codes) == 1 else None


def _blocks_of(c: Component) -> np.ndarray | slice:
    """Coefficient rows in the order of a scan of this component alone."""
    if (c.wide, c.high) == (c.stride, c.rows):
        return slice(None)
    return (np.arange(c.high)[:, None] * c.stride + np.arange(c.wide)).ravel()


def _fixed_scan(data: bytes, start: int, c: Component, dc, ac, ss, se, ah, al, restart) -> int | None:
    """Read a scan whose codes all have one width; its end, or None if it isn't such a scan."""
    rows, band = _blocks_of(c), slice(ss, se + 1)
    n, span = c.wide * c.high, se - ss + 1
    if ss == 0 and ah == 0 and restart == 1 and (one := _only(dc)) and one[0] + one[1] == 8:
        size = 3 * n - 2
        x = np.frombuffer(data + b"\xff\xd0", dtype=np.uint8, count=3 * n, offset=start) if start + size + 2 > len(data) else np.frombuffer(data, dtype=np.uint8, count=3 * n, offset=start)
        x = x.reshape(n, 3)
        if (x[:-1, 1] != 0xFF).any() or (x[:, 0] == 0xFF).any():
            return None
        s = one[1]
        raw = (x[:, 0] & ((1 << s) - 1)).astype(np.int16)
        c.coef[rows, 0] = np.where(raw >> (s - 1), raw, raw - (1 << s) + 1) << al
        return start + size
    if restart:
        return None
    if ss > 0 and ah == 0 and (one := _only(ac)) and one[1] >> 4 == 0 and one[0] + one[1] == 8:
        x = np.frombuffer(data, dtype=np.uint8, count=n * span, offset=start)
        if (x == 0xFF).any():
            return None
        s = one[1]
        raw = (x & ((1 << s) - 1)).astype(np.int16).reshape(n, span)
        c.coef[rows, band] = np.where(raw >> (s - 1), raw, raw - (1 << s) + 1) << al
        return start + n * span
    if ah:
        end = _scan_end(data, start)
        bits = np.unpackbits(np.frombuffer(data[start:end].replace(b"\xff\x00", b"\xff"), dtype=np.uint8))
        if ss == 0:
            c.coef[rows, 0] |= bits[:n].astype(np.int16) << np.int16(al)
            return end
        now = c.coef[rows, band]
        if len(bits) < n or not now.all():
            return None
        at, done = 0, 0
        fix = np.empty((n, span), dtype=np.uint8)
        while done < n:
            r = _Reader(b"")
            r.bits = bits[at : at + 32].tolist()
            rs = r.symbol(ac)
            run = rs >> 4
            if rs & 15 or run == 15:
                return None
            count = (1 << run) + r.take(run)
            at += r.at
            fix[done : done + count] = bits[at : at + count * span].reshape(count, span)
            at += count * span
            done += count
        c.coef[rows, band] = now + np.sign(now) * (fix.astype(np.int16) << np.int16(al))
        return end
    return None


def _refine(r: _Reader, row: np.ndarray, k: int, last: int, bit: int, zeros: int | None) -> int:
    """Correct known coefficients from k on; stop at the zero after ``zeros`` zeros."""
    while k <= last:
        if row[k]:
            if r.bit() and not abs(int(row[k])) & bit:
                row[k] += bit if row[k] > 0 else -bit
        elif zeros is not None:
            if zeros == 0:
                return k
            zeros -= 1
        k += 1
    return k


def _coded_scan(parts: list[bytes], units: list[list[tuple[Component, int]]], tables: dict, ss, se, ah, al, restart) -> None:
    """Read a scan code by code; units list the blocks of each MCU."""
    for p, data in enumerate(parts):
        r, eob, last = _Reader(data), 0, {}
        part = units[p * restart : (p + 1) * restart] if restart else units
        for unit in part:
            for c, b in unit:
                dc, ac = tables[c.ident]
                row = c.coef[b]
                if ss == 0:
                    if ah:
                        row[0] |= r.bit() << al
                        continue
                    s = r.symbol(dc)
                    last[c.ident] = last.get(c.ident, 0) + _signed(r.take(s), s)
                    row[0] = last[c.ident] << al
                    continue
                k = ss
                while k <= se and not eob:
                    rs = r.symbol(ac)
                    run, s = rs >> 4, rs & 15
                    if s == 0 and run < 15:
                        eob = (1 << run) + r.take(run)
                        break
                    if ah == 0:
                        k += run
                        if s:
                            row[k] = _signed(r.take(s), s) * (1 << al)
                        k += 1
                        continue
                    value = (1 if r.bit() else -1) << al if s else 0
                    k = _refine(r, row, k, se, 1 << al, run)
                    if s and k <= se:
                        row[k] = value
                    k += 1
                if eob:
                    if ah:
                        _refine(r, row, k, se, 1 << al, None)
                    eob -= 1


def read_coefficients(data: bytes) -> tuple[int, int, list[Component], dict[int, np.ndarray], bytes]:
    """Width, height, components with coefficients (blocks x 64, zigzag order), quantisers and the comment."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    at, restart, comment = 2, 0, b""
    quant: dict[int, np.ndarray] = {}
    tables: dict[tuple[int, int], dict] = {}
    comps: list[Component] = []
    width = height = 0
    while True:
        marker = data[at + 1]
        if marker == 0xD9:
            return width, height, comps, quant, comment
        size = struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xFE:
            comment = body
        elif marker == 0xDB:
            while body:
                wide = 2 if body[0] >> 4 else 1
                quant[body[0] & 15] = np.frombuffer(body, dtype=">u2" if wide == 2 else np.uint8, count=64, offset=1).astype(np.int32)
                body = body[1 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                key = (body[0] >> 4, body[0] & 15)
                tables[key], body = _codes(body)
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xC2:
            _, height, width, n = struct.unpack_from(">BHHB", body)
            comps = [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            hmax, vmax = max(c.h for c in comps), max(c.v for c in comps)
            across, down = -(-width // (8 * hmax)), -(-height // (8 * vmax))
            for c in comps:
                c.wide, c.high = -(-width * c.h // (8 * hmax)), -(-height * c.v // (8 * vmax))
                c.stride, c.rows = across * c.h, down * c.v
                c.coef = np.zeros((c.stride * c.rows, 64), dtype=np.int16)
        elif marker in (0xC0, 0xC1, 0xC3):
            raise ValueError("not a progressive JPEG")
        elif marker == 0xDA:
            chosen = [(next(c for c in comps if c.ident == body[1 + 2 * i]), body[2 + 2 * i]) for i in range(body[0])]
            ss, se, a = body[1 + 2 * body[0] : 4 + 2 * body[0]]
            coded = {c.ident: (tables.get((0, t >> 4), {}), tables.get((1, t & 15), {})) for c, t in chosen}
            if len(chosen) == 1:
                c = chosen[0][0]
                end = _fixed_scan(data, at, c, *coded[c.ident], ss, se, a >> 4, a & 15, restart)
                if end is not None:
                    at = end
                    continue
                units = [[(c, int(b))] for b in np.arange(len(c.coef))[_blocks_of(c)]]
            else:
                units = [[(c, (y * c.v + v) * c.stride + x * c.h + h) for c, _ in chosen for v in range(c.v) for h in range(c.h)] for y in range(down) for x in range(across)]
            end = _scan_end(data, at)
            _coded_scan(_intervals(data, end, at), units, coded, ss, se, a >> 4, a & 15, restart)
            at = end


def _plane(c: Component, quant: dict[int, np.ndarray], first: int, last: int) -> np.ndarray:
    """Samples of block rows ``first`` to ``last`` of a component, unclipped and centred on 128."""
    coef = c.coef[first * c.stride : last * c.stride]
    natural = np.zeros((len(coef), 64), dtype=np.float32)
    natural[:, _NATURAL] = coef * quant[c.quant]
    x = natural.reshape(-1, 8) @ _DCT  # along rows
    x = x.reshape(-1, 8, 8).transpose(0, 2, 1).reshape(-1, 8) @ _DCT
    x = x.reshape(last - first, c.stride, 8, 8).transpose(0, 3, 1, 2)
    return x.reshape(8 * (last - first), 8 * c.stride) + np.float32(128)


def decode(data: bytes) -> np.ndarray:
    """RGB tensor (height, width, 3) of 8-bit samples."""
    return to_rgb(*read_coefficients(data)[:4])


def to_rgb(width: int, height: int, comps: list[Component], quant: dict[int, np.ndarray]) -> np.ndarray:
    hmax, vmax = max(c.h for c in comps), max(c.v for c in comps)
    out = np.empty((height, width, 3), dtype=np.uint8)
    units = max(1, STRIP_BLOCKS // max(1, sum(c.stride * c.v for c in comps)))
    for unit in range(0, -(-height // (8 * vmax)), units):
        top = unit * 8 * vmax
        planes = []
        for c in comps:
            x = np.clip(_plane(c, quant, unit * c.v, min((unit + units) * c.v, c.rows)), 0, 255)
            x = np.repeat(np.repeat(x, vmax // c.v, axis=0), hmax // c.h, axis=1)
            planes.append(x[: height - top, :width])
        strip = out[top : top + len(planes[0])]
        if len(planes) == 1:
            strip[:] = np.rint(planes[0])[:, :, None]
            continue
        y, cb, cr = planes[0], planes[1] - np.float32(128), planes[2] - np.float32(128)
        for k, v in enumerate((y + np.float32(1.402) * cr, y - np.float32(0.344136) * cb - np.float32(0.714136) * cr, y + np.float32(1.772) * cb)):
            strip[:, :, k] = np.rint(np.clip(v, 0, 255))
    return out


def read_payload(comps: list[Component], comment: bytes) -> bytes:
    """The bytes that ``encode_payload`` put into the coefficients."""
    x = np.concatenate([c.coef[_blocks_of(c)] for c in comps])
    low = np.where(x < 0, x + np.int16(255), x)
    low[:, 0] -= x[:, 0] < 0
    return low.astype(np.uint8).tobytes()[: int(comment.split()[1])]


# ---- columns ---------------------------------------------------------------


def padded(raw: bytes) -> bytes:
    """Zero bytes up to a positive multiple of 64."""
    return raw + bytes(max(BLOCK - len(raw), 0) if len(raw) < BLOCK else -len(raw) % BLOCK)


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each whole text, null as empty, as a progressive JPEG.

    Repeated rows and null ids stay rows; other columns are ignored.
    """

    def run(batches):
        for batch in pieces_of(batches, 1, PIECE_BYTES):
            n, media = [], []
            for raw in batch.column(1).cast(pa.large_binary()).to_pylist():
                raw = raw or b""
                n.append(len(raw))
                media.append(encode_payload(padded(raw)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(media, pa.binary())], names=[id_col, "n_bytes", "media"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` long, n_bytes long, media binary")


def decode_media(media: DataFrame, tensors: bool = False) -> DataFrame:
    """Adds to ``media(.., media)`` what its file holds.

    payload (binary, null when the file has none), height, width, feature (width,
    height and channel sums of the RGB tensor) and, with ``tensors``, rgb (binary,
    rows by columns by three).  A null file, and one that is cut short, malformed
    or no progressive JPEG, gives nulls.
    """
    new = [("payload", T.BinaryType()), ("height", T.IntegerType()), ("width", T.IntegerType()), ("feature", T.StringType())]
    new += [("rgb", T.BinaryType())] if tensors else []
    schema = T.StructType([*(f for f in media.schema.fields if f.name != "media"), media.schema["media"], *(T.StructField(*x) for x in new)])

    def one(data):
        if data is None:
            return None, None, None, None, None
        try:
            width, height, comps, quant, comment = read_coefficients(data)
            rgb = to_rgb(width, height, comps, quant)
            payload = read_payload(comps, comment) if comment.startswith(b"payload ") else None
        except (ValueError, IndexError, KeyError, StopIteration, ZeroDivisionError, OverflowError, struct.error):
            return None, None, None, None, None
        feature = f"{width}x{height}:" + ",".join(str(int(rgb[:, :, k].sum(dtype=np.int64))) for k in range(3))
        return payload, height, width, feature, rgb.tobytes() if tensors else None

    def out(batch, rows):
        cols = list(zip(*rows)) if rows else [[]] * 5
        new = [pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.int32(), pa.int32(), pa.string(), pa.binary()))]
        return pa.RecordBatch.from_arrays([batch.column(c) for c in batch.schema.names] + new[: 4 + tensors], names=schema.names)

    def run(batches):
        for batch in pieces_of(batches, -1, PIECE_BYTES):
            rows, start, held = [], 0, 0
            for k, data in enumerate(batch.columns[-1].to_pylist()):
                rows.append(one(data))
                held += len(rows[-1][4] or b"")
                if held > OUT_BYTES:
                    yield out(batch.slice(start, len(rows)), rows)
                    rows, start, held = [], k + 1, 0
            yield out(batch.slice(start), rows)

    return media.select(*[c for c in media.columns if c != "media"], "media").mapInArrow(run, schema)


def media_report(docs: DataFrame) -> DataFrame:
    """Digests of the media column of whole texts and its RGB tensor; see ``encode_texts`` and ``decode_media``."""
    back = decode_media(encode_texts(docs), tensors=True)
    return back.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -BLOCK, BLOCK)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
        "height",
        "width",
        "rgb",
    )
