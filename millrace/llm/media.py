"""Baseline JPEG in numpy: marker parsing, Huffman decoding of whole batches in lockstep, DC-only luminance thumbnails, hashes.

A decoder lane is one restart interval (or a whole scan without them). All lanes of a batch advance one Huffman symbol a step, so
the work is done by numpy over thousands of lanes instead of by a Python loop over symbols.

The thumbnail's pixel is an 8x8 block's mean: quantized DC * quantizer / 8 + 128. ``store`` turns that round: with a DC quantizer of 8, a
payload byte b is the DC value b - 128 of a flat block, which Huffman coding keeps exactly; the thumbnail is the payload.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm._common import arrow_map, buffer_of, id_type, pick

#: Blocks in a row, and rows in one image (its height, 8 times that, has 16 bits); longer payloads go on in another image.
ROW = 192
ROWS = 8191

#: The order of coefficients, and the typical DC luminance code lengths of the JPEG standard (Annex K).
DC_COUNTS = [0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]
DC_SYMBOLS = list(range(12))
#: The AC table of flat blocks: end of block only, as one bit.
AC_COUNTS = [1] + [0] * 15
AC_SYMBOLS = [0]


def codes(counts: list[int], symbols: list[int]) -> dict[int, tuple[int, int]]:
    """Canonical Huffman codes: symbol -> (code, bits)."""
    out, code, k = {}, 0, 0
    for bits, n in enumerate(counts, 1):
        for _ in range(n):
            out[symbols[k]] = (code, bits)
            code, k = code + 1, k + 1
        code <<= 1
    return out


def lookup(counts: list[int], symbols: list[int]) -> np.ndarray:
    """For each 16-bit window: bits of the code in front << 8 | symbol; 0 where there is no code."""
    table = np.zeros(1 << 16, np.uint16)
    for symbol, (code, bits) in codes(counts, symbols).items():
        table[code << (16 - bits) : (code + 1) << (16 - bits)] = bits << 8 | symbol
    return table


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


#: For each difference of neighbours from -255 on: its code with the end-of-block bit 0, and the bits of that.
_CODE = np.zeros(511, np.uint32)
_BITS = np.zeros(511, np.uint8)
for _d in range(-255, 256):
    _n = abs(_d).bit_length()
    _c, _b = codes(DC_COUNTS, DC_SYMBOLS)[_n]
    _CODE[_d + 255], _BITS[_d + 255] = (_c << _n | (_d if _d >= 0 else _d + (1 << _n) - 1)) << 1, _b + _n + 1
_TABLES = _segment(0xDB, b"\x00" + bytes([8] + [1] * 63)) + _segment(0xC4, b"\x00" + bytes(DC_COUNTS) + bytes(DC_SYMBOLS)) + _segment(0xC4, b"\x10" + bytes(AC_COUNTS) + bytes(AC_SYMBOLS))
_SCAN = _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00")


def scans(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded bytes of rows of ``ROW`` flat blocks, each row a restart interval of its own, and the rows' bounds (rows + 1)."""
    rows = len(samples) // ROW
    x = samples.reshape(rows, ROW).astype(np.int16)
    diff = x + np.int16(255)
    diff[:, 1:] -= x[:, :-1]
    diff[:, 0] -= 128
    bits = _BITS[diff]
    ends = np.cumsum(bits, axis=1, dtype=np.int32)
    total = ends[:, -1].astype(np.int64)
    lengths = (total + 7) >> 3
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    last = (bounds[:-1, None] * 8 + (ends - 1)).reshape(-1)  # each code's last bit
    word = _CODE[diff].reshape(-1) << (7 - (last & 7)).astype(np.uint32)
    at = last >> 3
    # codes that end in the same byte are added up, as no two share a bit; a word reaches into the three bytes before at the most
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    words = np.zeros(int(bounds[-1]) + 3, np.uint32)
    words[at[first]] = np.add.reduceat(word, first)
    out = words.astype(np.uint8)
    for k in (1, 2, 3):
        out[:-k] |= (words[k:] >> np.uint32(8 * k)).astype(np.uint8)
    out = out[:-3]
    pad = (1 << (-total & 7)) - 1  # the rest of a row's last byte is ones
    out[bounds[1:] - 1] |= pad.astype(np.uint8)
    return out, bounds


def store(raw: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """Payloads (each a positive multiple of ``ROW`` bytes) as grayscale baseline JPEG files, one image after another if one is too small."""
    data, bounds = scans(raw)
    full = np.flatnonzero(data == 0xFF)
    stuffed = np.insert(data, full + 1, 0) if len(full) else data
    bounds = bounds + np.searchsorted(full, bounds)
    view = stuffed.tobytes()
    out = []
    edges = (offsets // ROW).tolist()
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        images = []
        for r in range(a, b, ROWS):
            rows = min(ROWS, b - r)
            cut = bounds[r : r + rows + 1].tolist()
            pieces = [b"\xff\xd8" + _TABLES, _segment(0xC0, struct.pack(">BHHBBBB", 8, 8 * rows, 8 * ROW, 1, 1, 0x11, 0)), _segment(0xDD, struct.pack(">H", ROW)), _SCAN]
            for k in range(rows):
                pieces.append(view[cut[k] : cut[k + 1]])
                if k < rows - 1:
                    pieces.append(bytes((0xFF, 0xD0 | k & 7)))
            images.append(b"".join(pieces) + b"\xff\xd9")
        out.append(b"".join(images))
    return out


class Image:
    """One baseline image: size, tables and the scan that has the first component, which is the luminance, from its markers. Scans of other components are passed over."""

    __slots__ = ("width", "height", "components", "most", "scan", "restart", "end")

    def __init__(self, data: bytes, at: int):
        if data[at : at + 2] != b"\xff\xd8":
            raise ValueError("no start of image")
        at += 2
        quantizers, dc, ac, restart, frame, self.scan = {}, {}, {}, 0, None, None
        while data[at : at + 2] != b"\xff\xd9":
            if at >= len(data):
                raise ValueError("no end of image")
            while data[at] == 0xFF and data[at + 1] == 0xFF:
                at += 1
            if data[at] != 0xFF:
                raise ValueError("marker expected")
            marker = data[at + 1]
            n = struct.unpack_from(">H", data, at + 2)[0]
            body = data[at + 4 : at + 2 + n]
            at += 2 + n
            if marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    quantizers[body[0] & 15] = struct.unpack_from(">H", body, 1)[0] if wide else body[1]
                    body = body[129 if wide else 65 :]
            elif marker == 0xC4:
                while body:
                    n_symbols = sum(body[1:17])
                    (ac if body[0] >> 4 else dc)[body[0] & 15] = body[1 : 17 + n_symbols]
                    body = body[17 + n_symbols :]
            elif marker == 0xC0 or marker == 0xC1:
                bits, self.height, self.width, n = struct.unpack_from(">BHHB", body)
                if bits != 8:
                    raise ValueError("only 8-bit samples")
                frame = {body[6 + 3 * k]: (body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)}
            elif 0xC0 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
                raise ValueError("not a baseline image")
            elif marker == 0xDD:
                restart = struct.unpack(">H", body)[0]
            elif marker == 0xDA:
                if frame is None:
                    raise ValueError("a scan without a frame")
                start, at = at, self._after(data, at)
                if self.scan is None and body[1] == next(iter(frame)):
                    self.scan, self.restart = data[start:at], restart
                    self.components = [(*frame[body[1 + 2 * k]][:2], quantizers[frame[body[1 + 2 * k]][2]], dc[body[2 + 2 * k] >> 4], ac[body[2 + 2 * k] & 15]) for k in range(body[0])]
                    self.most = max(c[0] for c in frame.values()), max(c[1] for c in frame.values())
        if self.scan is None:
            raise ValueError("no scan")
        self.end = at + 2

    @staticmethod
    def _after(data: bytes, at: int) -> int:
        """Where the entropy-coded bytes from ``at`` on end."""
        while True:
            at = data.find(b"\xff", at)
            if at < 0:
                raise ValueError("no end of image")
            if data[at + 1] and not 0xD0 <= data[at + 1] <= 0xD7:
                return at
            at += 2


def images(data: bytes) -> list[Image]:
    out, at = [], 0
    while at < len(data):
        out.append(Image(data, at))
        at = out[-1].end
    return out


def thumbnails(files: list[Image]) -> list[np.ndarray]:
    """DC-only luminance of each image, a pixel for each 8x8 block, as float32 before rounding; all images are decoded together."""
    plans: dict[tuple, int] = {}
    luts: list[np.ndarray] = []
    known: dict[bytes, int] = {}

    def lut(spec: bytes) -> int:
        if spec not in known:
            known[spec] = len(luts)
            n = list(spec[:16])
            luts.append(lookup(n, list(spec[16:])))
        return known[spec]

    lanes_plan, lanes_left, lanes_image, lanes_mcu, pieces = [], [], [], [], []
    shapes, out = [], []
    block_plans: list[list[tuple]] = []  # for each plan, of each block of a unit: component, DC table, AC table
    for i, x in enumerate(files):
        hs, vs = x.most
        single = len(x.components) == 1  # a scan of its own has the blocks that its component's samples need
        blocks = [(k, lut(c[3]), lut(c[4])) for k, c in enumerate(x.components) for _ in range(1 if single else c[0] * c[1])]
        plan = plans.setdefault(tuple(blocks), len(plans))
        if plan == len(block_plans):
            block_plans.append(blocks)
        across, down = -(-x.width // (8 * hs)), -(-x.height // (8 * vs))
        if single:
            h, v = x.components[0][:2]
            across, down = -(-(-(-x.width * h // hs)) // 8), -(-(-(-x.height * v // vs)) // 8)
        shapes.append((across, down, 1 if single else x.components[0][0], 1 if single else x.components[0][1]))
        out.append(np.zeros(across * down * shapes[-1][2] * shapes[-1][3], np.float32))
        step, total = x.restart or across * down, across * down
        parts = _intervals(x.scan) if x.restart else [x.scan]
        if len(parts) != -(-total // step):
            raise ValueError("restart intervals are missing")
        for k, piece in enumerate(parts):
            lanes_plan.append(plan)
            lanes_image.append(i)
            lanes_mcu.append(k * step)
            lanes_left.append(min(step, total - k * step))
            pieces.append(piece)
    if not pieces:
        return out
    n = len(pieces)
    pieces = [p.replace(b"\xff\x00", b"\xff") for p in pieces]
    lengths = np.fromiter(map(len, pieces), np.int64, n) + 4
    raw = np.frombuffer(b"\xff\xff\xff\xff".join(pieces) + b"\xff" * 12, np.uint8)
    begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    end = (begin + lengths - 4) * 8
    table = np.stack(luts).reshape(-1)
    per = np.array([len(b) for b in block_plans])
    width = int(per.max())
    comp, dcs, acs = (np.array([[b[j] for b in blocks] + [0] * (width - len(blocks)) for blocks in block_plans], np.int64).reshape(-1) for j in range(3))
    dcs, acs = dcs << 16, acs << 16
    simple = len(comp) == 1
    # seven bytes from each on: a DC code with its value and an AC code's window fit into what is left of them after any bit
    reach = np.zeros(len(raw) - 6, np.int64)
    for j in range(7):
        reach |= raw[j : j + len(reach)].astype(np.int64) << (8 * (6 - j))
    # the lanes' state; lanes that are done leave the arrays
    lane, plan, pos = np.arange(n), np.array(lanes_plan), begin * 8
    todo = np.array(lanes_left) * per[plan]
    block, k = np.zeros(n, np.int64), np.zeros(n, np.int64)
    n_comp = max(len(x.components) for x in files)
    last = np.zeros(n * n_comp, np.int64)
    y_blocks = np.array([sum(1 for b in blocks if b[0] == 0) for blocks in block_plans])
    y_start = np.concatenate([[0], np.cumsum(np.array(lanes_left) * y_blocks[plan])])
    y_at = y_start[:-1].copy()
    y_dc = np.zeros(int(y_start[-1]), np.int32)
    fresh = True  # all lanes are at a block's start
    while len(lane):
        word = reach[pos >> 3]
        left = 56 - (pos & 7)
        kind = 0 if simple else plan * width + block
        d = slice(None) if fresh else np.flatnonzero(k == 0)
        if fresh or len(d):
            w, sh, kd, who = word[d], left[d], (0 if simple else kind[d]), lane[d]
            found = table[dcs[kd] + (w >> (sh - 16) & 0xFFFF)].astype(np.int64)
            if not found.all():
                raise ValueError("no such Huffman code")
            size = found & 15
            sh = sh - (found >> 8) - size
            left[d] = sh
            ones = (1 << size) - 1
            value = w >> sh & ones
            value -= np.where(value <= ones >> 1, ones, 0)
            if simple:
                value += last[who]
                last[who] = value
                y_dc[y_at[who]] = value
                y_at[who] += 1
            else:
                c = comp[kd]
                value += last[who * n_comp + c]
                last[who * n_comp + c] = value
                y = who[c == 0]
                y_dc[y_at[y]] = value[c == 0]
                y_at[y] += 1
            k[d] = 1
        found = table[acs[kind] + (word >> (left - 16) & 0xFFFF)].astype(np.int64)
        if not found.all():
            raise ValueError("no such Huffman code")
        symbol = found & 255
        pos = (pos & ~7) + 56 - left + (found >> 8) + (symbol & 15)
        # an end of block, a run of sixteen zeros, or a run and a value
        k = np.where(symbol == 0, 64, k + (symbol >> 4) + 1)
        over = k >= 64
        fresh = bool(over.all())
        if fresh and not symbol.any():
            k[:] = 0
            todo -= 1
        elif over.any():
            if (k > 64).any():
                raise ValueError("too many coefficients")
            k[over] = 0
            todo[over] -= 1
        else:
            continue
        if not simple:
            block[over] = (block[over] + 1) % per[plan[over]]
        if not todo.all():
            go = todo > 0
            if (pos > end[lane])[~go].any():
                raise ValueError("scan ends early")
            lane, plan, pos, todo, block, k = lane[go], plan[go], pos[go], todo[go], block[go], k[go]
        if (pos >= len(reach) * 8).any():
            raise ValueError("scan ends early")
    for j in range(n):
        i = lanes_image[j]
        across, down, h, v = shapes[i]
        a = lanes_mcu[j] * h * v
        part = y_dc[y_start[j] : y_start[j + 1]]
        out[i][a : a + len(part)] = part
    for i, x in enumerate(files):
        across, down, h, v = shapes[i]
        pixels = out[i] * np.float32(x.components[0][2] / 8) + np.float32(128)
        if h * v > 1:  # units hold h x v luminance blocks
            pixels = pixels.reshape(down, across, v, h).transpose(0, 2, 1, 3)
        pixels = pixels.reshape(down * v, across * h)
        hmax, vmax = x.most
        tall, broad = -(-x.height * (v if v < vmax else vmax) // (8 * vmax)), -(-x.width * (h if h < hmax else hmax) // (8 * hmax))
        out[i] = pixels[: tall if h * v > 1 or len(x.components) > 1 else None, : broad if h * v > 1 or len(x.components) > 1 else None]
    return out


def _intervals(scan: bytes) -> list[bytes]:
    """The scan's bytes between restart markers, which must count 0 to 7 over and over."""
    out, at, start, k = [], 0, 0, 0
    while (at := scan.find(b"\xff", at)) >= 0:
        if scan[at + 1] == 0:
            at += 2
            continue
        if scan[at + 1] != 0xD0 | k & 7:
            raise ValueError("restart markers out of order")
        out.append(scan[start:at])
        start = at = at + 2
        k += 1
    return [*out, scan[start:]]


def difference_hash(pixels: np.ndarray) -> str:
    """16 hex digits: of 8 rows of 9 areas of the thumbnail, which are brighter than their right neighbour."""
    rows = np.linspace(0, pixels.shape[0], 9).astype(int)
    cols = np.linspace(0, pixels.shape[1], 10).astype(int)
    sums = np.zeros((pixels.shape[0] + 1, pixels.shape[1] + 1))
    sums[1:, 1:] = pixels.cumsum(0, dtype=np.float64).cumsum(1)
    r0, r1, c0, c1 = rows[:-1, None], np.maximum(rows[1:], rows[:-1] + 1).clip(max=pixels.shape[0])[:, None], cols[:-1], np.maximum(cols[1:], cols[:-1] + 1).clip(max=pixels.shape[1])
    r0, c0 = np.minimum(r0, r1 - 1), np.minimum(c0, c1 - 1)
    area = (sums[r1, c1] - sums[r0, c1] - sums[r1, c0] + sums[r0, c0]) / ((r1 - r0) * (c1 - c0))
    return np.packbits(area[:, :-1] > area[:, 1:]).tobytes().hex()


def padded(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Payloads: each text's bytes with bytes 32 up to a positive multiple of ``ROW``."""
    lengths = np.diff(offsets)
    full = np.maximum(1, -(-lengths // ROW)) * ROW
    edges = np.concatenate([[0], np.cumsum(full)])
    out = np.full(int(edges[-1]), 32, np.uint8)
    out[np.repeat(edges[:-1] - offsets[:-1], lengths) + np.arange(len(raw))] = raw
    return out, edges


def store_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: every whole text as UTF-8, padded, in a JPEG file. Null: empty. Rows stay as they are; no shuffle."""

    def make():
        def part(batch: pa.RecordBatch) -> pa.RecordBatch:
            raw, offsets = buffer_of(batch.column("text"))
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(store(*padded(raw, offsets)), pa.binary())], ["doc_id", "n_bytes", "media"])

        return part

    return arrow_map(pick(df, id_col, text_col), make, f"doc_id {id_type(df, id_col)}, n_bytes long, media binary", "text", 1 << 20)


def jpeg_features(df: DataFrame, media_col: str = "media") -> DataFrame:
    """Adds width, height (of the first image), n_images, thumbnail (8-bit luminance, a byte for each block, images in turn) and thumbnail_hash (of each image, joined by hyphens).

    A null, empty, damaged or non-baseline file has null features and the reason in media_error (else null). ``df`` keeps its columns; those that are called so are replaced.
    """
    added = {"width": pa.int32(), "height": pa.int32(), "n_images": pa.int32(), "thumbnail": pa.binary(), "thumbnail_hash": pa.string(), "media_error": pa.string()}
    df = df.drop(*added)
    names = df.columns

    def features(data: list[bytes | None]) -> list[tuple]:
        out: list[tuple] = [(None,) * 5 + ("no data",)] * len(data)
        sets, who = [], []
        for i, x in enumerate(data):
            if x:
                try:
                    sets.append(images(x))
                    who.append(i)
                except (ValueError, IndexError, KeyError, struct.error) as e:
                    out[i] = (None,) * 5 + (str(e) or type(e).__name__,)
        try:
            thumbs = thumbnails([x for s in sets for x in s])
        except (ValueError, IndexError) as e:
            if len(sets) == 1:
                out[who[0]] = (None,) * 5 + (str(e),)
                return out
            return [features([x])[0] for x in data]
        at = 0
        for i, s in zip(who, sets, strict=True):
            pixels = [np.clip(np.rint(t), 0, 255).astype(np.uint8) for t in thumbs[at : at + len(s)]]
            at += len(s)
            out[i] = (s[0].width, s[0].height, len(s), b"".join(p.tobytes() for p in pixels), "-".join(map(difference_hash, pixels)), None)
        return out

    def make():
        def part(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = features(batch.column(media_col).to_pylist())
            cols = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, t) for c, t in zip(cols, added.values(), strict=True))], [*names, *added])

        return part

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), "width int, height int, n_images int, thumbnail binary, thumbnail_hash string, media_error string"])
    return arrow_map(df, make, schema, media_col, 2 << 20)
