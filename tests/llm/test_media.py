import hashlib
import struct
import zlib

import numpy as np
import pytest

from millrace.llm import media
from millrace.llm.queries import QUERIES


def segment(marker, body):
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def number_bits(v):
    n = abs(v).bit_length()
    return n, (v if v >= 0 else v + (1 << n) - 1)


def encoded(rng, width, height, sampling, restart):
    """A baseline file of random coefficients, all Huffman codes nine bits long, and its luminance DC values in block order of the image."""
    hs, vs = max(h for h, _ in sampling), max(v for _, v in sampling)
    single = len(sampling) == 1
    across, down = (-(-width // 8), -(-height // 8)) if single else (-(-width // (8 * hs)), -(-height // (8 * vs)))
    h0, v0 = (1, 1) if single else sampling[0]
    dcs = np.zeros((down * v0, across * h0), int)
    out, bits, last, markers = b"", "", [0] * len(sampling), 0

    def flush():
        nonlocal bits
        bits += "1" * (-len(bits) % 8)
        data = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")
        bits = ""
        return data

    for m in range(across * down):
        if restart and m and m % restart == 0:
            out += flush() + bytes((0xFF, 0xD0 | markers & 7))
            markers, last = markers + 1, [0] * len(sampling)
        for c, (h, v) in enumerate(sampling):
            for b in range(1 if single else h * v):
                dc = int(rng.integers(-500, 500))
                if c == 0:
                    dcs[(m // across) * v0 + b // h0, (m % across) * h0 + b % h0] = dc
                n, extra = number_bits(dc - last[c])
                last[c] = dc
                bits += f"{n:09b}" + (f"{extra:0{n}b}" if n else "")
                k = 1
                while k < 64 and rng.random() < 0.7:
                    run = int(rng.integers(0, 20))
                    if k + run > 63:
                        break
                    while run > 15:
                        bits += f"{0xF0:09b}"
                        k, run = k + 16, run - 16
                    n, extra = number_bits(int(rng.choice([-70, -1, 1, 3, 200])))
                    bits += f"{run << 4 | n:09b}{extra:0{n}b}"
                    k += run + 1
                if k < 64:
                    bits += f"{0:09b}"
    out += flush()
    table = bytes([0] * 8 + [255] + [0] * 7)  # 255 codes of nine bits
    q = 3
    head = b"\xff\xd8" + segment(0xFE, b"a comment") + segment(0xDB, b"\x00" + bytes([q] + [1] * 63))
    head += segment(0xC0, struct.pack(">BHHB", 8, height, width, len(sampling)) + b"".join(bytes([c + 1, h << 4 | v, 0]) for c, (h, v) in enumerate(sampling)))
    head += segment(0xC4, b"\x00" + table + bytes(range(255))) + segment(0xC4, b"\x10" + table + bytes(range(255)))
    if restart:
        head += segment(0xDD, struct.pack(">H", restart))
    head += segment(0xDA, bytes([len(sampling)]) + b"".join(bytes([c + 1, 0]) for c in range(len(sampling))) + b"\x00\x3f\x00")
    return head + out + b"\xff\xd9", dcs * q / 8 + 128


@pytest.mark.parametrize("sampling", [[(1, 1)], [(1, 1)] * 3, [(2, 2), (1, 1), (1, 1)], [(2, 1), (1, 1), (1, 1)]])
@pytest.mark.parametrize("restart", [0, 1, 3])
def test_decoder_on_any_baseline_file(sampling, restart):
    rng = np.random.default_rng(len(sampling) + restart)
    files = [encoded(rng, w, h, sampling, restart) for w, h in ((8, 8), (33, 20), (100, 50), (17, 64))]
    got = media.thumbnails([media.images(f)[0] for f, _ in files])
    for pixels, (_, want) in zip(got, files, strict=True):
        assert np.allclose(pixels, want[: pixels.shape[0], : pixels.shape[1]]) and pixels.shape[0] <= want.shape[0]


@pytest.mark.parametrize("order", [(0, 1, 2), (1, 0, 2), (2, 1, 0)])
@pytest.mark.parametrize("sampling", [[(1, 1)] * 3, [(2, 2), (1, 1), (1, 1)], [(2, 1), (1, 1), (1, 2)]])
def test_scans_of_their_own(sampling, order):
    """Each component in a scan of its own, in any order, with other tables between them."""
    rng = np.random.default_rng(sum(order[:2]))
    hs, vs = max(h for h, _ in sampling), max(v for _, v in sampling)
    for width, height in ((8, 8), (33, 20), (100, 50)):
        scans, want, head = {}, None, b""
        for c, (h, v) in enumerate(sampling):
            data, dcs = encoded(rng, -(-width * h // hs), -(-height * v // vs), [(1, 1)], 0)
            mark = segment(0xDA, b"\x01\x01\x00\x00\x3f\x00")
            at = data.rindex(mark)
            scans[c] = data[at + len(mark) : -2]
            if c == 0:
                want, head = dcs, data[:at]
        frame = head.index(b"\xff\xc0")
        tables = head[frame + 4 + 9 :]
        sizes = segment(0xC0, struct.pack(">BHHB", 8, height, width, 3) + b"".join(bytes([c + 1, h << 4 | v, 0]) for c, (h, v) in enumerate(sampling)))
        file = head[:frame] + sizes + b"".join(tables + segment(0xDA, bytes([1, c + 1, 0, 0, 63, 0])) + scans[c] for c in order) + b"\xff\xd9"
        (image,) = media.images(file)
        assert (image.width, image.height) == (width, height) and np.allclose(media.thumbnails([image])[0], want)


def test_feature_of_several_images(monkeypatch):
    monkeypatch.setattr(media, "ROWS", 4)
    raw = np.random.default_rng(0).integers(0, 256, 192 * 10, dtype=np.uint8)
    other = raw.copy()
    other[-192:] = other[-192:][::-1]
    hashes = ["-".join(media.difference_hash(t) for t in media.thumbnails(media.images(media.store(x, np.array([0, len(x)]))[0]))) for x in (raw, other)]
    assert hashes[0] != hashes[1] and hashes[0][:16] == hashes[1][:16]


@pytest.mark.parametrize("n", [1, 2, 191, 500])
def test_store_is_lossless(n):
    rng = np.random.default_rng(n)
    payloads = [rng.integers(0, 256, 192 * k, dtype=np.uint8) for k in (1, n, 3)]
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in payloads])])
    files = media.store(np.concatenate(payloads), offsets)
    thumbs = media.thumbnails([media.images(f)[0] for f in files])
    for p, t in zip(payloads, thumbs, strict=True):
        assert (np.rint(t).astype(np.uint8).reshape(-1) == p).all()


def test_long_payloads_take_several_images(monkeypatch):
    monkeypatch.setattr(media, "ROWS", 4)
    p = np.arange(192 * 10, dtype=np.int64).astype(np.uint8)
    (f,) = media.store(p, np.array([0, len(p)]))
    parts = media.thumbnails(media.images(f))
    assert [x.shape[0] for x in parts] == [4, 4, 2] and (np.rint(np.concatenate(parts)).astype(np.uint8).reshape(-1) == p).all()


def test_op1(spark, sf, documents):
    got = QUERIES["op1_media"](spark, sf).toPandas().set_index("doc_id")
    for r in documents.collect():
        raw = r["text"].encode()
        p = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        row = got.loc[r["doc_id"]]
        assert (row.n_bytes, row.payload_bytes, row.payload_sha256, row.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
        assert row.feature.startswith(f"1536x{len(p) // 24}:1:")


def test_edges(spark, edge, empty):
    out = media.jpeg_features(media.store_texts(edge)).toPandas()
    assert len(out) == 10 and out.media_error.isna().all() and sorted(out.thumbnail.map(lambda x: bytes(x).decode().rstrip(" "))) == sorted((r["text"] or "").rstrip(" ") for r in edge.collect())
    assert media.jpeg_features(media.store_texts(empty)).count() == 0
    good = media.store(np.zeros(192, np.uint8), np.array([0, 192]))[0]
    bad = spark.createDataFrame([(0, None), (1, b""), (2, b"no image"), (3, good), (4, good[:-40]), (5, good.replace(b"\xff\xc0", b"\xff\xc2"))], "width int, media binary").coalesce(1)
    got = media.jpeg_features(bad).toPandas()
    assert got.media_error.isna().sum() == 1 and got.n_images.notna().sum() == 1 and got.columns.tolist().count("width") == 1
