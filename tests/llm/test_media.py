import hashlib
import io
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textlode.llm import media

RND = np.random.default_rng(1)


def bmp(picture, depth, up=True):
    h, w, _ = picture.shape
    rows = picture[::-1] if up else picture
    body = b"".join((r[:, ::-1].tobytes() if depth == 24 else np.hstack([r[:, ::-1], r[:, :1]]).tobytes()).ljust((w * depth // 8 + 3) // 4 * 4, b"\0") for r in rows)
    return b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h if up else -h, 1, depth, 0, len(body), 0, 0, 0, 0) + body


def test_netpbm_forms():
    grey = RND.integers(0, 256, (3, 5, 1), dtype="u1")
    rgb = RND.integers(0, 256, (2, 3, 3), dtype="u1")
    assert (media.decode(b"P5\n# note\n5 3\n255\n" + grey.tobytes()) == grey).all()
    assert (media.decode(media.encode_ppm(rgb)) == rgb).all()
    assert (media.decode(b"P2 5 3 255\n" + " ".join(map(str, grey.ravel())).encode()) == grey).all()
    assert (media.decode(b"P3\n3 2\n255\n" + b" ".join(b"%d" % x for x in rgb.ravel())) == rgb).all()
    assert media.decode(b"P1\n3 1\n101\n").ravel().tolist() == [0, 255, 0]
    assert media.decode(b"P4\n3 2\n\xa0\x40").ravel().tolist() == [0, 255, 0, 255, 0, 255]
    assert media.decode(b"P5 1 1 65535\n\x12\x34").ravel().tolist() == [0x1234]


def test_bmp_forms():
    rgb = RND.integers(0, 256, (4, 3, 3), dtype="u1")
    assert (media.decode(bmp(rgb, 24)) == rgb).all() and (media.decode(bmp(rgb, 24, up=False)) == rgb).all()
    assert (media.decode(bmp(rgb, 32)) == rgb).all()


def palette_bmp(pixels, colours):
    body = b"".join(bytes(r).ljust((len(r) + 3) // 4 * 4, b"\0") for r in pixels[::-1])
    head = struct.pack("<IiiHHIIiiII", 40, len(pixels[0]), len(pixels), 1, 8, 0, len(body), 0, 0, len(colours), 0)
    table = b"".join(bytes([b, g, r, 0]) for r, g, b in colours)
    return b"BM" + struct.pack("<IHHI", 54 + len(table) + len(body), 0, 0, 54 + len(table)) + head + table + body


def masked_bmp(words, masks):
    body = b"".join(struct.pack("<I", w) for w in words)
    head = struct.pack("<IiiHHIIiiII", 40, len(words), 1, 1, 32, 3, len(body), 0, 0, 0, 0) + struct.pack("<III", *masks)
    return b"BM" + struct.pack("<IHHI", 66 + len(body), 0, 0, 66) + head + body


def test_scaled_samples_palettes_and_masks():
    assert media.decode(b"P5 3 1 15\n\x00\x07\x0f").ravel().tolist() == [0, 119, 255]
    assert media.decode(b"P2 2 1 1000 0 1000").ravel().tolist() == [0, 65535]
    assert media.decode(palette_bmp([[0, 1], [1, 0]], [(1, 2, 3), (9, 8, 7)])).tolist() == [[[1, 2, 3], [9, 8, 7]], [[9, 8, 7], [1, 2, 3]]]
    assert media.decode(masked_bmp([0x00112233], (0xFF0000, 0xFF00, 0xFF))).ravel().tolist() == [0x11, 0x22, 0x33]
    assert media.decode(masked_bmp([0x3FF], (0x3FF, 0x3FF << 10, 0x3FF << 20))).ravel().tolist() == [255, 0, 0]


#: Each of a known form, and broken in its own way.
MALFORMED = [
    b"P2 1 1 65535 70000", b"P2 1 1 255 256", b"P2 1 1 255 -1", b"P2 1 1 255 x", b"P2 1 1 255 99999999999999999999", b"P2 0 0 255 ", b"P5 0 3 255\n", b"P5 2 2 0\nabcd",
    b"P5 2 2 70000\nabcd", b"P5 1 1 15\n\xff", b"P6\n2 2\n255\nx", b"P5\nx", b"P4 9 2\n\xff", b"P1 2 2 101", b"P6 99999999 99999999 255\n", b"P3 999999999999 1 255\n1",
    b"P5 1 1", b"P5", b"BM" + bytes(60), b"BM" + bytes(52), palette_bmp([[0, 5]], [(1, 2, 3)]), palette_bmp([[0]], []), masked_bmp([7], (0, 0, 0)), masked_bmp([7], (1, 2, 4))[:58],
    bmp(RND.integers(0, 256, (4, 3, 3), dtype="u1"), 24)[:-5], b"BM" + struct.pack("<IHHI", 54, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, -3, 2, 1, 24, 0, 0, 0, 0, 0, 0),
    b"BM" + struct.pack("<IHHI", 54, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 0, 0, 1, 24, 0, 0, 0, 0, 0, 0),
]


@pytest.mark.parametrize("data", [b"", b"GIF89a", *MALFORMED])
def test_unreadable(data):
    with pytest.raises(ValueError):
        media.decode(data)


@settings(max_examples=300, deadline=None)
@given(st.sampled_from([b"P1", b"P2", b"P3", b"P4", b"P5", b"P6", b"BM"]), st.binary(max_size=90))
def test_any_bytes_decode_or_raise_value_error(magic, rest):
    try:
        assert media.decode(magic + rest).ndim == 3
    except ValueError:
        pass


def test_tiles_of_malformed_media(spark):
    rows = [(i, bytearray(d)) for i, d in enumerate(MALFORMED)] + [(99, bytearray(b"P5 1 1 255\na"))]
    got = media.tiles(spark.createDataFrame([(i, d, 1) for i, d in rows], "doc_id long, media binary, height int")).collect()
    assert {r.doc_id for r in got if r.npy is not None} == {99} and len(got) == len(rows)


def test_area_resize_is_the_mean_over_areas():
    plane = RND.random((7, 11))
    fine = np.kron(plane, np.ones((8, 9)))  # every target pixel covers whole cells of this
    want = fine.reshape(8, 7, 9, 11).mean(axis=(1, 3))
    assert np.allclose(media.area_resize(plane, 8, 9), want)
    assert np.allclose(media.area_resize(plane, 7, 11), plane)
    assert np.allclose(media.area_resize(np.full((1, 1), 5.0), 8, 9), 5.0)
    assert media.difference_hash(np.full((1, 1, 3), 9, "u1")) == "0" * 16


def test_difference_hash_and_tiles():
    ramp = np.tile(np.arange(90, dtype="u1"), (80, 1))[:, :, None]
    assert media.difference_hash(ramp) == "f" * 16 and media.difference_hash(ramp[:, ::-1]) == "0" * 16
    tiles = media.npy_tiles(ramp, 64)
    assert [t[:2] for t in tiles] == [(0, 0), (0, 1), (1, 0), (1, 1)]
    back = [np.load(io.BytesIO(t[2])) for t in tiles]
    assert np.vstack([np.hstack(back[:2]), np.hstack(back[2:])]).tolist() == ramp.tolist()


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=700))
def test_payload_round_trip(text):
    payload, n = media.payload_of(text)
    raw = text.encode()
    assert n == len(raw) and len(payload) % 192 == 0 and len(payload) >= 192 and len(payload) - n < 192 + (n == 0)
    stored = media.encode_ppm(np.frombuffer(payload, "u1").reshape(-1, 64, 3))
    assert media.decode(stored).tobytes() == payload == raw + b" " * (len(payload) - n)


def test_rows(spark):
    texts = [None, "", "a" * 192, "é" * 97, "x" * 100_000, "a" * 192]
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, media string")
    got = {r.doc_id: r for r in media.digests(docs).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-16:])
    assert tuple(got[2])[1:] == tuple(got[5])[1:] and tuple(got[0])[1:] == tuple(got[1])[1:]
    pictures = media.text_pictures(docs)
    made = media.tiles(pictures).filter("doc_id = 3").collect()
    assert [np.load(io.BytesIO(r.npy)).shape for r in made] == [(2, 64, 3)]
    odd = spark.createDataFrame([(1, None), (2, bytearray(b"junk"))], "doc_id long, media binary")
    assert [r.npy for r in media.tiles(odd).collect()] == [None, None]
    assert media.digests(docs.limit(0)).count() == 0
