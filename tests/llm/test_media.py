"""Lossless WebP and the media columns: exact round trips of every feature of the format, and broken streams."""

import hashlib
import struct
import zlib

import numpy as np
import pytest

from polyloom.llm import media, queries, webp

from .conftest import AWKWARD


def images(seed):
    r = np.random.default_rng(seed)
    wild = [r.integers(0, 2**32, (h, w), dtype=np.uint32) for h, w in ((1, 1), (4, 16), (7, 5), (40, 16))]
    few = [(r.integers(0, k, (h, w)) * 0x10204).astype(np.uint32) for k, h, w in ((1, 3, 3), (2, 7, 9), (4, 9, 33), (16, 20, 17), (200, 20, 20))]
    return wild + few + [(np.add.outer(np.arange(20), np.arange(17)) * 0x010203).astype(np.uint32), np.tile(wild[1], (9, 1))]


@pytest.mark.parametrize(
    "options",
    [{}, {"cache_bits": 0}, {"cache_bits": 11}, {"palette": 0}, {"palette": 256}, {"least": 0}, {"least": 2}]
    + [{"transforms": t, "palette": p, "block": b} for t in ((0,), (1,), (2,), (0, 1, 2), (2, 1, 0)) for p in (0, 16) for b in (2, 4)],
)
def test_round_trip(options):
    own = images(len(str(options)))
    for a, b in zip(own, webp.decode(webp.encode(own, **options)), strict=True):
        assert a.shape == b.shape and (a == b).all()


def plain_inverse(pixels, w, h, size, modes):
    """The predictor undone pixel by pixel, from the specification."""
    c = webp._channels(pixels).reshape(h, w, 4)
    for y in range(h):
        for x in range(w):
            if x and y:
                f = c.reshape(-1, 4)
                at = y * w + x
                guess = webp.predict(int(modes[(y >> size) * ((w + (1 << size) - 1) >> size) + (x >> size)] >> 8 & 15), f[at - 1], f[at - w], f[at - w + 1], f[at - w - 1])
            else:
                guess = c[y, x - 1] if x else c[y - 1, x] if y else np.array([255, 0, 0, 0])
            c[y, x] = (c[y, x] + guess) & 255
    return webp._pixels(c.reshape(-1, 4))


@pytest.mark.parametrize("known", [(0, 1, 2, 14), tuple(range(16))])
def test_inverse_predictors_equal_the_plain_form(known):
    r = np.random.default_rng(len(known))
    jobs = []
    for w, h, size in ((16, 40, 4), (16, 3, 4), (16, 1, 4), (5, 9, 2), (1, 20, 3), (16, 33, 2)):
        n = -(-w // (1 << size)) * -(-h // (1 << size))
        jobs.append((r.integers(0, 2**32, w * h, dtype=np.uint32), w, h, size, (r.choice(known, n) << 8).astype(np.uint32)))
    for job, got in zip(jobs, webp.inverse_predictors(jobs), strict=True):
        assert (got == plain_inverse(*job)).all()
        assert (webp.forward_predictor(got, *job[1:]) == job[0]).all()


def test_chosen_transforms_round_trip_and_depend_on_the_image_alone():
    r = np.random.default_rng(9)
    ramp = (np.add.outer(np.arange(64), np.arange(16)) * 0x01010101).astype(np.uint32)
    green = r.integers(0, 256, (48, 16)).astype(np.uint32)
    grey = green << 16 | green << 8 | green | 0xFF000000
    text = [x for x in media.tiles(media.payload(("the quick brown fox " * 40 + "äöü 你好 ").encode() * 3))]
    own = [ramp, grey, *text, r.integers(0, 2**32, (17, 16), dtype=np.uint32)]
    files = webp.encode(own, transforms=None, block=4)
    for a, b in zip(own, webp.decode(files), strict=True):
        assert (a == b).all()
    assert files == [webp.encode([x], transforms=None, block=4)[0] for x in own]
    _, modes, factors = webp.chosen_transforms([x.ravel() for x in own[:2]], np.array([16, 16]), np.array([64, 48]), 4)
    assert set(modes[0] >> 8) <= {1, 2} and factors[1].any()  # a ramp is predicted, grey is green alone


def test_predictors_by_the_definition():
    left, top, top_right, top_left = (np.array(x) for x in ([10, 20, 30, 40], [50, 60, 70, 80], [90, 100, 110, 120], [130, 140, 150, 160]))
    assert webp.predict(0, left, top, top_right, top_left).tolist() == [255, 0, 0, 0]
    assert [webp.predict(m, left, top, top_right, top_left)[0] for m in range(1, 14)] == [10, 50, 90, 130, 50, 70, 30, 90, 70, 70, 10, 0, 0]


def hand_made(tokens, w, h):
    """A stream of (value, bits)."""
    n, value = 0, 0
    for v, k in [(w - 1, 14), (h - 1, 14), (1, 1), (0, 3), *tokens]:
        value |= v << n
        n += k
    body = b"/" + value.to_bytes((n + 7) // 8, "little")
    body += b"\0" * (len(body) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(body)) + b"WEBPVP8L" + struct.pack("<I", len(body)) + body


def simple(*symbols):
    return [(1, 1), (len(symbols) - 1, 1), (1, 1), *((s, 8) for s in symbols)]


def test_hand_made_streams():
    """Written bit by bit from the specification: simple codes of one and two symbols, groups of codes by an entropy image."""
    plain = [(0, 1), (0, 1), (0, 1), *simple(7, 9), *simple(1), *simple(2), *simple(255), *simple(0), (0, 1), (1, 1), (1, 1), (0, 1)]
    assert webp.decode([hand_made(plain, 2, 2)])[0].tolist() == [[0xFF010702, 0xFF010902], [0xFF010902, 0xFF010702]]
    entropy = [(0, 1), *simple(0, 1), *simple(0), *simple(0), *simple(0), *simple(0), (0, 1), (1, 1)]
    group = [*simple(5), *simple(1), *simple(2), *simple(255), *simple(0)], [*simple(6), *simple(3), *simple(4), *simple(255), *simple(0)]
    both = [(0, 1), (0, 1), (1, 1), (0, 3), *entropy, *group[0], *group[1]]
    assert webp.decode([hand_made(both, 8, 1)])[0].tolist() == [[0xFF010502] * 4 + [0xFF030604] * 4]


def test_broken_streams():
    good = webp.encode(images(1)[3:4])[0]
    for bad in (b"", b"RIFFxxxxWEBPVP8 ", good[:60], good[:20] + b"x" + good[21:]):
        with pytest.raises(webp.Broken):
            webp.decode([bad])


def test_query(spark, sf):
    rows = {r.doc_id: r for r in queries.op9_media_columns(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(docs) == len(rows)
    for d in docs:
        data = (d.text or "").encode()
        whole = data + bytes(-len(data) % 64) if data else bytes(64)
        r = rows[d.doc_id]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-64:]))
    by = {}
    for d in docs:
        by.setdefault(d.text, set()).add((rows[d.doc_id].media_sha256, rows[d.doc_id].feature))
    assert all(len(x) == 1 for x in by.values())


def test_awkward(awkward, nothing):
    rows = {r.doc_id: r for r in media.media_columns(awkward).collect()}
    assert len(rows) == len(AWKWARD) and rows[0].media == rows[1].media and rows[0].payload_bytes == 64
    for i, t in enumerate(AWKWARD):
        assert media.load([bytes(rows[i].media)])[0][0] == media.payload((t or "").encode())
        assert hashlib.sha256(rows[i].media).hexdigest() == rows[i].media_sha256 and len(rows[i].media) == rows[i].media_bytes
    assert media.media_columns(nothing).count() == 0
