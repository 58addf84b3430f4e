import hashlib
import io
import zlib

import numpy as np
import pytest

from facetry.llm import media


def test_round_trips():
    image = np.random.RandomState(0).randint(0, 256, (5, 7, 3)).astype(np.uint8)
    assert (media.decode(media.encode_ppm(image)) == image).all()
    assert (media.decode(media.encode_bmp(image)) == image).all()


def test_plain_and_packed_netpbm():
    assert media.decode(b"P2\n# c\n2 2\n255\n1 2\n3 4\n")[:, :, 0].tolist() == [[1, 2], [3, 4]]
    assert media.decode(b"P1 3 1 1 0 1")[:, :, 0].tolist() == [[0, 1, 0]]
    assert media.decode(b"P4\n3 2\n\xa0\x40")[:, :, 0].tolist() == [[0, 1, 0], [1, 0, 1]]
    assert media.decode(b"P5 1 1 65535\n\x01\x02")[0, 0, 0] == 258


@pytest.mark.parametrize("raw", [b"", b"P6 2 2 255\n123", b"BM", b"P5 0 1 255\n", b"PX"])
def test_broken_media(raw):
    with pytest.raises(ValueError):
        media.decode(raw)


def test_area_resize_is_the_mean_of_areas():
    image = np.random.RandomState(1).randint(0, 256, (12, 8, 1))
    want = image.reshape(3, 4, 4, 2, 1).mean(axis=(1, 3))
    assert np.allclose(media.area_resize(image, 3, 4), want)
    # fractional cuts: every pixel counts with its share
    fine = np.repeat(np.repeat(image, 5, 0), 3, 1)
    assert np.allclose(media.area_resize(image, 5, 3), fine.reshape(5, 12, 3, 8, 1).mean(axis=(1, 3)))


def areas(size, count):
    """How much of each of ``size`` pixels each of ``count`` equal parts covers."""
    return np.array([[max(0.0, min(i + 1, (k + 1) * size / count) - max(i, k * size / count)) for i in range(size)] for k in range(count)])


def described(image):
    """Tile and hash by the shares of every source pixel in every target pixel."""
    rows, columns, _ = image.shape
    mean = lambda h, w: np.einsum("hr,rcx,wc->hwx", areas(rows, h), image.astype(float), areas(columns, w)) / (rows / h * columns / w)
    grey = np.rint(mean(8, 9).sum(axis=2) * 1024)
    bits = "".join(str(int(grey[i, j] < grey[i, j + 1])) for i in range(8) for j in range(8))
    return np.rint(mean(8, 8)), f"{int(bits, 2):016x}"


def test_deep_samples_fit_tiles():
    image = media.decode(b"P5 2 2 65535\n" + b"\xff\xff" * 4)
    assert (np.load(io.BytesIO(media.tile(image))) == 255).all()


def test_query_columns_by_brute_force(spark, frame):
    rows = [(1, "abc"), (2, None), (3, ""), (4, "é" * 500), (4, "é" * 500), (None, "x" * 192), (7, "long " * 20000)]
    got = {(r["doc_id"], r["n_bytes"]): r for r in media.stored_texts(frame(rows)).collect()}
    for k, text in rows:
        raw = (text or "").encode()
        padded = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        r = got[k, len(raw)]
        assert r["payload_bytes"] == len(padded) and r["payload_sha256"] == hashlib.sha256(padded).hexdigest()
        assert r["tail_crc32"] == zlib.crc32(padded[-16:])
        stored = b"P6\n64 %d\n255\n" % (len(padded) // 192) + padded
        assert r["media_sha256"] == hashlib.sha256(stored).hexdigest() and r["media_bytes"] == len(stored)
        small, feature = described(np.frombuffer(padded, np.uint8).reshape(-1, 64, 3))
        assert (np.load(io.BytesIO(bytes(r["tile_npy"]))) == small).all() and r["feature"] == feature
    assert media.stored_texts(frame([])).count() == 0


def test_media_columns(spark):
    image = np.zeros((3, 3, 3), np.uint8)
    rows = media.media_columns(spark.createDataFrame([(1, media.encode_bmp(image)), (2, b"no"), (3, None)], "id long, media binary")).collect()
    assert [(r["height"], r["feature"]) for r in rows] == [(3, "0" * 16), (None, None), (None, None)]
