import hashlib
import zlib

import numpy as np
import pytest

from tidewater.llm import media

from .fixtures import AWKWARD, frame


def test_op1_against_brute_force(spark):
    got = {r.doc_id: r for r in media.media_features(media.store_texts(frame(spark, AWKWARD))).collect()}
    assert len(got) == len(AWKWARD)
    for k, text in enumerate(AWKWARD):
        raw = (text or "").encode()
        pay = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        r = got[k]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-32:]))
        stored = media.npy(np.frombuffer(pay, np.uint8).reshape(-1, 24, 24))
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())


def test_no_rows(spark):
    assert media.media_features(media.store_texts(frame(spark, []))).count() == 0


@pytest.mark.parametrize("shape", [(1, 1), (7, 5), (24, 24), (50, 33)])
def test_formats_hold_the_same_samples(shape):
    image = np.random.default_rng(1).integers(0, 256, shape, np.uint8)
    assert (media.decode(media.bmp(image)) == image).all()
    assert (media.decode(media.netpbm(image)) == image).all()
    assert (media.from_npy(media.npy(media.tiles(image)))[0][: min(24, shape[0]), : min(24, shape[1])] == image[:24, :24]).all()


def test_other_netpbm_kinds():
    assert media.decode(b"P1\n# c\n2 2\n1 0\n0 1\n").tolist() == [[0, 255], [255, 0]]
    assert media.decode(b"P4\n2 2\n\x80\x40").tolist() == [[0, 255], [255, 0]]
    assert media.decode(b"P2 2 1 15\n0 15").tolist() == [[0, 255]]
    assert media.decode(b"P3 1 1 255\n1 2 3").tolist() == [[[1, 2, 3]]]
    assert media.decode(b"P6 1 1 255\n\x01\x02\x03").tolist() == [[[1, 2, 3]]]
    assert media.decode(b"P5 1 1 65535\n\xff\xff").tolist() == [[255]]


@pytest.mark.parametrize("shape", [(3, 4), (8, 9), (100, 24), (71, 53)])
def test_area_resize_against_sums(shape, monkeypatch):
    monkeypatch.setattr(media, "BAND", 16)
    image = np.random.default_rng(2).integers(0, 256, shape, np.uint8)

    def weights(size, parts):
        edges = np.linspace(0, size, parts + 1)
        return np.array([[max(0, min(b, i + 1) - max(a, i)) for i in range(size)] for a, b in zip(edges, edges[1:])])

    want = weights(shape[0], 8) @ image @ weights(shape[1], 9).T / (shape[0] / 8 * shape[1] / 9)
    assert np.allclose(media.area_resize(image, 8, 9), want)
