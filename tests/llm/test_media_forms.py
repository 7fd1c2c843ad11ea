"""Stored forms of payload columns."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from mattelake.llm import media, webp


def payloads():
    rng = random.Random(8)
    words = [f"w{k}" for k in range(300)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([12, 40, 300, 2500]))) for _ in range(80)]
    return [media.padded(t.encode()) for t in [*texts, "x" * 9000, "ab" * 700, "é" * 63, ""]]


def test_every_payload_is_stored_by_transforms(monkeypatch):
    """Each image undoes a predictor, cross-colour or palette, or has several prefix-code groups."""
    seen, real = Counter(), webp._pixels_serial
    monkeypatch.setattr(webp, "_pixels_serial", lambda *a: seen.update(several=len(a[1]) > 1) or real(*a))
    for p in payloads():
        argb, undo = webp._parsed(media.encode_payload(p))
        seen.update([media.form_of(p)])
        assert {"predictor": webp.PREDICTOR, "cross": webp.CROSS, "palette": webp.PALETTE}.get(media.form_of(p), -1) in [u[0] for u in undo] or media.form_of(p) == "groups" or len(p) == 64
        assert media.form_of(p) or len(p) == 64
    assert min(seen[f] for f in media.FORMS) >= 8 and seen["several"] >= 8


def test_batches_decode_like_single_images(monkeypatch):
    monkeypatch.setattr(media, "PIXELS_AT_ONCE", 5000)
    monkeypatch.setattr(media, "PART", 6400)
    own = payloads()
    stored = [media.encode_payload(p) for p in own]
    assert any(len(media._files(m)) > 1 for m in stored)
    for p, m, images in zip(own, stored, media.decode_payloads(stored), strict=True):
        assert b"".join(i.tobytes() for i in images) == p
        assert all((a == b).all() for a, b in zip(images, media.decode_payload(m), strict=True))
    assert list(media.decode_payloads([])) == []


def test_references_reach_far_and_up():
    rng = np.random.default_rng(2)
    row = rng.integers(0, 2**32, 40, dtype=np.uint32)
    img = np.concatenate([row, rng.integers(0, 2**32, 400, dtype=np.uint32), row, row]).reshape(-1, 40)
    copies = webp._matches(img.ravel(), 40, 3)
    assert copies == [(440, 40, 440), (480, 40, 40)]
    assert (webp.decode(webp.encode(img)) == img).all() and len(webp.encode(img)) < 4 * 440 + 1500


def test_code_lengths_by_repeats_across_windows():
    """Repeat tokens of all kinds, which the own encoder does not write, with their extra bits at any place of a window."""
    inner = np.zeros(19, np.int64)
    inner[[8, 16, 17, 18]] = 2
    code, size = webp.codes(inner), dict.fromkeys((8, 16, 17, 18), 2)
    w, left = webp.Writer(), 255
    w.many(np.array([0, 19 - 4]), np.array([1, 4]))
    w.many(inner[list(webp.LENGTH_ORDER)], np.full(19, 3))
    w.put(0, 1)
    tokens = [(8, 0, 0)]
    while left:
        n = min(3 + left % 4, left) if left > 8 else min(left, 6) if left in (3, 4, 5, 6) else 3 if left > 5 else 0
        tokens.append((16, n - 3, 2) if n else (8, 0, 0))
        left -= n or 1
    for k, extra, more in [*tokens, (17, 7, 3), (18, 3, 7)]:
        w.put(int(code[k]), size[k])
        w.put(extra, more)
    bits = webp.Bits(w.bytes())
    got = webp._read_code(bits, 280)
    assert (got.table == webp.Code(np.concatenate([np.full(256, 8), np.zeros(24, np.int64)])).table).all()
    assert 0 <= bits.end - bits.at < 8


def test_batches_are_written_and_read_side_by_side(monkeypatch):
    """No image of a batch is read pixel by pixel on its own, and a payload's bytes do not depend on its batch."""
    own = payloads()
    alone = [media.encode_payload(p) for p in own]
    assert hashlib.sha256(b"".join(alone)).hexdigest() == "45556809c96850c0ce70066c70888a5ca340df9c651d287fd0a922dbb31e1bd7"
    assert media.encode_payloads(own) == alone and media.encode_payloads([]) == []
    monkeypatch.setattr(media, "WRITTEN_AT_ONCE", 3000)
    monkeypatch.setattr(media, "PART", 6400)
    assert media.encode_payloads(own) == [media.encode_payload(p) for p in own]
    monkeypatch.setattr(webp, "_pixels_serial", None)
    for few in (2, 64):
        monkeypatch.setattr(webp, "FEW", few)
        for p, images in zip(own, media.decode_payloads(alone), strict=True):
            assert b"".join(i.tobytes() for i in images) == p


def test_all_code_lengths_are_those_of_each_row():
    rng = np.random.default_rng(3)
    tally = rng.integers(0, 4, (60, 90)) ** 3 * (rng.random((60, 90)) < rng.random((60, 1)))
    tally[0], tally[1], tally[2] = 0, np.arange(90) == 7, 0
    tally[2, :30] = [int(1.7**k) for k in range(30)]
    longest = np.where(np.arange(60) % 2, 7, 11)
    want = np.stack([webp.code_lengths(t, m) for t, m in zip(tally, longest.tolist())])
    assert (webp.all_code_lengths(tally, longest) == want).all()


def test_a_broken_image_in_a_batch_is_an_error():
    stored = [media.encode_payload(p) for p in payloads()]
    for i, m in enumerate(stored):
        cut = m[: len(m) * 2 // 3]
        for batch in ([cut], [*stored[:i], cut, *stored[i + 1 :]]):
            with pytest.raises((webp.WebPError, IndexError)):
                webp.decode_many(batch)
        if i % 30 == 0:
            for k in range(30, len(m), 97):
                bad = bytearray(m)
                bad[k] ^= 255
                try:
                    one = webp.decode(bytes(bad))
                except (webp.WebPError, IndexError):
                    one = None
                try:
                    many = webp.decode_many([*stored[: i + 1], bytes(bad)])[-1]
                except (webp.WebPError, IndexError):
                    many = None
                assert (one is None) == (many is None) and (one is None or (one == many).all())


def test_last_symbols_without_bits():
    """A group's only colour takes no bits, so an image's last pixels may follow its last bit."""
    rng = np.random.default_rng(5)
    files, images = [], []
    for n in range(70):
        img = rng.integers(0, 2**32, (16, 16), dtype=np.uint32)
        img[8:, 8:] = 7
        groups = np.zeros((2, 2), np.int64)
        groups[1, 1] = 1
        img[8:, :8] = img[8:, :8] if n % 2 else img[0, 0]
        images.append(img if n % 3 else np.full((4 + n % 5, 8), n, np.uint32))
        files.append(webp.encode(images[-1], groups=groups, references=False) if n % 3 else webp.encode(images[-1], references=n % 2 == 0, cache_bits=n % 4))
    for got, img in zip(webp.decode_many(files), images, strict=True):
        assert (got == img).all()
