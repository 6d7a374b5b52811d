"""Streams of all kinds and depths, and words across the cuts of long streams."""

import base64
import bz2
import gzip
import lzma
import random
import zlib

import pytest

from lexigauge.llm import secrets

SECRET = "password=hunter2hunter2"


def spans(text):
    return secrets.scan(text)[1]


def deflated(data, wbits):
    c = zlib.compressobj(9, zlib.DEFLATED, wbits)
    return c.compress(data) + c.flush()


@pytest.mark.parametrize(
    "pack",
    [gzip.compress, zlib.compress, lambda d: deflated(d, 9), lambda d: deflated(d, 12), bz2.compress, lzma.compress, lambda d: deflated(d, -15), lambda d: gzip.compress(bz2.compress(zlib.compress(d))), lambda d: zlib.compress(d, 0)],
)
def test_streams(pack):
    word = base64.b64encode(pack(SECRET.encode())).decode()
    text = f"see {word} there"
    assert any(k == "assign" and a <= 4 and b >= 4 + len(word.rstrip("=")) - 1 for k, a, b in spans(text))
    assert not spans(f"see {base64.b64encode(pack(b'nothing in here at all')).decode()} there")


@pytest.mark.parametrize("depth", [1, 17, 18, 40, 300])
def test_any_depth(depth):
    data = SECRET.encode()
    for _ in range(depth):
        data = zlib.compress(data, 0) if depth > 40 else gzip.compress(data)
    assert any(k == "assign" for k, *_ in spans(base64.b64encode(data).decode()))


def test_words_of_words():
    text = SECRET
    for _ in range(9):
        text = base64.b64encode(gzip.compress(text.encode())).decode()
    assert any(k == "assign" for k, *_ in spans("x " + text))


def test_a_stream_that_holds_itself_ends(monkeypatch):
    """Inflating gives the same bytes again."""

    class Same:
        eof, unconsumed_tail = False, b""

        def decompress(self, data, most):
            self.eof = True
            return data

        def flush(self):
            return b""

    monkeypatch.setattr(secrets, "_unpacker", lambda data: Same())
    assert list(secrets._inflated(b"\x1f\x8bsame")) == []


@pytest.mark.parametrize("pack", [gzip.compress, bz2.compress])
def test_parts_of_long_streams(monkeypatch, pack):
    """All parts are read, a secret or a long base64 word across a cut is whole, and levels of streams go on."""
    monkeypatch.setattr(secrets, "INFLATED", 5000)
    monkeypatch.setattr(secrets, "OVERLAP", 100)
    rnd = random.Random(1)
    noise = lambda n: " ".join(str(rnd.randint(0, 99)) for _ in range(n))
    inner = base64.b64encode(bytes(rnd.randrange(256) for _ in range(6000)) + b" " + SECRET.encode() + b" " + bytes(rnd.randrange(256) for _ in range(3000))).decode()
    for n in (1200, 1600, 1663, 3000):
        for content in (f"{noise(n)} {SECRET} {noise(n)}", f"{noise(n)} {inner} {noise(40)}"):
            for data in (pack(content.encode()), gzip.compress(pack(content.encode()) + bytes(9000))):
                assert any(k == "assign" for k, *_ in spans(base64.b64encode(data).decode())), n


def test_broken_streams_say_what_they_hold():
    data = gzip.compress((SECRET + " " + "x" * 10).encode() * 50)
    for cut in (len(data) - 3, len(data) - 8):
        assert spans(base64.b64encode(data[:cut]).decode())
    for junk in (b"\x1f\x8b", b"BZh9", b"\xfd7zXZ\0", b"\x78\x9c", b"BZh9" + bytes(40), b"\x78\x9c" + bytes(40)):
        assert spans(base64.b64encode(junk.ljust(30, b"z")).decode()) == []
