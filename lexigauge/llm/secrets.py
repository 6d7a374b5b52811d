"""Secret scan with a worklist that unwraps nested encodings.

A text is a layer. In every layer the scanner looks for the base kinds and then
unwraps it: percent escapes and Unicode escapes (backslash u, x and U, numeric
character references) are decoded in place, so a secret that is plain in part is
found; base64 words that stand for plain text are decoded in place too; and every
base64 word of 16 characters or more, also one that is wrapped over lines, is
decoded by itself. Its bytes are read as UTF-8, where bytes that aren't keep a
place of their own, as UTF-16 where every other byte is nearly always zero, and
inflated, as often as it takes, if they are a gzip, zlib, bzip2 or xz stream, or a
deflated one without header that holds text; a stream that holds itself ends.

Each unwrapped layer goes on the worklist, until nothing is left to unwrap. A
layer with the content and the place of one seen before in this text is not
scanned again, which ends cycles; the same content in another place is. Every
layer keeps, for each of its characters, the start and end in the original text
it comes from, so a finding in any depth maps to a span of the original.

Memory is bounded: layers are unwrapped one at a time, depth first, and a stream
is inflated ``INFLATED`` bytes at a time, each part scanned with the last
``OVERLAP`` characters of the part before it, and with all of a base64 word that
goes on. All of it is read.

Base spans are those of the original text and always stay; spans from deeper
layers are added unless equal to one that is there. A null text counts as empty
and gives no spans. Rows are judged one by one; nothing is shuffled.
"""

from __future__ import annotations

import base64
import bz2
import lzma
import re
import string
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  # of AKIA[A-Z0-9]+ those with 18 characters or more
HEX = re.compile(r"[0-9a-f]{16,}")
ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|x([0-9A-Fa-f]{2})|U([0-9A-Fa-f]{8})|u\{([0-9A-Fa-f]{1,6})\})|&#(?:[xX]([0-9A-Fa-f]{1,6})|([0-9]{1,7}));")
PERCENTS = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}(?:\r?\n[ \t]*[A-Za-z0-9+/_-]{16,})*\r?\n[ \t]*[A-Za-z0-9+/_-]+={0,2}")
#: A base64 word whose bytes may all be printable ASCII, by the first character of each four.
PLAIN64 = re.compile(r"(?<![A-Za-z0-9+/_=-])(?:[I-Za-f][A-Za-z0-9+/]{3})+(?:[I-Za-f][A-Za-z0-9+/]={0,2}|[I-Za-f][A-Za-z0-9+/]{2}=?)?(?![A-Za-z0-9+/_=-])")
INFLATED, OVERLAP = 1 << 24, 1 << 16
BLANKS = dict.fromkeys(b"\t\n\r", " ")
WORD64 = string.ascii_letters + string.digits + "+/_=-"


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    return out + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


@dataclass
class Layer:
    """at[i], to[i]: the span of the original text that character i comes from."""

    text: str
    at: np.ndarray
    to: np.ndarray


def _within(x: Layer, found: list[tuple[int, int, str, np.ndarray, np.ndarray]]) -> Layer:
    """The layer with parts (start, end, new text, at, to) put in place of what they stand for."""
    s, at, to, i = [], [], [], 0
    for a, b, new, p, q in found:
        s += (x.text[i:a], new)
        at += (x.at[i:a], p)
        to += (x.to[i:a], q)
        i = b
    return Layer("".join(s) + x.text[i:], np.concatenate([*at, x.at[i:]]), np.concatenate([*to, x.to[i:]]))


def _text_of(data: bytes, at: np.ndarray, to: np.ndarray) -> Layer:
    """Bytes and their spans as characters and theirs; a byte that isn't UTF-8 is a character."""
    s = data.decode("utf-8", "surrogateescape")
    if len(s) == len(data):
        return Layer(s, at, to)
    c = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)
    size = 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000) - 2 * ((c >= 0xDC80) & (c <= 0xDCFF))
    end = np.cumsum(size)
    return Layer(s, at[end - size], to[end - 1])


def _wide(data: bytes, at: np.ndarray, to: np.ndarray) -> Layer | None:
    """UTF-16 text: nearly all of its high bytes are zero, or it starts with a mark."""
    b = np.frombuffer(data[: len(data) & ~1], np.uint8).reshape(-1, 2)
    if len(b) < 4:
        return None
    zero = (b == 0).mean(0)
    order = "le" if data[:2] == b"\xff\xfe" or zero[1] > 0.6 > zero[0] else "be" if data[:2] == b"\xfe\xff" or zero[0] > 0.6 > zero[1] else None
    if order is None:
        return None
    s = "".join(map(chr, b.view("<u2" if order == "le" else ">u2")[:, 0].tolist()))
    return Layer(s, at[0 : 2 * len(s) : 2], to[1 : 2 * len(s) : 2])


def _unpacker(data: bytes):
    """What inflates a stream that starts like this (a function of bytes, with ``eof``), or None: gzip, zlib with any window, bzip2, xz."""
    if data[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    if data[:3] == b"BZh" and data[3:4].isdigit():
        return bz2.BZ2Decompressor()
    if data[:6] == b"\xfd7zXZ\0":
        return lzma.LZMADecompressor()
    if len(data) > 2 and data[0] & 15 == 8 and data[0] >> 4 < 8 and (data[0] << 8 | data[1]) % 31 == 0 and not data[1] & 32:
        return zlib.decompressobj(15)
    return None


def _parts(data: Iterator[bytes], d) -> Iterator[bytes]:
    """Content of a stream, ``INFLATED`` bytes at a time; what a broken one gives before its break."""
    try:
        for piece in data:
            while not d.eof:
                out = d.decompress(piece, INFLATED)
                if out:
                    yield out
                piece = getattr(d, "unconsumed_tail", b"")
                if not piece and (not out or getattr(d, "needs_input", True)):
                    break
            if d.eof:
                return
        if hasattr(d, "flush") and (out := d.flush()):
            yield out
    except (zlib.error, OSError, lzma.LZMAError, EOFError):
        return


def _raw(data: bytes) -> bytes:
    """Content of a deflated stream without any header, if it is one to its end and holds text; else nothing."""
    d = zlib.decompressobj(-15)
    try:
        out = d.decompress(data, INFLATED)
        return out if d.eof and not d.unused_data and len(out) > 3 and out.decode().translate(BLANKS).isprintable() else b""
    except (zlib.error, ValueError):
        return b""


def _inflated(data: bytes) -> Iterator[bytes]:
    """Parts of a stream's content, inflated until it is a stream no more; nothing if it isn't one or is broken at its start.

    A content that came before ends it, as of a stream that holds itself. Beyond
    ``INFLATED`` bytes a content is passed on in parts.
    """
    seen: set[bytes] = set()
    while (d := _unpacker(data)) is not None:
        key = xxhash.xxh3_128_digest(data)
        if key in seen:
            return
        seen.add(key)
        parts, held = _parts(iter([data]), d), []
        for part in parts:
            held.append(part)
            if sum(map(len, held)) > INFLATED:
                yield from _long(chain(held, parts))
                return
        data = b"".join(held)
    if not seen and (out := _raw(data)):
        yield from (_inflated(out) if _unpacker(out) else [out])
    elif seen and data:
        yield data


def _long(parts: Iterator[bytes], depth: int = 0) -> Iterator[bytes]:
    """A content of many parts, inflated if it is a stream again; every level holds more than ``INFLATED`` bytes."""
    first = next(parts, b"")
    d = _unpacker(first) if depth < 100 else None
    if d is None:
        yield first
        yield from parts
    else:
        yield from _long(_parts(chain([first], parts), d), depth + 1)


def _percent(m: re.Match, x: Layer) -> tuple:
    data, a = bytes.fromhex(m[0].replace("%", "")), m.start()
    n = np.arange(len(data)) * 3 + a
    y = _text_of(data, x.at[n], x.to[n + 2])
    if not any("\udc80" <= c <= "\udcff" for c in y.text):
        return a, m.end(), y.text, y.at, y.to
    # a byte that isn't UTF-8 stays as it is written
    s, at, to, i = [], [], [], 0
    for c in y.text:
        k = len(c.encode("utf-8", "surrogateescape"))
        p, q = a + 3 * i, a + 3 * (i + k)
        if "\udc80" <= c <= "\udcff":
            s.append(x.text[p:q])
            at += x.at[p:q].tolist()
            to += x.to[p:q].tolist()
        else:
            s.append(c)
            at.append(x.at[p]), to.append(x.to[q - 1])
        i += k
    return a, m.end(), "".join(s), np.array(at, np.int64), np.array(to, np.int64)


def _escape(m: re.Match, x: Layer) -> tuple | None:
    v = int(m[6]) if m[6] else int(next(filter(None, m.groups())), 16)
    return None if v > 0x10FFFF else (m.start(), m.end(), chr(v), x.at[m.start() : m.start() + 1], x.to[m.end() - 1 : m.end()])


def _bytes64(word: str) -> bytes | None:
    bare = word.rstrip("=")
    if len(bare) % 4 == 1:
        return None
    try:
        return base64.b64decode(bare.replace("-", "+").replace("_", "/") + "=" * (-len(bare) % 4), validate=True)
    except ValueError:
        return None


def _spans64(n: int, at: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans of n bytes, given those of the base64 characters."""
    i = np.arange(n)
    return at[i * 4 // 3], to[np.minimum(len(to) - 1, -(-(i + 1) * 4 // 3) - 1)]


def _plain64(m: re.Match, x: Layer) -> tuple | None:
    data = _bytes64(m[0])
    if not data or len(m[0]) < 8 or not data.isascii() or not data.decode().isprintable():
        return None
    n = len(m[0].rstrip("="))
    at, to = _spans64(len(data), x.at[m.start() : m.start() + n], x.to[m.start() : m.start() + n])
    to[-1] = x.to[m.end() - 1]
    return m.start(), m.end(), data.decode(), at, to


def _base64(x: Layer, at: int, word: str, places: np.ndarray) -> Iterator[Layer]:
    """Layers of a base64 word, whose characters stand at ``places``."""
    data = _bytes64(word)
    if not data:
        return
    places = places[: len(word.rstrip("="))]
    rest = ""
    for part in _inflated(data):
        s = rest + part.decode("utf-8", "replace")
        for t in (s, part.decode("utf-16-le", "replace") if part[1:2] == b"\0" else ""):
            if t:
                yield Layer(t, np.broadcast_to(x.at[places[0]], len(t)), np.broadcast_to(x.to[places[-1]], len(t)))
        rest = s[-max(OVERLAP, len(s) - len(s.rstrip(WORD64))) :]
    p, q = _spans64(len(data), x.at[places], x.to[places])
    yield _text_of(data, p, q)
    if wide := _wide(data, p, q):
        yield wide


def unwrapped(x: Layer) -> Iterator[Layer]:
    """The layers that are one step further in."""
    t = x.text
    for pattern, decode, sign in ((PERCENTS, _percent, "%"), (ESCAPE, _escape, "\\"), (ESCAPE, _escape, "&#"), (PLAIN64, _plain64, "")):
        if sign in t and (pattern is not ESCAPE or sign == "\\" or "\\" not in t):
            found = [f for m in pattern.finditer(t) if (f := decode(m, x))]
            if found:
                yield _within(x, found)
    word = None
    for word in BASE64.finditer(t):
        yield from _base64(x, word.start(), word[0], np.arange(word.start(), word.end()))
    if word and "\n" in t:
        for m in WRAPPED.finditer(t):
            keep = np.array([i for i, c in enumerate(m[0], m.start()) if c not in "\r\n \t"])
            yield from _base64(x, m.start(), re.sub(r"[\r\n \t]", "", m[0]), keep)


def scan(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans), each by start and then by kind."""
    text = text or ""
    order = lambda s: (s[1], KINDS.index(s[0]), s[2])
    base = sorted(base_spans(text), key=order)
    n = np.arange(len(text) + 1)
    work, seen, found = [unwrapped(Layer(text, n[:-1], n[1:]))], set(), set(base)
    while work:
        y = next(work[-1], None)
        if y is None:
            work.pop()
            continue
        what = xxhash.xxh3_128(y.text.encode("utf-8", "surrogatepass"))
        for a in (y.at, y.to):
            what.update(a[:1].tobytes() if a.strides == (0,) else np.ascontiguousarray(a).tobytes())
        if not y.text or y.text == text or what.digest() in seen:
            continue
        seen.add(what.digest())
        found |= {(k, int(y.at[a]), int(y.to[a:b].max())) for k, a, b in base_spans(y.text)}
        work.append(unwrapped(y))
    return base, sorted(found, key=order)


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, spans) of each row; both arrays of (kind, start, end), code points, end exclusive."""
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for b in batches:
            both = [scan(t.as_py()) for t in b.column(1)]
            cols = [pa.array([[dict(zip(("kind", "start", "end"), s)) for s in x[i]] for x in both], span) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["doc_id", "base", "spans"])

    s = "array<struct<kind:string,start:bigint,end:bigint>>"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id long, base {s}, spans {s}")


def digests(found: DataFrame) -> DataFrame:
    """Counts of the base spans and the digest of their list; the list of all spans."""
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans"))
