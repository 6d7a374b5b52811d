"""SentencePiece encoding and decoding by weighted finite-state transducers.

Three transducers are compiled from a model file, which is read on the driver
and broadcast (its size is that of a vocabulary):

* the normaliser has one state and writes the word-start mark for a blank and
  every other character as it is, behind an arc that writes the first mark (only
  models whose normalisation rule is ``identity`` are accepted). It has one path
  for an input, so composing with it is writing that path's output;
* the piece transducer reads characters and writes piece ids. Its states hold
  the last piece written. An arc to another piece exists where the model's
  merges leave the two side by side, and weighs nothing; all others weigh
  infinity. That property of neighbours is what makes a sequence of pieces the
  one that the merge rules give, so the lightest path is the model's own
  encoding, not merely a cheap one. (Piece scores as weights would give the
  unigram segmentation, which for a merge-ranked model differs from its own.)
* the byte transducer reads a character that has no piece and writes its UTF-8
  bytes' ids.

The composition with an input is built as far as the search asks for it: from
each position only the arcs that read the next characters. The tropical-semiring
shortest path is searched from left to right, long arcs first. At most one
finite path reaches a position, so a position whose arcs all weigh infinity is
left for good, and the first path to the end is the shortest. With weights of
nothing and infinity this is a search for the one finite path rather than a
comparison of weights.

No piece spans the start of a word, so an input is cut there, and at characters
that no longer piece holds; paths are kept as packed ids, in a cache that is
bounded by bytes, and parts of more than ``LONGEST`` characters aren't kept.

Decoding maps ids back to their strings and bytes; ``round_trip`` says that it
gave the text. Null and empty texts have no ids; the round trip of an empty text
holds, that of a null text is null. Rows are handled one by one, without a
shuffle.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Iterable
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
CACHE_BYTES, PAIRS_CACHED, LONGEST = 96 << 20, 1_000_000, 64
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6


def _fields(buf: bytes):
    """(number, value) of each field of a protocol buffer message."""
    i = 0

    def varint() -> int:
        nonlocal i
        v = shift = 0
        while True:
            c = buf[i]
            i += 1
            v |= (c & 127) << shift
            shift += 7
            if c < 128:
                return v

    while i < len(buf):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(kind) or varint()
            yield key >> 3, buf[i : i + n]
            i += n


def cuts(pieces: Iterable[str]) -> str:
    """A pattern whose matches no piece goes beyond: marks start one, and so does each
    symbol that no piece holds behind another character than a mark or such a symbol."""
    behind: dict[str, set[str]] = {}
    for p in pieces:
        for x, y in zip(p, p[1:]):
            behind.setdefault(y, set()).add(x)
    free = {c for c in (p[0] for p in pieces) if not c.isalpha() and not c.isdecimal() and c != MARK}
    while bad := {c for c in free if not behind.get(c, set()) <= free | {MARK}}:
        free -= bad
    every = "".join(map(re.escape, sorted(free)))
    if not every:
        return f"{MARK}+[^{MARK}]*|[^{MARK}]+"
    return f"{MARK}+[{every}]*[^{MARK}{every}]*|[{every}]+[^{MARK}{every}]*|[^{MARK}{every}]+"


class Paths(dict):
    """Packed ids of words. At half of ``CACHE_BYTES`` a generation ends; its words stay for one more."""

    def __init__(self, find) -> None:
        self.find, self.older, self.size = find, {}, 0

    def __missing__(self, word: str) -> bytes:
        p = self.older.get(word)
        if p is None:
            p = self.find(word)
        if len(word) <= LONGEST:
            if self.size > CACHE_BYTES // 2:
                self.older, self.size = dict(self), 0
                self.clear()
            self[word] = p
            self.size += 200 + 2 * len(word) + len(p)  # entries in a dict, a string and bytes
        return p


class Model:
    """What a model file says of its pieces, the normaliser and where words end."""

    def __init__(self, model: bytes) -> None:
        pieces, rule, self.prefix, self.squeeze, escape = [], b"", 1, 1, 1
        for field, value in _fields(model):
            if field == 1:
                f = dict(_fields(value))
                pieces.append((f[1].decode(), struct.unpack("<f", f[2])[0] if 2 in f else 0.0, f.get(3, NORMAL)))
            elif field == 3:
                f = dict(_fields(value))
                rule, self.prefix, self.squeeze, escape = f.get(2, b""), f.get(3, 1), f.get(4, 1), f.get(5, 1)
        if rule or not escape:
            raise ValueError("only models with the identity normaliser and escaped white space are supported")
        self.names = [p for p, _, _ in pieces]
        self.ids = {p: i for i, (p, _, kind) in enumerate(pieces) if kind in (NORMAL, USER)}
        self.scores = {p: s for p, s, kind in pieces if kind in (NORMAL, USER)}
        self.bytes_ = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == BYTE}
        self.unknown = next((i for i, (_, _, kind) in enumerate(pieces) if kind == UNKNOWN), 0)
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids):
            raise ValueError("pieces that span the start of a word aren't supported")
        self.cut = re.compile(cuts(self.ids))

    def normalised(self, text: str) -> str:
        if not text:
            return ""
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        text = text.replace(" ", MARK)
        return MARK + text if self.prefix and text else text


class Transducer(Model):
    def __init__(self, model: bytes) -> None:
        super().__init__(model)
        self.byte_of = {i: b for b, i in self.bytes_.items()}
        #: Beginnings of pieces; true for those that are pieces which the merges do build.
        self.arcs = {p[:n]: False for p in self.ids for n in range(1, len(p) + 1)}
        self.arcs |= {p: True for p in self.ids if len(self.merged(p)) == 1}
        written = [bytes([self.byte_of[i]]) if i in self.byte_of else p.replace(MARK, " ").encode() for i, p in enumerate(self.names)]
        self.table, self.sizes = np.frombuffer(b"".join(written), np.uint8), np.array(list(map(len, written)))
        self.offsets = np.cumsum(self.sizes) - self.sizes
        self.beside: dict[str, dict[str, bool]] = {}
        self.pairs = 0
        joined = "".join(map(re.escape, sorted({c for p in self.ids if len(p) > 1 for c in p})))
        self.alone = re.compile(f"[{joined}]+|[^{joined}]")
        self.paths = Paths(self._part)

    # -- the merge rules, on single pieces and pairs

    def merged(self, s: str) -> list[str]:
        """The pieces that the merges leave of a short string: again and again the best pair, the leftmost of equals."""
        parts = list(s)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def may_follow(self, a: str, b: str) -> bool:
        """Weight 0 rather than infinity for the arc that writes ``b`` after ``a``."""
        return self.merged(a + b) == [a, b]

    # -- composition and shortest path

    def _part(self, part: str) -> bytes:
        return self.path(part) if len(part) <= LONGEST else b"".join(map(self.path, self.alone.findall(part)))

    def path(self, word: str) -> bytes:
        """Packed ids of one word (no start of a word inside)."""
        n = len(word)
        arcs, beside = self.arcs, self.beside
        if self.pairs > PAIRS_CACHED:
            beside.clear()
            self.pairs = 0
        out: list[str] = []
        left: list[list[int]] = []  # ends of the arcs from each piece's start that aren't tried yet, the longest last
        closed: set[int] = set()
        i = 0
        while i < n:
            if len(left) == len(out):
                ends = [i + 1]
                for j in range(i + 1, n + 1):
                    kind = arcs.get(word[i:j])
                    if kind is None:
                        if j > i + 1:
                            break
                    elif kind and j > i + 1:
                        ends.append(j)
                left.append(ends)
            next_to = beside.setdefault(out[-1], {}) if out else None
            ends = left[-1]
            while ends:
                j = ends.pop()
                if j in closed:
                    continue
                p = word[i:j]
                if next_to is not None:
                    ok = next_to.get(p)
                    if ok is None:
                        ok = next_to[p] = self.may_follow(out[-1], p)
                        self.pairs += 1
                    if not ok:
                        continue
                out.append(p)
                i = j
                break
            else:  # all arcs from here weigh infinity
                closed.add(i)
                left.pop()
                i -= len(out.pop())
        ids: list[int] = []
        for p in out:
            i = self.ids.get(p)
            if i is not None:
                ids.append(i)
            elif self.bytes_:
                ids += [self.bytes_[b] for b in p.encode("utf-8", "replace")]
            else:
                ids.append(self.unknown)
        return array("i", ids).tobytes()

    def packed(self, text: str | None) -> bytes:
        """Ids of a text, four bytes each."""
        if not text:
            return b""
        return b"".join(map(self.paths.__getitem__, self.cut.findall(self.normalised(text))))

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.packed(text), np.int32).tolist()

    def decode(self, ids: list[int] | np.ndarray) -> str:
        """The pieces' bytes one after the other, gathered from the table of all pieces' bytes."""
        ids = np.asarray(ids, np.int64)
        size = self.sizes[ids]
        end = np.cumsum(size)
        at = np.repeat(self.offsets[ids] - (end - size), size)
        at += np.arange(len(at))
        text = self.table[at].tobytes().decode("utf-8", "replace")
        return text[1:] if self.prefix and text[:1] == " " else text

    def canonical(self, text: str) -> str:
        """What decoding an encoding must give."""
        text = self.normalised(text).replace(MARK, " ")
        return text[1:] if self.prefix and text[:1] == " " else text


_loaded: dict[int, Transducer] = {}


def load(model: bytes) -> Transducer:
    key = hash(model)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Transducer(model)
    return _loaded[key]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode(docs: DataFrame, model_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_pieces, ids, decoded_sha256, round_trip) of each row."""
    import hashlib

    sent = docs.sparkSession.sparkContext.broadcast(Path(model_path or default_model()).read_bytes())

    def run(batches):
        t = load(sent.value)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                ids, sha, same = [], [], []
                for x in part.column(1):
                    x = x.as_py()
                    i = t.packed(x)
                    back = t.decode(np.frombuffer(i, np.int32))
                    ids.append(i)
                    sha.append(hashlib.sha256(back.encode("utf-8", "replace")).hexdigest())
                    same.append(None if x is None else back == t.canonical(x))
                off = np.cumsum([0, *map(len, ids)]).astype(np.int32) // 4
                arr = pa.ListArray.from_arrays(pa.array(off), pa.array(np.frombuffer(b"".join(ids), np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(off), pa.int64()), arr, pa.array(sha, pa.string()), pa.array(same, pa.bool_())], ["doc_id", "n_pieces", "ids", "decoded_sha256", "round_trip"])

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return d.mapInArrow(run, "doc_id long, n_pieces long, ids array<int>, decoded_sha256 string, round_trip boolean")


def decode(encoded: DataFrame, model_path: str | None = None) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids); null ids give a null text."""
    sent = encoded.sparkSession.sparkContext.broadcast(Path(model_path or default_model()).read_bytes())

    def run(batches):
        t = load(sent.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if x is None else t.decode(x) for x in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")
