"""SentencePiece encoding and decoding with weighted finite-state transducers.

The model file is read as plain protocol-buffer fields and compiled into machines whose arcs are tables:

* ``Normaliser``: the rules of the character map (a trie of rewritings, longest match first) composed with
  the white-space machine (dummy prefix, runs and ends of white space, space to the mark U+2581).
* ``Lexicon``: a trie of the pieces, whose final states put out a piece and its weight, and an arc for each
  character that no piece spells, which puts out its bytes.
* ``Neighbours`` (BPE models): weights between two pieces.

An input is composed with them, which gives a lattice of arcs between its positions, and one relaxation in the
tropical semiring (weights add along a path, the smallest sum wins, the first found on a tie) takes the
shortest path through it.  It is the same for both kinds of model:

* Unigram models: an arc weighs minus its piece's score; an unknown character the
  lowest score and 10 more; a user-defined piece what the library gives it.  There are no weights between pieces.
* BPE models: pieces have no additive score, and weights over pieces alone can't
  express merge order.  So arcs weigh nothing, and two neighbours weigh 0 if merging their joint spelling by score
  yields exactly these two, else infinity.  A segmentation all of whose neighbours are compatible is the one that the merges
  produce, so each prefix has one path of finite weight.  User-defined pieces are cut out first; unused ones are
  replaced by the halves they were merged from.

No piece has the mark after another character, nor a line end, so a text falls apart before each
run of spaces and at line ends, and between a Latin letter and a mark that follows none in any piece (``closers``); such units are
composed once and remembered, within a bound of bytes.  Long units aren't remembered.
(Models with such pieces, or whose character map has rules over white space of several characters, take each text as one unit.)

Null and empty texts have no pieces; repeated rows and ids are encoded as often as they occur; a null id stays null; an
empty table gives no rows; other columns, whatever their names, are ignored.  Decoding spells the pieces, bytes as bytes, and takes off the dummy
prefix; it gives back every text exactly where the normaliser changes nothing else.
Models without byte fallback raise ``ValueError``.
"""

from __future__ import annotations

import functools
import math
import re
import struct
import zlib
from array import array
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush
from itertools import pairwise
from string import punctuation

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import batch, map_batches, table

MODEL = "piece_bpe_32k.model"
MARK = "▁"
#: Bytes of units, and of neighbours, that a worker remembers; longer units aren't remembered.
MEMO_BYTES = 160 << 20
LONG_UNIT = 64

#: Fixed values of the model format.
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """``(number, value)`` of a protocol-buffer message's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield key >> 3, data[at : at + size]
            at += size


class Model:
    """What a model file says, as plain values."""

    def __init__(self, pieces: list[tuple[str, float, int]], kind: int = BPE, dummy_prefix: bool = True, squeeze: bool = False, charsmap: bytes = b""):
        self.pieces, self.kind, self.dummy_prefix, self.squeeze, self.charsmap = pieces, kind, dummy_prefix, squeeze, charsmap

    @classmethod
    def read(cls, path: str) -> Model:
        with open(path, "rb") as f:
            data = f.read()
        pieces, kind, prefix, squeeze, charsmap = [], UNIGRAM, True, True, b""
        for number, value in fields(data):
            if number == 1:
                own = dict(fields(value))
                pieces.append((own[1].decode(), struct.unpack("<f", own[2])[0] if 2 in own else 0.0, own.get(3, NORMAL)))
            elif number == 2:
                kind = dict(fields(value)).get(3, UNIGRAM)
            elif number == 3:
                own = dict(fields(value))
                prefix, squeeze, charsmap = bool(own.get(3, 1)), bool(own.get(4, 1)), own.get(2, b"")
        return cls(pieces, kind, prefix, squeeze, charsmap)


def characters(charsmap: bytes) -> dict[str, str]:
    """The rules of a compiled character map: a double array of 32-bit units (whose length comes first), then the
    rewritings, each closed by a zero byte, that the array's values point into."""
    if not charsmap:
        return {}
    size = struct.unpack_from("<I", charsmap)[0]
    units = np.frombuffer(charsmap, "<u4", size // 4, 4).astype(np.int64)
    texts, rules, every = charsmap[4 + size :], {}, np.arange(1, 256)
    below = units >> 10 << ((units & 1 << 9) >> 6)
    left = [(int(below[0]), b"")]
    while left:
        at, spelled = left.pop()
        to = at ^ every
        byte = every[to < len(units)]
        to = to[to < len(units)]
        hit = units[to] & (1 << 31 | 0xFF) == byte
        for child, byte_ in zip(to[hit].tolist(), byte[hit].tolist()):
            next_, key = child ^ int(below[child]), spelled + bytes([byte_])
            if units[child] >> 8 & 1:
                begin = int(units[next_]) & 0x7FFFFFFF
                rules[key.decode()] = texts[begin : texts.index(b"\0", begin)].decode()
            left.append((next_, key))
    return rules


def trie(words: dict[str, object]) -> list[dict]:
    """Arc tables of the machine that reads the words: ``table[state][character]`` is the next state, and
    ``table[state][""]`` what the word that ends there puts out."""
    table_: list[dict] = [{}]
    for word, out in words.items():
        state = 0
        for c in word:
            if c not in table_[state]:
                table_[state][c] = len(table_)
                table_.append({})
            state = table_[state][c]
        table_[state][""] = out
    return table_


class Normaliser:
    """Rewrites characters, longest rule first, and feeds the white-space machine, whose states are START (nothing
    yet), INSIDE and PENDING (white space that a further character may follow)."""

    START, INSIDE, PENDING = 0, 1, 2

    def __init__(self, model: Model, kept: list[str]):
        rules = characters(model.charsmap)
        self.plain = not rules
        self.rewrite = trie({**rules, **{k: k for k in kept}}) if rules else trie({})
        #: rules that a unit's border could cut
        self.over_spaces = any(len(k) > 1 and re.search("[ \n]", k) for k in rules)
        mark, first = MARK, MARK if model.dummy_prefix else ""
        # state -> (on a space, on another character): (next state, what goes before the character)
        self.first = None if model.squeeze else first
        if model.squeeze:
            self.arcs = {self.START: ((self.START, ""), (self.INSIDE, first)), self.INSIDE: ((self.PENDING, ""), (self.INSIDE, "")), self.PENDING: ((self.PENDING, ""), (self.INSIDE, mark))}
        else:
            self.arcs = {self.START: ((self.INSIDE, first + mark), (self.INSIDE, first)), self.INSIDE: ((self.INSIDE, mark), (self.INSIDE, "")), self.PENDING: ((self.PENDING, ""), (self.INSIDE, ""))}

    def rewritten(self, text: str) -> str:
        if self.plain:
            return text
        table_, out, at = self.rewrite, [], 0
        while at < len(text):
            state, end, put = 0, at + 1, text[at]
            for k in range(at, len(text)):
                state = table_[state].get(text[k])
                if state is None:
                    break
                if "" in table_[state]:
                    end, put = k + 1, table_[state][""]
            out.append(put)
            at = end
        return "".join(out)

    def __call__(self, text: str, state: int) -> tuple[str, int]:
        if self.first is not None:
            # without squeezing each space is a mark, whatever stands beside it: the arcs of a whole text at once
            out = self.rewritten(text).replace(" ", MARK)
            return (self.first + out if state == self.START and out else out), self.INSIDE if out else state
        out = []
        for part in re.split("( +)", self.rewritten(text)):
            if part.startswith(" "):
                for _ in part:
                    state, before = self.arcs[state][0]
                    out.append(before)
            elif part:
                state, before = self.arcs[state][1]
                out += (before, part)
        return "".join(out), state


class Lexicon:
    """The trie of the pieces, and the arcs that a position of an input has in the composition with it."""

    def __init__(self, pieces: dict[str, float], unknown: float):
        if min([unknown, *pieces.values()]) < 0:
            raise ValueError("a score is positive")
        self.unknown = array("f", [unknown])[0]
        self.table = trie(dict(zip(pieces, array("f", pieces.values()))))
        self.out = [state.pop("", None) for state in self.table]


#: Latin letters.
LETTER = "[A-Za-zÀ-ɏ]"


def closers(pieces: Iterable[str]) -> str:
    """The marks of ASCII that follow a Latin letter in no piece."""
    inside = {y for p in pieces for x, y in pairwise(p) if re.match(LETTER, x)}
    return "".join(c for c in punctuation if c not in inside)


class Memo(dict):
    """Forgets everything when what it holds exceeds so many bytes."""

    def __init__(self, most: int):
        self.most, self.held = most, 0

    def keep(self, key, value, size: int):
        self.held += size
        if self.held > self.most:
            self.clear()
            self.held = size
        self[key] = value
        return value


class Neighbours:
    """Weights between two pieces of a BPE model: 0 or infinity."""

    def __init__(self, score: dict[str, float], most: int):
        self.score, self.known = score, Memo(most)

    def merged(self, text: str) -> list[str]:
        """The pieces that merging neighbours by score, leftmost first, yields."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def halves(self, piece: str) -> list[str]:
        """What the last merge of the piece joined."""
        parts, score = list(piece), self.score
        while len(parts) > 2:
            at = max(range(len(parts) - 1), key=lambda i: (score.get(parts[i] + parts[i + 1], -math.inf), -i))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def __call__(self, a: str, b: str) -> float:
        """Unknown characters stand alone."""
        weight = self.known.get((a, b))
        if weight is None:
            free = a not in self.score or b not in self.score or self.merged(a + b) == [a, b]
            weight = self.known.keep((a, b), 0.0 if free else math.inf, 250)
        return weight


def shortest_path(unit: str, lexicon: Lexicon, between: Neighbours | None) -> list[str]:
    """The labels of the path of least weight through the composition of ``unit`` with the machines.

    The arcs that leave settled positions are taken by weight so far, of equal ones the furthest first, and relaxed: a
    position is settled by its first arc of finite weight.  (Weights aren't negative.)  With weights between pieces a state is a
    position and the piece that ends there: prefixes have one path of finite weight, so one state a position suffices."""
    n, table_, put, unknown = len(unit), lexicon.table, lexicon.out, lexicon.unknown
    # the length of the arc that settled each position
    last = [-1] * (n + 1)
    # where arcs weigh nothing, the arc of a furthest position is the one put there last
    flat = between is not None
    known = between.known.get if flat else None
    # single precision, as the library adds
    total, left, cost = array("f", [0.0]), [], 0.0
    at = begin = length = 0
    while True:
        last[at] = length
        if at == n:
            break
        # the arcs that leave the position: an unknown character's, then those of longer and longer pieces
        state, k = table_[0].get(unit[at]), at + 1
        weight = None if state is None else put[state]
        if flat:
            left.append((at, k))
        else:
            total[0] = cost + (unknown if weight is None else weight)
            heappush(left, (total[0], -k, -1))
        while state is not None and k < n and (state := table_[state].get(unit[k])) is not None:
            k += 1
            if (weight := put[state]) is not None:
                if flat:
                    left.append((at, k))
                else:
                    total[0] = cost + weight
                    heappush(left, (total[0], -k, at - k))
        while True:
            if flat:
                begin, at = left.pop()
            else:
                cost, at, begin = heappop(left)
                at, begin = -at, begin - at
            if last[at] >= 0:
                continue
            if flat and begin:
                pair = unit[begin - last[begin] : begin], unit[begin:at]
                if (weight := known(pair)) is None:
                    weight = between(*pair)
                if weight:
                    continue
            length = at - begin
            break
    out, at = [], n
    while at:
        out.append(unit[at - last[at] : at])
        at -= last[at]
    return out[::-1]


class Transducer:
    def __init__(self, model: Model, memo_bytes: int = MEMO_BYTES):
        if model.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are compiled")
        pieces = model.pieces
        self.model, bpe = model, model.kind == BPE
        self.id = {p: i for i, (p, _, k) in enumerate(pieces) if k in (NORMAL, USER_DEFINED, UNUSED)}
        self.byte_id = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(pieces) if k == BYTE}
        if len(self.byte_id) != 256:
            raise ValueError("the model has no byte fallback")
        normal = [s for _, s, k in pieces if k == NORMAL]
        # the library takes no negative number for the highest score
        least, most = min(normal, default=0.0), max([0.0, *normal])
        self.cut = sorted((p for p, _, k in pieces if k == USER_DEFINED), key=lambda p: (-len(p), p))
        self.unused = {p for p, _, k in pieces if k == UNUSED}
        if bpe:
            score = {p: s for p, s, k in pieces if k in (NORMAL, UNUSED)}
            self.lexicon, self.between = Lexicon(dict.fromkeys(score, 0.0), 0.0), Neighbours(score, memo_bytes // 3)
        else:
            weight = {p: -s for p, s, k in pieces if k == NORMAL} | {p: 0.1 - len(p) * most for p in self.cut}
            self.lexicon, self.between = Lexicon(weight, 10.0 - least), None
        self.normaliser = Normaliser(model, self.cut)
        self.pattern = re.compile("|".join(map(re.escape, self.cut))) if self.cut else None
        byte_of = {i: bytes([b]) for b, i in self.byte_id.items()}
        self.spelling = [byte_of.get(i, b"" if k in (CONTROL, UNKNOWN) else p.replace(MARK, " ").encode()) for i, (p, _, k) in enumerate(pieces)]
        whole = self.normaliser.over_spaces or any(MARK in p.lstrip(MARK) or " " in p for p in self.id) or any(MARK in p or "\n" in p for p in self.cut)
        if not self.normaliser.plain:
            # line ends may be rewritten to spaces; without squeezing, a rewritten space may stand beside a unit's border
            whole, line = whole or not model.squeeze, ""
        else:
            line = "" if any("\n" in p for p in self.id) else "\n"
        # a character map may rewrite characters together that no piece has together
        close = re.escape(closers(self.id)) if self.normaliser.plain and not self.cut else ""
        close = f"[ {MARK}]*+{LETTER}++(?=[{close}])|" if close else ""
        self.units = None if whole else re.compile(f"{close}[ {MARK}]+[^ {MARK}{line}]*|[^ {MARK}{line}]+" + f"|{line}+" * bool(line))
        #: ids by the normaliser's state before the unit, of units that end inside a text
        self.known = [Memo(memo_bytes) for _ in range(3)]

    def path(self, unit: str) -> list[str]:
        """The pieces (and characters without a piece) of a normalised unit."""
        if self.between is None:
            return shortest_path(unit, self.lexicon, None)
        out, at = [], 0
        for m in self.pattern.finditer(unit) if self.pattern else ():
            out += shortest_path(unit[at : m.start()], self.lexicon, self.between) + [m.group()]
            at = m.end()
        return self.used(out + shortest_path(unit[at:] if at else unit, self.lexicon, self.between))

    def used(self, path: list[str]) -> list[str]:
        while self.unused and any(p in self.unused and len(p) > 1 for p in path):
            path = [q for p in path for q in (self.between.halves(p) if p in self.unused and len(p) > 1 else [p])]
        return path

    def compose(self, unit: str, state: int) -> tuple[bytes, int]:
        """The ids of a unit of a text, and the normaliser's state after it."""
        normal, state = self.normaliser(unit, state)
        ids = []
        for piece in self.path(normal):
            if (i := self.id.get(piece)) is not None:
                ids.append(i)
            else:
                ids += [self.byte_id[b] for b in piece.encode("utf-8", "replace")]
        return struct.pack(f"<{len(ids)}I", *ids), state

    def encode(self, text: str) -> bytes:
        """The ids, little-endian unsigned 32-bit."""
        if not text:
            return b""
        if self.units is None:
            return self.compose(text, Normaliser.START)[0]
        known, out, state = self.known, [], Normaliser.START
        for unit in self.units.findall(text):
            if (ids := known[state].get(unit)) is None:
                before = state
                ids, state = self.compose(unit, before)
                if len(unit) <= LONG_UNIT and state == Normaliser.INSIDE:
                    known[before].keep(unit, ids, 210 + 2 * len(unit) + len(ids))
            else:
                state = Normaliser.INSIDE
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        spelled = b"".join(map(self.spelling.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return spelled.decode("utf-8", "replace")[1 if self.model.dummy_prefix else 0 :]


@functools.lru_cache(1)
def transducer(path: str) -> Transducer:
    """One for each worker."""
    return Transducer(Model.read(path))


ENCODED = "doc_id long, ids binary"
_ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])


def encode_table(docs: DataFrame, model: str | None = None) -> DataFrame:
    """``doc_id, ids`` (little-endian unsigned 32-bit) of every text."""
    path = model or public_tokenizers.path(MODEL)

    def run(batches):
        encode = transducer(path).encode
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                yield batch(_ENCODED, part.column(0), [encode(t or "") for t in part.column(1).to_pylist()])

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, ENCODED)


DECODED = "doc_id long, n_pieces long, n_byte_pieces long, ids_crc32 long, decoded_chars long, decoded_crc32 long"
_DECODED = pa.schema([("doc_id", pa.int64()), ("n_pieces", pa.int64()), ("n_byte_pieces", pa.int64()), ("ids_crc32", pa.int64()), ("decoded_chars", pa.int64()), ("decoded_crc32", pa.int64())])


def decode_digests(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """Numbers about the ids, and about the text that decoding gives back."""
    path = model or public_tokenizers.path(MODEL)

    def run(batches):
        machine = transducer(path)
        is_byte = np.zeros(len(machine.spelling), bool)
        is_byte[list(machine.byte_id.values())] = True
        for b in batches:
            out = ([], [], [], [], [], [])
            for doc, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                text = machine.decode(ids)
                for column, v in zip(out, (doc, len(ids) // 4, int(is_byte[np.frombuffer(ids, "<u4")].sum()), zlib.crc32(ids), len(text), zlib.crc32(text.encode()))):
                    column.append(v)
            yield batch(_DECODED, *out)

    return map_batches(encoded, run, DECODED)


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode_digests(encode_table(table(spark, sf_dir, "documents")))
