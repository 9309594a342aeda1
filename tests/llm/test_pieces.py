import itertools
import math
import random
import struct

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from barloom.llm import pieces as P

PATH = public_tokenizers.path(P.MODEL)
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
MACHINE = P.transducer(PATH)


def ids(text):
    return np.frombuffer(MACHINE.encode(text), "<u4").tolist()


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.lists(st.sampled_from(["the ", "ing", "tion", " ", "  ", "é", "漢", "a", "aa", "\n", "0", "▁", "</s>", "ough"]), max_size=20).map("".join)))
def test_like_the_library(text):
    assert ids(text) == LIBRARY.encode(text)
    if "▁" not in text:
        assert MACHINE.decode(MACHINE.encode(text)) == text


def test_long_text_like_the_library():
    rnd = random.Random(1)
    text = " ".join("".join(rnd.choice("etaoinshrdlu.,é\n") for _ in range(rnd.randrange(1, 14))) for _ in range(20_000))
    assert ids(text) == LIBRARY.encode(text) and MACHINE.decode(MACHINE.encode(text)) == text
    assert ids("a" * 5000) == LIBRARY.encode("a" * 5000)


BYTES = [(f"<0x{b:02X}>", 0.0, P.BYTE) for b in range(256)]


def field(number, value):
    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, bytes):
        return varint(number << 3 | 2) + varint(len(value)) + value
    return varint(number << 3) + varint(int(value))


def written(model):
    """The model as the library reads it."""
    out = b"".join(field(1, field(1, p.encode()) + field(2, float(s)) + field(3, k)) for p, s, k in model.pieces)
    out += field(2, field(3, model.kind) + field(35, 1))
    return out + field(3, field(2, model.charsmap) + field(3, model.dummy_prefix) + field(4, model.squeeze))


NFKC = dict(P.fields(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_normalizer_spec()))[2]
# no two paths weigh the same but by rounding
UNIGRAMS = [("▁", -3.01), ("a", -2.017), ("b", -2.531), ("ab", -3.0623), ("ba", -3.2171), ("aba", -6.0379), ("▁a", -2.8057), ("bb", -9.0113), ("▁ab", -4.2531), ("fi", -4.5), ("f", -5.0), ("i", -5.5)]
MERGES = [("ab", -1.0), ("▁a", -2.0), ("ba", -3.0), ("abba", -4.0), ("▁ab", -5.0), ("bb", -6.0), ("aab", -7.0), ("fi", -8.0)] + [(c, -9.0 - k) for k, c in enumerate("▁abfi")]
SPECIAL = [("<unk>", 0.0, P.UNKNOWN), ("<s>", 0.0, P.CONTROL), ("</s>", 0.0, P.CONTROL), *BYTES]


@pytest.mark.parametrize("kind", [P.UNIGRAM, P.BPE])
@pytest.mark.parametrize("squeeze,prefix,charsmap", [(False, True, b""), (True, True, b""), (True, False, b""), (False, False, b""), (True, True, NFKC), (False, True, NFKC)])
@pytest.mark.parametrize("own", [(), ("USER",), ("USER", "UNUSED")])
def test_models_like_the_library(kind, squeeze, prefix, charsmap, own):
    normal = [(p, s, P.NORMAL) for p, s in (UNIGRAMS if kind == P.UNIGRAM else MERGES)]
    if "UNUSED" in own:
        normal = [(p, s, P.UNUSED if p in ("ab", "bb") else k) for p, s, k in normal]
    user = [("cab", 0.0, P.USER_DEFINED), ("<x>", 0.0, P.USER_DEFINED)] if "USER" in own else []
    model = P.Model([*SPECIAL, *user, *normal], kind, prefix, squeeze, charsmap)
    library = sentencepiece.SentencePieceProcessor(model_proto=written(model))
    machine = P.Transducer(model)
    rnd = random.Random(5)
    texts = ["".join(rnd.choice(["a", "b", "a", "b", " ", "ab", "cab", "<x>", "c", "ﬁ", "é", "ＡＢ", "\u3000", "\n", "  ", "①", "\u200b"]) for _ in range(rnd.randrange(1, 12))) for _ in range(300)]
    wrong = [(t, np.frombuffer(machine.encode(t), "<u4").tolist(), library.encode(t)) for t in texts if np.frombuffer(machine.encode(t), "<u4").tolist() != library.encode(t)]
    assert wrong[:3] == []


def test_rules_of_a_character_map():
    rules = P.characters(NFKC)
    assert rules["ﬁ"] == "fi" and rules["①"] == "1" and rules["\n"] == " " and len(rules) > 5000


@pytest.mark.parametrize("kind", [P.UNIGRAM, P.BPE])
def test_the_path_is_the_shortest(kind):
    """Like the least of all paths through the lattice, for every short text."""
    table = UNIGRAMS if kind == P.UNIGRAM else MERGES
    machine = P.Transducer(P.Model([*SPECIAL, *((p, s, P.NORMAL) for p, s in table)], kind))
    weights = {p: -s if kind == P.UNIGRAM else 0.0 for p, s in table}
    for n in range(1, 7):
        for unit in map("".join, itertools.product("▁abc", repeat=n)):

            def paths(at, last):
                if at == len(unit):
                    yield 0.0, []
                    return
                for end in range(at + 1, len(unit) + 1):
                    piece = unit[at:end]
                    weight = weights.get(piece, machine.lexicon.unknown if end == at + 1 else math.inf)
                    step = weight + (machine.between(last, piece) if machine.between and last else 0.0)
                    if step < math.inf:
                        for w, rest in paths(end, piece):
                            yield step + w, [piece, *rest]

            found = list(paths(0, None))
            path = machine.path(unit)
            weight = min(found)[0]
            assert any(p == path and abs(w - weight) < 1e-5 for w, p in found)
            assert kind == P.UNIGRAM or len(found) == 1 and path == machine.between.merged(unit)


def test_models_that_are_refused():
    for model in (P.Model([("a", 0.0, P.NORMAL)]), P.Model(BYTES, kind=3)):
        with pytest.raises(ValueError):
            P.Transducer(model)


def test_memory_is_bounded():
    machine = P.Transducer(P.Model.read(PATH), memo_bytes=20_000)
    texts = [f"word{i} other{i} " + "漢" * (i % 200) for i in range(300)]
    assert [np.frombuffer(machine.encode(t), "<u4").tolist() for t in texts] == LIBRARY.encode(texts)
    assert all(m.held <= 21_000 for m in [*machine.known, machine.between.known])
    assert all(len(u) <= P.LONG_UNIT for m in machine.known for u in m)


def test_table(spark):
    rows = [(1, "two words", "x"), (2, None, "x"), (3, "", "x"), (None, "é漢", None), (1, "two words", "x"), (5, "w " * 50_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    encoded = P.encode_table(df).collect()
    assert sorted((r["doc_id"] or 0, len(r["ids"]) // 4) for r in encoded) == sorted((a or 0, len(LIBRARY.encode(t or ""))) for a, t, _ in rows)
    import zlib

    for r in P.decode_digests(P.encode_table(df)).collect():
        text = next((t or "" for a, t, _ in rows if a == r["doc_id"]), "")
        assert (r["decoded_chars"], r["decoded_crc32"]) == (len(text), zlib.crc32(text.encode()))
    assert P.decode_digests(P.encode_table(df.limit(0))).count() == 0


def test_borders_before_marks():
    """A mark is cut off where no piece has it after a letter, and only there."""
    assert "," in P.closers(["a", "b", ",", "ab", '",']) and "," not in P.closers(["a", ",", "a,"])
    for pieces in (["a,", "a", "b", ",", "ab"], ["a", "b", ",", "ab"]):
        model = P.Model([("<unk>", 0.0, 2), *((f"<0x{b:02X}>", 0.0, 6) for b in range(256)), *((p, -float(k), 1) for k, p in enumerate(pieces)), (P.MARK, -9.0, 1)], P.BPE)
        machine = P.Transducer(model)
        text = "ab, a,b,, ba,\nab, é,a"
        whole = machine.compose(text, P.Normaliser.START)[0]
        assert machine.encode(text) == whole and machine.encode(text) == whole
        assert machine.decode(whole) == text
