import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from barloom.llm import packing as K

SCHEMA = "doc_id long, text string, length string, piece string"
PATH = public_tokenizers.path(K.TOKENIZER)
TOKENIZER = Tokenizer.from_file(PATH)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=80), st.lists(st.sampled_from(["the ", "'s", " ", "  ", "\n", "é", "Ž", "123", "…", "</s>", "<|endoftext|>", "\x1c", " "]), max_size=20).map("".join)))
def test_ids_like_the_library(text):
    assert K.encoder(PATH).ids(text).tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids


def place(runs, length, rank):
    found = [(s + (rank - lo) // per, off + (rank - lo) % per * length) for n, lo, hi, s, per, off in runs if n == length and lo <= rank < hi]
    assert len(found) == 1
    return found[0]


def best_fit(lengths, capacity):
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(room) if r >= n]
        if fits:
            room[min(fits, key=lambda i: room[i])] -= n
        else:
            room.append(capacity - n)
    return len(room)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 20), st.integers(1, 30), max_size=12))
def test_plan_is_best_fit_over_counts(histogram):
    runs = K.plan_best_fit(histogram, 20)
    spans = {}
    for length, n in histogram.items():
        for rank in range(n):
            s, off = place(runs, length, rank)
            spans.setdefault(s, []).append((off, length))
    for own in spans.values():
        end = 0
        for off, length in sorted(own):
            assert off == end
            end += length
        assert end <= 20
    lengths = [n for n, k in histogram.items() for _ in range(k)]
    assert len(spans) == best_fit(lengths, 20)


ROWS = [(1, "a few words", "x", "x"), (2, None, "x", "x"), (3, "", "x", "x"), (4, "word " * 3000, "x", "x"), (None, "nobody", None, None)] + [(100 + i, "same length here", "x", "x") for i in range(300)] + [(1, "a few words", "x", "x")]


def test_table(spark):
    got = K.pack(spark, spark.createDataFrame(ROWS, SCHEMA), capacity=64).collect()
    want = Counter()
    for doc, text, _, _ in ROWS:
        ids = TOKENIZER.encode(text or "", add_special_tokens=False).ids + [K.END_ID]
        first = len(ids) % 64 or 64
        cuts = [0, *range(first, len(ids), 64), len(ids)]
        want.update((doc, k, lo, hi - lo, zlib.crc32(np.array(ids[lo:hi], "<u4").tobytes())) for k, (lo, hi) in enumerate(zip(cuts, cuts[1:])))
    assert Counter(tuple(r)[:5] for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by.values():
        end = 0
        for off, n in sorted(own):
            assert off == end
            end += n
        assert end <= 64
    assert len(by) == best_fit([r["length"] for r in got], 64)


def test_many_parts_of_a_length_rank_alike(spark):
    pieces = K.cut_pieces(spark.createDataFrame(ROWS, SCHEMA), 64)
    whole, parted = (K.assign(spark, pieces, 64, part).groupBy("sequence_id").sum("length").collect() for part in (10**6, 7))
    assert sorted(r[1] for r in whole) == sorted(r[1] for r in parted)


def test_empty_table(spark):
    assert K.pack(spark, spark.createDataFrame([], SCHEMA)).count() == 0
