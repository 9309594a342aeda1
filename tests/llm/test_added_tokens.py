"""Strings of added tokens inside texts, as the library takes them by default."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from barloom.llm import packing as K

PATH = public_tokenizers.path(K.TOKENIZER)
TOKENIZER = Tokenizer.from_file(PATH)
ADDED = sorted(t.content for t in TOKENIZER.get_added_tokens_decoder().values())


@pytest.mark.parametrize("around", ["{}", "some words {} and more", "é{}\n{}", "<{}>", "no token here"])
def test_pieces_like_the_library(spark, around):
    texts = [around.replace("{}", t) for t in ADDED]
    got = {r["doc_id"]: r for r in K.cut_pieces(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for k, text in enumerate(texts):
        ids = [*TOKENIZER.encode(text, add_special_tokens=False).ids, K.END_ID]
        assert (got[k]["length"], got[k]["ids_crc32"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
