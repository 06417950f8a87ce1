from __future__ import annotations

import zlib
from array import array

import public_tokenizers as P
from tokenizers import Tokenizer

from catchment.llm import packing, token_files
from catchment.llm.common import new_dir

TEXTS = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>y\n", "<|endoftext |>", "plain", "", None]


def wanted(end):
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    return [[*library.encode(t or "", add_special_tokens=False).ids, end] for t in TEXTS]


def test_token_files_are_those_of_the_plain_call(spark):
    assert wanted(0)[0] == [64, 220, 50256, 275, 0]
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    uri = new_dir(spark, "tokens")
    got = token_files.read_token_files(token_files.write_token_files(docs, uri, files=2), uri).orderBy("doc_id").collect()
    assert [r.ids for r in got] == wanted(0)


def test_packed_pieces_are_those_of_the_plain_call(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = packing.pack_documents(docs).orderBy("doc_id").collect()
    assert [(r.length, r.ids_crc32) for r in got] == [(len(x), zlib.crc32(array("I", x).tobytes())) for x in wanted(2)]
