import struct
import zlib
from collections import defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from helixframe.llm import packing
from helixframe.llm.queries import op1_packing, packed

from .helpers import SF, empty, odd_documents


def encoder():
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids + [0]


def check(docs, pieces, window=1024):
    encode = encoder()
    whole = [(d, encode(t)) for d, t in docs]
    crc = lambda ids: zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))
    by_doc = defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"], p["doc_tokens"]].append(p)
    assert sum(p["length"] for p in pieces) == sum(len(x) for _, x in whole)
    for doc, ids in whole:
        own = by_doc[doc, len(ids)]
        assert {p["start"] for p in own} and all(p["ids_crc32"] == crc(ids[p["start"] : p["start"] + p["length"]]) for p in own)
    by_sequence = defaultdict(list)
    for p in pieces:
        by_sequence[p["sequence_id"]].append(p)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for k, own in by_sequence.items():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at == window or k == len(by_sequence) - 1 and at <= window


def test_packs_all_tokens_of_the_tokenizers_library(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check(docs, op1_packing(spark, SF).collect())


def test_odd_rows(spark):
    texts = ["<|endoftext|> it's 12345   \n\n x", "a <|endoftext|>", "x<|endoftext|><|endoftext|>y <|ENDOFTEXT|> <|endof", "<|endoftext|>", "a" * 5000]
    docs = odd_documents(spark, texts).repartition(3)
    pieces = packed(docs, window=64)
    check([(r["doc_id"], r["text"]) for r in docs.collect()], pieces.collect(), 64)
    assert packed(empty(docs)).count() == 0


def test_sequences_hold_the_pieces(spark):
    docs = odd_documents(spark, ["some words", "more words here"])
    pieces = packed(docs, window=128, with_ids=True)
    rows = packing.sequences(pieces, 128).collect()
    assert all(len(r["input_ids"]) == len(r["segment_ids"]) == 128 for r in rows)
    assert sum(r["n_tokens"] for r in rows) == sum(len(encoder()(r["text"])) for r in docs.collect())


def test_added_tokens(tmp_path):
    assert packing.added_tokens(public_tokenizers.path("byte_bpe_50k.json")) == {"<|endoftext|>": 50256}
    (tmp_path / "t.json").write_text('{"added_tokens": [{"content": "<m>", "id": 3, "lstrip": true, "rstrip": false, "single_word": false}]}')
    with pytest.raises(ValueError):
        packing.added_tokens(str(tmp_path / "t.json"))
