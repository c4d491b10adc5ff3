import hashlib
import random

import numpy as np
import public_tokenizers
import pytest

from helixframe.llm import word_bpe
from helixframe.llm.queries import op12_word_bpe

from .helpers import SF, empty, odd_documents

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def codec():
    return word_bpe.WordBpe(PATH)


def brute(library, rows):
    out = []
    for doc, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        sha = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        out.append((doc, len(ids), sha, hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    return sorted(out, key=str)


def test_table(spark, library):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted(map(tuple, op12_word_bpe(spark, SF).collect()), key=str) == brute(library, rows)


def test_odd_rows(spark, library):
    texts = ["A<|endoftext|>b <|startoftext|><|endoftext|>", "ΣΑΣ ΟΔΟΣ İstanbul", "é ﬁ 한글 가", "x՘y Ɤ Ᲊ 💩👩‍👩‍👧", "it's WE'LL 'd ''re 12 345\x85\x1c 　.", "ab" * 3000, "a" * 1000, "!?" * 500 + "é" * 77, "\x00\x7f"]
    docs = odd_documents(spark, texts)
    exact = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted(map(tuple, word_bpe.digest(docs, PATH).collect()), key=str) == brute(library, exact)
    back = word_bpe.decoded(word_bpe.encoded(docs, PATH), PATH)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(((i, library.decode(library.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False)) for i, t in exact), key=str)
    assert word_bpe.digest(empty(docs), PATH).count() == 0


def test_proposals_that_pass_are_exact(codec):
    """Words of random tokens and random letters, of every length: verified proposals and both ways of merging agree."""
    rng = random.Random(3)
    names = [t for t, i in codec.symbols.items()]
    words = {"".join(rng.choices("aeinorst", k=rng.randint(1, 30))) for _ in range(3000)}
    words |= {"".join(chr(ord(c) % word_bpe.END) for t in rng.choices(names, k=rng.randint(1, 4)) for c in t).encode("latin-1").decode(errors="ignore") for _ in range(6000)}
    words -= {""}
    codec.known.clear()
    codec.failed = codec.met = 0
    codec.learn(words)
    assert 0 < codec.failed < codec.met == len(words)
    for w in words:
        raw = w.encode()
        ids = [codec.symbols[c] for c in raw[:-1].decode("latin-1") + chr(raw[-1] + word_bpe.END)]
        assert codec.known[w] == codec._merged_long(list(ids))


def test_pairs_by_merging(codec):
    """The test of pairs says what merging the two tokens says."""
    rng = np.random.default_rng(0)
    inner = {i: t for t, i in codec.symbols.items() if ord(t[-1]) < word_bpe.END}
    ends = codec.symbols
    a, b = rng.choice(list(inner), 4000), rng.choice(list(ends.values()), 4000)
    close = [(x, y) for x, y in zip(codec.left[codec.left >= 0], codec.right[codec.left >= 0])][:4000]
    a, b = np.append(a, [x for x, _ in close]), np.append(b, [y for _, y in close])
    text = {i: t for t, i in ends.items()}
    got = codec.crossed(a, b)
    for x, y, crossed in zip(a.tolist(), b.tolist(), got.tolist()):
        assert (codec.merged(text[x] + text[y]) != (x, y)) == crossed


def test_pieces_and_cache(codec, library, monkeypatch):
    for name, n in (("PIECE", 40), ("BATCH", 100), ("CACHE_WORDS", 20)):
        monkeypatch.setattr(word_bpe, name, n)
    texts = [" ".join(f"wörd{i % 37}'s" for i in range(n)) + "x" * n for n in (0, 1, 30, 400)]
    assert [x.tolist() for x in codec.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_stable_characters(codec, library):
    """Every character that the quick way takes, between letters and between signs."""
    import regex

    stable = regex.compile(f"[{word_bpe.STABLE}]")
    chars = [c for c in map(chr, range(0x10000)) if not 0xD800 <= ord(c) < 0xE000 and stable.match(c)]
    texts = [" ".join(f"a{c}a !{c}! Á{c}" for c in chars[i : i + 500]) for i in range(0, len(chars), 500)]
    assert not any(codec.unstable.search(t) for t in texts)
    for t in texts:
        words = [w for part in codec.words(t) for w in part]
        normal = library.normalizer.normalize_str(t)
        assert words == [bytes(codec.bytes_of[c] for c in w).decode() for w, _ in library.pre_tokenizer.pre_tokenize_str(normal)]
