"""BPE with word ends: speculate and verify.

Each word that a task has not met before is proposed by greedy longest match over the vocabulary. A
sequence of tokens is the encoding exactly where every adjacent pair is compatible, which is tested for
all pairs of a batch of words at once with numpy; only words with a failing pair are merged exactly.

Why pairs suffice: merging takes the pair of lowest rank, leftmost first. Up to the first merge across
a border, what happens on its two sides does not depend on the other tokens, so a border that is
crossed in the word is crossed in the pair as well. A pair is tested by undoing merges along the right
edge of its left token and the left edge of its right one, latest first: it fails if two pieces that
exist at the same time have a merge. That needs each token to have one merge, ranked after those of its
parts, and to be its own encoding; the first is checked when a vocabulary is read (another one is
refused), the second is computed for all tokens by the same test, and tokens that are not are never taken.

Texts are normalised (NFC, white space to spaces, lower case) and split into words as the vocabulary's
file says; the strings of its added tokens stand for their ids. Characters whose class depends on the
version of Unicode go through the normaliser and splitter of the ``tokenizers`` library, so results are
the same. Decoding joins the tokens' strings with spaces, which is what the file without a decoder does.

Rows stay where they are: nothing is shuffled. Texts are taken in pieces of PIECE characters, cut at
spaces, and a task's known words are dropped at CACHE_WORDS, so a giant text takes no more memory than
itself and its ids.

Defined cases: a null text is empty, with no ids; a null id is kept; repeated rows repeat; an empty
table gives no rows; other columns are ignored; in decoding, null ids are an empty text and an id
outside the vocabulary an error.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import column, columns_as, map_batches

#: Characters of a text that are split into words at once.
PIECE = 1 << 20
#: Words whose ids a task keeps.
CACHE_WORDS = 1 << 19
#: Texts are encoded together up to this many characters, so that new words are verified in few calls.
BATCH = 1 << 21
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
#: Characters of blocks that Unicode filled long ago: Latin, Greek, Cyrillic, general punctuation, currency, kana, CJK, Hangul.
STABLE = "\u0000-ԯḀ-῿ -⁯₠-₿぀-ゖ゙-ヿ一-鿌가-힣"
#: The last byte of a word is another symbol than the same byte within it.
END = 256
#: Symbols of a word up to which a scan of all pairs is faster than a heap.
SHORT = 48
#: Between words in what is matched; no symbol.
GAP = chr(1000)


def byte_symbols() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 for itself, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordBpe:
    """Encoder and decoder of one ``tokenizers`` file."""

    def __init__(self, json_path: str):
        import ahocorasick
        import regex

        with open(json_path, encoding="utf-8") as file:
            spec = json.load(file)
        model, suffix = spec["model"], spec["model"]["end_of_word_suffix"]
        split = spec["pre_tokenizer"]["pretokenizers"]
        plain = not any(model[x] for x in ("dropout", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
        if not (model["type"] == "BPE" and suffix and plain and spec["normalizer"] == NORMALIZER and spec["decoder"] is None and split[0]["invert"] and split[1]["type"] == "ByteLevel"):
            raise ValueError(f"{json_path}: only byte-level BPE with word ends, as in the public 49k vocabulary, is supported")
        if any(x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] for x in spec["added_tokens"]):
            raise ValueError("added tokens that take what is around them are not supported")
        self.path, self.library = json_path, None
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.specials = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.pattern = regex.compile(split[0]["pattern"]["Regex"])
        self.unstable = regex.compile(f"[^{STABLE}]")
        self.bytes_of = byte_symbols()
        size = 1 + max([*model["vocab"].values(), *self.special.values()])
        self.names = [None] * size
        for name, i in [*model["vocab"].items(), *self.special.items()]:
            self.names[i] = name

        # symbols: characters below 256 within a word, from 256 on at its end
        self.symbols = {}
        for name, i in model["vocab"].items():
            ended = name.endswith(suffix)
            raw = [self.bytes_of[c] for c in (name[: -len(suffix)] if ended else name)]
            if raw:
                raw[-1] += END * ended
                self.symbols["".join(map(chr, raw))] = i
        self._merges(model, size)
        self.longest = ahocorasick.Automaton()
        for text, i in self.symbols.items():
            if self.sound[i]:
                self.longest.add_word(text, (len(text), i))
        self.longest.make_automaton()
        self.known: dict[str, tuple[int, ...]] = {}
        self.failed = self.met = 0

    def _merges(self, model: dict, size: int) -> None:
        """Tables of merges: keys left * size + right in order, with rank and result; parts and rank by token (-1 for symbols)."""
        vocab = model["vocab"]
        pairs = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in model["merges"]], np.int64)
        self.size, self.left, self.right, self.born = size, *(np.full(size, -1) for _ in range(3))
        self.left[pairs[:, 2]], self.right[pairs[:, 2]], self.born[pairs[:, 2]] = pairs[:, 0], pairs[:, 1], np.arange(len(pairs))
        if len(set(pairs[:, 2].tolist())) < len(pairs) or (self.born[pairs[:, :2]].max(axis=1) >= np.arange(len(pairs))).any():
            raise ValueError("a token has two merges or one before those of its parts")
        keys = pairs[:, 0] * size + pairs[:, 1]
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order
        self.merge = {(a, b): (rank, c) for rank, (a, b, c) in enumerate(pairs.tolist())}
        alone = ~self.crossed(pairs[:, 0], pairs[:, 1], inner=True)
        self.sound = np.zeros(size, bool)
        self.sound[list(self.symbols.values())] = True
        self.sound[pairs[:, 2]] = alone
        for a, b, c in pairs[~alone | (self.born[pairs[:, :2]] >= 0).any(axis=1)].tolist():  # parts come before wholes
            self.sound[c] &= self.sound[a] and self.sound[b]

    def crossed(self, a: np.ndarray, b: np.ndarray, inner: bool = False) -> np.ndarray:
        """Whether merging crosses the border between tokens ``a`` and ``b``; ``inner``: before they would be merged themselves."""
        out = np.zeros(len(a), bool)
        at, never = np.arange(len(a)), np.iinfo(np.int64).max
        ends_a = np.full(len(a), never)
        ends_b = ends_a
        while len(at):
            key = a * self.size + b
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where(self.keys[place] == key, self.ranks[place], never)
            if inner:  # the pair's own merge is the limit
                ends_a, ends_b, inner = rank, rank, False
                rank = np.full(len(at), never)
            hit = (rank < ends_a) & (rank <= ends_b)
            out[at[hit]] = True
            go = ~hit & ((self.born[a] >= 0) | (self.born[b] >= 0))
            at, a, b, ends_a, ends_b = (x[go] for x in (at, a, b, ends_a, ends_b))
            # undo the later of the two; of equal merges the right one comes later
            undo_a = self.born[a] > self.born[b]
            ends_a, ends_b = np.where(undo_a, self.born[a], ends_a), np.where(undo_a, ends_b, self.born[b])
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_a, b, self.left[b])
        return out

    def merged(self, symbols: str) -> tuple[int, ...]:
        """Exact merging of one word, lowest rank first and leftmost among equals."""
        ids = [self.symbols[c] for c in symbols]
        if len(ids) > SHORT:
            return self._merged_long(ids)
        find, none = self.merge.get, (len(self.merge), -1)
        best = [find(pair, none) for pair in zip(ids, ids[1:])]
        while best and (low := min(best)) is not none:
            i = best.index(low)
            ids[i : i + 2] = [low[1]]
            del best[i]
            if i:
                best[i - 1] = find((ids[i - 1], low[1]), none)
            if i < len(best):
                best[i] = find((low[1], ids[i + 1]), none)
        return tuple(ids)

    def _merged_long(self, ids: list[int]) -> tuple[int, ...]:
        """The same with a heap, which stays fast in words of any length."""
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap: list[tuple] = []

        def offer(i: int, j: int) -> None:
            if found := self.merge.get((ids[i], ids[j])):
                heapq.heappush(heap, (found[0], i, found[1], ids[i], ids[j]))

        for i in range(len(ids) - 1):
            offer(i, i + 1)
        while heap:
            _, i, c, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= len(ids) or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = c, -1, after[j]
            if after[i] < len(ids):
                before[after[i]] = i
                offer(i, after[i])
            if before[i] >= 0:
                offer(before[i], i)
        return tuple(i for i in ids if i >= 0)

    def words(self, text: str) -> Iterator[list[str] | int]:
        """Lists of words, and the ids of added tokens between them."""
        at = 0
        for found in self.specials.finditer(text) if self.specials else ():
            yield from self._words(text[at : found.start()])
            yield self.special[found[0]]
            at = found.end()
        yield from self._words(text[at:])

    def _words(self, text: str) -> Iterator[list[str]]:
        if self.unstable.search(text):
            yield self._library_words(text)
            return
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        at = 0
        while at < len(text):
            stop = at + PIECE
            if stop < len(text):  # no word holds a space
                stop = text.rfind(" ", at, stop) + 1 or text.find(" ", stop) + 1 or len(text)
            yield self.pattern.findall(text[at:stop] if at or stop < len(text) else text)
            at = stop

    def _library_words(self, text: str) -> list[str]:
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(self.bytes_of[c] for c in word).decode() for word, _ in found]

    def learn(self, words: Iterable[str]) -> None:
        """Adds the encodings of new words to ``known``: proposals for all, exact merging for those that fail."""
        new = [w for w in words if w not in self.known]
        if not new:
            return
        raw = [w.encode() for w in new]
        symbols = [x[:-1].decode("latin-1") + chr(x[-1] + END) for x in raw]
        lengths = np.array([len(x) for x in symbols])
        begins = np.cumsum(lengths + 1) - lengths - 1
        found = list(self.longest.iter_long(GAP.join(symbols)))
        last = np.array([e for e, _ in found], np.int64)
        size, token = np.array([v for _, v in found], np.int64).reshape(-1, 2).T
        word = np.searchsorted(begins, last, "right") - 1
        covered = np.bincount(word, weights=size, minlength=len(new)).astype(int)
        fine = covered == lengths
        pair = np.flatnonzero(word[:-1] == word[1:])
        keys, back = np.unique(token[pair] * self.size + token[pair + 1], return_inverse=True)
        bad = self.crossed(keys // self.size, keys % self.size)[back]
        fine[word[pair[bad]]] = False
        cuts = np.searchsorted(word, np.arange(len(new) + 1))
        token = token.tolist()
        for w, ok, i, j, s in zip(new, fine.tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), symbols):
            self.known[w] = tuple(token[i:j]) if ok else self.merged(s)
        self.met += len(new)
        self.failed += int((~fine).sum())

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, little-endian uint32."""
        from itertools import chain

        out: list[np.ndarray] = []
        held: list[list] = []
        size = 0

        def flush() -> None:
            if len(self.known) > CACHE_WORDS:
                self.known.clear()
            self.learn(set(chain.from_iterable(p for parts in held for p in parts if isinstance(p, list))))
            known = self.known.__getitem__
            for parts in held:
                ids = [np.fromiter(chain.from_iterable(map(known, p)) if isinstance(p, list) else (p,), "<u4") for p in parts]
                out.append(np.concatenate(ids) if ids else np.zeros(0, "<u4"))
            held.clear()

        for text in texts:
            if len(text) > BATCH:  # pieces of a giant text are encoded one by one
                flush()
                size, ids = 0, []
                for part in self.words(text):
                    held.append([part])
                    flush()
                    ids.append(out.pop())
                out.append(np.concatenate(ids) if ids else np.zeros(0, "<u4"))
                continue
            held.append(list(self.words(text)))
            size += len(text)
            if size > BATCH:
                flush()
                size = 0
        flush()
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The tokens' strings, joined with spaces."""
        return " ".join(map(self.names.__getitem__, ids.tolist()))


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [x or "" for x in column(batch, "text").to_pylist()]


def encoded(docs: DataFrame, json_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids): the ids of every whole text as little-endian uint32."""

    def make():
        codec = WordBpe(json_path)

        def step(batch: pa.RecordBatch) -> Iterator[dict]:
            ids = codec.encode(_texts(batch))
            yield {"doc_id": column(batch, "doc_id"), "n_tokens": [len(x) for x in ids], "ids": [x.tobytes() for x in ids]}

        return step

    return map_batches(columns_as(docs, doc_id=id_col, text=text_col), make, "doc_id long, n_tokens long, ids binary")


def decoded(tokens: DataFrame, json_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of such ids."""

    def make():
        codec = WordBpe(json_path)

        def step(batch: pa.RecordBatch) -> Iterator[dict]:
            yield {"doc_id": column(batch, "doc_id"), "text": [codec.decode(np.frombuffer(x or b"", "<u4")) for x in column(batch, "ids").to_pylist()]}

        return step

    return map_batches(columns_as(tokens, doc_id=id_col, ids=ids_col), make, "doc_id long, text string")


def digest(docs: DataFrame, json_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of ``encoded`` and ``decoded`` in one pass, without sending the ids out of the task."""

    def make():
        codec = WordBpe(json_path)
        sha = lambda x: hashlib.sha256(x).hexdigest()

        def step(batch: pa.RecordBatch) -> Iterator[dict]:
            ids = codec.encode(_texts(batch))
            back = [sha(codec.decode(x).encode()) for x in ids]
            yield {"doc_id": column(batch, "doc_id"), "n_tokens": [len(x) for x in ids], "ids_sha256": list(map(sha, ids)), "decoded_sha256": back}

        return step

    return map_batches(columns_as(docs, doc_id=id_col, text=text_col), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
