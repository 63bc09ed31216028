"""BPE encoding and decoding with a pair occurrence index.

The words of a batch that are not in the worker's memory yet are laid out as one array of symbols. An index maps each
mergeable pair to all its positions. Active ranks are applied in ascending order: all positions of a rank merge at
once, links to the neighbours are updated, and the pairs that arise join their lists. A vocabulary whose merges could
revive a lower rank is refused, so one ascending sweep equals merging word by word.

Texts are normalised as the file says (NFC, white space, lower case), split at white space, and each chunk's words are
looked up. Chunks of plain Latin letters take a short path; any other text goes through the library's own normaliser
and splitter. Strings of special tokens in a text are special, as by the library's default.

Defined cases: a null text counts as empty: no ids, empty decoded text; repeated rows each get a row; no rows, no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import text_rows

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Letters whose lower case and composition are the same in every library: up to Latin Extended-A, less U+0130 (its
#: lower case is two characters), U+0085 and U+00A0 (white space), and the controls that differ as white space.
_PLAIN = re.compile("[\t\n\r -~¡-įı-ſ]*\\Z")
_MEMORY = 900_000


class Encoded(NamedTuple):
    n: int
    ids: bytes
    text: str


class PairIndexBpe:
    """The merges of one vocabulary file, and the sweep over a batch of words."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("unk_token") or model.get("byte_fallback"):
            raise ValueError("not a plain BPE vocabulary")
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.tokens = {i: t for t, i in self.vocab.items()} | {x["id"]: x["content"] for x in spec["added_tokens"]}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        width = max(self.vocab.values()) + 1
        self.width = np.int64(width)
        left, right, made, born = [], [], [], {}
        for rank, (a, b) in enumerate(tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]):
            if max(born.get(a, -1), born.get(b, -1)) > rank or a + b in born:
                raise ValueError("merges are not in the order in which their parts arise")
            born[a + b] = rank
            left.append(self.vocab[a])
            right.append(self.vocab[b])
            made.append(self.vocab[a + b])
        self.left, self.right, self.made = (np.array(x, dtype=np.int64) for x in (left, right, made))
        keys = self.left * self.width + self.right
        self.rank_of = np.argsort(keys)
        self.keys = keys[self.rank_of]

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.width + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank_of[at], -1)

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of each word; words are non-empty and in the byte alphabet."""
        symbols, ends = [], []
        vocab, suffix = self.vocab, self.suffix
        for w in words:
            symbols.extend(map(vocab.__getitem__, w[:-1]))
            symbols.append(vocab[w[-1] + suffix])
            ends.append(len(symbols))
        if not symbols:
            return [[] for _ in words]
        sym = np.array(symbols, dtype=np.int64)
        n = len(sym)
        after = np.arange(1, n + 1)
        after[np.array(ends) - 1] = -1
        before = np.arange(-1, n - 1)
        before[np.concatenate([[0], ends[:-1]])] = -1
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def enter(at: np.ndarray) -> None:
            """Put positions into the lists of their pairs."""
            rank = self._ranks(sym[at], sym[after[at]])
            known = rank >= 0
            at, rank = at[known], rank[known]
            if not len(at):
                return
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cut = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            for r, part in zip(rank[np.concatenate([[0], cut])].tolist(), np.split(at, cut)):
                if r in index:
                    index[r].append(part)
                else:
                    index[r] = [part]
                    heapq.heappush(active, r)

        enter(np.flatnonzero(after >= 0))
        while active:
            rank = heapq.heappop(active)
            held = index.pop(rank)
            at = held[0] if len(held) == 1 else np.unique(np.concatenate(held))
            a, b = self.left[rank], self.right[rank]
            at = at[(sym[at] == a) & (after[at] >= 0)]
            at = at[sym[after[at]] == b]
            if not len(at):
                continue
            if a == b and len(at) > 1:
                # runs of one symbol merge from the left: every second position of a run
                at = np.sort(at)
                joined = np.concatenate([[False], after[at[:-1]] == at[1:]])
                first = np.maximum.accumulate(np.where(joined, 0, np.arange(len(at))))
                at = at[(np.arange(len(at)) - first) % 2 == 0]
            gone = after[at]
            then = after[gone]
            sym[at] = self.made[rank]
            sym[gone] = -1
            after[at] = then
            inner = then >= 0
            before[then[inner]] = at[inner]
            prior = before[at]
            enter(np.unique(np.concatenate([at[inner], prior[prior >= 0]])))
        kept = np.flatnonzero(sym >= 0)
        ids = sym[kept]
        return [x.tolist() for x in np.split(ids, np.searchsorted(kept, ends[:-1]))]

    def decode(self, ids: list[int]) -> str:
        """As the library decodes when a file names no decoder: tokens joined by one space."""
        return " ".join(self.tokens[i] for i in ids)


class TextCoder:
    """Whole texts, with a bounded memory of chunks."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        from .packing import byte_alphabet

        self.bpe = PairIndexBpe(path)
        spec = json.load(open(path, encoding="utf-8"))
        library = Tokenizer.from_file(path)
        self.normalise, self.split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern).findall
        self.alphabet = {b: c for c, b in byte_alphabet().items()}
        marks = sorted(self.bpe.special, key=len, reverse=True)
        self.marks = re.compile("(" + "|".join(map(re.escape, marks)) + ")") if marks else None
        self.chunks: dict[str, Encoded] = {}
        self._forget()

    def _forget(self) -> None:
        self.chunks.clear()
        self.chunks.update({"\1" + c: Encoded(1, str(i).encode(), c) for c, i in self.bpe.special.items()})

    def _byte_word(self, word: str) -> str:
        return word if word.isascii() else "".join(map(self.alphabet.__getitem__, word.encode()))

    def _keys(self, text: str) -> list[str]:
        """What to look up for a text: plain chunks, or the library's words after \\0, and special tokens after \\1."""
        if self.marks is not None and self.marks.search(text):
            parts = self.marks.split(text)
            return [k for p in parts for k in (["\1" + p] if p in self.bpe.special else self._odd(p))]
        return text.lower().split() if _PLAIN.match(text) else self._odd(text)

    def _odd(self, text: str) -> list[str]:
        return ["\0" + w for w, _ in self.split(self.normalise(text))] if text else []

    def _words(self, key: str) -> list[str]:
        return [key[1:]] if key[0] == "\0" else [self._byte_word(w) for w in self.words(key)]

    def _learn(self, keys: set[str]) -> None:
        missing = [k for k in keys if k not in self.chunks]
        if len(self.chunks) + len(missing) > _MEMORY:
            self._forget()
            missing = [k for k in keys if k not in self.chunks]
        pieces = [self._words(k) for k in missing]
        words = list(dict.fromkeys(w for p in pieces for w in p))
        ids = dict(zip(words, self.bpe.encode_words(words)))
        for key, p in zip(missing, pieces):
            got = [i for w in p for i in ids[w]]
            self.chunks[key] = Encoded(len(got), " ".join(map(str, got)).encode(), self.bpe.decode(got))

    def lookup(self, texts: list[str]) -> Iterator[list[Encoded]]:
        """The encoded chunks of each text, in order, without those that have no id."""
        for part in self._portions(texts):
            keys = [self._keys(t) for t in part]
            self._learn(set().union(*keys))
            for k in keys:
                yield [x for x in map(self.chunks.__getitem__, k) if x.n]

    def digests(self, found: list[Encoded]) -> tuple[int, str, str]:
        ids = hashlib.sha256(b" ".join([x.ids for x in found])).hexdigest()
        decoded = hashlib.sha256(" ".join([x.text for x in found]).encode()).hexdigest()
        return sum([x.n for x in found]), ids, decoded

    @staticmethod
    def _portions(texts: list[str], chars: int = 24_000_000) -> Iterator[list[str]]:
        part, held = [], 0
        for t in texts:
            part.append(t)
            held += len(t)
            if held >= chars:
                yield part
                part, held = [], 0
        if part:
            yield part


_coders: dict[str, TextCoder] = {}


def text_coder(path: str) -> TextCoder:
    if path not in _coders:
        _coders[path] = TextCoder(path)
    return _coders[path]


def _code_batches(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = text_coder(path)
        for batch in batches:
            found = [coder.digests(x) for x in coder.lookup(batch.column(1).to_pylist())]
            n, ids, decoded = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return run


def encode_digests(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Number of ids, and digests of ids and of the decoded text, per row."""
    return text_rows(df, id_col, text_col).mapInArrow(_code_batches(tokenizer_path), SCHEMA)


def _id_batches(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = text_coder(path)
        for batch in batches:
            ids = [[int(i) for x in found for i in x.ids.split()] for found in coder.lookup(batch.column(1).to_pylist())]
            decoded = [coder.bpe.decode(x) for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())], names=["doc_id", "ids", "decoded"])

    return run


def encode(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int> and decoded string per row."""
    return text_rows(df, id_col, text_col).mapInArrow(_id_batches(tokenizer_path), "doc_id long, ids array<int>, decoded string")
