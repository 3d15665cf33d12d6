"""Encoding of whole corpora with a public byte-level BPE vocabulary.

Texts are split into words by the tokenizer's own pattern.  The distinct words
of a slice that are not known yet are sorted, which is the depth-first order of
their trie: walking from one word to the next keeps the states of the shared
prefix and computes only the rest.  The state of a prefix is the last token of
its encoding.  A token t that ends a prefix is that last token exactly if t and
the last token of the prefix without t stay apart when their bytes are encoded,
so one lookup chain per byte replaces the merging of whole words, and a prefix
that many words share is encoded once.  Words are remembered by the worker
process, so frequent words cost one dictionary lookup.

Everything runs in the map tasks; nothing is shuffled or broadcast (the
vocabulary is read from its file on each executor).

Defined cases: null, empty texts give an empty list; white space, control and
unassigned characters are encoded like any others; special-token strings are
ordinary text; texts of any length are encoded whole; rows with equal ids are
all kept; other columns, also ones named ``ids``, are ignored.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Words kept by a worker process; when it knows more, it forgets them all and goes on.
KNOWN_WORDS = 300_000
#: Characters whose words are held at a time.
SLICE_CHARS = 1_000_000


def default_vocabulary() -> str:
    """The path of byte_bpe_50k, by the environment or the installed vocabulary files."""
    return os.path.join(os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers"), "byte_bpe_50k.tiktoken")


#: Fixed value: the pattern by which the tokenizer splits texts into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class TrieEncoder:
    """Words to token ids by last-token states along a trie of words."""

    def __init__(self, vocabulary: str, pattern: str = PATTERN):
        import regex

        with open(vocabulary, "rb") as lines:
            self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.bytes = {i: b for b, i in self.rank.items()}
        self.split = regex.compile(pattern).findall
        self.known: dict[str, tuple[int, ...]] = {}
        self._left: dict[int, list] = {}
        self._right: dict[int, list] = {}
        self._apart: dict[int, bool] = {}
        self._shorter: dict[int, int] = {}
        self._whole: dict[int, bool] = {}
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._steps: dict[bytes, tuple[bytes, int]] = {}
        self._heads = {b[:i] for b in self.rank for i in range(1, len(b) + 1)}

    # -- facts about tokens, found when first needed -----------------------------------------
    def _merge(self, piece: bytes, parts_left: int) -> list[bytes]:
        """Merge ``piece`` by lowest rank until no pair is left or only ``parts_left`` parts are."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > parts_left:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``token``; None for single bytes."""
        got = self._halves.get(token, 0)
        if got == 0:
            piece = self.bytes[token]
            two = self._merge(piece, 2) if len(piece) > 1 else []
            got = (self.rank[two[0]], self.rank[two[1]]) if len(two) == 2 else None
            self._halves[token] = got
        return got

    def _edge(self, token: int, side: int) -> list[tuple[bytes, float]]:
        """The outermost tokens on one side of ``token`` while it is built, innermost first, each with the rank of the merge that ends it."""
        memo = self._right if side else self._left
        got = memo.get(token)
        if got is None:
            got, t, until = [], token, float("inf")
            while True:
                got.append((self.bytes[t], until))
                parts = self._parts(t)
                if parts is None:
                    break
                until, t = t, parts[side]
            got.reverse()
            memo[token] = got
        return got

    def stay_apart(self, a: int, b: int) -> bool:
        """Whether the bytes of a and b together are encoded as [a, b]."""
        key = a << 20 | b
        got = self._apart.get(key)
        if got is None:
            left, right, i, j, got = self._edge(a, 1), self._edge(b, 0), 0, 0, True
            rank = self.rank.get
            while True:
                (x, ends_x), (y, ends_y) = left[i], right[j]
                across = rank(x + y)
                if across is not None and across < ends_x and across <= ends_y:
                    got = False
                    break
                if i + 1 == len(left) and j + 1 == len(right):
                    break
                if ends_x <= ends_y:
                    i += 1
                else:
                    j += 1
            self._apart[key] = got
        return got

    def _is_whole(self, token: int) -> bool:
        got = self._whole.get(token)
        if got is None:
            got = self._whole[token] = len(self._merge(self.bytes[token], 1)) == 1
        return got

    def _next_shorter(self, token: int) -> int:
        """The longest token that is a proper suffix of ``token``; -1 for single bytes."""
        got = self._shorter.get(token)
        if got is None:
            piece, got = self.bytes[token], -1
            for i in range(1, len(piece)):
                r = self.rank.get(piece[i:])
                if r is not None:
                    got = r
                    break
            self._shorter[token] = got
        return got

    def _step(self, reached: bytes) -> tuple[bytes, int]:
        """The longest suffix of ``reached`` that begins some token, and the longest token that ends there."""
        state = reached
        while state not in self._heads:
            state = state[1:]
        token, i = self.rank.get(state), 0
        while token is None:
            i += 1
            token = self.rank.get(state[i:])
        got = self._steps[reached] = (state, token)
        return got

    # -- the trie ---------------------------------------------------------------------------
    def _learn(self, words: Iterable[str]) -> None:
        """Encode ``words`` in depth-first order of their trie."""
        rank, bytes_, apart, shorter, steps = self.rank, self.bytes, self._apart, self._next_shorter, self._steps
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
        if len(apart) > 4 * KNOWN_WORDS:
            apart.clear()
        if len(steps) > 4 * KNOWN_WORDS:
            steps.clear()
        todo = []
        for word in words:
            piece = word.encode()
            r = rank.get(piece)
            if r is not None and self._is_whole(r):
                self.known[word] = (r,)
            else:
                todo.append((piece, word))
        todo.sort()
        before = b""
        last: list[int] = [-1]  # last[i]: the last token of the encoding of the first i bytes
        states: list[bytes] = [b""]  # states[i]: what of the first i bytes may still grow into a token
        for piece, word in todo:
            common = 0
            top = min(len(before), len(piece))
            if before[:top] == piece[:top]:
                common = top
            else:
                while before[common] == piece[common]:
                    common += 1
            del last[common + 1 :], states[common + 1 :]
            for end in range(common + 1, len(piece) + 1):
                reached = states[-1] + piece[end - 1 : end]
                found = steps.get(reached) or self._step(reached)
                states.append(found[0])
                token = found[1]
                while True:
                    start = end - len(bytes_[token])
                    if start == 0:
                        if self._is_whole(token):
                            break
                    else:
                        ok = apart.get(last[start] << 20 | token)
                        if ok is None:
                            ok = self.stay_apart(last[start], token)
                        if ok:
                            break
                    token = shorter(token)
                last.append(token)
            ids, end = [], len(piece)
            while end:
                ids.append(last[end])
                end -= len(bytes_[last[end]])
            ids.reverse()
            self.known[word] = tuple(ids)
            before = piece

    def words(self, texts: list[str]) -> list[list[str]]:
        """The words of each text, all of them known afterwards."""
        found = [self.split(t) if t else [] for t in texts]
        fresh = set().union(*found).difference(self.known) if found else ()
        if fresh:
            forgets = len(self.known) > KNOWN_WORDS
            self._learn(set().union(*found) if forgets else fresh)
        return found

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        known = self.words(texts), self.known
        return [[i for w in words for i in known[1][w]] for words in known[0]]

    def count_batch(self, texts: list[str]) -> list[int]:
        found = self.words(texts)
        size = {w: len(self.known[w]) for w in set().union(*found)} if found else {}
        return [sum(map(size.__getitem__, words)) for words in found]


@lru_cache(maxsize=4)
def encoder(vocabulary: str) -> TrieEncoder:
    """The worker process's encoder for a vocabulary file."""
    return TrieEncoder(vocabulary)


def slices(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of runs of rows with about SLICE_CHARS characters; a longer text is alone."""
    values = texts.to_pylist()
    start, size = 0, 0
    for i, t in enumerate(values):
        n = len(t) if t else 0
        if i > start and size + n > SLICE_CHARS:
            yield start, values[start:i]
            start, size = i, 0
        size += n
    if values:
        yield start, values[start:]


def _ids(vocabulary: str, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            keys = batch.column(0)
            for start, texts in slices(batch.column(1)):
                found = enc.words(texts)
                known = enc.known
                flat: list[int] = []
                ends = [0]
                for words in found:
                    for w in words:
                        flat.extend(known[w])
                    ends.append(len(flat))
                ids = pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), pa.array(np.array(flat, np.int32)))
                yield pa.RecordBatch.from_arrays([keys.slice(start, len(texts)), ids], names=[key, "ids"])

    return run


def _counts(vocabulary: str, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            counts = [n for _, texts in slices(batch.column(1)) for n in enc.count_batch(texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=[key, "n_tokens"])

    return run


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """key and ids array<int>: the token ids of each row's text, without special tokens."""
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(_ids(vocabulary or default_vocabulary(), key), f"`{key}` {kind}, ids array<int>")


def count_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """key and n_tokens: the number of tokens of each row's text, 0 for null."""
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(_counts(vocabulary or default_vocabulary(), key), f"`{key}` {kind}, n_tokens bigint")
