"""Encoding a whole corpus with a public byte-level BPE vocabulary.

A text is cut into words by the vocabulary's pattern; a word met before costs one dictionary lookup. The
new words of a batch are laid end to end and merged together by a pair occurrence index: each mergeable
pair has the list of all its positions in the batch; the active pairs are applied in ascending rank, each
once and at all its positions at a stroke, and a merge adds the pairs it forms with both neighbours to
their lists. A pair formed by a merge always ranks behind it, so one ascending sweep is exact.

Defined results: null and empty texts give an empty list. Strings of special tokens are ordinary text. Very
long words are merged like others, by position lists. Repeated rows give repeated rows.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ..runtime import spread

#: Path of the vocabulary; executors read it too.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"

#: Fixed value: how the vocabulary's publisher cuts text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Words remembered by a worker; beyond that it starts anew.
REMEMBERED = 1_500_000


def _byte_letters() -> dict[str, int]:
    """The published stand-in letters of the 256 bytes: printable ones stand for themselves, the rest follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class PairIndex:
    """The merge rules as sorted arrays, and the sweep over a batch of words."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        ids: dict[str, int] = model["vocab"]
        self.byte_id = np.zeros(256, dtype=np.int64)
        for letter, byte in _byte_letters().items():
            self.byte_id[byte] = ids[letter]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.left = np.array([ids[a] for a, _ in merges], dtype=np.int64)
        self.right = np.array([ids[b] for _, b in merges], dtype=np.int64)
        self.made = np.array([ids[a + b] for a, b in merges], dtype=np.int64)
        self.width = int(max(ids.values())) + 1
        keys = self.left * self.width + self.right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order
        self.of = dict(zip(keys.tolist(), range(len(keys)), strict=True))

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs, -1 where there is no rule."""
        key = a * self.width + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], -1)

    def encode(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word."""
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        n = int(lengths.sum())
        if not n:
            return [np.zeros(0, dtype=np.int32) for _ in words]
        sym = self.byte_id[np.frombuffer(b"".join(words), dtype=np.uint8)]
        ends = np.cumsum(lengths)
        starts = ends - lengths
        nxt = np.arange(1, n + 1, dtype=np.int64)
        prv = np.arange(-1, n - 1, dtype=np.int64)
        some = lengths > 0
        nxt[ends[some] - 1] = -1  # no pair reaches over the end of a word
        prv[starts[some]] = -1
        alive = np.ones(n, dtype=bool)
        at = np.flatnonzero(nxt >= 0)
        ranks = self.rank(sym[at], sym[nxt[at]])
        at, ranks = at[ranks >= 0], ranks[ranks >= 0]
        order = np.argsort(ranks, kind="stable")
        lists: dict[int, list[np.ndarray]] = {}
        _spread(lists, at[order], ranks[order])
        active = list(lists)
        heapq.heapify(active)
        while active:
            r = heapq.heappop(active)
            parts = lists.pop(r)
            a, b, made = self.left[r], self.right[r], self.made[r]
            p = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
            p = p[alive[p] & (sym[p] == a)]
            q = nxt[p]
            good = q >= 0
            p, q = p[good], q[good]
            good = sym[q] == b
            p, q = p[good], q[good]
            if a == b and len(p) > 1:  # of overlapping positions in a run, every other one
                p = np.sort(p)
                q = nxt[p]
                new_run = np.r_[True, q[:-1] != p[1:]]
                run = np.flatnonzero(new_run)
                offset = np.arange(len(p)) - np.repeat(run, np.diff(np.r_[run, len(p)]))
                p, q = p[offset % 2 == 0], q[offset % 2 == 0]
            if not len(p):
                continue
            sym[p] = made
            alive[q] = False
            after = nxt[q]
            nxt[p] = after
            has = after >= 0
            prv[after[has]] = p[has]
            before = prv[p]
            lefts = before[before >= 0]
            at = np.unique(np.concatenate([lefts, p[has]]))  # neighbouring merges share a position
            if not len(at):
                continue
            ranks = self.rank(sym[at], sym[nxt[at]])
            keep = ranks >= 0
            at, ranks = at[keep], ranks[keep]
            if len(at):
                order = np.argsort(ranks, kind="stable")
                for new in _spread(lists, at[order], ranks[order]):
                    heapq.heappush(active, new)
        left = np.flatnonzero(alive)
        ids = sym[left].astype(np.int32)
        cuts = np.searchsorted(left, ends)
        return np.split(ids, cuts[:-1])


def _spread(lists: dict[int, list[np.ndarray]], at: np.ndarray, ranks: np.ndarray) -> list[int]:
    """Add positions, sorted by rank, to the ranks' lists; the ranks that had none."""
    if not len(at):
        return []
    edges = np.flatnonzero(np.r_[True, ranks[1:] != ranks[:-1]])
    new = []
    for i, j in zip(edges.tolist(), [*edges[1:].tolist(), len(ranks)], strict=True):
        r = int(ranks[i])
        if r in lists:
            lists[r].append(at[i:j])
        else:
            lists[r] = [at[i:j]]
            new.append(r)
    return new


class Numbering(dict):
    """Word to its number; a new word gets the next one and waits for encoding."""

    def __init__(self) -> None:
        super().__init__()
        self.waiting: list[str] = []

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.waiting.append(word)
        return n


class Encoder:
    def __init__(self, path: str):
        self.index = PairIndex(path)
        self.words = regex.compile(WORDS)
        self.forget()

    def forget(self) -> None:
        self.number = Numbering()
        self.flat = np.zeros(1 << 16, dtype=np.int32)
        self.ends = np.zeros(1 << 14, dtype=np.int64)

    def _settle(self) -> None:
        """Encode the waiting words and lay their ids behind the known ones."""
        waiting, known = self.number.waiting, len(self.number)
        if not waiting:
            return
        done = known - len(waiting)
        coded = self.index.encode([w.encode("utf-8", "surrogatepass") for w in waiting])
        sizes = np.fromiter(map(len, coded), dtype=np.int64, count=len(coded))
        base = int(self.ends[done - 1]) if done else 0
        ends = base + np.cumsum(sizes)
        if known > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros(max(known, len(self.ends)), dtype=np.int64)])
        if ends[-1] > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(int(ends[-1]), len(self.flat)), dtype=np.int32)])
        self.ends[done:known] = ends
        self.flat[base : int(ends[-1])] = np.concatenate(coded)
        waiting.clear()

    def numbers(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of all texts end to end, and how many words each text has; all words are known afterwards."""
        if len(self.number) > REMEMBERED:
            self.forget()
        get, find = self.number.__getitem__, self.words.findall
        counts = np.zeros(len(texts), dtype=np.int64)
        parts = []
        for i, t in enumerate(texts):
            if t:
                found = find(t)
                counts[i] = len(found)
                parts.append(np.fromiter(map(get, found), dtype=np.int64, count=len(found)))
        self._settle()
        return (np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)), counts

    def _sizes(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ends = self.ends[numbers]
        starts = np.where(numbers > 0, self.ends[numbers - 1], 0)
        return starts, ends - starts

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids end to end, and the offsets of each text's."""
        numbers, counts = self.numbers(texts)
        starts, sizes = self._sizes(numbers)
        total = np.concatenate([[0], np.cumsum(sizes)])
        take = np.repeat(starts - total[:-1], sizes) + np.arange(total[-1])
        return self.flat[take], total[np.concatenate([[0], np.cumsum(counts)])]

    def count(self, texts: list[str | None]) -> np.ndarray:
        numbers, counts = self.numbers(texts)
        total = np.concatenate([[0], np.cumsum(self._sizes(numbers)[1])])
        edges = total[np.concatenate([[0], np.cumsum(counts)])]
        return np.diff(edges)


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


#: Characters that are encoded at once.
_SLICE = 4_000_000


def _slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= _SLICE:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode_corpus(documents: DataFrame, vocabulary: str = VOCABULARY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>), one row per row of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(vocabulary)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for i, j in _slices(texts):
                ids, offsets = code.encode(texts[i:j])
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), lists], names=[key, "ids"])

    return spread(documents.select(key, text)).mapInArrow(run, f"{key} {dict(documents.dtypes)[key]}, ids array<int>")


def count_tokens(documents: DataFrame, vocabulary: str = VOCABULARY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens long), one row per row of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(vocabulary)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for i, j in _slices(texts):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(code.count(texts[i:j]))], names=[key, "n_tokens"])

    return spread(documents.select(key, text)).mapInArrow(run, f"{key} {dict(documents.dtypes)[key]}, n_tokens long")
