"""The functions Spark has no expression for, vectorised."""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .records import LARGE_FILE, LARGE_PROFILE, PROFILE


def _folded(path: str | None) -> str | None:
    if path is None:
        return None
    if path.isascii():
        return path.lower()
    nfkc = lambda t: unicodedata.normalize("NFKC", t)
    return "/".join(nfkc(nfkc(c).casefold()) for c in path.split("/"))


@F.pandas_udf(StringType())
def collision_key(paths: pd.Series) -> pd.Series:
    """Per component: compatibility form, full case folding, compatibility form."""
    return pd.Series([_folded(p) for p in paths], dtype=object)


def _gear() -> np.ndarray:
    """256 fixed 64-bit numbers of the rolling hash, from a rule: digests of the byte values."""
    return np.array([int.from_bytes(hashlib.sha256(bytes([b])).digest()[:8], "little") for b in range(256)], dtype=np.uint64)


_GEAR = _gear()
#: Bytes before a place that its hash depends on.
_REACH = 64


def _rolled(data: np.ndarray) -> np.ndarray:
    """The gear hash at every place: the sum of the 64 last bytes' numbers, each shifted by its distance, by doubling windows."""
    rolled = _GEAR[data]
    k = 1
    while k < _REACH:
        rolled[k:] += rolled[:-k] << np.uint64(k)
        k *= 2
    return rolled


def _places(rolled: np.ndarray, mean: int) -> tuple[np.ndarray, np.ndarray]:
    """Where a chunk may end: by the harder rule before the mean size, by the easier one behind it."""
    bits = max(1, mean.bit_length() - 1)
    hard = np.uint64(((1 << (bits + 1)) - 1) << 16)
    easy = np.uint64(((1 << max(1, bits - 1)) - 1) << 16)
    return np.flatnonzero((rolled & hard) == 0), np.flatnonzero((rolled & easy) == 0)


def _ends(strict: np.ndarray, loose: np.ndarray, first: int, n: int, low: int, mean: int, high: int) -> list[int]:
    """Ends of the chunks of the file that lies from ``first`` to ``n``."""
    ends, start = [], first
    while n - start > low:
        middle, stop = min(start + mean, n), min(start + high, n)
        i = int(np.searchsorted(strict, start + low))
        end = int(strict[i]) + 1 if i < len(strict) and strict[i] < middle else 0
        if not end:
            j = int(np.searchsorted(loose, max(middle, start + low)))
            end = int(loose[j]) + 1 if j < len(loose) and loose[j] < stop else stop
        ends.append(end)
        start = end
    if start < n:
        ends.append(n)
    return ends


def cut_points(data: bytes, low: int, mean: int, high: int) -> list[int]:
    """Ends of content-defined chunks: published gear rolling hash with normalised masks, at least low and at most high bytes; low is 64 or more.

    The hash at a place depends on the 64 bytes before it only, so all places are computed at once.
    """
    if len(data) <= low:
        return [len(data)] if data else []
    return _ends(*_places(_rolled(np.frombuffer(data, dtype=np.uint8)), mean), 0, len(data), low, mean, high)


def profile_of(size: int) -> tuple[int, int, int]:
    """The chunk sizes for a file of this size."""
    return LARGE_PROFILE if size >= LARGE_FILE else PROFILE


def stream_chunks(read: Callable[[int], bytes], profile: tuple[int, int, int]) -> Iterator[tuple[int, int, str]]:
    """(offset, length, digest) of a file's chunks, read in order; at most two chunks of the largest size are held."""
    low, mean, high = profile
    held, at, more = b"", 0, True
    while more or held:
        while more and len(held) < 2 * high:
            piece = read(high)
            more = bool(piece)
            held += piece
        ends = cut_points(held, low, mean, high)
        # with less than a whole chunk behind it, an end may be the buffer's and not the file's
        sure = ends if not more else [e for e in ends if len(held) - e >= high]
        start = 0
        for end in sure:
            yield at + start, end - start, hashlib.sha256(held[start:end]).hexdigest()
            start = end
        held, at = held[start:], at + start


def content_chunks(files: DataFrame, path: str = "path", content: str = "content", profile: tuple[int, int, int] | None = None) -> DataFrame:
    """(path, idx, chunk_offset, length, hash) of the chunks of every file; content is binary, null has none.

    profile is (least, mean, most) bytes, by default the one for the file's size. The files of a batch lie end to end for one pass of the
    rolling hash: a chunk's end depends on bytes of its own file only, since no chunk is shorter than the hash's reach.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(1)
            raw = raw.fill_null(b"") if raw.null_count else raw
            offsets = np.frombuffer(raw.buffers()[1], dtype=np.int64 if pa.types.is_large_binary(raw.type) else np.int32)[raw.offset : raw.offset + len(raw) + 1].astype(np.int64)
            data = np.frombuffer(raw.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]] if raw.buffers()[2] is not None and len(raw) else np.zeros(0, np.uint8)
            offsets = offsets - offsets[0] if len(offsets) else offsets
            rolled, places, view = _rolled(data), {}, memoryview(data)
            which, index, begin, length, digests = [], [], [], [], []
            for row in range(len(raw)):
                first, last = int(offsets[row]), int(offsets[row + 1])
                low, mean, high = profile or profile_of(last - first)
                if mean not in places:
                    places[mean] = _places(rolled, mean)
                start = first
                for i, end in enumerate(_ends(*places[mean], first, last, low, mean, high)):
                    which.append(row)
                    index.append(i)
                    begin.append(start - first)
                    length.append(end - start)
                    digests.append(hashlib.sha256(view[start:end]).hexdigest())
                    start = end
            columns = [batch.column(0).take(pa.array(which, pa.int64())), pa.array(index, pa.int32()), pa.array(begin, pa.int64()), pa.array(length, pa.int64()), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[path, "idx", "chunk_offset", "length", "hash"])

    return files.select(path, content).mapInArrow(run, f"{path} {dict(files.dtypes)[path]}, idx int, chunk_offset long, length long, hash string")


def seeded_bytes(seed: int, label: str, length: int) -> bytes:
    """Deterministic test payload: a linear congruential generator started from seed and label."""
    state = int.from_bytes(hashlib.sha256(f"{seed}|{label}".encode()).digest()[:8], "little")
    out = bytearray()
    while len(out) < length:
        state = (state * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        out += state.to_bytes(8, "little")
    return bytes(out[:length])
