"""Packed exchange of digests.

A digest is sent to the partition its high bits name, together with the document
and place it stands for. All that one batch sends to one partition is one row:
digests as plain bytes, documents and places as compressed columns. A batch sends
a digest that it holds many times only once where the rule allows, so a digest
that a third of all documents share costs one entry per batch.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "part int, kind int, blob binary"
#: Kinds of rows: digests to be compared; places already decided in their batch, passed on.
ASK, TOLD = 0, 1


def part_of(h: np.ndarray, parts: int) -> np.ndarray:
    """Partition of 64-bit digests, by their high 32 bits."""
    return (((h >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A fixed permutation of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def spans(sorted_: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of each run of equal numbers."""
    if not len(sorted_):
        return []
    cuts = np.flatnonzero(sorted_[1:] != sorted_[:-1]) + 1
    return list(zip([0, *cuts], [*cuts, len(sorted_)], strict=True))


def _planes(a: np.ndarray) -> bytes:
    """The bytes of an array, first bytes first: high bytes of small numbers then compress to nothing."""
    return a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes()


def _from_planes(raw: bytes, at: int, n: int, dtype) -> tuple[np.ndarray, int]:
    size = np.dtype(dtype).itemsize
    return np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T.copy().view(dtype).ravel(), at + n * size


def pack(keys: np.ndarray | None, docs: np.ndarray, columns: list[np.ndarray]) -> bytes:
    """keys: (n, width) bytes or None; docs: n ids, equal ones together; columns: n numbers each."""
    n = len(docs)
    cut = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1]])) if n else np.zeros(0, np.int64)
    own = docs[cut].astype(np.int64)
    counts = np.diff(np.append(cut, n)).astype(np.uint32)
    rest = _planes(np.diff(own, prepend=0)) + _planes(counts) + b"".join(_planes(np.ascontiguousarray(c)) for c in columns)
    key = b"" if keys is None else np.ascontiguousarray(keys).tobytes()
    return struct.pack("<III", n, len(cut), len(key)) + key + zstandard.compress(rest, 1)


def unpack(blob: bytes, dtypes: list) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    n, m, size = struct.unpack_from("<III", blob)
    keys = np.frombuffer(blob, np.uint8, size, 12).reshape(n, size // n if n else 0)
    raw = zstandard.decompress(blob[12 + size :])
    own, at = _from_planes(raw, 0, m, np.int64)
    counts, at = _from_planes(raw, at, m, np.uint32)
    columns = []
    for d in dtypes:
        c, at = _from_planes(raw, at, n, d)
        columns.append(c)
    return keys, np.repeat(np.cumsum(own), counts), columns


def rows(part: np.ndarray, kind: int, keys: np.ndarray | None, docs: np.ndarray, columns: list[np.ndarray]) -> list[tuple[int, int, bytes]]:
    """One row per partition that gets something; entries keep their order."""
    order = np.argsort(part.astype(np.uint16) if not len(part) or part.max() < 1 << 16 else part, kind="stable")
    sorted_ = part[order]
    out = []
    for a, b in spans(sorted_):
        o = order[a:b]
        out.append((int(sorted_[a]), kind, pack(None if keys is None else keys[o], docs[o], [c[o] for c in columns])))
    return out


def frame(found: list[tuple[int, int, bytes]]) -> pd.DataFrame:
    return pd.DataFrame(found, columns=["part", "kind", "blob"]) if found else pd.DataFrame({"part": pd.Series([], dtype="int32"), "kind": pd.Series([], dtype="int32"), "blob": pd.Series([], dtype=object)})


def same(order: np.ndarray, keys: list[np.ndarray]) -> np.ndarray:
    """Number of the run of equal keys that each place of order belongs to."""
    new = np.zeros(len(order), bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    return np.cumsum(new)


def shared(order: np.ndarray, run: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each run: its size, smallest and largest document."""
    if not len(order):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
    d = docs[order]
    return np.diff(np.append(cut, len(order))), np.minimum.reduceat(d, cut), np.maximum.reduceat(d, cut)


def digest_key(h: np.ndarray, more: np.ndarray | None = None) -> np.ndarray:
    """The bytes that are sent: the low 5 of h, or with a second digest its 8 and the low 2 of h. The partition tells more bits."""
    low = h.view(np.uint8).reshape(-1, 8)
    return low[:, :5] if more is None else np.hstack([more.view(np.uint8).reshape(-1, 8), low[:, :2]])


def key_numbers(keys: np.ndarray) -> list[np.ndarray]:
    """The bytes back as numbers to sort and compare by."""
    n, width = keys.shape
    if width == 10:
        return [np.ascontiguousarray(keys[:, :8]).view(np.uint64).ravel(), np.ascontiguousarray(keys[:, 8:]).view(np.uint16).ravel()]
    full = np.zeros((n, 8), np.uint8)
    full[:, :width] = keys
    return [full.view(np.uint64).ravel()]


def ordered(keys: list[np.ndarray]) -> np.ndarray:
    return np.argsort(keys[0]) if len(keys) == 1 else np.lexsort(keys[::-1])


def exchange(found: DataFrame, parts: int) -> DataFrame:
    """Rows go to the partition of their number."""
    return found.repartitionById(parts, "part") if hasattr(found, "repartitionById") else found.repartition(parts, "part")


def resolve(found: DataFrame, parts: int, dtypes: list, choose: Callable, record: np.dtype) -> DataFrame:
    """Compare the digests of each partition; one row (key, found) per document, with records of the entries that choose keeps.

    choose(order, run, docs) gives a mask over order. TOLD entries are passed on. Entries go
    on packed, now dealt by document. A partition's digests, and then its documents' records,
    are in memory at once; their number falls with the number of partitions.
    """

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked: dict[int, list[bytes]] = {}
        for b in batches:
            told = [unpack(x, dtypes) for x in b.loc[b["kind"] == TOLD, "blob"]]
            if told:
                yield frame(by_document(np.concatenate([t[1] for t in told]), [np.concatenate([t[2][k] for t in told]) for k in range(len(dtypes))], parts))
            for p, blob in zip(b.loc[b["kind"] == ASK, "part"], b.loc[b["kind"] == ASK, "blob"], strict=True):
                asked.setdefault(p, []).append(blob)
        for p in list(asked):
            got = [unpack(x, dtypes) for x in asked.pop(p)]
            keys = key_numbers(np.concatenate([g[0] for g in got]))
            docs = np.concatenate([g[1] for g in got])
            order = ordered(keys)
            keep = order[choose(order, same(order, keys), docs)]
            yield frame(by_document(docs[keep], [np.concatenate([g[2][i] for g in got])[keep] for i in range(len(dtypes))], parts))

    return gathered(exchange(found, parts).mapInPandas(decide, SCHEMA), parts, dtypes, record)


def by_document(docs: np.ndarray, columns: list[np.ndarray], parts: int) -> list[tuple[int, int, bytes]]:
    """Entries as packed rows, dealt by document."""
    order = np.argsort(docs)
    d = docs[order]
    return rows(part_of(mixed(d.astype(np.int64).view(np.uint64)), parts), TOLD, None, d, [c[order] for c in columns])


def gathered(dealt: DataFrame, parts: int, dtypes: list, record: np.dtype) -> DataFrame:
    """One row per document with its records as bytes: key, found."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = [unpack(x, dtypes) for b in batches for x in b["blob"]]
        if not got:
            return
        docs = np.concatenate([g[1] for g in got])
        order = np.argsort(docs)
        docs = docs[order]
        r = np.zeros(len(docs), record)
        for k, name in enumerate(record.names):
            r[name] = np.concatenate([g[2][k] for g in got])[order]
        cuts = spans(docs)
        for at in range(0, len(cuts), 10_000):
            part = cuts[at : at + 10_000]
            yield pd.DataFrame({"key": docs[[a for a, _ in part]], "found": [r[a:b].tobytes() for a, b in part]})

    return exchange(dealt, parts).mapInPandas(run, "key long, found binary")


def joined(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs, which have a key, with their records as `found`, null for none."""
    per = found.withColumnRenamed("key", "__k")
    return docs.join(per, docs["key"] == per["__k"], "left").drop("__k")


class WordHashes(dict):
    """Two 64-bit digests of each word; words get numbers as they come."""

    LIMIT = 400_000

    def __init__(self) -> None:
        self.raw = bytearray()

    def __missing__(self, word: bytes) -> int:
        self.raw += hashlib.blake2b(word, digest_size=16).digest()
        n = self[word] = len(self)
        return n

    def of(self, docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """The digests of all words of docs, one after the other."""
        if len(self) > self.LIMIT:
            self.clear()
            self.raw = bytearray()
        ids = np.fromiter(map(self.__getitem__, chain.from_iterable(docs)), np.int64, sum(map(len, docs)))
        both = np.frombuffer(bytes(self.raw), np.uint64).reshape(-1, 2)
        return (both[ids, 0], both[ids, 1]) if len(ids) else (np.zeros(0, np.uint64), np.zeros(0, np.uint64))


def chained(w: np.ndarray, length: int, factor: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Digest of every run of `length` numbers of w (polynomial in an odd factor, modulo 2**64); shorter than w by length - 1."""
    if len(w) < length:
        return np.zeros(0, np.uint64)
    power, block, size = np.uint64(factor), w, 1
    out, have, m = None, 0, np.uint64(factor)
    bits = length
    with np.errstate(over="ignore"):
        while bits:
            if bits & 1:
                if out is None:
                    out, have, m = block, size, power
                else:
                    n = len(w) - (have + size) + 1
                    out = out[:n] * power + block[have : have + n]
                    have, m = have + size, m * power
            bits >>= 1
            if bits:
                n = len(block) - size
                block = block[:n] * power + block[size : size + n]
                power, size = power * power, size * 2
    return out[: len(w) - length + 1]


def slices(texts: list, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about limit bytes each."""
    start = size = 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= limit:
            yield start, k + 1
            start, size = k + 1, 0
    if start < len(texts):
        yield start, len(texts)
