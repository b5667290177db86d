"""Substring deduplication by difference-cover anchors.

Words at places p with p mod 7 in {0, 1, 3} start an anchor of seven words. Any two
places i and j have an offset below 7 at which both are such places, so two equal runs
of 13 words hold an aligned pair of equal anchors. Anchors that two documents share are
extended: the 13-word windows around them, and only those, are compared as a whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import packed
from .util import census, parts_for

#: Window in words, period, cover, and the anchor: window - period + 1 words.
WINDOW, PERIOD, COVER = 13, 7, (0, 1, 3)
ANCHOR = WINDOW - PERIOD + 1
#: version: which of the texts of an id, 0 where ids differ.
PLACE = np.dtype([("at", "<u4"), ("version", "<u8")])
SLICE = 6_000_000


def _words(blobs) -> list[list[bytes]]:
    return [b"" if b is None else b for b in blobs]


def _starts(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place of each document, and of each word its place in its document."""
    first = np.cumsum(sizes) - sizes
    return first, np.arange(sizes.sum()) - np.repeat(first, sizes)


def _ask(h: np.ndarray, more: np.ndarray | None, docs: np.ndarray, columns: list[np.ndarray], parts: int, smallest: bool) -> list[tuple[int, int, bytes]]:
    """Rows for digests of one batch. Those that several of its documents hold are decided here:

    smallest False: all their places are told, one asks on. True: places in documents above the smallest are told, the smallest's ask on.
    """
    keys = [h] if more is None else [h, more]
    order = packed.ordered(keys)
    run = packed.same(order, keys)
    size, low, high = packed.shared(order, run, docs)
    if not len(order):
        return []
    many = (low != high)[run]
    d = docs[order]
    if smallest:
        told = d > low[run]
        ask = ~told
    else:
        told = many
        ask = ~many
        ask[np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))] = True
    out = []
    o = np.sort(order[ask])
    out += packed.rows(packed.part_of(h[o], parts), packed.ASK, packed.digest_key(h[o], None if more is None else more[o]), docs[o], [c[o] for c in columns])
    o = np.sort(order[told])
    out += packed.rows(packed.part_of(packed.mixed(docs[o].astype(np.uint64)), parts), packed.TOLD, None, docs[o], [c[o] for c in columns])
    return out


def _anchor_rows(parts: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = packed.WordHashes()
        for b in batches:
            b = b[b["id"].notna()]
            ids, own, texts = b["key"].to_numpy(np.int64), b["version"].to_numpy(np.int64).view(np.uint64), _words(b["raw"])
            for x, y in packed.slices(texts, SLICE):
                docs = [t.split() for t in texts[x:y]]
                sizes = np.array([len(d) for d in docs], np.int64)
                w, _ = hashes.of(docs)
                first, place = _starts(sizes)
                g = packed.mixed(packed.chained(w, ANCHOR))
                size = np.repeat(sizes, sizes)[: len(g)]
                p = place[: len(g)]
                r = p % PERIOD
                good = (size >= WINDOW) & (p + ANCHOR <= size) & np.isin(r, COVER)
                i = np.flatnonzero(good)
                row = np.repeat(np.arange(x, y), sizes)[i]
                yield packed.frame(_ask(g[i], None, ids[row], [p[i].astype(np.uint32), own[row]], parts, smallest=False))

    return run


def _own_places(found: bytes, version: np.uint64) -> np.ndarray:
    r = np.frombuffer(found, PLACE)
    return r["at"][r["version"] == version].astype(np.int64)


def _window_rows(parts: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = packed.WordHashes()
        for b in batches:
            b = b[b["found"].notna() & b["id"].notna()]
            ids, own, texts = b["key"].to_numpy(np.int64), b["version"].to_numpy(np.int64).view(np.uint64), _words(b["raw"])
            found = [_own_places(f, v) for f, v in zip(b["found"], own, strict=True)]
            for x, y in packed.slices(texts, SLICE):
                docs = [t.split() for t in texts[x:y]]
                sizes = np.array([len(d) for d in docs], np.int64)
                w1, w2 = hashes.of(docs)
                first, place = _starts(sizes)
                hit = np.zeros(len(place) + 1, np.int64)
                for f, n, places in zip(first, sizes, found[x:y], strict=True):
                    at = places
                    np.add.at(hit, f + np.maximum(at - (PERIOD - 1), 0), 1)
                    np.add.at(hit, np.minimum(f + at, f + n - 1) + 1, -1)
                n = max(len(w1) - WINDOW + 1, 0)
                i = np.flatnonzero((np.cumsum(hit[:-1])[:n] > 0) & (place[:n] + WINDOW <= np.repeat(sizes, sizes)[:n]))
                h, more = packed.mixed(packed.chained(w1, WINDOW)[i]), packed.chained(w2, WINDOW, 0xD6E8FEB86659FD93)[i]
                row = np.repeat(np.arange(x, y), sizes)[i]
                yield packed.frame(_ask(h, more, ids[row], [place[i].astype(np.uint32), own[row]], parts, smallest=True))

    return run


def _two_documents(order: np.ndarray, run: np.ndarray, docs: np.ndarray) -> np.ndarray:
    _, low, high = packed.shared(order, run, docs)
    return (low != high)[run] if len(order) else np.zeros(0, bool)


def _above_smallest(order: np.ndarray, run: np.ndarray, docs: np.ndarray) -> np.ndarray:
    _, low, _ = packed.shared(order, run, docs)
    return docs[order] > low[run] if len(order) else np.zeros(0, bool)


def removed_words(n: int, at: np.ndarray) -> np.ndarray:
    """Mask of the words that windows starting at the recorded places cover."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, at, 1)
    np.add.at(d, np.minimum(at + WINDOW, n), -1)
    return np.cumsum(d[:-1]) > 0


def _finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for raw, places, version in zip(b["raw"], b["found"].where(b["id"].notna(), None), b["version"].to_numpy(np.int64).view(np.uint64), strict=True):
            w = (raw or b"").split()
            gone = 0
            if places:
                mask = removed_words(len(w), _own_places(places, version))
                gone = int(mask.sum())
                w = [x for x, m in zip(w, mask, strict=True) if not m]
            out.append((len(w) + gone, gone, hashlib.sha256(b" ".join(w)).hexdigest()))
        yield pd.DataFrame({"doc_id": b["id"], "n_words": [o[0] for o in out], "n_removed": [o[1] for o in out], "kept_sha256": [o[2] for o in out]})


def dedup_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256.

    A word goes when a 13-word window that covers it also starts in a document with a smaller
    id; windows are judged on the input. Null and empty texts have no words; texts of fewer than
    13 words lose none. Rows that repeat an id, with the same text or others, have no smaller id
    among them: they take nothing from one another, and each loses what rows of smaller ids have.
    A row without an id is neither smaller nor larger than others: it loses nothing and takes
    nothing. Other columns are ignored; an empty table gives no rows. Memory is bounded by a
    batch of rows, or by a partition's share of the digests.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("raw"))
    c = census(d)
    parts = parts or parts_for(docs.sparkSession, c.size)
    version = F.lit(0).cast("long") if c.plain else F.xxhash64("raw")
    #: Rows without an id are spread by their texts and passed over; one table, so that both joins read one exchange of it.
    d = d.select(F.coalesce("doc_id", F.xxhash64("raw")).alias("key"), F.col("doc_id").cast("string").alias("id"), "raw", version.alias("version"))
    anchors = d.mapInPandas(_anchor_rows(parts), packed.SCHEMA)
    near = packed.resolve(anchors, parts, [np.uint32, np.uint64], _two_documents, PLACE)
    windows = packed.joined(d, near).mapInPandas(_window_rows(parts), packed.SCHEMA)
    gone = packed.resolve(windows, parts, [np.uint32, np.uint64], _above_smallest, PLACE)
    out = packed.joined(d, gone).mapInPandas(_finish, "doc_id string, n_words long, n_removed long, kept_sha256 string")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))
