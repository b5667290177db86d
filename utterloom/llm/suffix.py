"""Substring deduplication over bytes with suffix arrays.

Every 200-byte window has one anchor: of its 32-byte strings the one with the smallest
digest. The windows of a document that have the same anchor form a piece. Equal windows
have equal anchors, so only pieces whose anchor occurs elsewhere are looked at: they are
dealt out by anchor, so that equal windows meet in one shard, and distinct pieces of a
shard form its text. Its suffix array (induced sorting) and permuted common prefixes say
which windows occur twice.

A shard holds about SHARD bytes, whatever an anchor holds: pieces of an anchor with more
text than that are cut into the windows of 13 neighbouring places of the anchor and dealt
by what these have in common (188 bytes), and where that is too much again into single
windows. Equal windows have the anchor at the same place, so they still meet.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import packed
from .induced import permuted_lcp, suffix_array
from .util import census, keyed, materialise, parts_for

#: Window and anchor in bytes, and the starts of anchors in a window.
WINDOW, ANCHOR = 200, 32
STARTS = WINDOW - ANCHOR + 1
#: Bytes handled at once when anchors are selected, and of a shard's text for one suffix array.
BUFFER, SHARD = 400_000, 400_000
#: Places of the anchor in a window that pieces are cut by when their anchor, then what they share, has too much text.
CUTS = (13, 1)
FOUND = np.dtype([("s", "<u4"), ("n", "<u2"), ("off", "u1")])
PLACE = np.dtype([("at", "<u4"), ("n", "<u2")])
REF = np.dtype([("key", "<i8"), ("s", "<u4")])
PIECES = "h long, off int, piece binary, n long, refs binary"
_LETTERS = np.frombuffer(b"".join(hashlib.blake2b(bytes([k]), digest_size=8).digest() for k in range(256)), np.uint64)
_LOW = np.uint64((1 << 24) - 1)


def select(data: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows, anchor and anchor digest of each piece of a buffer. valid: the places where windows start."""
    none = np.zeros(0, np.int64)
    if len(data) < WINDOW or not valid.any():
        return none, none, none, none.astype(np.uint64)
    g = packed.mixed(packed.chained(_LETTERS[data], ANCHOR))
    m = (g & ~_LOW) | (_LOW - np.arange(len(g), dtype=np.uint64))  # ties go to the rightmost
    size = 1
    while size * 2 <= STARTS:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    if size < STARTS:
        m = np.minimum(m[: len(m) - (STARTS - size)], m[STARTS - size :])
    i = np.flatnonzero(valid[: len(m)])
    a = (_LOW - (m[i] & _LOW)).astype(np.int64)
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (i[1:] != i[:-1] + 1)])
    cut = np.flatnonzero(new)
    return i[cut], np.diff(np.append(cut, len(i))), a[cut], g[a[cut]]


def segments(ids: np.ndarray, texts: list[bytes]) -> Iterator[list[tuple[int, int, bytes]]]:
    """Lists of (id, offset, bytes) of about BUFFER bytes; long texts in overlapping parts that share no window."""
    held: list[tuple[int, int, bytes]] = []
    size = 0
    for i, t in zip(ids, texts, strict=True):
        for at in range(0, max(len(t) - WINDOW + 1, 0), BUFFER):
            part = t[at : at + BUFFER + WINDOW - 1] if len(t) > BUFFER else t
            held.append((i, at, part))
            size += len(part)
            if size >= BUFFER:
                yield held
                held, size = [], 0
    if held:
        yield held


def _texts(blobs) -> list[bytes]:
    return [b"" if b is None else b for b in blobs]


def _ask(h: np.ndarray, more: np.ndarray | None, docs: np.ndarray, columns: list[np.ndarray], parts: int) -> list[tuple[int, int, bytes]]:
    """Rows for the digests of one batch: of those it holds twice all places are told and one asks on."""
    keys = [h] if more is None else [h, more]
    order = packed.ordered(keys)
    if not len(order):
        return []
    run = packed.same(order, keys)
    size, _, _ = packed.shared(order, run, docs)
    first = np.concatenate([[True], run[1:] != run[:-1]])
    o = np.sort(order[first])
    out = packed.rows(packed.part_of(h[o], parts), packed.ASK, packed.digest_key(h[o], None if more is None else more[o]), docs[o], [c[o] for c in columns])
    o = np.sort(order[(size > 1)[run]])
    return out + packed.rows(packed.part_of(packed.mixed(docs[o].astype(np.uint64)), parts), packed.TOLD, None, docs[o], [c[o] for c in columns])


def _twice(order: np.ndarray, run: np.ndarray, docs: np.ndarray) -> np.ndarray:
    return (packed.shared(order, run, docs)[0] > 1)[run] if len(order) else np.zeros(0, bool)


def _anchor_rows(parts: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = _texts(b["raw"])
            ids = b["key"].to_numpy(np.int64)
            for x, y in packed.slices(texts, 64 * BUFFER):
                got: list[list[np.ndarray]] = [[] for _ in range(5)]
                for group in segments(ids[x:y], texts[x:y]):
                    data = np.frombuffer(b"".join(t for _, _, t in group), np.uint8)
                    sizes = np.array([len(t) for _, _, t in group])
                    first = np.cumsum(sizes) - sizes
                    valid = np.ones(len(data), bool)
                    for f, n in zip(first, sizes, strict=True):
                        valid[f + n - WINDOW + 1 : f + n] = False
                    s, n, a, h = select(data, valid)
                    k = np.searchsorted(first, s, side="right") - 1
                    place = s - first[k] + np.array([o for _, o, _ in group])[k]
                    for held, new in zip(got, (h, np.array([i for i, _, _ in group])[k], place.astype(np.uint32), n.astype(np.uint16), (a - s).astype(np.uint8)), strict=True):
                        held.append(new)
                if got[0]:
                    h, doc, s, n, off = (np.concatenate(g) for g in got)
                    yield packed.frame(_ask(h, None, doc, [s, n, off], parts))

    return run


def _held_rows(held: dict[tuple[int, bytes], list[int]], off: dict, keys: np.ndarray, at: np.ndarray, times: np.ndarray) -> pd.DataFrame:
    """A row of PIECES for each distinct piece, from the numbers of its places."""
    ref = np.empty(len(keys), REF)
    ref["key"], ref["s"] = keys, at
    raw, size = ref.tobytes(), REF.itemsize
    refs = [raw[size * i[0] : size * i[0] + size] if len(i) == 1 else ref[i].tobytes() for i in held.values()]
    n = [int(times[i[0]]) if len(i) == 1 else int(times[i].sum()) for i in held.values()]
    return pd.DataFrame({"h": np.array([h for h, _ in held], np.int64), "off": np.array([off[k] for k in held], np.int32), "piece": [p for _, p in held], "n": np.array(n, np.int64), "refs": refs})


def _digest(*parts: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(b"".join(parts), digest_size=8).digest(), "little", signed=True)


def _piece_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Distinct pieces of each batch that may repeat, with their places."""
    for b in batches:
        b = b[[f is not None for f in b["found"]]]
        held: dict[tuple[int, bytes], list[int]] = {}
        off: dict[tuple[int, bytes], int] = {}
        keys, at, times = [], [], []
        for i, raw, found, copies in zip(b["key"], b["raw"], b["found"], b["copies"], strict=True):
            # a piece that was told and asked on as well comes twice
            for s, n, o in set(np.frombuffer(found, FOUND).tolist()):
                k = (_digest(raw[s + o : s + o + ANCHOR]), raw[s : s + n + WINDOW - 1])
                held.setdefault(k, []).append(len(keys))
                off[k] = o
                keys.append(i)
                at.append(s)
                times.append(copies)
        yield _held_rows(held, off, np.array(keys, np.int64), np.array(at, np.uint32), np.array(times, np.int64))


def _cut_rows(width: int):
    """Pieces cut into the windows with their anchor at width neighbouring places, dealt by the bytes that these have in common."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            held: dict[tuple[int, bytes], list[int]] = {}
            off: dict[tuple[int, bytes], int] = {}
            refs, times, total = [], [], 0
            for h, o, piece, n, raw in zip(b["h"], b["off"], b["piece"], b["n"], b["refs"], strict=True):
                own = np.frombuffer(raw, REF)
                for j in range(max(0, o - (len(piece) - WINDOW)) // width, o // width + 1):
                    low, high = max(0, o - (j + 1) * width + 1), min(len(piece) - WINDOW, o - j * width)
                    core = piece[o - j * width : o - (j + 1) * width + 1 + WINDOW]
                    k = (_digest(h.to_bytes(8, "little", signed=True), j.to_bytes(2, "little"), core), piece[low : high + WINDOW])
                    moved = own.copy()
                    moved["s"] += low
                    held.setdefault(k, []).extend(range(total, total + len(own)))
                    off[k] = o - low
                    refs.append(moved)
                    times.append(np.append(np.ones(len(own) - 1, np.int64), n - len(own) + 1))
                    total += len(own)
            r = np.concatenate(refs) if refs else np.zeros(0, REF)
            yield _held_rows(held, off, r["key"], r["s"], np.concatenate(times) if times else np.zeros(0, np.int64))

    return run


def repeats(pieces: list[bytes]) -> list[np.ndarray]:
    """For each of the pieces, whether the window at each of its starts also starts elsewhere in them."""
    sizes = np.array([len(p) + 1 for p in pieces])
    first = np.cumsum(sizes) - sizes
    s = np.frombuffer(b"\0".join(pieces) + b"\0\0", np.uint8).astype(np.int64) + 2
    s[first + sizes - 1] = 1
    s[-1] = 0
    sa = suffix_array(s)
    room = np.append(np.repeat(first + sizes - 1, sizes), len(s) - 1) - np.arange(len(s))
    long = permuted_lcp(s, sa, first, room) >= WINDOW
    both = long.copy()
    both[sa[:-1]] |= long[sa[1:]]
    return [both[f : f + n - WINDOW] for f, n in zip(first, sizes, strict=True)]


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run of True."""
    d = np.diff(mask.astype(np.int8), prepend=0, append=0)
    start = np.flatnonzero(d == 1)
    return start, np.flatnonzero(d == -1) - start


def _shards(parts: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Places of repeated windows. Rows come in order of h; in memory are a batch and the distinct pieces of one shard."""
        chunk: dict[bytes, bytes | None] = {}  # piece -> its places, None if all its windows are known to repeat
        whole: list[tuple[int, bytes]] = []  # windows and places of such pieces
        size, last = 0, None
        for b in batches:
            for h, piece, n, refs in zip(b["h"], b["piece"], b["n"], b["refs"], strict=True):
                if h != last and size >= SHARD:
                    yield packed.frame(_places(chunk, parts))
                    chunk, size = {}, 0
                last = h
                if piece in chunk:
                    if chunk[piece] is not None:
                        whole.append((len(piece) - WINDOW + 1, chunk[piece]))
                        chunk[piece] = None
                    whole.append((len(piece) - WINDOW + 1, refs))
                else:
                    chunk[piece] = None if n > 1 else refs
                    size += len(piece)
                    if n > 1:
                        whole.append((len(piece) - WINDOW + 1, refs))
            if whole:
                yield packed.frame(_whole_places(whole, parts))
                whole = []
        if chunk:
            yield packed.frame(_places(chunk, parts))

    return run


def _dealt(refs: np.ndarray, at: np.ndarray, n: np.ndarray, parts: int) -> list[tuple[int, int, bytes]]:
    return packed.by_document(refs["key"], [(refs["s"].astype(np.int64) + at).astype(np.uint32), n.astype(np.uint16)], parts)


def _whole_places(whole: list[tuple[int, bytes]], parts: int) -> list[tuple[int, int, bytes]]:
    ref = np.frombuffer(b"".join(r for _, r in whole), REF)
    n = np.repeat(np.array([n for n, _ in whole]), [len(r) // REF.itemsize for _, r in whole])
    return _dealt(ref, np.zeros(len(ref), np.int64), n, parts)


def _places(chunk: dict[bytes, bytes | None], parts: int) -> list[tuple[int, int, bytes]]:
    at, number, refs = [], [], []
    for mask, raw in zip(repeats(list(chunk)), chunk.values(), strict=True):
        if raw is not None and mask.any():
            start, n = _runs(mask)
            at.append(start)
            number.append(n)
            refs.append(raw * len(start))  # one place each
    if not refs:
        return []
    return _dealt(np.frombuffer(b"".join(refs), REF), np.concatenate(at), np.concatenate(number), parts)


def covered(n: int, places: bytes) -> np.ndarray:
    """Mask of the bytes that the recorded windows cover."""
    d = np.zeros(n + 1, np.int32)
    r = np.frombuffer(places, PLACE)
    at = r["at"].astype(np.int64)
    np.add.at(d, at, 1)
    np.add.at(d, at + r["n"] + (WINDOW - 1), -1)
    return np.cumsum(d[:-1]) > 0


def _finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for raw, places, copies in zip(b["raw"], b["found"], b["copies"], strict=True):
            raw = raw or b""
            gone = spans = 0
            kept = raw
            if copies > 1 and len(raw) >= WINDOW:
                gone, spans, kept = len(raw), 1, b""
            elif places:
                mask = covered(len(raw), places)
                gone, spans = int(mask.sum()), len(_runs(mask)[0])
                kept = np.frombuffer(raw, np.uint8)[~mask].tobytes()
            out.append((len(raw), gone, spans, hashlib.sha256(kept).hexdigest()))
        yield pd.DataFrame({"doc_id": b["id"], **{c: [o[k] for o in out] for k, c in enumerate(("n_bytes", "n_removed", "n_spans", "kept_sha256"))}})


def dedup_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A byte goes when a 200-byte string that covers it also starts anywhere else, in the same
    or another document; strings never cross documents and are judged on the input. Null
    counts as empty; texts below 200 bytes lose nothing. Rows are documents of their own,
    whether or not they repeat an id or have none, so rows of equal texts lose all of them (from
    200 bytes on); a missing id stays missing. Other columns are ignored; an empty table gives no
    rows. Memory is bounded by a batch of rows, a shard, or a partition's share of the anchors.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("raw"))
    c = census(d)
    parts = parts or parts_for(docs.sparkSession, c.size)
    #: The id goes through as text, since a missing one would make floats of a batch's ids.
    d = keyed(d, c).select("key", F.col("doc_id").cast("string").alias("id"), "raw", "copies")
    anchors = d.mapInPandas(_anchor_rows(parts), packed.SCHEMA)
    near = packed.resolve(anchors, parts, [np.uint32, np.uint16, np.uint8], _twice, FOUND)
    pieces = materialise(packed.joined(d, near).mapInPandas(_piece_rows, PIECES), "pieces")
    ready = None
    for width in CUTS:
        large = materialise(pieces.groupBy("h").agg(F.sum(F.octet_length("piece")).alias("b")).filter(F.col("b") > SHARD).select("h"), "large")
        light = pieces.join(large, "h", "left_anti")
        ready = light if ready is None else ready.unionByName(light)
        if not large.count():
            pieces = None
            break
        pieces = materialise(pieces.join(large, "h", "left_semi").mapInPandas(_cut_rows(width), PIECES), "cut")
    ready = ready if pieces is None else ready.unionByName(pieces)
    dealt = ready.select("h", "piece", "n", "refs").repartition(parts, "h").sortWithinPartitions("h")
    places = packed.gathered(dealt.mapInPandas(_shards(parts), packed.SCHEMA), parts, [np.uint32, np.uint16], PLACE)
    out = packed.joined(d, places).mapInPandas(_finish, "doc_id string, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))
