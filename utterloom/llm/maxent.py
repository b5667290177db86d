"""LM scoring with a hashed maximum-entropy model.

A token's probability is factored by classes: P(class | history) P(token | class, history).
Both factors are softmaxes with hashed features of the history: the previous word, the
previous two, the one before the previous (skip), and the last frequent word (skip over what
follows it). The second one, whose features are hashed together with the class, is over the
most frequent words of the class and one place for its others, among which smoothed counts
decide. A class is the set of words that most often follow the same very frequent word;
words seen rarely share one, and the end of a text has its own. Weights are trained by
gradient updates that tasks compute on their documents and that are averaged row by row.

The texts are split into words once. A block of documents becomes one row: its distinct
words as digests, and its tokens as numbers of these. Since the vocabulary grows with the
input it is never broadcast: blocks send their distinct words with their counts to the
vocabulary's partitions and get counts and classes back. Training and scoring then read
blocks of small integers without another shuffle.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import packed
from .util import census, materialise, parts_for

#: Contexts (very frequent words) that make classes, least count of a word with a class of its own kind.
CONTEXTS, FREQUENT = 40, 5
RARE, END = CONTEXTS, CONTEXTS + 1
CLASSES = CONTEXTS + 2
#: Words of a class with a place of their own in its softmax; one more place for its others.
SLOTS = 31
WIDTH = SLOTS + 1
#: Hashed rows of features: the power of two from LEAST to MOST that has a row for every WORDS_A_ROW words or fewer of the vocabulary.
LEAST, MOST, WORDS_A_ROW = 1 << 14, 1 << 18, 64
ROUNDS, STEP = 2, 0.35
#: Tokens of an update: few at a task's start, then a quarter of those it has seen, up to CHUNK.
FIRST, CHUNK = 2048, 1 << 16
#: Bytes of text in a block of documents, and of text split into words at once.
BLOCK_BYTES, SLICE = 8_000_000, 1_000_000
#: Pieces that changes of weights are summed up in.
SUMS = 16
BOUND, NEVER = 60.0, 1e-9


def held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 1


def _held(c):
    return F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(5)) == 1


_FACTOR = 0x9E3779B97F4A7C15
_LETTERS = np.frombuffer(b"".join(hashlib.blake2b(bytes([k]), digest_size=8).digest() for k in range(256)), np.uint64)
_LOWER = np.array([k + 32 if 65 <= k <= 90 else k for k in range(256)], np.uint8)
_SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
_powers: list[np.ndarray] = []


def word_digests(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """64-bit digests of all words (A-Z lower-cased), one text after the other, and the number of words of each.

    A word's digest is a polynomial of its bytes' random numbers, taken from one running sum over all
    bytes: words are never cut out as objects.
    """
    raw = [t or b"" for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    n = len(data)
    if not _powers or len(_powers[0]) < n + 1:
        size = max(n + 1, 2 * SLICE)
        up, down = np.full(size, _FACTOR, np.uint64), np.full(size, pow(_FACTOR, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _powers[:] = [np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)]
    up, down = _powers
    space = _SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[0::2], edge[1::2]
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_LETTERS[_LOWER[data]] * up[:n], out=total[1:])
    h = packed.mixed((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    bounds = np.cumsum([len(t) + 1 for t in raw])
    return h, np.diff(np.searchsorted(start, bounds), prepend=0)


def _z(a: np.ndarray) -> bytes:
    return zstandard.compress(packed._planes(np.ascontiguousarray(a)), 1) if len(a) else b""


def _unz(blob: bytes, dtype) -> np.ndarray:
    return packed._from_planes(raw := zstandard.decompress(blob), 0, len(raw) // np.dtype(dtype).itemsize, dtype)[0] if blob else np.zeros(0, dtype)


BLOCKS = "block long, digests binary, counts binary, codes binary, ids binary, nameless binary, held binary, sizes binary"


def _block_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents as rows of BLOCKS: sorted digests of the distinct words, their counts in training documents, and each token's place among them."""
    number = TaskContext.get().partitionId() << 32
    for b in batches:
        texts = list(b["raw"])
        ids, nameless, held = b["key"].to_numpy(np.int64), b["nameless"].to_numpy(bool), b["held_out"].to_numpy(bool)
        for x, y in packed.slices([t or b"" for t in texts], BLOCK_BYTES):
            parts = [word_digests(texts[u + x : v + x]) for u, v in packed.slices([t or b"" for t in texts[x:y]], SLICE)]
            sizes = np.concatenate([n for _, n in parts])
            code, own = pd.factorize(np.concatenate([h for h, _ in parts]))
            order = np.argsort(own)
            place = np.empty(len(own), np.int64)
            place[order] = np.arange(len(own))
            code = place[code]
            counts = np.bincount(code[np.repeat(~held[x:y], sizes)], minlength=len(own))
            row = (number, own[order].tobytes(), _z(counts.astype(np.uint32)), _z(code.astype(np.uint32)), _z(ids[x:y]), _z(nameless[x:y].view(np.uint8)), _z(held[x:y].view(np.uint8)), _z(sizes.astype(np.uint32)))
            yield pd.DataFrame([row], columns=[c.split(" ")[0] for c in BLOCKS.split(", ")])
            number += 1


def _sent(h: np.ndarray, columns: list[np.ndarray], block: int, parts: int) -> list[tuple]:
    """Columns of sorted digests, a row for each partition of the vocabulary."""
    return [(int(p), block, h[a:b].tobytes(), *[_z(c[a:b]) for c in columns]) for (a, b), p in ((s, packed.part_of(h[s[0] : s[0] + 1], parts)[0]) for s in packed.spans(packed.part_of(h, parts)))]


def _count_rows(parts: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for raw, counts in zip(b["digests"], b["counts"], strict=True):
                h, n = np.frombuffer(raw, np.uint64), _unz(counts, np.uint32)
                yield pd.DataFrame(_sent(h[n > 0], [n[n > 0]], 0, parts), columns=["part", "block", "digests", "counts"])

    return run


def _grouped(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct digests in order, and the place of each digest among them."""
    h = np.frombuffer(b"".join(blobs), np.uint64)
    code, own = pd.factorize(h)
    order = np.argsort(own)
    place = np.empty(len(own), np.int64)
    place[order] = np.arange(len(own))
    return own[order], place[code] if len(h) else np.zeros(0, np.int64)


def _by_part(batches: Iterator[pd.DataFrame]) -> dict[int, list[tuple]]:
    """Rows by their partition of the vocabulary: all that this task has."""
    held: dict[int, list[tuple]] = {}
    for b in batches:
        for r in b.itertuples(index=False):
            held.setdefault(r.part, []).append(r)
    return held


def _top_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The most frequent words of each partition (kind 0), and its words and tokens (kind 1)."""
    for rows in _by_part(batches).values():
        h, code = _grouped([r.digests for r in rows])
        c = np.bincount(code, np.concatenate([_unz(r.counts, np.uint32) for r in rows]), len(h)).astype(np.int64)
        top = np.lexsort((h.view(np.int64), -c))[:CONTEXTS]
        yield pd.DataFrame({"kind": [0] * len(top) + [1], "h": [*h[top].view(np.int64), len(h)], "c": [*c[top], c.sum()]})


def _last_context(code: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each token the context code of the nearest earlier token that has one (CONTEXTS: none in its text)."""
    n = len(code)
    if not n:
        return code
    i = np.arange(n)
    seen = np.maximum.accumulate(np.where(code < CONTEXTS, i, -1))
    before = np.concatenate([[-1], seen[:-1]])
    start = first[np.searchsorted(first, i, side="right") - 1]
    return np.where(before >= start, code[np.maximum(before, 0)], CONTEXTS)


def _codes(h: np.ndarray, top: np.ndarray) -> np.ndarray:
    """Context code of each digest: its place in top, else CONTEXTS."""
    order = np.argsort(top)
    s = top[order]
    at = np.minimum(np.searchsorted(s, h), len(s) - 1) if len(s) else np.zeros(len(h), np.int64)
    return np.where(s[at] == h, order[at], CONTEXTS) if len(s) else np.full(len(h), CONTEXTS)


def _positions(block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all tokens of a block, tokens of each document, and the first place of each."""
    sizes = _unz(block.sizes, np.uint32).astype(np.int64)
    return _unz(block.codes, np.uint32).astype(np.int64), sizes, np.cumsum(sizes) - sizes


ASKED = "part int, block long, digests binary, counts binary, context binary, times binary"


def _vote_rows(top: np.ndarray, parts: int):
    """Distinct words of each block, with their counts and the context that each follows most often in its training documents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for block in b.itertuples(index=False):
                h = np.frombuffer(block.digests, np.uint64)
                code, sizes, first = _positions(block)
                f = _last_context(_codes(h, top)[code], first)
                good = (f < CONTEXTS) & np.repeat(_unz(block.held, np.uint8) == 0, sizes)
                table = np.bincount(code[good] * CONTEXTS + f[good], minlength=len(h) * CONTEXTS).reshape(len(h), CONTEXTS)
                best = table.argmax(1) if len(h) else np.zeros(0, np.int64)
                columns = [_unz(block.counts, np.uint32), best.astype(np.uint8), table[np.arange(len(h)), best].astype(np.uint32)]
                yield pd.DataFrame(_sent(h, columns, block.block, parts), columns=["part", "block", "digests", "counts", "context", "times"])

    return run


CANDIDATE = np.dtype([("cls", "u1"), ("h", "<i8"), ("c", "<i8")])
MASS = np.dtype([("c", "<i8"), ("v", "<i8")])


def _answer_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts and classes of the asked digests, in their order; and (block -1) sums by class and the most frequent words of each."""
    for rows in _by_part(batches).values():
        h, code = _grouped([r.digests for r in rows])
        c = np.bincount(code, np.concatenate([_unz(r.counts, np.uint32) for r in rows]), len(h)).astype(np.int64)
        context = np.concatenate([_unz(r.context, np.uint8) for r in rows]).astype(np.int64)
        follow = np.bincount(code * CONTEXTS + context, np.concatenate([_unz(r.times, np.uint32) for r in rows]), len(h) * CONTEXTS).reshape(len(h), CONTEXTS)
        cls = np.where((c >= FREQUENT) & (follow.max(1, initial=0) > 0), follow.argmax(1) if len(h) else 0, RARE).astype(np.uint8)
        at = 0
        for r in rows:
            n = len(r.digests) // 8
            k = code[at : at + n]
            yield pd.DataFrame({"block": [r.block], "part": [r.part], "counts": [_z(c[k])], "classes": [_z(cls[k])]})
            at += n
        mass = np.zeros(CLASSES, MASS)
        mass["c"] = np.bincount(cls, c, CLASSES).astype(np.int64)
        mass["v"] = np.bincount(cls[c > 0], minlength=CLASSES)
        order = np.lexsort((h.view(np.int64), -c, cls))
        rank = np.arange(len(h)) - np.searchsorted(cls[order], cls[order])
        top = order[(rank < SLOTS) & (cls[order] != RARE)]
        best = np.empty(len(top), CANDIDATE)
        best["cls"], best["h"], best["c"] = cls[top], h[top].view(np.int64), c[top]
        yield pd.DataFrame({"block": [-1], "part": [0], "counts": [mass.tobytes()], "classes": [best.tobytes()]})


def _summary_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """kind 0: words that may get a place in their class; kind 1: tokens (h) and words (c) of a class."""
    for b in batches:
        for mass, best in zip(b["counts"], b["classes"], strict=True):
            m, w = np.frombuffer(mass, MASS), np.frombuffer(best, CANDIDATE)
            yield pd.DataFrame({"kind": [0] * len(w) + [1] * CLASSES, "cls": [*w["cls"], *range(CLASSES)], "h": [*w["h"], *m["c"]], "c": [*w["c"], *m["v"]]}).astype({"kind": "int32", "cls": "int32", "h": "int64", "c": "int64"})


@dataclass
class Stats:
    """What is known of the training documents as a whole; its size is fixed.

    mass: smoothed tokens of each class's words without a place; slot_words, slot_of: digests with a place (sorted), and it.
    """

    tokens: int
    kinds: int
    ends: int
    features: int
    top: np.ndarray
    share: np.ndarray
    slot_share: np.ndarray
    mass: np.ndarray
    slot_words: np.ndarray
    slot_of: np.ndarray

    def first_weights(self) -> list[np.ndarray]:
        """Zero, but for the rows of the last frequent word, which start with the classes' and the places' shares."""
        one = np.zeros((CLASSES, self.features + CONTEXTS + 1), np.float32)
        one[:, self.features :] = np.log(self.share / self.share.sum())[:, None]
        two = np.zeros((WIDTH, self.features + CLASSES * (CONTEXTS + 1)), np.float32)
        two[:, self.features :] = np.repeat(np.log(self.slot_share / self.slot_share.sum(1, keepdims=True)).T, CONTEXTS + 1, 1)
        return [one, two]


ENCODED = "block long, codes binary, table binary, ids binary, nameless binary, held binary, sizes binary, known binary, base binary, inner binary"
#: What is known of a distinct word: 32 bits of its digest, class, place in its class, context code.
WORD = np.dtype([("bits", "<u4"), ("cls", "u1"), ("slot", "u1"), ("context", "u1")])


def _encode_rows(stats: Stats):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for block in b.itertuples(index=False):
                h = np.frombuffer(block.digests, np.uint64)
                got = sorted(block.answers, key=lambda a: a["part"])
                counts = np.concatenate([np.zeros(0, np.int64), *[_unz(a["counts"], np.int64) for a in got]])
                word = np.zeros(len(h), WORD)
                word["cls"] = np.concatenate([np.zeros(0, np.uint8), *[_unz(a["classes"], np.uint8) for a in got]])
                at = np.minimum(np.searchsorted(stats.slot_words, h), len(stats.slot_words) - 1)
                own = stats.slot_words[at] == h if len(stats.slot_words) else np.zeros(len(h), bool)
                word["slot"] = np.where(own, stats.slot_of[at] if len(stats.slot_words) else 0, SLOTS)
                word["bits"], word["context"] = packed.mixed(h) >> np.uint64(32), _codes(h, stats.top)
                code, sizes, first = _positions(block)
                below = stats.tokens + 0.5 * (stats.kinds + 1)
                inner = np.where(own, 0.0, np.log10((counts + 0.5) / stats.mass[word["cls"]]))
                add = lambda x: np.add.reduceat(np.append(x[code], 0.0), first)[: len(first)] * (sizes > 0) if len(first) else np.zeros(0)
                known = add((counts > 0).astype(np.float64)).astype(np.int64) + (stats.ends > 0)
                base = add(np.log10((counts + 0.5) / below)) + np.log10((stats.ends + 0.5) / below)
                row = (block.block, block.codes, zstandard.compress(word.tobytes(), 1), block.ids, block.nameless, block.held, block.sizes, known.tobytes(), base.tobytes(), add(inner).tobytes())
                yield pd.DataFrame([row], columns=[c.split(" ")[0] for c in ENCODED.split(", ")])

    return run


@dataclass
class Tokens:
    """All tokens of an encoded block, ends included: what precedes them (one, and one and two before), classes, places (-1: their class has none), last frequent words, documents; and tokens of each document."""

    one: np.ndarray
    two: np.ndarray
    cls: np.ndarray
    slot: np.ndarray
    last: np.ndarray
    doc: np.ndarray
    sizes: np.ndarray

    def hashed(self, k, rows: int, salted: bool) -> list[np.ndarray]:
        """Rows of the hashed features of tokens k. salted: with their class."""
        one, two = self.one[k], self.two[k]
        down = np.uint32(33 - rows.bit_length())
        out = []
        for salt, x in enumerate((one, one * np.uint32(65599) + two, two)):
            mixed = (x * np.uint32(2654435761) + np.uint32(salt * 40503 + 12345)) * np.uint32(2246822519)
            if salted:
                mixed = (mixed ^ self.cls[k].astype(np.uint32) * np.uint32(3266489917)) * np.uint32(668265263)
            out.append((mixed >> down).astype(np.int64))
        return out

    def class_rows(self, k, rows: int) -> list[np.ndarray]:
        """Rows of the softmax over classes, four for each token."""
        return [*self.hashed(k, rows, False), rows + self.last[k].astype(np.int64)]

    def place_rows(self, k, rows: int) -> list[np.ndarray]:
        """Rows of the softmax within the class, four for each token."""
        return [*self.hashed(k, rows, True), rows + self.cls[k].astype(np.int64) * (CONTEXTS + 1) + self.last[k]]


def tokens_of(block) -> Tokens:
    word = np.frombuffer(zstandard.decompress(block.table), WORD)
    code, sizes, _ = _positions(block)
    ends = np.cumsum(sizes + 1) - 1
    n = len(code) + len(sizes)
    real = np.ones(n, bool)
    real[ends] = False
    w = word[code]
    bits, cls, slot, context = np.zeros(n, np.uint32), np.full(n, END, np.uint8), np.full(n, -1, np.int8), np.full(n, CONTEXTS, np.uint8)
    bits[real], cls[real], slot[real], context[real] = w["bits"], w["cls"], w["slot"], w["context"]
    slot[cls >= RARE] = -1
    begin = ends - sizes
    one, two = np.zeros(n, np.uint32), np.zeros(n, np.uint32)
    one[1:], two[2:] = bits[:-1], bits[:-2]
    one[begin], two[begin] = 2, 1  # two starts before each text
    two[(begin + 1)[sizes > 0]] = 2
    return Tokens(one, two, cls, slot, _last_context(context, begin), np.repeat(np.arange(len(sizes), dtype=np.int32), sizes + 1), sizes + 1)


def weighted(w: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    """Sums of the rows' weights (classes x tokens), bounded so that no power of e overflows."""
    z, more = np.empty((len(w), len(rows[0])), np.float32), np.empty(len(rows[0]), np.float32)
    for k in range(len(w)):
        np.take(w[k], rows[0], out=z[k], mode="clip")
        for r in rows[1:]:
            np.take(w[k], r, out=more, mode="clip")
            z[k] += more
    return np.clip(z, -BOUND, BOUND, out=z)


def log_probability(w: np.ndarray, rows: list[np.ndarray], of: np.ndarray) -> np.ndarray:
    """Natural logarithm of the softmax's probability of the class `of` of each token."""
    z = weighted(w, rows)
    mine = z[of, np.arange(len(of))]
    return mine - np.log(np.exp(z, out=z).sum(0))


def _step(w: np.ndarray, square: np.ndarray, used: np.ndarray, rows: list[np.ndarray], of: np.ndarray) -> None:
    """One update by the gradient over some tokens, with a step of its own for each row."""
    p = weighted(w, rows)
    np.exp(p, out=p)
    p /= p.sum(0)
    p[of, np.arange(len(of))] -= 1
    r = np.concatenate(rows)
    n = np.bincount(r, minlength=w.shape[1])
    seen = np.flatnonzero(n)
    g = np.empty((len(w), len(seen)), np.float32)
    for k in range(len(w)):
        total = np.zeros(w.shape[1])
        for x in rows:
            total += np.bincount(x, p[k], w.shape[1])
        g[k] = total[seen]
    g /= np.sqrt(n[seen]).astype(np.float32)
    square[seen] += (g * g).mean(0)
    g *= STEP / np.sqrt(square[seen])
    w[:, seen] -= g
    used += n


CHANGES = "piece int, change binary, used binary"


def _gradient_rows(model, rows: int, turn: int, rounds: int):
    """One pass over this task's training documents of a round from the common weights; changes and uses of the rows, in pieces."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = model.value
        w = [x.copy() for x in first]
        square, used = [np.full(x.shape[1], 1e-2, np.float32) for x in w], [np.zeros(x.shape[1], np.int64) for x in w]
        seen = [0, 0]
        for b in batches:
            for block in b.itertuples(index=False):
                t = tokens_of(block)
                mine = (_unz(block.held, np.uint8) == 0) & (np.arange(len(t.sizes)) % rounds == turn)
                at = np.flatnonzero(mine[t.doc])
                for level, where, table, of in ((0, at, t.class_rows, t.cls), (1, at[t.slot[at] >= 0], t.place_rows, t.slot)):
                    x = 0
                    while x < len(where):
                        k = where[x : x + min(CHUNK, FIRST + seen[level] // 4)]
                        _step(w[level], square[level], used[level], table(k, rows), of[k].astype(np.int64))
                        x += len(k)
                        seen[level] += len(k)
        for level in (0, 1):
            if used[level].any():
                change = np.clip(w[level] - first[level], -6e4, 6e4).astype(np.float16)
                for k, part in enumerate(np.array_split(np.arange(change.shape[1]), SUMS)):
                    yield pd.DataFrame({"piece": [level * SUMS + k], "change": [zstandard.compress(change[:, part].tobytes(), 1)], "used": [used[level][part].tobytes()]})

    return run


def _summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The mean change of each piece of the weights, row by row, by use; sums are kept as rows come."""
    held: dict[int, list[np.ndarray]] = {}
    for b in batches:
        for piece, change, used in zip(b["piece"], b["change"], b["used"], strict=True):
            u = np.frombuffer(used, np.int64)
            c = np.frombuffer(zstandard.decompress(change), np.float16).reshape(-1, len(u)) * u.astype(np.float64)
            if piece in held:
                held[piece][0] += c
                held[piece][1] += u
            else:
                held[piece] = [c, u.copy()]
    for piece, (c, u) in held.items():
        yield pd.DataFrame({"piece": [piece], "mean": [(c / np.maximum(u, 1)).astype(np.float32).tobytes()]})


def train(encoded: DataFrame, stats: Stats, rounds: int = ROUNDS) -> list[np.ndarray]:
    """Weights after rounds of distributed updates; each round takes its share of the training documents."""
    sc = encoded.sparkSession.sparkContext
    w = stats.first_weights()
    for turn in range(rounds):
        shared = sc.broadcast(w)  # MOST rows at most
        part = encoded.select("codes", "table", "held", "sizes").mapInPandas(_gradient_rows(shared, stats.features, turn, rounds), CHANGES)
        sums = part.repartition(SUMS, "piece").mapInPandas(_summed, "piece int, mean binary").collect()  # the model, whose size is bounded
        w = [x.copy() for x in w]
        for r in sums:
            level, k = divmod(r["piece"], SUMS)
            own = np.array_split(np.arange(w[level].shape[1]), SUMS)[k]
            w[level][:, own] += np.frombuffer(r["mean"], np.float32).reshape(len(w[level]), len(own))
        shared.unpersist()
    return w


def prepared(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> tuple[DataFrame, Stats]:
    """Encoded blocks of all documents, and the statistics of the training documents."""
    spark = docs.sparkSession
    name = F.col(id_col).cast("long")
    d = docs.select(name.alias("doc_id"), F.col(text_col).cast("binary").alias("raw"))
    parts = parts or parts_for(spark, census(d).size)
    d = d.select(F.coalesce("doc_id", F.lit(0)).alias("key"), F.col("doc_id").isNull().alias("nameless"), F.coalesce(_held(F.col("doc_id")), F.lit(False)).alias("held_out"), "raw")
    blocks = materialise(d.mapInPandas(_block_rows, BLOCKS), "blocks")
    sent = blocks.select("digests", "counts").mapInPandas(_count_rows(parts), "part int, block long, digests binary, counts binary")
    tops = materialise(sent.repartition(parts, "part").mapInPandas(_top_rows, "kind int, h long, c long"), "tops")
    whole = tops.filter("kind = 1").agg(F.sum("h").alias("v"), F.sum("c").alias("c")).first()
    top = np.array([r["h"] for r in tops.filter("kind = 0").orderBy(F.desc("c"), "h").limit(CONTEXTS).collect()], np.int64).view(np.uint64)
    ends = int(d.filter(~F.col("held_out")).count())
    asked = blocks.select("block", "digests", "counts", "codes", "held", "sizes").mapInPandas(_vote_rows(top, parts), ASKED)
    answers = materialise(asked.repartition(parts, "part").mapInPandas(_answer_rows, "block long, part int, counts binary, classes binary"), "answers")
    summary = answers.filter("block = -1").select("counts", "classes").mapInPandas(_summary_rows, "kind int, cls int, h long, c long")
    rank = F.row_number().over(Window.partitionBy("cls").orderBy(F.desc("c"), "h"))
    best = summary.filter("kind = 0").withColumn("r", rank).filter(F.col("r") <= SLOTS).collect()  # at most CONTEXTS * SLOTS
    sums = summary.filter("kind = 1").groupBy("cls").agg(F.sum("h").alias("c"), F.sum("c").alias("v")).collect()
    tokens, kinds = int(whole["c"] or 0) + ends, int(whole["v"] or 0) + (ends > 0)
    share, mass, slots = np.zeros(CLASSES), np.zeros(CLASSES), np.zeros((CLASSES, WIDTH))
    mass[RARE] = share[RARE] = 0.5  # words never seen are one more rare word
    share[END] = ends + 0.5
    for r in sums:
        share[r["cls"]] += r["c"] + 0.5 * r["v"]
        mass[r["cls"]] += r["c"] + 0.5 * r["v"]
    for r in best:
        mass[r["cls"]] -= r["c"] + 0.5
        slots[r["cls"], r["r"] - 1] = r["c"] + 0.5
    slots[:, SLOTS] = mass
    share, slots = np.maximum(share, NEVER), np.maximum(slots, NEVER)  # classes and places without words
    words = np.array([r["h"] for r in best], np.int64).view(np.uint64)
    order = np.argsort(words)
    rows = min(MOST, max(LEAST, 1 << max(0, -(-kinds // WORDS_A_ROW) - 1).bit_length()))
    stats = Stats(tokens, kinds, ends, rows, top, share, slots, np.maximum(mass, 0.5), words[order], np.array([r["r"] - 1 for r in best], np.int64)[order])
    mine = answers.filter("block >= 0").groupBy("block").agg(F.collect_list(F.struct("part", "counts", "classes")).alias("answers"))
    encoded = blocks.drop("counts").join(mine, "block", "left").withColumn("answers", F.coalesce("answers", F.array().cast("array<struct<part:int,counts:binary,classes:binary>>")))
    return materialise(encoded.mapInPandas(_encode_rows(stats), ENCODED), "encoded"), stats


def scored(encoded: DataFrame, stats: Stats, weights: list[np.ndarray]) -> DataFrame:
    model = encoded.sparkSession.sparkContext.broadcast(weights)
    tokens, rows = stats.tokens, stats.features

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = model.value
        for b in batches:
            for block in b.itertuples(index=False):
                t = tokens_of(block)
                got = np.empty(len(t.cls))
                for x in range(0, len(got), CHUNK):
                    k = slice(x, x + CHUNK)
                    got[k] = log_probability(w[0], t.class_rows(k, rows), t.cls[k].astype(np.int64))
                inside = np.flatnonzero(t.slot >= 0)
                for x in range(0, len(inside), CHUNK):
                    k = inside[x : x + CHUNK]
                    got[k] += log_probability(w[1], t.place_rows(k, rows), t.slot[k].astype(np.int64))
                more = np.add.reduceat(got, np.cumsum(t.sizes) - t.sizes) / np.log(10) if len(t.sizes) else np.zeros(0)
                yield pd.DataFrame({
                    "doc_id": _unz(block.ids, np.int64), "nameless": _unz(block.nameless, np.uint8) > 0, "held_out": _unz(block.held, np.uint8) > 0, "n_tokens": t.sizes, "n_known": np.frombuffer(block.known, np.int64),
                    "train_tokens": tokens, "base_score": np.frombuffer(block.base, np.float64), "score": np.frombuffer(block.inner, np.float64) + more,
                })

    out = encoded.mapInPandas(run, "doc_id long, nameless boolean, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumn("doc_id", F.when(~F.col("nameless"), F.col("doc_id"))).drop("nameless")


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Documents with crc32(id) mod 5 = 1 are held out, all others train; rows without an id train.
    Scores are log10 probabilities of the whole text and its end. Null, empty and blank texts are an
    end alone. Rows are documents of their own, whether or not they repeat an id or have none. With no
    training documents every token is unknown and the weights are those of the start. Other columns
    are ignored; an empty table gives no rows.
    """
    encoded, stats = prepared(docs, id_col, text_col, parts)
    return scored(encoded, stats, train(encoded, stats))
