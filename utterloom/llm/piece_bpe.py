"""Exact merge-type encoding of SentencePiece BPE models by backtracking, and decoding.

A merge-type encoder joins, again and again, the neighbours whose union has the best
score. The same result is found left to right: take the longest piece that starts here
(all matches from one Aho-Corasick pass), accept it if it can stand next to the piece
before it, else try the next shorter one, else mark the place as failed in a bitfield
and step back. Two pieces can stand side by side when undoing their merges in reverse
order shows no earlier merge across the border.

No piece of such a model crosses from a word into the next `▁`, nor from letters to other
characters, so a text is encoded in units (a run of `▁` and the letters, or else the other
characters, behind it) and frequent units are looked up.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
LETTER = re.compile(r"[^\W\d_]")
#: Units kept for lookup in a worker, and the longest of them.
KEEP_UNITS, KEEP_LENGTH = 400_000, 64
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _fields(blob: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of each field of a protocol buffer message."""
    at, end = 0, len(blob)

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = blob[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < end:
        key = varint()
        kind = key & 7
        if kind == 0:
            value: object = varint()
        elif kind == 2:
            n = varint()
            value, at = blob[at : at + n], at + n
        else:
            n = 8 if kind == 1 else 4
            value, at = struct.unpack("<d" if kind == 1 else "<f", blob[at : at + n])[0], at + n
        yield key >> 3, value


class PieceModel:
    """Tables of a SentencePiece BPE model with byte fallback and the identity normaliser."""

    def __init__(self, path: str) -> None:
        pieces, trainer, normalizer = [], {}, {}
        with open(path, "rb") as f:
            for number, value in _fields(f.read()):
                if number == 1:
                    p = dict(_fields(value))
                    pieces.append((p.get(1, b"").decode(), p.get(2, 0.0), p.get(3, NORMAL)))
                elif number == 2:
                    trainer = dict(_fields(value))
                elif number == 3:
                    normalizer = dict(_fields(value))
        if trainer.get(3) != 2 or normalizer.get(2) or any(k in (USER, UNUSED) for _, _, k in pieces):
            raise ValueError("only BPE models with the identity normaliser and without user-defined or unused pieces are supported")
        self.prefix, self.squeeze = bool(normalizer.get(3, 1)), bool(normalizer.get(4, 1))
        if self.squeeze or not normalizer.get(5, 1):
            raise ValueError("models that remove extra white space or leave it unescaped are not supported")
        self.byte_ids = {int(s[1:-1], 16): i for i, (s, _, k) in enumerate(pieces) if k == BYTE}
        self.unknown = next(i for i, (_, _, k) in enumerate(pieces) if k == UNKNOWN)
        #: rank: place in the order of merges; a better score merges earlier, ties by the smaller id.
        order = sorted((i for i, x in enumerate(pieces) if x[2] == NORMAL), key=lambda i: (-pieces[i][1], i))
        self.rank = {pieces[i][0]: r for r, i in enumerate(order)}
        self.id_of = {pieces[i][0]: i for i in order}
        if any(MARK in s.lstrip(MARK) for s in self.rank):
            raise ValueError("a piece crosses words")
        self.unit_pattern = self._units()
        #: split: a piece that merging can reach -> the two pieces of its last merge; a single character -> None.
        self.split: dict[str, tuple[str, str] | None] = {}
        for s in self.rank:
            if len(s) == 1:
                self.split[s] = None
            elif (last := self._last_merge(s)) is not None:
                self.split[s] = last
        self.matcher = ahocorasick.Automaton()
        for s in self.split:
            self.matcher.add_word(s, len(s))
        self.matcher.make_automaton()
        self.fits: dict[tuple[str, str], bool] = {}
        #: Two generations, so that frequent units stay when the lookup table is full.
        self.units: dict[str, tuple[str, int, str]] = {}
        self.older: dict[str, tuple[str, int, str]] = {}

    def _units(self) -> re.Pattern:
        """Units: no piece reaches over their ends. Letters that a piece joins to other characters count as such."""
        bodies = [b for s in self.rank if len(b := s.lstrip(MARK)) > 1]
        odd: set[str] = set()
        while True:
            letter = [[bool(LETTER.match(c)) and c not in odd for c in b] for b in bodies]
            more = {b[k + d] for b, m in zip(bodies, letter, strict=True) for k in range(len(b) - 1) if m[k] != m[k + 1] for d in (0, 1) if m[k + d]}
            if not more:
                break
            odd |= more
        kind = rf"[^\W\d_{''.join(map(re.escape, sorted(odd)))}]"
        return re.compile(f"{MARK}*{kind}+|{MARK}*(?:(?!{kind})[^{MARK}])+|{MARK}+")

    def _last_merge(self, s: str) -> tuple[str, str] | None:
        """Merge the characters of s by rank; the last merge, or None if s does not come out as one piece."""
        parts, last = list(s), None
        while len(parts) > 1:
            best = min(((self.rank[parts[k] + parts[k + 1]], k) for k in range(len(parts) - 1) if parts[k] + parts[k + 1] in self.rank), default=None)
            if best is None:
                return None
            k = best[1]
            last = (parts[k], parts[k + 1])
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return last

    def beside(self, a: str, b: str) -> bool:
        """Whether merging leaves a and b as they are when they stand side by side."""
        key = (a, b)
        if (known := self.fits.get(key)) is None:
            if len(self.fits) > 2 * KEEP_UNITS:
                self.fits.clear()
            known = self.fits[key] = self._beside(a, b)
        return known

    def _beside(self, a: str, b: str) -> bool:
        """Undo the later of the two pieces' last merges, step by step; the pieces at the border must never have merged across it first."""
        rank, split = self.rank, self.split
        made_left, made_right = split.get(a), split.get(b)
        left_done, right_done = rank[a] if made_left else -1, rank[b] if made_right else -1  # ranks of the merges that made them
        undone_left = undone_right = len(rank)  # ranks at which the present border pieces were consumed
        while True:
            across = rank.get(a + b)
            #: of equal ranks the merge further left comes first: a's own to the left, but the one across before b's own
            if across is not None and across < undone_left and across <= undone_right:
                return False
            if made_left is None and made_right is None:
                return True
            if left_done >= right_done and made_left is not None:
                undone_left, a = left_done, made_left[1]
                made_left = split.get(a)
                left_done = rank[a] if made_left else -1
            else:
                undone_right, b = right_done, made_right[0]
                made_right = split.get(b)
                right_done = rank[b] if made_right else -1

    def pieces_of(self, s: str) -> list[str]:
        """The pieces of s, characters without a piece as they are."""
        n = len(s)
        longest = [1] * n
        for end, length in self.matcher.iter(s):
            start = end - length + 1
            if length > longest[start]:
                longest[start] = length
        open_at = (1 << (n + 1)) - 1  # bit k: a path through place k may still succeed
        split, out, at, size = self.split, [], 0, 0
        trial = longest[0] if n else 0
        while at < n:
            size = trial
            while size:
                piece = s[at : at + size]
                if (size == 1 or piece in split) and open_at >> (at + size) & 1 and (not out or self.beside(out[-1], piece)):
                    break
                size -= 1
            if size:
                out.append(s[at : at + size])
                at += size
                trial = longest[at] if at < n else 0
            else:
                open_at &= ~(1 << at)
                back = len(out.pop())
                at -= back
                trial = back - 1
        return out

    def unit(self, s: str) -> tuple[str, int, str]:
        """Ids joined by commas, their number, and the decoded text of a unit."""
        found = self.units.get(s)
        if found is None and (found := self.older.get(s)) is not None:
            self.units[s] = found
        if found is None:
            ids: list[int] = []
            for piece in self.pieces_of(s):
                own = self.id_of.get(piece)
                if own is not None:
                    ids.append(own)
                elif self.byte_ids:
                    ids += [self.byte_ids[b] for b in piece.encode()]
                else:
                    ids.append(self.unknown)
            found = (",".join(map(str, ids)), len(ids), self.decode(ids))
            if len(s) <= KEEP_LENGTH:
                if len(self.units) >= KEEP_UNITS // 2:
                    self.units, self.older = {}, self.units
                self.units[s] = found
        return found

    def decode(self, ids: list[int]) -> str:
        """The text of ids, `▁` as a space; the added first space is not taken off here."""
        if not hasattr(self, "surface"):
            self.surface = {i: s.encode() for s, i in self.id_of.items()} | {i: bytes([b]) for b, i in self.byte_ids.items()} | {self.unknown: " ⁇ ".encode()}
        return b"".join(self.surface[i] for i in ids).decode("utf-8", "replace").replace(MARK, " ")

    def normalise(self, text: str) -> str:
        return (MARK + text.replace(" ", MARK)) if text and self.prefix else text.replace(" ", MARK)

    def encode(self, text: str) -> list[int]:
        return [int(x) for u in self.unit_pattern.findall(self.normalise(text)) for x in self.unit(u)[0].split(",")]

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids joined by commas, SHA-256 of the decoded text."""
        found = [self.units.get(u) or self.unit(u) for u in self.unit_pattern.findall(self.normalise(text))]
        back = "".join([x[2] for x in found])
        back = back[1:] if self.prefix and back.startswith(" ") else back
        return sum([x[1] for x in found]), hashlib.sha256(",".join([x[0] for x in found]).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


_models: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    """The tables, built once in each worker from the file, which every machine has."""
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def encode_digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids_sha256, decoded_sha256, over whole texts.

    Null counts as empty, which has no ids. Rows that repeat an id get a row each. Other
    columns are ignored. A narrow map: no shuffle, one batch of rows in memory at a time.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model(model_path)
        for b in batches:
            got = [m.digest(t or "") for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_tokens": [g[0] for g in got], "ids_sha256": [g[1] for g in got], "decoded_sha256": [g[2] for g in got]})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, SCHEMA)


def encode_texts(docs: DataFrame, model_path: str, text_col: str = "text") -> DataFrame:
    """docs with `piece_ids` (array<int>) and `decoded` (string)."""
    names = [c for c in docs.columns if c not in ("piece_ids", "decoded")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in names) + ", piece_ids array<int>, decoded string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model(model_path)
        for b in batches:
            ids = [m.encode(t or "") for t in b[text_col]]
            text = [m.decode(x) for x in ids]
            yield b.assign(piece_ids=ids, decoded=[t[1:] if m.prefix and t.startswith(" ") else t for t in text])

    return docs.select(*names).mapInPandas(run, schema)
