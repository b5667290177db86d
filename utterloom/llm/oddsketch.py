"""MinHash near-duplicates with odd sketches.

The distinct word shingles of a text give MinHash samples; bands of samples put similar
texts into common buckets, and all samples fold into a parity bitmap (odd sketch): the
population count of the XOR of two bitmaps estimates how many samples differ.

Texts with the same set (by its size and two 64-bit digests of it) are one class and go on
as one. In each bucket the member that
meets most others over all bands is the centre. Members are verified against their centre
on full sets; what a member lacks of the centre's set, and has beside it, then stands for
its set. Members that are not linked with the centre are compared with the other members
(two members that are both linked are connected already): candidates by distance from the
centre and by sketch, links on the sets. So every pair that shares a bucket is decided,
without listing the pairs of a bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import packed
from .components import components
from .util import census, keyed, materialise

#: Bands and samples in each: two sets of similarity 0.85 share no bucket with probability (1 - 0.85**5)**25 = 4e-7.
BANDS, ROWS, BITS = 25, 5, 512
#: Estimates are trusted only this far below the threshold (six standard deviations of 125 samples).
MARGIN = 0.2
#: Members verified in one group, rows of a block of members, and width of the cells of distance.
GROUP, BLOCK, CELL = 32, 100, 0.05
_RANDOM = np.random.default_rng(20240229)
_A = _RANDOM.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RANDOM.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)
_POP = np.array([bin(k).count("1") for k in range(256)], np.uint16)


def shingle_sets(hashes: packed.WordHashes, texts: list[bytes | None], width: int) -> list[np.ndarray]:
    """Sorted distinct digests of each text's shingles, lower-cased (A-Z); a text of fewer words has its whole sequence as one."""
    docs = [(t or b"").lower().split() for t in texts]
    sizes = [len(d) for d in docs]
    w, _ = hashes.of(docs)
    g = packed.mixed(packed.chained(w, width))
    out, at = [], 0
    for n in sizes:
        if n >= width:
            out.append(np.unique(g[at : at + n - width + 1]))
        elif n:
            short = w[at : at + n]
            out.append(packed.mixed(packed.chained(short, n) + np.uint64(n)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Band digests (sets x BANDS) and odd sketches (sets x BITS / 8 bytes) of non-empty sets."""
    flat = np.concatenate(sets)
    sizes = np.array([len(s) for s in sets])
    first = np.cumsum(sizes) - sizes
    low = np.empty((len(_A), len(sets)), np.uint64)
    step = max(1, int(np.searchsorted(np.cumsum(sizes), 60_000)))
    for x in range(0, len(sets), step):  # about as much as a cache holds
        y = min(x + step, len(sets))
        part = flat[first[x] : first[y - 1] + sizes[y - 1]]
        own = first[x:y] - first[x]
        for k in range(len(_A)):
            low[k, x:y] = np.minimum.reduceat(part * _A[k] + _B[k], own)
    low = packed.mixed(low)
    bands = np.zeros((len(sets), BANDS), np.uint64)
    for b in range(BANDS):
        h = np.full(len(sets), b + 1, np.uint64)
        for r in range(ROWS):
            h = packed.mixed(h * np.uint64(0x9E3779B97F4A7C15) + low[b * ROWS + r])
        bands[:, b] = h
    spot = (packed.mixed(low + np.arange(len(_A), dtype=np.uint64)[:, None]) % np.uint64(BITS)).astype(np.int64)
    parity = np.zeros((len(sets), BITS), np.uint8)
    for k in range(len(_A)):
        parity[np.arange(len(sets)), spot[k]] ^= 1
    return bands, np.packbits(parity, axis=1)


def estimated(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity of each row of a to each row of b by their odd sketches."""
    x = _POP[a[:, None, :] ^ b[None, :, :]].sum(2)
    inner = np.maximum(1 - 2.0 * x / BITS, 1e-9)
    return 1 + (BITS / 2) * np.log(inner) / (2 * len(_A))


def _signature_rows(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = packed.WordHashes()
        for b in batches:
            ids, names, texts = b["key"].to_numpy(np.int64), list(b["id"]), list(b["raw"])
            for x, y in packed.slices([t or b"" for t in texts], 12_000_000):
                sets = shingle_sets(hashes, texts[x:y], width)
                some = [k for k, s in enumerate(sets) if len(s)]
                same = np.zeros((2, len(sets)), np.int64)
                for k in some:
                    same[0, k] = sets[k].sum(dtype=np.uint64).view(np.int64)
                    same[1, k] = np.bitwise_xor.reduce(packed.mixed(sets[k])).view(np.int64)
                out = pd.DataFrame({"key": ids[x:y], "id": names[x:y], "n_shingles": [len(s) for s in sets], "same_a": same[0], "same_b": same[1], "bands": None, "sketch": None})
                if some:
                    bands, sketch = signatures([sets[k] for k in some])
                    got_b, got_s = [None] * len(out), [None] * len(out)
                    for j, k in enumerate(some):
                        got_b[k], got_s[k] = bands[j].view(np.int64), sketch[j].tobytes()
                    out["bands"], out["sketch"] = got_b, got_s
                yield out

    return run


def _verify_rows(width: int, percent: int):
    """One group: a centre's text (role 0) and members' (role 1). Their links, and their sets as differences from the centre's."""

    def run(key, g: pd.DataFrame) -> pd.DataFrame:
        centre = int(key[0])
        hashes = packed.WordHashes()
        sets = shingle_sets(hashes, list(g["raw"]), width)
        role = g["role"].to_numpy()
        c = sets[int(np.flatnonzero(role == 0)[0])]
        out = []
        for k in np.flatnonzero(role == 1):
            s = sets[k]
            have = np.isin(c, s, assume_unique=True)
            extra = s[~np.isin(s, c, assume_unique=True)]
            both = int(have.sum())
            union = len(s) + len(c) - both
            out.append((centre, int(g["doc_id"].iat[k]), both, len(s), 100 * both >= percent * union, 1 - both / union, np.packbits(have).tobytes(), len(c), extra.tobytes(), g["sketch"].iat[k]))
        return pd.DataFrame(out, columns=["centre", "doc_id", "both", "n", "linked", "far", "have", "width", "extra", "sketch"])

    return run


STAR = "centre long, doc_id long, both long, n long, linked boolean, far double, have binary, width long, extra binary, sketch binary"


def _block_links(percent: int):
    """Links between the members of one block that are not linked with the centre (side 0) and those of another (side 1)."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        y, x = g[g["side"] == 0], g[g["side"] == 1]
        if not len(x) or not len(y):
            return pd.DataFrame({"a": pd.Series([], dtype="int64"), "b": pd.Series([], dtype="int64")})
        ids_y, ids_x = y["doc_id"].to_numpy(), x["doc_id"].to_numpy()
        sk = lambda f: np.frombuffer(b"".join(f["sketch"]), np.uint8).reshape(len(f), -1)
        n_y, n_x = y["n"].to_numpy(np.int64), x["n"].to_numpy(np.int64)
        may = estimated(sk(y), sk(x)) >= percent / 100 - MARGIN
        may &= 100 * np.minimum(n_y[:, None], n_x[None, :]) >= percent * np.maximum(n_y[:, None], n_x[None, :])
        may &= ids_y[:, None] != ids_x[None, :]
        rows, cols = np.flatnonzero(may.any(1)), np.flatnonzero(may.any(0))
        if not len(rows):
            return pd.DataFrame({"a": pd.Series([], dtype="int64"), "b": pd.Series([], dtype="int64")})
        width = int(g["width"].iat[0])
        bits = lambda f: np.unpackbits(np.frombuffer(b"".join(f["have"]), np.uint8).reshape(len(f), -1), axis=1)[:, :width].astype(np.float32)
        py, px = y.iloc[rows], x.iloc[cols]
        both = bits(py) @ bits(px).T
        ex = [np.frombuffer(e, np.uint64) for e in [*py["extra"], *px["extra"]]]
        values, code, times = np.unique(np.concatenate(ex), return_inverse=True, return_counts=True)
        shared = np.flatnonzero(times > 1)
        if len(shared):
            column = np.full(len(values), -1)
            column[shared] = np.arange(len(shared))
            owner = np.repeat(np.arange(len(ex)), [len(e) for e in ex])
            for at in range(0, len(shared), 20_000):
                m = np.zeros((len(ex), min(20_000, len(shared) - at)), np.float32)
                inside = (column[code] >= at) & (column[code] < at + m.shape[1])
                m[owner[inside], column[code[inside]] - at] = 1
                both += m[: len(rows)] @ m[len(rows) :].T
        union = n_y[rows][:, None] + n_x[cols][None, :] - both
        hit = may[np.ix_(rows, cols)] & (100 * np.rint(both) >= percent * np.rint(union))
        r, c = np.nonzero(hit)
        #: One link of each member is enough to hang it on; those between a tree's nodes add nothing.
        r, c = _forest(ids_y[rows][r], ids_x[cols][c])
        return pd.DataFrame({"a": r, "b": c})

    return run


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links that join two trees, in order."""
    top: dict[int, int] = {}

    def root(v: int) -> int:
        while (u := top.setdefault(v, v)) != v:
            top[v] = top[u]
            v = top[v]
        return v

    keep = []
    for k, (u, v) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        ru, rv = root(u), root(v)
        if ru != rv:
            top[ru] = rv
            keep.append(k)
    return a[keep], b[keep]


def near_groups(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Texts are linked when the intersection of their shingle sets is percent / 100 of the union
    or more. component_id is the smallest id that links reach. Null, empty and blank texts have
    no shingles and stand alone. Rows are nodes of their own, whether or not they repeat an id or
    have none; component_id is null where no row that is reached has an id. kept: the row's id is
    the component's; in a component without ids, the rows of one text (so one row, unless it is repeated). Other columns
    are ignored; an empty table gives no rows.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("raw"))
    c = census(d)
    d = keyed(d, c)
    schema = "key long, id string, n_shingles long, same_a long, same_b long, bands array<long>, sketch binary"
    signed = d.select("key", F.col("doc_id").cast("string").alias("id"), "raw").mapInPandas(_signature_rows(width), schema)
    signed = materialise(signed.withColumn("doc_id", F.col("id").cast("long")).drop("id"), "signatures")
    same = ["n_shingles", "same_a", "same_b"]
    #: A table of its own: joins with it can then split the rows of a very large class.
    classes = materialise(signed.filter("n_shingles > 0").groupBy(*same).agg(F.min("key").alias("rep"), F.min("doc_id").alias("least")), "classes")
    reps = signed.filter("n_shingles > 0").join(classes.select(*same, F.col("rep").alias("key")), [*same, "key"], "left_semi")
    if not c.plain:
        reps = reps.dropDuplicates(["key"])  # rows that are alike
    reps = reps.select(F.col("key").alias("doc_id"), "bands", "sketch")
    found = components(_links(d, reps, width, percent, c.plain))
    if c.plain:
        first = found.select(F.col("node").alias("rep"), "component")
    else:  # from the smallest key that is reached to the smallest id
        own = found.select(F.col("node").alias("rep"), F.col("component").alias("group")).join(classes.select("rep", "least"), "rep")
        first = own.join(own.groupBy("group").agg(F.min("least").alias("component")), "group").select("rep", "component", "group")
    rows = signed.select("key", "doc_id", *same).join(classes, same, "left").join(first, "rep", "left")
    group = F.coalesce("component" if c.plain else "group", "rep", "key")
    component = F.coalesce("component", "least", F.when(F.col("rep").isNull(), F.col("doc_id")))
    rows = rows.select("key", "doc_id", "n_shingles", component.alias("component_id"), group.alias("group"))
    kept = F.col("doc_id") == F.col("component_id")
    if not c.plain:
        lone = rows.filter("component_id is null")
        least = lone.groupBy("group").agg(F.min("key").alias("least"))
        rows = rows.join(least, "group", "left")
        kept = F.coalesce(kept, F.col("key") == F.col("least"), F.lit(False))
    return rows.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def _links(d: DataFrame, reps: DataFrame, width: int, percent: int, plain: bool) -> DataFrame:
    """Links (a, b) between representatives (doc_id: their keys) that connect all that share a bucket and are similar."""
    banded = materialise(reps.select("doc_id", F.explode("bands").alias("band")), "bands")
    sizes = banded.groupBy("band").agg(F.count("*").alias("size")).filter("size > 1")
    held = materialise(banded.join(sizes, "band"), "buckets")
    meets = held.groupBy("doc_id").agg(F.sum("size").alias("meets"))
    ranked = held.join(meets, "doc_id")
    centre = ranked.groupBy("band").agg(F.max(F.struct("meets", (-F.col("doc_id")).alias("less"))).alias("top")).select("band", (-F.col("top.less")).alias("centre"))
    stars = held.join(centre, "band").filter("doc_id <> centre").groupBy("centre", "doc_id").agg(F.max("size").alias("size"))
    sketch = reps.select("doc_id", "sketch")
    stars = stars.join(sketch, "doc_id").join(sketch.select(F.col("doc_id").alias("centre"), F.col("sketch").alias("centre_sketch")), "centre")
    #: A bucket of two has no other pair to decide, so its sketches may dismiss it.
    words = lambda c: [F.conv(F.hex(F.substring(c, 1 + 4 * k, 4)), 16, 10).cast("long") for k in range(BITS // 32)]
    apart = sum((F.bit_count(x.bitwiseXOR(y)) for x, y in zip(words("sketch"), words("centre_sketch"), strict=True)), F.lit(0))
    lowest = percent / 100 - MARGIN
    most = BITS / 2 * (1 - np.exp(-(1 - lowest) * 4 * len(_A) / BITS))
    stars = materialise(stars.filter((F.col("size") > 2) | (apart <= float(most))).select("centre", "doc_id", "sketch"), "stars")
    count = stars.groupBy("centre").agg(F.count("*").alias("members"))
    salts = F.ceil(F.col("members") / GROUP).cast("int")
    salt = lambda c, n: F.pmod(F.xxhash64(c), n)
    wanted = stars.join(count, "centre").select("doc_id", "centre", salt("doc_id", salts).alias("salt"), F.lit(1).alias("role"), "sketch")
    wanted = wanted.unionByName(wanted.select("centre", "salt").distinct().select(F.col("centre").alias("doc_id"), "centre", "salt", F.lit(0).alias("role"), F.lit(None).cast("binary").alias("sketch")))
    texts = d.select(F.col("key").alias("doc_id"), "raw")
    if not plain:
        texts = texts.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    texts = wanted.join(texts, "doc_id").select("centre", "salt", "doc_id", "role", "sketch", "raw")
    star = materialise(texts.groupBy("centre", "salt").applyInPandas(_verify_rows(width, percent), STAR), "verified")
    links = star.filter("linked").select(F.col("centre").alias("a"), F.col("doc_id").alias("b"))
    # the rest: members without a link to their centre, against the others of the star, by cells of distance
    loose = star.groupBy("centre").agg(F.sum(F.when(F.col("linked"), 0).otherwise(1)).alias("loose"), F.count("*").alias("members")).filter("loose > 0 and members > 1")
    cell = F.floor(F.col("far") / CELL).cast("int")
    reach = int(np.ceil((1 - percent / 100) / CELL)) + 1
    m = star.join(loose, "centre").withColumn("cell", cell)
    per_cell = m.groupBy("centre", "cell").agg(F.sum(F.when(F.col("linked"), 0).otherwise(1)).alias("y_n"), F.count("*").alias("x_n"))
    blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    x_cells = per_cell.select("centre", F.col("cell").alias("x_cell"), blocks("x_n").alias("x_blocks"))
    y_cells = per_cell.filter("y_n > 0").select("centre", F.col("cell").alias("y_cell"), blocks("y_n").alias("y_blocks"))
    #: Equal members lie at most 1 - percent / 100 apart (the distance is a metric), and every pair is met from its farther side.
    pairs = y_cells.join(x_cells, "centre").filter((F.col("x_cell") <= F.col("y_cell")) & (F.col("x_cell") >= F.col("y_cell") - reach))
    keep = ["centre", "doc_id", "n", "have", "width", "extra", "sketch"]
    tag = lambda c, n: F.pmod(F.xxhash64(c, F.lit(7)), n).cast("int")
    ys = m.filter("not linked").select(*keep, F.col("cell").alias("y_cell")).join(pairs, ["centre", "y_cell"])
    ys = ys.withColumn("y_block", tag("doc_id", F.col("y_blocks"))).withColumn("x_block", F.explode(F.sequence(F.lit(0), F.col("x_blocks") - 1))).withColumn("side", F.lit(0))
    xs = m.select(*keep, F.col("cell").alias("x_cell")).join(pairs, ["centre", "x_cell"])
    xs = xs.withColumn("x_block", tag("doc_id", F.col("x_blocks"))).withColumn("y_block", F.explode(F.sequence(F.lit(0), F.col("y_blocks") - 1))).withColumn("side", F.lit(1))
    cols = [*keep, "y_cell", "x_cell", "y_block", "x_block", "side"]
    more = ys.select(*cols).unionByName(xs.select(*cols)).groupBy("centre", "y_cell", "x_cell", "y_block", "x_block").applyInPandas(_block_links(percent), "a long, b long")
    return links.unionByName(more)
