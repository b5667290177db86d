"""Mixing sources to target weights by iterative proportional fitting.

Token counts are summed into cells (source, language, topic). The topic is what a text is
labelled as. The cells' weights are raked until their marginals meet the targets, or a last
error is reported where targets conflict; a cell's weight over its tokens
is the calibrated rate, scaled so that the kept tokens meet a budget with no rate
over one. A document is kept when a number in [0, 1) drawn from a digest of its
id is below its cell's rate, so the same documents are kept however they are dealt.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import SPACE, materialise

#: Least and most rounds of raking, the largest relative error of a marginal that ends it, share of all tokens to keep, powers that flatten each marginal, and the bound on cells.
ROUNDS, MOST_ROUNDS, CLOSE, BUDGET, POWERS, MAX_CELLS = 30, 2000, 1e-10, 0.6, (0.7, 0.8, 0.9), 200_000
SEED = "mix-1"
UNLABELLED = "unlabelled"


def n_words(text):
    """Words of a text column; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(rf"[^{SPACE[1:]}+")), F.lit(0)).cast("long")


def with_topic(docs: DataFrame, labels: DataFrame | None, id_col: str, name: str) -> DataFrame:
    """docs with a topic column: toxic, junk or clean as labels (doc_id, quality, toxic) say, unlabelled for others and for rows without an id. Of an id that is labelled twice the worse label counts."""
    if labels is None:
        return docs.withColumn(name, F.lit(UNLABELLED))
    worst = labels.groupBy(F.col("doc_id").alias("__label")).agg(F.max("toxic").alias("__toxic"), F.min("quality").alias("__good"))
    said = worst.select("__label", F.when(F.col("__toxic") == 1, "toxic").when(F.col("__good") == 0, "junk").otherwise("clean").alias("__said"))
    out = docs.join(said, docs[id_col] == said["__label"], "left").withColumn(name, F.coalesce("__said", F.lit(UNLABELLED)))
    return out.drop("__label", "__said")


def chance(id_col, seed: str = SEED):
    """A number in [0, 1) from 32 bits of the digest of an id column; null counts as an id of its own."""
    key = F.md5(F.concat_ws("/", F.lit(seed), F.coalesce(id_col.cast("string"), F.lit("null"))))
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def rake(cells: pd.DataFrame, axes: list[str], powers: tuple = POWERS, rounds: int = ROUNDS, budget: float = BUDGET, targets: dict | None = None, most_rounds: int = MOST_ROUNDS) -> tuple[np.ndarray, float]:
    """The rate of each cell (columns axes, tokens), and the largest relative error of a marginal that is left.

    targets: axis -> {value: share}; else shares are tokens to the power given. Targets that conflict leave an error.
    """
    tokens = cells["tokens"].to_numpy(float)
    weight, total = tokens.copy(), tokens.sum()
    if not total:
        return np.ones(len(cells)), 0.0
    codes = [pd.factorize(cells[a], use_na_sentinel=False) for a in axes]
    aims = []
    for axis, power, (code, values) in zip(axes, powers, codes, strict=True):
        own = np.bincount(code, tokens)
        want = np.array([targets[axis].get(v, 0.0) for v in values]) if targets and axis in targets else np.where(own > 0, own, 0) ** power * (own > 0)
        aims.append(want / want.sum() * total)
    error = 0.0
    for k in range(max(rounds, most_rounds)):
        for (code, _values), aim in zip(codes, aims, strict=True):
            have = np.bincount(code, weight)
            weight *= np.divide(aim, have, out=np.zeros_like(aim), where=have > 0)[code]
        error = max(float(np.max(np.abs(np.bincount(code, weight) - aim) / np.where(aim > 0, aim, total))) for (code, _values), aim in zip(codes, aims, strict=True))
        if k + 1 >= rounds and error <= CLOSE:
            break
    ratio = np.divide(weight, tokens, out=np.zeros_like(weight), where=tokens > 0)
    #: Rates min(1, scale * ratio) that keep the budget: the largest ratios are cut at one, the scale serves the rest.
    order = np.argsort(-ratio, kind="stable")
    cut = np.concatenate([[0.0], np.cumsum(tokens[order])])
    rest = weight.sum() - np.concatenate([[0.0], np.cumsum(weight[order])])
    for k in range(len(cells)):
        scale = (budget * total - cut[k]) / rest[k] if rest[k] > 0 else 0.0
        if scale * ratio[order[k]] <= 1:
            break
    else:
        scale = np.inf
    return np.where(ratio > 0, np.minimum(1.0, np.maximum(scale, 0.0) * ratio), np.where(tokens > 0, 0.0, 1.0)), error


def rates(docs: DataFrame, axes: list[str], max_cells: int = MAX_CELLS, **kw) -> DataFrame:
    """axes, tokens, rate, margin_error: one row per cell of docs, which has the axes and n_tokens.

    The cells, not the documents, come to the driver; more than max_cells of them are refused.
    """
    cells = docs.groupBy(*axes).agg(F.sum("n_tokens").alias("tokens"))
    got = cells.limit(max_cells + 1).toPandas()
    if len(got) > max_cells:
        raise ValueError(f"more than {max_cells} cells of {axes}")
    got = got.sort_values(axes, na_position="first", ignore_index=True)
    got["rate"], error = rake(got, axes, **kw)
    kind = {f.name: f.dataType.simpleString() for f in docs.schema}
    rows = [tuple(None if pd.isna(v) else v for v in r[: len(axes)]) + (int(r[-2]), float(r[-1]), error) for r in got[[*axes, "tokens", "rate"]].itertuples(index=False)]
    return docs.sparkSession.createDataFrame(rows, ", ".join(f"{a} {kind[a]}" for a in axes) + ", tokens long, rate double, margin_error double")


def mix(docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", axes=("source", "lang"), seed: str = SEED, **kw) -> DataFrame:
    """One row per input row: doc_id, source, lang, topic, n_tokens, rate, margin_error, kept, in no order.

    labels give the topics (with_topic). A null source or language is a value of its own. Null and empty
    texts have no tokens; a cell without tokens has rate one. Rows that repeat an id share their draw.
    Other columns are ignored. Ties cannot arise: the draw is compared with the rate alone. The broadcast
    side is the cells' rates, at most max_cells rows. margin_error: what raking leaves, above CLOSE only
    where targets conflict.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), *[F.col(a).alias(a) for a in axes], n_words(F.col(text_col)).alias("n_tokens"))
    #: The cells and the result both come from these narrow rows; the texts are read once.
    rows = materialise(with_topic(rows, labels, "doc_id", "topic"), "cells")
    r = rates(rows, [*axes, "topic"], **kw)
    out = with_rates(rows, r, [*axes, "topic"]).withColumn("kept", chance(F.col("doc_id"), seed) < F.col("rate"))
    return out.select("doc_id", *axes, "topic", "n_tokens", "rate", "margin_error", "kept")


def with_rates(rows: DataFrame, r: DataFrame, axes: list[str]) -> DataFrame:
    """rows with their cell's rate and the error."""
    renamed = r.select(*[F.col(a).alias(f"__r_{a}") for a in axes], "rate", "margin_error")
    cond = F.lit(True)
    for a in axes:
        cond = cond & rows[a].eqNullSafe(renamed[f"__r_{a}"])
    return rows.join(F.broadcast(renamed), cond, "left").drop(*[f"__r_{a}" for a in axes])


def sample(docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", axes=("source", "lang"), seed: str = SEED, **kw) -> DataFrame:
    """The rows of docs that mix keeps, with their own columns."""
    cols = docs.columns
    named = [f"__{a}" for a in axes] + ["__topic"]
    marked = with_topic(docs.select("*", *[F.col(a).alias(f"__{a}") for a in axes]), labels, id_col, "__topic")
    narrow = with_topic(docs.select(F.col(id_col).alias("__id"), *[F.col(a).alias(f"__{a}") for a in axes], n_words(F.col(text_col)).alias("n_tokens")), labels, "__id", "__topic")
    r = rates(materialise(narrow.select(*named, "n_tokens"), "cells"), named, **kw).withColumnRenamed("rate", "__rate")
    renamed = r.select(*[F.col(a).alias(f"__r{a}") for a in named], "__rate")
    cond = F.lit(True)
    for a in named:
        cond = cond & marked[a].eqNullSafe(renamed[f"__r{a}"])
    return marked.join(F.broadcast(renamed), cond).filter(chance(F.col(id_col), seed) < F.col("__rate")).select(*cols)
