"""Quality rules by weak supervision.

Rules vote good, bad or abstain. Expectation-maximisation over the table of vote
patterns estimates how often each rule gives each vote to good texts and to each kind
of bad ones, and the shares of these classes; the posterior probability of being good
replaces all-must-pass filtering. Labelled texts, where there are some, say which class is
which: they give the first estimates and stay in their class. So a rule that dislikes good
texts as often as bad ones is seen through, and its votes count for nothing.

The main path is built-in expressions. The pattern table has at most 3**len(RULES) rows for
each label, whatever the input, and comes to the driver, where the estimates are made.
"""

from __future__ import annotations

from collections import defaultdict
from math import exp, log

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import materialise, without_space, words_of

SYMBOLS = "#*$%&|<>"
#: Rounds of EM and pseudo-votes of each kind.
ROUNDS, SMOOTH = 12, 1.0
THRESHOLD = 0.5


def signals(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with one more column, `__q`, a struct of counts of the whole text (null: none).

    The 5-word windows of a text are compared by 64-bit digests first; only where two agree
    are they compared as strings, with their places, so the counts are exact.
    """
    n = F.size("__w")
    d = docs.withColumn("__t", F.coalesce(F.col(text_col), F.lit(""))).withColumn("__w", words_of(F.col("__t")))
    d = d.withColumn("__h", F.transform("__w", lambda w: F.xxhash64(w)))
    pair = lambda a, b: F.xxhash64(a, b)
    later = lambda c, k: F.slice(F.col(c), k + 1, F.greatest(F.lit(0), n - k))
    d = d.withColumn("__h2", F.zip_with("__h", later("__h", 1), pair))
    d = d.withColumn("__h4", F.zip_with("__h2", later("__h2", 2), pair))
    d = d.withColumn("__h5", F.slice(F.zip_with("__h4", later("__h", 4), pair), 1, F.greatest(F.lit(0), n - 4)))
    some = F.size(F.array_distinct("__h5")) < F.size("__h5")
    placed = F.transform(F.sequence(F.lit(1), n - 4), lambda i: F.struct(F.array_join(F.slice("__w", i, 5), " ").alias("w"), i.alias("i")))
    d = d.withColumn("__s", F.when(some, F.array_sort(placed)))
    at = lambda k: F.get(F.col("__s"), k)["w"]
    same = lambda s, k: F.coalesce(s["w"] == at(k - 1), F.lit(False)) | F.coalesce(s["w"] == at(k + 1), F.lit(False))
    d = d.withColumn("__p", F.array_sort(F.transform(F.filter("__s", same), lambda s: s["i"])))
    gaps = F.zip_with("__p", F.slice(F.col("__p"), 2, F.size("__p")), lambda a, b: F.coalesce(F.least(b - a, F.lit(5)), F.lit(5)))
    repeated = F.coalesce(F.aggregate(gaps, F.lit(0), lambda a, x: a + x), F.lit(0))
    lines = F.filter(F.split("__t", "\n"), lambda x: F.length(without_space(x)) > 0)
    d = d.withColumn("__l", lines)
    long = lambda c: c.cast("long")
    q = F.struct(
        long(n).alias("n_words"),
        long(F.length(without_space(F.col("__t")))).alias("word_chars"),
        long(F.length("__t") - F.length(F.translate("__t", SYMBOLS, ""))).alias("n_symbols"),
        long(F.size("__l") - F.size(F.array_distinct("__l"))).alias("n_dup_lines"),
        long(repeated).alias("n_repeat_words"),
        long(F.size("__l")).alias("n_lines"),
        long(F.size(F.array_distinct("__h"))).alias("n_distinct"),
        long(F.length("__t") - F.length(F.regexp_replace("__t", r"\p{Lu}", ""))).alias("n_upper"),
        long(F.length("__t") - F.length(F.translate("__t", "!?", ""))).alias("n_shouts"),
    )
    return d.withColumn("__q", q).drop("__t", "__w", "__h", "__h2", "__h4", "__h5", "__s", "__p", "__l")


def failed(q):
    """The base rule: too few words, or over a fifth of them in repeated windows."""
    return (q["n_words"] < 10) | (100 * q["n_repeat_words"] > 20 * q["n_words"])


#: Name -> (votes bad when, votes good when), integer comparisons of the counts; else the rule abstains.
RULES = {
    "symbols": ("10 * n_symbols > n_words", "50 * n_symbols <= n_words"),
    "symbol_share": ("100 * n_symbols > 3 * word_chars", "100 * n_symbols <= word_chars"),
    "capitals": ("10 * n_upper > 4 * word_chars", "5 * n_upper <= word_chars"),
    "shouts": ("5 * n_shouts > 2 * n_words", "10 * n_shouts <= n_words"),
    "repeats": ("100 * n_repeat_words > 20 * n_words", "20 * n_repeat_words <= n_words"),
    "lines": ("n_dup_lines >= 2 and 10 * n_dup_lines > 3 * n_lines", "10 * n_dup_lines <= 3 * n_lines"),
    "variety": ("n_words >= 30 and 10 * n_distinct < n_words", "5 * n_distinct > 2 * n_words"),
    "word_length": ("word_chars > 25 * n_words or word_chars < 2 * n_words", "word_chars <= 14 * n_words and word_chars >= 3 * n_words"),
    "brief": ("n_words < 60", "n_words >= 150"),
}


def votes(q: str, rules: dict[str, tuple[str, str]] = RULES) -> list:
    """One column per rule: -1 bad, 1 good, 0 abstains. q: the name of the struct of counts."""
    import re

    field = lambda e: re.sub(r"\b([nw]\w*_\w+)\b", rf"{q}.\1", e)
    return [F.expr(f"CASE WHEN {field(bad)} THEN -1 WHEN {field(good)} THEN 1 ELSE 0 END").alias(f"v_{k}") for k, (bad, good) in rules.items()]


#: Classes of the model: good, a bad class for each rule, and one for bad texts that no rule dislikes.
GOOD = 0


def first_weights(patterns: dict[tuple, float]) -> dict[tuple, dict[int, float]]:
    """How each pattern (votes and a label: 1 good, 0 bad, None) is dealt to classes at first.

    A bad text belongs to the classes of the rules that dislike it, in equal parts. With labels of both
    kinds only labelled texts count; without, two bad votes make a text bad, and one half of it.
    """
    told = {p[-1] for p in patterns} >= {0, 1}
    out = {}
    for p in patterns:
        votes_, label = p[:-1], p[-1]
        disliked = [k + 1 for k, v in enumerate(votes_) if v == -1] or [len(votes_) + 1]
        if told and label is None:
            continue
        n = sum(v == -1 for v in votes_)
        good = float(label) if told else (1.0, 0.5)[n] if n < 2 else 0.0
        out[p] = {GOOD: good} | {k: (1 - good) / len(disliked) for k in disliked}
    return out


def posteriors(patterns: dict[tuple, float], rounds: int = ROUNDS) -> dict[tuple, float]:
    """P(good) of each vote pattern, by EM over patterns (votes and label -> number of texts)."""
    if not patterns:
        return {}
    n_rules = len(next(iter(patterns))) - 1
    classes = range(n_rules + 2)
    weights = first_weights(patterns)
    model: tuple | None = None
    for _ in range(rounds):
        size: dict = defaultdict(float)
        given: dict = defaultdict(float)
        for p, w in weights.items():
            for c, x in w.items():
                size[c] += patterns[p] * x
                for j in range(n_rules):
                    given[c, j, p[j]] += patterns[p] * x
        total = sum(size.values()) + SMOOTH * len(classes)
        share = {c: log((size[c] + SMOOTH) / total) for c in classes}
        rate = {(c, j, v): log((given[c, j, v] + SMOOTH) / (size[c] + 3 * SMOOTH)) for c in classes for j in range(n_rules) for v in (-1, 0, 1)}
        model = (share, rate)
        weights = {p: classified(model, p, [c for c in classes if p[-1] is None or (c == GOOD) == (p[-1] == 1)]) for p in patterns}
    return {v: classified(model, v, list(classes))[GOOD] for v in {p[:-1] for p in patterns}}


def classified(model: tuple, votes_: tuple, classes: list[int]) -> dict[int, float]:
    """The classes' probabilities, given votes."""
    share, rate = model
    fit = {c: share[c] + sum(rate[c, j, v] for j, v in enumerate(votes_[: (len(rate) // 3) // len(share)])) for c in classes}
    most = max(fit.values())
    raw = {c: exp(x - most) for c, x in fit.items()}
    total = sum(raw.values())
    return {c: x / total for c, x in raw.items()}


def text_digest(text_col: str = "text"):
    """128 bits of a text (null as empty): texts of one digest have one verdict."""
    return F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))


def judged(docs: DataFrame, labels: DataFrame | None, id_col: str, text_col: str, rules: dict, rounds: int) -> DataFrame:
    """One row per input row: doc_id, `__text` (text_digest), the struct q of counts, base_failed, posterior and kept.

    Estimates are made on distinct texts, so copies are no evidence.
    """
    own = ["doc_id", "__text"]
    d = docs.select(F.col(id_col).alias("doc_id"), text_digest(text_col).alias("__text"), F.col(text_col).alias("text"))
    rows = materialise(signals(d).select(*own, "__q.*"), "signals")
    names = [f"v_{k}" for k in rules]
    held = rows.select(*own, F.struct(*[c for c in rows.columns if c not in own]).alias("q")).select("*", *votes("q", rules))
    seen = held.select("doc_id", "__text", *names)
    if labels is None:
        seen = seen.withColumn("label", F.lit(None).cast("int"))
    else:
        told = labels.groupBy(F.col("doc_id").alias("__id")).agg(F.min("quality").cast("int").alias("label"))
        seen = seen.join(told, seen["doc_id"] == told["__id"], "left")
    found = seen.select("__text", *names, "label").distinct().groupBy(*names, "label").agg(F.count("*").cast("double").alias("n")).collect()
    post = posteriors({tuple(r[:-1]): r["n"] for r in found}, rounds)
    #: At most 3**rules rows: which votes are given together.
    table = held.sparkSession.createDataFrame([(*p, x) for p, x in post.items()], ", ".join(f"{k} int" for k in names) + ", posterior double")
    out = held.join(F.broadcast(table), names)
    base = failed({c: F.col(f"q.{c}") for c in ("n_words", "n_repeat_words")})
    return out.select(*own, "q", base.alias("base_failed"), F.round("posterior", 6).alias("posterior"), (~base & (F.col("posterior") >= THRESHOLD)).alias("kept"))


def assess(docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", rules: dict = RULES, rounds: int = ROUNDS) -> DataFrame:
    """One row per input row: doc_id, the counts, base_failed, posterior (of being good) and kept.

    labels: doc_id, quality (1 good, 0 bad) of some texts; of an id that is labelled twice the worse
    label counts. Null and empty texts have no words and fail the base rule. Rows that repeat an id
    or have none each get their own verdict (a label without an id counts for none). Other input
    columns are ignored. Texts that fail the base rule take part in the estimates like all others. An
    empty table gives no rows.
    """
    out = judged(docs, labels, id_col, text_col, rules, rounds)
    counts = [F.col(f"q.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return out.select("doc_id", *counts, "base_failed", "posterior", "kept")


def good_rows(docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and `__text` (text_digest) of the rows that assess keeps."""
    return judged(docs, labels, id_col, text_col, RULES, ROUNDS).filter("kept").select("doc_id", "__text")
