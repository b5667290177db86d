"""The token table: joins with annotations, links, blanking, and its light forms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..sources.conllu import fields_of

PLAIN = ["utt_id", "utt_nr", "w_nr", "speaker", "child_project", "language", "child_other", "age", "age_days", "time_code", "word", "utterance", "utt_clean"]
PARSED = ["utt_id", "utt_nr", "w_nr", "URLwww", "URLloc", *PLAIN[3:11], "lemma", "pos", "utterance", "utt_clean", "utt_tagged", *[f"conll_{k}" for k in range(1, 11)]]
LIGHT = [c for c in PARSED[:18] if c != "time_code"]


def finalise(
    tokens: DataFrame,
    conllu: DataFrame | None = None,
    tagged: DataFrame | None = None,
    tagged_text: DataFrame | None = None,
    links: DataFrame | None = None,
    pos_utterance: str | None = None,
    server_url: str = "",
    by_number: bool = False,
) -> DataFrame:
    """The parsed table: tokens with columns of the parse (item_id, conll_id, conll_1..10), the tagger
    (item_id, w_nr, pos, lemma), its line (item_id, utt_tagged) and page links (item_id, local, file).

    by_number joins the parse on w_nr, as the printed numbers have it; else on the token's number without empty ones.
    """
    out = tokens
    #: Texts of an utterance would go through each join once per token; they are put beside the tokens behind the others.
    apart = any(x is not None for x in (conllu, tagged, tagged_text, links))
    if apart:
        texts = [F.coalesce(c, F.lit("")).alias(c) for c in ("utterance", "utt_clean")]
        said = tokens.select(F.col("item_id").alias("__item"), *texts).distinct().withColumn("__text", F.xxhash64("utterance", "utt_clean"))
        out = tokens.withColumn("__said", F.xxhash64(*texts)).drop("utterance", "utt_clean")
    if conllu is not None:
        own = conllu.withColumnRenamed("conll_id", "__k")
        out = out.join(own, (out["item_id"] == own["item_id"]) & (out["w_nr" if by_number else "conll_id"] == own["__k"]), "left").drop(own["item_id"]).drop("__k")
    else:
        out = out.withColumns({f"conll_{k}": F.lit("") for k in range(1, 11)})
    if tagged is not None:
        out = out.join(tagged.select("item_id", "w_nr", "pos", "lemma"), ["item_id", "w_nr"], "left")
        out = out.withColumn("pos", F.coalesce("pos", F.lit("_"))).withColumn("lemma", F.coalesce("lemma", F.lit("_")))
    else:
        blank = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("_"))
        out = out.withColumn("pos", blank(F.col("conll_4"))).withColumn("lemma", blank(F.col("conll_3")))
    if tagged_text is not None:
        own = tagged_text.withColumnRenamed("item_id", "__k")
        said = said.join(own, said["__item"] == own["__k"], "left").drop("__k")
    if links is not None:
        own = links.select(F.col("item_id").alias("__k"), F.col("local").alias("__local"), F.col("file").alias("__file"))
        said = said.join(own, said["__item"] == own["__k"], "left")
        at = F.concat(F.lit("#"), "__item")
        said = said.withColumn("URLloc", F.coalesce(text.hyperlink(F.concat(F.lit("http://localhost/"), "__local", at), "LOC"), F.lit("")))
        said = said.withColumn("URLwww", F.coalesce(text.hyperlink(F.concat(F.lit(server_url.rstrip("/") + "/"), "__file", at), "WWW"), F.lit("")) if server_url else F.lit("")).drop("__k", "__local", "__file")
    if apart:
        out = out.join(said, out["item_id"].eqNullSafe(said["__item"]) & (out["__said"] == said["__text"]), "left")
    out = out.withColumns({c: F.lit("") for c, given in (("utt_tagged", tagged_text), ("URLloc", links), ("URLwww", links)) if given is None})
    for c in ("utterance", "utt_clean", "utt_tagged"):
        out = out.withColumn(c, text.blank_unless(F.coalesce(c, F.lit("")), F.col("pos"), pos_utterance))
    return out.select(*PARSED, *[c for c in ("item_id",) if c in out.columns])


def of_graphs(rows: DataFrame, attributes: list[str]) -> DataFrame:
    """The parsed and coded table from rows of tokens with their node n and codings (coding.coded_tokens), without a join.

    Columns of PARSED that rows have stay, others are empty; lemma and tag are those of the parse.
    """
    n = F.col("n")
    fields = {f"conll_{k + 1}": c for k, c in enumerate(fields_of(n))}
    own = {"w_nr": n["pos"], "word": n["form"], "lemma": fields["conll_3"], "pos": fields["conll_4"]} | fields
    return rows.select(*[F.col(c) if c in rows.columns else own.get(c, F.lit("")).alias(c) for c in PARSED], "item_id", *attributes)


def light(table: DataFrame, pos_output: str = ".*") -> DataFrame:
    """The light columns of rows whose part of speech matches anywhere."""
    return table.filter(F.coalesce("pos", F.lit("")).rlike(pos_output)).select(*LIGHT)


def light_coded(table: DataFrame, pos: str = "^(VER|VV)", upos: str = "VERB", strict_positional: bool = False) -> DataFrame:
    """Verb rows of the coded table, fewer columns, codings without details.

    strict_positional filters by the 12th and 21st column, as older scripts do, instead of by name.
    """
    c = table.columns
    a, b = (c[11], c[20]) if strict_positional else ("pos", "conll_4")
    kept = table.filter(F.coalesce(F.col(a).cast("string"), F.lit("")).rlike(pos) | F.coalesce(F.col(b).cast("string"), F.lit("")).rlike(upos))
    places = [*range(0, 4), *range(5, 10), *range(11, 15), 19, *range(27, len(c))]
    names = [c[k] for k in places] if strict_positional else [n for n in c if n not in ("URLloc", "time_code", "utterance", "utt_clean", "utt_tagged", "item_id") and not (n.startswith("conll_") and n not in ("conll_4", "conll_10"))]
    return kept.select(*[text.without_details(F.col(n).cast("string")).alias(n) for n in names])


def concatenated(tables: list[DataFrame]) -> DataFrame:
    """Tables below each other; missing columns are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


#: Keys are dealt into so many groups for `first_rows`, whose bounds are broadcast.
GROUPS = 4096


def first_rows(tokens: DataFrame, key: str = "item_id", order: str = "w_nr") -> DataFrame:
    """The first row of each utterance.

    Whole rows are sorted by key; before that go those that come behind every first row of their group of keys,
    which is most of them where utterances start alike. Rows without an order stay, in case a key has no others.
    """
    values = [c for c in tokens.columns if c != key]
    group = F.pmod(F.xxhash64(key), F.lit(GROUPS))
    first = tokens.groupBy(key).agg(F.min(order).alias("__min"))
    bounds = first.groupBy(group.alias("__of")).agg(F.max("__min").alias("__last"))
    near = tokens.join(F.broadcast(bounds), (group == F.col("__of")) & (F.col(order).isNull() | (F.col(order) <= F.col("__last"))), "left_semi")
    return near.groupBy(key).agg(F.min_by(F.struct(*values), order).alias("r")).select(key, "r.*")
