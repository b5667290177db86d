"""Taggers and parsers as a protocol.

An annotator gets sentences in batches on the executors and returns annotated text for
each. A batch that fails is tried again in small parts, then one by one; sentences that
still fail come back with their error instead of ending the job.
"""

from __future__ import annotations

import re
import subprocess
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text

#: From a list of unparsed sentences (CoNLL-U blocks, or tokens by line) to one text each.
Annotator = Callable[[list[str]], list[str]]
SMALL = 10


def annotate(sentences: DataFrame, annotator: Annotator, batch: int = 10_000, key: str = "item_id", source: str = "block") -> DataFrame:
    """item_id, block, error."""

    def tried(texts: list[str]) -> list[tuple[str | None, str | None]]:
        try:
            got = annotator(texts)
            if len(got) != len(texts):
                raise ValueError(f"{len(got)} results for {len(texts)} sentences")
            return [(g, None) for g in got]
        except Exception as e:
            if len(texts) == 1:
                return [(None, f"{type(e).__name__}: {e}")]
            step = SMALL if len(texts) > SMALL else 1
            return [x for at in range(0, len(texts), step) for x in tried(texts[at : at + step])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), batch):
                part = b.iloc[at : at + batch]
                got = tried(list(part[source]))
                yield pd.DataFrame({key: part[key], "block": [g for g, _ in got], "error": [e for _, e in got]})

    return sentences.select(key, source).mapInPandas(run, f"{key} string, block string, error string")


def process_annotator(command: list[str]) -> Annotator:
    """Runs a tagger that reads a token or `<s_N>` mark per line and writes `word TAB pos TAB lemma` lines and the marks."""

    def run(texts: list[str]) -> list[str]:
        given = "".join(f"<s_{k}>\n" + re.sub(" +", "\n", t.strip()) + "\n" for k, t in enumerate(texts))
        out = subprocess.run(command, input=given, capture_output=True, text=True, check=True).stdout
        parts = re.split(r"<s_(\d+)>\n?", out)
        found = dict(zip(map(int, parts[1::2]), parts[2::2], strict=True))
        return [found.get(k, "").strip("\n") for k in range(len(texts))]

    return run


def http_annotator(url: str, model: str, timeout: float = 300.0) -> Annotator:
    """Sends CoNLL-U sentences to a parsing service in one request, as a form with model, input, tagger, parser and data; the answer is JSON with the parsed text as `result`."""

    def run(texts: list[str]) -> list[str]:
        import json
        import urllib.parse
        import urllib.request

        form = {"model": model, "input": "conllu", "tagger": "", "parser": "", "data": "\n\n".join(t.strip("\n") for t in texts) + "\n\n"}
        with urllib.request.urlopen(url, urllib.parse.urlencode(form).encode(), timeout) as answer:  # other states than 200 raise
            result = json.load(answer).get("result") or ""
        return [x for x in re.split(r"\n[ \t\r]*\n\s*", result.strip("\n")) if x.strip()]

    return run


def offline(sentences: DataFrame, parsed: DataFrame, key: str = "item_id") -> DataFrame:
    """Annotations that exist already: sentences with parsed blocks of the same key, else null."""
    return sentences.select(key).join(parsed.select(key, "block"), key, "left")


def tagged_tokens(tagged: DataFrame, key: str = "item_id", source: str = "block") -> DataFrame:
    """item_id, w_nr, word, pos, lemma of tagger output; lines without three fields are left out before numbering."""
    lines = F.filter(F.transform(F.split(F.coalesce(source, F.lit("")), "\n"), lambda x: F.split(x, "\t")), lambda f: F.size(f) == 3)
    t = tagged.select(key, F.posexplode(lines).alias("k", "f"))
    return t.select(key, (F.col("k") + 1).alias("w_nr"), F.col("f")[0].alias("word"), F.col("f")[1].alias("pos"), text.plain_lemma(F.col("f")[2]).alias("lemma"))


def tagged_lines(tokens: DataFrame, language=None, key: str = "item_id") -> DataFrame:
    """item_id, utt_tagged: `word_POS=lemma` of all tokens in one line; with a language column, corrected."""
    one = text.tagged_line(F.col("word"), F.col("pos"), F.col("lemma"))
    t = tokens.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("w_nr", one.alias("l")))), lambda x: x["l"]), " ").alias("utt_tagged"))
    return t if language is None else t.withColumn("utt_tagged", text.fix_tagged(F.col("utt_tagged"), language))


def tagged_blocks(tokens: DataFrame, key: str = "item_id") -> DataFrame:
    """Parser input from tagged tokens: item_id, block; unknown or empty lemmas and tags are `_`, ids have no gaps."""
    from ..sources.conllu import from_tokens

    blank = lambda c: F.when(F.coalesce(c, F.lit("")).isin("", "<unknown>"), "_").otherwise(c)
    return from_tokens(tokens.withColumnRenamed("w_nr", "conll_id"), lemma=blank(F.col("lemma")), xpos=F.when(F.col("pos") == "", "_").otherwise(F.col("pos")))
