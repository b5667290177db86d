"""Text of utterances: cleaning of transcript marks and language-specific tokenising, as column expressions.

Patterns run as Java regular expressions. `(?dU)` makes classes Unicode-aware and lets only
line feeds end lines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

UNICODE = "(?dU)"

#: The ordered replacements that remove transcript marks (name, pattern, replacement).
CLEAN_STEPS: list[tuple[str, str, str]] = [
    ("zero_word", r" 0([\S+])", " $1"),
    ("zero_verb", r"0(faire|ne) ", "\x01 "),
    ("liaison", r"&=li ", " "),
    ("retracing", r"<[^>]+> \[//?\] ", ""),
    ("stress", r"\[\!\] ?", " "),
    ("pause", r" ?\(\.+\) ", " "),
    ("commented", r"<([^>]+)>\s+\[%[^\]]+\]", "$1"),
    ("unclear_group", r"<(0|www|xxx|yyy)[^>]+> ?", ""),
    ("linker", r"\+[<,]? ?", ""),
    ("unclear_word", r"(0|www|xxx|yyy)\s", ""),
    ("brackets", r"\[.*?\] ?", ""),
    ("completion", r"\(([A-Za-z]+)\)", "$1"),
    ("interruption", r" \+/+", " "),
    ("joiner", r"[_=]", " "),
    ("word_form", r"@[a-z:0-9]+", ""),
    ("fragment", r"&[\S]+", ""),
    ("angles", r"[<>]", ""),
    ("spaces", r"\s+", " "),
    ("ends", r"^\s+|\s+$", ""),
]


def replaced(c: Column, pattern: str, replacement: str) -> Column:
    return F.regexp_replace(c, UNICODE + pattern, replacement)


def clean_step(c: Column, name: str) -> Column:
    """One step alone."""
    pattern, replacement = next((p, r) for n, p, r in CLEAN_STEPS if n == name)
    return replaced(c, pattern, replacement)


def clean(c: Column, skip: tuple[str, ...] = ()) -> Column:
    """All steps in order."""
    for name, pattern, replacement in CLEAN_STEPS:
        if name not in skip:
            c = replaced(c, pattern, replacement)
    return c


#: Replacements of each language's tokeniser.
OPENING, CLOSING = r"""([\|\{\(\/\´\`"»«°<])""", r"""([\]\|\}\/\`\"\),\;\:\!\?\.\%»«>])(?=\s|$)"""
FRENCH = [
    (r"([dcjlmnstDCJLNMST]'|[Qq]u'|[Jj]usqu'|[Ll]orsqu')", "$1 "),
    (OPENING, "$1 "),
    (CLOSING, " $1"),
    (r"(-t-elles?|-t-ils?|-t-on|-ce|-elles?|-ils?|-je|-la|-les?|-leur|-lui|-mêmes?|-m'|-moi|-nous|-on|-toi|-tu|-t'|-vous|-en|-y|-ci|-là)", " $1"),
    (r"\s+", " "),
]
ITALIAN = [(OPENING, "$1 "), (CLOSING, " $1"), (r"([a-zA-Z]+')(?=[a-zA-Zà-úÀ-Ú])", "$1 "), (r"\s+", " ")]
ENGLISH = [(r"n't", " n't"), (r"I'm", "I 'm"), (r"(\S)'(s|ve|ll|d|re)", "$1 '$2")]
GERMAN: list[tuple[str, str]] = []
DEFAULT = [(r"([,;?.!])(?=\s|$)", " $1"), (r"\s+", " ")]


def _steps(steps: list[tuple[str, str]]) -> Callable[[Column], Column]:
    def run(c: Column) -> Column:
        for pattern, replacement in steps:
            c = replaced(c, pattern, replacement)
        return c

    return run


#: (pattern that the language matches, tokeniser), in order; the first hit serves.
TOKENISERS: list[tuple[str, Callable[[Column], Column]]] = [
    ("fra|french", _steps(FRENCH)),
    ("ita|italian", _steps(ITALIAN)),
    ("eng|english", _steps(ENGLISH)),
    ("deu|german", _steps(GERMAN)),
]
default_tokeniser = _steps(DEFAULT)


def register_tokeniser(language_pattern: str, tokeniser: Callable[[Column], Column], first: bool = False) -> None:
    """Adds a language: a function from a text column to a column with tokens parted by spaces."""
    TOKENISERS.insert(0 if first else len(TOKENISERS), (language_pattern, tokeniser))


def tokenise(c: Column, language: Column | str) -> Column:
    """Tokens parted by single spaces. language: a column, or a name known when the plan is made."""
    if isinstance(language, str):
        import re

        return next((f for p, f in TOKENISERS if re.search(p, language)), default_tokeniser)(c)
    out = None
    for pattern, f in TOKENISERS:
        hit = F.coalesce(language.rlike(pattern), F.lit(False))
        out = F.when(hit, f(c)) if out is None else out.when(hit, f(c))
    return default_tokeniser(c) if out is None else out.otherwise(default_tokeniser(c))


def words(tokenised: Column) -> Column:
    """array<struct<w_nr, word>>: numbers count empty tokens, which are left out."""
    numbered = F.transform(F.split(tokenised, " "), lambda w, i: F.struct((i + 1).alias("w_nr"), w.alias("word")))
    return F.filter(numbered, lambda x: x["word"] != "")


#: Corrections of a French tagger's one-line output (`word_POS=lemma ...`).
TAGGER_FIXES = [
    (r"([,\?])_NAM=<unknown>", "$1_PON=,"),
    (r"Marie_VER:pres=marier", "Marie_NAM=Marie"),
    (r"( allez[^_ ]*)_([^= ]+)=<unknown>", " $1_VER:impe=NEWLEM:aller"),
    (r"( attend[^_ ]*)_([^= ]+)=<unknown>", " $1_VER=NEWLEM:attendre"),
    (r"( dis[^_ ]*)_([^= ]+)=<unknown>", " $1_VER=NEWLEM:dire"),
    (r"( enl.v.[^_ ]*)_([^= ]+)=<unknown>", " $1_VER=NEWLEM:enlever"),
    (r"( fai[^_ ]*)_([^= ]+)=<unknown>", " $1_VER=NEWLEM:faire"),
    (r"( fini[^_ ]*)_([^= ]+)=<unknown>", " $1_VER=NEWLEM:finir"),
    (r"( prend[^_ ]*)_([^= ]+)=<unknown>", " $1_VER=NEWLEM:prendre"),
    (r"( mett[^_ ]*)_([^= ]+)=<unknown>", " $1_VER=NEWLEM:mettre"),
    (r"( regard[^_ ]*)_([^= ]+)=<unknown>", " $1_VER=NEWLEM:regarder"),
    (r"( tomb[^_ ]*)_([^= ]+)=<unknown>", " $1_VER=NEWLEM:tomber"),
    (r"( vu[^_ ]*)_([^= ]+)=<unknown>", " $1_VER=NEWLEM:voir"),
    (r"( ![^_ ]*)_([^= ]+)=<unknown>", " !_PON=!"),
    (r"NEWLEM:", ""),
]


def fix_tagged(c: Column, language: Column) -> Column:
    """Corrects tagger errors in French one-line output; other languages stay."""
    out = c
    for pattern, replacement in TAGGER_FIXES:
        out = replaced(out, pattern, replacement)
    return F.when(F.coalesce(language.rlike("fra|french"), F.lit(False)), out).otherwise(c)


def plain_lemma(c: Column) -> Column:
    """The last word of a lemma of several words."""
    return replaced(c, ".*? ", "")


def tagged_line(word: Column, pos: Column, lemma: Column) -> Column:
    return F.concat(word, F.lit("_"), pos, F.lit("="), lemma)


def age_days(age: Column) -> Column:
    """Days of an age `Y;MM.DD`, whose later parts may be missing: 365 a year, 30.4 a month, truncated."""
    part = lambda p: F.coalesce(F.nullif(F.regexp_extract(F.coalesce(age, F.lit("")), p, 1), F.lit("")).cast("double"), F.lit(0.0))
    return (part(r"(\d+);") * 365 + part(r"\d+;(\d+)") * F.lit(30.4) + part(r"\d+;\d+\.(\d+)")).cast("int")


def hyperlink(url: Column, label: str) -> Column:
    """A spreadsheet formula."""
    return F.concat(F.lit('=HYPERLINK("'), url, F.lit(f'"; "{label}")'))


def escaped(c: Column) -> Column:
    """Angle brackets as entities (without the semicolon, as the pages have them)."""
    return F.replace(F.replace(c, F.lit("<"), F.lit("&lt")), F.lit(">"), F.lit("&gt"))


def blank_unless(c: Column, pos: Column, pattern: str | None) -> Column:
    """c where the part of speech matches (anywhere), else empty."""
    return c if pattern is None else F.when(F.coalesce(pos, F.lit("")).rlike(pattern), c).otherwise(F.lit(""))


def without_details(c: Column) -> Column:
    """Codings without `(node>head_lemma)`; `(node>0)` stays."""
    return F.regexp_replace(c, r"\(\d+>\d+_.*?\)", "")
