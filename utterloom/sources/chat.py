"""Transcripts in CHAT format: files -> sessions -> utterances -> tokens.

One row per file is split by generators and projections; only the running number of
utterances needs a window, over the utterances of one file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text

#: The header lines in front of a session, and a main tier with its continuation and dependent lines.
HEADER = r"^((?:(?:@|\t)[^\n]*\n)*)"
BLOCK = r"(\*[^\n]*(?:\n(?![*@])[^\n]*)*)"
#: Fixed value: an age that is known to be wrong, and the right one.
WRONG_AGE, RIGHT_AGE = "24;00.02", "2;00.02"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """file, content: one row per file; gzip by extension."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("content"))


def sessions(files: DataFrame) -> DataFrame:
    """file, session, header, body: blocks that end with @End; the header is the lines in front that begin with @ or a tab."""
    parts = F.filter(F.split("content", "(?<=@End)"), lambda x: F.length(x) > 0)
    out = files.select("file", F.posexplode(parts).alias("session", "block"))
    start = F.regexp_replace("block", r"(?U)^\s+", "")
    out = out.select("file", "session", start.alias("block"))
    header = F.regexp_extract("block", HEADER, 1)
    return out.select("file", "session", header.alias("header"), F.substring(F.col("block"), F.length(header) + 1, F.length("block")).alias("body"))


def parsed_header(h: Column) -> dict[str, Column]:
    """Columns of a header text: pid (null if none), language, project, names (code -> name), children (array of structs)."""
    project = F.regexp_extract(h, r"@ID:\s+(.*?)\|(.*?)\|", 2)
    pid = F.nullif(F.regexp_extract(h, r"@PID:.*?-(\d+)", 1), F.lit(""))
    line = F.regexp_extract(F.regexp_replace(h, "\n\t", " "), r"@Participants:\s+([^\n]*)", 1)
    people = F.filter(F.transform(F.split(line, ","), lambda p: F.split(F.regexp_replace(p, r"(?U)^\s+|\s+$", ""), r"(?U)\s+")), lambda t: F.size(t) >= 2)
    names = F.transform(people, lambda t: F.struct(F.get(t, F.lit(0)).alias("code"), F.get(t, F.lit(1)).alias("name")))
    ids = F.transform(F.regexp_extract_all(h, F.lit(r"@ID:\s+([^\n]*)"), F.lit(1)), lambda x: F.split(F.regexp_replace(x, r"(?U)\s+$", ""), r"\|"))
    target = F.filter(ids, lambda f: (F.size(f) > 7) & (F.get(f, F.lit(7)) == "Target_Child"))
    return {"pid": F.regexp_replace(pid, "^0+", ""), "language": F.regexp_extract(h, r"@ID:\s+(.*?)\|(.*?)\|", 1), "project": project, "names": names, "target": target}


def with_header(s: DataFrame) -> DataFrame:
    """sessions with pid, language, project, names and children (code, full_id, age, age_days), in the order of the @ID lines."""
    out = s.select("*", *[c.alias(k) for k, c in parsed_header(F.col("header")).items()])

    def name_of(code: Column) -> Column:
        #: Of a code named twice the last name counts.
        return F.element_at(F.filter("names", lambda n: n["code"] == code)["name"], -1)

    tail = F.concat(F.lit("_"), F.substring("project", 1, 3))

    def child(f: Column) -> Column:
        code = F.get(f, F.lit(2))
        age = F.when(F.get(f, F.lit(3)) == WRONG_AGE, RIGHT_AGE).otherwise(F.get(f, F.lit(3)))
        name = F.replace(F.translate(F.coalesce(F.try_element_at(F.filter("names", lambda n: n["code"] == code), F.lit(-1))["name"], code), "éè", "ee"), F.lit("Sullyvan"), F.lit("Sullivan"))
        return F.struct(code.alias("code"), F.concat(name, tail).alias("full_id"), age.alias("age"), text.age_days(age).alias("age_days"))

    found = F.transform("target", child)
    #: A code that comes twice keeps its first place and takes the last values.
    found = F.transform(F.array_distinct(F.transform(found, lambda c: c["code"])), lambda k: F.element_at(F.filter(found, lambda c: c["code"] == k), -1))
    chi = F.try_element_at(F.filter("names", lambda n: n["code"] == "CHI"), F.lit(-1))["name"]
    fallback = F.array(F.struct(F.lit("CHI").alias("code"), F.concat(F.coalesce(chi, F.lit("NN")), tail).alias("full_id"), F.lit("").alias("age"), F.lit(0).alias("age_days")))
    return out.withColumn("children", F.when(F.size(found) > 0, found).otherwise(fallback)).drop("target")


def utterances(s: DataFrame) -> DataFrame:
    """One row per main tier: file, session, block, speaker, utterance, time_code and the header's columns, with utt_nr and utt_id.

    Numbers run on over sessions while the PID stays, also where a session has none, and start
    anew when it changes.
    """
    s = with_header(s)
    u = s.select("*", F.posexplode(F.regexp_extract_all("body", F.lit(BLOCK), F.lit(1))).alias("block", "raw")).drop("body", "header")
    u = u.withColumn("raw", F.regexp_replace("raw", r"(?U)\n\s+", " "))
    u = u.withColumn("time_code", F.regexp_extract("raw", "\x15(\\d+_\\d+)\x15", 1))
    bare = F.regexp_replace(F.regexp_replace("raw", "(?U)\\s*\x15[^\n]*?\x15", ""), r"(?U)^\s+|\s+$", "")
    main = r"(?dU)^\*([A-Z0-9]+):\s+(.*)"
    u = u.withColumn("speaker", F.regexp_extract(bare, main, 1)).withColumn("utterance", F.regexp_replace(F.regexp_extract(bare, main, 2), r"(?U)\s+$", ""))
    u = u.filter("speaker <> ''").drop("raw")
    return numbered(u)


def numbered(u: DataFrame, order: tuple[str, ...] = ("session", "block"), part: tuple[str, ...] = ("file",)) -> DataFrame:
    """Adds pid carried on, utt_nr and utt_id; needs file, pid, and the columns of order."""
    line = Window.partitionBy(*part).orderBy(*order)
    u = u.withColumn("pid", F.coalesce(F.last("pid", ignorenulls=True).over(line), F.lit("")))
    changed = F.coalesce((F.col("pid") != F.lag("pid").over(line)).cast("int"), F.lit(0))
    u = u.withColumn("__run", F.sum(changed).over(line))
    u = u.withColumn("utt_nr", F.row_number().over(Window.partitionBy(*part, "__run").orderBy(*order))).drop("__run")
    return u.withColumn("utt_id", F.concat("pid", F.lit("_u"), F.col("utt_nr").cast("string")))


def speaker_columns(speaker: Column, children: Column) -> dict[str, Column]:
    """child_project, child_other (C or X), age and age_days of an utterance: the speaking child's, else the first child's."""
    own = F.filter(children, lambda c: c["code"] == speaker)
    is_child = F.size(own) > 0
    who = F.when(is_child, F.get(own, F.lit(0))).otherwise(F.get(children, F.lit(0)))
    return {
        "child_project": who["full_id"],
        "child_other": F.when(is_child, "C").otherwise("X"),
        "age": F.when(is_child, who["age"]).otherwise(F.lit("")),
        "age_days": who["age_days"],
    }


def tokens(u: DataFrame, utt_clean: bool = False) -> DataFrame:
    """One row per token with the base columns, and conll_id: its number among the utterance's non-empty tokens."""
    u = u.withColumn("__clean", text.clean(F.col("utterance")))
    who = speaker_columns(F.col("speaker"), F.col("children"))
    listed = text.words(text.tokenise(F.col("__clean"), F.col("language")))
    u = u.select("file", "session", "utt_id", "utt_nr", "speaker", *[c.alias(k) for k, c in who.items()], "language", "time_code", "utterance", F.when(F.lit(utt_clean), F.col("__clean")).otherwise(F.lit("")).alias("utt_clean"), F.posexplode(listed).alias("k", "w"))
    return u.select(
        F.concat("utt_id", F.lit("_w"), F.col("w.w_nr").cast("string")).alias("utt_id"), "utt_nr", F.col("w.w_nr").alias("w_nr"),
        "speaker", "child_project", "language", "child_other", "age", "age_days", "time_code", F.col("w.word").alias("word"), "utterance", "utt_clean",
        F.col("utt_id").alias("item_id"), (F.col("k") + 1).alias("conll_id"), "file",
    )


def read_chat(spark: SparkSession, path: str, utt_clean: bool = False) -> DataFrame:
    """The token table of CHAT files."""
    return tokens(utterances(sessions(read_files(spark, path))), utt_clean)
