"""CoNLL-U: files and text columns to sentence graphs, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.plan import let, once

SEPARATOR = r"\n[ \t\r]*\n\s*"
ENTRIES = "array<struct<k:string,v:string>>"


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """file, block_nr, block: blank lines (also with spaces) part sentences; a missing last line end is fine.

    Files are read whole. For well-formed files larger than memory use read_large.
    """
    f = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    parts = F.filter(F.split("value", SEPARATOR), lambda x: F.length(F.trim(x)) > 0)
    return f.select("file", F.posexplode(parts).alias("block_nr", "block"))


def read_large(spark: SparkSession, path: str) -> DataFrame:
    """file, block: sentences parted by exactly one empty line; files are split among tasks."""
    return spark.read.option("lineSep", "\n\n").text(path).filter(F.length(F.trim("value")) > 0).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("block"))


def pairs(c: Column) -> Column:
    """`A=B|C` as a map; `_` and empty give an empty map; a key without a value has an empty one; of repeated keys the last counts."""
    parts = F.filter(F.split(c, r"\|"), lambda x: x != "")
    value = lambda x: F.when(F.instr(x, "=") > 0, F.substring(x, F.instr(x, "=") + 1, F.length(x))).otherwise(F.lit(""))
    key = lambda x: F.substring_index(x, "=", 1)
    keyed = F.transform(parts, lambda x: F.struct(key(x).alias("k"), value(x).alias("v")))
    none = F.map_from_entries(F.array().cast(ENTRIES))
    return F.when((c == "_") | (c == ""), none).when(F.instr(c, "|") == 0, F.create_map(key(c), value(c))).otherwise(let(keyed, last_entries))


def last_entries(kv: Column) -> Column:
    """A map of (k, v) structs; of repeated keys the last counts."""
    keys = F.array_distinct(F.transform(kv, lambda p: p["k"]))
    last = F.transform(keys, lambda k: F.struct(k.alias("k"), F.element_at(F.filter(kv, lambda p: p["k"] == k), -1)["v"].alias("v")))
    return F.map_from_entries(F.when(F.size(keys) == F.size(kv), kv).otherwise(last))


def parsed(block: Column) -> tuple[Column, Column]:
    """(meta, nodes) of a sentence block. Positions number the tokens with whole ids; other lines have position 0 and no head."""
    lines = F.filter(F.split(block, "\r?\n"), lambda x: F.trim(x) != "")
    heads = F.filter(lines, lambda x: x.startswith("#") & x.rlike(r"^#[^=]*="))
    kv = F.transform(heads, lambda x: F.struct(F.trim(F.regexp_extract(x, r"^#\s*([^=]*)=", 1)).alias("k"), F.trim(F.regexp_extract(x, r"^#[^=]*=(.*)$", 1)).alias("v")))
    meta = let(kv, last_entries)
    rows = F.filter(F.transform(F.filter(lines, lambda x: ~x.startswith("#")), lambda x: F.split(x, "\t")), lambda f: F.size(f) == 10)
    at = lambda f, k: F.get(f, F.lit(k))

    def node(f: Column) -> Column:
        whole = at(f, 0).rlike(r"^\d+$")
        return F.struct(
            at(f, 0).alias("id"), F.when(whole, at(f, 0).cast("int")).otherwise(F.lit(0)).alias("pos"), at(f, 1).alias("form"), at(f, 2).alias("lemma"), at(f, 3).alias("upos"), at(f, 4).alias("xpos"),
            pairs(at(f, 5)).alias("feats"), F.when(at(f, 6).rlike(r"^\d+$"), at(f, 6).cast("int")).alias("head"), at(f, 7).alias("deprel"), at(f, 8).alias("deps"), pairs(at(f, 9)).alias("misc"),
        )

    return meta, F.transform(rows, node)


def graphs(blocks: DataFrame, block: str = "block") -> DataFrame:
    """blocks with meta, item_id, nodes (tokens with whole ids, in order of id, so that nodes[k].pos = k + 1) and others (ranges, empty nodes)."""
    meta, nodes = parsed(F.col(block))
    out = blocks.withColumn("meta", meta).withColumn("__n", once(nodes))
    out = out.withColumn("nodes", once(F.array_sort(F.filter("__n", lambda n: n["pos"] > 0), lambda a, b: a["pos"] - b["pos"]))).withColumn("others", F.filter("__n", lambda n: n["pos"] == 0))
    return out.withColumn("item_id", F.try_element_at("meta", F.lit("item_id"))).drop("__n", block)


def read_conllu(spark: SparkSession, path: str) -> DataFrame:
    return graphs(read_blocks(spark, path))


def joined_pairs(m: Column) -> Column:
    """A map as `A=B|C=D`, `_` for none."""
    text = F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|")
    return F.when(m.isNull() | (F.size(m) == 0), "_").otherwise(text)


def fields_of(n: Column) -> list[Column]:
    """The ten fields of a node, as text."""
    blank = lambda c: F.when((c == "") | c.isNull(), "_").otherwise(c)
    head = F.coalesce(n["head"].cast("string"), F.lit("_"))
    return [n["id"], *[blank(n[c]) for c in ("form", "lemma", "upos", "xpos")], joined_pairs(n["feats"]), head, blank(n["deprel"]), blank(n["deps"]), joined_pairs(n["misc"])]


def line_of(n: Column) -> Column:
    """A node as a line."""
    return F.concat_ws("\t", *fields_of(n))


def block_of(meta: Column, nodes: Column) -> Column:
    """A sentence as text, without the empty line behind it."""
    head = F.transform(F.map_entries(meta), lambda e: F.concat(F.lit("# "), e["key"], F.lit(" = "), e["value"]))
    return F.array_join(F.concat(head, F.transform(nodes, line_of)), "\n")


def to_blocks(g: DataFrame) -> DataFrame:
    """block: the text of each graph, ranges and empty nodes in their places (a range before its first token, an empty node behind its token)."""
    key = lambda n: F.struct(F.regexp_extract(n["id"], r"^\d+", 0).cast("int").alias("a"), F.when(F.instr(n["id"], ".") > 0, 1).otherwise(0).alias("b"), F.when(F.instr(n["id"], "-") > 0, 0).otherwise(1).alias("c"), F.coalesce(F.nullif(F.regexp_extract(n["id"], r"\.(\d+)", 1), F.lit("")).cast("int"), F.lit(0)).alias("d"))
    rest = F.col("others") if "others" in g.columns else F.array().cast(g.schema["nodes"].dataType)
    every = F.transform(F.array_sort(F.transform(F.concat("nodes", rest), lambda n: F.struct(key(n).alias("k"), n["id"].alias("i"), line_of(n).alias("l")))), lambda x: x["l"])
    #: Most sentences have the tokens 1, 2, 3 and so on, and nothing else: their places need not be sorted out.
    plain = F.forall(F.transform("nodes", lambda n, k: n["id"] == (k + 1).cast("string")), lambda x: x)
    every = F.when(plain & (F.size(rest) == 0) if "others" in g.columns else plain, F.transform("nodes", line_of)).otherwise(every)
    head = F.transform(F.map_entries("meta"), lambda e: F.concat(F.lit("# "), e["key"], F.lit(" = "), e["value"]))
    return g.withColumn("block", F.array_join(F.concat(head, every), "\n"))


def write_conllu(g: DataFrame, path: str, mode: str = "error", compression: str | None = None) -> None:
    """Sentences parted by an empty line."""
    w = to_blocks(g).select(F.concat("block", F.lit("\n")).alias("value")).write.mode(mode)
    (w.option("compression", compression) if compression else w).text(path)


def from_tokens(tokens: DataFrame, lemma: Column | None = None, xpos: Column | None = None) -> DataFrame:
    """Unparsed sentences from token rows (item_id, conll_id, word): item_id, block."""
    row = F.concat_ws("\t", F.col("conll_id").cast("string"), "word", lemma if lemma is not None else F.lit("_"), F.lit("_"), xpos if xpos is not None else F.lit("_"), *[F.lit("_")] * 5)
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("conll_id", row.alias("l")))), lambda x: x["l"]), "\n")
    return tokens.groupBy("item_id").agg(lines.alias("l")).select("item_id", F.concat(F.lit("# item_id = "), "item_id", F.lit("\n"), "l").alias("block"))


def token_rows(g: DataFrame) -> DataFrame:
    """One row per token with whole id: item_id, conll_id, conll_1 .. conll_10 as text."""
    n = g.select("item_id", F.explode("nodes").alias("n"))
    return n.select("item_id", F.col("n.pos").alias("conll_id"), *[c.alias(f"conll_{k + 1}") for k, c in enumerate(fields_of(F.col("n")))])
