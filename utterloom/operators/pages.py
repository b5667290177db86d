"""Browsable HTML pages of sentences with their dependency trees."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.plan import let
from ..functions.text import escaped

STYLE = """
  :root { --ink: #22303c; --soft: #6b7c8c; --line: #d5dde3; --tint: #f4f8f6 }
  body { margin: 2rem auto; max-width: 62rem; color: var(--ink); font: 1rem/1.5 Georgia, serif }
  nav { display: flex; gap: 1.5rem; padding: .5rem 0; border-block: 1px solid var(--line) }
  section { margin: 1.8rem 0; scroll-margin-top: 1rem }
  h2 { margin: 0; font-size: .95rem; color: var(--soft) }
  .child { color: #8a3b12; font-weight: bold }
  blockquote { margin: .4rem 0; padding: .3rem 1rem; background: var(--tint) }
  pre { margin: 0; overflow-x: auto; font-size: .85rem }
  .lem { font-style: italic } .verb { text-decoration: underline } .cat { color: #1d6b52 } .tag { color: var(--soft) } .rel { color: #31509b }
"""


def depths(nodes: Column) -> Column:
    """Steps from each token to the root, as an array; on a circle of heads the number of tokens.

    Each round doubles the way that is looked up: every token takes over what the token at the end of
    its way knows, so a sentence of n tokens needs log2(n) rounds.
    """
    way = "array<struct<h:int,d:int>>"
    start = F.transform(nodes, lambda n: F.struct(F.coalesce(n["head"], F.lit(0)).alias("h"), F.when(n["head"] > 0, 1).otherwise(0).alias("d"))).cast(way)

    def longer(ways: Column, _: Column) -> Column:
        def one(w: Column) -> Column:
            return let(F.get(ways, w["h"] - 1), lambda then: F.when((w["h"] > 0) & then.isNotNull(), F.struct(then["h"].alias("h"), (w["d"] + then["d"]).alias("d"))).otherwise(w))

        return F.transform(ways, one).cast(way)

    rounds = F.ceil(F.log2(F.greatest(F.size(nodes), F.lit(2)))).cast("int")
    done = F.aggregate(F.sequence(F.lit(1), rounds), start, longer)
    return F.transform(done, lambda w: F.least(w["d"], F.size(nodes)))


def tree_lines(nodes: Column, html: bool = True) -> Column:
    """One line per token in order: number, a dot per two levels of depth, fields, relation and head."""

    def one(n: Column, deep: Column) -> Column:
        span = (lambda kind, c: F.concat(F.lit(f'<span class="{kind}">'), c, F.lit("</span>"))) if html else (lambda kind, c: c)
        lemma, xpos = F.coalesce(n["lemma"], F.lit("_")), F.coalesce(n["xpos"], F.lit("_"))
        upos = F.when(n["upos"].startswith("VER"), span("verb", n["upos"])).otherwise(span("cat", n["upos"]))
        form = F.concat(F.lit("<b>"), n["form"], F.lit("</b>")) if html else n["form"]
        dots = F.repeat(F.lit("."), deep * 4)
        return F.concat(F.lpad(n["id"], 2, "0"), dots, F.lit(" "), F.concat_ws(" ", form, span("lem", lemma), upos, span("tag", xpos), span("rel", n["deprel"])), F.lit("&#8594;" if html else "→"), F.coalesce(n["head"].cast("string"), F.lit("0")))

    return F.array_join(F.zip_with(nodes, depths(nodes), one), "\n")


#: Runs of keys for each shuffle partition, and keys drawn for each run.
RUNS, DRAWN = 32, 4


def in_runs(g: DataFrame, keys: list[str]) -> DataFrame:
    """Adds __run: runs of about equal length that follow each other in the order of keys; rows with the same key share one.

    The keys between runs are drawn once, so every use of the result sees the same runs.
    """
    spark = g.sparkSession
    count = RUNS * max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    key = F.struct(*[F.col(k) for k in keys])
    drawn = g.select(key.alias("k")).orderBy(F.rand(7)).limit(count * DRAWN).agg(F.array_sort(F.collect_list("k")).alias("__bounds"))
    found = drawn.first()[0]
    bounds = spark.createDataFrame([([found[k * len(found) // count] for k in range(1, count)] if found else [],)], drawn.schema)
    #: Halving: how many bounds are at most the key.
    at = F.aggregate(
        F.sequence(F.lit(1), F.lit(count.bit_length())), F.struct(F.lit(0).alias("lo"), F.size("__bounds").alias("hi")),
        lambda r, _: let(((r["lo"] + r["hi"]) / 2).cast("int"), lambda m: F.when(r["lo"] >= r["hi"], r).when(F.get(F.col("__bounds"), m) <= key, F.struct((m + 1).alias("lo"), r["hi"].alias("hi"))).otherwise(F.struct(r["lo"].alias("lo"), m.alias("hi")))),
    )["lo"]
    return g.crossJoin(F.broadcast(bounds)).withColumn("__run", at).drop("__bounds")


def numbered_pages(g: DataFrame, size: int, order: list[str], part: list[str]) -> DataFrame:
    """Adds page and pages: each file's (part's) sentences in runs of size.

    A part may be most of the table, so it is numbered in pieces; what lies before a piece is known from counts.
    """
    r = in_runs(g, [*part, *order])
    each = r.groupBy(*part, "__run").agg(F.count("*").alias("__n"))
    all_of = Window.partitionBy(*part)
    before = F.sum("__n").over(all_of.orderBy("__run").rowsBetween(Window.unboundedPreceding, -1))
    #: Only parts of several runs, so at most two rows for each run.
    several = each.withColumns({"__before": F.coalesce(before, F.lit(0)), "__all": F.sum("__n").over(all_of), "__runs": F.count("*").over(all_of)}).filter("__runs > 1")
    several = several.select(*[F.col(c).alias(f"__k{k}") for k, c in enumerate([*part, "__run"])], "__before", "__all")
    same = [r[c].eqNullSafe(several[f"__k{k}"]) for k, c in enumerate([*part, "__run"])]
    j = r.join(F.broadcast(several), reduce(lambda a, b: a & b, same), "left")
    line = Window.partitionBy(*part, "__run")
    n = F.row_number().over(line.orderBy(*order)) + F.coalesce("__before", F.lit(0))
    total = F.coalesce("__all", F.count("*").over(line))
    return j.withColumn("page", F.floor((n - 1) / size).cast("int")).withColumn("pages", F.ceil(total / size).cast("int")).select(*g.columns, "page", "pages")


def links(paged: DataFrame, directory: str, project: str = "project") -> DataFrame:
    """item_id, local, file: where each sentence is."""
    file = F.concat(F.substring(project, 1, 3), F.col("page").cast("string"), F.lit(".html"))
    return paged.select("item_id", F.concat(F.lit(directory.rstrip("/") + "/"), file).alias("local"), file.alias("file"))


def pages(paged: DataFrame, info: DataFrame, title: str, project: str = "project") -> DataFrame:
    """file, html: one row per page. paged: item_id, nodes, page, pages, project and an order column `n`; info: item_id, child_project, speaker, age, utterance.

    A page holds a bounded number of sentences, so its rows meet in one task.
    """
    j = paged.join(info.select("item_id", "child_project", "speaker", "age", "utterance"), "item_id", "left")
    c = lambda name, default: F.coalesce(F.col(name), F.lit(default))
    age = F.coalesce(F.nullif(F.col("age"), F.lit("")), F.lit("_"))
    who = F.when(F.col("speaker") == "CHI", F.concat(F.lit('<span class="child">CHI, '), age, F.lit("</span>"))).otherwise(c("speaker", "N/A"))
    body = F.concat(
        F.lit('<section id="'), "item_id", F.lit('">\n<h2>'), "item_id", F.lit(" &middot; "), c("child_project", "N/A"), F.lit(" &middot; "), who, F.lit("</h2>\n<blockquote>"),
        escaped(c("utterance", "[Utterance not found]")), F.lit("</blockquote>\n<pre>"), tree_lines(F.col("nodes")), F.lit("</pre>\n</section>\n"),
    )
    name = lambda k: F.concat(F.substring(project, 1, 3), k.cast("string"), F.lit(".html"))
    link = lambda k, label: F.concat(F.lit('<a href="'), name(k), F.lit(f'">{label}</a>'))
    p, last = F.col("page"), F.col("page") == F.col("pages") - 1
    nav = F.concat(
        F.lit("<nav>"), F.when(p > 0, link(p - 1, "back")).otherwise(F.lit("")), F.lit("<strong>"), F.col(project), F.lit(" "), (p + 1).cast("string"), F.lit(" of "),
        F.col("pages").cast("string"), F.lit("</strong>"), F.when(~last, link(p + 1, "on")).otherwise(F.lit("")), F.lit("</nav>\n"),
    )
    head = f'<!DOCTYPE html>\n<html lang="en">\n<meta charset="utf-8">\n<title>{title}</title>\n<style>{STYLE}</style>\n'
    rows = j.select(project, "page", nav.alias("nav"), F.struct("n", body.alias("b")).alias("s"))
    out = rows.groupBy(project, "page").agg(F.first("nav").alias("nav"), F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["b"]), "").alias("body"))
    return out.select(name(p).alias("file"), F.concat(F.lit(head), "nav", "body", "nav", F.lit("</html>\n")).alias("html"))


def write_pages(p: DataFrame, path: str, mode: str = "error") -> None:
    """One folder per page file."""
    p.select("file", F.col("html").alias("value")).repartition("file").write.mode(mode).partitionBy("file").text(path)
