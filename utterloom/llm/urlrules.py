"""URL filters: pattern rules indexed by their rarest literal token.

Every rule has literal tokens that any URL it fits must contain. It is filed
under the one that the fewest URLs of the table contain. The distinct tokens of
a URL fetch the rules filed under them; only those run their regular expressions,
one on the host and one on the path. Everything is built-in expressions.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .util import lower_ascii

TOKEN = r"[0-9A-Za-z]+"
#: The bound on what is broadcast.
MAX_RULES = 200_000


@dataclass(frozen=True)
class UrlRule:
    """host and path are regular expressions, searched in the host and in the path (fold: with A-Z lower-cased).

    tokens: lower-cased alphanumeric runs that every fitting URL has as whole tokens of host or path.
    rank: of the fitting rules the highest rank decides, then the smallest name.
    """

    name: str
    verdict: str
    host: str
    path: str
    tokens: tuple[str, ...]
    rank: int
    fold: bool = False


def host_rule(rule: str, verdict: str, base: int = 1_000_000) -> UrlRule:
    """A (host, path) rule such as `example.org/es/`: the host and its subdomains, paths that start with the path.

    The longest of these wins; they precede pattern rules. A path's last token counts as
    literal only if it ends before the path does, since the URL's path may go on.
    """
    host, slash, rest = rule.partition("/")
    path = slash + rest
    whole = re.findall(TOKEN, host) + re.findall(r"[0-9A-Za-z]+(?=[^0-9A-Za-z])", path)
    return UrlRule(rule, verdict, rf"(?s)^(?:.*\.)?{re.escape(host)}\z", rf"(?s)^{re.escape(path)}", tuple(dict.fromkeys(t.lower() for t in whole)), base + len(rule))


def in_order(words: tuple[str, ...]) -> str:
    """A pattern for texts that hold the words as whole tokens, in this order, with anything between."""
    if not words:
        return ""
    edge = "[^0-9a-z]"
    return rf"(?s)(?:^|{edge})" + rf"{edge}(?:.*{edge})?".join(words) + rf"(?:{edge}|\z)"


def word_rule(host: tuple[str, ...] = (), path: tuple[str, ...] = (), verdict: str = "block", rank: int = 1) -> UrlRule:
    """Fits when host and path hold these words (a-z, 0-9), in order, in any case. Its name is not reported as a host rule.

    The more words it has, the higher it ranks among such rules.
    """
    return UrlRule("~" + " ".join(host) + "/" + " ".join(path), verdict, in_order(host), in_order(path), tuple(dict.fromkeys(host + path)), rank + len(host) + len(path), True)


def url_parts(url):
    """(host, path) columns: host A-Z lower-cased; both empty without `://` or for null."""
    u = F.coalesce(url, F.lit(""))
    at = F.locate("://", u)
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    tail = F.substring(rest, F.length(host) + 1, F.length(rest))
    return lower_ascii(host), F.regexp_extract(tail, r"(?s)^[^?#]*", 0)


def judge(pages: DataFrame, rules: list[UrlRule], default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict, pattern_rule.

    A pattern sees the host or the path, never both as one text, so no character of a path can pass for a host.

    rule is the deciding host rule, else null; verdict is the deciding rule's, else default.
    Null and empty URLs have no tokens, hence the default. Rows that repeat an id are judged
    by their own URL. Other input columns are ignored. The rule list is a parameter on the
    driver; its size, not the table's, bounds what is broadcast (about 100 bytes a rule, MAX_RULES at most).
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    spark = pages.sparkSession
    host, path = url_parts(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    tokens = F.array_distinct(F.regexp_extract_all(lower_ascii(F.concat_ws("\n", "host", "path")), F.lit(TOKEN), F.lit(0)))
    index = rule_index(spark, urls.select(F.explode(tokens).alias("token")), rules)
    if index is None:
        best = None
    else:
        #: Distinct (host, path) pairs are judged once; a very common URL is one row here.
        asked = urls.select("host", "path").distinct().select("host", "path", F.explode(tokens).alias("token"))
        path = F.when(F.col("fold"), lower_ascii(F.col("path"))).otherwise(F.col("path"))
        got = asked.join(F.broadcast(index), "token").filter(F.rlike("host", F.col("on_host")) & F.rlike(path, F.col("on_path")))
        best = got.groupBy("host", "path").agg(F.min(F.struct((-F.col("rank")).alias("r"), "name", "fits")).alias("b"))
        best = best.select(F.col("host").alias("h"), F.col("path").alias("p"), F.col("b.name").alias("name"), F.col("b.fits").alias("fits"))
    if best is None:
        return urls.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default), "pattern_rule": F.lit(None).cast("string")})
    out = urls.join(best, (urls["host"] == best["h"]) & (urls["path"] == best["p"]), "left")
    own = F.col("name").startswith("~")
    return out.select(
        "page_id", "host", "path",
        F.when(~own, F.col("name")).alias("rule"),
        F.coalesce("fits", F.lit(default)).alias("verdict"),
        F.when(own, F.col("name")).alias("pattern_rule"),
    )


def rule_index(spark: SparkSession, seen: DataFrame, rules: list[UrlRule]) -> DataFrame | None:
    """Columns token, name, fits, on_host, on_path, fold, rank: each rule under its rarest token. seen has the URLs' tokens."""
    if not rules:
        return None
    every = [(r.name, r.verdict, r.host, r.path, r.fold, r.rank, t) for r in rules for t in r.tokens]
    missing = [r.name for r in rules if not r.tokens]
    if missing:
        raise ValueError(f"rules without a literal token: {missing}")
    mine = spark.createDataFrame(every, "name string, fits string, on_host string, on_path string, fold boolean, rank long, token string")
    wanted = mine.select("token").distinct()
    counts = seen.join(F.broadcast(wanted), "token").groupBy("token").agg(F.count("*").alias("n"))
    rarest = mine.join(F.broadcast(counts), "token", "left").groupBy("name").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "fits", "on_host", "on_path", "fold", "rank")).alias("b")
    )
    return rarest.select("name", "b.token", "b.fits", "b.on_host", "b.on_path", "b.fold", "b.rank")
