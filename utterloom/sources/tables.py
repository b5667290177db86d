"""Tables as tab-separated text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_tsv(spark: SparkSession, path: str | list[str], quoting: bool = False) -> DataFrame:
    """All columns as text, empty fields as empty strings; columns without a name are dropped. Without quoting, quotes are text."""
    r = spark.read.option("sep", "\t").option("header", True).option("quote", '"' if quoting else "").option("nullValue", "\x00").option("emptyValue", "")
    df = r.csv(path)
    #: Spark calls the k-th column `_c<k>` when its name is empty.
    names = [c for k, c in enumerate(df.columns) if c.strip() and c != f"_c{k}"]
    return df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in names])


def line(df: DataFrame, columns: list[str] | None = None, escape_plain: bool = False):
    """A row as one line. escape_plain writes a backslash before tabs, backslashes and line ends, else the escape mark U+001E is removed."""
    names = columns or df.columns

    def one(c: str):
        v = F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
        return F.regexp_replace(v, r"([\t\\\r\n|])", r"\\$1") if escape_plain else F.replace(v, F.lit("\x1e"), F.lit(""))

    return F.concat_ws("\t", *[one(c) for c in names]).alias("value")


def write_tsv(df: DataFrame, path: str, columns: list[str] | None = None, mode: str = "error", gzip: bool = False, plain: bool = False, one: bool = False) -> None:
    """No quoting. plain: the 13-column form with `\\r\\n` and backslashes.

    A part file for each task, each with a header line; one: a single table file in the order of the rows. Its parts
    are written by all tasks and then joined as bytes (gzip files below each other are one), so no task reads the table.
    """
    names = columns or df.columns
    w = df.select(line(df, names, plain).alias("value"))
    header, end = "\t".join(names), "\r\n" if plain else "\n"
    before = set(_files(df.sparkSession, path)) if one else set()
    out = w if one else w.mapInArrow(_headed(header), "value string")
    writer = out.write.mode(mode).option("lineSep", end)
    (writer.option("compression", "gzip") if gzip else writer.option("compression", "none") if one else writer).text(path)
    if one:
        _join(df.sparkSession, path, [f for f in _files(df.sparkSession, path) if f not in before], (header + end).encode(), gzip)


def _files(spark: SparkSession, path: str) -> list[str]:
    """The part files of a folder in the order of their tasks."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
    return sorted((n for n in names if n.startswith("part-")), key=lambda n: (int(n.split("-")[1]), n))


def _join(spark: SparkSession, path: str, parts: list[str], header: bytes, gzip: bool) -> None:
    """Makes one file of a folder's parts, behind a header if there are rows."""
    import gzip as gz

    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(conf)
    at = lambda name: jvm.org.apache.hadoop.fs.Path(folder, name)
    #: An empty gzip file has 20 bytes.
    parts_with_rows = [n for n in parts if fs.getFileStatus(at(n)).getLen() > (20 if gzip else 0)]
    if parts_with_rows:
        out = fs.create(at("_joined"), True)
        try:
            out.write(gz.compress(header, mtime=0) if gzip else header)
            for n in parts_with_rows:
                source = fs.open(at(n))
                try:
                    jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, 1 << 20, False)
                finally:
                    source.close()
        finally:
            out.close()
    for n in parts[0 if parts_with_rows else 1 :]:
        fs.delete(at(n), False)
    if parts_with_rows:
        fs.rename(at("_joined"), at(parts[0]))


def _headed(header: str):
    def run(batches):
        import pyarrow as pa

        first = True
        for b in batches:
            if first and b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([header], type=b.schema.field(0).type)], schema=b.schema)
                first = False
            yield b

    return run


def output_name(path: str | Column, suffix: str):
    """`x.cha(.gz)` with another ending; coded tables get `.coded` before theirs. A name or a column of names."""
    import re

    if isinstance(path, Column):
        if suffix == "coded":
            return F.regexp_replace(path, r"(\.\w+)$", ".coded$1")
        return F.concat(F.regexp_replace(path, r"\.cha(\.gz)?$", ""), F.lit(suffix))
    if suffix == "coded":
        return re.sub(r"(\.\w+)$", r".coded\1", path)
    return re.sub(r"\.cha(\.gz)?$", "", path) + suffix
