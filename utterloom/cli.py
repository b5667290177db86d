"""Command line: `chat` makes token tables from transcripts, `code` codes treebanks, `merge` puts codings into tables."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="utterloom", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("chat", help="transcripts to a token table")
    c.add_argument("chat_file")
    c.add_argument("out_dir")
    c.add_argument("--parsed", help="CoNLL-U files of the same utterances (item_id)")
    c.add_argument("-p", "--parameters", help="parameter file of the tagger; its program is --tagger")
    c.add_argument("--tagger", default="./tree-tagger", help="the tagger's program, on every machine")
    c.add_argument("--api_model", help="model of the parsing service at --api_url")
    c.add_argument("--api_url", help="address of a parsing service")
    c.add_argument("--chunk_parse", type=int, default=10000, help="utterances in a request")
    c.add_argument("--utt_tagged", action="store_true", help="fill the utt_tagged column")
    c.add_argument("--rewrite", help="rewrite rules")
    c.add_argument("--lexicon", action="append", default=[], help="lexicon file of the rewrite rules")
    c.add_argument("--write_conllu", action="store_true")
    c.add_argument("--html_dir")
    c.add_argument("--server_url", default="")
    c.add_argument("--chunk_html", type=int, default=5000)
    c.add_argument("--pos_output", default=".*")
    c.add_argument("--pos_utterance")
    c.add_argument("--utt_clean", action="store_true")
    c.add_argument("-z", "--gzip", action="store_true")
    c.add_argument("--one_file", action="store_true", help="each table as one file with one header")
    d = sub.add_parser("code", help="code sentences")
    d.add_argument("query_file")
    d.add_argument("conllu_file")
    d.add_argument("out_dir")
    d.add_argument("-c", "--coding_only", action="store_true")
    d.add_argument("-f", "--first_rule", action="store_true")
    d.add_argument("-m", "--mark_coding", action="store_true")
    d.add_argument("-n", "--code_node", action="store_true")
    d.add_argument("-t", "--print_text", action="store_true")
    d.add_argument("--chunk-size", type=int, default=0, help="files per micro-batch; 0: one batch job")
    d.add_argument("--estimate", action="store_true", help="count sentences first")
    m = sub.add_parser("merge", help="codings into a table")
    m.add_argument("csv_file")
    m.add_argument("coded_file")
    m.add_argument("out_dir")
    m.add_argument("--code_head", action="store_true")
    m.add_argument("-z", "--gzip", action="store_true")
    m.add_argument("--one_file", action="store_true", help="the table as one file with one header")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    from .functions import text
    from .operators import annotate, coding, pages, rewrite, table
    from .plans import language
    from .sources import chat, conllu, tables
    from .streaming import micro

    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("utterloom").getOrCreate()
    read = lambda path: "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())  # noqa: E731  rule files are small

    def kept(df, path: str):
        """Written and read again: a tagger, service or rewriting runs once, whatever reads its result."""
        df.write.parquet(path)
        return spark.read.parquet(path)

    if a.command == "chat":
        tokens = chat.read_chat(spark, a.chat_file, a.utt_clean)
        if not (a.parsed or a.parameters or a.api_model):
            tables.write_tsv(tokens, f"{a.out_dir}/table", table.PLAIN, gzip=a.gzip, plain=True)
            return
        tagged = lines = None
        if a.parameters:
            given = tokens.groupBy("item_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("w_nr", "word"))), lambda x: x["word"]), " ").alias("block"))
            tagger = annotate.process_annotator([a.tagger, a.parameters, "-token", "-lemma", "-sgml"])
            found = kept(annotate.annotate(given, tagger, a.chunk_parse), f"{a.out_dir}/tagged")
            tagged = annotate.tagged_tokens(found)
            if a.utt_tagged:
                speech = table.first_rows(tokens).select("item_id", "language")
                lines = annotate.tagged_lines(tagged).join(speech, "item_id").select("item_id", text.fix_tagged(F.col("utt_tagged"), F.col("language")).alias("utt_tagged"))
        blocks = None
        if a.parsed:
            blocks = conllu.read_blocks(spark, a.parsed)
        elif a.api_model:
            if not a.api_url:
                raise SystemExit("--api_model needs --api_url")
            unparsed = annotate.tagged_blocks(tagged) if tagged is not None else conllu.from_tokens(tokens)
            parser_ = annotate.http_annotator(a.api_url, a.api_model)
            blocks = kept(annotate.annotate(unparsed, parser_, a.chunk_parse), f"{a.out_dir}/parsed_blocks").filter("block is not null").select(F.lit("").alias("file"), F.monotonically_increasing_id().alias("block_nr"), "block")
        if blocks is None:
            out = table.finalise(tokens, None, tagged, lines, pos_utterance=a.pos_utterance, server_url=a.server_url)
            tables.write_tsv(out, f"{a.out_dir}/parsed", table.PARSED, gzip=a.gzip, one=a.one_file)
            tables.write_tsv(table.light(out, a.pos_output), f"{a.out_dir}/light", table.LIGHT, gzip=a.gzip, one=a.one_file)
            return
        if a.rewrite:
            lexicons = {p.rsplit("/", 1)[-1]: language.read_lexicon(read(p)) for p in a.lexicon}
            blocks = kept(rewrite.rewrite(blocks, language.parse_grammar(read(a.rewrite)), lexicons), f"{a.out_dir}/rewritten")
            blocks.filter("rewrite_error is not null").select("rewrite_error", "block").write.json(f"{a.out_dir}/rewrite_errors")
        g = conllu.graphs(blocks)
        links = None
        if a.html_dir:
            first = table.first_rows(tokens)
            project = first.select("item_id", F.substring_index("child_project", "_", -1).alias("project"))
            paged = pages.numbered_pages(g.join(project, "item_id", "left").withColumn("n", F.struct("file", "block_nr")), a.chunk_html, ["block_nr"], ["file"])
            pages.write_pages(pages.pages(paged, first, a.chat_file.rsplit("/", 1)[-1]), a.html_dir)
            links = pages.links(paged, a.html_dir)
        out = table.finalise(tokens, conllu.token_rows(g), tagged, lines, links=links, pos_utterance=a.pos_utterance, server_url=a.server_url)
        tables.write_tsv(out, f"{a.out_dir}/parsed", table.PARSED, gzip=a.gzip, one=a.one_file)
        tables.write_tsv(table.light(out, a.pos_output), f"{a.out_dir}/light", table.LIGHT, gzip=a.gzip, one=a.one_file)
        if a.write_conllu:
            conllu.write_conllu(g, f"{a.out_dir}/conllu", compression="gzip" if a.gzip else None)
    elif a.command == "code":
        rules = language.parse_rules(read(a.query_file))

        def written(g, path: str) -> None:
            g = coding.coding_only(g) if a.coding_only else g
            if a.print_text or a.mark_coding:
                coding.concordance(g, a.mark_coding).select(F.col("text").alias("value")).write.text(path)
            else:
                conllu.write_conllu(g, path)

        if a.estimate:
            print(f"{conllu.read_blocks(spark, a.conllu_file).count()} sentences")
        if a.chunk_size:
            stream = micro.stream_blocks(spark, a.conllu_file, a.chunk_size)
            micro.code_stream(stream, rules, lambda g, n: written(g, f"{a.out_dir}/batch={n}"), f"{a.out_dir}/_checkpoint", a.first_rule, code_node=a.code_node).awaitTermination()
        else:
            written(coding.code(conllu.read_conllu(spark, a.conllu_file), rules, a.first_rule, code_node=a.code_node), f"{a.out_dir}/coded")
    else:
        out = coding.merge(tables.read_tsv(spark, a.csv_file), conllu.read_conllu(spark, a.coded_file), code_head=a.code_head)
        tables.write_tsv(out, f"{a.out_dir}/coded", gzip=a.gzip, one=a.one_file)


if __name__ == "__main__":
    main()
