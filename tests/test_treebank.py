import random
import re
import sys

import pytest
from pyspark.sql import functions as F

from utterloom.functions.plan import spread
from utterloom.operators import annotate, coding, match, pages, rewrite, table
from utterloom.plans import language
from utterloom.sources import conllu, tables
from utterloom.streaming import micro

SENTENCE = """# item_id = 7_u1
# sent_id = s1
1\tMarie\tMarie\tPROPN\t_\t_\t3\tnsubj\t_\t_
2-3\tl'a\t_\t_\t_\t_\t_\t_\t_\t_
2\tl'\tle\tPRON\t_\tNumber=Sing|PronType=Prs\t3\tobj\t_\t_
3\tvoit\tvoir\tVERB\tV\tVerbForm=Fin\t0\troot\t_\tfix=
3.1\tx\tx\tX\t_\t_\t_\t_\t_\t_
4\tà\tà\tADP\t_\t_\t5\tcase\t_\t_
5\tmidi\tmidi\tNOUN\t_\t_\t3\tobl:arg\t_\tSpaceAfter=No|a=b=c"""


@pytest.fixture(scope="module")
def graph(spark):
    return conllu.graphs(spark.createDataFrame([(0, SENTENCE)], "n int, block string"))


def found(g, rule: str, **kw) -> list[tuple]:
    rules = language.parse_rules("% coding attribute=a value=x " + rule + "\n")
    return [(m["node"], m["head"], m["lemma"]) for m in match.match(g, rules, **kw).collect()[0]["matches"]]


@pytest.mark.parametrize(
    "rule,want",
    [
        ("node=V addlemma=N\npattern { V -[nsubj]-> N }", [("3", "1", "Marie")]),
        ("node=N addlemma=V\npattern { V -[1=obl]-> N; }", [("5", "3", "voir")]),
        ("node=N addlemma=V\npattern { V -[obl]-> N; }", []),
        ("node=N\npattern { N [form=/^À/i] }", [("4", "0", None)]),
        ("node=N\npattern { N [form=/^À/] }", []),
        ('node=N\npattern { N [form=re"[lL]\'"] }', [("2", "0", None)]),
        ("node=N\npattern { N [form=/i/, upos=NOUN|PROPN] }", [("1", "0", None), ("5", "0", None)]),
        ("node=N\npattern { N [!PronType, upos=PRON] }", []),
        ("node=V\npattern { X -[root]-> V }", [("3", "0", None)]),
        ("node=V addlemma=X\npattern { X -[root]-> V }", [("3", "0", None)]),
        ("node=A addlemma=B\npattern { A < B; B [upos=VERB] }", [("2", "3", "voir")]),
        ("node=P addlemma=V\npattern { V -> N; N -[case]-> P; P [form=à] }\nwithout { V -[obl:arg]-> N }", []),
        ("node=P addlemma=V\npattern { V -> N; N -[case]-> P; }\nwithout { P [form=\"de\"] }", [("4", "3", "voir")]),
        ("node=N addlemma=V\npattern { V [upos=VERB]; V -> N }\nwithout { N -[case]-> P }", [("1", "3", "Marie"[:0] or "voir"), ("2", "3", "voir")]),
        ("node=V addlemma=Q\npattern { V [fix=\"\"] }", [("3", "0", None)]),
        ("node=Q addlemma=V\npattern { V [upos=VERB] }", []),
        ("node=N addlemma=V\npattern { V -[obj|nsubj]-> N; N << V }", [("1", "3", "voir"), ("2", "3", "voir")]),
        ("node=N addlemma=V\nPATTERN { V -[re\".*:arg\"]-> N }", [("5", "3", "voir")]),
        ("node=N\npattern { N [a=\"b=c\"] }", [("5", "0", None)]),
    ],
)
def test_constructs(graph, rule, want):
    assert found(graph, rule) == want


def test_injective_flag(graph):
    rule = "node=A addlemma=B\npattern { A [upos=VERB]; B [upos=VERB] }"
    assert found(graph, rule) == [] and found(graph, rule, injective=False) == [("3", "3", "voir")]


def test_parser_reads_files_as_they_are_written():
    text = """% a comment with coding words? no
% coding attribute=modal value=other node=V addlemma=MOD
pattern {
    MOD [lemma="pouvoir"] | [lemma="vouloir"];  % trailing
    V [upos="VERB", form=/a%b|x\\/y/i]; e1:MOD -[xcomp|1=ccomp]-> V -> W;
}
without { MOD [lemma="savoir"] }
% CODING attribute=m val=inf node=V add=MOD
PATTERN { MOD [lemma=/(pouvoir|devoir)/]; MOD < V; V << W }
% coding attr=bad
pattern { N [] }
exit
% coding attribute=z value=z node=Z
pattern { Z [] }
"""
    with pytest.warns(UserWarning, match="malformed"):
        rules = language.parse_rules(text)
    assert [(r.att, r.val, r.node, r.add) for r in rules] == [("modal", "other", "V", "MOD"), ("m", "inf", "V", "MOD")]
    p = rules[0].pattern
    assert p.names == ["MOD", "V", "W"] and len(p.nodes[0][1]) == 2 and len(p.edges) == 2 and p.edges[0].ident == "e1"
    assert p.nodes[1][1][0][1] == language.Feature("form", "regex", ("a%b|x\\/y",), True)
    assert [x.kind for x in p.edges[0].labels] == ["full", "main"] and rules[0].without[0].names == ["MOD"]
    for bad in ("pattern { N [upos= }", "pattern { N -[x-> M }", "pattern { N ? }", "without { N [] }"):
        with pytest.raises(language.PatternError):
            language.parse_pattern(bad)


def random_block(rnd: random.Random, k: int) -> str:
    n = rnd.randint(1, 7)
    rows = [f"# item_id = {k}_u1"]
    for i in range(1, n + 1):
        feats = rnd.choice(["_", "PronType=Prs", "VerbForm=Inf"])
        head = rnd.choice([h for h in range(n + 1) if h != i])
        rows.append("\t".join([str(i), rnd.choice("abc"), rnd.choice("xyz"), rnd.choice(["NOUN", "VERB", "PRON"]), "_", feats, str(head), rnd.choice(["root"] if head == 0 else ["nsubj", "obj", "obl:arg", "nsubj:pass", "case"]), "_", "_"]))
    return "\n".join(rows)


PATTERNS = [
    "pattern { V [upos=VERB]; V -[1=nsubj]-> N; }",
    "pattern { V -> N; N -> P; } without { P [upos=NOUN]; }",
    "pattern { X -[obj]-> A; X -[nsubj|case]-> B; A << B }",
    "pattern { A [upos=NOUN]; B [upos=VERB|PRON]; A < B; C [form=/a|b/]; C << A }",
    "pattern { X -[root]-> V; } without { V -[obj]-> N; } without { M [form=c]; M < V; }",
    "pattern { V [upos=VERB]; R [form=a]; V < R; N -> R; N [upos=NOUN|PRON] }",
    "pattern { N [!PronType]; V -[re\"n.*\"]-> N } without { A [lemma=x]; B [lemma=y]; A < B; V -> A }",
]


def test_compiled_patterns_equal_search_in_python(spark):
    rnd = random.Random(5)
    blocks = [random_block(rnd, k) for k in range(120)]
    g = conllu.graphs(spark.createDataFrame([(k, b) for k, b in enumerate(blocks)], "n int, block string"))
    rules = []
    for k, text in enumerate(PATTERNS):
        pattern, without = language.parse_pattern(text)
        rules.append(language.Rule(k + 1, "a", "x", pattern.names[0], None, pattern, without))
    got = {r["n"]: r["matches"] for r in match.match(g, rules).select("n", "matches").collect()}
    total = 0
    for k, b in enumerate(blocks):
        want = sorted((r.nr, [int(m[n]) for n in r.pattern.names]) for r in rules for m in rewrite.find(rewrite.parse_graph(b), r.pattern, r.without))
        assert [(m["rule"], m["bound"]) for m in got[k]] == want
        total += len(want)
    assert total > 200


def test_block_round_trip(graph):
    assert conllu.to_blocks(graph).collect()[0]["block"] == SENTENCE


def test_files_round_trip(spark, tmp_path, graph):
    (tmp_path / "a.conllu").write_text(SENTENCE + "\n \t\n\n" + SENTENCE.replace("7_u1", "7_u2"), encoding="utf8")
    g = conllu.read_conllu(spark, f"{tmp_path}/a.conllu")
    assert [r["item_id"] for r in g.orderBy("block_nr").collect()] == ["7_u1", "7_u2"]
    conllu.write_conllu(g.coalesce(1), f"{tmp_path}/out", compression="gzip")
    again = conllu.read_large(spark, f"{tmp_path}/out")
    assert again.count() == 2
    assert sorted(r["item_id"] for r in conllu.graphs(again).collect()) == ["7_u1", "7_u2"]


RULES = """% coding attribute=subj value=first node=V addlemma=N
pattern { V -[nsubj]-> N }
% coding attribute=subj value=second node=V addlemma=N
pattern { V -[1=nsubj|obj]-> N }
% coding attribute=pp value=1 node=P
pattern { N -[case]-> P }
"""


def test_texts_do_not_go_through_the_joins_of_tokens(spark):
    """They are put beside the tokens at the end, also where an id has two texts or none is there."""
    rows = [("a", 1, "one two"), ("a", 2, "one two"), ("b", 1, "x"), ("b", 2, "y"), (None, 1, "z"), ("c", 1, None)]
    tok = spark.createDataFrame(rows, "item_id string, w_nr int, utterance string").selectExpr("item_id", "w_nr", "w_nr conll_id", "utterance", "concat('<', utterance, '>') utt_clean", "concat_ws('_', item_id, w_nr) utt_id", "1 utt_nr", "'w' word", *[f"'' {c}" for c in table.PLAIN[3:8]], "0 age_days", "'' time_code")
    tag = spark.createDataFrame([(i, w, "V", "l") for i, w, _ in rows if i], "item_id string, w_nr int, pos string, lemma string")
    links = spark.createDataFrame([("a", "h/1.html", "1.html")], "item_id string, local string, file string")
    out = table.finalise(tok, None, tag, links=links)
    got = sorted(tuple(r) for r in out.select(F.coalesce("item_id", F.lit("-")), "w_nr", "utterance", "utt_clean", "pos", F.col("URLloc") != "").collect())
    assert got == sorted((i or "-", w, u or "", f"<{u}>" if u else "", "V" if i else "_", i == "a") for i, w, u in rows)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = spark._jvm.PythonSQLUtils.explainString(out._jdf.queryExecution(), "formatted")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    dealt = re.findall(r"Exchange\nInput \[\d+\]: \[(.*)\]\nArguments: hashpartitioning\(item_id#\d+, w_nr#", plan)
    assert dealt and not any("utterance" in x for x in dealt)



def test_first_rows_sort_few_rows(spark):
    """Rows behind all first rows go before the sort; keys that start late, have no order or are missing keep theirs."""
    rows = [(f"k{k}", n, f"{k}_{n}") for k in range(200) for n in range(1, 40)] + [("late", 70, "x"), ("late", 71, "y"), ("none", None, "z"), (None, 5, "n"), (None, 4, "m")]
    df = spark.createDataFrame(rows, "item_id string, w_nr int, word string").repartition(4)
    out = table.first_rows(df)
    want = [(f"k{k}", 1, f"{k}_1") for k in range(200)] + [("late", 70, "x"), ("none", None, None), (None, 4, "m")]
    assert out.columns == ["item_id", "w_nr", "word"] and sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, want))
    plan = spark._jvm.PythonSQLUtils.explainString(out._jdf.queryExecution(), "simple")
    assert re.search(r"SortAggregate.*min_by[\s\S]*BroadcastHashJoin .* LeftSemi", plan)


def test_first_rule_and_metadata(graph):
    rules = language.parse_rules(RULES)
    one = coding.code(graph, rules).collect()[0]["meta"]["coding"]
    assert one == "subj:first(3>1_Marie); subj:second(3>2_le); pp:1(4>0)"
    every = coding.code(graph, rules, first=False).collect()[0]["meta"]["coding"]
    assert every == "subj:first(3>1_Marie); subj:second(3>1_Marie); subj:second(3>2_le); pp:1(4>0)"
    again = coding.code(coding.code(graph, rules).drop("codings"), rules)
    assert again.collect()[0]["meta"]["coding"] == one
    marked = coding.concordance(coding.code(graph, rules), mark=True).collect()[0]["text"]
    assert marked == "Marie l' <h rule=\"subj\">voit</h> à midi"
    nodes = coding.code(graph, rules, code_node=True).collect()[0]["nodes"]
    assert nodes[2]["misc"]["coding"] == "subj:first(3>1_Marie); subj:second(3>2_le)" and nodes[3]["misc"]["coding"] == "pp:1(4>0)"
    assert coding.coding_only(graph).count() == 0 and coding.coding_only(again).count() == 1


def test_merge(spark, graph):
    g = coding.code(graph, language.parse_rules(RULES))
    t = spark.createDataFrame([(f"7_u1_w{k}", f"old{k}" if k == 3 else "") for k in range(1, 6)] + [("9_u9_w1", "")], "utt_id string, pp string")
    out = {r["utt_id"]: (r["subj"], r["pp"]) for r in coding.merge(t, g).collect()}
    assert out == {"7_u1_w1": ("", ""), "7_u1_w2": ("", ""), "7_u1_w3": ("first(3>1_Marie);second(3>2_le)", "old3"), "7_u1_w4": ("", "1(4>0)"), "7_u1_w5": ("", ""), "9_u9_w1": ("", "")}
    twice = t.coalesce(1).unionByName(spark.createDataFrame([("7_u1_w3", "last")], t.schema).coalesce(1))
    assert {r["utt_id"]: (r["subj"], r["pp"]) for r in coding.merge(twice, g).collect()} == out | {"7_u1_w3": (out["7_u1_w3"][0], "last")}
    head = {r["utt_id"]: (r["subj"], r["pp"]) for r in coding.merge(t, g, ["pp", "subj"], code_head=True).collect()}
    for code_head, want in ((False, out), (True, head)):
        got = {r["utt_id"]: (r["subj"], r["pp"]) for r in coding.coded_tokens(g, ["pp", "subj"], code_head).collect()}
        assert got == {k: (s, "" if p == "old3" else p) for k, (s, p) in want.items() if k != "9_u9_w1"}
    assert head["7_u1_w1"] == ("first(3>1_Marie)", "") and head["7_u1_w2"][0] == "second(3>2_le)" and head["7_u1_w4"] == ("", "")
    parsed = coding.parsed(F.lit("a:v(2>3_x:y); broken; b:w; c:z(4>0)"))
    assert [(e["att"], e["node"], e["head"]) for e in spark.range(1).select(parsed.alias("p")).collect()[0]["p"]] == [("a", "2", "3"), ("b", "1", "0"), ("c", "4", "0")]


GRAMMAR = """
rule mark { pattern { V [upos=VERB, !seen]; } commands { V.seen = ""; } }  % a mark
package p {
  rule two_subjects {
    pattern { V [upos=VERB]; A < B; B << V; e1: V -[nsubj]-> A; e2: V -[nsubj]-> B; }
    commands { del_edge e1; del_edge e2; add_edge V -[dislocated:todo]-> A; add_edge V -[nsubj]-> B; V.seen = V.seen + two_subjects + ","; V.todo = attach; }
  }
  rule object (verbs from "v.tsv") {
    pattern { V [lemma=verbs.lemma]; A << B; e: V -[obj]-> B; V -[nsubj]-> A }
    without { COMMA [form=","]; A << COMMA }
    commands { del_edge e; add_edge A -[dislocated]-> B }
  }
}
strat main { Onf (Alt (mark, p,)) }
"""


def lines(*rows):
    return "# item_id = 1_u1\n" + "\n".join("\t".join([str(k + 1), f, f, u, "_", "_", str(h), d, "_", "_"]) for k, (f, u, h, d) in enumerate(rows))


def test_rewriting(spark):
    g = language.parse_grammar(GRAMMAR)
    lex = {"v.tsv": language.read_lexicon("lemma\tx\n%--\ndort\ti\n")}
    double = lines(("Marie", "PROPN", 3, "nsubj"), ("elle", "PRON", 3, "nsubj"), ("va", "VERB", 0, "root"))
    moved = lines(("il", "PRON", 2, "nsubj"), ("dort", "VERB", 0, "root"), ("bébé", "NOUN", 2, "obj"))
    comma = lines(("il", "PRON", 2, "nsubj"), ("dort", "VERB", 0, "root"), (",", "PUNCT", 2, "punct"), ("bébé", "NOUN", 2, "obj"))
    df = spark.createDataFrame([(0, double), (1, moved), (2, comma)], "n int, block string")
    out = rewrite.rewrite(df, g, lex).orderBy("n").collect()
    a = rewrite.parse_graph(out[0]["block"])
    assert set(a.edges) == {("3", "dislocated:todo", "1"), ("3", "nsubj", "2"), ("0", "root", "3")} and a.misc["3"] == {"seen": "two_subjects,", "todo": "attach"}
    assert ("1", "dislocated", "3") in rewrite.parse_graph(out[1]["block"]).edges and out[1]["rewrite_steps"] == 2
    assert ("2", "obj", "4") in rewrite.parse_graph(out[2]["block"]).edges
    again = rewrite.rewrite(spark.createDataFrame([(r["n"], r["block"]) for r in out], "n int, block string"), g, lex).orderBy("n").collect()
    assert [r["block"] for r in again] == [r["block"] for r in out] and all(r["rewrite_steps"] == 0 and r["rewrite_error"] is None for r in again)


def test_endless_rules_are_reported(spark):
    g = language.parse_grammar('rule r { pattern { V [upos=VERB] } commands { V.x = V.x + "a" } }')
    out = rewrite.rewrite(spark.createDataFrame([(lines(("a", "VERB", 0, "root")),)], "block string"), g).collect()[0]
    assert "no normal form" in out["rewrite_error"] and out["rewrite_steps"] == 0


def test_long_rewriting_has_no_fixed_limit(spark):
    """Each step is one edge; 150 of them are no reason to give up."""
    g = language.parse_grammar("rule r { pattern { e: V -[obj]-> N } commands { del_edge e; add_edge V -[iobj]-> N } }")
    many = lines(("v", "VERB", 0, "root"), *[("n", "NOUN", 1, "obj") for _ in range(150)])
    out = rewrite.rewrite(spark.createDataFrame([(many,)], "block string"), g).collect()[0]
    assert out["rewrite_steps"] == 150 and out["rewrite_error"] is None and "\tobj\t" not in out["block"]
    back = language.parse_grammar("rule a { pattern { e: V -[x]-> N } commands { del_edge e; add_edge V -[y]-> N } } rule b { pattern { e: V -[y]-> N } commands { del_edge e; add_edge V -[x]-> N } }")
    out = rewrite.rewrite(spark.createDataFrame([(lines(("v", "VERB", 0, "root"), ("n", "NOUN", 1, "x")),)], "block string"), back).collect()[0]
    assert "comes again" in out["rewrite_error"]


def test_rewriting_holds_few_sentences_at_a_time(spark, monkeypatch):
    """A batch of Arrow is cut up; other columns, nulls and order stay."""
    from pyspark.sql.types import StructType

    g = language.parse_grammar("rule r { pattern { e: V -[obj]-> N } commands { del_edge e; add_edge V -[iobj]-> N } }")
    block = lines(("v", "VERB", 0, "root"), ("n", "NOUN", 1, "obj"))
    df = spark.range(1000).coalesce(1).selectExpr("map('k', id) m", "CASE WHEN id <> 300 THEN concat('# n = ', id, '\n') END AS h", "id").withColumn("block", F.concat("h", F.lit(block))).drop("h")
    caught = []
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, run, schema: caught.append((self, run, schema)) or self)
    rewrite.rewrite(df, g)
    monkeypatch.undo()
    ((own, run, schema),) = caught
    sizes = [b.num_rows for b in run(iter(own.toArrow().combine_chunks().to_batches()))]
    assert sum(sizes) == 1000 and max(sizes) <= 200 and isinstance(schema, StructType)
    out = rewrite.rewrite(df, g).collect()
    assert [r["id"] for r in out] == [r["m"]["k"] for r in out] == list(range(1000))
    assert all(r["rewrite_steps"] == 1 and f"# n = {r['id']}\n" in r["block"] and "\tiobj\t" in r["block"] for r in out if r["id"] != 300)
    assert out[300]["block"] is None and out[300]["rewrite_error"] and out[300]["rewrite_steps"] == 0


def test_rewriting_does_not_search_anew_for_each_step(monkeypatch):
    """The labels looked at grow with the steps, not with their square."""
    calls = []
    plain = rewrite._label
    monkeypatch.setattr(rewrite, "_label", lambda *a: calls.append(a) or plain(*a))
    rules = language.parse_grammar("rule r { pattern { V -[obj]-> N; e: V -[obj]-> N } commands { del_edge e; add_edge V -[iobj]-> N } }").rules_of("main")
    g = rewrite.parse_graph(lines(*[("n", "NOUN", max(k // 2, 1), "obj" if k else "root") for k in range(300)]))
    assert rewrite.normal_form(g, rules) == 299 and {x for _, x, _ in g.edges} == {"root", "iobj"}
    assert len(calls) < 20 * 300


def test_rewriting_equals_a_search_of_all_nodes():
    """Matches in the order of a search through all nodes, step by step, also as the index follows the changes."""
    rnd = random.Random(7)
    rules = language.parse_grammar(
        'rule a { pattern { e: V -[obj|case]-> N; N [upos=NOUN] } without { N -> Z; Z [m="1"] } commands { del_edge e; add_edge V -[mark]-> N; N.m = "1" } }'
        ' rule b { pattern { A [upos=VERB, !m]; B << A } without { A -[mark]-> B } commands { A.m = A.m + "1"; add_edge B -[obj]-> A } }'
    ).rules_of("main")
    steps = 0
    for _ in range(60):
        n = rnd.randrange(1, 9)
        text = lines(*[("w", rnd.choice(["NOUN", "VERB", "ADV"]), rnd.randrange(0, n + 1), rnd.choice(["obj", "case", "root", "mark"])) for _ in range(n)])
        g, kept = rewrite.parse_graph(text), rewrite.parse_graph(text)
        index = rewrite.Index(g)
        for _ in range(12):
            found = [list(rewrite.find(g, r.pattern, r.without, index=index)) for r in rules]
            assert found == [list(rewrite.find(kept, r.pattern, r.without)) for r in rules]
            first = next(((r, m) for r, ms in zip(rules, found, strict=True) for m in ms), None)
            if first is None:
                break
            assert rewrite.apply(g, *first, index) == rewrite.apply(kept, *first)
            assert index.state() == rewrite.Index(kept).state()
            steps += 1
    assert steps > 50


def test_rows_are_spread_in_whole_rounds(spark):
    """No task is left over for a round of its own."""
    cores = spark.sparkContext.defaultParallelism
    for n, tasks in ((1, cores), (cores, cores), (cores + 1, 2 * cores), (3 * cores - 1, 3 * cores)):
        rows = spread(spark.range(0, 1000 * n, 1, n)).groupBy(F.spark_partition_id().alias("p")).count().collect()
        assert len(rows) == tasks and sum(r["count"] for r in rows) == 1000 * n


def test_rows_of_one_row_group_are_spread(spark, tmp_path):
    """More splits than cores, but all rows in one of them."""
    spark.range(4000).coalesce(1).write.parquet(f"{tmp_path}/one")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        df = spark.read.parquet(f"{tmp_path}/one")
        assert df.rdd.getNumPartitions() >= 4 and df.select(F.spark_partition_id()).distinct().count() == 1
        sizes = [r["count"] for r in spread(df).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sum(sizes) == 4000 and max(sizes) <= 4000 / 4 * 1.2


def test_depths(spark):
    rnd = random.Random(4)
    heads = [[0], [0, 1, 2, 3, 4, 5, 6], [2, 3, 1], [3, 1, 0, 3, 9], *[[rnd.randrange(0, n + 1) for _ in range(n)] for n in (5, 8, 13, 40)]]
    df = spark.createDataFrame([(k, [(p + 1, h) for p, h in enumerate(hs)]) for k, hs in enumerate(heads)], "k int, nodes array<struct<pos:int,head:int>>")
    for r in df.select("k", pages.depths(F.col("nodes")).alias("d")).collect():
        hs = heads[r["k"]]
        for p, d in enumerate(r["d"]):
            h, steps = hs[p], 0
            while h and steps < len(hs):
                steps += 1
                h = hs[h - 1] if h <= len(hs) else 0
            assert d == min(steps, len(hs))


@pytest.fixture(scope="module")
def service():
    """A parsing service: every token hangs on the first; sentences with `bad` are refused."""
    import json
    import threading
    import urllib.parse
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class Parser(BaseHTTPRequestHandler):
        def do_POST(self):
            form = urllib.parse.parse_qs(self.rfile.read(int(self.headers["Content-Length"])).decode())
            data = form["data"][0]
            ok = form["model"] == ["m"] and form["input"] == ["conllu"] and "bad" not in data
            out = []
            for x in data.strip("\n").split("\n"):
                f = x.split("\t")
                out.append(x if len(f) != 10 else "\t".join([*f[:3], "VERB" if f[0] == "1" else "NOUN", f[4], "_", "0" if f[0] == "1" else "1", "root" if f[0] == "1" else "obj", "_", "_"]))
            body = json.dumps({"result": "\n".join(out) + "\n\n"}).encode()
            self.send_response(200 if ok else 400)
            self.end_headers()
            self.wfile.write(body if ok else b"no")

        def log_message(self, *a):
            pass

    s = HTTPServer(("127.0.0.1", 0), Parser)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}/process"
    s.shutdown()


def test_parsing_service(spark, service):
    words_ = spark.createDataFrame([(f"{k}_u1", j + 1, "bad" if k == 7 else f"w{j}") for k in range(12) for j in range(3)], "item_id string, conll_id int, word string")
    out = {r["item_id"]: r for r in annotate.annotate(conllu.from_tokens(words_), annotate.http_annotator(service, "m"), batch=5).collect()}
    assert [k for k, r in out.items() if r["error"]] == ["7_u1"] and "400" in out["7_u1"]["error"]
    assert out["3_u1"]["block"].split("\n")[2] == "2\tw1\t_\tNOUN\t_\t_\t1\tobj\t_\t_"


def test_command_line_with_tagger_and_service(spark, service, tmp_path):
    from utterloom import cli

    (tmp_path / "a.cha").write_text("@PID:\t11312/c-5-1\n@ID:\tfra|G|CHI|2;||||Target_Child|||\n*CHI:\toui lapin .\n*CHI:\tnon .\n@End\n", encoding="utf8")
    script = tmp_path / "tagger"
    script.write_text(f"#!{sys.executable}\nimport sys\nfor x in sys.stdin:\n x = x.strip()\n print(x if x.startswith('<s_') else x + '\\tN\\tle ' + x.upper())\n")
    script.chmod(0o755)
    base = ["chat", f"{tmp_path}/a.cha"]
    tagger = ["-p", "p.par", "--tagger", str(script), "--utt_tagged", "--one_file"]
    cli.main([*base, f"{tmp_path}/t", *tagger], spark)
    rows = [r["value"].split("\t") for r in spark.read.text(f"{tmp_path}/t/parsed").collect()]
    assert rows[0] == table.PARSED and len(rows) == 6 and [r[12:15] for r in rows if r[0] == "5_u1_w2"] == [["lapin", "LAPIN", "N"]] and any("oui_N=OUI lapin_N=LAPIN ._N=." in r for r in rows)
    cli.main([*base, f"{tmp_path}/b", *tagger, "--api_model", "m", "--api_url", service, "--chunk_parse", "1"], spark)
    rows = [r["value"].split("\t") for r in spark.read.text(f"{tmp_path}/b/parsed").collect()]
    assert [(r[12], r[13], r[20], r[24]) for r in rows if r[0] == "5_u1_w2"] == [("lapin", "LAPIN", "LAPIN", "1")]
    cli.main([*base, f"{tmp_path}/s", "--api_model", "m", "--api_url", service], spark)
    assert sum("VERB" in r["value"] for r in spark.read.text(f"{tmp_path}/s/parsed").collect()) == 2


def test_golden_tables(spark):
    """Optional: a folder (GOLDEN_DIR) with a transcript, its coded table and the query file; cells are compared by column."""
    import glob
    import os

    from utterloom.sources import chat

    where = os.environ.get("GOLDEN_DIR")
    if not where:
        pytest.skip("GOLDEN_DIR is not set")
    transcript, coded = glob.glob(f"{where}/*.cha")[0], glob.glob(f"{where}/*.coded.csv")[0]
    head, *body = [x.split("\t") for x in open(coded, encoding="utf8").read().strip("\n").split("\n")]
    want = {r[0]: dict(zip(head, r)) for r in body}
    got = {r["utt_id"]: r for r in chat.read_chat(spark, transcript).collect()}
    assert set(got) == set(want) and len(want) == 94
    for k, w in want.items():
        for c in ("utt_nr", "w_nr", "speaker", "child_project", "language", "child_other", "age", "age_days", "time_code", "word"):
            assert str(got[k][c]) == w[c], (k, c)
    sentences: dict = {}
    for r in want.values():
        if r["conll_1"]:
            sentences.setdefault(r["utt_id"].rsplit("_w", 1)[0], []).append([r[f"conll_{k}"] for k in range(1, 11)])
    blocks = [f"# item_id = {i}\n" + "\n".join("\t".join(f) for f in sorted(s, key=lambda f: int(f[0]))) for i, s in sentences.items()]
    rules = language.parse_rules(open(glob.glob(f"{where}/*french.query")[0], encoding="utf8").read())
    g = coding.code(conllu.graphs(spark.createDataFrame([(b,) for b in blocks], "block string")), rules)
    atts = sorted({r.att for r in rules})
    coded_ = {r["utt_id"]: r for r in coding.coded_tokens(g, atts).collect()}
    cells = 0
    for k, w in want.items():
        for a in head[28:]:
            mine = coded_[k][a] if k in coded_ and a in atts else ""
            assert mine == w[a], (k, a)
            cells += bool(w[a])
    assert cells == 36
    rnd = random.Random(6)
    some = [random_block(rnd, k) for k in range(40)] + blocks
    trees = conllu.graphs(spark.createDataFrame(list(enumerate(some)), "n int, block string"))
    grammar = language.parse_grammar(open(glob.glob(f"{where}/*.grs")[0], encoding="utf8").read())
    lexicon = language.read_lexicon(open(glob.glob(f"{where}/*.tsv")[0], encoding="utf8").read())
    assert len(grammar.rules) == 12
    for k, r in enumerate(grammar.rules):  # rewrite rules match alike in both
        lex = {r.lexicon[0]: lexicon} if r.lexicon else {}
        found_ = {x["n"]: x["matches"] for x in match.match(trees, [language.Rule(k, "a", "x", r.pattern.names[0], None, r.pattern, r.without)], lexicons=lex).select("n", "matches").collect()}
        for n, b in enumerate(some):
            assert [m["bound"] for m in found_[n]] == sorted([int(m[x]) for x in r.pattern.names] for m in rewrite.find(rewrite.parse_graph(b), r.pattern, r.without, lex)), (r.name, n)
    for path in glob.glob(f"{where}/**/*.query", recursive=True):  # every shipped rule against the search in plain Python
        rnd, shipped = random.Random(3), language.parse_rules(open(path, encoding="utf8").read())
        some = [random_block(rnd, k) for k in range(12)] + blocks[:8]
        trees = conllu.graphs(spark.createDataFrame(list(enumerate(some)), "n int, block string"))
        for at in range(0, len(shipped), 12):
            part = shipped[at : at + 12]
            found_ = {r["n"]: r["matches"] for r in match.match(trees, part).select("n", "matches").collect()}
            for n, b in enumerate(some):
                plain = sorted((r.nr, [int(m[x]) for x in r.pattern.names]) for r in part for m in rewrite.find(rewrite.parse_graph(b), r.pattern, r.without) if r.node in r.pattern.names)
                assert [(m["rule"], m["bound"]) for m in found_[n]] == plain, (path, n)


def test_annotator_isolates_failures(spark):
    def tagger(texts):
        if any("bad" in t for t in texts):
            raise RuntimeError("cannot")
        return [f"{t}\tNOUN\tthe {t}" for t in texts]

    df = spark.createDataFrame([(str(k), "bad" if k == 13 else f"w{k}") for k in range(30)], "item_id string, block string")
    out = annotate.annotate(df, tagger)
    rows = {r["item_id"]: r for r in out.collect()}
    assert len(rows) == 30 and [k for k, r in rows.items() if r["error"]] == ["13"]
    t = annotate.tagged_tokens(out.filter("error is null"))
    assert {(r["word"], r["pos"], r["lemma"]) for r in t.filter("item_id = '4'").collect()} == {("w4", "NOUN", "w4")}
    assert annotate.tagged_lines(t).filter("item_id = '4'").collect()[0]["utt_tagged"] == "w4_NOUN=w4"
    assert annotate.tagged_blocks(t).filter("item_id = '4'").collect()[0]["block"] == "# item_id = 4\n1\tw4\tw4\t_\tNOUN\t_\t_\t_\t_\t_"
    assert annotate.offline(df, out.filter("error is null")).filter("block is null").count() == 1


def test_process_annotator():
    script = "import sys\nfor x in sys.stdin:\n x=x.strip()\n print(x if x.startswith('<s_') else x+'\\tP\\t'+x.lower())"
    run = annotate.process_annotator([sys.executable, "-c", script])
    assert run(["A b", "C"]) == ["A\tP\ta\nb\tP\tb", "C\tP\tc"]


def test_tables_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", '=HYPERLINK("u"; "LOC")', "", "x\x1ey"), ("b", '"quoted', None, "z")], "k string, link string, _corpus string, esc string").coalesce(1)
    tables.write_tsv(df, f"{tmp_path}/t", gzip=True)
    back = tables.read_tsv(spark, f"{tmp_path}/t")
    assert [tuple(r) for r in back.orderBy("k").collect()] == [("a", '=HYPERLINK("u"; "LOC")', "", "xy"), ("b", '"quoted', "", "z")]
    assert back.columns == ["k", "link", "_corpus", "esc"]
    tables.write_tsv(df.repartition(2), f"{tmp_path}/one", one=True)
    assert [r["value"] for r in spark.read.text(f"{tmp_path}/one").collect()].count("k\tlink\t_corpus\tesc") == 1
    (tmp_path / "n.csv").write_text("a\t\t_c\n1\t2\t3\n")
    assert tables.read_tsv(spark, f"{tmp_path}/n.csv").columns == ["a", "_c"]
    assert tables.output_name("x.cha.gz", ".parsed.csv") == "x.parsed.csv" and tables.output_name("x.parsed.csv", "coded") == "x.parsed.coded.csv"
    last = coding.last_rows(spark.createDataFrame([("a", 1, "p"), ("b", 2, "q"), ("a", 3, "r")], "utt_id string, line int, v string"))
    assert sorted(tuple(r) for r in last.collect()) == [("a", 1, "r"), ("b", 2, "q")]


def test_one_part_is_numbered_by_many_tasks(spark):
    """Parts of many runs, of one, without a name; keys without a value come first, no task gets a large part whole."""
    rows = [("big", k if k != 17 else None, k) for k in range(3000)] + [(p, k, k) for p in ("s", None) for k in range(7)] + [(f"p{k}", 0, k) for k in range(50)]
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame(rows, "f string, o int, v int").repartition(4)
    out = pages.numbered_pages(df, 20, ["o"], ["f"])
    assert out.columns == ["f", "o", "v", "page", "pages"]
    got = out.withColumn("task", F.spark_partition_id()).collect()
    want = {}
    for f in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == f), key=lambda r: -1 if r[1] is None else r[1])
        want |= {(f, r[2]): (k // 20, -(-len(own) // 20)) for k, r in enumerate(own)}
    assert len(got) == len(rows) and {(r["f"], r["v"]): (r["page"], r["pages"]) for r in got} == want
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in pages.numbered_pages(df, 20, ["o"], ["f"]).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes) == len(rows) and max(sizes) < 0.6 * len(rows)
    assert pages.numbered_pages(df.filter("v < 0"), 20, ["o"], ["f"]).count() == 0


def test_coded_table_as_one_file_is_written_by_many_tasks(spark, tmp_path, monkeypatch):
    """What is joined to the file of s16 are parts of several tasks."""
    from utterloom import queries

    parts = []
    plain = tables._join
    monkeypatch.setattr(tables, "_join", lambda s, path, names, *a: parts.extend(names) or plain(s, path, names, *a))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        n = queries.QUERIES["s16_coded_file"](spark, "/root/testdata/sf0.001").count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert n > 0 and len(parts) > 1


def test_rules_look_at_a_token_again_only_when_it_changed(monkeypatch):
    """The features looked at grow with the tokens and steps, not with their product."""
    calls = []
    plain = rewrite._holds
    monkeypatch.setattr(rewrite, "_holds", lambda *a: calls.append(a) or plain(*a))
    rules = language.parse_grammar('rule r { pattern { V [upos=VERB, !seen] } commands { V.seen = "1" } }').rules_of("main")
    g = rewrite.parse_graph(lines(*[("v", "VERB", max(k, 0), "x") for k in range(200)]))
    assert rewrite.normal_form(g, rules) == 200 and all(g.misc[n] == {"seen": "1"} for n in g.order)
    assert len(calls) < 10 * 200


def test_tokens_of_the_coded_file_are_not_dealt_by_key(spark, monkeypatch):
    """No exchange of tokens, whose tasks would read more the larger the table; tokens of a sentence stay below each other."""
    from utterloom import queries

    plans = []
    plain = tables.write_tsv
    monkeypatch.setattr(tables, "write_tsv", lambda df, *a, **k: plans.append(df._jdf.queryExecution().executedPlan().toString()) or plain(df, *a, **k))
    out = queries.QUERIES["s16_coded_file"](spark, "/root/testdata/sf0.001")
    assert len(plans) == 1 and "hashpartitioning" not in plans[0]
    places = {}
    for k, r in enumerate(out.coalesce(1).collect()):
        sid, _, n = r["value"].split("\t")[0].rpartition("_w")
        places.setdefault(sid, []).append((int(n), k))
    assert places and all([n for n, _ in p] == list(range(1, len(p) + 1)) and p[-1][1] - p[0][1] == len(p) - 1 for p in places.values())


def test_tokens_with_one_value_are_tested_once(monkeypatch):
    """The features looked at grow with the values of a sentence, not with its tokens; the next sentence looks at none again."""
    calls = []
    plain = rewrite._holds
    monkeypatch.setattr(rewrite, "_holds", lambda *a: calls.append(a) or plain(*a))
    rules = language.parse_grammar('rule r { pattern { V [upos=VERB]; N [form=/^a|b$/i]; e: V -[obj]-> N } commands { del_edge e; add_edge V -[iobj]-> N } } rule s { pattern { X -[root]-> V; V [!seen] } commands { V.seen = "1" } }').rules_of("main")
    prepared = rewrite.searches(rules)
    for _ in range(2):
        g = rewrite.parse_graph(lines(*[(f"A{k % 3}", "NOUN" if k else "VERB", min(k, 1), "obj" if k else "root") for k in range(300)]))
        assert rewrite.normal_form(g, rules, prepared=prepared) == 300
        assert [x for _, x, _ in g.edges] == ["root"] + ["iobj"] * 299 and [n for n in g.order if g.misc[n]] == ["1"]
    assert len(calls) < 20


def test_features_of_odd_values_and_nodes():
    """Values that stand for none, features that are in both fields, a token with the number 0."""
    block = "\n".join("\t".join(f) for f in [["0", "x", "_", "_", "_", "_", "_", "_", "_", "_"], ["1", "_", "_", "_", "_", "A=1", "0", "root", "_", "A=2"], ["2", "y", "y", "", "_", "_", "1", "obj", "_", "A=2"], ["3", "y", "_", "N", "_", "B=1", "1", "obj", "_", "_"]])
    for given in (block, block.split("\n", 1)[1]):
        for test in ("!A", "A=1", "A=2", "lemma=y", "!lemma", "!upos", 'upos=""', "word=_", "form=_", "!form"):
            pattern, without = language.parse_pattern("pattern { N [" + test + "] }")
            g = rewrite.parse_graph(given)
            f = pattern.nodes[0][1][0][0]
            want = [n for n in g.order if n != "0" and rewrite._holds(g.feature(n, f.name), f, {})]
            assert [m["N"] for m in rewrite.find(g, pattern, without)] == want, test


def test_blocks_of_plain_and_other_sentences(spark):
    """Tokens in order are written as they stand; others, ranges and empty nodes in their places."""
    row = lambda i: f"{i}\tw\tw\tN\t_\tA=1\t0\tx\t_\tB=|C=2"
    given = [["1", "2", "3"], ["1-2", "1", "2", "2.1", "3"], ["3", "1", "2"], ["01", "2"], ["2", "10", "3"], []]
    blocks = spark.createDataFrame([("\n".join(["# item_id = s"] + [row(i) for i in ids]),) for ids in given], "block string").coalesce(1)
    sorted_ = [["1", "2", "3"], ["1-2", "1", "2", "2.1", "3"], ["1", "2", "3"], ["01", "2"], ["2", "3", "10"], []]
    want = ["\n".join(["# item_id = s"] + [row(i) for i in ids]) for ids in sorted_]
    g = conllu.graphs(blocks)
    assert [r["block"] for r in conllu.to_blocks(g).collect()] == want
    assert [r["block"] for r in conllu.to_blocks(g.drop("others")).collect()] == [w for w in ["\n".join(x for x in w.split("\n") if x.split("\t")[0].isdigit() or x[0] == "#") for w in want]]
    backwards = g.withColumn("nodes", F.reverse("nodes"))
    assert [r["block"] for r in conllu.to_blocks(backwards).collect()] == want


@pytest.mark.parametrize(("gzip", "plain"), [(False, False), (True, False), (True, True)])
def test_one_file_is_written_by_all_tasks(spark, tmp_path, gzip, plain):
    """One file with one header, rows in their order; tasks without rows add nothing; appending adds a file."""
    import gzip as gz

    df = spark.range(0, 400, 1, 8).filter("id < 100 OR id >= 200").selectExpr("id", "concat('x', id) v", "spark_partition_id() p")
    end = "\r\n" if plain else "\n"
    tables.write_tsv(df.drop("p"), f"{tmp_path}/t", one=True, gzip=gzip, plain=plain)
    tables.write_tsv(df, f"{tmp_path}/tasks", ["id", "p"], one=True, gzip=gzip, plain=plain)
    (file,) = (tmp_path / "t").glob("part-*")
    text = (gz.open(file) if gzip else open(file, "rb")).read().decode()
    ids = [*range(100), *range(200, 400)]
    assert text == end.join(["id\tv", *[f"{k}\tx{k}" for k in ids], ""]) and not list((tmp_path / "t").glob("_j*"))
    back = spark.read.option("lineSep", end).text(f"{tmp_path}/t")
    assert [r["value"] for r in back.collect()] == text.split(end)[:-1]
    #: The task of each row, as it was when its line was made.
    seen = spark.read.option("lineSep", end).text(f"{tmp_path}/tasks").filter("value <> 'id\tp'").selectExpr("split(value, '\t')[1] p").distinct().count()
    tables.write_tsv(df.filter("id < 0"), f"{tmp_path}/empty", one=True, gzip=gzip)
    assert seen == 6 and spark.read.text(f"{tmp_path}/empty").count() == 0
    tables.write_tsv(df.drop("p"), f"{tmp_path}/t", mode="append", one=True, gzip=gzip, plain=plain)
    assert len(list((tmp_path / "t").glob("part-*"))) == 2 and spark.read.option("lineSep", end).text(f"{tmp_path}/t").count() == 2 * 301


def test_light_coded_by_name_and_place(spark, graph):
    g = coding.code(graph, language.parse_rules(RULES))
    tok = g.select("item_id", F.explode("nodes").alias("n")).select(F.concat("item_id", F.lit("_w"), "n.id").alias("utt_id"), F.lit(1).alias("utt_nr"), F.col("n.pos").alias("w_nr"), *[F.lit("s").alias(c) for c in ("speaker", "child_project", "language", "child_other", "age", "age_days", "time_code")], F.col("n.form").alias("word"), F.lit("u").alias("utterance"), F.lit("").alias("utt_clean"), "item_id", F.col("n.pos").alias("conll_id"))
    full = coding.merge(table.finalise(tok, conllu.token_rows(g)), g, ["pp", "subj"])
    rows = table.light_coded(full).collect()
    assert [(r["utt_id"], r["pos"], r["subj"]) for r in rows] == [("7_u1_w3", "VERB", "first;second")]
    assert table.light_coded(full.drop("item_id"), strict_positional=True).count() == 0
    assert table.light(full, "NOUN|PRON").count() == 2 and table.light(full).columns == table.LIGHT


def test_pages(graph):
    p = pages.numbered_pages(graph.withColumn("project", F.lit("Geneva")).withColumn("f", F.lit("x")), 1, ["n"], ["f"]).withColumn("n", F.struct("n"))
    info = graph.select("item_id", F.lit("Marie_Gen").alias("child_project"), F.lit("CHI").alias("speaker"), F.lit("2;06.10").alias("age"), F.lit("a <b>").alias("utterance"))
    r = pages.pages(p, info, "t").collect()[0]
    assert r["file"] == "Gen0.html" and "a &ltb&gt" in r["html"] and '<section id="7_u1">' in r["html"] and "CHI, 2;06.10" in r["html"]
    assert "04........ <b>à</b>" in r["html"] and "&#8594;5" in r["html"] and ">on</a>" not in r["html"]
    assert pages.links(p, "html").collect()[0]["local"] == "html/Gen0.html"


def test_micro_batches_equal_batch(spark, tmp_path):
    rnd = random.Random(9)
    (tmp_path / "in").mkdir()
    blocks = [random_block(rnd, k) for k in range(40)]
    for k in range(4):
        (tmp_path / "in" / f"f{k}.conllu").write_text("\n\n".join(blocks[10 * k : 10 * k + 10]) + "\n", encoding="utf8")
    rules = language.parse_rules(RULES)
    parts: list = []
    nodes: list = []
    q = micro.code_stream(micro.stream_blocks(spark, f"{tmp_path}/in", 1), rules, lambda g, n: parts.append((n, [(r["item_id"], r["meta"].get("coding")) for r in g.collect()])), f"{tmp_path}/cp")
    q.awaitTermination(120)
    whole = conllu.graphs(spark.createDataFrame([(b,) for b in blocks], "block string"))
    want = sorted((r["item_id"], r["meta"].get("coding") or "") for r in coding.code(whole, rules).collect())
    q = micro.code_stream(micro.stream_blocks(spark, f"{tmp_path}/in", 4, large=True), rules, lambda g, n: nodes.extend(x["misc"] for r in g.collect() for x in r["nodes"]), f"{tmp_path}/cp3", code_node=True)
    q.awaitTermination(120)
    assert any("coding" in x for x in nodes)
    assert len(parts) == 4 and sorted((i, c or "") for _, p in parts for i, c in p) == want


def test_stream_files_are_split_among_tasks(spark, tmp_path):
    """Also where some blank lines have spaces or stand in rows."""
    rnd = random.Random(4)
    (tmp_path / "in").mkdir()
    text = "".join(random_block(rnd, k) + rnd.choice(["\n\n", "\n\n", "\n\n\n", "\n \n", "\n\n \t\n", "\n \n\n"]) for k in range(200))
    (tmp_path / "in" / "f.conllu").write_text(text, encoding="utf8")
    got, tasks = [], []
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        b = micro.stream_blocks(spark, f"{tmp_path}/in")
        q = b.writeStream.foreachBatch(lambda d, n: (tasks.append(d.rdd.getNumPartitions()), got.extend(r["block"].strip() for r in d.collect()))).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        q.awaitTermination(120)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(got) == sorted(r["block"].strip() for r in conllu.read_blocks(spark, f"{tmp_path}/in").collect()) and len(got) == 200
    assert max(tasks) > 2


def test_numbers_go_on_between_batches(spark, tmp_path):
    """As in batch: a PID that changes starts anew, also when it comes back; a missing one goes on."""
    from utterloom.sources import chat

    schema = "file string, pid string, session long, block long, utterance string"
    pids = [None, "1", "1", "2", None, "1", "1", None]
    rows = [(f, p, k, b, "x") for f in "fg" for k, p in enumerate(pids) for b in range(2)]
    src = tmp_path / "u"
    for part in (rows[:7] + rows[16:20], rows[7:16] + rows[20:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(str(src))
    s = micro.number_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(src)))
    q = s.writeStream.format("memory").queryName("numbered").option("checkpointLocation", f"{tmp_path}/cp2").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(180)
    batch = chat.numbered(spark.createDataFrame(rows, schema))
    key = ["file", "session", "block", "pid", "utt_nr", "utt_id"]
    got = sorted(tuple(r) for r in spark.table("numbered").select(*key).collect())
    assert got == sorted(tuple(r) for r in batch.select(*key).collect()) and len(got) == 32
