"""Patterns over dependency trees as column expressions.

A sentence is one row with an array of nodes, and no pattern crosses a sentence. So a rule
becomes nested higher-order functions over that array: no join, no shuffle, and all rules
of a query run in one pass. A node's head is looked up by its place in the array.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.plan import once
from ..plans.language import Block, Edge, Feature, Label, Rule

NODE = (
    "struct<id string, pos int, form string, lemma string, upos string, xpos string, feats map<string,string>, "
    "head int, deprel string, deps string, misc map<string,string>>"
)
MATCH = "struct<rule int, att string, val string, node string, head string, lemma string, bound array<int>>"
FIELDS = ("form", "lemma", "upos", "xpos")


def root_node() -> Column:
    """The virtual node 0, the source of root edges."""
    none = F.lit(None).cast("string")
    empty = F.lit(None).cast("map<string,string>")
    return F.struct(
        F.lit("0").alias("id"), F.lit(0).alias("pos"), none.alias("form"), none.alias("lemma"), none.alias("upos"), none.alias("xpos"),
        empty.alias("feats"), F.lit(None).cast("int").alias("head"), none.alias("deprel"), none.alias("deps"), empty.alias("misc"),
    )


def feature_of(n: Column, name: str) -> Column:
    """A column field, else a feature, else a miscellaneous one; `_` in fields is none."""
    if name in FIELDS:
        return F.nullif(n[name], F.lit("_"))
    if name == "word":
        return n["form"]
    return F.coalesce(F.try_element_at(n["feats"], F.lit(name)), F.try_element_at(n["misc"], F.lit(name)))


def holds(n: Column, f: Feature, lexicons: dict[str, dict[str, set[str]]]) -> Column:
    v = feature_of(n, f.name)
    if f.kind == "absent":
        return v.isNull()
    if f.kind == "equal":
        hit = v.isin(*f.values)
    elif f.kind == "regex":
        hit = v.rlike(("(?iu)" if f.ignore_case else "") + f.values[0])
    elif f.kind == "whole":
        hit = v.rlike(f"^(?:{f.values[0]})$")
    else:
        hit = v.isin(*sorted(lexicons[f.values[0]][f.values[1]]))
    return F.coalesce(hit, F.lit(False))


def label_holds(deprel: Column, labels: tuple[Label, ...]) -> Column | None:
    tests = []
    for x in labels:
        if x.kind == "full":
            tests.append(deprel == x.value)
        elif x.kind == "main":
            tests.append((deprel == x.value) | deprel.startswith(x.value + ":"))
        else:
            tests.append(deprel.rlike(f"^(?:{x.value})$"))
    return reduce(lambda a, b: a | b, tests) if tests else None


def _all(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, tests) if tests else F.lit(True)


class _Search:
    """Expressions of one block, given the nodes bound so far."""

    def __init__(self, nodes: Column, lexicons: dict, injective: bool) -> None:
        self.nodes, self.lexicons, self.injective = nodes, lexicons, injective

    def features(self, b: Block, name: str, n: Column) -> list[Column]:
        out = []
        for who, options in b.nodes:
            if who == name and any(options):
                out.append(reduce(lambda x, y: x | y, [_all([holds(n, f, self.lexicons) for f in o]) for o in options]))
        return out

    def edge(self, e: Edge, source: Column, target: Column) -> Column:
        hit = target["head"] == source["pos"]
        lab = label_holds(target["deprel"], e.labels)
        return hit if lab is None else hit & lab

    def order(self, o, left: Column, right: Column) -> Column:
        # node 0 stands in no order
        real = (left["pos"] > 0) & (right["pos"] > 0)
        return real & ((right["pos"] == left["pos"] + 1) if o.next_to else (left["pos"] < right["pos"]))

    def between(self, b: Block, name: str, n: Column, bound: dict[str, Column]) -> list[Column]:
        """Tests of name against the bound ones and itself."""
        both = bound | {name: n}
        out = [self.edge(e, both[e.source], both[e.target]) for e in b.edges if name in (e.source, e.target) and e.source in both and e.target in both]
        out += [self.order(o, both[o.left], both[o.right]) for o in b.orders if name in (o.left, o.right) and o.left in both and o.right in both]
        return out

    def candidates(self, b: Block, name: str, bound: dict[str, Column]) -> Column:
        """The nodes that name can be, fewest known first: its dependent's head, a neighbour, those before or behind another, else all."""
        for e in b.edges:
            if e.source == name and e.target in bound:
                head = bound[e.target]["head"]
                return F.when(head > 0, F.slice(self.nodes, head, F.lit(1))).otherwise(F.array(root_node()))
        for o in sorted(b.orders, key=lambda o: not o.next_to):
            if o.left == name and o.right in bound:
                at = bound[o.right]["pos"]
                return F.slice(self.nodes, F.greatest(at - 1, F.lit(1)), F.when(at > 1, 1).otherwise(0)) if o.next_to else F.slice(self.nodes, F.lit(1), F.greatest(at - 1, F.lit(0)))
            if o.right == name and o.left in bound:
                at = bound[o.left]["pos"]
                return F.slice(self.nodes, at + 1, F.lit(1) if o.next_to else F.greatest(F.size(self.nodes) - at, F.lit(0)))
        free = any(e.source == name for e in b.edges) and not any(w == name for w, _ in b.nodes) and not any(e.target == name for e in b.edges)
        return F.concat(self.nodes, F.array(root_node())) if free else self.nodes

    def ways(self, b: Block, name: str, bound: dict[str, Column]) -> Column:
        def good(n: Column) -> Column:
            # places and edges first: they are cheap and leave few nodes for the features
            tests = self.between(b, name, n, bound)
            if self.injective:
                tests += [n["pos"] != other["pos"] for other in bound.values()]
            tests += self.features(b, name, n)
            return F.coalesce(_all(tests), F.lit(False))

        return F.filter(self.candidates(b, name, bound), good)

    def plan(self, b: Block, known: set[str]) -> list[str]:
        """An order of binding: the most tested node first, then along edges, then along orders."""
        left, out, seen = [n for n in b.names if n not in known], [], set(known)

        def weight(n: str) -> tuple:
            up = any(e.source == n and e.target in seen for e in b.edges)
            down = any(e.target == n and e.source in seen for e in b.edges)
            near = any({o.left, o.right} - {n} <= seen and n in (o.left, o.right) for o in b.orders)
            tests = sum(len(o[0]) for w, o in b.nodes if w == n)
            dependent = any(e.target == n for e in b.edges)
            return (up, down, near, dependent, tests, -b.names.index(n))

        while left:
            best = max(left, key=weight)
            out.append(best)
            seen.add(best)
            left.remove(best)
        return out

    def absent(self, block: Block, bound: dict[str, Column]) -> Column:
        """NOT EXISTS of a without block."""
        fresh = self.plan(block, set(bound))
        own = {k: v for k, v in bound.items() if k in block.names}
        fixed = []
        for k in own:
            fixed += self.features(block, k, own[k])
        fixed += [self.edge(e, own[e.source], own[e.target]) for e in block.edges if e.source in own and e.target in own]
        fixed += [self.order(o, own[o.left], own[o.right]) for o in block.orders if o.left in own and o.right in own]

        def some(k: int, got: dict[str, Column]) -> Column:
            if k == len(fresh):
                return F.lit(True)
            if k == len(fresh) - 1:
                return F.size(self.ways(block, fresh[k], got)) > 0
            return F.exists(self.ways(block, fresh[k], got), lambda n: some(k + 1, got | {fresh[k]: n}))

        start = bound if self.injective else own
        return ~F.coalesce(_all([*fixed, some(0, dict(start))]), F.lit(False))

    def matches(self, pattern: Block, without: list[Block], result) -> Column:
        """Array of result(bound) for every match."""
        names = self.plan(pattern, set())

        def go(k: int, bound: dict[str, Column]) -> Column:
            name = names[k]
            found = self.ways(pattern, name, bound)
            if k < len(names) - 1:
                return F.flatten(F.transform(found, lambda n: go(k + 1, bound | {name: n})))
            if without:
                found = F.filter(found, lambda n: _all([self.absent(w, bound | {name: n}) for w in without]))
            return F.transform(found, lambda n: result(bound | {name: n}))

        return go(0, {})


def rule_matches(nodes: Column, r: Rule, injective: bool = True, lexicons: dict | None = None) -> Column:
    """Array of MATCH structs of one rule, ordered by the bound places."""
    if r.node not in r.pattern.names:  # the coded node must be in the pattern
        return F.array().cast(f"array<{MATCH}>")

    def result(b: dict[str, Column]) -> Column:
        who = b[r.node]
        head = b.get(r.add) if r.add else None
        real = head is not None
        return F.struct(
            F.lit(r.nr).alias("rule"), F.lit(r.att).alias("att"), F.lit(r.val).alias("val"), who["id"].alias("node"),
            (head["id"] if real else F.lit("0")).alias("head"),
            (F.when(head["pos"] > 0, F.coalesce(F.nullif(head["lemma"], F.lit("_")), F.lit("unknown"))) if real else F.lit(None).cast("string")).alias("lemma"),
            F.array(*[b[n]["pos"] for n in r.pattern.names]).alias("bound"),
        )

    found = _Search(nodes, lexicons or {}, injective).matches(r.pattern, r.without, result)
    #: Structs sort by their fields in order: the bound places first.
    placed = F.array_sort(F.transform(found, lambda m: F.struct(m["bound"].alias("b"), m.alias("m"))))
    return F.transform(placed, lambda x: x["m"]).cast(f"array<{MATCH}>")


def match(graphs: DataFrame, rules: list[Rule], injective: bool = True, lexicons: dict | None = None, nodes: str = "nodes") -> DataFrame:
    """graphs with `matches`: the matches of all rules, in order of rules, then of bound places."""
    per = [rule_matches(F.col(nodes), r, injective, lexicons) for r in rules]
    return graphs.withColumn("matches", once(F.flatten(F.array(*per))) if per else F.array().cast(f"array<{MATCH}>"))
