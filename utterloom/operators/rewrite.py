"""Rule-based rewriting of sentence graphs to a normal form.

A sentence is rewritten on its own: while rules apply, heads can be missing or doubled, so
the work is on a small graph of edges in plain Python, in Arrow batches of CoNLL-U texts.
Nothing is shuffled, and no Spark job is started per round.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import compress

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..plans.language import Block, Feature, Grammar, Label, Rewrite

#: Without a limit of their own, sentences may take so many steps, and so many more for each token and rule.
STEPS, STEPS_EACH = 200, 10
#: Sentences that are Python objects at one time.
ROWS = 128
#: Values of a feature whose tests are remembered before they are forgotten.
VALUES = 10_000
FIELDS = {"form": 1, "lemma": 2, "upos": 3, "xpos": 4}


@dataclass
class Graph:
    """head: comment lines; nodes: id -> ten fields; feats, misc: ordered maps; edges: (source id, label, target id)."""

    head: list[str]
    order: list[str]
    nodes: dict[str, list[str]]
    feats: dict[str, dict[str, str]]
    misc: dict[str, dict[str, str]]
    edges: list[tuple[str, str, str]] = field(default_factory=list)

    def feature(self, n: str, name: str) -> str | None:
        if n == "0":
            return None
        if name in FIELDS:
            v = self.nodes[n][FIELDS[name]]
            return None if v == "_" else v
        if name == "word":
            return self.nodes[n][1]
        return self.feats[n].get(name, self.misc[n].get(name))

    def raw(self, nodes: list[str], name: str) -> list[str | None]:
        """What `feature` of each node depends on: the same for two nodes (not 0) only if their features are."""
        if name in FIELDS or name == "word":
            k = FIELDS.get(name, 1)
            return [self.nodes[n][k] for n in nodes]
        feats, misc = self.feats, self.misc
        return [feats[n].get(name, misc[n].get(name)) if feats[n] or misc[n] else None for n in nodes]

    def set(self, n: str, name: str, value: str) -> None:
        if name in FIELDS:
            self.nodes[n][FIELDS[name]] = value
        elif name in self.feats[n]:
            self.feats[n][name] = value
        else:
            self.misc[n][name] = value


def _pairs(s: str) -> dict[str, str]:
    return {} if s in ("_", "") else {k: v for k, _, v in (x.partition("=") for x in s.split("|"))}


def _text(d: dict[str, str]) -> str:
    return "|".join(f"{k}={v}" for k, v in d.items()) or "_"


def parse_graph(block: str) -> Graph:
    g = Graph([], [], {}, {}, {})
    order, nodes, feats, misc, edges = g.order, g.nodes, g.feats, g.misc, g.edges
    for line in block.split("\n"):
        if line.startswith("#"):
            g.head.append(line)
            continue
        f = line.split("\t")
        if len(f) == 10:
            i, head = f[0], f[6]
            order.append(i)
            nodes[i] = f
            feats[i] = {} if f[5] == "_" else _pairs(f[5])
            misc[i] = {} if f[9] == "_" else _pairs(f[9])
            if i.isdigit() and head.isdigit():
                edges.append((head, f[7], i))
    return g


def graph_text(g: Graph) -> str:
    """The first head of a token is written; a token without one has `_`."""
    first: dict[str, tuple[str, str]] = {}
    for s, label, t in g.edges:
        first.setdefault(t, (s, label))
    out = list(g.head)
    nodes, feats, misc = g.nodes, g.feats, g.misc
    for i in g.order:
        f = nodes[i][:]
        x, y = feats[i], misc[i]
        f[5], f[9] = _text(x) if x else "_", _text(y) if y else "_"
        if i.isdigit():
            f[6], f[7] = first.get(i, ("_", "_"))
        out.append("\t".join(f))
    return "\n".join(out)


def _holds(v: str | None, f: Feature, lexicons: dict) -> bool:
    if f.kind == "absent":
        return v is None
    if v is None:
        return False
    if f.kind == "equal":
        return v in f.values
    if f.kind == "regex":
        return re.search(f.values[0], v, re.I if f.ignore_case else 0) is not None
    if f.kind == "whole":
        return re.fullmatch(f.values[0], v) is not None
    return v in lexicons[f.values[0]][f.values[1]]


def _label(label: str, labels: tuple[Label, ...]) -> bool:
    if not labels:
        return True
    return any(
        label == x.value if x.kind == "full" else label.split(":")[0] == x.value if x.kind == "main" else re.fullmatch(x.value, label) is not None for x in labels
    )


class Index:
    """A graph's tokens, and its edges by their ends and labels. It follows the changes of `apply`."""

    def __init__(self, g: Graph) -> None:
        self.g = g
        self.tokens = [i for i in g.order if i.isdigit()]
        self.place = {n: k for k, n in enumerate(self.tokens)}
        self.up: dict[str, list[tuple[str, str]]] = {}
        self.down: dict[str, list[tuple[str, str]]] = {}
        self.ends: dict[str, list[tuple[str, str]]] = {}
        up, down, ends = self.up, self.down, self.ends
        for s, x, t in g.edges:
            up.setdefault(t, []).append((s, x))
            down.setdefault(s, []).append((t, x))
            ends.setdefault(x, []).append((s, t))
        #: What nodes were found to fit, and their tokens in order: (block, name) -> node -> bool, (block, name) -> tokens.
        self.fit: dict[tuple[int, str], dict[str, bool]] = {}
        self.fitting: dict[tuple[int, str], list[str]] = {}
        #: Nodes whose features have changed since such a list was made, and whether they were in it.
        self.stale: dict[tuple[int, str], dict[str, bool]] = {}
        self.marks: dict[str, int] = {}
        self.mark: int | None = None

    def add(self, e: tuple[str, str, str]) -> None:
        s, x, t = e
        self.up.setdefault(t, []).append((s, x))
        self.down.setdefault(s, []).append((t, x))
        self.ends.setdefault(x, []).append((s, t))

    def remove(self, e: tuple[str, str, str]) -> None:
        s, x, t = e
        self.up[t].remove((s, x))
        self.down[s].remove((t, x))
        self.ends[x].remove((s, t))
        if not self.ends[x]:
            del self.ends[x]

    def touch(self, n: str) -> None:
        """Features of n have changed."""
        for k, d in self.fit.items():
            had = d.pop(n, None)
            if k in self.fitting and had is not None:
                self.stale.setdefault(k, {}).setdefault(n, had)
        self.marks.pop(n, None)
        self.mark = None

    def state(self) -> int:
        """A digest of all that rules can change (graph_state); only nodes that were touched are digested anew."""
        if self.mark is None:
            marks, feats, misc = self.marks, self.g.feats, self.g.misc
            for n, f in self.g.nodes.items():
                if n not in marks:
                    x, y = feats[n], misc[n]
                    marks[n] = hash((tuple(f), tuple(x.items()) if x else (), tuple(y.items()) if y else ()))
            self.mark = hash(tuple([marks[n] for n in self.g.nodes]))
        return hash((tuple(self.g.edges), self.mark))


class Search:
    """A pattern with its `without`, prepared for many graphs."""

    def __init__(self, pattern: Block, without: list[Block], lexicons: dict | None = None, injective: bool = True) -> None:
        self.pattern, self.without, self.lexicons, self.injective = pattern, without, lexicons or {}, injective
        self.options: dict[tuple[int, str], list] = {}
        self.named: dict[tuple[int, str], bool] = {}
        #: The feature of names that are tested for one only, and what was found for its values.
        self.only: dict[tuple[int, str], str] = {}
        self.values: dict[tuple[int, str], dict[str | None, bool]] = {}
        self.edges: dict[tuple[int, str], list] = {}
        self.orders: dict[tuple[int, str], list] = {}
        self.free: dict[tuple[int, str], bool] = {}
        self.labels: dict[int, dict[str, bool]] = {}
        self.ways: dict[int, list[str]] = {}
        for b in (pattern, *without):
            for name in {*b.names, *pattern.names}:
                k = id(b), name
                self.options[k] = [o for w, o in b.nodes if w == name]
                self.named[k] = any(any(o) for o in self.options[k])
                tested = {f.name for options in self.options[k] for o in options for f in o}
                if len(tested) == 1:
                    self.only[k], self.values[k] = tested.pop(), {}
                self.edges[k] = [e for e in b.edges if name in (e.source, e.target)]
                self.orders[k] = [o for o in b.orders if name in (o.left, o.right)]
                self.free[k] = any(e.source == name for e in b.edges) and not self.options[k] and not any(e.target == name for e in b.edges)

    def takes(self, e, label: str) -> bool:
        if not e.labels:
            return True
        known = self.labels.setdefault(id(e), {})
        got = known.get(label)
        if got is None:
            got = known[label] = _label(label, e.labels)
        return got

    def fits(self, index: Index, b: Block, name: str, n: str) -> bool:
        k = id(b), name
        known = index.fit.get(k)
        if known is None:
            known = index.fit[k] = {}
        got = known.get(n)
        if got is None:
            got = known[n] = self.holds(index.g, k, n)
        return got

    def holds(self, g: Graph, k: tuple[int, str], n: str) -> bool:
        for options in self.options[k]:
            for o in options:
                for f in o:
                    if not _holds(g.feature(n, f.name), f, self.lexicons):
                        break
                else:
                    break
            else:
                return False
        return True

    def held(self, g: Graph, k: tuple[int, str], nodes: list[str]) -> list[bool]:
        """`holds` of many nodes; where it depends on one feature, once for each value."""
        known, raw = self.values[k], g.raw(nodes, self.only[k])
        if len(known) > VALUES:
            known.clear()
        for v, n in {v: n for n, v in zip(nodes, raw, strict=True) if v not in known}.items():
            known[v] = self.holds(g, k, n)
        return [known[v] for v in raw]

    def fitting(self, index: Index, b: Block, name: str) -> list[str]:
        k = id(b), name
        if not self.named[k]:
            return index.tokens
        got, stale = index.fitting.get(k), index.stale.pop(k, None)
        if got is None and k in self.only and k not in index.fit and "0" not in index.place:
            found = self.held(index.g, k, index.tokens)
            index.fit[k] = dict(zip(index.tokens, found, strict=True))
            got = index.fitting[k] = list(compress(index.tokens, found))
        elif got is None or (stale and any(self.fits(index, b, name, n) != had for n, had in stale.items())):
            known, g = index.fit.setdefault(k, {}), index.g
            for n in index.tokens:
                if n not in known:
                    known[n] = self.holds(g, k, n)
            got = index.fitting[k] = [n for n in index.tokens if known[n]]
        return got

    def possible(self, index: Index) -> bool:
        """False where an edge of the pattern has no edge with its label, or a named token no token with its features."""
        b = self.pattern
        if any(e.labels and not any(self.takes(e, x) for x in index.ends) for e in b.edges):
            return False
        return all(not any(o) or self.fitting(index, b, w) for w, o in b.nodes)

    def linked(self, index: Index, b: Block, got: dict[str, str], name: str) -> bool:
        k = id(b), name
        for e in self.edges[k]:
            s, t = got.get(e.source), got.get(e.target)
            if s is not None and t is not None:
                for end, x in index.down.get(s, ()):
                    if end == t and self.takes(e, x):
                        break
                else:
                    return False
        for o in self.orders[k]:
            if o.left in got and o.right in got:
                left, right = int(got[o.left]), int(got[o.right])
                if not left or not right or (right != left + 1 if o.next_to else left >= right):
                    return False
        return True

    def candidates(self, index: Index, b: Block, name: str, got: dict[str, str]) -> list[str]:
        k = id(b), name
        labelled = None
        for e in self.edges[k]:
            if e.source == name and e.target in got:
                return [s for s, _ in index.up.get(got[e.target], ())]
            if e.target == name and e.source in got:
                return [t for t, _ in index.down.get(got[e.source], ())]
            labelled = labelled or (e if e.labels else None)
        if labelled is not None and len(index.place) == len(index.tokens):
            #: Only ends of edges with such a label can do, in the same order.
            end = 0 if labelled.source == name else 1
            ends = {p[end] for x, pairs in index.ends.items() if self.takes(labelled, x) for p in pairs}
            near = sorted((n for n in ends if n in index.place), key=index.place.__getitem__)
            return ["0", *near] if self.free[k] and "0" in ends else near
        return [*(["0"] if self.free[k] else []), *self.fitting(index, b, name)]

    def along(self, b: Block, known: set[str]) -> list[str]:
        left, out, seen = [n for n in b.names if n not in known], [], set(known)
        while left:
            near = [n for n in left if any((e.source == n and e.target in seen) or (e.target == n and e.source in seen) for e in b.edges)]
            best = (near or [n for n in left if any(w == n and any(o) for w, o in b.nodes)] or left)[0]
            out.append(best)
            seen.add(best)
            left.remove(best)
        return out

    def extend(self, index: Index, b: Block, names: list[str], k: int, got: dict[str, str]) -> Iterator[dict[str, str]]:
        if k == len(names):
            yield got
            return
        name = names[k]
        named = self.named[id(b), name]
        for n in self.candidates(index, b, name, got):
            if (self.injective and n in got.values()) or (n == "0" and named):
                continue
            new = got | {name: n}
            if self.fits(index, b, name, n) and self.linked(index, b, new, name):
                yield from self.extend(index, b, names, k + 1, new)

    def blocked(self, index: Index, w: Block, got: dict[str, str]) -> bool:
        own = {k: v for k, v in got.items() if k in w.names}
        if not all(self.fits(index, w, k, v) and self.linked(index, w, own, k) for k, v in own.items()):
            return False
        if id(w) not in self.ways:
            self.ways[id(w)] = self.along(w, set(got))
        return next(self.extend(index, w, self.ways[id(w)], 0, dict(got if self.injective else own)), None) is not None

    def __call__(self, index: Index) -> Iterator[dict[str, str]]:
        """Bindings (name -> node id), as they are found: names along edges and orders, places in order."""
        if not self.possible(index):
            return
        b = self.pattern
        if id(b) not in self.ways:
            self.ways[id(b)] = self.along(b, set())
        for m in self.extend(index, b, self.ways[id(b)], 0, {}):
            if not any(self.blocked(index, w, m) for w in self.without):
                yield m


def find(g: Graph, pattern: Block, without: list[Block], lexicons: dict | None = None, injective: bool = True, index: Index | None = None) -> Iterator[dict[str, str]]:
    """Bindings (name -> node id) of a pattern, as they are found: names along edges and orders, places in order."""
    return Search(pattern, without, lexicons, injective)(index or Index(g))


def apply(g: Graph, r: Rewrite, m: dict[str, str], index: Index | None = None) -> bool:
    """Runs the commands of r on a match; False if they change nothing."""
    index = index or Index(g)
    touched = [m[c.args[0]] for c in r.commands if c.kind == "set"]
    before = (list(g.edges), [(list(g.nodes[k]), dict(g.feats[k]), dict(g.misc[k])) for k in touched])
    named = {e.ident: e for e in r.pattern.edges if e.ident}
    for c in r.commands:
        if c.kind == "del_edge":
            e = named[c.args[0]]
            source, target = m[e.source], m[e.target]
            k = next((k for k, (s, x, t) in enumerate(g.edges) if s == source and t == target and _label(x, e.labels)), None)
            if k is not None:
                index.remove(g.edges.pop(k))
        elif c.kind == "add_edge":
            new = (m[c.args[0]], c.args[1], m[c.args[2]])
            if new not in g.edges:
                g.edges.append(new)
                index.add(new)
        else:
            node, feature, parts = c.args
            g.set(m[node], feature, "".join(p[1] if p[0] == "text" else g.feature(m[p[1]], p[2]) or "" for p in parts))
            index.touch(m[node])
    return before != (g.edges, [(g.nodes[k], g.feats[k], g.misc[k]) for k in touched])


def searches(rules: list[Rewrite], lexicons: dict | None = None) -> list[Search]:
    return [Search(r.pattern, r.without, (lexicons or {}).get(r.name)) for r in rules]


def normal_form(g: Graph, rules: list[Rewrite], lexicons: dict | None = None, max_steps: int | None = None, prepared: list[Search] | None = None) -> int:
    """Applies the first rule that changes the graph until none does; the number of steps.

    Raises when a state comes again, or (rules that let a graph grow) after more steps than the limit,
    by default STEPS and STEPS_EACH for each token and rule. prepared: `searches` of the rules, to be used for many graphs.
    """
    limit = STEPS + STEPS_EACH * len(g.order) * len(rules) if max_steps is None else max_steps
    prepared = prepared or searches(rules, lexicons)
    index = Index(g)
    seen: set[int] = set()
    for step in range(limit + 1):
        for r, search in zip(rules, prepared, strict=True):
            changed = False
            for m in search(index):
                if not seen:
                    seen.add(index.state())
                changed = apply(g, r, m, index)
                if changed:
                    break
            if changed:
                break
        else:
            return step
        state = index.state()
        if state in seen:
            raise RuntimeError(f"no normal form: a state comes again after {step + 1} steps")
        seen.add(state)
    raise RuntimeError(f"no normal form after {limit} steps")


def graph_state(g: Graph) -> tuple:
    """All that rules can change, in the order it is in."""
    return tuple(g.edges), tuple(tuple(f) for f in g.nodes.values()), tuple(tuple(f.items()) for f in g.feats.values()), tuple(tuple(f.items()) for f in g.misc.values())


def rewrite(blocks: DataFrame, grammar: Grammar, lexicons: dict[str, dict[str, set[str]]] | None = None, strategy: str = "main", block: str = "block", max_steps: int | None = None) -> DataFrame:
    """blocks with rewritten texts, `rewrite_steps`, and `rewrite_error` (null, or why the sentence stayed as it was).

    lexicons: file name -> column -> values. Other columns stay.
    """
    rules = grammar.rules_of(strategy)
    own = {r.name: {r.lexicon[0]: (lexicons or {})[r.lexicon[1]]} for r in rules if r.lexicon}

    names = [f for f in blocks.schema.fields if f.name not in ("rewrite_steps", "rewrite_error")]
    at = [f.name for f in names].index(block)

    def one(t: str | None, prepared: list[Search]) -> tuple[str | None, int, str | None]:
        try:
            g = parse_graph(t)
            n = normal_form(g, rules, own, max_steps, prepared)
            return graph_text(g) if n else t, n, None
        except Exception as e:  # the sentence stays, its error is reported with it
            return t, 0, f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prepared = searches(rules, own)
        for b in batches:
            for k in range(0, b.num_rows, ROWS):
                part = b.slice(k, ROWS)
                texts, steps, errors = zip(*[one(t, prepared) for t in part.column(at).to_pylist()], strict=True)
                columns = [pa.array(texts, c.type) if i == at else c for i, c in enumerate(part.columns)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(steps, pa.int32()), pa.array(errors, pa.string())], names=[*part.schema.names, "rewrite_steps", "rewrite_error"])
            b = part = columns = None  # not held while the next batch is read

    schema = StructType([*names, StructField("rewrite_steps", IntegerType()), StructField("rewrite_error", StringType())])
    return blocks.select(*[F.col(f"`{f.name}`") for f in names]).mapInArrow(run, schema)
