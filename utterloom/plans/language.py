"""The pattern language: coding queries and rewrite rules, parsed on the driver.

    query   := { "%" coding-line block+ } [ "exit" | "quit" rest ]
    block   := ("pattern" | "without") "{" { clause [";"] } "}"
    clause  := name featset { "|" [name] featset } | [edge-id ":"] name edge name { edge name } | name ("<" | "<<") name
    featset := "[" [ feature { "," feature } ] "]"
    feature := "!" name | name "=" value
    value   := string | bare { "|" bare } | "/" regex "/" ["i"] | 're"' regex '"' | lexicon "." field
    edge    := "->" | "-[" label { "|" label } "]->" ; label := bare | "1=" bare | 're"' regex '"'

A `%` begins a comment, except in strings and between slashes.
"""

from __future__ import annotations

import re
import warnings
from dataclasses import dataclass, field


class PatternError(ValueError):
    """A pattern that cannot be parsed."""


@dataclass(frozen=True)
class Feature:
    """kind: equal (one of values), regex (searched), whole (regex for all of it), absent, lexicon (values: name, field)."""

    name: str
    kind: str
    values: tuple[str, ...] = ()
    ignore_case: bool = False


@dataclass(frozen=True)
class Label:
    """kind: full, main (the part before the colon), whole (regex)."""

    kind: str
    value: str


@dataclass(frozen=True)
class Edge:
    source: str
    labels: tuple[Label, ...]  # any of them; none: any edge
    target: str
    ident: str | None = None


@dataclass(frozen=True)
class Order:
    left: str
    right: str
    next_to: bool


@dataclass
class Block:
    """nodes: (name, alternatives), all of which hold; names: in order of first appearance."""

    nodes: list[tuple[str, tuple[tuple[Feature, ...], ...]]] = field(default_factory=list)
    edges: list[Edge] = field(default_factory=list)
    orders: list[Order] = field(default_factory=list)
    names: list[str] = field(default_factory=list)

    def name(self, n: str) -> str:
        if n not in self.names:
            self.names.append(n)
        return n


@dataclass
class Rule:
    """A coding rule: attribute=value on node, with head add (or none)."""

    nr: int
    att: str
    val: str
    node: str
    add: str | None
    pattern: Block
    without: list[Block]


@dataclass
class Command:
    """kind: del_edge (edge), add_edge (source, label, target), set (node, feature, parts)."""

    kind: str
    args: tuple


@dataclass
class Rewrite:
    name: str
    package: str | None
    pattern: Block
    without: list[Block]
    commands: list[Command]
    lexicon: tuple[str, str] | None = None  # name, file


@dataclass
class Grammar:
    rules: list[Rewrite]
    strategies: dict[str, list[str]]

    def rules_of(self, strategy: str = "main") -> list[Rewrite]:
        """The rules of a strategy in its order; names of packages stand for their rules. Without that strategy, all rules."""
        if strategy not in self.strategies:
            return self.rules
        out: list[Rewrite] = []
        for n in self.strategies[strategy]:
            found = [r for r in self.rules if n in (r.name, r.package)]
            if not found:
                raise PatternError(f"strategy {strategy}: no rule or package {n}")
            out += found
        return out


NAME = re.compile(r"[A-Za-z_À-ÿ][\w:\-]*")
BARE = re.compile(r"[^\s\[\]{}|,;\"=<>()]+")


class Scanner:
    def __init__(self, text: str) -> None:
        self.text, self.at = text, 0

    def space(self) -> None:
        while self.at < len(self.text):
            c = self.text[self.at]
            if c == "%":
                end = self.text.find("\n", self.at)
                self.at = len(self.text) if end < 0 else end
            elif c.isspace():
                self.at += 1
            else:
                return

    def peek(self, s: str) -> bool:
        self.space()
        return self.text.startswith(s, self.at)

    def take(self, s: str) -> bool:
        if self.peek(s):
            self.at += len(s)
            return True
        return False

    def need(self, s: str) -> None:
        if not self.take(s):
            self.fail(f"expected {s!r}")

    def fail(self, what: str) -> None:
        raise PatternError(f"{what} at {self.text[self.at : self.at + 30]!r}")

    def match(self, pattern: re.Pattern, what: str) -> str:
        self.space()
        m = pattern.match(self.text, self.at)
        if not m:
            self.fail(f"expected {what}")
        self.at = m.end()
        return m.group()

    def name(self) -> str:
        return self.match(re.compile(r"\w+"), "a name")

    def until(self, end: str) -> str:
        """Raw text up to an unescaped end character, which is passed."""
        start = self.at
        while self.at < len(self.text) and self.text[self.at] != end:
            self.at += 2 if self.text[self.at] == "\\" else 1
        if self.at >= len(self.text):
            self.fail(f"no closing {end!r}")
        self.at += 1
        return self.text[start : self.at - 1]

    def done(self) -> bool:
        self.space()
        return self.at >= len(self.text)


def _feature(s: Scanner, lexicons: set[str]) -> Feature:
    if s.take("!"):
        return Feature(s.match(NAME, "a feature"), "absent")
    name = s.match(NAME, "a feature")
    s.need("=")
    if s.take('re"'):
        return Feature(name, "whole", (s.until('"'),))
    if s.take("/"):
        pattern = s.until("/")
        fold = s.text.startswith("i", s.at) and not re.match(r"\w\w", s.text[s.at : s.at + 2])
        s.at += fold
        return Feature(name, "regex", (pattern,), fold)
    values = []
    while True:
        values.append(s.until('"') if s.take('"') else s.match(BARE, "a value"))
        if not s.take("|"):
            break
    if len(values) == 1 and "." in values[0] and values[0].split(".")[0] in lexicons:
        return Feature(name, "lexicon", tuple(values[0].split(".", 1)))
    return Feature(name, "equal", tuple(values))


def _features(s: Scanner, lexicons: set[str]) -> tuple[Feature, ...]:
    s.need("[")
    out = []
    while not s.take("]"):
        out.append(_feature(s, lexicons))
        s.take(",")
    return tuple(out)


def _label(s: Scanner) -> Label:
    if s.take('re"'):
        return Label("whole", s.until('"'))
    if s.take("1="):
        return Label("main", s.match(re.compile(r"[^\s\]|]+"), "a label"))
    value = s.match(re.compile(r"[^\s\]|]+"), "a label")
    if "/" in value:
        warnings.warn(f"label {value!r} is taken literally", stacklevel=2)
    return Label("full", value)


def parse_block(s: Scanner, lexicons: set[str]) -> Block:
    s.need("{")
    b = Block()
    while not s.take("}"):
        if s.take(";"):
            continue
        first = s.name()
        ident = None
        if s.peek(":") and not s.peek("::"):
            s.take(":")
            ident, first = first, s.name()
        if s.peek("["):
            options = [_features(s, lexicons)]
            while s.take("|"):
                if not s.peek("["):
                    other = s.name()
                    if other != first:
                        s.fail(f"alternatives of {first} name {other}")
                options.append(_features(s, lexicons))
            b.nodes.append((b.name(first), tuple(options)))
        elif s.peek("<"):
            next_to = not s.take("<<")
            if next_to:
                s.need("<")
            b.orders.append(Order(b.name(first), b.name(s.name()), next_to))
        elif s.peek("-"):
            source = b.name(first)
            while s.peek("-"):
                labels: list[Label] = []
                if not s.take("->"):
                    s.need("-[")
                    labels.append(_label(s))
                    while s.take("|"):
                        labels.append(_label(s))
                    s.need("]->")
                target = b.name(s.name())
                b.edges.append(Edge(source, tuple(labels), target, ident))
                source = target
        else:
            s.fail(f"no clause after {first!r}")
    return b


def parse_pattern(text: str, lexicons: set[str] | None = None) -> tuple[Block, list[Block]]:
    """The pattern block and the without blocks of a rule's text. Several pattern blocks are one conjunction."""
    s = Scanner(text)
    pattern, without = None, []
    while not s.done():
        word = s.match(re.compile(r"[A-Za-z]+"), "pattern or without").lower()
        if word not in ("pattern", "without"):
            s.fail(f"unknown block {word!r}")
        b = parse_block(s, lexicons or set())
        if word == "without":
            without.append(b)
        elif pattern is None:
            pattern = b
        else:
            pattern.nodes += b.nodes
            pattern.edges += b.edges
            pattern.orders += b.orders
            for n in b.names:
                pattern.name(n)
    if pattern is None:
        raise PatternError("no pattern block")
    return pattern, without


CODING = re.compile(r"attribute=(?P<att>\w+).*val(?:ue)?=(?P<val>\w+).*node=(?P<node>\w+)(?:.*?(?:addlemma|add)=(?P<add>\w+))?")


def parse_rules(text: str) -> list[Rule]:
    """The coding rules of a query file, in order of priority; lines that are no coding are warned of and left out."""
    text = re.sub(r"\n(?:exit|quit).*", "", text + "\n", flags=re.S)
    out: list[Rule] = []
    for part in re.split(r"%\s*(?:coding|CODING)", text):
        if not re.search(r"(?:PATTERN|pattern)\s*\{", part) or "\n" not in part:
            continue
        line, body = part.split("\n", 1)
        m = CODING.search(line)
        if not m:
            warnings.warn(f"malformed coding line: {line.strip()}", stacklevel=2)
            continue
        body = body[: body.rfind("}") + 1]
        pattern, without = parse_pattern(body)
        out.append(Rule(len(out) + 1, m["att"], m["val"], m["node"], m["add"], pattern, without))
    return out


def _commands(s: Scanner) -> list[Command]:
    s.need("{")
    out = []
    while not s.take("}"):
        if s.take(";"):
            continue
        first = s.name()
        if first == "del_edge":
            out.append(Command("del_edge", (s.name(),)))
        elif first == "add_edge":
            source = s.name()
            s.need("-[")
            label = s.match(re.compile(r"[^\s\]]+"), "a label")
            s.need("]->")
            out.append(Command("add_edge", (source, label, s.name())))
        else:
            s.need(".")
            feature = s.match(NAME, "a feature")
            s.need("=")
            parts: list[tuple[str, ...]] = []
            while True:
                if s.take('"'):
                    parts.append(("text", s.until('"')))
                else:
                    word = s.match(re.compile(r"\w+"), "a value")
                    if s.text.startswith(".", s.at):
                        s.at += 1
                        parts.append(("feature", word, s.match(NAME, "a feature")))
                    else:
                        parts.append(("text", word))
                if not s.take("+"):
                    break
            out.append(Command("set", (first, feature, tuple(parts))))
    return out


def parse_grammar(text: str) -> Grammar:
    """Rules, packages and strategies of a rewrite file. Of strategies, Onf and Alt over names are known."""
    s = Scanner(text)
    g = Grammar([], {})

    def rule(package: str | None) -> None:
        name, lexicon = s.name(), None
        if s.take("("):
            short = s.name()
            s.need("from")
            s.need('"')
            lexicon = (short, s.until('"'))
            s.need(")")
        s.need("{")
        pattern, without, commands = None, [], []
        while not s.take("}"):
            word = s.name()
            if word == "pattern":
                pattern = parse_block(s, {lexicon[0]} if lexicon else set())
            elif word == "without":
                without.append(parse_block(s, {lexicon[0]} if lexicon else set()))
            elif word == "commands":
                commands = _commands(s)
            else:
                s.fail(f"unknown block {word!r}")
        if pattern is None:
            raise PatternError(f"rule {name} has no pattern")
        g.rules.append(Rewrite(name, package, pattern, without, commands, lexicon))

    while not s.done():
        if s.peek("@") or s.peek("#"):  # an appended lexicon or settings are not part of the rules
            break
        word = s.name()
        if word == "rule":
            rule(None)
        elif word == "package":
            package = s.name()
            s.need("{")
            while not s.take("}"):
                if s.name() != "rule":
                    s.fail("expected a rule")
                rule(package)
        elif word == "strat":
            name = s.name()
            s.need("{")
            inner = s.until("}")
            inner = re.sub(r"%[^\n]*", "", inner)
            g.strategies[name] = [w for w in re.findall(r"\w+", inner) if w not in ("Onf", "Alt", "Iter", "Seq", "Pick")]
        else:
            s.fail(f"unknown declaration {word!r}")
    return g


def read_lexicon(text: str) -> dict[str, set[str]]:
    """Values of each column of a lexicon: tab-separated, first line the names, lines that begin with % are comments."""
    lines = [x.split("\t") for x in text.splitlines() if x.strip() and not x.startswith("%")]
    return {name: {row[k] for row in lines[1:] if len(row) > k} for k, name in enumerate(lines[0])} if lines else {}
