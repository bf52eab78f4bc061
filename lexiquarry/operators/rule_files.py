"""Token rules as text: a loader for files of rules, and cascades of such files.

    Det := OpenRegex { <pos="DT"> | <pos="CD"> }
    consume Phrase := TypedOpenRegex { (<Head>: <pos=/NN.*/ & !lemma="be">+) (?: <string="of"> @Det? <pos="NN">)* }
    Pronoun := CaseInsensitiveKeywordTagger { it
                                              one }

A token test is ``<property op value>`` over string, lemma, pos and chunk; a value is a "text", a 'text'
or a /regular expression/ that the whole property matches; tests combine with ``&``, ``|``, ``!`` and
brackets. Patterns have groups ``( )``, ``(?: )`` and named ``(<Name>: )``, the quantifiers ``? * + {n,m}``,
alternatives, the anchors ``^`` and ``$``, and ``@Rule`` for a span that an earlier rule found.
``//`` begins a comment.

A file is a level; rules apply in order, each over the spans of all before. A rule scans left to right
and goes on behind a match. A rule marked ``consume`` takes its tokens: no later rule of the same file
matches there.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import cached_property

import pandas as pd
from pyspark.sql import DataFrame

from lexiquarry.operators.cascade import Alt, Context, Name, One, Pattern, Ref, Rep, Scan, Seq, Span, Start, Token, W
from lexiquarry.session import ship, spread


class RuleError(ValueError):
    pass


class Test(One):
    """One token that meets a predicate."""

    __test__ = False  # not a test case


class End(Pattern):
    def at(self, ctx, i, names):
        if i == len(ctx.tokens):
            yield i, names

    def first(self):
        return [], set(), True


@dataclass(frozen=True)
class Rule:
    name: str
    pattern: Pattern
    consume: bool = False

    @cached_property
    def scan(self) -> Scan:
        return Scan(self.name, self.pattern)


_HEAD = re.compile(r"(consume\s+)?([A-Za-z_]\w*)\s*:=\s*(OpenRegex|TypedOpenRegex|KeywordTagger|CaseInsensitiveKeywordTagger)\s*\{")
_NAMED = re.compile(r"\(\s*<\s*([A-Za-z_]\w*)\s*>\s*:")
_COUNT = re.compile(r"\{\s*(\d+)\s*(?:(,)\s*(\d*)\s*)?\}")
_PROPERTIES = ("string", "lemma", "pos", "chunk")
#: Most repetitions of ``*`` and ``+``: far more than a sentence has tokens.
MANY = 10_000


class _Reader:
    """A recursive-descent reader over one file's text."""

    def __init__(self, text: str):
        self.text, self.at = text, 0

    def fail(self, what: str):
        line = self.text.count("\n", 0, self.at) + 1
        raise RuleError(f"line {line}: {what}")

    def skip(self) -> None:
        while self.at < len(self.text):
            if self.text[self.at].isspace():
                self.at += 1
            elif self.text.startswith("//", self.at):
                end = self.text.find("\n", self.at)
                self.at = len(self.text) if end < 0 else end
            else:
                return

    def peek(self) -> str:
        self.skip()
        return self.text[self.at : self.at + 1]

    def take(self, what: str) -> bool:
        self.skip()
        if self.text.startswith(what, self.at):
            self.at += len(what)
            return True
        return False

    def need(self, what: str) -> None:
        if not self.take(what):
            self.fail(f"expected {what!r}")

    # -- rules

    def rules(self) -> list[Rule]:
        out = []
        while self.peek():
            head = _HEAD.match(self.text, self.at)
            if not head:
                self.fail("expected a rule")
            self.at = head.end()
            if head[3].endswith("KeywordTagger"):
                pattern = self.keywords("CaseInsensitive" in head[3])
            else:
                pattern = self.alternatives()
                self.need("}")
            out.append(Rule(head[2], pattern, bool(head[1])))
        return out

    def keywords(self, any_case: bool) -> Pattern:
        end = self.text.find("}", self.at)
        if end < 0:
            self.fail("expected '}'")
        lines = [re.sub("//.*", "", x).split() for x in self.text[self.at : end].split("\n")]
        self.at = end + 1
        case = "(?i)" if any_case else ""
        phrases = sorted((x for x in lines if x), key=lambda x: -len(x))  # longest first
        return Alt(*[Seq(*[W(string=case + re.escape(w)) for w in x]) for x in phrases])

    # -- patterns

    def alternatives(self) -> Pattern:
        out = [self.sequence()]
        while self.take("|"):
            out.append(self.sequence())
        return out[0] if len(out) == 1 else Alt(*out)

    def sequence(self) -> Pattern:
        out = []
        while self.peek() and self.peek() not in "|)}":
            out.append(self.repeated())
        return out[0] if len(out) == 1 else Seq(*out)

    def repeated(self) -> Pattern:
        part = self.single()
        while (c := self.peek()) and c in "?*+{":
            if c == "{":
                found = _COUNT.match(self.text, self.at)
                if not found:
                    self.fail("expected a number of repetitions")
                low = int(found[1])
                high = low if not found[2] else int(found[3]) if found[3] else MANY
                self.at = found.end()
            else:
                low, high = {"?": (0, 1), "*": (0, MANY), "+": (1, MANY)}[c]
                self.at += 1
            part = Rep(part, low, high)
        return part

    def single(self) -> Pattern:
        self.skip()
        if named := _NAMED.match(self.text, self.at):
            self.at = named.end()
            inner = self.alternatives()
            self.need(")")
            return Name(named[1], inner)
        if self.take("(?:") or self.take("("):
            inner = self.alternatives()
            self.need(")")
            return inner
        if self.take("^"):
            return Start()
        if self.take("$"):
            return End()
        if self.take("@"):
            name = re.compile(r"\w+").match(self.text, self.at)
            if not name:
                self.fail("expected a rule's name")
            self.at = name.end()
            return Ref(name[0])
        if self.take("<"):
            holds = self.either()
            self.need(">")
            return Test(holds)
        self.fail("expected a pattern")

    # -- token tests

    def either(self):
        parts = [self.both()]
        while self.take("|"):
            parts.append(self.both())
        return parts[0] if len(parts) == 1 else lambda t: any(p(t) for p in parts)

    def both(self):
        parts = [self.negated()]
        while self.take("&"):
            parts.append(self.negated())
        return parts[0] if len(parts) == 1 else lambda t: all(p(t) for p in parts)

    def negated(self):
        if self.take("!"):
            inner = self.negated()
            return lambda t: not inner(t)
        if self.take("("):
            inner = self.either()
            self.need(")")
            return inner
        name = re.compile(r"\w+").match(self.text, self.at) if self.peek() else None
        if not name or name[0] not in _PROPERTIES:
            self.fail(f"expected one of {', '.join(_PROPERTIES)}")
        self.at = name.end()
        self.need("=")
        mark = self.peek()
        if mark not in ('"', "'", "/") or not mark:
            self.fail("expected a value")
        self.at += 1
        value, prop = "", name[0]
        while self.at < len(self.text) and self.text[self.at] != mark:
            if self.text[self.at] == "\\" and self.text[self.at + 1 : self.at + 2] == mark:
                self.at += 1
            elif self.text[self.at] == "\\":
                value += self.text[self.at]
                self.at += 1
            value += self.text[self.at : self.at + 1]
            self.at += 1
        self.need(mark)
        if mark == "/":
            try:
                shape = re.compile(value)
            except re.error as e:
                self.fail(f"bad expression {value!r}: {e}")
            return lambda t: shape.fullmatch(getattr(t, prop)) is not None
        return lambda t: getattr(t, prop) == value


def parse(text: str) -> list[Rule]:
    """Rules of one file, in order."""
    return _Reader(text).rules()


def _refs(p) -> set[str]:
    if isinstance(p, Ref):
        return {p.kind}
    inner = [*getattr(p, "parts", ())] + ([p.part] if hasattr(p, "part") else [])
    return set().union(*map(_refs, inner)) if inner else set()


def cascade(files: Iterable[str]) -> list[list[Rule]]:
    """Levels from the texts of rule files; a reference to a rule that no earlier one names is an error."""
    known: set[str] = set()
    levels = []
    for text in files:
        level = parse(text)
        for r in level:
            if missing := _refs(r.pattern) - known:
                raise RuleError(f"{r.name} refers to unknown {', '.join(sorted(missing))}")
            known.add(r.name)
        levels.append(level)
    return levels


def load(path: str) -> list[list[Rule]]:
    """Levels named, one file a line, by a cascade file; rule files lie beside it."""
    import os

    with open(path, encoding="utf-8") as f:
        names = [x.strip() for x in f if x.strip() and not x.startswith("//")]
    texts = []
    for n in names:
        with open(os.path.join(os.path.dirname(path), n), encoding="utf-8") as f:
            texts.append(f.read())
    return cascade(texts)


def apply(tokens: list[Token], levels: list[list[Rule]]) -> tuple[Context, list[Span]]:
    """(all spans, those of the last level) of one sentence."""
    ctx, last = Context(tokens), []
    for level in levels:
        taken = [False] * len(tokens)
        last = []
        for rule in level:
            i = 0
            while i < len(tokens):
                hit = next(((j, n) for j, n in rule.pattern.at(ctx, i, {}) if j > i and not any(taken[i:j])), None) if rule.scan.may(ctx, i) else None
                if hit is None:
                    i += 1
                    continue
                span = Span(rule.name, i, hit[0], hit[1])
                ctx.add(span)
                last.append(span)
                if rule.consume:
                    taken[i : hit[0]] = [True] * (hit[0] - i)
                i = hit[0]
    return ctx, last


SPANS = "id string, kind string, start int, end int, text string, names map<string,string>, last boolean"


def spans(rows: DataFrame, files: list[str], tagger, id_: str = "id", text: str = "text") -> DataFrame:
    """Every span of every text (id, text): kind, token range, text, texts of its named groups, and whether
    it is one of the last level. ``tagger`` makes tokens of a text; a null text has no span."""
    cascade(files)  # errors show here, not in a task
    ship(rows.sparkSession)

    def run(batches):
        levels = cascade(files)
        for b in batches:
            out = []
            for i, t in zip(b["id"], b["text"]):
                if t is None:
                    continue
                ctx, last = apply(tagger(t), levels)
                top = {id(s) for s in last}
                for s in ctx.spans:
                    out.append((i, s.kind, s.start, s.end, ctx.text((s.start, s.end)), {k: ctx.text(v) for k, v in s.names.items()}, id(s) in top))
            yield pd.DataFrame(out, columns=["id", "kind", "start", "end", "text", "names", "last"])

    return spread(rows.selectExpr(f"cast({id_} as string) as id", f"{text} as text")).mapInPandas(run, SPANS)
