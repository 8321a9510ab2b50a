"""Lexer, syntax tree and parser of the pattern language.

Own code for the grammar of SURVEY section 9, with the documented decisions of section 8: a bare
``/re/`` may follow another token, alignment knows ``!=``, and text that is left over is an error.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

REGEX_SIGNS = set(".*+?[](){}|^$\\")
UNBOUNDED = 100
RELATIONS = ("child", "parent", "sibling", "descendant", "ancestor")
DATE_PARTS = ("year", "century", "decade", "month", "week", "day")
FUNCTIONS = (*DATE_PARTS, "distance", "distabs", "strlen", "f", "nchildren", "depth", "ndescendants", "nvals", "contains", "rchild", "rcontains", "tcnt")
FIELD_FUNCTIONS = (*DATE_PARTS, "strlen", "tcnt", "forms", "spellout", "nvals", "depth", "nchildren", "ndescendants", "f")
COMMANDS = ("count", "group", "sort", "freq", "stats", "coll", "dcoll", "keyness", "tabulate", "size", "raw", "cat", "show", "set", "drop")


class QueryError(ValueError):
    """A query that can't be parsed or doesn't fit the corpus."""


# ---- syntax tree ------------------------------------------------------------------------


@dataclass(frozen=True)
class Everything:
    pass


@dataclass(frozen=True)
class Test:
    __test__ = False  # not a test case
    attr: str
    op: str
    value: str
    regex: str = ""  # "", "part" or "whole"
    lower: bool = False
    accents: bool = False


@dataclass(frozen=True)
class CountValues:
    attr: str
    op: str
    n: int


@dataclass(frozen=True)
class Both:
    parts: tuple


@dataclass(frozen=True)
class Either:
    parts: tuple


@dataclass(frozen=True)
class Related:
    relation: str
    cond: object
    negated: bool = False
    label: str = ""


@dataclass(frozen=True)
class CountRelated:
    relation: str
    cond: object
    op: str
    n: int


@dataclass
class Slot:
    kind: str  # token, anchor or subtree
    label: str = ""
    cond: object = Everything()
    low: int = 1
    high: int = 1
    region: str = ""
    closing: bool = False
    attrs: tuple = ()
    peers: tuple = ()
    where: tuple = ()
    of: str = ""
    whole: bool = False  # a bare word without an own repetition: as a lone token its runs are not cut


@dataclass
class Scope:
    region: str
    test: Test | None = None
    having: object = None
    negated: bool = False


@dataclass
class Containing:
    region: str = ""
    cond: object = None
    negated: bool = False


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple


@dataclass(frozen=True)
class Filter:
    kind: str  # region, align, order, function
    left: object
    op: str
    right: object


@dataclass
class Query:
    slots: list
    relations: list
    scopes: list = field(default_factory=list)
    containing: list = field(default_factory=list)
    filters: list = field(default_factory=list)


@dataclass
class Parallel:
    source: Query
    target: Query
    filters: list


@dataclass
class Statement:
    name: str
    query: object


@dataclass
class Field:
    label: str
    attr: str
    calls: tuple = ()

    def __str__(self):
        out = f"{self.label}.{self.attr}" if self.label and self.attr else self.attr or self.label
        for c in reversed(self.calls):
            out = f"{c}({out})"
        return out


@dataclass
class Command:
    verb: str
    names: list = field(default_factory=list)
    fields: list = field(default_factory=list)
    args: dict = field(default_factory=dict)


# ---- lexer ------------------------------------------------------------------------------

_LEX = re.compile(
    r"""(?P<space>\s+|\#[^\n]*(?:\n|$))|(?P<string>"(?:[^"\\]|\\.)*")|(?P<tag></?[A-Za-z][^<>]*>)|(?P<number>-?[0-9]+)
    |(?P<op>!=|<=|>=|!>|!<|>>|<<|::|[=<>&|()\[\]{},;:.+*?%!])|(?P<name>[^\W\d](?:[\w\#-]|/(?=[^\W\d]))*)""",
    re.X,
)


@dataclass
class Lexeme:
    kind: str
    text: str
    at: int


def lex(text: str) -> list[Lexeme]:
    out, at = [], 0
    while at < len(text):
        last = out[-1].text if out else ""
        if text[at] == "/":
            m = re.compile(r"/((?:[^/\\]|\\.)*)/").match(text, at)
            if m:
                out.append(Lexeme("regex", m[1], at))
                at = m.end()
                continue
        m = _LEX.match(text, at)
        if not m:
            raise QueryError(f"unexpected {text[at]!r} at {at}")
        kind = m.lastgroup
        if kind == "tag" and last in ("::", "&") and not re.match(r"</?[A-Za-z]\w*(\s|>|=)", m[0]):
            m, kind = re.compile(r"<=?").match(text, at), "op"
        if kind == "string":
            out.append(Lexeme("string", re.sub(r"\\(.)", lambda k: k[1] if k[1] in "\"\\" else k[0], m[0][1:-1]), at))
        elif kind != "space":
            out.append(Lexeme(kind, m[0], at))
        at = m.end()
    out.append(Lexeme("end", "", len(text)))
    return out


# ---- parser -----------------------------------------------------------------------------


class Parser:
    def __init__(self, text: str, strict: bool = False, max_gap: int = UNBOUNDED):
        self.items, self.at, self.strict, self.max_gap = lex(text), 0, strict, max_gap

    @property
    def now(self) -> Lexeme:
        return self.items[self.at]

    def ahead(self, n: int = 1) -> Lexeme:
        return self.items[min(self.at + n, len(self.items) - 1)]

    def take(self, *texts: str) -> bool:
        if self.now.kind in ("op", "name") and self.now.text in texts:
            self.at += 1
            return True
        return False

    def need(self, *texts: str) -> str:
        text = self.now.text
        if not self.take(*texts):
            raise QueryError(f"expected {' or '.join(texts)} at {self.now.at}, found {text!r}")
        return text

    def name(self) -> str:
        if self.now.kind != "name":
            raise QueryError(f"expected a name at {self.now.at}, found {self.now.text!r}")
        self.at += 1
        return self.items[self.at - 1].text

    def integer(self) -> int:
        if self.now.kind != "number":
            raise QueryError(f"expected a number at {self.now.at}, found {self.now.text!r}")
        self.at += 1
        return int(self.items[self.at - 1].text)

    def program(self) -> list:
        out = []
        while self.now.kind != "end":
            if self.take(";"):
                continue
            out.append(self.statement())
            if self.now.kind != "end":
                self.need(";")
        return out

    def statement(self):
        if self.now.kind == "name" and self.now.text in COMMANDS and self.ahead().text not in ("=", ":"):
            return self.command()
        name = ""
        if self.now.kind == "name" and self.ahead().text == "=":
            name = self.name()
            self.need("=")
        if self.now.text == "dep_subtree":
            slot = self.token()
            return Statement(name, Query([slot], []))
        query = self.query()
        if self.take("with"):
            target = self.query(filters=False)
            filters = self.filters() if self.take("::") else []
            return Statement(name, Parallel(query, target, filters))
        return Statement(name, query)

    def starts_token(self) -> bool:
        x = self.now
        return x.kind in ("string", "regex", "tag") or x.text == "[" or x.kind == "name" and self.ahead().text == ":" or x.text == "dep_subtree"

    def query(self, filters: bool = True) -> Query:
        slots, relations = [self.token()], []
        while True:
            if self.now.kind == "op" and self.now.text in (">", "<", ">>", "<<", "!>", "!<"):
                relations.append(self.now.text)
                self.at += 1
                slots.append(self.token())
            elif self.starts_token():
                relations.append("")
                slots.append(self.token())
            else:
                break
        q = Query(slots, relations)
        while True:
            negated = self.now.text == "not" and self.ahead().text in ("within", "containing") and self.take("not")
            if self.take("within"):
                q.scopes.append(self.scope(bool(negated)))
            elif self.take("containing"):
                if self.take("subtree"):
                    q.containing.append(Containing(cond=self.bracket(), negated=bool(negated)))
                else:
                    q.containing.append(Containing(region=self.name(), negated=bool(negated)))
            else:
                break
        if filters and self.take("::"):
            q.filters = self.filters()
        return q

    def scope(self, negated: bool) -> Scope:
        name, test = self.name(), None
        if self.now.text in ("=", "!=", "<", ">", "<=", ">="):
            test = self.value_test(name)
            name = name.split("_", 1)[0]
        having = self.bracket() if self.take("having") else None
        return Scope(name, test, having, negated)

    def token(self) -> Slot:
        label = ""
        if self.now.kind == "name" and self.ahead().text == ":" and self.now.text != "dep_subtree":
            label = self.name()
            self.need(":")
        if self.take("dep_subtree"):
            self.need("(")
            of = self.name()
            self.need(")")
            return Slot("subtree", label, of=of)
        if self.now.kind == "tag":
            slot = self.tag(label)
            if self.take("where"):
                names = [self.name()]
                while self.take(","):
                    names.append(self.name())
                slot.where = tuple(names)
            return slot
        x = self.now
        if x.text == "[" and x.kind == "op":
            slot = Slot("token", label, self.bracket())
            slot.low, slot.high = self.repetition(1, 1)
            return slot
        if x.kind in ("string", "regex"):
            self.at += 1
            kind = "part" if x.kind == "regex" else "whole" if self.pattern(x.text) else ""
            tests = tuple(Test(a, "=", x.text, kind, *(False, False)) for a in ("form", "contr_form"))
            lower, accents = self.folds()
            if lower or accents:
                tests = tuple(Test(t.attr, "=", t.value, t.regex, lower, accents) for t in tests)
            # a contraction's form stands on each of its tokens: a run of them is one match
            slot = Slot("token", label, Either(tests), whole=self.max_gap == UNBOUNDED and not (self.now.kind == "op" and self.now.text in "+*?{"))
            slot.low, slot.high = self.repetition(1, self.max_gap)
            return slot
        raise QueryError(f"expected a token at {x.at}, found {x.text!r}")

    def pattern(self, text: str) -> bool:
        return not self.strict and any(c in REGEX_SIGNS for c in text)

    def tag(self, label: str) -> Slot:
        raw = self.now.text
        self.at += 1
        closing = raw.startswith("</")
        body = raw[2:-1] if closing else raw[1:-1]
        m = re.match(r"\s*([A-Za-z][\w-]*)", body)
        rest, region, attrs, peers = body[m.end() :], m[1], [], []
        pattern = re.compile(r"\s*(?:(rcontains|rchild|contains)\s*\(\s*([\w-]+)\s*\)|([\w#/.-]+)\s*=\s*(?:\"((?:[^\"\\]|\\.)*)\"|([^\s\"]+)))")
        while rest.strip():
            k = pattern.match(rest)
            if not k:
                raise QueryError(f"can't read {rest.strip()!r} in {raw}")
            if k[1]:
                peers.append((k[1], k[2]))
            else:
                attrs.append((k[3], re.sub(r"\\(.)", r"\1", k[4]) if k[4] is not None else k[5]))
            rest = rest[k.end() :]
        return Slot("anchor", label, region=region, closing=closing, attrs=tuple(attrs), peers=tuple(peers))

    def repetition(self, low: int, high: int) -> tuple[int, int]:
        if self.take("+"):
            return 1, self.max_gap
        if self.take("*"):
            return 0, self.max_gap
        if self.take("?"):
            return 0, 1
        if self.take("{"):
            low = self.integer()
            high = low
            if self.take(","):
                high = self.integer() if self.now.kind == "number" else self.max_gap
            self.need("}")
            if low < 0 or high < low:
                raise QueryError(f"bad repetition {{{low},{high}}}")
        return low, high

    def bracket(self):
        self.need("[")
        cond = Everything() if self.now.text == "]" else self.condition()
        self.need("]")
        return cond

    def condition(self):
        parts = [self.conjunction()]
        while self.take("|"):
            parts.append(self.conjunction())
        return parts[0] if len(parts) == 1 else Either(tuple(parts))

    def conjunction(self):
        parts = [self.primary()]
        while self.take("&"):
            parts.append(self.primary())
        return parts[0] if len(parts) == 1 else Both(tuple(parts))

    def primary(self):
        if self.take("("):
            cond = self.condition()
            self.need(")")
            return cond
        negated = self.now.text == "not" and self.ahead().text in RELATIONS and self.take("not")
        if self.now.text in RELATIONS and (self.ahead().text == "[" or self.ahead(2).text == ":"):
            relation, label = self.name(), ""
            if self.now.kind == "name":
                label = self.name()
                self.need(":")
            if negated and label:
                raise QueryError("a negated relation can't have a label")
            return Related(relation, self.bracket(), bool(negated), label)
        if self.now.text in ("count", "nvals") and self.ahead().text == "(":
            what = self.name()
            self.need("(")
            relation = self.name()
            if what == "nvals":
                self.need(")")
                return CountValues(relation, self.need("=", "!=", "<", ">", "<=", ">="), self.integer())
            if relation not in RELATIONS:
                raise QueryError(f"count({relation}) isn't a relation")
            cond = self.bracket() if self.now.text == "[" else Everything()
            self.need(")")
            return CountRelated(relation, cond, self.need("=", "!=", "<", ">", "<=", ">="), self.integer())
        return self.value_test(self.name())

    def folds(self) -> tuple[bool, bool]:
        lower = accents = False
        while self.take("%"):
            flag = self.name()
            if flag not in ("c", "d"):
                raise QueryError(f"unknown flag %{flag}")
            lower, accents = lower or flag == "c", accents or flag == "d"
        return lower, accents

    def value_test(self, attr: str) -> Test:
        op, x = self.need("=", "!=", "<", ">", "<=", ">="), self.now
        if x.kind not in ("string", "regex", "number"):
            raise QueryError(f"expected a value at {x.at}, found {x.text!r}")
        self.at += 1
        kind = "part" if x.kind == "regex" else "whole" if x.kind == "string" and self.pattern(x.text) else ""
        if kind and op == "!=" and x.kind == "string":
            raise QueryError(f"{x.text!r} holds pattern signs; != takes a literal")
        if kind and op not in ("=", "!="):
            raise QueryError(f"{op} takes a literal")
        lower, accents = self.folds()
        return Test(attr, op, x.text, kind, lower, accents)

    # ---- global filters

    def filters(self) -> list:
        out = [self.filter()]
        while self.take("&"):
            out.append(self.filter())
        return out

    def call(self) -> Call:
        name = self.name()
        self.need("(")
        args = [self.operand()]
        while self.take(","):
            args.append(self.operand())
        self.need(")")
        return Call(name, tuple(args))

    def operand(self):
        """label, label.attr, match.attr or attr: (label, attr)"""
        first = self.name()
        if self.take("."):
            return first, self.name()
        return "", first

    def filter(self) -> Filter:
        if self.now.text in FUNCTIONS and self.ahead().text == "(":
            left = self.call()
            op = self.need("=", "!=", "<", ">", "<=", ">=")
            right = self.call() if self.now.kind == "name" else self.integer()
            return Filter("function", left, op, right)
        label, attr = self.operand()
        if self.ahead().kind == "name" and self.now.text in ("=", "!=", "<", ">"):
            op = self.need("=", "!=", "<", ">")
            other = self.operand()
            if not label and not other[0] and op in ("<", ">"):
                return Filter("order", attr, op, other[1])
            if op not in ("=", "!="):
                raise QueryError("attributes are aligned by = or !=")
            if not label or not other[0]:
                raise QueryError("alignment needs label.attribute on both sides")
            return Filter("align", (label, attr), op, other)
        return Filter("region", label, "", self.value_test(attr))

    # ---- commands

    def fields(self) -> list:
        out = [self.one_field()]
        while self.take(","):
            out.append(self.one_field())
        return out

    def one_field(self) -> Field:
        if self.now.text in FIELD_FUNCTIONS and self.ahead().text == "(":
            name = self.name()
            self.need("(")
            if name == "spellout":
                label = self.name()
                self.need(",")
                inner = Field(label, self.name())
            else:
                inner = self.one_field()
            self.need(")")
            if name in ("tcnt", "forms", "depth", "nchildren", "ndescendants") and not inner.label and not inner.calls:
                inner = Field(inner.attr, "")
            return Field(inner.label, inner.attr, (name, *inner.calls))
        label, attr = self.operand()
        return Field("" if label == "match" else label, attr)

    def command(self) -> Command:
        verb = self.name()
        c = Command(verb)
        if verb in ("count", "group", "sort", "freq"):
            while self.now.text != "by":
                c.names.append(self.name())
                if not self.take(","):
                    break
            self.need("by")
            c.fields = self.fields()
        elif verb == "stats":
            c.args["metrics"] = []
            while True:
                metric = self.need("avg", "median")
                self.need("(")
                c.args["metrics"].append((metric, self.one_field()))
                self.need(")")
                if not self.take(","):
                    break
            c.fields = self.fields() if self.take("by") else []
        elif verb in ("coll", "dcoll"):
            self.collocation(c)
        elif verb == "keyness":
            if self.now.kind == "name" and self.now.text not in ("vs", "by"):
                c.names.append(self.name())
            if self.take("vs"):
                c.args["versus"] = self.name()
            c.fields = self.fields() if self.take("by") else []
        elif verb == "tabulate":
            if self.now.kind == "name" and (self.ahead().kind == "number" or self.ahead().kind == "name"):
                c.names.append(self.name())
            if self.now.kind == "number":
                c.args["offset"], c.args["limit"] = self.integer(), self.integer()
            c.fields = self.fields()
        elif verb in ("size", "raw", "cat"):
            if self.now.kind == "name":
                c.names.append(self.name())
        elif verb == "show":
            c.args["what"] = self.name()
            if self.now.kind == "name":
                c.args["name"] = self.name()
        elif verb == "set":
            c.args["name"] = self.name()
            c.args["value"] = self.now.text
            self.at += 1
        elif verb == "drop":
            c.args["name"] = self.name()
        return c

    def collocation(self, c: Command) -> None:
        while True:
            if self.take("("):
                if self.take("on"):
                    c.args["on"] = self.name()
                else:
                    c.names.append(self.name())
                self.need(")")
            elif self.take("on"):
                c.args["on"] = self.name()
            else:
                break
        kinds = ("head", "children", "descendants")
        if c.verb == "coll":
            if self.now.kind == "name" and self.now.text != "by" and not c.names:
                c.names.append(self.name())
            if self.take("on"):
                c.args["on"] = self.name()
        else:
            c.args["relations"] = []
            while self.now.kind == "name" and self.now.text != "by":
                x = self.name()
                if self.take("."):
                    c.args["on"] = x
                    x = self.name()
                    c.args["relations"].append(x)
                elif x not in kinds and not c.names and not c.args["relations"] and self.now.text != ",":
                    c.names.append(x)
                    continue
                else:
                    c.args["relations"].append(x)
                if not self.take(","):
                    break
        c.fields = self.fields() if self.take("by") else []


def parse(text: str, strict: bool = False, max_gap: int = UNBOUNDED) -> list:
    return Parser(text, strict, max_gap).program()
