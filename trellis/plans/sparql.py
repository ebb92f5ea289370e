"""SPARQL 1.1 text -> syntax tree.

Terms are tokens (strings, see functions/terms.py) or Var. Groups are lists of tuples:
("triple", s, path, o), ("optional", group), ("union", [groups]), ("graph", term, group), ("filter", expr), ("bind", expr, var),
("values", [vars], [rows]), ("minus", group), ("group", group), ("select", Query). Expressions are tuples (operator, ...)."""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass, field

from trellis.functions.terms import RDF, TYPE, XSD, escape, unescape

_TOKEN = re.compile(
    r"""(?P<ws>\s+|\#[^\n]*)|(?P<iri><[^\x00-\x20<>"{}|^`\\]*>)|(?P<var>[?$]\w+)|(?P<long>\"\"\"(?:[^"\\]|\\.|"(?!""))*\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*''')
    |(?P<str>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')|(?P<dt>\^\^)|(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)|(?P<blank>_:[\w.-]*\w)
    |(?P<num>\d+\.\d*[eE][+-]?\d+|\.?\d+[eE][+-]?\d+|\d*\.\d+|\d+)|(?P<name>(?:[^\W\d_](?:[\w.-]*[\w-])?)?:(?:[\w%:-]|\.(?=[\w:%-])|\\.)*)|(?P<word>[A-Za-z_]\w*)
    |(?P<op>\|\||&&|!=|<=|>=|[=<>!+\-*/(){}\[\],;.|^?])""",
    re.X | re.S,
)
AGGREGATES = ("COUNT", "SUM", "AVG", "MIN", "MAX", "SAMPLE", "GROUP_CONCAT")


class Var(str):
    """A variable; blank nodes of patterns are variables whose names begin with _:."""


@dataclass
class Query:
    form: str
    distinct: bool = False
    project: list | None = None  # [(expr, Var)]; None: all
    template: list = field(default_factory=list)
    where: list = field(default_factory=list)
    group: list = field(default_factory=list)
    having: list = field(default_factory=list)
    order: list = field(default_factory=list)
    limit: int | None = None
    offset: int = 0
    dataset: tuple | None = None  # (graphs of the default graph, named graphs); None: all


@dataclass
class Update:
    kind: str  # insert data, delete data, modify, drop, clear, copy, move, add, create, load
    insert: list = field(default_factory=list)  # [(g, s, p, o)]
    delete: list = field(default_factory=list)
    where: list = field(default_factory=list)
    source: str | None = None
    target: str | None = None


class Parser:
    def __init__(self, text: str, prefixes: dict | None = None):
        self.prefixes, self.base, self.tokens, at = dict(prefixes or {}), "", [], 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(f"cannot read the query near {text[at : at + 40]!r}")
            if m.lastgroup != "ws":
                self.tokens.append((m.lastgroup, m[0]))
            at = m.end()
        self.at, self.blanks, self.graph = 0, itertools.count(), None

    # tokens
    def peek(self, ahead: int = 0):
        return self.tokens[self.at + ahead] if self.at + ahead < len(self.tokens) else ("end", "")

    def next(self):
        token = self.peek()
        self.at += 1
        return token

    def word(self, *words: str) -> str | None:
        """The next keyword if it is one of words."""
        kind, text = self.peek()
        if kind == "word" and text.upper() in words:
            self.at += 1
            return text.upper()
        return None

    def op(self, *ops: str) -> str | None:
        kind, text = self.peek()
        if kind == "op" and text in ops:
            self.at += 1
            return text
        return None

    def need(self, text: str):
        if not (self.op(text) or self.word(text)):
            raise ValueError(f"expected {text!r}, found {self.peek()[1]!r}")

    # query forms
    def prologue(self):
        while w := self.word("PREFIX", "BASE"):
            if w == "PREFIX":
                name = self.next()[1]
                self.prefixes[name[:-1]] = self.next()[1][1:-1]
            else:
                self.base = self.next()[1][1:-1]

    def parse(self):
        """A Query, or a list of Updates."""
        self.prologue()
        w = self.peek()[1].upper()
        if w in ("SELECT", "ASK", "CONSTRUCT", "DESCRIBE"):
            q = self.query()
            if self.peek()[0] != "end":
                raise ValueError(f"unexpected {self.peek()[1]!r} after the query")
            return q
        out = []
        while self.peek()[0] != "end":
            out.append(self.update())
            self.op(";")
            self.prologue()
        if not out:
            raise ValueError("empty query")
        return out

    def query(self) -> Query:
        form = self.word("SELECT", "ASK", "CONSTRUCT", "DESCRIBE")
        q = Query(form.lower())
        if form == "SELECT":
            q.distinct = bool(self.word("DISTINCT", "REDUCED"))
            if not self.op("*"):
                q.project = []
                while self.peek()[0] == "var" or self.peek()[1] == "(":
                    if self.op("("):
                        e = self.expr()
                        self.need("AS")
                        q.project.append((e, self.var()))
                        self.need(")")
                    else:
                        v = self.var()
                        q.project.append((("var", v), v))
        elif form == "DESCRIBE":
            q.project = []
            while self.peek()[0] in ("var", "iri", "name"):
                q.project.append(self.term())
            if self.peek()[1] != "{" and self.peek()[1].upper() != "WHERE":
                return q
        elif form == "CONSTRUCT" and self.peek()[1] == "{":
            q.template = self.template()
        while self.word("FROM"):
            if q.dataset is None:
                q.dataset = ([], [])
            q.dataset[bool(self.word("NAMED"))].append(self.term())
        self.word("WHERE")
        q.where = self.group()
        if form == "CONSTRUCT" and not q.template:
            q.template = [(None, *x[1:]) for x in q.where]
        if self.word("GROUP"):
            self.need("BY")
            while self.peek()[0] == "var" or self.peek()[1] == "(" or self.peek()[0] == "word" and self.peek()[1].upper() not in ("HAVING", "ORDER", "LIMIT", "OFFSET", "VALUES"):
                if self.op("("):
                    e = self.expr()
                    v = self.var() if self.word("AS") else Var(f"_g{len(q.group)}")
                    self.need(")")
                else:
                    e = self.primary()
                    v = e[1] if e[0] == "var" else Var(f"_g{len(q.group)}")
                q.group.append((e, v))
        if self.word("HAVING"):
            while self.peek()[1] == "(":
                q.having.append(self.primary())
        if self.word("ORDER"):
            self.need("BY")
            while True:
                if w := self.word("ASC", "DESC"):
                    q.order.append((self.primary(), w == "DESC"))
                elif self.peek()[0] == "var" or self.peek()[1] == "(" or self.peek()[0] == "word" and self.peek()[1].upper() not in ("LIMIT", "OFFSET", "VALUES"):
                    q.order.append((self.primary(), False))
                else:
                    break
        while w := self.word("LIMIT", "OFFSET"):
            n = int(self.next()[1])
            if w == "LIMIT":
                q.limit = n
            else:
                q.offset = n
        if self.word("VALUES"):
            q.where.append(self.values())
        return q

    def update(self) -> Update:
        w = self.word("INSERT", "DELETE", "DROP", "CLEAR", "CREATE", "COPY", "MOVE", "ADD", "LOAD", "WITH")
        if w in ("DROP", "CLEAR", "CREATE", "COPY", "MOVE", "ADD", "LOAD"):
            self.word("SILENT")

            def target():
                if all_ := self.word("ALL", "DEFAULT", "NAMED"):
                    return all_.lower()
                self.word("GRAPH")
                return self.term()

            if w == "LOAD":
                source = self.next()[1]
                return Update("load", source=source, target=target() if self.word("INTO") else None)
            first = target()
            if w in ("COPY", "MOVE", "ADD"):
                self.need("TO")
                return Update(w.lower(), source=first, target=target())
            return Update("drop" if w == "CLEAR" else w.lower(), target=first)
        default = None
        if w == "WITH":
            default = self.term()
            w = self.word("INSERT", "DELETE")
        if self.word("DATA"):
            quads = self.template(default)
            return Update(w.lower() + " data", **{w.lower(): quads})
        if w == "DELETE" and self.word("WHERE"):
            at = self.at
            where = self.group()
            self.at = at
            return Update("modify", delete=self.template(default), where=where)
        u = Update("modify")
        if w == "DELETE":
            u.delete = self.template(default)
            if self.word("INSERT"):
                u.insert = self.template(default)
        elif w == "INSERT":
            u.insert = self.template(default)
        else:
            raise ValueError(f"unexpected {self.peek()[1]!r}")
        self.need("WHERE")
        where = self.group()
        u.where = [("graph", default, where)] if default else where
        return u

    def template(self, default=None) -> list[tuple]:
        """{ triples, GRAPH blocks } -> (g, s, p, o)."""
        self.need("{")
        out, graph = [], default
        depth = 1
        while depth:
            if self.op("}"):
                depth -= 1
                graph = default
            elif self.word("GRAPH"):
                graph = self.term()
                self.need("{")
                depth += 1
            elif not self.op("."):
                out += [(graph, *t[1:]) for t in self.triples()]
        return out

    # patterns
    def group(self) -> list:
        self.need("{")
        if self.peek()[1].upper() == "SELECT":
            q = self.query()
            self.need("}")
            return [("select", q)]
        out: list = []
        while not self.op("}"):
            if self.op("."):
                continue
            if self.word("OPTIONAL"):
                out.append(("optional", self.group()))
            elif self.word("MINUS"):
                out.append(("minus", self.group()))
            elif self.word("GRAPH"):
                g = self.term()
                out.append(("graph", g, self.group()))
            elif self.word("FILTER"):
                out.append(("filter", self.primary()))
            elif self.word("BIND"):
                self.need("(")
                e = self.expr()
                self.need("AS")
                out.append(("bind", e, self.var()))
                self.need(")")
            elif self.word("VALUES"):
                out.append(self.values())
            elif self.word("SERVICE"):
                raise ValueError("SERVICE is not supported")
            elif self.peek()[1] == "{":
                parts = [self.group()]
                while self.word("UNION"):
                    parts.append(self.group())
                out.append(("union", parts) if len(parts) > 1 else ("group", parts[0]))
            else:
                out += self.triples()
        return out

    def values(self):
        rows, names = [], []
        if self.op("("):
            while not self.op(")"):
                names.append(self.var())
            self.need("{")
            while self.op("("):
                row = []
                while not self.op(")"):
                    row.append(None if self.word("UNDEF") else self.term())
                rows.append(row)
            self.need("}")
        else:
            names.append(self.var())
            self.need("{")
            while not self.op("}"):
                rows.append([None if self.word("UNDEF") else self.term()])
        return ("values", names, rows)

    def triples(self) -> list[tuple]:
        out: list = []
        bare = self.peek()[1] == "["
        s = self.node(out)
        if not (bare and self.peek()[1] in (".", "}")):
            self.properties(s, out)
        return out

    def properties(self, s, out):
        while True:
            if self.peek()[1] in (".", "]", "}") or self.peek()[0] == "end":
                return
            p = self.path()
            while True:
                out.append(("triple", s, p, self.node(out)))
                if not self.op(","):
                    break
            if not self.op(";"):
                return
            while self.op(";"):
                pass

    def node(self, out):
        if self.op("["):
            s = Var(f"_:n{next(self.blanks)}")
            self.properties(s, out)
            self.need("]")
            return s
        if self.op("("):
            items = []
            while not self.op(")"):
                items.append(self.node(out))
            head = f"<{RDF}nil>"
            for item in reversed(items):
                cell = Var(f"_:n{next(self.blanks)}")
                out += [("triple", cell, f"<{RDF}first>", item), ("triple", cell, f"<{RDF}rest>", head)]
                head = cell
            return head
        return self.term()

    # paths: a token or Var, or (kind, ...): seq, alt, inv, star, plus, opt, not
    def path(self):
        if self.peek()[0] == "var":
            return self.var()
        parts = [self.sequence()]
        while self.op("|"):
            parts.append(self.sequence())
        return parts[0] if len(parts) == 1 else ("alt", *parts)

    def sequence(self):
        parts = [self.step()]
        while self.op("/"):
            parts.append(self.step())
        return parts[0] if len(parts) == 1 else ("seq", *parts)

    def step(self):
        if self.op("^"):
            return ("inv", self.step())
        if self.op("("):
            p = self.path()
            self.need(")")
        elif self.op("!"):
            names = []
            if self.op("("):
                while not self.op(")"):
                    names.append(("inv", self.step()) if self.op("^") else self.step())
                    self.op("|")
            else:
                names.append(self.step())
            p = ("not", *names)
        elif self.peek() == ("word", "a"):
            self.next()
            p = TYPE
        else:
            p = self.term()
        if mark := self.op("*", "+", "?"):
            p = ({"*": "star", "+": "plus", "?": "opt"}[mark], p)
        return p

    # terms
    def var(self) -> Var:
        kind, text = self.next()
        if kind != "var":
            raise ValueError(f"expected a variable, found {text!r}")
        return Var(text[1:])

    def iri(self, text: str) -> str:
        if text.startswith("<"):
            inner = text[1:-1]
            return f"<{inner if ':' in inner else self.base + inner}>"
        prefix, _, local = text.partition(":")
        if prefix not in self.prefixes:
            raise ValueError(f"unknown prefix {prefix!r}")
        return f"<{self.prefixes[prefix]}{re.sub(r'\\(.)', r'\1', local)}>"

    def term(self):
        kind, text = self.next()
        if kind == "var":
            return Var(text[1:])
        if kind in ("iri", "name"):
            return self.iri(text)
        if kind == "blank":
            return Var(text)
        if kind in ("str", "long"):
            body = escape(unescape(text[3:-3] if kind == "long" else text[1:-1]))
            if self.peek()[0] == "lang":
                return f'"{body}"{self.next()[1]}'
            if self.peek()[0] == "dt":
                self.next()
                datatype = self.iri(self.next()[1])
                return f'"{body}"' if datatype == f"<{XSD}string>" else f'"{body}"^^{datatype}'
            return f'"{body}"'
        if kind == "op" and text in "+-" and self.peek()[0] == "num":
            return '"' + text.strip("+") + self.term()[1:]
        if kind == "num":
            return f'"{text}"^^<{XSD}{"double" if "e" in text.lower() else "decimal" if "." in text else "integer"}>'
        if kind == "word" and text.lower() in ("true", "false"):
            return f'"{text.lower()}"^^<{XSD}boolean>'
        if kind == "word" and text == "a":
            return TYPE
        raise ValueError(f"unexpected {text!r}")

    # expressions
    def expr(self):
        e = self.conjunction()
        while self.op("||"):
            e = ("||", e, self.conjunction())
        return e

    def conjunction(self):
        e = self.relation()
        while self.op("&&"):
            e = ("&&", e, self.relation())
        return e

    def relation(self):
        e = self.sum()
        if o := self.op("=", "!=", "<", ">", "<=", ">="):
            return (o, e, self.sum())
        if self.word("IN"):
            return ("in", e, self.arguments())
        if self.peek()[1].upper() == "NOT" and self.peek(1)[1].upper() == "IN":
            self.at += 2
            return ("!", ("in", e, self.arguments()))
        return e

    def sum(self):
        e = self.product()
        while o := self.op("+", "-"):
            e = (o, e, self.product())
        return e

    def product(self):
        e = self.unary()
        while o := self.op("*", "/"):
            e = (o, e, self.unary())
        return e

    def unary(self):
        if self.op("!"):
            return ("!", self.unary())
        if self.peek()[1] == "-" and self.peek(1)[0] != "num":
            self.next()
            return ("-", ("term", f'"0"^^<{XSD}integer>'), self.unary())
        self.op("+") if self.peek(1)[0] != "num" else None
        return self.primary()

    def arguments(self) -> list:
        self.need("(")
        out = []
        while not self.op(")"):
            out.append(self.expr())
            self.op(",")
        return out

    def primary(self):
        kind, text = self.peek()
        if self.op("("):
            e = self.expr()
            self.need(")")
            return e
        if kind == "word" and text.lower() not in ("true", "false"):
            name = self.next()[1].upper()
            if name == "NOT":
                self.need("EXISTS")
                return ("!", ("exists", self.group()))
            if name == "EXISTS":
                return ("exists", self.group())
            if name in AGGREGATES:
                self.need("(")
                distinct = bool(self.word("DISTINCT"))
                arg = None if self.op("*") else self.expr()
                separator = " "
                if self.op(";"):
                    self.need("SEPARATOR")
                    self.need("=")
                    separator = unescape(self.next()[1][1:-1])
                self.need(")")
                return ("aggregate", name, distinct, arg, separator)
            return ("call", name, self.arguments())
        if kind in ("iri", "name") and self.peek(1)[1] == "(":
            name = self.iri(self.next()[1])
            return ("call", name, self.arguments())
        t = self.term()
        return ("var", t) if isinstance(t, Var) else ("term", t)


def parse(text: str, prefixes: dict | None = None):
    return Parser(text, prefixes).parse()


def classify(text: str) -> str:
    """select, ask, construct, describe or update."""
    tree = parse(text)
    return tree.form if isinstance(tree, Query) else "update"
