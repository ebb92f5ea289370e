"""Turtle, TriG, N-Triples and N-Quads: parsing and writing small texts on the driver."""

from __future__ import annotations

import itertools
import re
import uuid
from collections import defaultdict

from trellis.functions.terms import RDF, TYPE, XSD, escape, unescape

_TOKEN = re.compile(
    r"""(?P<ws>\s+|\#[^\n]*)|(?P<iri><[^\x00-\x20<>"{}|^`\\]*>)|(?P<long>\"\"\"(?:[^"\\]|\\.|"(?!""))*\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*''')|(?P<str>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
    |(?P<dt>\^\^)|(?P<dir>@prefix\b|@base\b)|(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)|(?P<blank>_:[\w.-]*\w)|(?P<num>[+-]?(?:\d+\.\d*[eE][+-]?\d+|\.?\d+[eE][+-]?\d+|\d*\.\d+|\d+))
    |(?P<name>(?:[^\W\d_][\w.-]*)?:(?:[\w%-]|\.(?=[\w:%-])|:|\\[_~.!$&'()*+,;=/?\#@%-])*)|(?P<word>[A-Za-z]+)|(?P<punct>[.;,\[\](){}])""",
    re.X | re.S,
)


class Parser:
    """Text -> quads (g, s, p, o); g is default_graph outside GRAPH blocks. Blank nodes get labels of their own for each text."""

    def __init__(self, text: str, default_graph: str | None = None, base: str = ""):
        self.graph, self.base, self.prefixes, self.out = default_graph, base, {}, []
        self.mark, self.count, self.labels = uuid.uuid4().hex[:12], itertools.count(), {}
        self.tokens, at = [], 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(f"cannot read near {text[at : at + 40]!r}")
            if m.lastgroup != "ws":
                self.tokens.append((m.lastgroup, m[0]))
            at = m.end()
        self.at = 0

    def peek(self):
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def next(self):
        token = self.peek()
        self.at += 1
        return token

    def expect(self, text: str):
        if self.next()[1] != text:
            raise ValueError(f"expected {text!r} near {' '.join(t for _, t in self.tokens[max(0, self.at - 4) : self.at + 2])!r}")

    def fresh(self) -> str:
        return f"_:b{self.mark}x{next(self.count)}"

    def parse(self) -> list[tuple]:
        while self.peek()[0] != "end":
            kind, text = self.peek()
            word = text.lower()
            if kind == "dir" or kind == "word" and word in ("prefix", "base"):
                self.next()
                if word.endswith("prefix"):
                    name = self.next()[1][:-1]
                    self.prefixes[name] = self.resolve(self.next()[1])
                else:
                    self.base = self.next()[1][1:-1]
                if kind == "dir":
                    self.expect(".")
            elif kind == "word" and word == "graph":
                self.next()
                self.block(self.term())
            elif text == "{":
                self.block(self.graph)
            else:
                self.statement()
        return self.out

    def block(self, graph):
        outer, self.graph = self.graph, graph
        self.expect("{")
        while self.peek()[1] != "}":
            self.triples()
            if self.peek()[1] == ".":
                self.next()
        self.next()
        self.graph = outer

    def statement(self):
        at = self.at
        if self.peek()[0] in ("iri", "name", "blank"):
            subject = self.term()
            if self.peek()[1] == "{":
                return self.block(subject)
            self.at = at
        self.triples()
        if self.peek()[0] in ("iri", "name", "blank"):  # N-Quads: a graph behind the object
            g = self.term()
            _, s, p, o = self.out.pop()
            self.out.append((g, s, p, o))
        self.expect(".")

    def triples(self):
        bare = self.peek()[1] == "["
        subject = self.term()
        if not (bare and self.peek()[1] in (".", "}")):
            self.properties(subject)

    def properties(self, subject):
        while True:
            if self.peek()[1] in (".", "]", "}"):
                return
            predicate = TYPE if self.peek() == ("word", "a") else None
            if predicate:
                self.next()
            else:
                predicate = self.term()
            while True:
                self.out.append((self.graph, subject, predicate, self.term()))
                if self.peek()[1] != ",":
                    break
                self.next()
            if self.peek()[1] != ";":
                return
            while self.peek()[1] == ";":
                self.next()

    def resolve(self, text: str) -> str:
        inner = text[1:-1]
        return inner if ":" in inner or not self.base else self.base + inner

    def expand(self, name: str) -> str:
        prefix, _, local = name.partition(":")
        if prefix not in self.prefixes:
            raise ValueError(f"unknown prefix {prefix!r}")
        return self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local)

    def term(self) -> str:
        kind, text = self.next()
        if kind == "iri":
            return f"<{self.resolve(text)}>"
        if kind == "name":
            return f"<{self.expand(text)}>"
        if kind == "blank":
            return self.labels.setdefault(text, None) or self.labels.update({text: self.fresh()}) or self.labels[text]
        if kind in ("str", "long"):
            body = escape(unescape(text[3:-3] if kind == "long" else text[1:-1]))
            if self.peek()[0] == "lang":
                return f'"{body}"{self.next()[1]}'
            if self.peek()[0] == "dt":
                self.next()
                kind_iri = self.term()
                return f'"{body}"' if kind_iri == f"<{XSD}string>" else f'"{body}"^^{kind_iri}'
            return f'"{body}"'
        if kind == "num":
            name = "double" if "e" in text.lower() else "decimal" if "." in text else "integer"
            return f'"{text}"^^<{XSD}{name}>'
        if kind == "word" and text in ("true", "false"):
            return f'"{text}"^^<{XSD}boolean>'
        if text == "[":
            node = self.fresh()
            self.properties(node)
            self.expect("]")
            return node
        if text == "(":
            items = []
            while self.peek()[1] != ")":
                items.append(self.term())
            self.next()
            head = f"<{RDF}nil>"
            for item in reversed(items):
                node = self.fresh()
                self.out += [(self.graph, node, f"<{RDF}first>", item), (self.graph, node, f"<{RDF}rest>", head)]
                head = node
            return head
        raise ValueError(f"unexpected {text!r}")


def parse(text: str, graph: str | None = None) -> list[tuple[str | None, str, str, str]]:
    """Turtle, TriG, N3 (without rules), N-Triples or N-Quads -> quads."""
    return Parser(text, graph).parse()


def parse_jsonld(text: str, graph: str | None = None) -> list[tuple]:
    """JSON-LD with @context prefixes and terms, @id, @type, @value, @list, @graph -> quads."""
    import json

    mark, count, out = uuid.uuid4().hex[:12], itertools.count(), []

    def expand(name, context):
        if name in context:
            got = context[name]
            return expand(got["@id"] if isinstance(got, dict) else got, {k: v for k, v in context.items() if k != name})
        prefix, _, local = name.partition(":")
        return context[prefix] + local if local and isinstance(context.get(prefix), str) else context.get("@vocab", "") + name if ":" not in name else name

    def node(x, context, g):
        if not isinstance(x, dict):
            from trellis.functions.terms import literal

            return literal(x)
        if "@value" in x:
            from trellis.functions.terms import literal

            return literal(x["@value"], expand(x["@type"], context) if "@type" in x else None, x.get("@language"))
        context = context | (x.get("@context") or {})
        me = x.get("@id")
        me = f"_:b{mark}x{next(count)}" if me is None else me if me.startswith("_:") else f"<{expand(me, context)}>"
        for key, values in x.items():
            if key == "@type":
                out.extend((g, me, TYPE, f"<{expand(t, context)}>") for t in (values if isinstance(values, list) else [values]))
            elif key == "@graph":
                for one in values:
                    node(one, context, me if "@id" in x else g)
            elif not key.startswith("@"):
                kind = context.get(key)
                for v in values if isinstance(values, list) else [values]:
                    if isinstance(v, str) and isinstance(kind, dict) and kind.get("@type") == "@id":
                        v = {"@id": v}
                    elif isinstance(v, (str, int, float)) and isinstance(kind, dict) and "@type" in kind:
                        v = {"@value": v, "@type": kind["@type"]}
                    if isinstance(v, dict) and "@list" in v:
                        head = f"<{RDF}nil>"
                        for item in reversed(v["@list"]):
                            cell = f"_:b{mark}x{next(count)}"
                            out.extend([(g, cell, f"<{RDF}first>", node(item, context, g)), (g, cell, f"<{RDF}rest>", head)])
                            head = cell
                        out.append((g, me, f"<{expand(key, context)}>", head))
                    else:
                        out.append((g, me, f"<{expand(key, context)}>", node(v, context, g)))
        return me

    data = json.loads(text)
    for one in data if isinstance(data, list) else [data]:
        node(one, {}, graph)
    return out


def parse_xml(text: str, graph: str | None = None) -> list[tuple]:
    """RDF/XML: node elements, property elements, rdf:about / ID / nodeID / resource / datatype, xml:lang, parseType Resource and Collection."""
    import xml.etree.ElementTree as ET

    mark, count, out = uuid.uuid4().hex[:12], itertools.count(), []
    r = lambda name: f"{{{RDF}}}{name}"
    name_of = lambda tag: f"<{tag[1:].replace('}', '', 1)}>"
    fresh = lambda: f"_:b{mark}x{next(count)}"

    def element(e):
        me = f"<{e.get(r('about'))}>" if e.get(r("about")) is not None else f"_:{mark}{e.get(r('nodeID'))}" if e.get(r("nodeID")) else f"<#{e.get(r('ID'))}>" if e.get(r("ID")) else fresh()
        if e.tag != r("Description"):
            out.append((graph, me, TYPE, name_of(e.tag)))
        body(me, e)
        for k, v in e.attrib.items():
            if k.startswith("{") and not k.startswith((f"{{{RDF}}}", "{http://www.w3.org/XML")):
                out.append((graph, me, name_of(k), f'"{escape(v)}"'))
        return me

    def body(me, e):
        for p in e:
            kind = p.get(r("parseType"))
            if p.get(r("resource")) is not None:
                o = f"<{p.get(r('resource'))}>"
            elif p.get(r("nodeID")):
                o = f"_:{mark}{p.get(r('nodeID'))}"
            elif kind == "Resource":
                o = fresh()
                body(o, p)
            elif kind == "Collection":
                o = f"<{RDF}nil>"
                for item in reversed([element(x) for x in p]):
                    cell = fresh()
                    out.extend([(graph, cell, f"<{RDF}first>", item), (graph, cell, f"<{RDF}rest>", o)])
                    o = cell
            elif len(p):
                o = element(p[0])
            else:
                o = f'"{escape(p.text or "")}"'
                if p.get(r("datatype")):
                    o += f"^^<{p.get(r('datatype'))}>"
                elif p.get("{http://www.w3.org/XML/1998/namespace}lang"):
                    o += f"@{p.get('{http://www.w3.org/XML/1998/namespace}lang')}"
            out.append((graph, me, name_of(p.tag), o))

    root = ET.fromstring(text)
    for e in root if root.tag == r("RDF") else [root]:
        element(e)
    return out


READERS = {"turtle": parse, "ttl": parse, "trig": parse, "n3": parse, "nt": parse, "ntriples": parse, "nquads": parse, "nq": parse, "json-ld": parse_jsonld, "xml": parse_xml, "rdf/xml": parse_xml}


def write_turtle(triples) -> str:
    """Turtle grouped by subject, in order of tokens."""
    groups: dict = defaultdict(lambda: defaultdict(list))
    for s, p, o in sorted(set(triples)):
        groups[s][p].append(o)
    return "\n".join(f"{s} " + " ;\n    ".join(f"{'a' if p == TYPE else p} {', '.join(os)}" for p, os in ps.items()) + " ." for s, ps in groups.items()) + ("\n" if groups else "")


def write_trig(quads) -> str:
    groups: dict = defaultdict(list)
    for g, s, p, o in quads:
        groups[g].append((s, p, o))
    return "\n".join(f"{g} {{\n{write_turtle(ts)}}}\n" for g, ts in sorted(groups.items()))


def write_nquads(quads) -> str:
    return "".join(f"{s} {p} {o} {g} .\n" for g, s, p, o in sorted(set(quads)))


def write_ntriples(triples) -> str:
    return "".join(f"{s} {p} {o} .\n" for s, p, o in sorted(set(triples)))
