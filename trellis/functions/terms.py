"""RDF terms as single strings in N-Triples form: `<iri>`, `_:label`, `"lex"`, `"lex"^^<datatype>`, `"lex"@lang`.

Term identity is string equality; values are decoded by the columns here, all null where a term has no such value."""

from __future__ import annotations

import datetime as dt
import re
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

XSD = "http://www.w3.org/2001/XMLSchema#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
SH = "http://www.w3.org/ns/shacl#"
PROV = "http://www.w3.org/ns/prov#"
SKOS = "http://www.w3.org/2004/02/skos/core#"
TYPE = f"<{RDF}type>"
INTEGERS = ("integer", "int", "long", "short", "byte", "nonNegativeInteger", "positiveInteger", "nonPositiveInteger", "negativeInteger", "unsignedInt", "unsignedLong", "unsignedShort", "unsignedByte")
NUMERIC = (*INTEGERS, "decimal", "double", "float")
_ESCAPES = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t"}
_UNSAFE = re.compile(r'[\x00-\x20<>"{}|\\^`]')


def iri(text: str) -> str:
    return f"<{text}>"


def check_iri(text: str) -> str:
    """text, if it can stand between angle brackets; else ValueError."""
    if not isinstance(text, str) or not text or _UNSAFE.search(text):
        raise ValueError(f"not a usable IRI: {text!r}")
    return text


def escape(text: str) -> str:
    return "".join(_ESCAPES.get(c, c) for c in text)


def unescape(text: str) -> str:
    if "\\" not in text:
        return text
    table = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f"}
    return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", lambda m: chr(int(m[1][1:], 16)) if m[1][0] in "uU" and len(m[1]) > 1 else table.get(m[1], m[1]), text)


def literal(value, datatype: str | None = None, lang: str | None = None) -> str:
    """The token of a Python value."""
    if lang:
        return f'"{escape(str(value))}"@{lang}'
    if datatype is None:
        if isinstance(value, bool):
            value, datatype = str(value).lower(), XSD + "boolean"
        elif isinstance(value, int):
            datatype = XSD + "integer"
        elif isinstance(value, float):
            value, datatype = repr(value), XSD + "double"
        elif isinstance(value, Decimal):
            datatype = XSD + "decimal"
        elif isinstance(value, dt.datetime):
            value, datatype = value.isoformat(), XSD + "dateTime"
        elif isinstance(value, dt.date):
            value, datatype = value.isoformat(), XSD + "date"
    if datatype in (None, XSD + "string"):
        return f'"{escape(str(value))}"'
    return f'"{escape(str(value))}"^^<{datatype}>'


_LITERAL = re.compile(r'^"(.*)"(?:\^\^<([^>]*)>|@([A-Za-z0-9-]+))?$', re.S)


def decode(token: str | None):
    """The Python value of a token: IRIs and blank nodes as str."""
    if token is None:
        return None
    if token.startswith("<"):
        return token[1:-1]
    m = _LITERAL.match(token)
    if not m:
        return token
    text, kind = unescape(m[1]), (m[2] or "").removeprefix(XSD)
    try:
        if kind in INTEGERS:
            return int(text)
        if kind in ("double", "float"):
            return float(text)
        if kind == "decimal":
            return Decimal(text)
        if kind == "boolean":
            return text in ("true", "1")
        if kind == "dateTime":
            return dt.datetime.fromisoformat(text)
        if kind == "date":
            return dt.date.fromisoformat(text)
    except (ValueError, ArithmeticError):
        pass
    return text


# Columns


def is_iri(t: Column) -> Column:
    return t.startswith("<")


def is_blank(t: Column) -> Column:
    return t.startswith("_:")


def is_literal(t: Column) -> Column:
    return t.startswith('"')


def lexical(t: Column) -> Column:
    """The text of a term: an IRI without brackets, a literal without quotes and escapes."""
    raw = F.regexp_extract(t, r'(?s)^"(.*)"(?:\^\^<[^>]*>|@[A-Za-z0-9-]+)?$', 1)
    plain = raw
    for code, char in (("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ('\\"', '"')):
        plain = F.replace(plain, F.lit(code), F.lit(char))
    plain = F.replace(plain, F.lit("\\\\"), F.lit("\\"))
    # A backslash before another escape needs care: only such literals pay for it.
    careful = F.array_join(F.transform(F.split(raw, r"\\\\"), lambda x: _simple(x)), "\\")
    text = F.when(raw.contains("\\\\"), careful).otherwise(plain)
    return F.when(is_iri(t), F.substr(t, F.lit(2), F.length(t) - 2)).when(is_blank(t), t).when(raw.contains("\\"), text).otherwise(raw)


def _simple(x: Column) -> Column:
    for code, char in (("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ('\\"', '"')):
        x = F.replace(x, F.lit(code), F.lit(char))
    return x


def datatype(t: Column) -> Column:
    """The datatype's IRI; null for IRIs and blank nodes."""
    found = F.regexp_extract(t, r'(?s)^".*"\^\^<([^>]*)>$', 1)
    return F.when(is_literal(t), F.when(found != "", found).when(t.endswith('"'), XSD + "string").otherwise(RDF + "langString"))


def lang(t: Column) -> Column:
    return F.when(is_literal(t), F.regexp_extract(t, r'(?s)^".*"@([A-Za-z0-9-]+)$', 1))


def number(t: Column) -> Column:
    """The value of a numeric literal as double."""
    kinds = "|".join(NUMERIC)
    text = F.regexp_extract(t, rf'^"([^"]*)"\^\^<{re.escape(XSD)}(?:{kinds})>$', 1)
    return F.when(text != "", text.try_cast("double"))


def exact(t: Column) -> Column:
    """The value of an integer or decimal literal, nine digits behind the point."""
    kinds = "|".join([*INTEGERS, "decimal"])
    text = F.regexp_extract(t, rf'^"([^"]*)"\^\^<{re.escape(XSD)}(?:{kinds})>$', 1)
    return F.when(text != "", text.try_cast("decimal(38,9)"))


def timestamp(t: Column) -> Column:
    text = F.regexp_extract(t, rf'^"([^"]*)"\^\^<{re.escape(XSD)}date(?:Time)?>$', 1)
    return F.when(text != "", text.try_cast("timestamp"))


def boolean(t: Column) -> Column:
    text = F.regexp_extract(t, rf'^"([^"]*)"\^\^<{re.escape(XSD)}boolean>$', 1)
    return F.when(text.isin("true", "1"), True).when(text.isin("false", "0"), False)


def encode_iri(text: Column) -> Column:
    return F.concat(F.lit("<"), text, F.lit(">"))


def encode(value: Column, kind: str) -> Column:
    """The token of a typed column; kind: str, int, num, bool, ts, ntz (a timestamp without zone, taken as UTC)."""
    if kind == "str":
        text = value
        for char, code in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
            text = F.replace(text, F.lit(char), F.lit(code))
        return F.concat(F.lit('"'), text, F.lit('"'))
    if kind == "ntz":
        text, name = F.concat(F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z")), "dateTime"
    elif kind == "ts":
        text, name = F.concat(F.date_format(F.to_utc_timestamp(value, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z")), "dateTime"
    else:
        text, name = value.cast("string"), {"int": "integer", "num": "double", "bool": "boolean", "dec": "decimal"}[kind]
    return F.concat(F.lit('"'), text, F.lit(f'"^^<{XSD}{name}>'))
