"""SPARQL expressions as columns. A Value is a column of tokens, or typed (int, num, bool, str, ts); errors are null."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

from trellis.functions import terms as T


class Value:
    def __init__(self, column: Column, kind: str = "term", whole: Column | None = None, constant: str | None = None, precise: Column | None = None):
        """whole: whether a num is an integer; precise: that integer as a decimal, for what a double can't hold."""
        self.column, self.kind, self.whole, self.constant, self.precise = column, kind, whole, constant, precise

    def token(self) -> Column:
        if self.kind == "term":
            return self.column
        if self.kind == "num" and self.whole is not None:
            return F.when(self.column.isNotNull(), F.when(self.whole, T.encode(self.column.try_cast("bigint") if self.precise is None else self.precise, "int")).otherwise(T.encode(self.column, "num")))
        return T.encode(self.column, self.kind)

    def number(self) -> Column:
        return T.number(self.column) if self.kind == "term" else self.column if self.kind in ("int", "num") else F.lit(None).cast("double")

    def exact(self) -> Column:
        """The value of an integer or decimal; null for doubles."""
        if self.precise is not None:
            return F.when(self.whole, self.precise)
        return T.exact(self.column) if self.kind == "term" else self.column.try_cast("decimal(38,9)") if self.kind == "int" else F.lit(None).cast("decimal(38,9)")

    def is_whole(self) -> Column:
        if self.kind == "term":
            return F.coalesce(self.column.rlike(rf'\^\^<{T.XSD}(?:{"|".join(T.INTEGERS)})>$'), F.lit(False))
        return F.lit(self.kind == "int") if self.whole is None else self.whole

    def timestamp(self) -> Column:
        return T.timestamp(self.column) if self.kind == "term" else self.column if self.kind == "ts" else F.lit(None).cast("timestamp")

    def string(self) -> Column:
        """STR(): the lexical form."""
        return T.lexical(self.column) if self.kind == "term" else self.column if self.kind == "str" else T.lexical(self.token())

    def order_keys(self) -> list[Column]:
        """Unbound, blank nodes, IRIs, literals; numbers and times by value."""
        t = self.token()
        rank = F.when(T.is_blank(t), 1).when(T.is_iri(t), 2).when(t.isNotNull(), 3)
        return [rank.alias("k0"), self.number().alias("k1"), self.timestamp().alias("k2"), self.string().alias("k3")]


_EXACT = float(2**53)


def truth(v: Value) -> Column:
    """The effective boolean value; null for an error."""
    if v.kind == "bool":
        return v.column
    if v.kind in ("int", "num"):
        return v.column != 0
    if v.kind == "str":
        return v.column != ""
    t = v.column
    return F.coalesce(T.boolean(t), T.number(t) != 0, F.when(T.datatype(t).isin(T.XSD + "string", T.RDF + "langString"), T.lexical(t) != ""))


def compare(op: str, a: Value, b: Value) -> Column:
    def relate(x: Column, y: Column) -> Column:
        return {"=": x == y, "!=": x != y, "<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[op]

    if a.kind == "bool" and b.kind == "bool":
        return relate(a.column, b.column)
    if "str" in (a.kind, b.kind) and {a.kind, b.kind} <= {"str"}:
        return relate(a.column, b.column)
    if op in ("=", "!="):
        for x, y in ((a, b), (b, a)):  # an IRI or plain string equals its own token alone
            if x.constant is not None and (x.constant.startswith("<") or x.constant.endswith('"')):
                return relate(y.token(), x.column)
    # Doubles hold integers up to 2^53; beyond, digits are compared.
    p, q = a.number(), b.number()
    numbers = F.when((F.abs(p) >= _EXACT) & (F.abs(q) >= _EXACT), F.coalesce(relate(a.exact(), b.exact()), relate(p, q))).otherwise(relate(p, q))
    times = relate(a.timestamp(), b.timestamp())
    x, y = a.token(), b.token()
    if op in ("=", "!="):
        return F.coalesce(numbers, times, relate(x, y))
    same = T.datatype(x) == T.datatype(y)
    return F.coalesce(numbers, times, F.when(same, relate(a.string(), b.string())))


def _text(v: Value, out: Column) -> Value:
    """A string function keeps the argument's language."""
    if v.kind != "term":
        return Value(out, "str")
    tag = T.lang(v.column)
    return Value(F.when(F.coalesce(tag, F.lit("")) != "", F.concat(T.encode(out, "str"), F.lit("@"), tag)).otherwise(T.encode(out, "str")))


def _iri(v: Value) -> Value:
    return Value(F.when(T.is_iri(v.token()), v.token()).otherwise(T.encode_iri(v.string())))


def _uri_encoded(x: Column) -> Column:
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        x = F.replace(x if a != "+" else F.url_encode(x), F.lit(a), F.lit(b))
    return x


def _zone(text: Column) -> Column:
    return F.regexp_extract(text, r"T.*?(Z|[+-]\d{2}:\d{2})$", 1)


def _duration(zone: Column) -> Column:
    hours, minutes = (F.substring(zone, at, 2).try_cast("int") for at in (2, 5))
    part = lambda n, unit: F.when(n != 0, F.concat(n.cast("string"), F.lit(unit))).otherwise("")
    some = F.coalesce((hours != 0) | (minutes != 0), F.lit(False))
    return F.when(some, F.concat(F.when(zone.startswith("-"), "-").otherwise(""), F.lit("PT"), part(hours, "H"), part(minutes, "M"))).otherwise("PT0S")


def _pattern(args: list[Value], at: int) -> Column:
    flags = F.concat(F.lit("(?"), args[at].string(), F.lit(")")) if len(args) > at else F.lit("")
    return F.concat(flags, args[1].string())


def _cast(name: str, v: Value) -> Value:
    text = F.trim(v.string())
    kind = name.removeprefix(T.XSD)
    if kind in T.INTEGERS:
        n = F.coalesce(F.when(v.number().isNotNull(), v.number().try_cast("bigint")), F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("bigint")), T.boolean(v.token()).cast("bigint"))
        return Value(n, "int")
    if kind in ("double", "float"):
        return Value(F.coalesce(v.number(), text.try_cast("double")), "num")
    if kind == "decimal":
        return Value(T.encode(F.coalesce(v.number(), text.try_cast("double")), "dec"))
    if kind == "boolean":
        return Value(F.coalesce(truth(v) if v.kind != "str" else None, F.when(text.isin("true", "1"), True).when(text.isin("false", "0"), False)) if v.kind != "str" else F.when(text.isin("true", "1"), True).when(text.isin("false", "0"), False), "bool")
    if kind == "dateTime":
        return Value(F.when(text.try_cast("timestamp").isNotNull(), F.concat(T.encode(text, "str"), F.lit(f"^^<{T.XSD}dateTime>"))))
    if kind == "date":
        return Value(F.when(text.try_cast("date").isNotNull(), F.concat(T.encode(F.substring(text, 1, 10), "str"), F.lit(f"^^<{T.XSD}date>"))))
    if kind == "string":
        return Value(v.string(), "str")
    raise ValueError(f"unknown function {name}")


def call(name: str, a: list[Value], raw: list, columns: dict) -> Value:
    """A built-in function or cast."""
    if name.startswith("<"):
        return _cast(name[1:-1], a[0])
    s = [x.string for x in a]
    t = [x.token for x in a]
    n = [x.number for x in a]
    date = lambda f: Value(F.when(a[0].timestamp().isNotNull(), f(a[0].timestamp())), "int")
    table = {
        "BOUND": lambda: Value(t[0]().isNotNull() if raw[0][1] in columns else F.lit(False), "bool"),
        "STR": lambda: Value(s[0](), "str"),
        "LANG": lambda: Value(T.lang(t[0]()), "str"),
        "DATATYPE": lambda: Value(T.encode_iri(T.datatype(t[0]()))),
        "ISIRI": lambda: Value(T.is_iri(t[0]()), "bool"),
        "ISURI": lambda: Value(T.is_iri(t[0]()), "bool"),
        "ISBLANK": lambda: Value(T.is_blank(t[0]()), "bool"),
        "ISLITERAL": lambda: Value(T.is_literal(t[0]()), "bool"),
        "ISNUMERIC": lambda: Value(F.when(t[0]().isNotNull(), n[0]().isNotNull()), "bool"),
        "SAMETERM": lambda: Value(t[0]() == t[1](), "bool"),
        "IRI": lambda: _iri(a[0]),
        "URI": lambda: _iri(a[0]),
        "CONTAINS": lambda: Value(s[0]().contains(s[1]()), "bool"),
        "STRSTARTS": lambda: Value(s[0]().startswith(s[1]()), "bool"),
        "STRENDS": lambda: Value(s[0]().endswith(s[1]()), "bool"),
        "STRLEN": lambda: Value(F.length(s[0]()).cast("bigint"), "int"),
        "UCASE": lambda: _text(a[0], F.upper(s[0]())),
        "LCASE": lambda: _text(a[0], F.lower(s[0]())),
        "CONCAT": lambda: Value(F.concat(*[x() for x in s]), "str"),
        "SUBSTR": lambda: _text(a[0], F.substr(s[0](), n[1]().cast("int"), n[2]().cast("int") if len(a) > 2 else F.lit(2**31 - 1))),
        "STRBEFORE": lambda: _text(a[0], F.when(s[0]().contains(s[1]()), F.substr(s[0](), F.lit(1), F.position(s[1](), s[0]()) - 1)).otherwise(F.lit(""))),
        "STRAFTER": lambda: _text(a[0], F.when(s[0]().contains(s[1]()), F.substr(s[0](), F.position(s[1](), s[0]()) + F.length(s[1]()))).otherwise(F.lit(""))),
        "ENCODE_FOR_URI": lambda: Value(_uri_encoded(s[0]()), "str"),
        "REGEX": lambda: Value(F.rlike(s[0](), _pattern(a, 2)), "bool"),
        "REPLACE": lambda: _text(a[0], F.regexp_replace(s[0](), _pattern(a, 3), s[2]())),
        "LANGMATCHES": lambda: Value(F.when(s[1]() == "*", s[0]() != "").otherwise((F.lower(s[0]()) == F.lower(s[1]())) | F.lower(s[0]()).startswith(F.concat(F.lower(s[1]()), F.lit("-")))), "bool"),
        "ABS": lambda: Value(F.abs(n[0]()), "num", whole=a[0].is_whole()),
        "CEIL": lambda: Value(F.ceil(n[0]()).cast("double"), "num", whole=a[0].is_whole()),
        "FLOOR": lambda: Value(F.floor(n[0]()).cast("double"), "num", whole=a[0].is_whole()),
        "ROUND": lambda: Value(F.floor(n[0]() + 0.5).cast("double"), "num", whole=a[0].is_whole()),
        "YEAR": lambda: date(F.year), "MONTH": lambda: date(F.month), "DAY": lambda: date(F.day),
        "HOURS": lambda: date(F.hour), "MINUTES": lambda: date(F.minute), "SECONDS": lambda: date(F.second),
        "TZ": lambda: Value(F.when(a[0].timestamp().isNotNull(), _zone(s[0]())), "str"),
        "TIMEZONE": lambda: Value(F.when(a[0].timestamp().isNotNull() & (_zone(s[0]()) != ""), F.concat(T.encode(_duration(_zone(s[0]())), "str"), F.lit(f"^^<{T.XSD}dayTimeDuration>")))),
        "NOW": lambda: Value(F.current_timestamp(), "ts"),
        "MD5": lambda: Value(F.md5(s[0]()), "str"), "SHA1": lambda: Value(F.sha1(s[0]()), "str"),
        "SHA256": lambda: Value(F.sha2(s[0](), 256), "str"), "SHA384": lambda: Value(F.sha2(s[0](), 384), "str"), "SHA512": lambda: Value(F.sha2(s[0](), 512), "str"),
        "STRUUID": lambda: Value(F.uuid(), "str"), "UUID": lambda: Value(F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">"))),
        "RAND": lambda: Value(F.rand(), "num"),
        "BNODE": lambda: Value(F.concat(F.lit("_:f"), F.replace(F.uuid(), F.lit("-"), F.lit("")))),
        "STRDT": lambda: Value(F.concat(T.encode(s[0](), "str"), F.lit("^^"), t[1]())),
        "STRLANG": lambda: Value(F.concat(T.encode(s[0](), "str"), F.lit("@"), s[1]())),
    }
    if name == "IF":
        c = truth(a[0])
        return Value(F.when(c, t[1]()).when(~c, t[2]()))
    if name == "COALESCE":
        return Value(functools.reduce(lambda x, y: F.coalesce(x, y), [x() for x in t]))
    if name not in table:
        raise ValueError(f"unknown function {name}")
    return table[name]()
