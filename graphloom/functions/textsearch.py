"""Text search: documents as arrays of words in order, queries as text of a small language (& and, | or, ! not, <-> next, <n> at distance n)."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def words(x: Column) -> Column:
    """Lower-case words in order; a word's place is its index."""
    return F.array_remove(F.split(F.lower(x), r"[^\p{L}\p{N}]+"), "")


def to_tsvector(x: Column, kind: T.DataType) -> Column:
    return x if isinstance(kind, T.ArrayType) else words(x)


def is_query(t: T.DataType) -> bool:
    return isinstance(t, T.StructType) and t.names == ["query"]


def query(x: Column) -> Column:
    return F.struct(x.alias("query"))


def text_of(x: Column, kind: T.DataType) -> Column:
    return x.getField("query") if is_query(kind) else x


def plain(c, type_of) -> Column:
    return query(F.array_join(words(c[0]), " & "))


def phrase(c, type_of) -> Column:
    return query(F.array_join(words(c[0]), " <-> "))


def websearch(c, type_of) -> Column:
    """Words are joined by and; "or" and a leading minus work, quotes make phrases."""
    t = F.regexp_replace(F.lower(c[0]), r'"([^"]*)"', "\u0001$1\u0002")
    parts = F.filter(F.regexp_extract_all(t, F.lit("(-?\u0001[^\u0002]*\u0002|\\S+)"), F.lit(1)), lambda w: w != "")
    made = F.transform(parts, lambda w: F.concat(F.when(w.startswith("-"), "!").otherwise(""), F.when(F.contains(w, F.lit("\u0001")), F.concat(F.lit("("), F.array_join(words(w), " <-> "), F.lit(")"))).otherwise(F.array_join(words(w), " & "))))
    joined = F.array_join(made, " & ")
    return query(F.regexp_replace(joined, " & or & ", " | "))


def joined(a: Column, op: Column | str, b: Column) -> Column:
    """Two queries with an operator between; brackets only where they are needed."""
    part = lambda x: F.when(F.rlike(x, F.lit(r"[\s&|<]")), F.concat(F.lit("("), x, F.lit(")"))).otherwise(x)
    return query(F.concat(part(a), F.lit(" "), F.lit(op) if isinstance(op, str) else op, F.lit(" "), part(b)))


def tsquery_phrase(c, type_of) -> Column:
    n = F.concat(F.lit("<"), c[2].cast("int").cast("string"), F.lit(">")) if len(c) == 3 else F.lit("<->")
    return joined(text_of(c[0], type_of(c[0])), n, text_of(c[1], type_of(c[1])))


#: Between the words of a document that is searched for a phrase.
MARK = "\u0001"
TOKEN = re.compile(r"\s*(<->|<\d+>|[&|!()]|'[^']*'|[^\s&|!()<>]+)")


def compile_query(text: str):
    """A function from an array of words to a boolean Column. Phrases give the places where they end."""
    tokens = TOKEN.findall(text.lower())
    at = 0

    def peek():
        return tokens[at] if at < len(tokens) else None

    def take():
        nonlocal at
        at += 1
        return tokens[at - 1]

    def either():
        left = both()
        while peek() == "|":
            take()
            left = ("or", left, both())
        return left

    def both():
        left = follows()
        while peek() == "&":
            take()
            left = ("and", left, follows())
        return left

    def follows():
        left = one()
        while (p := peek()) and p.startswith("<"):
            n = 1 if take() == "<->" else int(p[1:-1])
            left = ("next", n, left, one())
        return left

    def one():
        t = take()
        if t == "!":
            return ("not", one())
        if t == "(":
            inner = either()
            take()
            return inner
        return ("word", t.strip("'").removesuffix(":*"), t.endswith(":*"))

    tree = either() if tokens else None

    def chain(n) -> list[tuple[int, str]] | None:
        """A phrase of whole words as their distances from the ones before; None if it holds anything else."""
        if n[0] == "word":
            return None if n[2] or not n[1] or MARK in n[1] or "\\E" in n[1] else [(0, n[1])]
        if n[0] != "next" or n[1] < 1 or n[3][0] != "word":
            return None
        left, right = chain(n[2]), chain(n[3])
        return [*left, (n[1], right[0][1])] if left and right else None

    def places(n, doc: Column) -> Column:
        if n[0] == "word":
            hit = (lambda w: w.startswith(n[1])) if n[2] else (lambda w: w == n[1])
            return F.filter(F.transform(doc, lambda w, i: F.when(hit(w), i).otherwise(-1)), lambda i: i >= 0)
        if n[0] == "next":
            # Both sides once for a document; inside a lambda the left one would be computed for each place of the right one.
            return F.array_intersect(places(n[3], doc), F.transform(places(n[2], doc), lambda i: i + n[1]))
        if n[0] == "or":
            return F.array_union(places(n[1], doc), places(n[2], doc))
        return F.array_intersect(places(n[1], doc), places(n[2], doc))

    def truth(n, doc: Column) -> Column:
        if n[0] == "and":
            return truth(n[1], doc) & truth(n[2], doc)
        if n[0] == "or":
            return truth(n[1], doc) | truth(n[2], doc)
        if n[0] == "not":
            return ~truth(n[1], doc)
        if n[0] == "word" and not n[2]:
            return F.array_contains(doc, n[1])
        if n[0] == "word":
            return F.exists(doc, lambda w: w.startswith(n[1]))
        if words_of := chain(n):
            # A text of the words between marks that no word has, nor the sign of a null.
            text = F.concat(F.lit(MARK), F.array_join(doc, MARK, "\u0002"), F.lit(MARK))
            if all(d == 1 for d, _ in words_of[1:]):
                return F.contains(text, F.lit(MARK + MARK.join(w for _, w in words_of) + MARK))
            between = f"[^{MARK}]*{MARK}"
            return F.rlike(text, F.lit(MARK + "".join(f"(?:{between}){{{max(d - 1, 0)}}}\\Q{w}\\E{MARK}" for d, w in words_of)))
        return F.size(places(n, doc)) > 0

    return (lambda doc: truth(tree, doc)) if tree else lambda doc: F.lit(False)


def matches(doc: Column, kind: T.DataType, query: Column) -> Column:
    """The query must not read rows: it is computed once, and compiled."""
    try:
        text = SparkSession.getActiveSession().range(1).select(query.alias("q")).first()[0]
    except AnalysisException:
        raise ValueError("a text query must be the same for all rows") from None
    return compile_query(text)(to_tsvector(doc, kind)) if text is not None else F.lit(None).cast("boolean")


FUNCTIONS = {
    "to_tsvector": lambda c, t: words(c[0]), "plainto_tsquery": plain, "phraseto_tsquery": phrase, "websearch_to_tsquery": websearch, "tsquery_phrase": tsquery_phrase,
    "ts_delete": lambda c, t: F.array_except(c[0], c[1] if isinstance(t(c[1]), T.ArrayType) else F.array(c[1])), "strip": lambda c, t: F.array_sort(F.array_distinct(c[0])),
}
PREFIX = {"!!": lambda x, t: query(F.concat(F.lit("!("), text_of(x, t(x)), F.lit(")")))}
CASTS = {"tsvector": to_tsvector, "tsquery": lambda x, k: x if is_query(k) else query(x)}


def operator(op, a, b, ta, tb):
    if op == "@@" and (is_query(tb) or isinstance(tb, T.StringType) and not is_query(ta)):
        return matches(a, ta, text_of(b, tb))
    if op == "@@" and (is_query(ta) or isinstance(tb, T.ArrayType)):
        return matches(b, tb, text_of(a, ta))
    if is_query(ta) and is_query(tb):
        x, y = text_of(a, ta), text_of(b, tb)
        if op in ("||", "&&", "|", "&"):
            return joined(x, op[0], y)
        if op == "<->":
            return joined(x, "<->", y)
        if op in ("@>", "<@"):
            whole, part = (x, y) if op == "@>" else (y, x)
            return F.size(F.array_except(words(part), words(whole))) == 0
    return None
