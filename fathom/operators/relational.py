"""The SQL surface: what a statement may contain, typed parameters, PostgreSQL's order of nulls."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from fathom.constants import SQL_BYTES, SQL_DEPTH
from fathom.errors import require

#: Words that name an operation outside the subset.
REFUSED = {"union": "0A000", "intersect": "0A000", "except": "0A000", "lateral": "0A000", "recursive": "0A000", "rollup": "0A000", "cube": "0A000", "over": "0A000", "window": "0A000", "pivot": "0A000", "tablesample": "0A000", "qualify": "0A000", "right": "0A000", "full": "0A000", "cross": "0A000", "natural": "0A000"}
_TOKEN = re.compile(r"""\s+|--[^\n]*|/\*.*?\*/|'(?:[^']|'')*'|"(?:[^"]|"")*"|`[^`]*`|\$\d+|[A-Za-z_]\w*|\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|<=>|<->|<#>|<=|>=|<>|!=|::|\|\||.""", re.S)


@dataclass(frozen=True)
class Token:
    text: str
    word: str  # lower case where it is a bare word, else empty


def lex(sql: str) -> list[Token]:
    out = []
    for m in _TOKEN.finditer(sql):
        t = m[0]
        if t.isspace() or t.startswith("--") or t.startswith("/*"):
            continue
        out.append(Token(t, t.lower() if re.match(r"[A-Za-z_]", t) else ""))
    return out


def checked(sql: str, strict: bool = True) -> list[Token]:
    """Tokens of one complete statement; refuses what the subset leaves out."""
    require(len(sql.encode()) <= SQL_BYTES, "54000", "the statement is too long")
    tokens = lex(sql)
    while tokens and tokens[-1].text == ";":
        tokens.pop()
    require(bool(tokens), "42601", "an empty statement")
    require(all(t.text != ";" for t in tokens), "42601", "one statement at a time")
    require(all(t.text != "?" for t in tokens), "42601", "parameters are written $1, $2, ...")
    depth = most = 0
    for t in tokens:
        depth += (t.text == "(") - (t.text == ")")
        most = max(most, depth)
        require(depth >= 0, "42601", "unbalanced parentheses")
        require(t.text != "[" or not strict, "0A000", "array expressions are not supported")
        require(not strict or t.word not in REFUSED, "0A000", f"{t.text} is not supported")
    require(depth == 0, "42601", "unbalanced parentheses")
    require(most <= SQL_DEPTH, "54001", "the statement is nested too deeply")
    return tokens


def null_order(tokens: Sequence[Token]) -> list[str]:
    """The statement's words with NULLS LAST after ascending and NULLS FIRST after descending ORDER BY items."""
    out: list[str] = []
    stack: list[bool] = [False]  # whether an ORDER BY is open at each depth
    pending = ""

    def close() -> None:
        nonlocal pending
        if stack[-1] and pending:
            out.append(pending)
        pending = ""

    i = 0
    while i < len(tokens):
        t = tokens[i]
        if t.text == "(":
            stack.append(False)
            saved = pending
            out.append(t.text)
            i += 1
            inner, level = i, 1
            while level:
                level += (tokens[i].text == "(") - (tokens[i].text == ")")
                i += 1
            stack.pop()
            out += null_order(tokens[inner : i - 1])
            out.append(")")
            pending = saved
            continue
        if t.word == "order" and i + 1 < len(tokens) and tokens[i + 1].word == "by":
            out += ["ORDER", "BY"]
            stack[-1], pending = True, "NULLS LAST"
            i += 2
            continue
        if stack[-1]:
            if t.text == ",":
                close()
                out.append(",")
                pending = "NULLS LAST"
                i += 1
                continue
            if t.word in ("asc", "desc"):
                pending = "NULLS FIRST" if t.word == "desc" else "NULLS LAST"
            elif t.word == "nulls":
                pending = ""
            elif t.word in ("limit", "offset", "fetch", "for"):
                close()
                stack[-1] = False
        out.append(t.text)
        i += 1
    close()
    return out


def statement(sql: str, strict: bool = True) -> str:
    """Spark's form of a read-only statement: $n becomes :pn, quoted names become backticks, nulls get their order."""
    tokens = checked(sql, strict)
    require(tokens[0].word in ("select", "with"), "0A000", "only SELECT can be read")
    words = null_order(tokens)
    named = []
    for w in words:
        if re.fullmatch(r"\$\d+", w):
            w = f":p{w[1:]}"
        elif w.startswith('"'):
            w = "`" + w[1:-1].replace('""', '"') + "`"
        elif w.startswith("'"):
            # SQL doubles quotes and knows no backslash escapes
            w = "r'" + w[1:-1] + "'" if "''" not in w else "'" + w[1:-1].replace("\\", "\\\\").replace("''", "\\'") + "'"
        named.append(w)
    return _joined(named)


def _joined(words: Sequence[str]) -> str:
    out = ""
    for w in words:
        out += w if w == "." or out.endswith(".") or not out else f" {w}"
    return out


def select(spark: SparkSession, sql: str, parameters: Sequence = (), tables: Mapping[str, DataFrame] | None = None, strict: bool = True) -> DataFrame:
    """Run a read-only statement over named DataFrames with $1, $2, ... bound to typed values."""
    text = statement(sql, strict)
    for name, df in (tables or {}).items():
        df.createOrReplaceTempView(name)
    try:  # names are resolved here, so no later statement sees these tables
        return spark.sql(text, args={f"p{i}": v for i, v in enumerate(parameters, 1)} or None)
    except AnalysisException as e:
        require(e.getCondition() != "TABLE_OR_VIEW_NOT_FOUND", "42P01", str(e).split("\n")[0])
        raise
    finally:
        for name in tables or {}:
            spark.catalog.dropTempView(name)
