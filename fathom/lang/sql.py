"""SQL statements over a transaction's tables: reads go to Spark SQL, changes to ``operators.changes``."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import asdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathom.constants import SQL_STATEMENTS
from fathom.errors import EngineError, require
from fathom.operators import changes, relational
from fathom.operators.changes import Constraints, ForeignKey
from fathom.operators.relational import Token
from fathom.plans.store import Transaction

#: SQL spellings of column types.
TYPES = {
    "boolean": "boolean", "bool": "boolean", "smallint": "smallint", "integer": "int", "int": "int", "bigint": "bigint", "real": "float", "float": "double",
    "double": "double", "text": "string", "varchar": "string", "bytea": "binary", "date": "date", "timestamptz": "timestamp", "timestamp": "timestamp",
    "uuid": "string", "jsonb": "string",
}
ACTIONS = ("no action", "restrict", "cascade", "set null", "set default")


class Words:
    """A cursor over the tokens of a statement."""

    def __init__(self, tokens: Sequence[Token]) -> None:
        self.t, self.i = list(tokens), 0

    @property
    def done(self) -> bool:
        return self.i >= len(self.t)

    def peek(self, k: int = 0) -> Token:
        return self.t[self.i + k] if self.i + k < len(self.t) else Token("", "")

    def take(self, *words: str) -> bool:
        if all(self.peek(k).word == w or self.peek(k).text == w for k, w in enumerate(words)):
            self.i += len(words)
            return True
        return False

    def want(self, *words: str) -> None:
        require(self.take(*words), "42601", f"expected {' '.join(words).upper()} at {self.peek().text or 'the end'}")

    def name(self) -> str:
        t = self.peek()
        self.i += 1
        if t.text.startswith('"'):
            return t.text[1:-1].replace('""', '"')
        require(bool(t.word), "42601", f"expected a name at {t.text or 'the end'}")
        return t.word

    def names(self) -> list[str]:
        self.want("(")
        out = [self.name()]
        while self.take(","):
            out.append(self.name())
        self.want(")")
        return out

    def until(self, *stops: str) -> list[Token]:
        """Tokens up to one of the words (or a comma or parenthesis) outside parentheses."""
        out, depth = [], 0
        while not self.done:
            t = self.peek()
            if depth == 0 and (t.word in stops or t.text in stops or t.text == ")"):
                break
            depth += (t.text == "(") - (t.text == ")")
            out.append(t)
            self.i += 1
        return out


def literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, (int, float)):
        return repr(value)
    if isinstance(value, (list, tuple)):
        return "array(" + ", ".join(f"{float(v)!r}D" for v in value) + ")"
    if isinstance(value, bytes):
        return f"X'{value.hex()}'"
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def expression(tokens: Sequence[Token], parameters: Sequence = ()) -> str:
    """Spark's spelling of a scalar expression or condition."""
    out, i = [], 0
    while i < len(tokens):
        t = tokens[i]
        if re.fullmatch(r"\$\d+", t.text):
            n = int(t.text[1:])
            require(1 <= n <= len(parameters), "42P02", f"no value for {t.text}")
            out.append(literal(parameters[n - 1]))
        elif t.word == "record_ref" and i + 3 < len(tokens) and tokens[i + 1].text == "(" and tokens[i + 3].text == ",":
            out.append(f"named_struct('namespace', {tokens[i + 2].text}, 'id', ")
            i += 3
        elif t.text.startswith('"'):
            out.append("`" + t.text[1:-1].replace('""', '"') + "`")
        elif t.text.startswith("'"):
            out.append(literal(t.text[1:-1].replace("''", "'")))
            if i + 2 < len(tokens) and tokens[i + 1].text == "::" and tokens[i + 2].word == "vector":
                out[-1] = f"from_json({out[-1]}, 'array<double>')"
                i += 2
        else:
            out.append(t.text)
        i += 1
    return relational._joined(out)


def constraints(meta: dict) -> Constraints:
    c = meta["constraints"]
    return Constraints(tuple(c["primary_key"]), {k: tuple(v) for k, v in c["unique"].items()}, c["checks"], tuple(c["not_null"]), c["lengths"], c["vectors"], c["references"])


def foreign_keys(tx: Transaction, deferred: bool = False) -> dict[str, list[ForeignKey]]:
    out: dict[str, list[ForeignKey]] = {}
    for t in tx.names("table"):
        for k in tx.meta(t)["foreign_keys"]:
            fk = ForeignKey(**{**k, "columns": tuple(k["columns"]), "parent_columns": tuple(k["parent_columns"])})
            out.setdefault(t, []).append(fk)
    return out


def tables(tx: Transaction) -> dict[str, DataFrame]:
    return {t: tx.read(t) for t in tx.names("table")}


def execute(tx: Transaction, sql: str, parameters: Sequence = (), strict: bool = True) -> tuple[DataFrame | None, int | None]:
    """(rows, affected). Rows are those of a SELECT, EXPLAIN or RETURNING; changes are staged in the transaction."""
    w = Words(relational.checked(sql, False))
    head = w.peek().word
    if head in ("select", "with"):
        known = set(tx.names("table"))
        used = {t.word for t in w.t if t.word} | {t.text.strip('"') for t in w.t if t.text.startswith('"')}
        return relational.select(tx.store.spark, sql, parameters, {t: tx.read(t) for t in known & used}, strict), None
    if head == "explain":
        require(w.peek(1).word != "analyze", "0A000", "EXPLAIN ANALYZE is not supported")
        df, _ = execute(tx, re.sub(r"(?is)^\s*explain", "", sql), parameters, strict)
        plan = df._jdf.queryExecution().simpleString() if df is not None else ""
        return tx.store.spark.createDataFrame([(line,) for line in plan.splitlines()], "plan string"), None
    handler = {"insert": _insert, "update": _update, "delete": _delete, "create": _create, "drop": _drop, "alter": _alter, "set": _set}.get(head)
    require(handler is not None, "0A000", f"{head or w.peek().text} is not supported")
    w.i += 1
    return handler(tx, w, parameters)


def script(tx: Transaction, statements: Sequence[str]) -> list[tuple[DataFrame | None, int | None]]:
    require(len(statements) <= SQL_STATEMENTS, "54000", f"at most {SQL_STATEMENTS} statements")
    return [execute(tx, s) for s in statements]


def _table(tx: Transaction, name: str) -> DataFrame:
    require(tx.has(name) and tx.kind(name) == "table", "42P01", f"no table {name}")
    return tx.read(name)


def _returning(w: Words, rows: DataFrame, parameters: Sequence) -> DataFrame | None:
    if not w.take("returning"):
        require(w.done, "42601", f"unexpected {w.peek().text}")
        return None
    items = [expression(w.until(","), parameters)]
    while w.take(","):
        items.append(expression(w.until(","), parameters))
    return rows.selectExpr(*items)


def _insert(tx: Transaction, w: Words, parameters: Sequence):
    w.want("into")
    name = w.name()
    target, meta = _table(tx, name), tx.meta(name)
    columns = w.names() if w.peek().text == "(" else list(target.columns)
    for c in columns:
        require(c in target.columns, "42703", f"no column {c}")
    spark = tx.store.spark
    if w.take("values"):
        rows = []
        while True:
            w.want("(")
            cells = [expression(w.until(","), parameters)]
            while w.take(","):
                cells.append(expression(w.until(","), parameters))
            w.want(")")
            require(len(cells) == len(columns), "42601", "a row has another number of values than columns")
            rows.append(cells)
            if not w.take(","):
                break
        # DEFAULT stands for the column's own
        rows = [[meta["defaults"].get(c, "NULL") if x.lower() == "default" else x for c, x in zip(columns, r, strict=True)] for r in rows]
        each = " UNION ALL ".join("SELECT " + ", ".join(f"CAST({x} AS {target.schema[c].dataType.simpleString()}) AS `{c}`" for c, x in zip(columns, r, strict=True)) + f", {i} AS `_row`" for i, r in enumerate(rows))
        given = spark.sql(each)
    else:
        body = w.until("on", "returning")
        found = relational.select(spark, _plain(body), parameters, tables(tx))
        given = found.select(*[F.col(f"`{f}`").cast(target.schema[c].dataType).alias(c) for f, c in zip(found.columns, columns, strict=True)]).withColumn("_row", F.monotonically_increasing_id())
    for c in target.columns:
        if c in columns:
            continue
        if c in meta["identity"]:
            top = target.agg(F.max(c)).head()[0] or 0
            given = given.withColumn(c, (F.row_number().over(Window.orderBy("_row")) + top).cast(target.schema[c].dataType))
        else:
            given = given.withColumn(c, F.expr(meta["defaults"].get(c, "NULL")).cast(target.schema[c].dataType))
    given = given.select(*target.columns)
    own = constraints(meta)
    if w.take("on", "conflict"):
        key = w.names() if w.peek().text == "(" else list(own.primary_key)
        w.want("do")
        if w.take("nothing"):
            set_, condition = None, None
        else:
            w.want("update", "set")
            set_, condition = _assignments(w, parameters), None
            if w.take("where"):
                condition = expression(w.until("returning"), parameters)
        out = changes.on_conflict(target, given, key, set_, condition)
        changes.verify(out, own)
        touched = out.exceptAll(target)
    else:
        out, touched = changes.insert(target, given, own), given
    for fk in foreign_keys(tx).get(name, []):
        if not fk.deferred:
            parent = out if fk.parent == name else _table(tx, fk.parent)
            require(changes.broken_references(out, parent, fk).isEmpty(), "23503", f"{fk.name} is violated")
    n = touched.count()
    tx.put(name, out)
    return _returning(w, touched, parameters), n


def _plain(tokens: Sequence[Token]) -> str:
    return " ".join(t.text for t in tokens)


def _assignments(w: Words, parameters: Sequence) -> dict[str, str]:
    out = {}
    while True:
        c = w.name()
        w.want("=")
        require(c not in out, "42701", f"{c} is set twice")
        out[c] = expression(w.until(",", "where", "returning"), parameters)
        if not w.take(","):
            return out


def _defaults(tx: Transaction) -> dict:
    return {t: tx.meta(t)["defaults"] for t in tx.names("table")}


def _update(tx: Transaction, w: Words, parameters: Sequence):
    name = w.name()
    target = _table(tx, name)
    w.want("set")
    set_ = _assignments(w, parameters)
    for c in set_:
        require(c in target.columns, "42703", f"no column {c}")
    condition = expression(w.until("returning"), parameters) if w.take("where") else None
    before = changes.affected(target, condition)
    n = before.count()
    out = changes.update_rows(tables(tx), foreign_keys(tx), name, set_, condition, _defaults(tx))
    changes.verify(out[name], constraints(tx.meta(name)))
    _put_changed(tx, out)
    return _returning(w, changes.update(before, set_), parameters), n


def _delete(tx: Transaction, w: Words, parameters: Sequence):
    w.want("from")
    name = w.name()
    target = _table(tx, name)
    condition = expression(w.until("returning"), parameters) if w.take("where") else None
    gone = changes.affected(target, condition)
    n = gone.count()
    out = changes.delete_rows(tables(tx), foreign_keys(tx), name, condition or "true", _defaults(tx))
    _put_changed(tx, out)
    return _returning(w, gone, parameters), n


def _put_changed(tx: Transaction, out: dict[str, DataFrame]) -> None:
    for t, df in out.items():
        if df is not tx.read(t):
            tx.put(t, df)


def _type(w: Words) -> tuple[str, dict]:
    """Spark type and what the spelling adds: length, dimension, namespace."""
    kind, more = w.name(), {}
    if kind in ("numeric", "decimal"):
        args = [x.text for x in _arguments(w) if x.text != ","]
        return f"decimal({','.join(args)})" if args else "decimal(38,9)", more
    if kind == "vector":
        return "array<double>", {"vector": int(_arguments(w)[0].text)}
    if kind == "record_ref":
        return "struct<namespace:string,id:string>", {"reference": _arguments(w)[0].text.strip("'")}
    if kind == "double":
        w.take("precision")
    require(kind in TYPES, "42704", f"no type {kind}")
    if kind == "varchar" and (args := _arguments(w)):
        more["length"] = int(args[0].text)
    return TYPES[kind], more


def _arguments(w: Words) -> list[Token]:
    if not w.take("("):
        return []
    out = []
    while not w.take(")"):
        out.append(w.peek())
        w.i += 1
    return out


def _reference(w: Words, name: str, columns: list[str], tx: Transaction) -> dict:
    parent = w.name()
    theirs = w.names() if w.peek().text == "(" else (tx.meta(parent)["constraints"]["primary_key"] if tx.has(parent) else [])
    fk = asdict(ForeignKey(name, tuple(columns), parent, tuple(theirs)))
    while True:
        if w.take("match"):
            fk["match"] = w.name()
        elif w.take("on", "delete") or w.take("on", "update"):
            side = "on_" + w.peek(-1).word
            action = w.name()
            action += " " + w.name() if action in ("no", "set") else ""
            require(action in ACTIONS, "42601", action)
            fk[side] = action
        elif w.take("deferrable"):
            fk["deferrable"] = True
        elif w.take("initially", "deferred"):
            fk["deferred"] = fk["deferrable"] = True
        elif w.take("initially", "immediate") or w.take("not", "deferrable"):
            pass
        else:
            return fk


def _column(w: Words, tx: Transaction, meta: dict, table: str) -> tuple[str, str]:
    c = w.name()
    kind, more = _type(w)
    own = meta["constraints"]
    if "length" in more:
        own["lengths"][c] = more["length"]
    if "vector" in more:
        own["vectors"][c] = more["vector"]
    if "reference" in more:
        own["references"][c] = more["reference"]
    while True:
        if w.take("primary", "key"):
            own["primary_key"] = [c]
        elif w.take("not", "null"):
            own["not_null"].append(c)
        elif w.take("null"):
            pass
        elif w.take("unique"):
            own["unique"][f"{table}_{c}_key"] = [c]
        elif w.take("check"):
            w.want("(")
            own["checks"][f"{table}_{c}_check"] = expression(w.until())
            w.want(")")
        elif w.take("default"):
            meta["defaults"][c] = expression(w.until(",", "not", "null", "unique", "check", "references", "primary"))
        elif w.take("generated"):
            w.until("identity")
            w.want("identity")
            meta["identity"].append(c)
        elif w.take("references"):
            meta["foreign_keys"].append(_reference(w, f"{table}_{c}_fkey", [c], tx))
        else:
            return c, kind


def _constraint(w: Words, tx: Transaction, meta: dict, table: str) -> bool:
    """A table constraint, if one is next."""
    name = w.name() if w.take("constraint") else None
    own = meta["constraints"]
    if w.take("primary", "key"):
        own["primary_key"] = w.names()
    elif w.take("unique"):
        columns = w.names()
        own["unique"][name or f"{table}_{'_'.join(columns)}_key"] = columns
    elif w.take("check"):
        w.want("(")
        own["checks"][name or f"{table}_check{len(own['checks'])}"] = expression(w.until())
        w.want(")")
    elif w.take("foreign", "key"):
        columns = w.names()
        w.want("references")
        meta["foreign_keys"].append(_reference(w, name or f"{table}_{'_'.join(columns)}_fkey", columns, tx))
    else:
        return False
    return True


def empty_meta() -> dict:
    return {"constraints": {"primary_key": [], "unique": {}, "checks": {}, "not_null": [], "lengths": {}, "vectors": {}, "references": {}}, "foreign_keys": [], "defaults": {}, "identity": []}


def _create(tx: Transaction, w: Words, parameters: Sequence):
    unique = w.take("unique")
    if w.take("index"):
        name = w.name() if w.peek().word != "on" else "index"
        w.want("on")
        table, columns = w.name(), w.names()
        meta = tx.meta(table)
        if unique:  # an index is a matter of pruning here; a unique one is a constraint
            meta = {**meta, "constraints": {**meta["constraints"], "unique": {**meta["constraints"]["unique"], name: columns}}}
            changes.verify(tx.read(table), constraints(meta))
        tx.put(table, tx.read(table), meta={**meta, "indexes": {**meta.get("indexes", {}), name: columns}})
        return None, 0
    w.want("table")
    exists_ok = w.take("if", "not", "exists")
    table = w.name()
    if tx.has(table):
        require(exists_ok, "42P07", f"table {table} exists")
        return None, 0
    meta, columns = empty_meta(), []
    w.want("(")
    while True:
        if not _constraint(w, tx, meta, table):
            columns.append(_column(w, tx, meta, table))
        if not w.take(","):
            break
    w.want(")")
    require(w.done, "42601", f"unexpected {w.peek().text}")
    for fk in meta["foreign_keys"]:
        if fk["parent"] == table and not fk["parent_columns"]:
            fk["parent_columns"] = meta["constraints"]["primary_key"]
        require(fk["parent"] == table or tx.has(fk["parent"]), "42P01", f"no table {fk['parent']}")
    df = tx.store.spark.createDataFrame([], ", ".join(f"`{c}` {k}" for c, k in columns))
    tx.put(table, df, "table", meta)
    return None, 0


def _drop(tx: Transaction, w: Words, parameters: Sequence):
    if w.take("index"):
        name = w.name()
        for t in tx.names("table"):
            meta = tx.meta(t)
            if name in meta.get("indexes", {}):
                unique = {k: v for k, v in meta["constraints"]["unique"].items() if k != name}
                tx.put(t, tx.read(t), meta={**meta, "constraints": {**meta["constraints"], "unique": unique}, "indexes": {k: v for k, v in meta["indexes"].items() if k != name}})
                return None, 0
        raise EngineError("42704", f"no index {name}")
    w.want("table")
    missing_ok, table = w.take("if", "exists"), w.name()
    cascade = w.take("cascade")
    if not tx.has(table):
        require(missing_ok, "42P01", f"no table {table}")
        return None, 0
    for t, fks in foreign_keys(tx).items():
        if t != table and any(fk.parent == table for fk in fks):
            require(cascade, "2BP01", f"{t} refers to {table}")
            meta = tx.meta(t)
            tx.put(t, tx.read(t), meta={**meta, "foreign_keys": [k for k in meta["foreign_keys"] if k["parent"] != table]})
    tx.drop(table)
    return None, 0


def _alter(tx: Transaction, w: Words, parameters: Sequence):
    w.want("table")
    table = w.name()
    df, meta = _table(tx, table), tx.meta(table)
    import copy

    meta = copy.deepcopy(meta)
    own = meta["constraints"]
    if w.take("rename", "to"):
        new = w.name()
        require(not tx.has(new), "42P07", f"table {new} exists")
        tx.drop(table)
        tx.put(new, df, "table", meta)
        for t in tx.names("table"):
            m = tx.meta(t)
            if any(k["parent"] == table for k in m["foreign_keys"]):
                tx.put(t, tx.read(t), meta={**m, "foreign_keys": [{**k, "parent": new if k["parent"] == table else k["parent"]} for k in m["foreign_keys"]]})
        return None, 0
    if w.take("rename", "constraint"):
        old = w.name()
        w.want("to")
        new = w.name()
        for part in (own["unique"], own["checks"]):
            if old in part:
                part[new] = part.pop(old)
        for fk in meta["foreign_keys"]:
            fk["name"] = new if fk["name"] == old else fk["name"]
    elif w.take("rename"):
        w.take("column")
        old = w.name()
        w.want("to")
        new = w.name()
        df = changes.rename_column(df, old, new)
        swap = lambda xs: [new if x == old else x for x in xs]
        own["primary_key"], own["not_null"], own["unique"] = swap(own["primary_key"]), swap(own["not_null"]), {k: swap(v) for k, v in own["unique"].items()}
        own["checks"] = {k: re.sub(rf"\b{re.escape(old)}\b", new, v) for k, v in own["checks"].items()}
        for part in (own["lengths"], own["vectors"], own["references"], meta["defaults"]):
            if old in part:
                part[new] = part.pop(old)
        for fk in meta["foreign_keys"]:
            fk["columns"] = swap(fk["columns"])
    elif w.take("add"):
        if not _constraint(w, tx, meta, table):
            w.take("column")
            c, kind = _column(w, tx, meta, table)
            df = changes.add_column(df, c, kind, meta["defaults"].get(c))
        changes.verify(df, constraints(meta))
        for k in meta["foreign_keys"]:
            fk = ForeignKey(**{**k, "columns": tuple(k["columns"]), "parent_columns": tuple(k["parent_columns"])})
            require(changes.broken_references(df, df if fk.parent == table else tx.read(fk.parent), fk).isEmpty(), "23503", f"{fk.name} is violated")
    elif w.take("drop", "constraint"):
        name = w.name()
        found = own["unique"].pop(name, None) or own["checks"].pop(name, None) or [k for k in meta["foreign_keys"] if k["name"] == name]
        require(bool(found), "42704", f"no constraint {name}")
        meta["foreign_keys"] = [k for k in meta["foreign_keys"] if k["name"] != name]
    elif w.take("drop"):
        w.take("column")
        c = w.name()
        cascade = w.take("cascade")
        df = changes.drop_column(df, c, constraints(meta), cascade)
        own["primary_key"] = [] if c in own["primary_key"] else own["primary_key"]
        own["not_null"] = [x for x in own["not_null"] if x != c]
        own["unique"] = {k: v for k, v in own["unique"].items() if c not in v}
        own["checks"] = {k: v for k, v in own["checks"].items() if not re.search(rf"\b{re.escape(c)}\b", v)}
        meta["foreign_keys"] = [k for k in meta["foreign_keys"] if c not in k["columns"]]
        for part in (own["lengths"], own["vectors"], own["references"], meta["defaults"]):
            part.pop(c, None)
    else:
        w.want("alter")
        w.take("column")
        c = w.name()
        require(c in df.columns, "42703", f"no column {c}")
        if w.take("set", "not", "null"):
            own["not_null"] = [*dict.fromkeys([*own["not_null"], c])]
            changes.verify(df, constraints(meta))
        elif w.take("drop", "not", "null"):
            own["not_null"] = [x for x in own["not_null"] if x != c]
        elif w.take("set", "default"):
            meta["defaults"][c] = expression(w.until(), parameters)
        elif w.take("drop", "default"):
            meta["defaults"].pop(c, None)
        else:
            w.take("set", "data")
            w.want("type")
            kind, more = _type(w)
            df = changes.alter_type(df, c, kind)
            own["lengths"].pop(c, None)
            if "length" in more:
                own["lengths"][c] = more["length"]
            changes.verify(df, constraints(meta))
    tx.put(table, df, "table", meta)
    return None, 0


def _set(tx: Transaction, w: Words, parameters: Sequence):
    """SET CONSTRAINTS ALL | names DEFERRED | IMMEDIATE; turning immediate checks at once."""
    w.want("constraints")
    names = None if w.take("all") else [w.name()]
    while names is not None and w.take(","):
        names.append(w.name())
    deferred = w.name() == "deferred"
    for t in tx.names("table"):
        meta = tx.meta(t)
        new = [{**k, "deferred": deferred} if k["deferrable"] and (names is None or k["name"] in names) else k for k in meta["foreign_keys"]]
        if new != meta["foreign_keys"]:
            tx.put(t, tx.read(t), meta={**meta, "foreign_keys": new})
    if not deferred:
        check_deferred(tx)
    return None, 0


def check_deferred(tx: Transaction) -> None:
    """What a commit requires: every foreign key holds, deferred ones too."""
    for t, fks in foreign_keys(tx).items():
        for fk in fks:
            if fk.deferred or t in tx.staged or fk.parent in tx.staged:
                require(changes.broken_references(tx.read(t), tx.read(fk.parent), fk).isEmpty(), "23503", f"{fk.name} is violated")
