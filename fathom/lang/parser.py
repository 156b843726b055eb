"""The verb-first statement language: tokens, clauses, and one ``Statement`` for each verb."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from fathom.constants import MAX_K, TRAVERSE_DEPTH
from fathom.errors import EngineError

_TOKEN = re.compile(r"""(?P<space>\s+|--[^\n]*)|(?P<string>'(?:[^']|'')*')|(?P<number>-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<param>\$\d+)|(?P<word>[^\W\d][\w]*)|(?P<mark>->|<=|>=|!=|<>|\[\]|[\[\]{}(),;:.@=<>*+/-])""")


class QueryError(EngineError):
    """Refused statement: a stable code, a message and the byte position of a caret."""

    def __init__(self, code: str, message: str, position: int = 0) -> None:
        super().__init__(f"query.{code}", message)
        self.position = position


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    at: int

    @property
    def upper(self) -> str:
        return self.text.upper() if self.kind == "word" else ""


@dataclass
class Statement:
    verb: str
    args: dict = field(default_factory=dict)

    def __getattr__(self, name):
        try:
            return self.args[name]
        except KeyError:
            raise AttributeError(name) from None


#: Leading words with an answer of their own.
REFUSED = {
    "SELECT": "not_sql", "INSERT": "not_sql", "WITH": "no_cte", "BEGIN": "no_transactions", "COMMIT": "no_transactions",
    "ROLLBACK": "no_transactions", "SAVEPOINT": "no_transactions", "START": "no_transactions", "ALTER": "no_ddl", "TRUNCATE": "no_ddl",
}
WRITES = {"upsert", "delete", "update_point", "update_edge", "relate", "unrelate", "append", "transaction", "create", "drop", "ml"}
OPTIONS = {
    "shards", "replicas", "quantization", "payload_schema", "named_vectors", "vectors", "hnsw_m", "hnsw_ef_construct", "recall_sla",
    "streamer_max_bytes",
}


def lex(text: str) -> list[Token]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise QueryError("syntax", f"unexpected {text[at]!r}", len(text[:at].encode()))
        if m.lastgroup != "space":
            out.append(Token(m.lastgroup, m[0], at))
        at = m.end()
    return out


class Parser:
    def __init__(self, text: str, parameters: tuple = ()) -> None:
        self.text, self.parameters = text, parameters
        self.tokens = lex(text)
        while self.tokens and self.tokens[-1].text == ";":
            self.tokens.pop()
        self.i = 0

    # tokens

    def fail(self, code: str, message: str, at: Token | None = None) -> QueryError:
        token = at or (self.tokens[self.i] if self.i < len(self.tokens) else None)
        position = len(self.text[: token.at].encode()) if token else len(self.text.encode())
        return QueryError(code, message, position)

    def peek(self, ahead: int = 0) -> Token:
        return self.tokens[self.i + ahead] if self.i + ahead < len(self.tokens) else Token("end", "", len(self.text))

    def next(self) -> Token:
        t = self.peek()
        self.i += 1
        return t

    def take(self, *words: str) -> bool:
        """Whether the next words are these; if so they are consumed."""
        if all(self.peek(k).upper == w for k, w in enumerate(words)):
            self.i += len(words)
            return True
        return False

    def mark(self, text: str) -> bool:
        if self.peek().text == text and self.peek().kind == "mark":
            self.i += 1
            return True
        return False

    def want(self, *words: str) -> None:
        if not self.take(*words):
            raise self.fail("syntax", f"expected {' '.join(words)}")

    def want_mark(self, text: str) -> None:
        if not self.mark(text):
            raise self.fail("syntax", f"expected {text}")

    def name(self) -> str:
        t = self.next()
        if t.kind == "word":
            return t.text
        if t.kind == "string":
            return t.text[1:-1].replace("''", "'")
        raise self.fail("syntax", "expected a name", t)

    def here(self) -> str | None:
        """A collection's name, or None before a clause or the end: the one in use."""
        t = self.peek()
        return None if t.kind == "end" or (t.kind == "word" and t.text.upper() in ("WHERE", "LIMIT", "AFTER")) else self.name()

    def identifier(self) -> str:
        """An id: a word, text, or number, as text."""
        t = self.peek()
        if t.kind == "param":
            return str(self.value())
        if t.kind == "number":
            self.i += 1
            return t.text
        return self.name()

    def integer(self, code: str = "invalid_count", low: int = 0, high: int = MAX_K) -> int:
        t, v = self.peek(), self.value()
        if not isinstance(v, int) or isinstance(v, bool) or not low <= v <= high:
            raise self.fail(code, f"expected a whole number from {low} to {high}", t)
        return v

    def number(self, code: str = "invalid_number") -> float:
        t, v = self.peek(), self.value()
        if isinstance(v, bool) or not isinstance(v, (int, float)):
            raise self.fail(code, "expected a number", t)
        return float(v)

    def value(self):
        t = self.next()
        if t.kind == "string":
            return t.text[1:-1].replace("''", "'")
        if t.kind == "number":
            v = float(t.text)
            return int(t.text) if re.fullmatch(r"-?\d+", t.text) else int(v) if v.is_integer() else v
        if t.kind == "param":
            n = int(t.text[1:])
            if not 1 <= n <= len(self.parameters):
                raise self.fail("missing_parameter", f"no value for {t.text}", t)
            return self.parameters[n - 1]
        if t.upper in ("TRUE", "FALSE", "NULL"):
            return {"TRUE": True, "FALSE": False, "NULL": None}[t.upper]
        if t.text == "[" or t.text == "[]":
            out: list = []
            if t.text == "[" and not self.mark("]"):
                out.append(self.value())
                while self.mark(","):
                    out.append(self.value())
                self.want_mark("]")
            return out
        if t.text == "{":
            return self.object()
        raise self.fail("syntax", "expected a value", t)

    def object(self) -> dict:
        """The rest of an object after its brace."""
        out: dict = {}
        if self.mark("}"):
            return out
        while True:
            t = self.next()
            if t.kind not in ("word", "string", "number"):
                raise self.fail("syntax", "expected a key", t)
            key = t.text[1:-1].replace("''", "'") if t.kind == "string" else t.text
            if key in out:
                raise self.fail("duplicate_key", f"key {key} twice", t)
            self.want_mark(":")
            out[key] = self.value()
            if not self.mark(","):
                self.want_mark("}")
                return out

    def many(self, one):
        out = [one()]
        while self.mark(","):
            out.append(one())
        return out

    # shared clauses

    def vector(self):
        """A literal as a list, or @id as text."""
        if self.mark("@"):
            return self.identifier()
        t, v = self.peek(), self.value()
        if not isinstance(v, list) or not v or any(isinstance(x, bool) or not isinstance(x, (int, float)) for x in v):
            raise self.fail("invalid_vector", "expected a vector of numbers", t)
        return [float(x) for x in v]

    def field_name(self) -> str:
        out = self.name()
        while True:
            if self.mark("[]"):
                out += "[]"
            elif self.peek().text == ".":
                self.i += 1
                out += "." + self.name()
            else:
                return out

    def filter(self) -> dict:
        out: dict = {}
        while True:
            if self.peek().upper == "NOT":
                raise self.fail("syntax", "NOT is not supported in a filter")
            name, t = self.field_name(), self.next()
            op = {"=": "eq", "!=": "ne", "<>": "ne", "<": "lt", "<=": "lte", ">": "gt", ">=": "gte"}.get(t.text)
            if t.upper == "LIKE":
                raise self.fail("no_like", "use CONTAINS in place of LIKE", t)
            if t.upper == "IN":
                self.want_mark("(")
                op, v = "in", self.many(self.value)
                self.want_mark(")")
            elif t.upper == "CONTAINS":
                op, v = "text", self.value()
            elif op:
                v = self.value()
            else:
                raise self.fail("syntax", "expected a comparison", t)
            ops = out.setdefault(name, {})
            if op in ops:
                raise self.fail("duplicate_condition", f"{t.text} twice on {name}", t)
            ops[op] = v
            if self.peek().upper == "OR":
                raise self.fail("no_or_across_fields", "conditions join by AND; use IN for values of one field")
            if not self.take("AND"):
                return out

    def clauses(self, allowed: dict) -> dict:
        """Optional clauses in any order, each at most once. ``allowed``: words to (name, parser)."""
        out: dict = {}
        while self.peek().kind != "end" and self.peek().text not in ("}", ";"):
            for words, (name, parse) in allowed.items():
                t = self.peek()
                if self.take(*words.split()):
                    if name in out:
                        raise self.fail("duplicate_clause", f"{words} twice", t)
                    out[name] = parse()
                    break
            else:
                raise self.fail("syntax", f"unexpected {self.peek().text}")
        return out

    def connected(self) -> dict:
        ids = self.many(self.identifier)
        out: dict = {"anchors": ids, "hops": 1, "direction": "out", "types": None}
        while True:
            if self.take("VIA"):
                out["types"] = self.many(self.name)
            elif self.take("DIRECTION"):
                out["direction"] = self.direction()
            elif self.take("WITHIN"):
                out["hops"] = self.integer(high=16)
                self.take("HOPS") or self.take("HOP")
            elif self.take("ALLOW", "DEGRADED"):
                out["degraded"] = True
            else:
                return out

    def direction(self) -> str:
        t = self.next()
        if t.upper not in ("OUT", "IN", "ANY"):
            raise self.fail("syntax", "expected OUT, IN or ANY", t)
        return t.text.lower()

    def fusion(self) -> str:
        t = self.next()
        if t.text.lower() not in ("rrf", "weighted"):
            raise self.fail("syntax", "expected rrf or weighted", t)
        return t.text.lower()

    def recall(self) -> float:
        t, v = self.peek(), self.number("invalid_recall")
        if not 0 < v <= 1:
            raise self.fail("invalid_recall", "recall is over 0 and at most 1", t)
        return v

    def budget(self) -> int:
        v = self.integer(high=1 << 31)
        self.take("MS")
        return v

    def yes(self) -> bool:
        return True

    def search_clauses(self) -> dict:
        return {
            "USING": ("using", self.name), "WHERE": ("filter", self.filter), "LIMIT": ("limit", self.integer), "WITH PAYLOAD": ("payload", self.yes),
            "EF": ("ef", lambda: self.integer(high=1 << 31)), "RECALL": ("recall", self.recall), "BUDGET": ("budget", self.budget),
            "CONNECTED TO": ("connected", self.connected),
        }

    # statements

    def parse(self) -> Statement:
        if not self.tokens:
            raise self.fail("empty", "an empty statement")
        s = self.statement()
        if self.peek().text == ";":
            raise self.fail("multiple_statements", "one statement at a time")
        if self.peek().kind != "end":
            raise self.fail("syntax", f"unexpected {self.peek().text}")
        return s

    def statement(self) -> Statement:
        t = self.next()
        word = t.upper
        if word == "EXPLAIN":
            if self.take("PIPELINE"):
                return Statement("explain", {"pipeline": self.pipeline()})
            raise self.fail("no_explain", "only a pipeline can be explained", t)
        if word == "CREATE" and self.peek().upper != "COLLECTION" or word == "DROP" and self.peek().upper != "COLLECTION":
            raise self.fail("no_ddl", "only collections are made here; use SQL for tables", t)
        if word in REFUSED:
            raise self.fail(REFUSED[word], f"{t.text} is not a statement here", t)
        if word == "UPDATE" and self.peek(1).upper == "SET":
            raise self.fail("not_sql", "use SQL UPDATE for tables", t)
        method = getattr(self, f"do_{word.lower()}", None) if word else None
        if method is None:
            raise self.fail("unknown_statement", f"unknown statement {t.text}", t)
        return method()

    def do_search(self) -> Statement:
        c = self.name()
        if self.peek().upper in ("COUNT", "SUM", "AVG", "MIN", "MAX"):
            raise self.fail("no_aggregates", "use SQL for aggregates")
        if not self.take("NEAR"):
            raise self.fail("missing_near", "SEARCH needs NEAR")
        return Statement("search", {"collection": c, "vector": self.vector(), **self.clauses(self.search_clauses())})

    def do_hybrid(self) -> Statement:
        c = self.name()
        vector = self.vector() if self.take("NEAR") else None
        self.want("TEXT")
        t, given = self.peek(), self.value()
        out: dict = {"collection": c, "vector": vector}
        if isinstance(given, str):
            self.want("FIELD")
            out |= {"text": given, "field": self.field_name()}
        elif isinstance(given, dict):
            try:
                out["sparse"] = {int(k): float(v) for k, v in given.items()}
            except (TypeError, ValueError):
                raise self.fail("invalid_number", "a sparse query is {dimension: weight}", t) from None
        else:
            raise self.fail("syntax", "expected text or {dimension: weight}", t)
        more = {"FUSION": ("fusion", self.fusion), "DENSE": ("dense", self.number), "SPARSE": ("sparse_weight", self.number)}
        return Statement("hybrid", out | self.clauses({**self.search_clauses(), **more}))

    def do_multi(self) -> Statement:
        c = self.name()
        vectors = []
        while True:
            if not self.take("NEAR"):
                raise self.fail("missing_near", "MULTI needs NEAR before each vector")
            vectors.append(self.vector())
            if not self.mark(","):
                break
        t = self.peek()
        out = self.clauses({"FUSION": ("fusion", self.fusion), "WEIGHTS": ("weights", lambda: self.many(self.number)), "WHERE": ("filter", self.filter), "LIMIT": ("limit", self.integer)})
        if "weights" in out and len(out["weights"]) != len(vectors):
            raise self.fail("weight_arity", "one weight for each NEAR", t)
        return Statement("multi", {"collection": c, "vectors": vectors, **out})

    def do_recommend(self) -> Statement:
        c = self.name()
        if not self.take("LIKE"):
            raise self.fail("missing_like", "RECOMMEND needs LIKE")
        like = self.many(self.identifier)
        unlike = self.many(self.identifier) if self.take("UNLIKE") else []
        return Statement("recommend", {"collection": c, "like": like, "unlike": unlike, **self.clauses({"USING": ("using", self.name), "WHERE": ("filter", self.filter), "LIMIT": ("limit", self.integer)})})

    def do_count(self) -> Statement:
        return Statement("count", {"collection": self.here(), **self.clauses({"WHERE": ("filter", self.filter)})})

    def do_scroll(self) -> Statement:
        return Statement("scroll", {"collection": self.here(), **self.clauses({"WHERE": ("filter", self.filter), "LIMIT": ("limit", self.integer), "AFTER": ("after", self.identifier)})})

    def do_get(self) -> Statement:
        c = self.name()
        self.want("POINTS")
        return Statement("get", {"collection": c, "ids": self.many(self.identifier)})

    def do_show(self) -> Statement:
        self.want("COLLECTIONS")
        return Statement("show")

    def do_describe(self) -> Statement:
        return Statement("describe", {"collection": self.here()})

    def do_use(self) -> Statement:
        return Statement("use", {"collection": self.name()})

    def point(self) -> dict:
        t, p = self.peek(), self.value()
        if not isinstance(p, dict) or "id" not in p:
            raise self.fail("missing_point_id", "a point is an object with an id", t)
        return p | {"id": str(p["id"])}

    def do_upsert(self) -> Statement:
        self.want("INTO")
        return Statement("upsert", {"collection": self.name(), "points": self.many(self.point), **self.clauses({"NO WAIT": ("no_wait", self.yes)})})

    def do_delete(self) -> Statement:
        self.want("FROM")
        c = self.name()
        if self.take("POINTS"):
            return Statement("delete", {"collection": c, "ids": self.many(self.identifier)})
        if self.take("WHERE"):
            return Statement("delete", {"collection": c, "filter": self.filter()})
        raise self.fail("unbounded_delete", "DELETE needs POINTS or WHERE")

    def do_update(self) -> Statement:
        c = self.name()
        edge = self.take("EDGE")
        if not edge:
            self.want("POINT")
        which = self.identifier()
        self.want("SET", "PROPERTIES" if edge else "PAYLOAD")
        t, new = self.peek(), self.value()
        if not isinstance(new, dict):
            raise self.fail("syntax", "expected an object", t)
        return Statement("update_edge" if edge else "update_point", {"collection": c, "id": which, "new": new, **self.clauses({"REPLACE": ("replace", self.yes), "NO WAIT": ("no_wait", self.yes)})})

    def do_relate(self) -> Statement:
        c, src = self.name(), self.identifier()
        self.want_mark("->")
        kind = self.name()
        self.want_mark("->")
        out = {"collection": c, "src": src, "type": kind, "dst": self.identifier()}
        return Statement("relate", out | self.clauses({"SET": ("properties", self.value), "IDEMPOTENCY KEY": ("key", self.identifier), "WITH DEFERRED ENDPOINTS": ("deferred", self.yes), "NO WAIT": ("no_wait", self.yes)}))

    do_connect = do_relate

    def do_unrelate(self) -> Statement:
        c = self.name()
        self.want("EDGE")
        return Statement("unrelate", {"collection": c, "ids": self.many(self.identifier), **self.clauses({"NO WAIT": ("no_wait", self.yes)})})

    def do_traverse(self) -> Statement:
        c = self.name()
        self.want("FROM")
        start: dict = {}
        if self.peek(1).text == "." and self.peek().kind == "word":
            start["source"] = self.field_name()
        else:
            start["anchors"] = self.many(self.identifier)

        def returning() -> str:
            t = self.next()
            if t.upper not in ("NODES", "EDGES", "PATHS"):
                raise self.fail("syntax", "expected NODES, EDGES or PATHS", t)
            return t.text.lower()

        out = self.clauses({
            "VIA": ("types", lambda: self.many(self.name)), "DIRECTION": ("direction", self.direction), "DEPTH": ("depth", lambda: self.integer(high=16)),
            "EDGE WHERE": ("edge_filter", self.filter), "WHERE": ("filter", self.filter), "BUDGET": ("budget", self.budget), "LIMIT": ("limit", self.integer),
            "WITH PAYLOAD": ("payload", self.yes), "RETURN": ("returning", returning),
        })
        return Statement("traverse", {"collection": c, "depth": TRAVERSE_DEPTH, "direction": "out", "returning": "nodes", **start, **out})

    def do_create(self) -> Statement:
        self.want("COLLECTION")
        c = self.name()
        out: dict = {}
        while self.peek().kind != "end":
            if self.take("DIM"):
                out["dim"] = self.integer("invalid_count", 1, 65_536)
            elif self.take("METRIC"):
                t = self.next()
                if t.text.lower() not in ("cosine", "l2", "dot"):
                    raise self.fail("unknown_metric", f"unknown metric {t.text}", t)
                out["metric"] = t.text.lower()
            elif self.take("WITH"):
                t, options = self.peek(), self.value()
                if not isinstance(options, dict):
                    raise self.fail("invalid_collection_options", "WITH takes an object", t)
                if "index_kind" in options:
                    raise self.fail("no_index_family", "there is no index family to choose", t)
                if unknown := set(options) - OPTIONS:
                    raise self.fail("unknown_collection_option", f"unknown: {sorted(unknown)}", t)
                out["options"] = options
            else:
                raise self.fail("syntax", f"unexpected {self.peek().text}")
        if "dim" not in out:
            raise self.fail("missing_dim", "CREATE COLLECTION needs DIM")
        return Statement("create", {"collection": c, "metric": "cosine", "options": {}, **out})

    def do_drop(self) -> Statement:
        self.want("COLLECTION")
        return Statement("drop", {"collection": self.name(), **self.clauses({"IF EXISTS": ("if_exists", self.yes)})})

    def do_sql(self) -> Statement:
        start = self.tokens[self.i - 1].at + 3
        self.i = len(self.tokens)
        return Statement("sql", {"text": self.text[start:].rstrip().rstrip(";").strip()})

    def ns(self) -> int:
        t = self.next()
        if t.kind == "param":
            self.i -= 1
            return int(self.value())
        if t.kind != "string" or not re.fullmatch(r"'-?\d+'", t.text):
            raise self.fail("invalid_time", "times are quoted whole nanoseconds", t)
        return int(t.text[1:-1])

    def do_append(self) -> Statement:
        self.want("INTO")
        c, t, rows = self.name(), self.peek(), self.value()
        if not isinstance(rows, list) or not all(isinstance(r, dict) and set(r) == {"asset", "property", "time_ns", "value"} for r in rows):
            raise self.fail("invalid_sample", "samples are {asset, property, time_ns, value}", t)
        for r in rows:
            if not isinstance(r["time_ns"], str) or not re.fullmatch(r"-?\d+", r["time_ns"]):
                raise self.fail("invalid_time", "times are quoted whole nanoseconds", t)
        return Statement("append", {"collection": c, "samples": rows})

    def asset(self) -> dict:
        self.want("ASSET")
        if self.peek().kind == "word" and self.peek(1).text == ".":
            return {"source": self.field_name()}
        return {"asset": self.identifier()}

    def do_history(self) -> Statement:
        out = {"collection": self.name(), **self.asset()}
        self.want("PROPERTY")
        out["property"] = self.name()
        self.want("FROM")
        out["start"] = self.ns()
        self.want("TO")
        out["end"] = self.ns()
        self.want("LIMIT")
        out["limit"] = self.integer(low=1, high=4096)
        return Statement("history", out | self.clauses({"WHERE": ("filter", self.filter)}))

    def do_latest(self) -> Statement:
        out = {"collection": self.name(), **self.asset()}
        self.want("PROPERTY")
        out["property"] = self.name()
        return Statement("latest", out | self.clauses({"WHERE": ("filter", self.filter)}))

    def do_ml(self) -> Statement:
        self.want("MATERIALIZE")
        out: dict = {"view": self.name()}
        self.want("FROM")
        out["table"] = self.name()
        self.want("TARGET")
        out["target"] = self.name()
        self.want("FEATURES")
        self.want_mark("(")
        out["features"] = self.many(self.name)
        self.want_mark(")")
        self.want("TASK")
        out["task"] = self.name().lower()
        self.want("USING")
        out["using"] = self.name().lower()
        return Statement("ml", out)

    # blocks

    def block(self) -> str:
        """The text between braces."""
        self.want_mark("{")
        start, depth = self.peek().at, 1
        while depth:
            t = self.next()
            if t.kind == "end":
                raise self.fail("syntax", "a brace is not closed")
            depth += (t.text == "{") - (t.text == "}")
        return self.text[start : self.tokens[self.i - 1].at]

    def do_pipeline(self) -> Statement:
        return self.pipeline()

    def pipeline(self) -> Statement:
        stages: list[tuple[str, str, Statement]] = []
        kinds = {"VECTOR": ("search", "hybrid", "recommend", "multi"), "GRAPH": ("traverse",), "RELATIONAL": ("sql",), "TEMPORAL": ("history", "latest")}
        while self.peek().upper in kinds:
            kind = self.next().upper
            alias, at = self.name(), self.peek()
            body = self.block()
            if kind == "RELATIONAL" and not body.lstrip().upper().startswith("SQL"):
                body = "SQL " + body
            s = Parser(body, self.parameters).parse()
            if s.verb not in kinds[kind]:
                raise self.fail("pipeline_stage", f"a {kind} stage can't {s.verb}", at)
            if alias in [a for _, a, _ in stages]:
                raise self.fail("duplicate_alias", f"{alias} twice", at)
            if kind == "VECTOR" and "limit" not in s.args:
                raise self.fail("unbounded_vector", "a vector stage needs LIMIT", at)
            stages.append((kind.lower(), alias, s))
        joins = []
        while self.peek().upper in ("INNER", "LEFT"):
            kind = self.next().text.lower()
            self.want("JOIN")
            alias = self.name()
            self.want("ON")
            left = self.field_name()
            self.want_mark("=")
            joins.append((kind, alias, left, self.field_name()))
        if not ({"vector", "temporal"} & {k for k, _, _ in stages}) or not joins:
            raise self.fail("pipeline_incomplete", "a pipeline needs a vector or temporal stage and a join")
        self.want("RETURN")
        returning, order = self.many(self.field_name), None
        if self.take("ORDER", "BY"):
            by = self.field_name()
            order = (by, "desc" if self.take("DESC") else "asc" if self.take("ASC") or True else "")
        if not self.take("LIMIT"):
            raise self.fail("limit_required", "a pipeline needs LIMIT")
        return Statement("pipeline", {"stages": stages, "joins": joins, "returning": returning, "order": order, "limit": self.integer(low=1)})

    def do_transaction(self) -> Statement:
        parts = [p.strip() for p in re.split(r""";(?=(?:[^']|'[^']*')*$)""", self.block()) if p.strip()]
        sql = expect = vector = None
        graph = []
        for p in parts:
            head, rest = p.split(None, 1)
            if head.upper() == "SQL" and sql is None:
                sql = rest
            elif head.upper() == "EXPECT" and sql is not None and expect is None and re.fullmatch(r"(?i)SQL\s+ROWS\s+\d+", rest):
                expect = int(rest.split()[-1])
            elif head.upper() == "VECTOR" and vector is None:
                vector = Parser(rest, self.parameters).parse()
            elif head.upper() == "GRAPH":
                graph.append(Parser(rest, self.parameters).parse())
            else:
                raise self.fail("transaction_profile", f"unexpected {head} in a transaction")
        ok = sql and vector and graph and vector.verb in ("upsert", "delete") and all(g.verb in ("relate", "unrelate", "update_edge") for g in graph)
        if not ok or sql.split()[0].upper() not in ("INSERT", "UPDATE", "DELETE"):
            raise self.fail("transaction_profile", "a transaction is one SQL change, one VECTOR change and graph changes")
        if {g.collection for g in graph} != {vector.collection}:
            raise self.fail("transaction_profile", "vector and graph stages name one collection")
        if any(g.args.get("no_wait") or g.args.get("deferred") or g.args.get("key") for g in graph) or vector.args.get("no_wait") or "filter" in vector.args:
            raise self.fail("transaction_profile", "no NO WAIT, deferred endpoints, keys or filters in a transaction")
        return Statement("transaction", {"sql": sql, "expect": expect, "vector": vector, "graph": graph})


def parse(text: str, parameters: tuple = ()) -> Statement:
    if re.match(r"(?is)\s*SQL\b", text):  # SQL has marks of its own
        return Statement("sql", {"text": re.sub(r"(?is)^\s*SQL\b", "", text).strip().rstrip(";").strip()})
    return Parser(text, parameters).parse()



