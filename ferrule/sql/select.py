"""Queries of the dialect as Spark SQL text.

Expressions are parsed once into functions of a scope, which knows the columns' types; with it they give (text, type).
Everything else is Catalyst's work: joins, subqueries, grouping and windows keep their shape in the text.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from ferrule.functions.operators import glob_regex
from ferrule.sql import functions as fn
from ferrule.sql.functions import Value
from ferrule.sql.lexer import Token, lex

Expr = Callable[["Scope"], Value]
AGGREGATES = {"count", "sum", "avg", "total", "min", "max", "group_concat", "string_agg", "median", "percentile", "percentile_cont", "percentile_disc", "decimal_sum", "json_group_array", "json_group_object", "jsonb_group_array", "jsonb_group_object"}
WINDOW = {"row_number", "rank", "dense_rank", "percent_rank", "cume_dist", "ntile", "lag", "lead", "first_value", "last_value", "nth_value"}
ENDS = {"FROM", "WHERE", "GROUP", "HAVING", "ORDER", "LIMIT", "UNION", "INTERSECT", "EXCEPT", "WINDOW", "ON", "USING", "JOIN", "INNER", "LEFT", "RIGHT", "FULL", "CROSS", "NATURAL", "SET", "RETURNING", "AS", "INDEXED", "NOT", "WHEN", "THEN", "ELSE", "END", "ASC", "DESC", "COLLATE", "AND", "OR", "OVER", "FILTER", "OFFSET", "ESCAPE", "IS", "IN", "LIKE", "GLOB", "BETWEEN", "NULLS"}


def name(x: str) -> str:
    return "`" + x.replace("`", "``") + "`"


@dataclass
class Scope:
    """Columns in reach: their types by lower-case name, with and without the table's name."""

    types: dict[str, str] = field(default_factory=dict)
    outer: Scope | None = None
    aliases: dict[str, Expr] = field(default_factory=dict)
    grouped: bool = False  # columns outside aggregates stand for a row of the group
    keys: set[str] = field(default_factory=set)
    picked: str | None = None  # how to pick that row
    names: dict[str, str] = field(default_factory=dict)  # columns that have another name in Spark
    inside: int = 0
    numbered: list[str] = field(default_factory=list)  # windows whose rows and peer groups are numbered in the source

    def name_of(self, column: str) -> str | None:
        if column.lower() in self.types or not self.outer:
            return self.names.get(column.lower())
        return self.outer.name_of(column)

    def type_of(self, column: str) -> str | None:
        return self.types.get(column.lower()) or (self.outer.type_of(column) if self.outer else None)


def kind(spark_type: str) -> str:
    t = spark_type.lower()
    if t in ("bigint", "int", "smallint", "tinyint"):
        return "int"
    return "real" if t in ("double", "float") or t.startswith("decimal") else {"string": "text", "boolean": "bool", "binary": "blob"}.get(t, "time" if t.startswith(("timestamp", "date")) else "any")


@dataclass
class Window:
    """A window's parts. GROUPS frames and EXCLUDE count on numbers of rows and peer groups, which the query's source
    gets as columns."""

    base: str | None = None
    partition: list[Expr] = field(default_factory=list)
    order: list[Callable[[Scope], str]] = field(default_factory=list)
    unit: str | None = None
    low: str = "UNBOUNDED PRECEDING"
    high: str = "CURRENT ROW"
    exclude: str | None = None
    keys: list[str] = field(default_factory=list)  # PARTITION BY and ORDER BY as text
    terms: list[str] = field(default_factory=list)

    def resolved(self, parser: Parser, s: Scope) -> Window:
        """With the base window's parts, and keys and terms as text."""
        own = parser.windows[self.base].resolved(parser, s) if self.base else Window()
        if (self.order and own.terms) or (self.base and own.unit):
            raise ValueError("cannot override ORDER BY or frame specification of window")
        keys = own.keys + [k[0] for k in parser._inner(s, self.partition)]
        return replace(self, base=None, keys=keys, terms=own.terms + [o(s) for o in self.order])

    def text(self, s: Scope, turned: bool = False, numbered: bool = False) -> str:
        """As text. turned: a frame up to UNBOUNDED FOLLOWING over the reversed order, for functions that don't depend on
        it. numbered: the order by row numbers."""
        terms, unit, low, high = self.terms, self.unit, self.low, self.high
        if unit == "GROUPS" or (numbered and unit == "ROWS"):
            d, n = self.numbers(s)
            terms, unit = ([f"{d} ASC NULLS FIRST"], "RANGE") if unit == "GROUPS" else ([f"{n} ASC NULLS FIRST"], "ROWS")
        if turned and unit and terms and high == "UNBOUNDED FOLLOWING" and low != "UNBOUNDED PRECEDING":
            terms = [_opposite(t) for t in terms]
            swap = {"PRECEDING": "FOLLOWING", "FOLLOWING": "PRECEDING"}
            low, high = "UNBOUNDED PRECEDING", re.sub(r"\b(PRECEDING|FOLLOWING)$", lambda m: swap[m[0]], low)
        parts = [f"PARTITION BY {', '.join(self.keys)}"] * bool(self.keys) + [f"ORDER BY {', '.join(terms)}"] * bool(terms)
        return " ".join([*parts, f"{unit} BETWEEN {low} AND {high}"] if unit else parts)

    def numbers(self, s: Scope) -> tuple[str, str]:
        """The columns with the peer group's and the row's number."""
        spec = " ".join([f"PARTITION BY {', '.join(self.keys)}"] * bool(self.keys) + [f"ORDER BY {', '.join(self.terms or ['1'])}"])
        if spec not in s.numbered:
            s.numbered.append(spec)
        k = s.numbered.index(spec)
        return f"`_d{k}`", f"`_n{k}`"


def _opposite(term: str) -> str:
    x, way, _, nulls = term.rsplit(" ", 3)
    return f"{x} {'ASC' if way == 'DESC' else 'DESC'} NULLS {'LAST' if nulls == 'FIRST' else 'FIRST'}"


class Parser:
    """lookup: the Spark types of a table by name, as [(column, type)]."""

    def __init__(self, sql: str, lookup: Callable[[str], list[tuple[str, str]]], pragma: Callable[[str, str | None], str] | None = None, case_sensitive_like: bool = False) -> None:
        self.sql, self.tokens, self.i = sql, lex(sql), 0
        self.lookup, self.pragma, self.case_sensitive = lookup, pragma, case_sensitive_like
        self.ctes: dict[str, list[tuple[str, str]]] = {}
        self.n = 0

    # Tokens ------------------------------------------------------------------------------------------------------

    @property
    def now(self) -> Token:
        return self.tokens[self.i]

    def ahead(self, n: int = 1) -> Token:
        return self.tokens[min(self.i + n, len(self.tokens) - 1)]

    def take(self) -> Token:
        self.i += 1
        return self.tokens[self.i - 1]

    def accept(self, *words: str) -> bool:
        """A run of keywords or signs."""
        for k, w in enumerate(words):
            t = self.ahead(k)
            if t.word != w and not (t.kind == "op" and t.text == w):
                return False
        self.i += len(words)
        return True

    def expect(self, *words: str) -> None:
        if not self.accept(*words):
            raise SyntaxError(f"near {self.now.text!r}: expected {' '.join(words)}")

    def identifier(self) -> str:
        t = self.take()
        if t.kind not in ("name", "quoted", "string"):
            raise SyntaxError(f"near {t.text!r}: expected a name")
        return t.text

    def listed(self, one: Callable) -> list:
        out = [one()]
        while self.accept(","):
            out.append(one())
        return out

    # Expressions -------------------------------------------------------------------------------------------------

    def expr(self) -> Expr:
        left = self.conjunction()
        while self.accept("OR"):
            left = self._logic("OR", left, self.conjunction())
        return left

    def conjunction(self) -> Expr:
        left = self.negation()
        while self.accept("AND"):
            left = self._logic("AND", left, self.negation())
        return left

    @staticmethod
    def _logic(op: str, a: Expr, b: Expr) -> Expr:
        return lambda s: (f"({fn.condition(a(s))} {op} {fn.condition(b(s))})", "bool")

    def negation(self) -> Expr:
        if self.now.word == "NOT" and self.ahead().word != "NULL":
            self.take()
            x = self.negation()
            return getattr(x, "inverse", None) or (lambda s: (f"(NOT {fn.condition(x(s))})", "bool"))
        return self.predicate()

    def predicate(self) -> Expr:
        left = self.bits()
        while True:
            if self.now.kind == "op" and self.now.text in ("=", "==", "<>", "!=", "<", "<=", ">", ">="):
                op = {"==": "=", "!=": "<>"}.get(t := self.take().text, t)
                right = self.bits()
                c = getattr(left, "collation", None) or getattr(right, "collation", None)
                left = self._compare(op, self._collated(left, c), self._collated(right, c)) if c else self._compare(op, left, right)
            elif self.accept("ISNULL") or self.accept("IS", "NULL"):
                left = self._wrap("({} IS NULL)", left)
            elif self.accept("NOTNULL") or self.accept("NOT", "NULL") or self.accept("IS", "NOT", "NULL"):
                left = self._wrap("({} IS NOT NULL)", left)
            elif self.accept("IS"):
                left = self._is(left)
            elif self.now.word in ("IN", "LIKE", "GLOB", "REGEXP", "MATCH", "BETWEEN") or (self.now.word == "NOT" and self.ahead().word in ("IN", "LIKE", "GLOB", "REGEXP", "MATCH", "BETWEEN")):
                no = "NOT " if self.accept("NOT") else ""
                left = self._suffix(self.take().word, no, left)
            else:
                return left

    @staticmethod
    def _wrap(template: str, *xs: Expr, kind: str = "bool") -> Expr:
        return lambda s: (template.format(*(x(s)[0] for x in xs)), kind)

    @staticmethod
    def _compare(op: str, a: Expr, b: Expr) -> Expr:
        def render(s: Scope) -> Value:
            x, y = a(s), b(s)
            if "bool" in (x[1], y[1]) and x[1] != y[1]:  # booleans count as 0 and 1
                x, y = ((f"CAST({v[0]} AS INT)", "int") if v[1] == "bool" else v for v in (x, y))
            if {x[1], y[1]} == {"text", "time"}:
                x, y = ((f"CAST({v[0]} AS TIMESTAMP_NTZ)", "time") for v in (x, y))
            return f"({x[0]} {op} {y[0]})", "bool"

        return render

    def _is(self, left: Expr) -> Expr:
        no = self.accept("NOT")
        if self.accept("DISTINCT", "FROM"):
            no = not no
        elif self.now.word in ("TRUE", "FALSE"):
            want = self.take().word == "TRUE"
            return lambda s: (f"({'NOT ' if no else ''}coalesce({'' if want else 'NOT '}{fn.condition(left(s))}, false))", "bool")
        right = self.bits()
        return self._wrap("(NOT ({} <=> {}))" if no else "({} <=> {})", left, right)

    def _suffix(self, op: str, no: str, left: Expr) -> Expr:
        if op == "BETWEEN":
            low = self.bits()
            self.expect("AND")
            high = self.bits()
            return self._wrap(f"({{}} {no}BETWEEN {{}} AND {{}})", left, low, high)
        if op == "IN":
            self.expect("(")
            if self.now.word in ("SELECT", "WITH", "VALUES"):
                sub = self.query()
                self.expect(")")
                member: Expr = lambda s: (f"({left(s)[0]} IN ({sub(s)[0]}))", "bool")
                absent: Expr = lambda s: (self._absent(left(s)[0], sub, s), "bool")
                member.inverse, absent.inverse = absent, member  # type: ignore[attr-defined]
                return absent if no else member
            if self.accept(")"):
                return lambda s: ("true" if no else "false", "bool")
            items = self.listed(self.expr)
            self.expect(")")
            return lambda s: (f"({left(s)[0]} {no}IN ({', '.join(x(s)[0] for x in items)}))", "bool")
        right = self.bits()
        if op == "LIKE":
            escape = self.bits() if self.accept("ESCAPE") else None
            return lambda s: (f"({no}{self._like(left(s), right(s), escape(s) if escape else None)})", "bool")
        return self._matched(op, no, left, right)

    def _absent(self, x: str, sub: Callable, s: Scope) -> str:
        """x NOT IN (SELECT y): a plain IN of the distinct y and two facts about them (are there any, is one NULL), so
        that Spark joins by equality; its own NULL-aware form is a nested loop beside an OR and on large sides. Subqueries
        that speak of the outer query, or whose rows may change from run to run, keep that form."""
        ctes, windows = dict(self.ctes), self.windows
        try:
            text, out = sub(None)
        except KeyError:  # a column of the outer query
            self.ctes, self.windows = ctes, windows
            return f"({x} NOT IN ({sub(s)[0]}))"
        if len(out) != 1 or re.search(r"\b(LIMIT|OFFSET|rand\w*|uuid)\b", text, re.I):
            return f"({x} NOT IN ({sub(s)[0]}))"
        rows = f"({text}) AS `_in`(`_y`)"
        facts = f"(SELECT CASE WHEN count(*) = 0 THEN 'none' WHEN count(*) > count(`_y`) THEN 'null' END FROM {rows})"
        return f"(CASE WHEN {x} IN (SELECT DISTINCT `_y` FROM {rows}) THEN false WHEN {facts} = 'none' THEN true WHEN {facts} = 'null' OR {x} IS NULL THEN NULL ELSE true END)"

    @staticmethod
    def _matched(op: str, no: str, x: Expr, pattern: Expr) -> Expr:
        """x GLOB, REGEXP or MATCH a literal pattern, also as glob(pattern, x) and so on."""
        if op == "MATCH":
            raise ValueError("unable to use function MATCH in the requested context")

        def render(s: Scope) -> Value:
            p = fn._literal(pattern(s))
            regex = glob_regex(p) if op == "GLOB" else "(?s)" + re.sub(r"([+?(){}|\\])", r"\\\1", p)
            return (f"({no}{fn.text(x(s))} RLIKE {fn.quote(regex)})" if regex else f"({no}false)"), "bool"

        return render

    def _like(self, x: Value, p: Value, escape: Value | None) -> str:
        turn = (lambda t: t) if self.case_sensitive else fn.fold
        if escape is None:  # no character escapes: not even Spark's own
            p = (f"replace({fn.text(p)}, '\\\\', '\\\\\\\\')", "text")
            return f"{turn(fn.text(x))} LIKE {turn(p[0])}"
        return f"{turn(fn.text(x))} LIKE {turn(fn.text(p))} ESCAPE {escape[0]}"

    _LEVELS = (("&", "|", "<<", ">>"), ("+", "-"), ("*", "/", "%"))

    def bits(self, level: int = 0) -> Expr:
        if level == len(self._LEVELS):
            return self.chain()
        left = self.bits(level + 1)
        while self.now.kind == "op" and self.now.text in self._LEVELS[level]:
            left = self._arithmetic(self.take().text, left, self.bits(level + 1))
        return left

    def chain(self) -> Expr:
        left = self.unary()
        while self.now.kind == "op" and self.now.text in ("||", "->", "->>"):
            op, right = self.take().text, None
            right = self.unary()
            left = self._chained(op, left, right)
        return left

    @staticmethod
    def _chained(op: str, a: Expr, b: Expr) -> Expr:
        def render(s: Scope) -> Value:
            x, y = a(s), b(s)
            if op == "||":
                return f"({fn.text(x)} || {fn.text(y)})", "text"
            cells, function = (fn._TEXTS, "json_arrow") if op == "->" else (fn._VALUES, "json_arrow_value")
            if y[1] == "int" and not re.fullmatch(r"-?[0-9]+", y[0].strip("()")):
                return fn.python(function)(x, ("concat('$[', CASE WHEN {0} < 0 THEN concat('#', {0}) ELSE {0} END, ']')".format(y[0]), "text"))
            return fn.read(function, cells)(x, (y[0].strip("()"), "int") if y[1] == "int" else y)

        return render

    @staticmethod
    def _arithmetic(op: str, a: Expr, b: Expr) -> Expr:
        def number(v: Value) -> Value:
            return fn.cast(v, "REAL") if v[1] == "text" else (f"CAST({v[0]} AS INT)", "int") if v[1] == "bool" else v

        def render(s: Scope) -> Value:
            x, y = number(a(s)), number(b(s))
            both = x[1] == y[1] == "int"
            if op == "/":
                return (f"({x[0]} div nullif({y[0]}, 0))", "int") if both else (f"({fn._d(x)} / nullif({fn._d(y)}, 0D))", "real")
            if op == "%":
                x, y = (v[0] if v[1] == "int" else f"CAST({v[0]} AS BIGINT)" for v in (x, y))
                return f"({x} % nullif({y}, 0))", "int"
            if op in ("<<", ">>"):
                left, right = f"shiftleft(CAST({x[0]} AS BIGINT), CAST(abs({y[0]}) AS INT))", f"shiftright(CAST({x[0]} AS BIGINT), CAST(abs({y[0]}) AS INT))"
                far_left, far_right = f"CASE WHEN abs({y[0]}) >= 64 THEN 0 ELSE {left} END", f"CASE WHEN abs({y[0]}) >= 64 THEN CASE WHEN {x[0]} < 0 THEN -1 ELSE 0 END ELSE {right} END"
                a_, b_ = (far_left, far_right) if op == "<<" else (far_right, far_left)
                return f"(CASE WHEN {y[0]} < 0 THEN {b_} ELSE {a_} END)", "int"
            if both and op in ("+", "-", "*") and all(re.fullmatch(r"-?[0-9]+", v[0].strip("()")) for v in (x, y)):
                exact = {"+": int.__add__, "-": int.__sub__, "*": int.__mul__}[op](*(int(v[0].strip("()")) for v in (x, y)))
                if not -(2**63) <= exact < 2**63:  # constants that overflow become a real
                    return f"{float(exact)!r}D", "real"
            return f"({x[0]} {op} {y[0]})", "int" if both or op in "&|" else "real"

        return render

    def unary(self) -> Expr:
        if self.now.kind == "op" and self.now.text in ("-", "+", "~"):
            op = self.take().text
            x = self.unary()
            return x if op == "+" else lambda s: (f"({op}{x(s)[0]})", x(s)[1])
        x = self.primary()
        while self.accept("COLLATE"):
            c = self.identifier().upper()
            if c not in ("NOCASE", "RTRIM", "BINARY"):
                raise ValueError(f"no such collation sequence: {c}")
            x = self._collated(x, c)
        return x

    def _collated(self, x: Expr, c: str) -> Expr:
        """A comparison key; as a result column the value itself."""
        plain = getattr(x, "plain", x)
        key: Expr = {"NOCASE": lambda s: (fn.fold(plain(s)[0]), "text"), "RTRIM": self._wrap("rtrim({})", plain, kind="text"), "BINARY": self._wrap("{}", plain, kind="text")}[c]
        key.plain, key.collation = plain, c  # type: ignore[attr-defined]
        return key

    def primary(self) -> Expr:
        t = self.take()
        if t.kind == "number":
            if t.text[:2].lower() == "0x":
                return lambda s: (str(int(t.text, 16)), "int")
            whole = t.text.isdigit() and int(t.text) < 2**63
            return lambda s: (t.text if whole else f"{t.text}D", "int" if whole else "real")
        if t.kind == "string":
            return lambda s: (fn.quote(t.text), "text")
        if t.kind == "blob":
            return lambda s: (f"X'{t.text}'", "blob")
        if t.kind == "op" and t.text == "(":
            if self.now.word in ("SELECT", "WITH", "VALUES"):
                sub = self.query()
                self.expect(")")
                return lambda s: (f"({self._single(sub(s)[0])})", sub(s)[1][0][1] if sub(s)[1] else "any")
            items = self.listed(self.expr)
            self.expect(")")
            return items[0] if len(items) == 1 else lambda s: (f"({', '.join(x(s)[0] for x in items)})", "any")
        if t.kind == "quoted":
            return self.column([t.text])
        if t.kind != "name":
            raise SyntaxError(f"near {t.text!r}: syntax error")
        w = t.word
        if w == "NULL":
            return lambda s: ("NULL", "any")
        if w in ("TRUE", "FALSE"):
            return lambda s: (w.lower(), "bool")
        if w in ("CURRENT_DATE", "CURRENT_TIME", "CURRENT_TIMESTAMP"):
            pattern = {"CURRENT_DATE": "yyyy-MM-dd", "CURRENT_TIME": "HH:mm:ss", "CURRENT_TIMESTAMP": "yyyy-MM-dd HH:mm:ss"}[w]
            return lambda s: (f"date_format(current_timestamp(), '{pattern}')", "text")
        if w == "CASE":
            return self.case()
        if w == "CAST":
            self.expect("(")
            x = self.expr()
            self.expect("AS")
            declared = self.type_name()
            self.expect(")")
            return lambda s: fn.cast(x(s), declared)
        if w == "EXISTS":
            self.expect("(")
            sub = self.query()
            self.expect(")")
            return lambda s: (f"EXISTS ({sub(s)[0]})", "bool")
        if self.now.text == "(" and self.now.kind == "op":
            return self.call(t.text.lower())
        return self.column([t.text])

    @staticmethod
    def _single(sub: str) -> str:
        return sub

    def type_name(self) -> str:
        words = []
        while self.now.kind in ("name", "quoted") and self.now.word not in ("NOT", "NULL", "PRIMARY", "UNIQUE", "CHECK", "DEFAULT", "COLLATE", "REFERENCES", "GENERATED", "AS", "CONSTRAINT"):
            words.append(self.take().text)
        if self.accept("("):
            while not self.accept(")"):
                self.take()
        return " ".join(words)

    def case(self) -> Expr:
        base = None if self.now.word == "WHEN" else self.expr()
        pairs, last = [], None
        while self.accept("WHEN"):
            test = self.expr()
            self.expect("THEN")
            pairs.append((test, self.expr()))
        if self.accept("ELSE"):
            last = self.expr()
        self.expect("END")

        def render(s: Scope) -> Value:
            tests = [self._compare("=", base, c)(s)[0] if base else fn.truth(c(s)) for c, _ in pairs]
            values = [v(s) for _, v in pairs] + ([last(s)] if last else [])
            kinds = {v[1] for v in values} - {"any"}
            body = " ".join(f"WHEN {t} THEN {v[0]}" for t, v in zip(tests, values))
            return f"(CASE {body}{f' ELSE {values[-1][0]}' if last else ''} END)", kinds.pop() if len(kinds) == 1 else "real" if kinds == {"int", "real"} else "any"

        return render

    def column(self, parts: list[str]) -> Expr:
        while self.accept("."):
            parts.append(self.identifier())
        parts = parts[1:] if len(parts) > 2 else parts
        key = ".".join(p.lower() for p in parts)

        def render(s: Scope) -> Value:
            found = s.type_of(key)
            if found is None and len(parts) == 1 and key in s.aliases:
                alias = s.aliases[key]
                return f"({alias(s)[0]})", alias(s)[1]
            if found is None:
                raise KeyError(f"no such column: {'.'.join(parts)}")
            text = s.name_of(key) or ".".join(name(p) for p in parts)
            if s.grouped and not s.inside and key in s.types and text.lower() not in s.keys:
                text = s.picked.format(text) if s.picked else f"any_value({text})"
            return text, found

        render.column = parts[-1]  # type: ignore[attr-defined]
        return render

    def call(self, f: str) -> Expr:
        self.expect("(")
        distinct, star, args, order = self.accept("DISTINCT"), False, [], []
        if self.accept("*"):
            star = True
        elif self.now.text != ")":
            args = self.listed(self.expr)
        if self.accept("ORDER", "BY"):
            order = self.listed(self.order_term)
        self.expect(")")
        where = None
        if self.accept("FILTER", "("):
            self.expect("WHERE")
            where = self.expr()
            self.expect(")")
        if self.accept("OVER"):
            over = self.identifier() if self.now.kind != "op" else self.window()
            return self._over(f, args, star, where, over)
        if f in AGGREGATES and not (f in ("min", "max") and len(args) > 1):
            render = self._aggregate(f, args, star, distinct, order, where)
            render.aggregate = f  # type: ignore[attr-defined]
            return self._found(render, f, args)
        if f in ("glob", "regexp", "match") and len(args) == 2:
            return self._matched(f.upper(), "", args[1], args[0])
        if f == "like" and len(args) == 3:
            return lambda s: (f"({self._like(args[1](s), args[0](s), args[2](s))})", "bool")
        if f in self.session and not args:
            return lambda s: self.session[f]
        if star or f not in fn.FUNCTIONS:
            raise ValueError(f"no such function: {f}")
        return lambda s: fn.FUNCTIONS[f](*(a(s) for a in args))

    def _found(self, render: Expr, f: str, args: list[Expr]) -> Expr:
        self.aggregates.append((f, args))
        return render

    aggregates: list = []
    #: Functions of the session, as values.
    session: dict[str, Value] = {}

    def _inner(self, s: Scope, xs: list[Expr]) -> list[Value]:
        s.inside += 1
        try:
            return [x(s) for x in xs]
        finally:
            s.inside -= 1

    def _aggregate(self, f: str, args: list[Expr], star: bool, distinct: bool, order: list, where: Expr | None) -> Expr:
        def render(s: Scope) -> Value:
            xs = self._inner(s, args)
            by = ", ".join(self._inner(s, order)) if order else None
            tail = f" FILTER (WHERE {fn.condition(self._inner(s, [where])[0])})" if where else ""
            d = "DISTINCT " * distinct
            if f == "count":
                return f"count({d}{xs[0][0] if xs else '*'}){tail}", "int"
            x = xs[0]
            number = fn.cast(x, "REAL") if x[1] == "text" else (f"CAST({x[0]} AS INT)", "int") if x[1] == "bool" else x
            if f in ("sum", "avg"):
                return f"{f}({d}{number[0]}){tail}", "int" if f == "sum" and x[1] == "int" else "real"
            if f == "total":
                return f"coalesce(sum({d}{fn._d(number)}){tail}, 0D)", "real"
            if f in ("min", "max"):
                return f"{f}({x[0]}){tail}", x[1]
            if f in ("group_concat", "string_agg"):
                within = f" WITHIN GROUP (ORDER BY {by or fn.text(x)})"
                return f"listagg({d}{fn.text(x)}, {xs[1][0] if len(xs) > 1 else chr(39) + ',' + chr(39)}){within}{tail}", "text"
            if f == "median":
                return f"median({x[0]}){tail}", "real"
            if f == "percentile":
                return f"percentile({x[0]}, {xs[1][0]} / 100){tail}", "real"
            if f in ("percentile_cont", "percentile_disc"):
                return f"{f}({xs[1][0].rstrip('D')}) WITHIN GROUP (ORDER BY {x[0]}){tail}", "real" if f.endswith("cont") else x[1]
            if f == "decimal_sum":
                return f"regexp_replace(CAST(sum(try_cast({x[0]} AS DECIMAL(38, 10))){tail} AS STRING), '\\\\.?0+$', '')", "text"
            cell = fn.quoted(x) if f.endswith("array") else f"concat({fn.quoted((fn.text(x), 'text'))}, ':', {fn.quoted(xs[1])})"
            if by:
                cells = f"coalesce(listagg({cell}, ',') WITHIN GROUP (ORDER BY {by}){tail}, '')"
            else:
                cells = f"array_join(array_sort(collect_list({cell}){tail}), ',')"
            body = f"concat('[', {cells}, ']')" if f.endswith("array") else f"concat('{{', {cells}, '}}')"
            return (f"parse_json({body})", "any") if f.startswith("jsonb") else (body, "json")

        return render

    def _over(self, f: str, args: list[Expr], star: bool, where: Expr | None, over: str | Window) -> Expr:
        if f not in AGGREGATES | WINDOW:
            raise ValueError(f"{f}() may not be used as a window function")

        def render(s: Scope) -> Value:
            xs = self._inner(s, args)
            w = (self.windows[over.lower()] if isinstance(over, str) else over).resolved(self, s)
            if where:
                test = fn.condition(self._inner(s, [where])[0])
                xs = [(f"CASE WHEN {test} THEN {x[0]} END", x[1]) for x in xs] or [(f"CASE WHEN {test} THEN 1 END", "int")]
            if w.exclude:
                return self._excluding(f, xs, w, s)
            spec = f"({w.text(s, turned=f in ('count', 'sum', 'avg', 'total', 'min', 'max'))})"
            inner = ", ".join(x[0] for x in xs) or ("*" if star or f == "count" else "")
            if f == "total":
                return f"coalesce(sum({fn._d(xs[0])}) OVER {spec}, 0D)", "real"
            if f in ("group_concat", "string_agg"):
                parts = f"collect_list({fn.text(xs[0])}) OVER {spec}"
                return f"CASE WHEN size({parts}) > 0 THEN array_join({parts}, {xs[1][0] if len(xs) > 1 else chr(39) + ',' + chr(39)}) END", "text"
            if f in ("json_group_array", "jsonb_group_array"):
                body = f"concat('[', array_join(collect_list({fn.quoted(xs[0])}) OVER {spec}, ','), ']')"
                return (f"parse_json({body})", "any") if f.startswith("jsonb") else (body, "json")
            if f in ("json_group_object", "jsonb_group_object"):
                body = f"concat('{{', array_join(collect_list(concat({fn.quoted((fn.text(xs[0]), 'text'))}, ':', {fn.quoted(xs[1])})) OVER {spec}, ','), '}}')"
                return (f"parse_json({body})", "any") if f.startswith("jsonb") else (body, "json")
            kinds = {"count": "int", "avg": "real", "percent_rank": "real", "cume_dist": "real"}
            return f"{f}({inner}) OVER {spec}", kinds.get(f) or ("int" if f in ("row_number", "rank", "dense_rank", "ntile") else xs[0][1])

        return render

    def _excluding(self, f: str, xs: list[Value], w: Window, s: Scope) -> Value:
        """A function over a frame with EXCLUDE: the frame's values with row and group numbers, filtered."""
        d, n = w.numbers(s)
        x = xs[0] if xs else ("1", "int")
        keep = {"CURRENT ROW": f"c.n <> {n}", "GROUP": f"c.d <> {d}", "TIES": f"(c.d <> {d} OR c.n = {n})"}[w.exclude]
        cells = f"filter(collect_list(named_struct('n', {n}, 'd', {d}, 'v', {x[0]})) OVER ({w.text(s, numbered=True)}), c -> {keep})"
        values = f"transform(array_sort({cells}), c -> c.v)"
        known = f"filter({values}, v -> v IS NOT NULL)"
        zero = "CAST(0 AS BIGINT)" if x[1] == "int" else "0D"
        total = f"aggregate({known}, {zero}, (a, v) -> a + {'v' if x[1] == 'int' else 'CAST(v AS DOUBLE)'})"
        if f == "count":
            return f"CAST(size({known}) AS BIGINT)", "int"
        if f == "sum":
            return f"CASE WHEN size({known}) > 0 THEN {total} END", x[1]
        if f in ("avg", "total"):
            whole = f"CAST({total} AS DOUBLE)"
            return (whole if f == "total" else f"CASE WHEN size({known}) > 0 THEN {whole} / size({known}) END"), "real"
        if f in ("min", "max"):
            return f"array_{f}({known})", x[1]
        if f in ("first_value", "last_value", "nth_value"):
            at = {"first_value": "0", "last_value": f"size({values}) - 1", "nth_value": f"CAST({xs[1][0]} AS INT) - 1" if len(xs) > 1 else "0"}[f]
            return f"get({values}, {at})", x[1]
        if f in ("group_concat", "string_agg"):
            text = f"transform({known}, v -> {fn.text(('v', x[1]))})"
            return f"CASE WHEN size({known}) > 0 THEN array_join({text}, {xs[1][0] if len(xs) > 1 else chr(39) + ',' + chr(39)}) END", "text"
        raise NotImplementedError(f"{f}() over a frame with EXCLUDE")

    windows: dict[str, Window] = {}

    def window(self) -> Window:
        """( [base] [PARTITION BY] [ORDER BY] [frame] ); the opening bracket is next."""
        self.expect("(")
        w = Window()
        if self.now.kind in ("name", "quoted") and self.now.word not in ("PARTITION", "ORDER", "ROWS", "RANGE", "GROUPS"):
            w.base = self.identifier().lower()
        w.partition = self.listed(self.expr) if self.accept("PARTITION", "BY") else []
        w.order = self.listed(self.order_term) if self.accept("ORDER", "BY") else []
        if self.now.word in ("ROWS", "RANGE", "GROUPS"):
            w.unit = self.take().word
            if self.accept("BETWEEN"):
                w.low = self._bound()
                self.expect("AND")
                w.high = self._bound()
            else:
                w.low, w.high = self._bound(), "CURRENT ROW"
            if self.accept("EXCLUDE") and not self.accept("NO", "OTHERS"):
                w.exclude = next(e for e in ("CURRENT ROW", "GROUP", "TIES") if self.accept(*e.split()))
        self.expect(")")
        return w

    def _bound(self) -> str:
        for words in ("UNBOUNDED PRECEDING", "UNBOUNDED FOLLOWING", "CURRENT ROW"):
            if self.accept(*words.split()):
                return words
        size = self.bits()(Scope())[0]
        return f"{size} {self.take().word}"

    def order_term(self) -> Callable[[Scope], str]:
        x = self.expr()
        way = "DESC" if self.accept("DESC") else "ASC" if self.accept("ASC") or True else ""
        nulls = f"NULLS {self.take().word}" if self.accept("NULLS") else "NULLS LAST" if way == "DESC" else "NULLS FIRST"
        return lambda s: f"{x(s)[0]} {way} {nulls}"

    # Queries -----------------------------------------------------------------------------------------------------

    def query(self) -> Callable[[Scope | None], tuple[str, list[tuple[str, str]]]]:
        """[WITH] compound [ORDER BY] [LIMIT]: a function of the outer scope that gives text and output columns."""
        ctes, recursive = [], False
        if self.accept("WITH"):
            recursive = self.accept("RECURSIVE")
            for cte in iter(lambda: self._cte(), None):
                ctes.append(cte)
                if not self.accept(","):
                    break
        parts = [(None, self.core())]
        while self.now.word in ("UNION", "INTERSECT", "EXCEPT"):
            op = self.take().word + (" ALL" if self.accept("ALL") else "")
            parts.append((op, self.core()))
        order = self.listed(self.order_term) if self.accept("ORDER", "BY") else []
        limit = self._limit()

        def render(outer: Scope | None = None) -> tuple[str, list[tuple[str, str]]]:
            before, heads = dict(self.ctes), []
            for c, columns, body in ctes:
                if recursive:  # the first SELECT tells the columns that the others may speak of
                    _, out, _ = body.first(outer, [])
                    self.ctes[c.lower()] = [(n, k) for n, (_, k) in zip(columns, out)] if columns else out
                text, out = body(outer)
                out = [(n, k) for n, (_, k) in zip(columns, out)] if columns else out
                self.ctes[c.lower()] = out
                heads.append(f"{name(c)}({', '.join(name(n) for n, _ in out)}) AS ({text})")
            text, out, scope = parts[0][1](outer, order if len(parts) == 1 else [])
            for op, p in parts[1:]:
                right, columns, _ = p(outer, [])
                if len(columns) != len(out):
                    raise ValueError(f"SELECTs to the left and right of {op} do not have the same number of result columns")
                text = f"({text}) {op} ({right})"
            if len(parts) > 1 and order:
                s = Scope({n.lower(): k for n, k in out}, outer)
                text = f"SELECT * FROM ({text}) ORDER BY {', '.join(o(s) for o in order)}"
            text += limit
            self.ctes = before
            return (f"WITH {'RECURSIVE ' * recursive}{', '.join(heads)} " if heads else "") + text, out

        render.first = parts[0][1]  # type: ignore[attr-defined]
        return render

    def _cte(self):
        c = self.identifier()
        columns = []
        if self.accept("("):
            columns = self.listed(self.identifier)
            self.expect(")")
        self.expect("AS")
        self.accept("NOT")
        self.accept("MATERIALIZED")
        self.expect("(")
        body = self.query()
        self.expect(")")
        return c, columns, body

    def _limit(self) -> str:
        if not self.accept("LIMIT"):
            return ""
        number = lambda: int(float(eval_number(self.bits()(Scope())[0])))
        n, skip = number(), 0
        if self.accept("OFFSET"):
            skip = number()
        elif self.accept(","):
            n, skip = number(), n
        return (f" LIMIT {n}" if n >= 0 else " LIMIT ALL" if skip > 0 else "") + (f" OFFSET {skip}" if skip > 0 else "")

    def core(self):
        if self.accept("VALUES"):
            rows = self.listed(self._row)
            if len({len(r) for r in rows}) != 1:
                raise ValueError("all VALUES must have the same number of terms")

            def values(outer, order):
                cells = [[x(outer or Scope()) for x in r] for r in rows]
                out = [(f"column{k + 1}", next((r[k][1] for r in cells if r[k][1] != "any"), "any")) for k in range(len(rows[0]))]
                if outer:  # a row that speaks of an outer query is no constant
                    return " UNION ALL ".join("SELECT " + ", ".join(f"{v[0]} AS {n}" for v, (n, _) in zip(r, out)) for r in cells), out, None
                text = ", ".join(f"({', '.join(v[0] for v in r)})" for r in cells)
                return f"SELECT * FROM VALUES {text} AS v({', '.join(n for n, _ in out)})", out, None

            return values
        self.expect("SELECT")
        distinct = "DISTINCT " * self.accept("DISTINCT")
        self.accept("ALL")
        kept, self.aggregates = self.aggregates, []
        windows, self.windows = self.windows, dict(self.windows)
        items = self.listed(self._item)
        found = self.aggregates
        sources = self._from() if self.accept("FROM") else None
        single = sources is not None and sources.single
        where = self.expr() if self.accept("WHERE") else None
        group = self.listed(self.expr) if self.accept("GROUP", "BY") else []
        having = self.expr() if self.accept("HAVING") else None
        own = self.windows
        if self.accept("WINDOW"):
            for w in iter(lambda: self.identifier(), None):
                self.expect("AS")
                own[w.lower()] = self.window()
                if not self.accept(","):
                    break
        grouped, self.aggregates, self.windows = bool(group or found or self.aggregates), kept, windows

        def render(outer, order):
            scope, text = Scope(outer=outer), ""
            if sources:
                text, scope.types = sources(scope)
            saved, self.windows = self.windows, own
            for x, alias, _ in items:
                if alias and x:
                    scope.aliases[alias.lower()] = x
            condition = f" WHERE {fn.condition(where(scope))}" if where else ""
            keys = []
            for g in group:
                k = g(scope)[0]
                keys.append(items[int(k) - 1][0](scope)[0] if k.isdigit() else k)
            scope.grouped, scope.keys = grouped, {k.strip("()").lower() for k in keys}
            extremes = [(f, a) for f, a in found if f in ("min", "max")]
            if grouped and len(extremes) == 1:
                by = self._inner(scope, extremes[0][1])[0][0]
                scope.picked = f"{extremes[0][0]}_by({{}}, {by})"
            out, cells = [], []
            for x, alias, label in items:
                if x is None:
                    own_columns = [c for c in scope.types if "." not in c]
                    out += [(c, scope.types[c]) for c in own_columns]
                    cells.append("*")
                    continue
                v = x(scope)
                label = alias or getattr(x, "column", None) or label
                out.append((label, v[1]))
                cells.append(f"{v[0]} AS {name(label)}")
            tail = f" GROUP BY {', '.join(keys)}" if keys else ""
            tail += f" HAVING {fn.condition(having(scope))}" if having and grouped else ""
            if order:
                known = {n.lower() for n, _ in out}
                s = Scope({**scope.types}, outer, {}, scope.grouped, scope.keys, scope.picked)
                terms = []
                for o in order:
                    s.types = {**scope.types, **{n: "any" for n in known}}
                    s.keys = scope.keys | {name(n).lower() for n in known}
                    terms.append(o(s))
                tail += f" ORDER BY {', '.join(terms)}"
            self.windows = saved
            if scope.numbered:
                if grouped or not single or any(c == "*" for c in cells):
                    raise NotImplementedError("GROUPS frames and EXCLUDE need one source, named columns and no grouping: use a derived table")
                numbers = ", ".join(f"dense_rank() OVER ({w}) AS `_d{k}`, row_number() OVER ({w}) AS `_n{k}`" for k, w in enumerate(scope.numbered))
                text, condition = f"(SELECT *, {numbers} FROM {text}{condition}) AS {text.rsplit(' AS ', 1)[1]}", ""
            return f"SELECT {distinct}{', '.join(cells)}{f' FROM {text}' if text else ''}{condition}{tail}", out, scope

        return render

    def _row(self) -> list[Expr]:
        self.expect("(")
        row = self.listed(self.expr)
        self.expect(")")
        return row

    def _item(self) -> tuple[Expr | None, str | None, str]:
        if self.accept("*"):
            return None, None, "*"
        begin = self.now.at
        x = self.expr()
        x = getattr(x, "plain", x)
        label = self.sql[begin : self.now.at].strip()
        alias = None
        if self.accept("AS") or (self.now.kind in ("name", "quoted", "string") and self.now.word not in ENDS):
            alias = self.identifier()
        return x, alias, label

    def _from(self) -> Callable[[Scope], tuple[str, dict[str, str]]]:
        sources = [(None, self._source(), None)]
        while True:
            natural = self.accept("NATURAL")
            how = "CROSS" if self.accept("CROSS") else "INNER" if self.accept("INNER") else next((h for h in ("LEFT", "RIGHT", "FULL") if self.accept(h)), None)
            if how in ("LEFT", "RIGHT", "FULL"):
                self.accept("OUTER")
            if not self.accept("JOIN"):
                if natural or how:
                    raise SyntaxError(f"near {self.now.text!r}: expected JOIN")
                break
            source, on = self._source(), None
            if self.accept("ON"):
                on = self.expr()
            elif self.accept("USING", "("):
                on = self.listed(self.identifier)
                self.expect(")")
            elif not natural and how != "CROSS":
                raise SyntaxError("a JOIN needs ON or USING")
            sources.append((("NATURAL " if natural else "") + (how if how and not (how == "CROSS" and on) else "INNER"), source, on))

        def render(scope: Scope) -> tuple[str, dict[str, str]]:
            text, types = sources[0][1](scope)
            for how, source, on in sources[1:]:
                right, more = source(scope)
                if how.startswith("NATURAL") and not {c for c in more if "." not in c} & set(types):
                    how = "CROSS"
                types = {**more, **types}
                inner = Scope(types, scope.outer)
                text += f" {how} JOIN {right}" + (f" USING ({', '.join(name(c) for c in on)})" if isinstance(on, list) else f" ON {fn.condition(on(inner))}" if on else "")
            return text, types

        render.single = len(sources) == 1  # type: ignore[attr-defined]
        return render

    def _source(self):
        if self.accept("("):
            sub = self.query()
            self.expect(")")
            alias = self._alias()

            def derived(scope: Scope):
                nonlocal alias
                text, out = sub(scope.outer)
                if alias is None:
                    self.n += 1
                    alias = f"_s{self.n}"
                return f"({text}) AS {name(alias)}", self._typed(alias, out)

            return derived
        table = self.identifier()
        if self.accept("."):
            table = self.identifier()
        if table.lower().startswith("pragma_") and self.pragma:
            argument = None
            if self.accept("("):
                argument = None if self.now.text == ")" else self.take().text
                self.expect(")")
            table = self.pragma(table.lower(), argument)
        alias = self._alias() or table
        if self.accept("INDEXED", "BY"):
            self.identifier()
        self.accept("NOT", "INDEXED")

        def base(scope: Scope):
            columns = self.ctes.get(table.lower())
            if columns is None:
                columns = [(c, kind(k)) for c, k in self.lookup(table)]
            return f"{name(table)} AS {name(alias)}", self._typed(alias, columns)

        return base

    def _alias(self) -> str | None:
        if self.accept("AS") or (self.now.kind in ("name", "quoted") and self.now.word not in ENDS):
            return self.identifier()
        return None

    @staticmethod
    def _typed(alias: str, columns: list[tuple[str, str]]) -> dict[str, str]:
        return {**{c.lower(): k for c, k in columns}, **{f"{alias.lower()}.{c.lower()}": k for c, k in columns}}


def eval_number(text: str) -> float:
    """A constant of numbers and + - * ( ), as LIMIT takes."""
    plain = text.replace("D", "").replace(" ", "")
    if not re.fullmatch(r"[0-9.+*()-]+", plain):
        raise ValueError(f"not a constant number: {text}")
    value = sum(float(t) for t in re.findall(r"[+-]?[0-9.]+", plain.replace("(", "").replace(")", ""))) if "*" not in plain else float(__import__("math").prod(float(x) for x in plain.replace("(", "").replace(")", "").split("*")))
    if value != int(value):
        raise ValueError("datatype mismatch")
    return value
