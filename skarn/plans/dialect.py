"""The dialect's queries as Spark SQL.

A tokenizer and a recursive-descent rewriter. It keeps track of types just far enough to close the gaps between the
dialect and Spark: integer division, IEEE division of reals, Boolean against number comparison, float literals, NULL
order, LIKE without escapes, the function library, GROUP_CONCAT, columns outside GROUP BY, folded texts under the
`es` collation, NOT IN without a forced broadcast. Planning and optimisation are Catalyst's.

Beyond the dialect WITH (RECURSIVE too), UNION / INTERSECT / EXCEPT, OVER, FILTER, ROLLUP, CUBE, GROUPING SETS, comma joins
and functions that only Spark has are read as well, so the dialect's semantics hold in them. Other forms of Spark's raise
Unsupported; the session hands such statements to Spark as they are.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from skarn.errors import SyntaxFault
from skarn.functions.collation import fold_sql
from skarn.functions.scalar import NAMES, quoted, sql_of


class Unsupported(SyntaxFault):
    """A form that only Spark knows."""


@dataclass(frozen=True)
class Token:
    kind: str  # word, name, text, number, param, sign, end
    value: str
    place: int = 0

    def is_word(self, *words: str) -> bool:
        return self.kind == "word" and self.value.upper() in words


_TOKEN = re.compile(
    r"""\s+|--[^\n]*|\#[^\n]*|/\*.*?\*/"""
    r"""|(?P<number>(?:\d+\.\d*|\.\d+|\d+)(?:[eE][+-]?\d+)?)"""
    r"""|(?P<text>'(?:[^'\\]|\\.|'')*')"""
    r"""|(?P<name>"(?:[^"]|"")*"|`(?:[^`]|``)*`)"""
    r"""|(?P<word>[^\W\d]\w*)|(?P<param>\?)"""
    r"""|(?P<sign><=>|<>|!=|<=|>=|\|\||[-+*/%=<>().,;@:\[\]])""",
    re.S,
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", "b": "\b", "Z": "\x1a"}


def tokens(sql: str) -> list[Token]:
    out, at = [], 0
    while at < len(sql):
        m = _TOKEN.match(sql, at)
        if not m:
            raise SyntaxFault(f"unexpected {sql[at]!r} at {at}")
        if m.lastgroup == "text":
            body = m["text"][1:-1].replace("''", "'")
            out.append(Token("text", re.sub(r"\\(.)", lambda e: _ESCAPES.get(e[1], e[1]), body, flags=re.S), at))
        elif m.lastgroup == "name":
            mark = m["name"][0]
            out.append(Token("name", m["name"][1:-1].replace(mark * 2, mark), at))
        elif m.lastgroup:
            out.append(Token(m.lastgroup, m[0], at))
        at = m.end()
    return [*out, Token("end", "", len(sql))]


def split_statements(script: str) -> list[str]:
    """The statements of a script, cut at `;` outside texts, names and comments."""
    out, first = [], 0
    for t in tokens(script):
        if t.kind == "end" or t.value == ";" and t.kind == "sign":
            if script[first : t.place].strip():
                out.append(script[first : t.place].strip())
            first = t.place + 1
    return out


#: Words that end an expression or start a clause.
_CLAUSES = ("FROM", "WHERE", "GROUP", "HAVING", "ORDER", "LIMIT", "OFFSET")
_JOINS = ("JOIN", "INNER", "LEFT", "RIGHT", "FULL", "CROSS")
_RESERVED = {*_CLAUSES, *_JOINS, "ON", "USING", "AS", "AND", "OR", "NOT", "IS", "IN", "LIKE", "BETWEEN", "ASC", "DESC", "NULLS", "SELECT", "THEN", "WHEN", "ELSE", "END", "UNION", "INTERSECT", "EXCEPT", "SEPARATOR", "ESCAPE", "MINUS"}
_SETS = ("UNION", "INTERSECT", "EXCEPT", "MINUS")
_GROUPINGS = ("ROLLUP", "CUBE", "GROUPING")
_GROUP_CONCAT_BYTES = 1_048_576
_AGGREGATES = {"count", "sum", "min", "max", "avg"}
TYPES = {
    "BOOL": ("boolean", "bool"), "BOOLEAN": ("boolean", "bool"), "INT": ("int", "int"), "INTEGER": ("int", "int"), "BIGINT": ("bigint", "int"),
    "REAL": ("double", "real"), "DOUBLE": ("double", "real"), "FLOAT": ("double", "real"), "DECIMAL": ("decimal", "decimal"), "NUMERIC": ("decimal", "decimal"),
    "TEXT": ("string", "text"), "VARCHAR": ("string", "text"), "CHAR": ("string", "text"), "BLOB": ("binary", "bytes"), "BYTEA": ("binary", "bytes"),
    "DATE": ("date", "date"), "TIMESTAMP": ("timestamp_ntz", "ts"), "DATETIME": ("timestamp_ntz", "ts"), "UUID": ("string", "text"), "SERIAL": ("int", "int"),
}


def tag_of(spark_type: str) -> str | None:
    """The type tag of a Spark type's simple name."""
    if spark_type.startswith("decimal"):
        return "decimal"
    return {"tinyint": "int", "smallint": "int", "int": "int", "bigint": "int", "float": "real", "double": "real", "string": "text", "boolean": "bool", "binary": "bytes", "date": "date", "timestamp": "ts", "timestamp_ntz": "ts"}.get(spark_type)


@dataclass
class Scope:
    """Column types of a SELECT's FROM, by name and by alias.name; the outer SELECT's for correlated names."""

    types: dict[str, str | None] = field(default_factory=dict)
    outer: Scope | None = None
    group_keys: set[str] | None = None
    in_aggregate: int = 0

    def find(self, name: str) -> tuple[str | None, bool]:
        """Type, and whether the column is this SELECT's own."""
        if name in self.types:
            return self.types[name], True
        return (self.outer.find(name)[0] if self.outer else None), self.outer is None


def name_sql(*parts: str) -> str:
    return ".".join("`" + p.replace("`", "``") + "`" for p in parts)


class Rewriter:
    """schema_of(name parts) -> [(column, Spark type)] or None where the table is unknown; relation_of(name parts) -> the parts that Spark knows it by."""

    def __init__(self, sql: str, schema_of=lambda parts: None, collation: str = "binary", constants: dict[str, str] | None = None, relation_of=lambda parts: parts):
        self.tokens, self.at = tokens(sql), 0
        self.schema_of, self.relation_of, self.es = schema_of, relation_of, collation == "es"
        self.constants = constants or {}
        self.scope = Scope()
        self.ctes: dict[str, list[tuple[str, str | None]]] = {}
        self.growing: list[tuple[str, list[str]]] = []  # recursive CTEs whose first term isn't read yet
        self.filtering = False  # whether a predicate here only decides if a row stays
        self.outer_names = 0

    # -- tokens

    @property
    def now(self) -> Token:
        return self.tokens[self.at]

    def take(self) -> Token:
        self.at += 1
        return self.tokens[self.at - 1]

    def word(self, *words: str) -> bool:
        if self.now.is_word(*words):
            self.at += 1
            return True
        return False

    def sign(self, value: str) -> bool:
        if self.now.kind == "sign" and self.now.value == value:
            self.at += 1
            return True
        return False

    def need(self, what: str) -> None:
        if not (self.sign(what) or self.word(what)):
            raise SyntaxFault(f"{what} expected at {self.now.place}, found {self.now.value!r}")

    def identifier(self) -> str:
        if self.now.kind == "name" or self.now.kind == "word" and self.now.value.upper() not in _RESERVED:
            return self.take().value
        raise SyntaxFault(f"a name expected at {self.now.place}, found {self.now.value!r}")

    def end(self) -> None:
        self.sign(";")
        if self.now.kind != "end":
            raise Unsupported(f"unexpected {self.now.value!r} at {self.now.place}")

    # -- SELECT

    def statement(self) -> str:
        out = self.query()[0]
        self.end()
        return out

    def query(self) -> tuple[str, list[tuple[str, str | None]]]:
        """[WITH ...] SELECT, or SELECTs under set operations: SQL, and the names and types of its columns."""
        known, filtering, self.filtering = dict(self.ctes), self.filtering, False
        prefix = ""
        if self.word("WITH"):
            recursive = self.word("RECURSIVE")
            prefix = f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(self._list(self._cte, recursive=recursive))} "
        sql, columns = self._set_query() if self._in_set() or self.now.value == "(" and self.now.kind == "sign" else self.select()
        self.ctes, self.filtering = known, filtering
        return prefix + sql, columns

    def at_query(self) -> bool:
        return self.now.is_word("SELECT", "WITH")

    def _cte(self, recursive: bool = False) -> str:
        name, names = self.identifier(), []
        if self.sign("("):
            names = self._list(self.identifier)
            self.need(")")
        self.need("AS")
        self.need("(")
        if recursive:
            self.ctes[name] = [(n, None) for n in names]
            self.growing.append((name, names))
        sql, columns = self.query()
        self.need(")")
        self.growing = [g for g in self.growing if g[0] != name]
        self.ctes[name] = self._named(names, columns)
        return f"{name_sql(name)}{' (' + ', '.join(map(name_sql, names)) + ')' if names else ''} AS ({sql})"

    @staticmethod
    def _named(names: list[str], columns: list) -> list[tuple[str, str | None]]:
        return [(n, kind) for n, (_, kind) in zip(names or [n for n, _ in columns], columns, strict=False)]

    def _in_set(self) -> bool:
        """Whether the query that begins here has set operations of its own."""
        depth, k = 0, self.at
        while (t := self.tokens[k]).kind != "end" and t.value != ";":
            if t.kind == "sign" and t.value in "()":
                depth += 1 if t.value == "(" else -1
                if depth < 0:
                    break
            elif not depth and t.is_word(*_SETS):
                return True
            k += 1
        return False

    def _term(self) -> tuple[str, list[tuple[str, str | None]]]:
        if self.sign("("):
            sql, columns = self.query()
            self.need(")")
            return f"({sql})", columns
        return self.select(tail=False)

    def _set_query(self) -> tuple[str, list[tuple[str, str | None]]]:
        """Terms in text order; Spark's precedence is the standard one. ORDER BY and LIMIT are of the whole."""
        sql, columns = self._term()
        for name, names in self.growing:
            self.ctes[name] = self._named(names, columns)
        while self.now.is_word(*_SETS):
            op = self.take().value.upper()
            every = " ALL" if self.word("ALL") else ""
            self.word("DISTINCT")
            sql += f" {op}{every} {self._term()[0]}"
        outer, self.scope = self.scope, Scope(types=dict(columns), outer=self.scope)
        order = self._order_by() if self.word("ORDER") else ""
        limit = self._limit()
        self.scope = outer
        return sql + order + limit, columns

    def select(self, tail: bool = True) -> tuple[str, list[tuple[str, str | None]]]:
        """SQL, and the names and types of its columns; tail: with its own ORDER BY and LIMIT."""
        self.need("SELECT")
        outer, self.scope = self.scope, Scope(outer=self.scope)
        distinct = self.word("DISTINCT")
        self.word("ALL")
        items_at = self.at
        source = self._skip_to_from()
        from_sql = self._from() if source else ""
        after_from = self.at
        keys = self._peek_group_keys()
        self.at = after_from
        where = f" WHERE {self._condition()}" if self.word("WHERE") else ""
        group = ""
        if self.word("GROUP"):
            self.need("BY")
            group = f" GROUP BY {', '.join(self._list(self._group_key))}"
        self.scope.group_keys = keys
        having = f" HAVING {self.expression()[0]}" if self.word("HAVING") else ""
        order = self._order_by() if tail and self.word("ORDER") else ""
        limit = self._limit() if tail else ""
        stop = self.at
        self.at = items_at
        items = self._list(self._item)
        if source and not self.now.is_word("FROM"):
            raise Unsupported(f"unexpected {self.now.value!r} at {self.now.place}")
        if source or self.at > stop:
            self.at = max(stop, self.at) if not source else stop
        columns = [c for i in items for c in i[1]]
        listed = ", ".join(i[0] for i in items)
        self.scope = outer
        if distinct and self.es and any(t == "text" for _, t in columns):
            inner = f"SELECT {listed}{from_sql}{where}{group}{having}{order}"
            folded = ", ".join(fold_sql(name_sql(n)) if t == "text" else name_sql(n) for n, t in columns)
            shown = ", ".join(f"min({name_sql(n)}) AS {name_sql(n)}" if t == "text" else f"first({name_sql(n)}) AS {name_sql(n)}" for n, t in columns)
            return f"SELECT {shown} FROM ({inner}) GROUP BY {folded}{limit}", columns
        return f"SELECT {'DISTINCT ' if distinct else ''}{listed}{from_sql}{where}{group}{having}{order}{limit}", columns

    def _skip_to_from(self) -> bool:
        """Go to this SELECT's FROM; without one, to its other clauses or its end."""
        depth, k = 0, self.at
        while (t := self.tokens[k]).kind != "end":
            if t.kind == "sign" and t.value == "(":
                depth += 1
            elif t.kind == "sign" and t.value == ")":
                if not depth:
                    break
                depth -= 1
            elif not depth and t.is_word(*_CLAUSES, *_SETS) or not depth and t.value == ";":
                break
            k += 1
        self.at = k
        return self.tokens[k].is_word("FROM")

    def _peek_group_keys(self) -> set[str] | None:
        """The GROUP BY keys, before the clauses that refer to them are read."""
        depth, k, outer_at = 0, self.at, self.at
        while (t := self.tokens[k]).kind != "end":
            if t.kind == "sign" and t.value in "()":
                depth += 1 if t.value == "(" else -1
                if depth < 0:
                    break
            elif not depth and t.is_word(*_SETS):
                break
            elif not depth and t.is_word("GROUP") and self.tokens[k + 1].is_word("BY"):
                self.at = k + 2
                keys = {x for own in self._list(self._group_key, plain=True) for x in own}
                self.at = outer_at
                return keys
            k += 1
        return None

    def _group_key(self, plain: bool = False):
        """SQL of a GROUP BY item, or, plain, the expressions in it."""
        if self.now.is_word(*_GROUPINGS) and (self.tokens[self.at + 1].value == "(" or self.tokens[self.at + 1].is_word("SETS")):
            name = self.take().value.upper()
            name += " " + self.take().value.upper() if name == "GROUPING" else ""
            sql, inside = self._grouping()
            return inside if plain else f"{name} {sql}"
        sql, kind = self.expression()
        return [sql] if plain else fold_sql(sql) if self.es and kind == "text" else sql

    def _grouping(self) -> tuple[str, list[str]]:
        """A parenthesised list of expressions and of such lists."""
        self.need("(")
        parts: list[tuple[str, list[str]]] = []
        while not self.sign(")"):
            if self.now.value == "(" and self.now.kind == "sign":
                parts.append(self._grouping())
            else:
                sql = self.expression()[0]
                parts.append((sql, [sql]))
            self.sign(",")
        return f"({', '.join(sql for sql, _ in parts)})", [x for _, own in parts for x in own]

    def _list(self, one, **options) -> list:
        out = [one(**options)]
        while self.sign(","):
            out.append(one(**options))
        return out

    def _condition(self) -> str:
        self.filtering = True
        out = self.expression()[0]
        self.filtering = False
        return out

    def _opaque(self, read):
        """read() where the value of a predicate matters, not only whether it is true."""
        filtering, self.filtering = self.filtering, False
        out = read()
        self.filtering = filtering
        return out

    def _item(self):
        start = self.at
        if self.sign("*"):
            return "*", [(k, v) for k, v in self.scope.types.items() if "." not in k]
        if self.now.kind in ("word", "name"):
            name = self.take().value
            if self.sign(".") and self.sign("*"):
                return f"{name_sql(name)}.*", [(k.split(".", 1)[1], v) for k, v in self.scope.types.items() if k.startswith(name + ".")]
            self.at = start
        sql, kind = self._of_group()
        bare = self.at - start in (1, 3) and self.tokens[self.at - 1].kind in ("word", "name") and self.tokens[start].kind in ("word", "name")
        name = self.identifier() if self.word("AS") else self.identifier() if self.now.kind in ("word", "name") and self.now.value.upper() not in _RESERVED else self.tokens[self.at - 1].value if bare else "?column?"
        return f"{sql} AS {name_sql(name)}", [(name, kind)]

    def _from(self) -> str:
        self.need("FROM")
        out = f" FROM {self._source()}"
        while self.now.is_word(*_JOINS) or self.now.kind == "sign" and self.now.value == ",":
            if self.sign(","):
                out += f", {self._source()}"
                continue
            kind = "CROSS" if self.word("CROSS") else "LEFT" if self.word("LEFT") else "RIGHT" if self.word("RIGHT") else "FULL" if self.word("FULL") else "INNER" if self.word("INNER") or True else ""
            self.word("OUTER")
            self.need("JOIN")
            known = dict(self.scope.types)
            right_at = self.at
            right = self._source()
            if self.word("ON"):
                out += f" {kind if kind != 'CROSS' else 'INNER'} JOIN {right} ON {self.expression()[0]}"
            elif self.word("USING"):
                self.need("(")
                names = self._list(self.identifier)
                self.need(")")
                left = self._owner(known, names)
                alias = self._alias_at(right_at)
                out += f" {kind} JOIN {right} ON " + " AND ".join(f"{name_sql(*left[n], n)} = {name_sql(alias, n)}" for n in names)
            elif kind == "CROSS":
                out += f" CROSS JOIN {right}"
            else:
                raise SyntaxFault(f"{kind} JOIN needs ON or USING")
        return out

    @staticmethod
    def _owner(known: dict, names: list[str]) -> dict[str, list[str]]:
        return {n: [next((k.split(".")[0] for k in known if k.endswith("." + n)), "")] for n in names}

    def _alias_at(self, place: int) -> str:
        return self.aliases[place]

    aliases: dict[int, str]

    def _source(self) -> str:
        place = self.at
        if not hasattr(self, "aliases"):
            self.aliases = {}
        if self.sign("("):
            sql, columns = self.query()
            self.need(")")
            self.word("AS")
            alias = self.identifier()
            self._known(alias, columns)
            self.aliases[place] = alias
            return f"({sql}) AS {name_sql(alias)}"
        parts = [self.identifier()]
        while self.sign("."):
            parts.append(self.identifier())
        alias = parts[-1]
        if self.word("AS") or self.now.kind in ("word", "name") and self.now.value.upper() not in _RESERVED:
            alias = self.identifier()
        self.aliases[place] = alias
        if len(parts) == 1 and parts[0] in self.ctes:
            self._known(alias, self.ctes[parts[0]])
            return f"{name_sql(*parts)} AS {name_sql(alias)}"
        schema = self.schema_of(parts)
        if schema is not None:
            self._known(alias, [(n, tag_of(t)) for n, t in schema])
        return f"{name_sql(*self.relation_of(parts))} AS {name_sql(alias)}"

    def _known(self, alias: str, columns: list[tuple[str, str | None]]) -> None:
        for name, kind in columns:
            self.scope.types.setdefault(name, kind)
            self.scope.types[f"{alias}.{name}"] = kind

    def _order_by(self) -> str:
        self.need("BY")
        return f" ORDER BY {', '.join(self._list(self._order_item))}"

    def _of_group(self):
        """An expression; one that is a GROUP BY key as a whole stands for the key."""
        keys, at = self.scope.group_keys, self.at
        if keys:
            self.scope.group_keys = None
            sql, kind = self.expression()
            self.scope.group_keys = keys
            if sql in keys and not (self.es and kind == "text"):
                return sql, kind
            self.at = at
        return self.expression()

    def _order_item(self) -> str:
        sql, kind = self._of_group()
        if self.es and kind == "text":
            sql = fold_sql(sql)
        down = self.word("DESC")
        if not down:
            self.word("ASC")
        nulls = "FIRST" if down else "LAST"
        if self.word("NULLS"):
            nulls = "FIRST" if self.word("FIRST") else "LAST"
            if nulls == "LAST":
                self.need("LAST")
        return f"{sql} {'DESC' if down else 'ASC'} NULLS {nulls}"

    def _limit(self) -> str:
        out = ""
        if self.word("LIMIT"):
            out = f" LIMIT {self._row_count()}"
            if self.word("OFFSET"):
                out += f" OFFSET {self._row_count()}"
        elif self.now.is_word("OFFSET"):
            raise SyntaxFault("OFFSET needs LIMIT")
        return out

    def _row_count(self) -> str:
        t = self.take()
        if t.kind == "param":
            return "?"
        text = t.value.strip()
        if t.kind in ("number", "text") and re.fullmatch(r"\d+", text):
            return text
        raise SyntaxFault(f"a row count expected, found {t.value!r}")

    # -- expressions: (SQL, type tag)

    def expression(self) -> tuple[str, str | None]:
        left = self._and()
        while self.word("OR"):
            left = (f"({left[0]} OR {self._and()[0]})", "bool")
        return left

    def _and(self):
        left = self._not()
        while self.word("AND"):
            left = (f"({left[0]} AND {self._not()[0]})", "bool")
        return left

    def _not(self):
        if self.word("NOT"):
            return f"(NOT {self._opaque(self._not)[0]})", "bool"
        return self._is_null()

    def _is_null(self):
        left = self._predicate()
        while self.word("IS"):
            negated = self.word("NOT")
            self.need("NULL")
            left = (f"({left[0]} IS {'NOT ' if negated else ''}NULL)", "bool")
        return left

    def _alike(self, a, b):
        """Both sides of a comparison: Booleans against numbers as 0 and 1, texts folded under es."""
        number = ("int", "real", "decimal")
        if a[1] == "bool" and b[1] in number:
            a = (f"cast({a[0]} AS int)", "int")
        elif b[1] == "bool" and a[1] in number:
            b = (f"cast({b[0]} AS int)", "int")
        if self.es and a[1] == "text" and b[1] == "text":
            return (fold_sql(a[0]), "text"), (fold_sql(b[0]), "text")
        return a, b

    def _predicate(self):
        left = self._sum()
        while True:
            t = self.now
            if t.kind == "sign" and t.value in ("=", "<>", "!=", "<", "<=", ">", ">="):
                self.take()
                a, b = self._alike(left, self._sum())
                left = (f"({a[0]} {'<>' if t.value == '!=' else t.value} {b[0]})", "bool")
                continue
            negated = self.now.is_word("NOT") and self.tokens[self.at + 1].is_word("BETWEEN", "LIKE", "IN")
            if negated:
                self.take()
            no = "NOT " if negated else ""
            if self.word("BETWEEN"):
                low = self._sum()
                self.need("AND")
                high = self._sum()
                (a, lo), (b, hi) = self._alike(left, low), self._alike(left, high)
                left = (f"({no}({a[0]} >= {lo[0]} AND {b[0]} <= {hi[0]}))", "bool")
            elif self.word("LIKE"):
                left = (f"({no}{self._like(left)})", "bool")
            elif self.word("IN"):
                left = (f"({self._in(left, no)})", "bool")
            else:
                return left

    def _like(self, left) -> str:
        at = self.at
        pattern = self._sum()
        plain = self.tokens[at].value if self.at == at + 1 and self.tokens[at].kind == "text" else None
        escape = self.take().value if self.word("ESCAPE") else None
        if plain is not None and escape:
            plain = re.sub(re.escape(escape) + "(.)", lambda m: "\\" + m[1], plain.replace("\\", "\\\\"))
        elif plain is not None:
            plain = plain.replace("\\", "\\\\")
        right = quoted(plain) if plain is not None else f"replace({pattern[0]}, '\\\\', '\\\\\\\\')"
        return f"{fold_sql(left[0])} LIKE {fold_sql(right)}" if self.es else f"{left[0]} LIKE {right}"

    def _in(self, left, no: str) -> str:
        self.need("(")
        if self.at_query():
            outer_names = self.outer_names
            sql, columns = self.query()
            self.need(")")
            if len(columns) == 1 and (self.es and left[1] == "text" or no and self.filtering and self.outer_names == outer_names):
                value, column = left[0], name_sql(columns[0][0])
                if self.es and left[1] == "text":
                    value, column = fold_sql(value), fold_sql(column)
                inner = f"(SELECT {column} AS `__v` FROM ({sql}))"
                if no and self.filtering and self.outer_names == outer_names:
                    # an ordinary anti join and two tests of the subquery alone; Spark's null-aware anti join broadcasts it whole
                    some = f"EXISTS (SELECT 1 FROM {inner} AS `__s`"
                    return f"NOT {some} WHERE `__s`.`__v` = {value}) AND ({value} IS NOT NULL AND NOT {some} WHERE `__s`.`__v` IS NULL) OR NOT {some}))"
                return f"{value} {no}IN {inner}"
            return f"{left[0]} {no}IN ({sql})"
        items = self._list(self.expression)
        self.need(")")
        pairs = [self._alike(left, i) for i in items]
        if len({a[0] for a, _ in pairs}) > 1:
            tests = " OR ".join(f"{a[0]} = {b[0]}" for a, b in pairs)
            return f"{'NOT ' if no else ''}({tests})"
        return f"{pairs[0][0][0]} {no}IN ({', '.join(b[0] for _, b in pairs)})"

    def _sum(self):
        left = self._product()
        while self.now.kind == "sign" and self.now.value in ("+", "-", "||"):
            op = self.take().value
            right = self._product()
            kind = "text" if op == "||" else self._wider(left[1], right[1])
            left = (f"({left[0]} {op} {right[0]})", kind)
        return left

    @staticmethod
    def _wider(a, b):
        for kind in ("real", "decimal"):
            if kind in (a, b):
                return kind
        return "int" if a == b == "int" else None

    def _product(self):
        left = self._unary()
        while self.now.kind == "sign" and self.now.value in ("*", "/", "%"):
            op = self.take().value
            right = self._unary()
            kind = self._wider(left[1], right[1])
            if op == "/" and kind == "int":
                wide = "int" if "bigint" not in (left[0] + right[0]) and self._narrow(left) and self._narrow(right) else "bigint"
                left = (f"({left[0]} div {right[0]})" if wide == "bigint" else f"cast({left[0]} div {right[0]} AS int)", "int")
            elif op == "/" and kind == "real":
                a, b = f"cast({left[0]} AS double)", f"cast({right[0]} AS double)"
                zero = f"CASE WHEN {a} = 0D OR isnan({a}) THEN double('NaN') WHEN {a} > 0D THEN double('Infinity') ELSE double('-Infinity') END"
                left = (f"CASE WHEN {b} = 0D THEN CASE WHEN {a} IS NOT NULL THEN {zero} END ELSE {a} / nullif({b}, 0D) END", "real")
            else:
                left = (f"({left[0]} {op} {right[0]})", kind)
        return left

    @staticmethod
    def _narrow(side) -> bool:
        return bool(re.fullmatch(r"-?\d{1,9}", side[0]))

    def _unary(self):
        if self.sign("-"):
            if self.now.kind == "number" and re.fullmatch(r"\d+", self.now.value):
                return f"-{self.take().value}", "int"
            inner = self._unary()
            return f"(-{inner[0]})", inner[1]
        if self.sign("+"):
            return self._unary()
        return self._primary()

    def _primary(self):
        t = self.now
        if t.kind == "number":
            self.take()
            return (t.value, "int") if t.value.isdigit() else (t.value + "D", "real")
        if t.kind == "text":
            return quoted(self.take().value), "text"
        if t.kind == "param":
            self.take()
            return "?", None
        if self.sign("("):
            if self.at_query():
                sql, columns = self.query()
                self.need(")")
                return f"({sql})", columns[0][1] if len(columns) == 1 else None
            at = self.at
            inner = self.expression()
            self.need(")")
            if self.filtering and (self.now.kind == "sign" and self.now.value not in (")", ";", ",") or self.now.is_word("IS", "IN", "NOT", "LIKE", "BETWEEN")):
                self.at = at  # its value is an operand
                inner = self._opaque(self.expression)
                self.need(")")
            return f"({inner[0]})", inner[1]
        if t.kind == "word":
            upper, following = t.value.upper(), self.tokens[self.at + 1]
            if upper in ("NULL", "TRUE", "FALSE"):
                self.take()
                return upper, None if upper == "NULL" else "bool"
            if upper == "CASE":
                return self._case()
            if upper == "EXISTS" and following.value == "(":
                self.at += 2
                sql = self.query()[0]
                self.need(")")
                return f"EXISTS ({sql})", "bool"
            if following.kind == "sign" and following.value == "(":
                return self._call()
            if upper in ("CURRENT_TIMESTAMP", "CURRENT_DATE") and t.value not in self.scope.types:
                self.take()
                return sql_of(upper, [])
            if upper == "INTERVAL" and following.kind in ("number", "text"):
                self.take()
                amount = quoted(following.value) if following.kind == "text" else following.value
                self.take()
                return f"INTERVAL {amount} {self.take().value}", None
            if upper in ("DATE", "TIMESTAMP") and following.kind == "text":
                self.at += 2
                return f"{'DATE' if upper == 'DATE' else 'TIMESTAMP_NTZ'} {quoted(following.value)}", "date" if upper == "DATE" else "ts"
            if upper in ("INTERVAL", "VALUES"):
                raise Unsupported(upper)
        if t.kind == "sign" and t.value == "@":
            return self._variable()
        return self._column()

    def _variable(self):
        """@@name, @@session.name, @@global.name."""
        self.need("@")
        self.need("@")
        name = self.take().value.lower()
        while self.sign("."):
            name = self.take().value.lower()
        if "@@" + name not in self.constants:
            raise SyntaxFault(f"unknown variable {name}")
        sql = self.constants["@@" + name]
        return sql, "text" if sql.startswith("'") else "int"

    def _column(self):
        parts = [self.identifier()]
        while self.sign("."):
            parts.append(self.identifier())
        kind, own = self.scope.find(".".join(parts[-2:]))
        self.outer_names += not own
        sql = name_sql(*parts[-2:])
        scope = self.scope
        if own and scope.group_keys is not None and not scope.in_aggregate:
            short = {k.split(".")[-1] for k in scope.group_keys}
            if sql in scope.group_keys or name_sql(parts[-1]) in short:
                return (f"min({sql})", kind) if self.es and kind == "text" else (sql, kind)
            if ".".join(parts) in scope.types:
                return f"first({sql})", kind
        return sql, kind

    def _case(self):
        return self._opaque(self._case_inside)

    def _case_inside(self):
        self.take()
        subject = None if self.now.is_word("WHEN") else self.expression()
        out, kind = "CASE", None
        while self.word("WHEN"):
            test = self.expression()
            if subject:
                a, b = self._alike(subject, test)
                test = (f"{a[0]} = {b[0]}", "bool")
            self.need("THEN")
            value = self.expression()
            kind = kind or value[1]
            out += f" WHEN {test[0]} THEN {value[0]}"
        if self.word("ELSE"):
            value = self.expression()
            kind = kind or value[1]
            out += f" ELSE {value[0]}"
        self.need("END")
        return out + " END", kind

    def _cast(self):
        value = self.expression()
        self.need("AS")
        sql, kind = self.type_name()
        self.need(")")
        return f"cast({value[0]} AS {sql})", kind

    def type_name(self) -> tuple[str, str]:
        name = self.take().value.upper()
        if name not in TYPES:
            raise SyntaxFault(f"unknown type {name}")
        self.word("PRECISION")
        sizes = []
        if self.sign("("):
            sizes = self._list(lambda: self.take().value)
            self.need(")")
        sql, kind = TYPES[name]
        if kind == "decimal":
            sql = f"decimal({', '.join([*sizes, '0'][:2])})" if sizes else "decimal(38, 10)"
        return sql, kind

    def _call(self):
        return self._opaque(self._call_inside)

    def _call_inside(self):
        name = self.take().value
        sql, kind = self._call_of(name.lower(), name)
        if self.now.is_word("FILTER"):
            self.take()
            self.need("(")
            self.need("WHERE")
            self.scope.in_aggregate += 1
            sql += f" FILTER (WHERE {self.expression()[0]})"
            self.scope.in_aggregate -= 1
            self.need(")")
        if self.now.is_word("OVER"):
            self.take()
            return f"{sql} OVER ({self._window()})", kind
        return sql, kind

    def _window(self) -> str:
        """PARTITION BY, ORDER BY with the dialect's NULL order, and a frame as it stands."""
        self.need("(")
        parts = []
        if self.now.is_word("PARTITION"):
            self.take()
            self.need("BY")
            parts.append(f"PARTITION BY {', '.join(self._list(lambda: self._folded(self.expression())))}")
        if self.word("ORDER"):
            parts.append(self._order_by().strip())
        if self.now.is_word("ROWS", "RANGE"):
            while not (self.now.kind == "sign" and self.now.value == ")"):
                if self.now.kind == "end":
                    raise SyntaxFault("unclosed window")
                parts.append(self.take().value)
        self.need(")")
        return " ".join(parts)

    def _folded(self, value) -> str:
        return fold_sql(value[0]) if self.es and value[1] == "text" else value[0]

    def _call_of(self, name: str, written: str):
        self.need("(")
        if name in self.constants and self.now.value == ")" and self.sign(")"):
            return self.constants[name], "int"
        if name == "cast":
            return self._cast()
        if name in ("group_concat", "string_agg"):
            return self._group_concat(name)
        if name in _AGGREGATES:
            return self._aggregate(name)
        if name in ("extract", "trim", "position", "substring") and self._keyword_call():
            return self._passed(name)
        args = [] if self.sign(")") else self._list(self.expression)
        if args:
            self.need(")")
        if name in NAMES:
            return sql_of(name, [a[0] for a in args], [a[1] for a in args])
        if self.now.is_word("WITHIN"):
            raise Unsupported("WITHIN GROUP")
        return f"{written}({', '.join(a[0] for a in args)})", {"row_number": "int", "rank": "int", "dense_rank": "int", "ntile": "int"}.get(name) or (args[0][1] if args and name in ("lag", "lead", "first_value", "last_value", "nth_value", "greatest", "least", "any_value", "first", "last") else None)

    def _keyword_call(self) -> bool:
        depth, k = 0, self.at
        while self.tokens[k].kind != "end" and depth >= 0:
            t = self.tokens[k]
            if t.kind == "sign" and t.value in "()":
                depth += 1 if t.value == "(" else -1
            elif not depth and (t.is_word("FROM", "IN") or t.is_word("BOTH", "LEADING", "TRAILING")):
                return True
            k += 1
        return False

    def _passed(self, name: str):
        """Keyword forms of calls, which Spark reads alike."""
        depth, parts = 0, []
        while depth >= 0:
            t = self.take()
            if t.kind == "end":
                raise SyntaxFault("unclosed call")
            depth += {"(": 1, ")": -1}.get(t.value, 0) if t.kind == "sign" else 0
            if depth >= 0:
                parts.append(quoted(t.value) if t.kind == "text" else name_sql(t.value) if t.kind == "name" else t.value)
        return f"{name}({' '.join(parts)})", "int" if name in ("extract", "position") else "text"

    def _aggregate(self, name: str):
        self.scope.in_aggregate += 1
        distinct = self.word("DISTINCT")
        if name == "count" and self.sign("*"):
            arg = ("*", None)
        else:
            arg = self.expression()
        self.scope.in_aggregate -= 1
        self.need(")")
        if name == "avg":
            return f"avg({'DISTINCT ' if distinct else ''}cast({arg[0]} AS double))", "real"
        inner = fold_sql(arg[0]) if self.es and distinct and arg[1] == "text" else arg[0]
        return f"{name}({'DISTINCT ' if distinct else ''}{inner})", "int" if name == "count" else arg[1]

    def _group_concat(self, name: str):
        self.scope.in_aggregate += 1
        distinct = self.word("DISTINCT")
        value = self.expression()
        separator, order = ",", []
        if self.sign(","):
            separator = self.take().value
        if self.word("ORDER"):
            self.need("BY")
            order = self._list(self._order_item)
        if self.word("SEPARATOR"):
            separator = self.take().value
        self.scope.in_aggregate -= 1
        self.need(")")
        text = f"cast(cast({value[0]} AS int) AS string)" if value[1] == "bool" else f"cast({value[0]} AS string)"
        if distinct and order and any(not o.startswith(value[0] + " ") for o in order):
            out = self._distinct_in_order(value[0], text, order, separator)
        else:
            if distinct and order:
                order = [text + o[len(value[0]) :] for o in order]
            within = f" WITHIN GROUP (ORDER BY {', '.join(order)})" if order else ""
            out = f"listagg({'DISTINCT ' if distinct else ''}{text}, {quoted(separator)}){within}"
        # the result has at most _GROUP_CONCAT_BYTES bytes; a character that is cut in two goes
        cut = f"rtrim('\ufffd', make_valid_utf8(cast(substring(cast({out} AS binary), 1, {_GROUP_CONCAT_BYTES}) AS string)))"
        return f"CASE WHEN octet_length({out}) > {_GROUP_CONCAT_BYTES} THEN {cut} ELSE {out} END", "text"

    @staticmethod
    def _distinct_in_order(value: str, text: str, order: list[str], separator: str) -> str:
        """DISTINCT in the order of other keys: sort by all keys, then keep the first place of each text."""
        keys, test = [], "0"
        for i, o in reversed(list(enumerate(order))):
            key, down, nulls_last = re.fullmatch(r"(.*) (ASC|DESC) NULLS (FIRST|LAST)", o, re.S).groups()
            keys.insert(0, f"'k{i}', {key}")
            a, b = f"x.k{i}", f"y.k{i}"
            last = 1 if nulls_last == "LAST" else -1
            less = 1 if down == "DESC" else -1
            test = f"CASE WHEN {a} IS NULL AND {b} IS NULL THEN {test} WHEN {a} IS NULL THEN {last} WHEN {b} IS NULL THEN {-last} WHEN {a} < {b} THEN {less} WHEN {a} > {b} THEN {-less} ELSE {test} END"
        rows = f"array_agg(named_struct({', '.join(keys)}, 'v', {text})) FILTER (WHERE {value} IS NOT NULL)"
        texts = f"array_distinct(transform(array_sort({rows}, (x, y) -> {test}), x -> x.v))"
        return f"CASE WHEN count({value}) > 0 THEN array_join({texts}, {quoted(separator)}) END"


def rewrite(sql: str, schema_of=lambda parts: None, collation: str = "binary", constants: dict[str, str] | None = None) -> str:
    """A query of the dialect as Spark SQL."""
    return Rewriter(sql, schema_of, collation, constants).statement()
