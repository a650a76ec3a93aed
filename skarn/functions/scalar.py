"""The dialect's scalar functions as Spark SQL of their arguments' SQL.

Every function is an expression of Spark's own functions; `call` gives a Column, the dialect layer uses the SQL.
Argument and result types are tags: int, real, text, bool, date, ts, bytes, or None where unknown.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


class FunctionError(ValueError):
    """An unknown function, or arguments that it doesn't take."""


def quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def literal_of(sql: str) -> str | None:
    """The text of a string literal as `quoted` writes it; None for other expressions."""
    if len(sql) < 2 or sql[0] != "'" or sql[-1] != "'" or re.search(r"(?<!\\)(\\\\)*'", sql[1:-1]):
        return None
    return re.sub(r"\\(.)", r"\1", sql[1:-1])


#: The date specifiers of the dialect and the patterns of Spark's formatter that print the same.
_PATTERNS = {
    "Y": "yyyy", "y": "yy", "m": "MM", "c": "M", "M": "MMMM", "b": "MMM", "d": "dd", "e": "d", "H": "HH", "h": "hh", "i": "mm", "s": "ss", "S": "ss",
    "p": "a", "W": "EEEE", "a": "EEE", "j": "DDD", "T": "HH:mm:ss", "r": "hh:mm:ss a",
}


def date_format(value: str, form: str) -> str:
    """Format a timestamp by a literal format; unknown specifiers print as they are, an empty format is NULL."""
    if not form:
        return "cast(NULL AS string)"
    parts, text, k = [], "", 0
    while k < len(form):
        c, spec = form[k], form[k + 1 : k + 2]
        if c != "%" or not spec:
            text += c
            k += 1
            continue
        k += 2
        if spec == "%":
            text += "%"
        elif spec in _PATTERNS or spec == "w":
            if text:
                parts.append(quoted(text))
                text = ""
            parts.append(f"cast(dayofweek({value}) - 1 AS string)" if spec == "w" else f"date_format({value}, '{_PATTERNS[spec]}')")
        else:
            text += "%" + spec
    if text:
        parts.append(quoted(text))
    return f"CASE WHEN {value} IS NOT NULL THEN concat({', '.join(parts)}) END"


_FIELDS = {"Y": ("year", r"(\\d{4})"), "y": ("year2", r"(\\d{1,2})"), "m": ("month", r"(\\d{1,2})"), "c": ("month", r"(\\d{1,2})"), "d": ("day", r"(\\d{1,2})"), "e": ("day", r"(\\d{1,2})"), "H": ("hour", r"(\\d{1,2})"), "h": ("hour", r"(\\d{1,2})"), "i": ("minute", r"(\\d{1,2})"), "s": ("second", r"(\\d{1,2})"), "S": ("second", r"(\\d{1,2})")}


def str_to_date(value: str, form: str) -> tuple[str, str]:
    """Parse by a literal format: SQL and type. A date without time fields, else a timestamp; NULL on any failure."""
    pattern, fields, groups, k = "^", {}, 0, 0
    while k < len(form):
        c, spec = form[k], form[k + 1 : k + 2]
        if c == "%" and spec:
            k += 2
            if spec in _FIELDS:
                name, part = _FIELDS[spec]
                pattern += part
                groups += 1
                fields[name] = groups
            else:
                pattern += "\\\\%" if spec == "%" else "."
        else:
            pattern += re.sub(r"([^\w\s])", r"\\\\\1", c).replace("'", "\\'") if c != "\\" else "\\\\\\\\"
            k += 1
    get = lambda name, default: f"cast(nullif(regexp_extract({value}, '{pattern}', {fields[name]}), '') AS int)" if name in fields else default
    year = get("year", "1970")
    if "year2" in fields:
        short = get("year2", "0")
        year = f"({short} + CASE WHEN {short} < 70 THEN 2000 ELSE 1900 END)"
    month, day = get("month", "1"), get("day", "1")
    timed = any(f in fields for f in ("hour", "minute", "second"))
    made = f"try_make_timestamp_ntz({year}, {month}, {day}, {get('hour', '0')}, {get('minute', '0')}, {get('second', '0')})"
    whole = f"CASE WHEN {value} RLIKE '{pattern}' THEN {made} END"
    return (whole, "ts") if timed else (f"cast({whole} AS date)", "date")


def _substr(s: str, start: str, length: str | None = None) -> str:
    if length is None:
        return f"CASE WHEN {start} < 0 THEN '' ELSE substring({s}, {start}) END"
    return f"CASE WHEN {start} < 0 OR {length} < 0 THEN '' ELSE substring({s}, CASE WHEN {start} = 0 THEN 1 ELSE {start} END, {length}) END"


def _replace(s: str, old: str, new: str) -> str:
    spread = f"CASE WHEN {s} = '' THEN {new} ELSE concat({new}, array_join(split({s}, ''), {new}), {new}) END"
    return f"CASE WHEN {old} = '' THEN {spread} ELSE replace({s}, {old}, {new}) END"


def _char(n: str) -> str:
    return f"CASE WHEN {n} BETWEEN 0 AND 55295 OR {n} BETWEEN 57344 AND 1114111 THEN decode(unhex(lpad(hex({n}), 8, '0')), 'UTF-32') WHEN {n} IS NOT NULL THEN '' END"


def _round(types, x, digits="0"):
    if types and types[0] == "int":
        return x
    return f"(signum({x}) * floor(abs({x}) * pow(10D, greatest({digits}, 0)) + 0.5D) / pow(10D, greatest({digits}, 0)))"


_NAMES = "CASE typeof({0}) WHEN 'int' THEN 'Int' WHEN 'bigint' THEN 'BigInt' WHEN 'double' THEN 'Real' WHEN 'string' THEN 'Text' WHEN 'boolean' THEN 'Bool' WHEN 'binary' THEN 'Bytes' WHEN 'date' THEN 'Date' WHEN 'timestamp_ntz' THEN 'Timestamp' WHEN 'timestamp' THEN 'Timestamp' ELSE CASE WHEN typeof({0}) LIKE 'decimal%' THEN 'Decimal' ELSE typeof({0}) END END"
_UUID7 = "regexp_replace(concat(lpad(lower(hex(unix_millis(current_timestamp()))), 12, '0'), '7', substr({0}, 16, 3), substr({0}, 20, 4), substr({0}, 25, 12)), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})', '$1-$2-$3-$4-')"
_HEX_TEXT = "regexp_replace({0}, '^(0x|\\\\\\\\x)', '')"
_SPACE = "(?U)^\\\\s+|\\\\s+$"


def _same(name: str, result: str | None = None) -> tuple[Callable, str | None]:
    return (lambda types, *a: f"{name}({', '.join(a)})"), result


def _form(template: str, result: str | None = None) -> tuple[Callable, str | None]:
    return (lambda types, *a: template.format(*a)), result


#: name -> (SQL of (types, *argument SQL), result type; "=" means the first argument's).
_TABLE: dict[str, tuple[Callable, str | None]] = {
    "length": _same("length", "int"), "octet_length": _same("octet_length", "int"), "upper": _same("upper", "text"), "lower": _same("lower", "text"),
    "trim": _form(f"regexp_replace({{0}}, '{_SPACE}', '')", "text"), "ltrim": _form("regexp_replace({0}, '(?U)^\\\\s+', '')", "text"), "rtrim": _form("regexp_replace({0}, '(?U)\\\\s+$', '')", "text"),
    "substr": ((lambda types, *a: _substr(*a)), "text"),
    "concat": ((lambda types, *a: f"concat_ws('', {', '.join(f'cast({x} AS string)' for x in a)})" if a else "''"), "text"),
    "concat_ws": ((lambda types, sep, *a: f"concat_ws({', '.join([sep, *(f'cast({x} AS string)' for x in a)])})"), "text"),
    "repeat": _same("repeat", "text"), "replace": ((lambda types, *a: _replace(*a)), "text"), "reverse": _same("reverse", "text"),
    "left": _form("CASE WHEN coalesce({1}, 0) <= 0 THEN '' ELSE left({0}, {1}) END", "text"), "right": _form("CASE WHEN coalesce({1}, 0) <= 0 THEN '' ELSE right({0}, {1}) END", "text"),
    "lpad": _same("lpad", "text"), "rpad": _same("rpad", "text"),
    "locate": _form("coalesce(locate({0}, {1}), 0)", "int"), "instr": _form("coalesce(instr({0}, {1}), 0)", "int"),
    "ascii": _same("ascii", "int"), "char": ((lambda types, n: _char(n)), "text"), "space": _form("coalesce(space({0}), '')", "text"),
    "strcmp": _form("CASE WHEN {0} < {1} THEN -1 WHEN {0} > {1} THEN 1 WHEN {0} = {1} THEN 0 END", "int"),
    "abs": _same("abs", "="), "ceil": _form("cast(ceil({0}) AS double)", "real"), "floor": _form("cast(floor({0}) AS double)", "real"),
    "round": (_round, "="), "pow": _form("pow(try_cast({0} AS double), try_cast({1} AS double))", "real"), "sqrt": _form("sqrt({0})", "real"),
    "mod": _form("({0} % {1})", "="), "sign": ((lambda types, x: f"cast(signum({x}) AS int)" if types and types[0] == "int" else f"signum({x})"), "="),
    "coalesce": _same("coalesce", "="), "nullif": _same("nullif", "="), "isnull": ((lambda types, *a: f"({a[0]} IS NULL)" if a else "TRUE"), "bool"),
    "if": _form("if(coalesce({0}, FALSE), {1}, {2})", None), "typeof": _form("CASE WHEN {0} IS NULL THEN 'NULL' ELSE " + _NAMES + " END", "text"),
    "to_char": _form("cast({0} AS string)", "text"),
    "now": _form("cast(current_timestamp() AS timestamp_ntz)", "ts"), "current_date": _form("current_date()", "date"), "unix_timestamp": _form("unix_timestamp()", "int"),
    "year": _same("year", "int"), "month": _same("month", "int"), "day": _same("day", "int"), "hour": _same("hour", "int"), "minute": _same("minute", "int"), "second": _same("second", "int"),
    "datediff": _same("datediff", "int"), "find_in_set": _form("find_in_set(lower({0}), lower({1}))", "int"),
    "from_base64": _form("try_to_binary({0}, 'base64')", "bytes"), "to_base64": _form("base64(cast({0} AS binary))", "text"),
    "gen_random_uuid": _form("uuid()", "text"), "uuid_generate_v7": ((lambda types: _UUID7.format("uuid()")), "text"),
    "is_valid_uuid": _form("(regexp_replace({0}, '-', '') RLIKE '^[0-9a-fA-F]{{32}}$')", "bool"),
    "version": _form("version()", "text"), "current_user": _form("current_user()", "text"), "current_database": _form("current_database()", "text"), "current_schema": _form("current_database()", "text"),
    "connection_id": _form("cast(1 AS bigint)", "int"), "row_count": _form("cast(-1 AS bigint)", "int"), "last_insert_id": _form("cast(0 AS bigint)", "int"),
}

ALIASES = {
    "char_length": "length", "character_length": "length", "len": "length", "byte_length": "octet_length", "ucase": "upper", "lcase": "lower", "substring": "substr", "mid": "substr",
    "replicate": "repeat", "position": "locate", "chr": "char", "ceiling": "ceil", "power": "pow", "ifnull": "coalesce", "nvl": "coalesce", "iff": "if", "pg_typeof": "typeof",
    "str": "to_char", "tostring": "to_char", "current_timestamp": "now", "getdate": "now", "sysdate": "now", "curdate": "current_date", "today": "current_date",
    "uuid_generate_v4": "gen_random_uuid", "random_uuid": "gen_random_uuid", "newid": "gen_random_uuid", "uuid7": "uuid_generate_v7", "is_uuid": "is_valid_uuid",
    "user": "current_user", "session_user": "current_user", "system_user": "current_user", "database": "current_database", "schema": "current_schema", "lastval": "last_insert_id",
}
NAMES = frozenset(_TABLE) | frozenset(ALIASES) | {"date_format", "str_to_date", "encode", "decode"}


def sql_of(name: str, args: list[str], types: list[str | None] | None = None) -> tuple[str, str | None]:
    """Spark SQL and type of a call; names are case-insensitive."""
    name = name.lower()
    name = ALIASES.get(name, name)
    types = types or []
    try:
        if name in ("date_format", "str_to_date", "encode", "decode"):
            form = literal_of(args[1])
            if form is None:
                raise FunctionError(f"{name} needs a literal second argument")
            if name == "date_format":
                value = args[0] if not types or types[0] != "text" else f"coalesce(try_to_timestamp({args[0]}, 'yyyy-MM-dd HH:mm:ss'), try_to_timestamp({args[0]}, 'yyyy-MM-dd'))"
                return date_format(value, form), "text"
            if name == "str_to_date":
                return str_to_date(args[0], form)
            if form.lower() not in ("base64", "hex"):
                raise FunctionError(f"{name} knows base64 and hex")
            if name == "encode":
                return (f"base64(cast({args[0]} AS binary))" if form.lower() == "base64" else f"lower(hex(cast({args[0]} AS binary)))"), "text"
            return (f"try_to_binary({args[0]}, 'base64')" if form.lower() == "base64" else f"unhex({_HEX_TEXT.format(args[0])})"), "bytes"
        make, result = _TABLE[name]
        return make(types, *args), (types[0] if types else None) if result == "=" else result
    except KeyError:
        raise FunctionError(f"unknown function {name}") from None
    except (IndexError, TypeError):
        raise FunctionError(f"{name} doesn't take {len(args)} arguments") from None


def call(name: str, *args: str) -> Column:
    """A function of argument expressions, for the DataFrame API: call("substr", "c_name", "2", "3")."""
    return F.expr(sql_of(name, list(args))[0])


def to_number_permissive(text: str, kind: str = "int") -> str:
    """SQL: the numeric prefix of a text; 0 where there is none."""
    pattern = r"^\\s*([+-]?\\d+)" if kind == "int" else r"^\\s*([+-]?(?:\\d+\\.?\\d*|\\.\\d+)(?:[eE][+-]?\\d+)?)"
    return f"coalesce(try_cast(nullif(regexp_extract({text}, '{pattern}', 1), '') AS {'bigint' if kind == 'int' else 'double'}), {'0' if kind == 'int' else '0D'})"
