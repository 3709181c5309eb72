"""The scalar functions of the dialect, each a Spark SQL expression over its arguments.

``render(name, args)`` gives SQL text; every function stays inside the JVM. Times of the date functions are epoch
seconds, as the dialect has them; ``_time`` columns are epoch milliseconds.
"""

from __future__ import annotations

from collections.abc import Callable

Template = str | Callable[..., str]


def _number(x: str) -> str:
    return f"cast({x} AS DOUBLE)"


def _text(x: str) -> str:
    return f"cast({x} AS STRING)"


def _gcd(a: str, b: str) -> str:
    """Euclid in a fixed number of steps: 92 cover all 64-bit numbers."""
    start = f"named_struct('x', abs(cast({a} AS BIGINT)), 'y', abs(cast({b} AS BIGINT)))"
    step = "(s, i) -> IF(s.y = 0, s, named_struct('x', s.y, 'y', s.x % s.y))"
    return f"aggregate(sequence(1, 92), {start}, {step}, s -> s.x)"


def _round(x: str, p: str = "0") -> str:
    return f"(floor({_number(x)} * power(10, {p}) + 0.5) / power(10, {p}))"


#: Names of character sets without signs, and Spark's names.
_CHARSETS = {"utf8": "UTF-8", "latin1": "ISO-8859-1", "iso88591": "ISO-8859-1", "ascii": "US-ASCII", "usascii": "US-ASCII", "sqlascii": "US-ASCII", "utf16": "UTF-16"}


def _charset(name: str) -> str:
    return _case(f"regexp_replace(lower({name}), '[^a-z0-9]', '')", [(f"'{k}'", f"'{v}'") for k, v in _CHARSETS.items()]).removesuffix(" END") + " ELSE 'UTF-8' END"


def _in_charset(s: str, name: str) -> str:
    """Text that the character set can write, else null."""
    beyond = _case(_charset(name), [("'ISO-8859-1'", "'[^\\\\x00-\\\\xff]'"), ("'US-ASCII'", "'[^\\\\x00-\\\\x7f]'")]).removesuffix(" END") + " ELSE '(?!)' END"
    return f"IF({s} RLIKE {beyond}, NULL, decode(encode({s}, {_charset(name)}), {_charset(name)}))"


def _from_charset(s: str, name: str) -> str:
    return f"decode(cast({s} AS BINARY), {_charset(name)})"


def _stamp(seconds: str) -> str:
    return f"timestamp_seconds({seconds})"


_FIELDS = {
    "year": "year(%s)", "month": "month(%s)", "day": "day(%s)", "hour": "hour(%s)", "minute": "minute(%s)", "second": "second(%s)",
    "dow": "(dayofweek(%s) - 1)", "doy": "dayofyear(%s)", "quarter": "quarter(%s)", "week": "weekofyear(%s)", "epoch": "unix_seconds(%s)",
}


def _date_part(field: str, seconds: str) -> str:
    name = field.strip("'").lower()
    if name not in _FIELDS:
        raise ValueError(f"unknown date field {name}")
    return f"cast({_FIELDS[name] % _stamp(seconds)} AS DOUBLE)"


def _to_char(value: str, form: str) -> str:
    pattern = form
    for token, java in (("YYYY", "yyyy"), ("MM", "MM"), ("DD", "dd"), ("HH24", "HH"), ("HH12", "hh"), ("MI", "mm"), ("SS", "ss")):
        pattern = f"replace({pattern}, '{token}', '{java}')"
    return f"date_format({_stamp(value)}, {pattern})"


def _tries(function: str, text: str, form: str | None, patterns: list[str]) -> str:
    if form:
        pattern = form
        for token, java in (("YYYY", "yyyy"), ("DD", "dd"), ("HH24", "HH"), ("MI", "mm"), ("SS", "ss")):
            pattern = f"replace({pattern}, '{token}', '{java}')"
        return f"{function}({text}, {pattern})"
    return "coalesce(" + ", ".join(f"{function}({text}, '{p}')" for p in patterns) + ")"


def _age(a: str, b: str) -> str:
    d = f"abs({b} - {a})"
    return f"concat(cast(floor({d} / 86400) AS BIGINT), ' days ', lpad(cast(floor({d} % 86400 / 3600) AS BIGINT), 2, '0'), ':', lpad(cast(floor({d} % 3600 / 60) AS BIGINT), 2, '0'), ':', lpad(cast(floor({d} % 60) AS BIGINT), 2, '0'))"


def vector(x: str) -> str:
    """A vector as ARRAY<DOUBLE> from an array or from text such as '[1, 2]', '1,2' or '(1 2)'."""
    return f"transform(filter(split(regexp_replace(array_join(cast(array({x}) AS ARRAY<STRING>), ','), '[\\\\[\\\\]()]', ' '), '[\\\\s,]+'), v -> v <> ''), v -> try_cast(v AS DOUBLE))"


def dot(a: str, b: str) -> str:
    return f"aggregate(zip_with({a}, {b}, (x, y) -> cast(x AS DOUBLE) * cast(y AS DOUBLE)), cast(0 AS DOUBLE), (s, v) -> s + v)"


def l2(a: str, b: str) -> str:
    return f"sqrt(aggregate(zip_with({a}, {b}, (x, y) -> (cast(x AS DOUBLE) - cast(y AS DOUBLE)) * (cast(x AS DOUBLE) - cast(y AS DOUBLE))), cast(0 AS DOUBLE), (s, v) -> s + v))"


def cosine(a: str, b: str) -> str:
    return f"try_divide({dot(a, b)}, sqrt({dot(a, a)}) * sqrt({dot(b, b)}))"


def _bit_of(s: str, offset: str) -> str:
    byte = f"cast(conv(hex(substring(cast({s} AS BINARY), cast(floor({offset} / 8) AS INT) + 1, 1)), 16, 10) AS INT)"
    return f"(shiftright({byte}, 7 - cast({offset} AS INT) % 8) & 1)"


def _byte_of(s: str, offset: str) -> str:
    return f"cast(conv(hex(substring(cast({s} AS BINARY), {offset} + 1, 1)), 16, 10) AS INT)"


def _with_byte(s: str, offset: str, value: str) -> str:
    raw = f"cast({s} AS BINARY)"
    return f"cast(concat(substring({raw}, 1, {offset}), unhex(lpad(hex(cast({value} AS INT)), 2, '0')), substring({raw}, {offset} + 2, 2147483647)) AS STRING)"


def _with_bit(s: str, offset: str, value: str) -> str:
    mask = f"shiftleft(1, 7 - cast({offset} AS INT) % 8)"
    at = f"cast(floor({offset} / 8) AS INT)"
    byte = _byte_of(s, at)
    return _with_byte(s, at, f"IF({value} = 1, {byte} | {mask}, {byte} & ~{mask})")


def _format(form: str, *args: str) -> str:
    java = f"replace(replace(replace({form}, '%I', '\"%s\"'), '%L', '\\'%s\\''), '%%', '%%')"
    return f"format_string({', '.join([java, *map(_text, args)])})"


def _substring(s: str, start: str, size: str | None = None) -> str:
    return f"substring({s}, {start})" if size is None else f"substring({s}, {start}, {size})"


def _regexp_replace(s: str, pattern: str, to: str, flags: str = "''") -> str:
    if "g" in flags:
        return f"regexp_replace({s}, {pattern}, {to})"
    first = f"regexp_instr({s}, {pattern})"
    found = f"regexp_substr({s}, {pattern})"
    return f"IF({first} = 0, {s}, concat(substring({s}, 1, {first} - 1), {to}, substring({s}, {first} + length({found}))))"


TYPES = {"bool": 16, "boolean": 16, "bytea": 17, "int8": 20, "bigint": 20, "int2": 21, "smallint": 21, "int4": 23, "int": 23, "integer": 23, "text": 25, "json": 114, "float4": 700, "real": 700, "float8": 701, "double precision": 701, "varchar": 1043, "date": 1082, "time": 1083, "timestamp": 1114, "timestamptz": 1184, "interval": 1186, "numeric": 1700, "uuid": 2950}


def _case(x: str, pairs: list[tuple[str, str]]) -> str:
    return f"CASE {x} " + " ".join(f"WHEN {a} THEN {b}" for a, b in pairs) + " END"


_UNARY = "abs acos acosh asin asinh atan atanh ceil cos cosh cot degrees exp floor radians sin sinh sqrt tan tanh"
FUNCTIONS: dict[str, Template] = {name: f"{name}(cast({{0}} AS DOUBLE))" for name in _UNARY.split()}
FUNCTIONS |= {
    "abs": "abs({0})",
    "acot": "atan(try_divide(1.0D, {0}))",
    "acoth": "(0.5D * ln(({0} + 1.0D) / ({0} - 1.0D)))",
    "atan2": "atan2({0}, {1})",
    "div": lambda y, x: f"cast(try_divide({_number(y)}, {_number(x)}) AS BIGINT)",
    "gcd": _gcd,
    "lcm": lambda a, b: f"coalesce(cast(try_divide(abs(cast({a} AS BIGINT) * cast({b} AS BIGINT)), {_gcd(a, b)}) AS BIGINT), 0)",
    "isfinite": lambda x: f"({x} IS NOT NULL AND NOT isnan({_number(x)}) AND abs({_number(x)}) <> double('inf'))",
    "ln": "ln({0})",
    "log": lambda b, x=None: f"log10({b})" if x is None else f"log({b}, {x})",
    "mod": lambda x, y: f"({x} - floor(try_divide({_number(x)}, {_number(y)})) * {y})",
    "pi": "pi()",
    "power": "power({0}, {1})",
    "random": "rand()",
    "round": _round,
    "setseed": lambda seed: "cast(NULL AS STRING)",
    "sign": "signum({0})",
    "trunc": "IF({0} >= 0, floor({0}), ceil({0}))",
    "width_bucket": "width_bucket({0}, {1}, {2}, {3})",
    # strings
    "ascii": "nullif(ascii({0}), 0)",
    "array_to_string": lambda a, d, n=None: f"array_join({a}, {d})" if n is None else f"array_join({a}, {d}, {n})",
    "bit_length": "bit_length({0})",
    "btrim": lambda s, c="' '": f"trim(BOTH {c} FROM {s})",
    "char_length": "char_length({0})",
    "chr": "IF({0} > 0, decode(unhex(lpad(hex(cast({0} AS BIGINT)), 8, '0')), 'UTF-32'), NULL)",
    "concat": lambda *a: f"concat_ws('', {', '.join(a)})",
    "concat_ws": lambda *a: f"concat_ws({', '.join(a)})",
    "convert": lambda s, a, b: _in_charset(s, b),
    "convert_from": _from_charset,
    "convert_to": _in_charset,
    "decode": lambda s, f: f"cast(CASE lower({f}) WHEN 'hex' THEN unhex({s}) WHEN 'base64' THEN unbase64({s}) ELSE cast({s} AS BINARY) END AS STRING)",
    "encode": lambda s, f: f"CASE lower({f}) WHEN 'hex' THEN lower(hex({s})) WHEN 'base64' THEN base64(cast({s} AS BINARY)) ELSE {s} END",
    "format": _format,
    "get_bit": _bit_of,
    "get_byte": _byte_of,
    "initcap": "initcap({0})",
    "left": "left({0}, {1})",
    "length": "length({0})",
    "lower": "lower({0})",
    "lpad": lambda s, n, f="' '": f"lpad({s}, {n}, {f})",
    "ltrim": lambda s, c=None: f"ltrim({s})" if c is None else f"trim(LEADING {c} FROM {s})",
    "md5": "md5({0})",
    "octet_length": "octet_length({0})",
    "overlay": lambda s, r, a, n="-1": f"overlay({s}, {r}, {a}, {n})",
    "position": "position({0}, {1})",
    "quote_ident": "concat('\"', replace({0}, '\"', '\"\"'), '\"')",
    "quote_literal": "concat('\\'', replace({0}, '\\'', '\\'\\''), '\\'')",
    "quote_nullable": "coalesce(concat('\\'', replace({0}, '\\'', '\\'\\''), '\\''), 'NULL')",
    "regexp_match": lambda s, p, f="''": f"nullif(regexp_extract({s}, {p}, 0), '')",
    "regexp_matches": lambda s, p, f="''": f"array_join(regexp_extract_all({s}, {p}, 0), ',')",
    "regexp_replace": _regexp_replace,
    "regexp_split_to_array": lambda s, p, f="''": f"array_join(split({s}, {p}), ',')",
    "repeat": "IF({1} < 0, NULL, repeat({0}, {1}))",
    "replace": "replace({0}, {1}, {2})",
    "reverse": "reverse({0})",
    "right": "right({0}, {1})",
    "rpad": lambda s, n, f="' '": f"rpad({s}, {n}, {f})",
    "rtrim": lambda s, c=None: f"rtrim({s})" if c is None else f"trim(TRAILING {c} FROM {s})",
    "set_bit": _with_bit,
    "set_byte": _with_byte,
    "split_part": "split_part({0}, {1}, {2})",
    "starts_with": "startswith({0}, {1})",
    "string_to_array": lambda s, d, n=None: f"array_join(split({s}, concat('\\\\Q', {d}, '\\\\E')), ',')",
    "strpos": "instr({0}, {1})",
    "substring": _substring,
    "to_ascii": "translate({0}, 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ', 'aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY')",
    "to_hex": "lower(hex(cast({0} AS BIGINT)))",
    "translate": "translate({0}, {1}, {2})",
    "trim": "trim({0})",
    "upper": "upper({0})",
    # dates
    "age": _age,
    "clock_timestamp": "unix_seconds(current_timestamp())",
    "current_date": "cast(current_date() AS STRING)",
    "current_time": "date_format(current_timestamp(), 'HH:mm:ss')",
    "current_timestamp": "unix_seconds(current_timestamp())",
    "date_part": _date_part,
    "date_trunc": lambda p, s: f"unix_seconds(date_trunc({p}, {_stamp(s)}))",
    "extract": _date_part,
    "now": "unix_seconds(current_timestamp())",
    "statement_timestamp": "unix_seconds(current_timestamp())",
    "transaction_timestamp": "unix_seconds(current_timestamp())",
    "to_char": _to_char,
    "to_date": lambda t, f=None: _tries("try_to_date", t, f, ["yyyy-MM-dd", "MM/dd/yyyy", "dd-MM-yyyy"]),
    "to_number": lambda t, f=None: f"try_cast(translate({t}, ',$€£¥ ', '') AS DOUBLE)",
    "to_timestamp": lambda t, f=None: f"unix_seconds({_tries('try_to_timestamp', t, f, ['yyyy-MM-dd HH:mm:ss', 'yyyy-MM-dd', 'yyyy/MM/dd HH:mm:ss'])})",
    # conditions
    "coalesce": lambda *a: f"coalesce({', '.join(a)})",
    "greatest": lambda *a: f"greatest({', '.join(a)})" if len(a) > 1 else a[0],
    "least": lambda *a: f"least({', '.join(a)})" if len(a) > 1 else a[0],
    "nullif": "nullif({0}, {1})",
    # vectors
    "to_vec": vector,
    "vec_ip": lambda a, b: dot(vector(a), vector(b)),
    "vec_l2": lambda a, b: l2(vector(a), vector(b)),
    "cosine_sim": lambda a, b: cosine(vector(a), vector(b)),
    # arrays
    "array_length": lambda a, d="1": f"IF({d} = 1, array_size({a}), NULL)",
    "array_at": lambda a, i: f"get({a}, IF({i} < 0, array_size({a}) + {i}, {i}))",
    "array_concat": lambda a, b: f"concat({a}, {b})",
    # session and compatibility
    "pg_client_encoding": "'UTF8'",
    "pg_get_expr": lambda e, r=None, p=None: e,
    "pg_get_partkeydef": lambda r: "cast(NULL AS STRING)",
    "pg_get_viewdef": lambda r, p=None: "cast(NULL AS STRING)",
    "pg_total_relation_size": lambda r: "cast(0 AS BIGINT)",
    "pg_typeof": lambda x: _case(f"typeof({x})", [("'bigint'", "'bigint'"), ("'int'", "'integer'"), ("'double'", "'double precision'"), ("'string'", "'text'"), ("'boolean'", "'boolean'")]).replace(" END", " ELSE typeof(" + x + ") END"),
    "format_type": lambda oid, mod=None: _case(oid, [(str(v), f"'{k}'") for v, k in {v: k for k, v in reversed(TYPES.items())}.items()]),
    "to_regtype": lambda name: _case(f"lower({name})", [(f"'{k}'", str(v)) for k, v in TYPES.items()]),
    "version": "'lodestream 0.1'",
}
ALIASES = {"pow": "power", "truncate": "trunc", "character_length": "char_length", "replicate": "repeat", "curdate": "current_date", "curtime": "current_time", "array_cat": "array_concat", "ceiling": "ceil", "substr": "substring"}
#: Names that a session answers.
SESSION = {"current_database": "database", "current_schema": "schema", "current_user": "user", "session_user": "user"}


def render(name: str, args: list[str], session: dict[str, str] | None = None) -> str | None:
    """SQL text of a call; None where the dialect has no such function."""
    name = name.lower().removeprefix("pg_catalog.")
    name = ALIASES.get(name, name)
    if name in SESSION:
        return "'" + (session or {}).get(SESSION[name], "main") + "'"
    template = FUNCTIONS.get(name)
    if template is None:
        return None
    if callable(template):
        return template(*args)
    try:
        return template.format(*args)
    except IndexError:
        raise ValueError(f"{name} wants more than {len(args)} arguments") from None


#: Fixed-length date units in milliseconds.
UNITS = {"millisecond": 1, "second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000, "week": 604_800_000, "month": 30 * 86_400_000, "year": 365 * 86_400_000}


def datepart(part: str, ms: str) -> str:
    part = part.lower()
    if part in ("second", "millisecond"):
        return f"cast(({ms}) div {UNITS[part]} AS DOUBLE)"
    return f"cast({_FIELDS[part] % f'timestamp_millis({ms})'} AS DOUBLE)"


def dateadd(part: str, n: str, ms: str) -> str:
    return f"cast({ms} + {n} * {UNITS[part.lower()]} AS BIGINT)"


def datediff(part: str, a: str, b: str) -> str:
    return f"(cast({a} - {b} AS BIGINT) div {UNITS[part.lower()]})"


def plain_number(x: str) -> str:
    """Text of a number, whole ones without a fraction."""
    return f"IF({x} = floor({x}) AND abs({x}) < 1e15, cast(cast({x} AS BIGINT) AS STRING), cast({x} AS STRING))"


def string_slice(s: str, start: str | None, stop: str | None, step: str | None) -> str:
    """Python's s[start:stop:step] on code points."""
    n = f"length({s})"

    def bound(x: str, low: str, high: str) -> str:
        return f"greatest({low}, least({high}, IF({x} < 0, {n} + {x}, {x})))"

    if step is None or step == "1":
        a = bound(start, "0", n) if start else "0"
        b = bound(stop, "0", n) if stop else n
        return f"substring({s}, {a} + 1, greatest(0, {b} - {a}))"
    if step == "0":
        return "''"
    if step.startswith("-"):
        a = bound(start, "-1", f"{n} - 1") if start else f"{n} - 1"
        b = bound(stop, "-1", f"{n} - 1") if stop else "-1"
        some = f"{a} > {b}"
        last = f"({b} + 1)"
    else:
        a = bound(start, "0", n) if start else "0"
        b = bound(stop, "0", n) if stop else n
        some = f"{a} < {b}"
        last = f"({b} - 1)"
    return f"IF({some}, array_join(transform(sequence({a}, {last}, {step}), i -> substring({s}, i + 1, 1)), ''), '')"
