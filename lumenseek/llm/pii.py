"""Format-preserving pseudonyms for personal data and secrets, in DataFrame functions only.

Validated values (card numbers by their check digit, IBANs by their remainder, IPv4 addresses, dates of the calendar,
IPv6 addresses written out, phone numbers, social security numbers, e-mail addresses, keys and tokens) are replaced by a keyed permutation of all
values of the same format: an unbalanced Feistel network over the value's characters. Equal values get equal pseudonyms
in every document, different values different ones, and whoever has the key can invert it. A card number's pseudonym
has a right check digit, a date's is a date, an address's octets stay below 256; what separates digits stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Feistel rounds; each adds a keyed hash of one half to the other.
ROUNDS = 8
#: Secrets and local parts of addresses that are longer, or have other than ASCII characters, are replaced by a keyed
#: hash, which cannot be inverted.
LONG = 512
#: Days from FIRST_DAY that dates are permuted among: DATE_A * DATE_B, exactly those up to the end of 2099.
FIRST_DAY, DATE_A, DATE_B = "1900-01-01", 17, 4297

_DIGIT_END = r"(?![\d\p{L}])"
_PASSWORD_WORDS, _SECRET_WORDS = "password|passwd|pwd", r"token|secret|api[ _-]?key|access[_-]?key"
#: A separator and a quoted value without its last quote; and a value up to the next space.
_QUOTED = r"[=:]\s{0,3}(?:\x22(?!\x22|$)[^\x22\\\n]*+(?:\\.[^\x22\\\n]*+)*+(?=\x22|$)|'(?!'|$)[^'\\\n]*+(?:\\.[^'\\\n]*+)*+(?='|$))"
_BARE = r"[\x22']?[^\s\x22']\S*+"


def _secret(words: str, rest: str) -> str:
    return rf"(?<![A-Za-z])(?i:{words})[\x22']?\s{{0,3}}{rest}"


#: What stays of a secret.
_SECRET_NAME = _secret(f"{_PASSWORD_WORDS}|{_SECRET_WORDS}", r"[=:]\s{0,3}[\x22']?")
#: What stays of a token after the word bearer.
_BEARER_NAME = r"(?i:bearer)\s{1,3}"
#: What each kind looks like; the first that fits at a place counts.
PATTERNS: dict[str, str] = {
    "email": r"(?<![\p{L}\p{N}_.+-])[\p{L}\p{N}_.+-]++(?:'[\p{L}\p{N}_.+-]++)*+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    "secret": _secret(_SECRET_WORDS, f"(?:{_QUOTED}|=\\s{{0,3}}{_BARE}|:\\s{{0,3}}(?=[\\x22']?(?:\\S{{12}}|[\\p{{L}}]*+[^\\p{{L}}\\s.,;:!?)])){_BARE})") + "|" + _secret(_PASSWORD_WORDS, f"(?:{_QUOTED}|[=:]\\s{{0,3}}{_BARE})"),
    "bearer": rf"(?<![A-Za-z]){_BEARER_NAME}(?=[A-Za-z._~+/-]{{0,64}}+\d)(?=[\w.~+/-]{{16}})[\w.~+/-]++=*+",
    "access": r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "date": r"(?<![\d./-])(?:(?:19|20)\d\d-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])\.(?:0[1-9]|1[0-2])\.(?:19|20)\d\d|(?:0[1-9]|1[0-2])/(?:0[1-9]|[12]\d|3[01])/(?:19|20)\d\d)(?![\d/-])",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\d|\.\d)",
    "ip6": r"(?<![\w:.])(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}(?![\w:])",
    "phone": r"(?:(?<![\d+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?\d{2,4}(?:[ .-]?\d{2,4}){1,2}?|\d{1,4}(?:[ .-]?\d{2,4}){2,4})|(?<![\d+.-])(?:\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}(?:-\d{3}-|\.\d{3}\.)\d{4}(?![.-]\d)))" + _DIGIT_END,
    "ssn": r"(?<![\d-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\d-])",
}
# a run of digit groups that may hold card numbers; see _pieces
PATTERNS["card"] = r"(?<![\d\p{L}])(?=(?:[ -]?\d){13})\d++(?!\p{L})(?:[ -](?!" + "|".join(PATTERNS[k] for k in ("date", "ip", "ssn")) + r")\d++(?!\p{L}))*+"
#: What every value of any kind has in it: an at sign; a word for a secret and its separator; the start of an access key or
#: of an IBAN; the word bearer; two colons around hexadecimal digits; a sign or parenthesis before a digit; a point, slash or hyphen between digits; thirteen digits.
_TRACE = rf"@|(?i:{_PASSWORD_WORDS}|{_SECRET_WORDS})[\x22']?\s{{0,3}}[=:]|AKIA|[A-Z]{{2}}\d\d|(?i:bearer)\s|[0-9a-f]:[0-9a-f]{{1,4}}:[0-9a-f]|[+(]\d|\d[-./]\d|\d(?:[ -]?\d){{12}}"
_ALL = "|".join(f"(?:{p})" for p in PATTERNS.values())


def _quoted(text: str) -> str:
    return "r'" + text.replace("'", r"\x27") + "'"


def _kind(v: str) -> str:
    """SQL: the kind of a match."""
    return "CASE " + " ".join(f"WHEN {v} RLIKE {_quoted(f'^(?:{p})$')} THEN '{k}'" for k, p in PATTERNS.items()) + " END"


def _bind(name: str, value: str, body: str) -> str:
    """SQL: body with a name for value."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _digits(v: str) -> str:
    return f"regexp_replace({v}, '[^0-9]', '')"


def _luhn(digits: str, first_doubled: str) -> str:
    """SQL: the sum of digits modulo 10, every second from the right doubled; the last is doubled if first_doubled is 1."""
    d = "CAST(substr(x, -i, 1) AS INT)"
    term = f"(CASE WHEN (i + {first_doubled}) % 2 = 1 THEN {d} ELSE {d} * 2 - CASE WHEN {d} > 4 THEN 9 ELSE 0 END END)"
    return _bind("x", digits, f"aggregate(sequence(1, length(x)), 0, (s, i) -> (s + {term}) % 10)")


def _mod97(text: str) -> str:
    """SQL: the remainder of an IBAN's number, letters counting 10 to 35."""
    value = "CASE WHEN c RLIKE '[0-9]' THEN CAST(c AS INT) ELSE ascii(c) - 55 END"
    moved = f"split(concat(substr(y, 5), substr(y, 1, 4)), '')"
    return _bind("y", text, f"aggregate({moved}, 0, (s, c) -> (s * CASE WHEN c RLIKE '[0-9]' THEN 10 ELSE 100 END + {value}) % 97)")


def _pieces(v: str) -> str:
    """SQL: a match as an array of strings: a run of digit groups is divided into the card numbers in it, each the longest
    from a group's start to a group's end whose check digit is right, and what lies between them. What starts like an IBAN
    is divided at the last space before which its remainder is right, for a word in capitals may follow."""
    part = "array_join(slice(tk, n, m - n + 1), '')"
    ends = f"filter(sequence(n, least(n + 36, size(tk)), 2), m -> length({_digits(part)}) BETWEEN 13 AND 19 AND {_luhn(_digits(part), '0')} = 0)"
    put = "named_struct('at', m + 1, 'made', concat(g.made, array(array_join(slice(tk, g.at, n - g.at), ''), " + part + ")))"
    found = _bind("m", f"array_max({ends})", f"CASE WHEN m IS NULL THEN g ELSE {put} END")
    start = "named_struct('at', 1, 'made', CAST(array() AS ARRAY<STRING>))"
    left = "array_join(slice(tk, g.at, size(tk)), '')"
    parts = f"aggregate(sequence(1, size(tk), 2), {start}, (g, n) -> CASE WHEN n < g.at THEN g ELSE {found} END, g -> filter(concat(g.made, array({left})), y -> y <> ''))"
    ends = f"filter(sequence(15, length({v})), m -> (m = length({v}) OR substr({v}, m + 1, 1) = ' ') AND length(replace(left({v}, m), ' ', '')) >= 15 AND {_mod97(f"replace(left({v}, m), ' ', '')")} = 1)"
    iban = _bind("m", f"array_max({ends})", f"CASE WHEN m IS NULL OR m = length({v}) THEN array({v}) ELSE array(left({v}, m), substr({v}, m + 1)) END")
    # digit groups and single separators take turns
    cards = _bind("tk", f"regexp_extract_all({v}, '[0-9]+|[ -]', 0)", parts)
    return f"CASE WHEN {v} RLIKE '^[0-9][0-9 -]{{12,}}$' THEN {cards} WHEN length({v}) >= 15 AND {v} RLIKE {_quoted('^' + PATTERNS['iban'] + '$')} THEN {iban} ELSE array({v}) END"


def _valid(v: str) -> str:
    """SQL: whether a match (struct v with kind and text) is what it looks like."""
    day = f"coalesce(try_to_timestamp({_iso(f'{v}.text')}), CAST(NULL AS TIMESTAMP))"
    return (
        f"CASE {v}.kind WHEN 'card' THEN length({_digits(f'{v}.text')}) BETWEEN 13 AND 19 AND {_luhn(_digits(f'{v}.text'), '0')} = 0 "
        f"WHEN 'iban' THEN {_mod97(f'''replace({v}.text, ' ', '')''')} = 1 WHEN 'date' THEN {day} IS NOT NULL ELSE {v}.kind IS NOT NULL END"
    )


def _iso(v: str) -> str:
    return (
        f"CASE WHEN {v} LIKE '____-%' THEN {v} WHEN {v} LIKE '%.%' THEN concat_ws('-', substr({v}, 7, 4), substr({v}, 4, 2), substr({v}, 1, 2)) "
        f"ELSE concat_ws('-', substr({v}, 7, 4), substr({v}, 1, 2), substr({v}, 4, 2)) END"
    )


def _fixed(v: str) -> str:
    """SQL: how many characters at the start, and at the end, of a match stay as they are: struct a, z."""
    body = {
        "email": ("0", f"length({v}.text) - instr({v}.text, '@') + 1"),
        "secret": (f"length(regexp_extract({v}.text, {_quoted('^' + _SECRET_NAME)}, 0))", "0"),
        "bearer": (f"length(regexp_extract({v}.text, {_quoted('^' + _BEARER_NAME)}, 0))", "0"),
        "access": ("4", "0"),
        "iban": ("4", "0"),
        "phone": (f"length(regexp_extract({v}.text, '^[+][0-9]+', 0))", "0"),
        "card": ("0", "1"),
    }
    # an undivided phone number keeps one digit of its country code only
    body["phone"] = (f"CASE WHEN {v}.text RLIKE '^[+][0-9]+$' THEN 2 ELSE {body['phone'][0]} END", "0")
    return f"CASE {v}.kind " + " ".join(f"WHEN '{k}' THEN named_struct('a', CAST({a} AS INT), 'z', CAST({z} AS INT))" for k, (a, z) in body.items()) + " ELSE named_struct('a', 0, 'z', 0) END"


def _ssn_codes(v: str) -> str:
    """SQL: places of the three groups among the valid ones: areas 001 to 899 without 666, groups from 01, serials from 0001."""
    area = f"CAST(substr({v}, 1, 3) AS INT)"
    return f"array({area} - CASE WHEN {area} > 666 THEN 2 ELSE 1 END, CAST(substr({v}, 5, 2) AS INT) - 1, CAST(substr({v}, 8, 4) AS INT) - 1)"


def _ssn_text(new: str) -> str:
    parts = (f"{new}[0] + CASE WHEN {new}[0] >= 665 THEN 2 ELSE 1 END", 3), (f"{new}[1] + 1", 2), (f"{new}[2] + 1", 4)
    return "concat_ws('-', " + ", ".join(f"lpad(CAST({x} AS STRING), {n}, '0')" for x, n in parts) + ")"


def _radix(v: str, c: str) -> str:
    """SQL: of how many the alphabet of a character is: 10, 26, or 16 and 36 where letters and digits mix; 0: it stays."""
    return (
        f"CASE WHEN {v}.kind = 'access' THEN 36 WHEN {v}.hex AND {c} RLIKE '[0-9a-f]' THEN 16 "
        f"WHEN {c} RLIKE '[0-9]' THEN 10 WHEN {c} RLIKE '[a-zA-Z]' THEN 26 ELSE 0 END"
    )


def _code(radix: str, c: str) -> str:
    return f"CASE {radix} WHEN 36 THEN instr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', {c}) - 1 WHEN 16 THEN instr('0123456789abcdef', {c}) - 1 WHEN 10 THEN ascii({c}) - 48 ELSE ascii(lower({c})) - 97 END"


def _char(radix: str, code: str, c: str) -> str:
    return (
        f"CASE {radix} WHEN 36 THEN substr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', {code} + 1, 1) WHEN 16 THEN substr('0123456789abcdef', {code} + 1, 1) "
        f"WHEN 10 THEN char(48 + {code}) WHEN 26 THEN char({code} + CASE WHEN {c} RLIKE '[a-z]' THEN 97 ELSE 65 END) ELSE {c} END"
    )


def _feistel(codes: str, radices: str, tweak: str) -> str:
    """SQL: the codes (ints below their radices) permuted: halves take turns to add a keyed stream made from the other.
    A single code is replaced by its rank when all codes of its radix are ordered by a keyed hash."""
    half = f"(size({codes}) DIV 2)"
    left, right = f"slice({codes}, 1, {half})", f"slice({codes}, {half} + 1, size({codes}) - {half})"
    added = "transform({own}, (x, i) -> CAST((x + CAST(conv(substr(h[i DIV 8], 8 * (i % 8) + 1, 8), 16, 10) AS BIGINT)) % {radix} AS INT))"

    def turn(own: str, other: str, offset: str) -> str:
        # 256 bits for every eight codes, from one digest of the other half
        digest = f"sha2(array_join(transform({other}, x -> CAST(x AS STRING)), ','), 256)"
        hashed = f"transform(sequence(0, (size({own}) - 1) DIV 8), j -> sha2(concat_ws('|', {tweak}, CAST(k AS STRING), CAST(j AS STRING), d), 256))"
        return _bind("d", digest, _bind("h", hashed, added.format(own=own, radix=f"{radices}[i + {offset}]")))

    even = f"named_struct('l', {turn('s.l', 's.r', '0')}, 'r', s.r)"
    odd = f"named_struct('l', s.l, 'r', {turn('s.r', 's.l', half)})"
    start = f"named_struct('l', {left}, 'r', {right})"
    many = f"aggregate(sequence(0, {ROUNDS - 1}), {start}, (s, k) -> CASE WHEN k % 2 = 0 THEN {even} ELSE {odd} END, s -> concat(s.l, s.r))"
    keyed = f"transform(sequence(0, {radices}[0] - 1), x -> named_struct('h', sha2(concat_ws('|', {tweak}, CAST(x AS STRING)), 256), 'x', CAST(x AS INT)))"
    one = f"array(CAST(array_position(transform(array_sort({keyed}), y -> y.x), {codes}[0]) - 1 AS INT))"
    return f"CASE WHEN size({codes}) = 1 THEN {one} ELSE {many} END"


def _steps() -> list[tuple[str, str]]:
    """Columns, in order, from _match (array of strings) and _key to _new (array of strings of the same length)."""
    days = f"datediff(CAST({_iso('v.text')} AS DATE), DATE'{FIRST_DAY}')"
    character = "named_struct('c', c, 'r', CASE WHEN i < v.fixed.a OR i >= length(v.text) - v.fixed.z THEN 0 ELSE " + _radix("v", "c") + " END)"
    chars = f"transform(split(v.text, ''), (c, i) -> {character})"
    moving = "filter(v.chars, x -> x.r > 0)"
    codes = (
        f"CASE WHEN NOT v.valid THEN CAST(array() AS ARRAY<INT>) WHEN v.kind = 'ip' THEN transform(split(v.text, '[.]'), x -> CAST(x AS INT)) "
        f"WHEN v.kind = 'date' THEN array(CAST({days} DIV {DATE_B} AS INT), CAST({days} % {DATE_B} AS INT)) "
        f"WHEN v.kind = 'ssn' THEN {_ssn_codes('v.text')} ELSE transform({moving}, x -> CAST({_code('x.r', 'x.c')} AS INT)) END"
    )
    radices = f"CASE WHEN v.kind = 'ip' THEN array(256, 256, 256, 256) WHEN v.kind = 'date' THEN array({DATE_A}, {DATE_B}) WHEN v.kind = 'ssn' THEN array(898, 99, 9999) ELSE transform({moving}, x -> x.r) END"
    rank = "size(filter(slice(v.chars, 1, i), y -> y.r > 0))"
    letters = f"array_join(transform(v.chars, (x, i) -> CASE WHEN x.r = 0 THEN x.c ELSE {_char('x.r', f'v.new[{rank}]', 'x.c')} END), '')"
    date = f"date_add(DATE'{FIRST_DAY}', v.new[0] * {DATE_B} + v.new[1])"
    dated = f"CASE WHEN v.text LIKE '____-%' THEN date_format({date}, 'yyyy-MM-dd') WHEN v.text LIKE '%.%' THEN date_format({date}, 'dd.MM.yyyy') ELSE date_format({date}, 'MM/dd/yyyy') END"
    card = _bind("w", letters, f"concat(substr(w, 1, length(w) - 1), CAST((10 - {_luhn(_digits('substr(w, 1, length(w) - 1)'), '1')}) % 10 AS STRING))")
    iban = _bind("w", letters, f"concat(substr(w, 1, 2), lpad(CAST(98 - {_mod97('''concat(substr(w, 1, 2), '00', replace(substr(w, 5), ' ', ''))''')} AS STRING), 2, '0'), substr(w, 5))")
    whole = f"concat(left(v.text, v.fixed.a), 'u', substr(sha2(concat_ws('|', _key, v.kind, v.text), 256), 1, 15), right(v.text, v.fixed.z))"
    made = (
        f"CASE WHEN NOT v.valid THEN v.text WHEN size(v.codes) = 0 OR v.kind IN ('secret', 'email', 'bearer') AND (length(v.text) > {LONG} OR substr(v.text, v.fixed.a + 1) RLIKE '[^ -~]') THEN {whole} WHEN v.kind = 'ip' THEN array_join(transform(v.new, x -> CAST(x AS STRING)), '.') "
        f"WHEN v.kind = 'date' THEN {dated} WHEN v.kind = 'ssn' THEN {_ssn_text('v.new')} WHEN v.kind = 'card' THEN {card} WHEN v.kind = 'iban' THEN {iban} ELSE {letters} END"
    )
    tweak = "concat(_key, ':', v.kind)"
    return [
        ("_found", f"transform(_match, t -> named_struct('text', t, 'kind', {_kind('t')}))"),
        ("_found", f"transform(_found, v -> named_struct('text', v.text, 'kind', v.kind, 'valid', {_valid('v')}, 'fixed', {_fixed('v')}, 'hex', v.kind = 'ip6' OR v.kind = 'secret' AND v.text RLIKE {_quoted('^' + _SECRET_NAME + '[0-9a-f]+$')}))"),
        ("_found", f"transform(_found, v -> named_struct('text', v.text, 'kind', v.kind, 'valid', v.valid, 'fixed', v.fixed, 'chars', {chars}))"),
        ("_found", f"transform(_found, v -> named_struct('text', v.text, 'kind', v.kind, 'valid', v.valid, 'fixed', v.fixed, 'chars', v.chars, 'codes', {codes}, 'radices', {radices}))"),
        ("_found", f"transform(_found, v -> named_struct('text', v.text, 'kind', v.kind, 'valid', v.valid, 'fixed', v.fixed, 'chars', v.chars, 'codes', v.codes, 'new', {_feistel('v.codes', 'v.radices', tweak)}))"),
        ("_new", f"transform(_found, v -> {made})"),
        ("_kinds", "transform(filter(_found, v -> v.valid), v -> v.kind)"),
    ]


def pseudonymise(docs: DataFrame, key: str, *, text_col: str = "text", found_col: str | None = None) -> DataFrame:
    """docs with the values of PATTERNS in text_col replaced by their pseudonyms under key.

    The key reaches the tasks as a value of a one-row table, so it is in no plan or log. All rows, columns and their order stay; with found_col, that column is added last: the kinds found, in text order
    (array of strings, empty if none). A null text stays null and an empty one empty. Rows are treated one by one, so
    repeated rows give repeated rows, and columns of any names may be there. An empty table gives an empty table.
    """
    if not key:
        raise ValueError("key must not be empty")
    fields = docs.columns
    if found_col in fields:
        raise ValueError(f"there is a column {found_col} already")
    text = F.col("_row").getField(text_col).cast("string")
    secret = docs.sparkSession.createDataFrame([(key,)], "secret string")
    df = docs.select(F.struct("*").alias("_row")).withColumn("_key", secret.scalar())
    none = F.array().cast("array<string>")
    # one cheap look keeps texts that can hold no value from the long pattern, and a text without a match is not divided
    df = df.withColumn("_match", F.when(text.rlike(_TRACE), F.regexp_extract_all(text, F.lit(_ALL), 0)).otherwise(none))
    df = df.withColumn("_split", F.expr(f"transform(_match, t -> {_pieces('t')})")).withColumn("_gap", F.when(F.size("_match") > 0, F.split(text, _ALL, -1)).otherwise(none)).withColumn("_match", F.flatten("_split"))
    for name, sql in _steps():
        df = df.withColumn(name, F.expr(sql))
    # no gap lies between the pieces of a match
    gaps = F.flatten(F.zip_with(F.slice("_gap", 1, F.size("_split")), "_split", lambda a, b: F.concat(F.array(a), F.array_repeat(F.lit(""), F.size(b) - 1))))
    joined = F.when(F.size("_match") == 0, text).otherwise(F.concat(F.array_join(F.zip_with(gaps, "_new", lambda a, b: F.concat(a, b)), ""), F.element_at("_gap", -1)))
    out = [joined.alias(c) if c == text_col else F.col("_row").getField(c).alias(c) for c in fields]
    if found_col:
        out.append(F.coalesce("_kinds", F.array().cast("array<string>")).alias(found_col))
    return df.select(*out)
