"""Where queries and the SQL that must give the same rows are kept."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame under ``name``."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


# --- pieces of SQL, spelled for the oracle's regular expressions ---

W = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def s_strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{W}+', ''), '{W}+$', '')"


def s_words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '{W}+'), lambda ww: ww <> '')"


def s_trim(x: str, chars: str) -> str:
    return f"trim({x}, '{chars.replace(chr(39), chr(39) * 2)}')"


def s_indel(a: str, b: str) -> str:
    """Indel ratio by a dynamic programme over lists."""
    cells = f"list_transform(range(1, length({b}) + 1), lambda j: [j::varchar])"
    row = f"list_reduce({cells}, lambda acc, j: list_append(acc, case when ca[1] = substring({b}, j[1]::int, 1) then (prev[j[1]::int]::int + 1)::varchar else greatest(prev[j[1]::int + 1]::int, acc[-1]::int)::varchar end), ['0'])"
    start = f"list_transform(range(0, length({b}) + 1), lambda x: '0')"
    lcs = f"(list_reduce(list_transform(string_split({a}, ''), lambda ch: [ch]), lambda prev, ca: {row}, {start}))[-1]::int"
    return f"(case when length({a}) + length({b}) = 0 then 100.0::double when length({a}) = 0 or length({b}) = 0 then 0.0::double else 200.0::double * {lcs} / (length({a}) + length({b})) end)"
