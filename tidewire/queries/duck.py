"""Fragments of DuckDB SQL from which the oracles are put together."""

from __future__ import annotations

from tidewire.functions import text as t


def quoted(items: list[str]) -> str:
    return "[" + ", ".join("'" + i.replace("'", "''") + "'" for i in items) + "]"


def joined(items: str) -> str:
    return f"array_to_string(list_sort(list_distinct({items})), ',')"


def minus(items: str, stops: list[str]) -> str:
    return f"list_filter({items}, lambda q: not list_contains({quoted(stops)}, q))"


def words(x: str) -> str:
    return f"regexp_extract_all({x}, '[\\pL\\pN_]+')"


def matching(x: str, pattern: str) -> str:
    return f"list_filter({words(x)}, lambda w: regexp_full_match(w, '{pattern}'))"


def lower(items: str) -> str:
    return f"list_transform({items}, lambda w: lower(w))"


def acronyms(x: str) -> str:
    return lower(minus(matching(x, "[A-Z]{2,}"), t.GENERIC_ACRONYMS))


def all_acronyms(x: str) -> str:
    return lower(matching(x, "[A-Z]{2,}"))


def proper(x: str) -> str:
    return lower(matching(x, "[A-Z][a-z]{2,}"))


def plain(x: str, stops: list[str], least: int = 3) -> str:
    return minus(f"list_filter(regexp_extract_all(lower({x}), '[a-z0-9]+'), lambda w: length(w) >= {least})", stops)


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def normalize(x: str) -> str:
    """As the library's rule, with composition."""
    a = f"regexp_replace(coalesce({x}, ''), '[\\x{{200B}}-\\x{{200D}}\\x{{2060}}\\x{{FEFF}}\\x{{00AD}}]', '', 'g')"
    b = f"regexp_replace({a}, '[\\x{{00A0}}\\x{{2009}}\\x{{202F}}]', ' ', 'g')"
    c = f"regexp_replace({b}, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x{{9f}}]', ' ', 'g')"
    return collapse(f"nfc_normalize({c})")


def event_core_cte(source: str, key: str = "id") -> str:
    """CTEs ending in ``core(id, headline, core)`` that take the event out of headlines step by step."""
    inc = "(?i)\\b(?:fire|blaze|blast|crash|flood|killing|death|tragedy)\\b"
    act = "(?i)\\b(?:audit|inspect|launch|order|review|seek|start|survey)\\w*\\b"
    return f"""
    c0 as (select {key} as id, headline, {collapse('headline')} as x from {source}),
    c1 as (select id, headline, coalesce(nullif(trim(regexp_extract(x, '(?i)^(?:after|following)\\s+[^,:;]{{3,120}}[,:]\\s+(.+)$', 1)), ''), x) as x from c0),
    c2 as (select id, headline, case when instr(x, ':') > 0 and regexp_matches(substr(x, 1, instr(x, ':') - 1), '{inc}')
             and regexp_matches(substr(x, instr(x, ':') + 1), '{act}') then trim(substr(x, instr(x, ':') + 1)) else x end as x from c1),
    c3 as (select id, headline, coalesce(nullif(trim(regexp_extract(x, '(?i)^.+?\\b(?:fire|blaze|blast|crash|flood|killing|death|tragedy)\\s+(?:prompts?|sparks?|triggers?)\\s+(.+)$', 1)), ''), x) as x from c2),
    core as (select id, headline, case when m <> '' and regexp_matches(m, '{act}') then trim(m) else x end as core from (
             select id, headline, x, regexp_extract(x, '(?i)^(.+?)\\s+(?:after|following)\\s+[^,;:]{{3,120}}$', 1) as m from c3))"""


def cues(core: str) -> str:
    figures = lower(f"regexp_extract_all({core}, '(?i)\\b\\d[\\d,./-]*(?:%|bn|m|million|billion|crore|lakh|rs|pkr|usd)?\\b')")
    return f"list_concat(list_concat({all_acronyms(core)}, {figures}), {minus(proper(core), t.HEADLINE_STOPS)})"


def shingles(x: str, size: int = 3) -> str:
    # The words are bound once by an outer lambda.
    return f"""(list_transform([regexp_extract_all(lower({x}), '[a-z0-9]+')], lambda ws: case when len(ws) = 0 then []::varchar[] else
        list_transform(range(1, greatest(len(ws) - {size - 1}, 1) + 1), lambda i: array_to_string(ws[i:i + {size - 1}], ' ')) end)[1])"""


def hash64(x: str) -> str:
    return f"(concat('0x', substr(md5({x}), 1, 16))::ubigint)"


def canonical_url(u: str) -> str:
    scheme = f"coalesce(nullif(lower(regexp_extract(trim({u}), '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)), ''), 'https')"
    rest = f"regexp_replace(trim({u}), '^[A-Za-z][A-Za-z0-9+.-]*://', '')"
    host = f"regexp_replace(lower(regexp_extract({rest}, '^([^/?#:]*)', 1)), '^www\\.', '')"
    path = f"coalesce(nullif(regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1), ''), '/')"
    return f"{scheme} || '://' || {host} || case when length({path}) > 1 then regexp_replace({path}, '/$', '') else {path} end"


def host(u: str) -> str:
    return f"lower(regexp_extract(regexp_replace(trim({u}), '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '^([^/?#:]*)', 1))"


def markup(x: str) -> str:
    """As the library's rule, with the entities that the driver's pages have."""
    out = f"regexp_replace(regexp_replace({x}, '(?s)<!.CDATA.(.*?)..>', '\\1', 'g'), '<[^>]+>', ' ', 'g')"
    named = {"lt": "<", "gt": ">", "quot": '"', "apos": "''", "nbsp": " ", "copy": "©", "middot": "·", "amp": "&"}
    for name, char in named.items():
        out = f"replace({out}, '&{name};', '{char}')"
    return normalize(out)
