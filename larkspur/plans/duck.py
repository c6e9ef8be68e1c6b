"""Pieces of DuckDB SQL that state the operators a second time, for the oracle."""

from __future__ import annotations

from larkspur.functions import fixed

PUNCT = "。．. ;；,，"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sub(x: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(by)}, 'g')"


def strip(x: str) -> str:
    return sub(x, r"^\s+|\s+$")


def strip_of(x: str, chars: str) -> str:
    inner = chars.replace("-", r"\-")
    return sub(x, f"^[{inner}]+|[{inner}]+$")


def collapse(x: str) -> str:
    return strip(sub(x, r"\s+", " "))


def text(x: str) -> str:
    return f"coalesce({x}, '')"


def strip_label(x: str) -> str:
    t = sub(sub(strip(text(x)), fixed.LABEL_EN), fixed.LABEL_ZH)
    return collapse(strip_of(strip(t), PUNCT))


def clean_ctes(source: str, x: str, keep: str) -> tuple[str, str]:
    """CTEs that clean a text step by step; the last has columns of keep, cleaned and notes."""
    out, last = [f"c0 AS (SELECT {keep}, {strip(x)} AS t, []::VARCHAR[] AS notes FROM {source})"], "c0"
    for k, (pattern, by, note) in enumerate(fixed.NOISE_STEPS, 1):
        new = sub("t", pattern, by.replace("$1", r"\1"))
        out.append(f"c{k} AS (SELECT {keep}, n AS t, CASE WHEN n <> t THEN list_append(notes, {q(note)}) ELSE notes END AS notes FROM (SELECT *, {new} AS n FROM {last}))")
        last = f"c{k}"
    out.append(f"cleaned AS (SELECT {keep}, {strip_of(strip(collapse('t')), PUNCT)} AS cleaned, notes FROM {last})")
    return ", ".join(out), "cleaned"


def csv_said(x: str) -> str:
    """A text with single spaces, as the round trips through CSV files are compared."""
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def marked_ctes(name: str, source: str, column: str, separators: str) -> str:
    """CTEs of which the last, `name`, has row_id and marked: the text with chr(1) for each separator that stands in no bracket.

    The depth of brackets after a piece, never below zero, is a running sum less its running minimum where that is negative.
    """
    chars = " || ".join(f"chr({ord(c)})" for c in separators)
    return f"""{name}0 AS (SELECT row_id, unnest(range(1, len(ps) + 1)) AS i, unnest(ps) AS piece FROM (SELECT row_id, regexp_extract_all({column}, '[(（\\[【{{]|[)）\\]】}}]|[^(（\\[【{{)）\\]】}}]+') AS ps FROM {source})),
{name}1 AS (SELECT *, sum(CASE WHEN piece IN ('(', '（', '[', '【', '{{') THEN 1 WHEN piece IN (')', '）', ']', '】', '}}') THEN -1 ELSE 0 END) OVER (PARTITION BY row_id ORDER BY i) AS s FROM {name}0),
{name}2 AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY row_id ORDER BY i)) AS depth FROM {name}1),
{name}3 AS (SELECT row_id, string_agg(CASE WHEN depth = 0 THEN translate(piece, {chars}, repeat(chr(1), {len(separators)})) ELSE piece END, '' ORDER BY i) AS marked FROM {name}2 GROUP BY row_id),
{name} AS (SELECT s.row_id, coalesce(marked, '') AS marked FROM {source} s LEFT JOIN {name}3 USING (row_id))"""


def clean_block(x: str) -> str:
    t = sub(strip(text(x)), fixed.ZERO_WIDTH)
    t = sub(sub(t, r"(?i)https?://\S+", " "), r"(^|\s)#[\w-]+", " ")
    for phrase in fixed.BLOCK_PHRASES:
        t = sub(t, rf"(?i)\b{phrase}\b", " ")
    for p in (r"(?i)\[\s*more\s*\]", r"(\.{3,}|…)", r"(?i)\b(and|&)\s*$", r"(?i)\betc\.?\s*$", fixed.DISCLAIMER):
        t = sub(t, p, " ")
    return collapse(t)


def lookup_key(x: str) -> str:
    t = f"lower({strip(text(x))})"
    for a, b in (("’", "'"), ("‘", "'"), ("（", "("), ("）", ")")):
        t = f"replace({t}, {q(a)}, {q(b)})"
    for p, b in ((r"<[^>]{1,80}>", ""), (r"\([^)]*\)", ""), ("/", " "), ("[®™]", ""), ("[.:：]", " ")):
        t = sub(t, p, b)
    return collapse(t)


def any_of(x: str, parts: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(p)})" for p in parts) + ")"


SPLIT = r"^([A-Za-z][A-Za-z0-9+.\-]*://)([^/?#]*)([^?#]*)(?:\?([^#]*))?"


def host(u: str) -> str:
    return f"lower(regexp_extract({u}, {q(SPLIT)}, 2))"


def path(u: str) -> str:
    return f"regexp_extract({u}, {q(SPLIT)}, 3)"


def query(u: str) -> str:
    return f"regexp_extract({u}, {q(SPLIT)}, 4)"


def url_like(x: str) -> str:
    t = strip(text(x))
    return f"CASE WHEN regexp_matches({t}, '(?i)^[a-z][a-z0-9+.\\-]*://') THEN {t} WHEN starts_with({t}, 'www.') OR contains(split_part({t}, '/', 1), '.') THEN 'https://' || {t} ELSE '' END"


def canonical(u: str) -> str:
    base = f"lower(regexp_extract({u}, {q(SPLIT)}, 1)) || {host(u)} || CASE WHEN {path(u)} = '' THEN '/' ELSE {path(u)} END"
    kept = f"list_filter(string_split({query(u)}, '&'), lambda p: p <> '' AND NOT regexp_matches(regexp_extract(p, '^[^=]*'), {q(fixed.TRACKING_KEY)}))"
    return f"CASE WHEN regexp_matches({u}, '(?i)^https?://[^/?#]+') THEN {base} || CASE WHEN len({kept}) > 0 THEN '?' || array_to_string({kept}, '&') ELSE '' END ELSE {u} END"


def effective_type(kind: str, ref: str) -> str:
    u = f"lower({url_like(ref)})"
    return f"CASE WHEN {any_of(u, fixed.THIRD_PARTIES)} THEN 'thirdparty' WHEN {any_of(u, fixed.RETAILERS)} THEN 'retailer' ELSE lower({strip(text(kind))}) END"


def tokens(x: str) -> str:
    stop = ", ".join(q(w) for w in fixed.STOP_WORDS)
    own = f"list_filter(regexp_extract_all(lower({text(x)}), '[a-z0-9]+'), lambda t: (length(t) >= 4 OR (length(t) >= 3 AND regexp_matches(t, '[0-9]'))) AND t NOT IN ({stop}))"
    return f"list_distinct(list_concat({own}, list_transform(list_filter({own}, lambda t: contains(t, '0')), lambda t: replace(t, '0', 'o'))))"


def url_score(u: str, base: str) -> str:
    p = f"lower({path(u)})"
    last = f"coalesce(list_filter(string_split({p}, '/'), lambda s: s <> '')[-1], '')"
    depth = f"len(list_filter(string_split({p}, '/'), lambda s: s <> ''))"
    hyphens = f"(length({last}) - length(replace({last}, '-', '')))"
    add = lambda cond, n: f"CASE WHEN {cond} THEN {n} ELSE 0 END"
    m = lambda x, pat: f"regexp_matches({x}, {q(pat)})"
    total = " + ".join([
        add(m(p, "/products?/"), 6), add(m(p, "/p/[^/]+$"), 6), add(m(p, r"\.html$"), 6), add(f"{depth} = 1 AND {hyphens} >= 3", 4),
        add(f"{depth} <= 2 AND {m(last, '(?i)^the-[a-z0-9-]+$')}", 4), add(f"{depth} <= 2 AND {hyphens} >= 2", 2), add(f"{depth} <= 2 AND {m(last, fixed.CARE_WORDS)}", 2),
    ])
    never = f"NOT regexp_matches({u}, '(?i)^https?://[^/?#]+') OR {host(u)} <> {host(base)} OR {m(path(u), fixed.STATIC_FILE)} OR {path(u)} IN ('', '/')"
    return f"CASE WHEN {never} THEN NULL WHEN {m(p, fixed.NEGATIVE_PATH)} THEN -4 ELSE {total} END"


def number(t: str) -> str:
    t = f"regexp_replace({t}, '[\\s'']', '', 'g')"
    dot_last = f"length(regexp_extract({t}, '[^.]*$')) < length(regexp_extract({t}, '[^,]*$'))"
    both = f"CASE WHEN {dot_last} THEN replace({t}, ',', '') ELSE replace(replace({t}, '.', ''), ',', '.') END"
    plain = f"CASE WHEN contains({t}, ',') AND contains({t}, '.') THEN {both} WHEN contains({t}, ',') THEN CASE WHEN regexp_matches({t}, '^[^,]*,[^,]{{1,2}}$') THEN replace({t}, ',', '.') ELSE replace({t}, ',', '') END ELSE {t} END"
    return f"try_cast(regexp_extract({plain}, '^[0-9]*\\.?[0-9]*') AS DOUBLE)"
