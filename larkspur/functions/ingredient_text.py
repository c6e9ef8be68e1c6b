"""Cleaning and scoring of ingredient texts."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspur.functions import fixed
from larkspur.functions.core import PUNCTUATION, WHITE, ascii_only, collapse, has_any, let, replaced, strip, strip_ends, text


def meaningful(c: Column) -> Column:
    """The trimmed text; '' for null, blank and words that stand for nothing."""
    return let(strip_ends(text(c)), lambda t: F.when((F.octet_length(t) <= 16) & F.lower(t).isin(fixed.BLANK_WORDS), "").otherwise(t))


def needs_harvest(raw: Column, force: bool = False) -> Column:
    """P7."""
    return F.lit(True) if force else meaningful(raw) == ""


def clean_block(c: Column) -> Column:
    """T1."""
    t = F.regexp_replace(strip(text(c)), fixed.ZERO_WIDTH, "")
    t = F.regexp_replace(F.regexp_replace(t, fixed.BLOCK_LINK, " "), fixed.BLOCK_TAG, " ")
    t = F.regexp_replace(t, rf"(?i)\b(?:{'|'.join(fixed.BLOCK_PHRASES)})\b", " ")
    for pattern in (*fixed.BLOCK_FILLING, fixed.DISCLAIMER):
        t = F.regexp_replace(t, pattern, " ")
    return collapse(t)


def strip_label(c: Column) -> Column:
    """The parser's text without its label and outer punctuation."""
    label = lambda t: F.regexp_replace(F.regexp_replace(t, fixed.LABEL_EN, ""), fixed.LABEL_ZH, "")
    t = let(strip_ends(text(c)), lambda t: F.when(has_any(t, [":", "："]), label(t)).otherwise(t))
    return collapse(strip_ends(strip_ends(t), PUNCTUATION))


#: What may stand after the word that a truncated text ends with.
_TRAILING = " \t\n\x0b\f\r\u0085\u2028\u2029.…"


def _may_be_truncated(t: Column) -> Column:
    """Whether TRUNCATED can match: its words end the text, white space and dots aside."""
    ends = lambda c, parts: reduce(lambda held, x: held | F.endswith(c, F.lit(x)), parts, F.lit(False))
    end = F.lower(F.rtrim(F.substring(t, -48, 48), F.lit(_TRAILING)))  # walks the text, so the last letters are looked at first
    return ends(t, ["&", *(x + y for a, b in ("nd", "tc") for x in (a, a.upper()) for y in (b, b.upper())), *_TRAILING]) & let(end, lambda e: (F.length(e) < 3) | ends(e, ["and", "etc", "&"]))


def _may_hold_ui_phrase(t: Column) -> Column:
    """Whether UI_PHRASES can match: the words of one of its phrases occur, wherever."""
    has = lambda low, word, *one_of: F.contains(low, F.lit(word)) & has_any(low, list(one_of))
    return let(F.lower(t), lambda low: has(low, "read", "more", "less", "ingredient") | has(low, "show", "more", "less", "ingredient") | has(low, "see", "more", "less", "text") | has(low, "view", "full") | has(low, "click", "here") | has(low, "ingredient", "function"))


#: For each of NOISE_STEPS what a text holds that its pattern can match; a search for it takes a fraction of the pattern's time.
_NOISE_SIGNS = [
    lambda t: ~ascii_only(t) & has_any(t, list(fixed.ZERO_WIDTH[1:-1])), lambda t: F.contains(t, F.lit("://")), lambda t: F.contains(t, F.lit("#")), lambda t: F.contains(t, F.lit("[")),
    _may_hold_ui_phrase, _may_be_truncated, lambda t: has_any(t, ["...", "…"]), _may_be_truncated,
]


def clean_with_notes(c: Column) -> Column:
    """Struct of the cleaned text and a note for each step that changed it."""
    state = F.struct(strip_ends(text(c)).alias("text"), F.array().cast("array<string>").alias("notes"))
    for (pattern, by, note), sign in zip(fixed.NOISE_STEPS, _NOISE_SIGNS, strict=True):
        state = _step(state, pattern, by, note, sign)
    return let(state, lambda s: F.struct(strip_ends(collapse(s["text"]), PUNCTUATION).alias("text"), s["notes"].alias("notes")))


def _step(state: Column, pattern: str, by: str, note: str, sign: Callable[[Column], Column]) -> Column:
    def change(s: Column) -> Column:
        return let(F.regexp_replace(s["text"], pattern, by), lambda t: F.struct(t.alias("text"), F.when(t != s["text"], F.array_append(s["notes"], F.lit(note))).otherwise(s["notes"]).alias("notes")))

    return let(state, lambda s: F.when(sign(s["text"]), change(s)).otherwise(s))


def block_label_stripped(c: Column) -> Column:
    t = F.regexp_replace(strip(text(c)), fixed.BLOCK_LABEL_EN, "")
    return strip(F.regexp_replace(t, fixed.BLOCK_LABEL_ZH, ""))


def slice_after_label(c: Column) -> Column:
    """T4: what follows the first label that doesn't stand at the very start."""

    def cut(t: Column, pattern: str, otherwise: Column) -> Column:
        at = F.regexp_instr(t, F.lit(pattern))
        label = F.regexp_extract(t, pattern, 0)
        return F.when(at > 1, strip(F.substring(t, at + F.length(label), F.length(t)))).otherwise(otherwise)

    return let(block_label_stripped(c), lambda t: cut(t, fixed.INNER_LABEL_EN, cut(t, fixed.INNER_LABEL_ZH, t)))


def inline_sequence(c: Column) -> Column:
    """T5: the text from the earliest common token that opens a list, and of it the first run of five Latin items."""

    def starts(t: Column, low: Column) -> Column:
        opens = lambda at: F.when((at > 0) & ~F.substring(t, F.lit(1), at - 1).rlike("[,;，；]") & F.substring(t, at, F.lit(120)).rlike("[,/]"), at)
        return F.array(*[F.when(F.contains(low, F.lit(token)), let(F.regexp_instr(t, F.lit(rf"(?i)\b{token}\b")), opens)) for token in fixed.COMMON_TOKENS])

    def from_token(t: Column) -> Column:
        return let(let(F.lower(t), lambda low: F.array_min(starts(t, low))), lambda first: since(t, first))

    def since(t: Column, first: Column) -> Column:
        return F.when(first.isNotNull(), strip(F.substring(t, F.coalesce(first, F.lit(1)), F.length(t)))).otherwise(t)

    run = fixed.LATIN_RUN
    cleaned = F.regexp_replace(clean_block(slice_after_label(c)), fixed.LIST_WORD, "")
    return let(let(cleaned, from_token), lambda t: F.when(t.rlike(run), collapse(F.regexp_extract(t, run, 1))).otherwise(t))


def _count(t: Column, char: str) -> Column:
    return F.length(t) - F.length(F.replace(t, F.lit(char), F.lit("")))


def is_script_or_json(c: Column) -> Column:
    """T6. The numbers are fixed values."""
    return let(strip(text(c)), lambda t: ((F.length(t) >= 120) & t.rlike(r"^[{\[]")) | t.rlike(fixed.CODE_SIGNS) | ((_count(t, "{") >= 3) & (_count(t, "}") >= 3) & (_count(t, ":") >= 4) & (_count(t, '"') >= 4)))


def ingredient_score(c: Column) -> Column:
    """T7, rounded to six places. The weights and bounds are fixed values."""

    def score(t: Column) -> Column:
        hits = let(F.lower(t), lambda low: sum((F.contains(low, F.lit(w)).cast("int") for w in fixed.COMMON_TOKENS), F.lit(0)))
        parts = F.size(F.filter(F.split(t, r"[,;，；]\s*"), lambda p: strip(p) != ""))
        full = F.when(t.rlike("[,;，；]"), 0.35).otherwise(0.0) + F.least(F.lit(0.35), hits * 0.08) + F.when(parts >= 5, 0.3).when(parts >= 4, 0.25).otherwise(0.0)
        return F.when(t == "", 0.0).when(F.length(t) < 10, 0.1).when(F.length(t) > 3000, 0.2).when(is_script_or_json(t), 0.05).otherwise(F.round(F.least(F.lit(1.0), full), 6))

    return let(strip(text(c)), score)


def has_inci_signal(c: Column) -> Column:
    """T8."""
    return let(text(c), lambda t: has_any(F.lower(t), fixed.COMMON_TOKENS) | t.rlike(fixed.INCI_WORDS))


def is_invalid_blob(c: Column) -> Column:
    """T9."""
    may = lambda t: has_any(t, ["see ", "refer to", "not avail", "包装", "图片"])  # noqa: E731  (a part of each of the phrases)
    return let(F.lower(strip_ends(text(c))), lambda t: (t == "") | t.isin(fixed.BLANK_WORDS) | (may(t) & has_any(t, fixed.NO_SOURCE_PHRASES)))


def html_to_text(c: Column, list_items: bool = True, any_case: bool = True) -> Column:
    """T10; without list_items and any_case its first form. Null for null and blank."""
    flag = "(?i)" if any_case else ""
    t = F.replace(c, F.lit(" "), F.lit(" "))
    t = F.regexp_replace(t, rf"{flag}<br\s*/?>", "\n")
    for tag in ("p", "div", *(["li"] if list_items else [])):
        t = F.regexp_replace(t, rf"{flag}</{tag}\s*>", "\n")
    t = F.replace(F.regexp_replace(t, rf"{flag}</?[a-z][^>]*>", " "), F.lit("\r\n"), F.lit("\n"))
    for pattern, by in ((r"[ \t]+", " "), (r"\n[ \t]+", "\n"), (r"\n{3,}", "\n\n")):
        t = F.regexp_replace(t, pattern, by)
    return let(strip(t), lambda x: F.when(x != "", x))


def choose_overview(structured: Column, detailed: Column, meta: Column) -> Column:
    """T11."""

    def choose(s: Column, d: Column) -> Column:
        longer = F.length(d) >= F.greatest(F.length(s) + 60, F.floor(F.length(s) * 1.35 + 0.5))
        expanded = d.rlike(fixed.EXPANDED_TEXT)
        better = F.startswith(F.lower(d), F.lower(s)) | (longer & expanded)
        return F.when(d.isNotNull() & (s.isNull() | better), d).otherwise(F.coalesce(s, html_to_text(meta)))

    return let(html_to_text(structured), lambda s: let(html_to_text(detailed), lambda d: choose(s, d)))


def merged_description(overview: Column, how_to_use: Column, ingredients: Column) -> Column:
    """The parts that there are, by blank lines; null if there is none."""
    part = lambda label, c: F.when(strip(text(c)) != "", F.concat(F.lit(label), strip(c)))
    return let(F.concat_ws("\n\n", part("", overview), part("How to Use: ", how_to_use), part("Ingredients and Safety: ", ingredients)), lambda t: F.when(t != "", t))


def lookup_key(c: Column) -> Column:
    """I2. Most texts have nothing to be taken out or put as one space, so their key is the text in lower case."""

    def full(c: Column) -> Column:
        t = replaced(F.lower(strip_ends(text(c))), "’‘（）", "''()")
        t = _without(_without(t, "<", r"<[^>]{1,80}>"), "(", r"\([^)]*\)")
        return collapse(replaced(t, "/.:：®™", [" ", " ", " ", " ", "", ""]))

    plain = lambda t: ascii_only(t) & ~has_any(t, [*"</.(:", "  ", *WHITE[1:]]) & ~F.startswith(t, F.lit(" ")) & ~F.endswith(t, F.lit(" "))
    return let(c, lambda t: F.when(plain(t), F.lower(t)).otherwise(full(t)))


def _without(c: Column, sign: str, pattern: str) -> Column:
    """The text without what matches the pattern, which only texts with the sign can."""
    return let(c, lambda t: F.when(F.contains(t, F.lit(sign)), F.regexp_replace(t, pattern, "")).otherwise(t))


def inci_key(c: Column) -> Column:
    """I6. A list as the parser joins it, in ASCII, has one space after each semicolon to lose and no other."""
    full = lambda t: F.array_join(F.filter(F.transform(F.split(t, ";"), lambda p: F.lower(strip(p))), lambda p: p != ""), ";")
    ends = lambda t: F.startswith(t, F.lit(" ")) | F.startswith(t, F.lit(";")) | F.endswith(t, F.lit(" ")) | F.endswith(t, F.lit(";"))
    joined = lambda t: ascii_only(t) & ~has_any(t, [" ;", ";;", "  ", *WHITE[1:]]) & ~ends(t)
    return let(text(c), lambda t: F.when(joined(t), F.replace(F.lower(t), F.lit("; "), F.lit(";"))).otherwise(full(t)))


def search_query(market: Column, brand: Column, product: Column) -> Column:
    """P5."""
    base = strip(F.concat_ws(" ", strip(text(brand)), strip(text(product))))
    return strip(F.concat(base, F.when(F.upper(strip(text(market))).isin("CN", "CHN", "CHINA"), " 全成分").otherwise(" ingredients list INCI")))


def search_queries(market: Column, brand: Column, product: Column, hosts: Column) -> Column:
    """P5: the query for each official host, and then the general one."""
    return let(search_query(market, brand, product), lambda q: F.concat(F.transform(hosts, lambda h: F.concat(q, F.lit(" site:"), h)), F.array(q)))
