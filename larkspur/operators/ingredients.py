"""The ingredient parsing job (I1 to I5, I7), row by row in column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions import fixed
from larkspur.functions.core import PUNCTUATION, WHITE, ascii_only, collapse, has_any, let, lookup, odd_space, replaced, strip, strip_of, text
from larkspur.functions.ingredient_text import clean_with_notes, is_invalid_blob, lookup_key, meaningful, strip_label
from larkspur.scratch import small, stored

SEPARATORS = ",，、;；\n\r\t|•·●・"
OPENERS, CLOSERS = "(（[【{", ")）]】}"
#: What a separator outside of brackets is turned into.
MARK = "\u0001"
PIECES = r"[(（\[【{]|[)）\]】}]|[^(（\[【{)）\]】}]+"
NO_MAPPING = "No INCI mapping found"
INCI = "array<struct<order:int,standard_name:string,original_text:string,uncertain:boolean,needs_review:boolean>>"


def _marked(said: Column, separators: str) -> Column:
    """The text with MARK for each separator that stands in no bracket; any closer ends any opener, an open one holds the rest."""
    common, rare = separators[:1], separators[1:]  # a search for a mark takes a fraction of its replacement's time
    marked = lambda t, by: replaced(t, by, MARK * len(by))
    mark = lambda t: let(marked(t, common), lambda x: F.when(has_any(x, list(rare)), marked(x, rare)).otherwise(x) if rare else x)

    def step(state: Column, piece: Column) -> Column:
        depth = state["depth"] + F.when(piece.isin(list(OPENERS)), 1).when(piece.isin(list(CLOSERS)) & (state["depth"] > 0), -1).otherwise(0)
        return F.struct(depth.alias("depth"), F.concat(state["said"], F.when(state["depth"] == 0, mark(piece)).otherwise(piece)).alias("said"))

    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("said"))
    held = F.aggregate(F.regexp_extract_all(said, F.lit(PIECES), 0), start, step, lambda state: state["said"])
    return F.when(has_any(said, list(OPENERS)), held).otherwise(mark(said))


def _tokens(said: Column) -> Column:
    """Pieces between separators; a single one that has a slash between spaces is split at slashes."""
    parts = lambda t: F.when(has_any(t, list(WHITE[1:])), F.transform(F.split(t, MARK), strip)).otherwise(F.transform(F.split(t, MARK), lambda p: F.trim(p)))  # noqa: E731  (spaces are trimmed by bytes)
    pieces = lambda t: F.filter(let(t, parts), lambda p: p != "")
    return let(pieces(_marked(said, SEPARATORS)), lambda p: F.when((F.size(p) == 1) & F.try_element_at(p, F.lit(1)).rlike(r"\s/\s"), pieces(_marked(p[0], "/"))).otherwise(p))


def _tidy(tokens: Column) -> Column:
    tidy = lambda t: collapse(strip_of(strip(strip_of(strip(t), " \t\n\r–—•·●・-")), PUNCTUATION))
    ends = lambda t: reduce(lambda held, x: held | F.startswith(t, F.lit(x)) | F.endswith(t, F.lit(x)), [" ", "-", ".", ";", ","], F.lit(False))
    tidied = lambda t: F.when(ascii_only(t) & ~odd_space(t) & ~ends(t), t).otherwise(tidy(t))  # noqa: E731  (most tokens are tidy)
    return F.filter(F.transform(tokens, tidied), lambda t: t != "")


def tokenized(rows: DataFrame, column: str = "cleaned_text") -> DataFrame:
    """Adds tokens."""
    return rows.withColumn("tokens", _tidy(_tokens(text(F.col(column)))))


def separator_failed(tokens: Column) -> Column:
    one = F.try_element_at(tokens, F.lit(1))
    return (F.size(tokens) == 1) & ((F.length(one) >= 80) | (F.size(F.regexp_extract_all(one, F.lit("[A-Za-z0-9]+"), 0)) >= 6))


def _english(t: Column) -> Column:
    upper_first = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))
    words = F.when(odd_space(t), F.split(t, r"\s+")).otherwise(F.split(t, " "))
    plain = ascii_only(t) & ~odd_space(t)  # in lower case, too, so that initcap changes nothing but first letters
    return F.when(t.rlike("[-A-Z0-9/]"), upper_first(t)).when(plain, F.initcap(t)).otherwise(F.array_join(F.transform(words, upper_first), " "))


def _long_key(plain: Column, longest: int) -> Column:
    """Whether the lookup key is longer than `longest` for sure: so many characters at the start have none that a key lacks. Such a token is in no dictionary of shorter keys, and much of prose is such tokens."""
    whole = lambda t: (F.length(t) == longest + 2) & ~has_any(t, [*"<（(/.:：®™"]) & ~odd_space(t) & ~F.startswith(t, F.lit(" "))
    kept = lambda t: ~has_any(t, [*"<（(®™"]) & (F.length(replaced(t, f"{WHITE}/.:：", [""] * (len(WHITE) + 4))) > longest)  # noqa: E731  (in prose with dots; they and white space become spaces at most)
    return (F.octet_length(plain) >= longest + 2) & (let(F.substring(plain, 1, longest + 2), whole) | let(F.substring(plain, 1, 2 * longest), kept))


def mapped(tokens: Column, names: Column | None = None) -> Column:
    """Per token its name and how it was found. The dictionary is a constant of the plan, so nothing is shuffled, or a map that the row holds (names: by lookup key)."""
    if names is None:
        names = lookup([(k, v) for k, v in _dictionary()])
        keys = lookup([(v, k) for v, k in _standard_keys()])
        own_key = lambda standard: keys[standard]
        longest = max(len(k) for k, _ in _dictionary())
        key_of = lambda plain: F.when(~_long_key(plain, longest), lookup_key(plain))
    else:
        own_key = key_of = lookup_key

    def one(token: Column) -> Column:
        def named(plain: Column) -> Column:
            tags = F.regexp_extract_all(token, F.lit(r"<[^>]{1,80}>"), 0)
            tag_note = F.when(F.contains(token, F.lit("<")) & (F.size(tags) > 0), F.concat(F.lit("Removed tag(s) ['"), F.array_join(tags, "', '"), F.lit("'] from '"), token, F.lit("'")))

            def found(key: Column) -> Column:
                def build(standard: Column) -> Column:
                    cjk = ~ascii_only(plain) & plain.rlike("[一-鿿]")
                    return F.struct(
                        F.when(standard.isNotNull(), standard).when(cjk, plain).otherwise(_english(plain)).alias("standard_name"), plain.alias("original_text"),
                        standard.isNull().alias("uncertain"), (standard.isNull() & cjk).alias("needs_review"),
                        tag_note.alias("tag_note"), F.when(standard.isNotNull() & (own_key(standard) != key), F.concat(F.lit("Mapped '"), plain, F.lit("' -> '"), standard, F.lit("'"))).alias("map_note"),
                    )

                return let(F.try_element_at(names, key), build)

            return let(key_of(plain), found)

        return let(F.when(F.contains(token, F.lit("<")), strip(F.regexp_replace(token, r"<[^>]{1,80}>", ""))).otherwise(token), named)

    return F.filter(F.transform(tokens, one), lambda t: t["original_text"] != "")


def _key(said: str) -> str:
    """lookup_key for the constants, which hold no tags or quotes."""
    import re

    plain = re.sub(r"\([^)]*\)", "", said.strip().lower()).replace("/", " ")
    return " ".join(re.sub("[.:：]", " ", plain).split())


def _dictionary() -> list[tuple[str, str]]:
    return [(_key(k), v) for k, v in fixed.SYNONYMS]


def _standard_keys() -> list[tuple[str, str]]:
    return [(v, _key(v)) for v in dict.fromkeys(v for _, v in fixed.SYNONYMS)]


DICTIONARY = "synonym string, standard string, version int, position long"


def built_in_dictionary(spark: SparkSession) -> DataFrame:
    """D17 as version 1 of a dictionary table."""
    return spark.createDataFrame([(k, v, 1, n) for n, (k, v) in enumerate(fixed.SYNONYMS)], DICTIONARY)


def dictionary_names(dictionary: DataFrame, version: int | None = None) -> DataFrame:
    """key, standard of a dictionary table (DICTIONARY) up to a version: per lookup key what its newest version says, of one version the first position; a null standard takes the key out."""
    rows = dictionary if version is None else dictionary.filter(F.col("version") <= version)
    newest = rows.withColumn("key", lookup_key(F.col("synonym"))).groupBy("key").agg(F.max_by("standard", F.struct("version", (-F.col("position")).alias("p"))).alias("standard"))
    return newest.filter("standard is not null and key <> ''")


def _with_names(rows: DataFrame, dictionary: DataFrame) -> DataFrame:
    """rows, which have tokens and a row_id, with __names: the entries of the dictionary for their tokens. Each row's distinct keys are joined, broadcast or shuffled by the dictionary's size; row_id null stays unnamed."""
    keys = F.array_distinct(F.transform("tokens", lambda t: lookup_key(F.when(F.contains(t, F.lit("<")), strip(F.regexp_replace(t, r"<[^>]{1,80}>", ""))).otherwise(t))))
    asked = rows.filter("row_id is not null").select("row_id", F.explode(keys).alias("key")).distinct()
    met = asked.join(small(stored(dictionary, "dictionary")), "key")
    held = met.groupBy("row_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "standard"))).alias("__names"))
    return rows.join(held, "row_id", "left").withColumn("__names", F.coalesce("__names", F.create_map().cast("map<string,string>")))


def parsed(rows: DataFrame, raw: str = "raw_ingredient_text", dictionary: DataFrame | None = None) -> DataFrame:
    """Adds cleaned_text, parse_status, inci_list, inci, unrecognized, notes, parse_confidence and needs_review.

    dictionary: key, standard (dictionary_names) in place of the built-in one; rows then need a row_id.
    """
    outputs = ("cleaned_text", "parse_status", "inci_list", "inci", "unrecognized", "notes", "parse_confidence", "needs_review")
    keep = [c for c in rows.columns if c not in outputs]
    rows = rows.select(*keep, clean_with_notes(strip_label(meaningful(F.col(raw)))).alias("__c"))
    rows = tokenized(rows.select(*keep, F.col("__c.text").alias("cleaned_text"), F.col("__c.notes").alias("__notes")))
    if dictionary is not None:
        rows = _with_names(stored(rows, "tokens"), dictionary)
    names = None if dictionary is None else F.col("__names")

    def assembled(tokens: Column) -> Column:
        invalid = is_invalid_blob(F.col("cleaned_text")) | (F.size(tokens) == 0)

        def build(items: Column) -> Column:
            unknown = F.array_distinct(F.transform(F.filter(items, lambda t: t["uncertain"]), lambda t: t["original_text"]))
            review = F.transform(F.filter(items, lambda t: t["needs_review"]), lambda t: F.struct(t["original_text"].alias("original_text"), F.lit(NO_MAPPING).alias("issue")))
            notes = F.concat(F.col("__notes"), F.filter(F.flatten(F.transform(items, lambda t: F.array(t["tag_note"], t["map_note"]))), lambda n: n.isNotNull()))
            confidence = F.greatest(F.lit(0.0), F.round(1 - F.when(separator_failed(tokens), 0.5).otherwise(0.0) - F.size(review) * 0.1, 6))
            inci = F.transform(items, lambda t, i: F.struct((i + 1).cast("int").alias("order"), t["standard_name"].alias("standard_name"), t["original_text"].alias("original_text"), t["uncertain"].alias("uncertain"), t["needs_review"].alias("needs_review")))
            good = F.struct(
                F.when(confidence < 0.6, "NEEDS_REVIEW").otherwise("OK").alias("parse_status"), F.array_join(F.transform(items, lambda t: t["standard_name"]), "; ").alias("inci_list"), inci.alias("inci"),
                unknown.alias("unrecognized"), notes.alias("notes"), confidence.alias("parse_confidence"), review.alias("needs_review"),
            )
            none = F.struct(
                F.lit("NEEDS_SOURCE").alias("parse_status"), F.lit("").alias("inci_list"), F.array().cast(INCI).alias("inci"), F.array().cast("array<string>").alias("unrecognized"),
                F.array().cast("array<string>").alias("notes"), F.lit(0.0).alias("parse_confidence"), F.array().cast("array<struct<original_text:string,issue:string>>").alias("needs_review"),
            )
            return F.when(invalid, none).otherwise(good)

        return let(mapped(tokens, names), build)

    return rows.withColumn("__p", assembled(F.col("tokens"))).select(*keep, "cleaned_text", "__p.*")


def lean(rows: DataFrame) -> DataFrame:
    """Parsed rows without what `whole` makes again of their inci: three of six columns that are about as long as the text."""
    return rows.drop("inci_list", "unrecognized", "needs_review")


def whole(rows: DataFrame) -> DataFrame:
    """Lean rows with all columns of a parse."""
    of = lambda flag: F.filter("inci", lambda i: i[flag])
    return rows.withColumns({
        "inci_list": F.array_join(F.transform("inci", lambda i: i["standard_name"]), "; "), "unrecognized": F.array_distinct(F.transform(of("uncertain"), lambda i: i["original_text"])),
        "needs_review": F.transform(of("needs_review"), lambda i: F.struct(i["original_text"].alias("original_text"), F.lit(NO_MAPPING).alias("issue"))),
    })


def unrecognized_report(rows: DataFrame) -> DataFrame:
    """Per unrecognized token, the rows that have it and how often it occurs. rows: parsed and stored, for the filters that an explosion brings would parse again."""
    unknown = F.transform(F.filter("inci", lambda i: i["uncertain"]), lambda i: i["original_text"])
    per_row = rows.select(F.explode(let(unknown, lambda u: F.transform(F.array_distinct(u), lambda t: F.struct(t.alias("token"), F.size(F.filter(u, lambda x: x == t)).alias("k"))))).alias("t"))
    return per_row.groupBy("t.token").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("t.k").alias("n_occurrences"))


#: Buckets of a sketch as a power of two: estimates are within 1.6 % in two of three cases, and exact for few rows.
SKETCH_BITS = 12


def unrecognized_sketches(rows: DataFrame, by: str = "import_id") -> DataFrame:
    """I7 as a table that later runs add to: per token and import a distinct sketch of its rows, and how often it occurs. rows: parsed and stored."""
    said = rows.select(by, "row_id", F.explode(F.transform(F.filter("inci", lambda i: i["uncertain"]), lambda i: i["original_text"])).alias("token"))
    return said.groupBy("token", by).agg(F.hll_sketch_agg("row_id", F.lit(SKETCH_BITS)).alias("rows_sketch"), F.count(F.lit(1)).alias("n_occurrences"))


def merged_sketches(*tables: DataFrame, by: tuple[str, ...] = ("token",)) -> DataFrame:
    """Tables of sketches put together: per token (and what else is in `by`) the union of its sketches, the estimated rows and the occurrences. A row that several tables hold counts once, its occurrences as often as they were counted."""
    both = tables[0]
    for t in tables[1:]:
        both = both.unionByName(t)
    out = both.groupBy(*by).agg(F.hll_union_agg("rows_sketch").alias("rows_sketch"), F.sum("n_occurrences").alias("n_occurrences"))
    return out.withColumn("n_rows", F.hll_sketch_estimate("rows_sketch"))
