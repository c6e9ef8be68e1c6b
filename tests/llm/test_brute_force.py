"""The corpus operators and the stages of the pipeline against plain Python that states the same rules over again."""

from __future__ import annotations

import collections
import datetime
import hashlib
import itertools
import math
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from larkspur.llm import decontaminate, licenses, mixing, near_dup, pii, quality
from tests.conftest import SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")
KEY = "k"


def plain(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def shingle_list(words, size=5):
    return [tuple(words[k : k + size]) for k in range(len(words) - size + 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def items(spark):
    return {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}


# ---------------------------------------------------------------- pseudonyms


def feistel(v, radix, tag):
    v, half = list(v), len(v) // 2
    for r in range(pii.ROUNDS):
        left = r % 2 == 0
        other = ",".join(map(str, v[half:] if left else v[:half]))
        for i in range(half) if left else range(half, len(v)):
            said = "|".join([KEY, tag, str(r), str(i), str(len(v)), other])
            v[i] = (v[i] + int(hashlib.sha256(said.encode()).hexdigest()[:12], 16)) % radix[i]
    return v


def permuted(text, movable, tag):
    at = [k for k, c in enumerate(text) if movable(k) and re.match("[A-Za-z0-9]", c)]
    code = lambda c: ord(c) - 48 if c.isdigit() else ord(c.lower()) - 97
    new = feistel([code(text[k]) for k in at], [10 if text[k].isdigit() else 26 for k in at], tag) if at else []
    out = list(text)
    for k, x in zip(at, new, strict=True):
        out[k] = chr(x + (48 if text[k].isdigit() else 97 if text[k].islower() else 65))
    return "".join(out)


def luhn(digits):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(digits))) % 10


def mod97(iban):
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def some_date(m):
    a, b, c = (int(x) for x in re.split("[./-]", m))
    sep, year_first = re.search("[./-]", m)[0], re.match("[0-9]{4}", m)
    day_first = not year_first and (sep == "." or a > 12)
    y, mo, d = (a, b, c) if year_first else (c, b, a) if day_first else (c, a, b)
    try:
        n = (datetime.date(y, mo, d) - datetime.date(1900, 1, 1)).days
    except ValueError:
        return m
    v = [n // 4297, n % 4297]
    while True:
        v = feistel(v, [17, 4297], "date")
        t = datetime.date(1900, 1, 1) + datetime.timedelta(v[0] * 4297 + v[1])
        if (t.day > 12) == (d > 12):
            break
    parts = (f"{t.year}", f"{t.month:02}", f"{t.day:02}") if year_first else (f"{t.day:02}", f"{t.month:02}", f"{t.year}") if day_first else (f"{t.month:02}", f"{t.day:02}", f"{t.year}")
    return sep.join(parts)


def pseudonym(m, kind):
    if kind == "email":
        return permuted(m, lambda k: k < m.rindex("."), "email")
    if kind == "iban":
        if mod97(m.replace(" ", "")) != 1:
            return m
        body = permuted(m[4:], lambda k: True, "iban")
        return m[:2] + f"{98 - mod97(m[:2] + '00' + body.replace(' ', '')):02}" + body
    if kind == "card":
        if luhn(re.sub("[^0-9]", "", m)):
            return m
        body = permuted(m[:-1], lambda k: k > 0, "card")
        return body + str((10 - luhn(re.sub("[^0-9]", "", body) + "0")) % 10)
    if kind == "ssn":
        a, g, s = map(int, m.split("-"))
        if not (0 < a < 900 and a != 666 and g and s):
            return m
        a, g, s = feistel([a - (1 if a < 666 else 2), g - 1, s - 1], [898, 99, 9999], "ssn")
        return f"{a + (1 if a < 665 else 2):03}-{g + 1:02}-{s + 1:04}"
    if kind == "ip":
        return ".".join(map(str, feistel(list(map(int, m.split("."))), [256] * 4, "ip")))
    if kind == "date":
        return some_date(m)
    digits = re.sub("[^0-9]", "", m)
    code = 0
    if m.startswith("+"):
        two = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
        code = 1 if digits[0] in "17" else 2 if digits[:2] in two else 3
    place = [len(re.sub("[^0-9]", "", m[: k + 1])) for k in range(len(m))]
    return permuted(m, lambda k: place[k] > code, "phone") if 8 <= len(digits) <= 15 else m


def replaced(text):
    pattern = re.compile("|".join(f"(?P<{k}>{p})" for k, p in pii.KINDS.items()))
    said = [0]

    def one(m):
        new = pseudonym(m[0], m.lastgroup)
        said[0] += new != m[0]
        return new

    return (None if text is None else pattern.sub(one, text)), said[0]


PERSONAL = [
    "ES91 2100 0418 4502 0005 1332 EUR", "ES9121000418450200051332", "pay DE89 3704 0044 0532 0130 00 NOW", "NO93 8601 1117 947", "MT84 MALT 0110 0001 2345 MTLC AST0 01S", "DE89 3704 0044 0532 0130 01", "at 2023-01-02T10:00:00Z",
    "31/12/1999 and 12/31/1999 and 31-12-1999 and 2/3", "13/01/2001 14/01/2001", "1999/12/31 1999.12.31 2023-02-30 29/02/2001 29/02/2000", "4111 1111 1111 1111 4111-1111-1111-1112", "a.b@c.example.org, +44 20 7946 0958", "10.0.0.1 999.1.1.1", "(555) 123-4567 555-123-4567", "078-05-1120 000-12-1234", "", None, "x" * 300_000 + " a@b.example.com",
]


def test_pseudonyms(spark, docs):
    rows = [(k, t) for k, t in enumerate(PERSONAL)] + [(r["doc_id"] + 100, r["text"]) for r in docs.collect()] + [(None, PERSONAL[0]), (3, PERSONAL[3]), (3, PERSONAL[3])]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, n_replaced string, __new string")
    made = pii.pseudonymised(df, KEY)
    got = collections.Counter(map(tuple, made.select("doc_id", "text", "n_replaced").collect()))
    assert set(made.columns) == {"doc_id", "text", "n_replaced", "__new"} and {r["__new"] for r in made.select("__new").collect()} == {"y"}
    assert got == collections.Counter((i, *replaced(t)) for i, t in rows)
    changed = {t: replaced(t)[1] for t in PERSONAL if t and len(t) < 200}
    assert changed["ES91 2100 0418 4502 0005 1332 EUR"] == changed["at 2023-01-02T10:00:00Z"] == 1 and changed["31/12/1999 and 12/31/1999 and 31-12-1999 and 2/3"] == 3 and changed["DE89 3704 0044 0532 0130 01"] == 0
    assert replaced("13/01/2001 14/01/2001")[0].split()[0] != replaced("13/01/2001 14/01/2001")[0].split()[1]
    with pytest.raises(ValueError, match="key"):
        pii.pseudonymised(df, "")


SPELLINGS = [
    ["+1 415 555 2671", "+14155552671", "+1 (415) 555-2671", "+1-415-555-2671", "(415) 555-2671", "415-555-2671", "415.555.2671"], ["+44 20 7946 0958", "+442079460958", "+44 (20) 7946 0958"], ["+351 212 345 678", "+351212345678"],
    ["2020-05-13", "13/05/2020", "05/13/2020", "13.05.2020", "2020/05/13", "13-05-2020", "2020.05.13"], ["2020-05-04", "05/04/2020", "04.05.2020"], ["4111 1111 1111 1111", "4111111111111111", "4111-1111-1111-1111"], ["DE89 3704 0044 0532 0130 00", "DE89370400440532013000"], ["Jane.Roe@Example.org", "jane.roe@example.org"],
]


def test_spellings_stay_linked(spark):
    """All spellings of a value become spellings of one pseudonym."""

    def value(kind, text):
        if kind in (3, 4):
            a, b, c = (int(x) for x in re.split("[./-]", text))
            sep = re.search("[./-]", text)[0]
            return (a, b, c) if a > 999 else (c, b, a) if sep == "." or a > 12 else (c, a, b)
        kept = re.sub("[^0-9A-Za-z@]", "", text).lower()
        return kept[-10:] if kind == 0 else kept

    flat = [(k, t) for k, ts in enumerate(SPELLINGS) for t in ts]
    got = {r["text"]: r["new"] for r in pii.pseudonymised(spark.createDataFrame([(k, t, t) for k, t in flat], "doc_id long, text string, new string"), KEY, text="new").collect()}
    for k, ts in enumerate(SPELLINGS):
        assert len({value(k, got[t]) for t in ts}) == 1 and all(got[t] != t for t in ts), [got[t] for t in ts]


# ---------------------------------------------------------------- benchmark leaks


def weighted(words, rarity, unseen):
    bag = collections.Counter(shingle_list(words))
    return {s: n * rarity.get(s, unseen) for s, n in bag.items()}


def similarity(a, b):
    both = sum(min(a[s], b[s]) for s in a.keys() & b.keys())
    return both / (sum(a.values()) + sum(b.values()) - both)


def true_leaks(texts, items):
    """(doc, item) -> the greatest similarity of any window of the item's length."""
    bags = {i: set(shingle_list(plain(t))) for i, t in items.items() if len(plain(t)) >= 5}
    held = collections.Counter(s for b in bags.values() for s in b)
    rarity, unseen = {s: 1 + math.log((1 + len(bags)) / (1 + n)) for s, n in held.items()}, 1 + math.log(1 + len(bags))
    own, out = {i: weighted(plain(items[i]), rarity, unseen) for i in bags}, {}
    for d, t in texts.items():
        words = plain(t)
        said = shingle_list(words)
        for i, b in bags.items():
            if len(b.intersection(said)) < 0.3 * len(b):
                continue
            n = len(plain(items[i]))
            best = max((similarity(weighted(words[k : k + n], rarity, unseen), own[i]) for k in range(max(1, len(words) - n + 1))), default=0)
            if best >= 0.8 - 1e-9:
                out[d, i] = best
    return out


def edited(words, rng, edits):
    words = list(words)
    for _ in range(edits):
        k = rng.randrange(len(words))
        kind = rng.randrange(3)
        words[k : k + 1] = [f"q{rng.randrange(99)}"] if kind == 0 else [] if kind == 1 else [words[k], "extra"]
    return words


def test_edited_passages_are_caught(spark, items):
    """Windows with up to three edits; a fingerprint misses some of those that are barely similar."""
    rng, texts = random.Random(11), {}
    for d in range(400):
        words = edited(plain(items[rng.choice(sorted(items))]), rng, rng.randrange(4))
        texts[d] = " ".join([f"a{rng.randrange(10**6)}" for _ in range(rng.randrange(60))] + words + [f"b{rng.randrange(10**6)}" for _ in range(rng.randrange(60))])
    want = true_leaks(texts, items)
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.leaks(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), bench).collect()}
    assert got.keys() <= want.keys() and all(v <= want[k] + 1e-6 for k, v in got.items())
    share = lambda lo, hi: sum(k in got for k, v in want.items() if lo <= v < hi) / max(1, sum(lo <= v < hi for v in want.values()))
    assert len(want) > 120 and share(0.8, 2) >= 0.97 and share(0.9, 2) >= 0.99


def test_leaks_of_odd_rows(spark):
    words = [f"w{k}" for k in range(40)]
    passage, other = " ".join(words[:20]), " ".join(words[20:])
    rows = [(None, f"x y {passage} z"), (None, f"x y {passage} z"), (None, f"p {passage}"), (1, passage), (1, "clean text of no passage at all"), (2, None), (3, ""), (4, " ".join(["same"] * 3000)), (5, " ".join([passage] * 2)), (5, " ".join([passage] * 2)), (6, "q " * 60_000 + other)]
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], "doc_id long, text string, start string, none int")
    bench = spark.createDataFrame([(1, passage), (2, other), (2, other), (3, "too short"), (4, None), (5, " ".join(["same"] * 12))], "item_id long, text string")
    got = collections.Counter((r["doc_id"], r["item_id"]) for r in decontaminate.leaks(df, bench).collect())
    assert got == {(None, 1): 2, (1, 1): 1, (4, 5): 1, (5, 1): 1, (6, 2): 1}
    assert decontaminate.leaks(df.limit(0), bench).count() == 0 and decontaminate.leaks(df, bench.limit(0)).count() == 0


def test_near_prints_by_brute_force(spark):
    """Every pair of fingerprints within the radius, and no other."""
    rng, long = random.Random(3), lambda x: x - (x >> 63 << 64)
    bits = [rng.getrandbits(64) for _ in range(60)]
    own = bits[:5] + [b ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(20))) for b in bits for _ in range(10)]
    want = {(long(a), long(b)) for a in own for b in bits if (a ^ b).bit_count() <= decontaminate.RADIUS}
    near = decontaminate.near_prints(spark.createDataFrame(sorted({(long(a),) for a in own}), "own long"), spark.createDataFrame([(long(b),) for b in bits], "bits long"))
    rows = near.collect()
    assert {(r["own"], b) for r in rows for b in r["near"]} == want and len(rows) == len({r["own"] for r in rows}) and len(want) > 400


def test_phrases_of_many_items_lay_no_windows_alone(spark):
    """A phrase that all items share is in no leak by itself; items around it are still found, from few words on either side."""
    phrase = "which of the following statements is true about the given passage"
    items = {k: f"{phrase} {' '.join(f'w{k}x{j}' for j in range(8 + k % 5))}" for k in range(60)}
    texts = {d: f"intro {d} {phrase} and then something else {d}" for d in range(20)} | {100 + k: f"before {d} {t} after it" for d, (k, t) in enumerate(items.items())} | {300: " ".join([phrase] * 200)}
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.leaks(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string")).collect()}
    assert got == pytest.approx(true_leaks(texts, items)) and {(100 + k, k) for k in items} == got.keys()


def test_items_of_few_words(spark):
    """They are found where their words stand in a row, from `shortest` words on; items of one id are told apart."""
    docs = spark.createDataFrame([(1, "He said: Yes, indeed so!"), (2, "indeed, yes"), (3, "one two three four five"), (3, "one two three four five"), (4, None), (5, ""), (None, "so, one two THREE four")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "yes indeed"), (2, "one two three four"), (3, "so"), (4, ""), (5, None), (6, "yes no"), (7, "two three four five"), (7, "yes"), (7, "a text of many words that no document holds"), (None, "said yes")], "item_id long, text string")
    found = [(r["doc_id"], r["item_id"], r["start"], r["n_words"], r["similarity"]) for r in decontaminate.leaks(docs, bench).collect()]
    assert sorted(found, key=str) == sorted([(1, 1, 2, 2, 1.0), (3, 2, 0, 4, 1.0), (None, 2, 1, 4, 1.0), (1, 3, 4, 1, 1.0), (None, 3, 0, 1, 1.0), (3, 7, 1, 4, 1.0), (1, 7, 2, 1, 1.0), (2, 7, 1, 1, 1.0), (1, None, 1, 2, 1.0)], key=str)
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, bench, shortest=3).collect()} == {(3, 2), (None, 2), (3, 7)}
    assert decontaminate.leaks(docs, bench, shortest=5).count() == 0


# ---------------------------------------------------------------- licenses


def true_licenses(texts, known):
    out = {}
    for d, t in texts.items():
        said = shingle_list(plain(t))
        for name, listed in known.items():
            for template in listed:
                ts = set(shingle_list(plain(template)))
                half = licenses.window_length(len(plain(template)) - 4)
                for at in range(0, max(1, len(said)), half):
                    share = len(ts.intersection(said[at : at + 2 * half])) / len(ts)
                    if share >= 0.8:
                        out[d, name] = max(out.get((d, name), 0), share)
    return out


def test_licenses(spark, docs):
    known, rng = licenses.templates(), random.Random(5)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for k, (name, listed) in enumerate(sorted(known.items())):
        words = plain(listed[-1])
        texts[10_000 + k] = " ".join(["before"] * rng.randrange(900) + edited(words, rng, len(words) // 60) + ["after"] * 50)
        texts[20_000 + k] = " ".join(words[: len(words) // 2]) + " it goes on in another way"
    got = {(r["doc_id"], r["license"]): r["containment"] for r in licenses.scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    want = true_licenses(texts, known)
    assert got == pytest.approx(want) and sum(d >= 10_000 for d, _ in want) >= 15 and len({n for d, n in want if d < 10_000}) >= 3


def test_licenses_of_odd_rows(spark):
    mit = licenses.templates()["mit"]
    rows = [(None, mit[0]), (None, mit[0]), (None, "x " + mit[0]), (1, mit[1]), (1, mit[1]), (1, "nothing"), (2, None), (3, ""), (4, "filler " * 50_000 + mit[1])]
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], "doc_id long, text string, license string, half int")
    got = collections.Counter((r["doc_id"], r["license"], r["template"]) for r in licenses.scan(df).collect() if r["license"] == "mit")
    assert got == {(None, "mit", 0): 2, (1, "mit", 1): 1, (4, "mit", 1): 1}
    assert licenses.scan(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="fewer"):
        licenses.scan(df, known={"short": ["MIT"]})


# ---------------------------------------------------------------- mixing, repetition


def true_targets(sizes):
    """Water filling, one cap after another."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-32-be")) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    target, open_, left = {}, set(names), 1.5 * sum(sizes.values())
    while open_:
        share = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if 2 * sizes[s] < share * weight[s]}
        if not full:
            return target | {s: share * weight[s] for s in open_}
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def test_targets(spark, docs):
    small = spark.createDataFrame([(k, "w " * n, s) for k, (n, s) in enumerate([(3, "a"), (400, "b"), (1, "c"), (50, None), (0, "z"), (20, "\U00010000"), (20, "￿")])], "doc_id long, text string, source string")
    for df in (docs, small):
        rows = mixing.mixed(df).collect()
        sizes = collections.Counter()
        for r in df.collect():
            sizes[r["source"]] += len(WORD.findall(r["text"] or ""))
        want = true_targets(dict(sizes))
        assert {r["source"]: r["target"] for r in rows} == pytest.approx(want) and {r["source"]: r["source_size"] for r in rows} == dict(sizes)
        assert all(r["size"] == len(WORD.findall(t or "")) for r, t in zip(sorted(rows, key=lambda r: r["doc_id"]), [x["text"] for x in sorted(df.collect(), key=lambda r: r["doc_id"])], strict=True))


def test_mix_of_equal_ids_agrees_on_reruns(spark):
    rows = [(k % 3, f"{'w ' * 5}{k}", "s") for k in range(60)] + [(1, "same text here", "s")] * 7 + [(None, "x y", "s")] * 3
    df = spark.createDataFrame([(*r, 9, "z") for r in rows], "doc_id long, text string, source string, size int, taken string")
    one, two = (collections.Counter((r["doc_id"], r["text_key"], r["taken"]) for r in mixing.mixed(df.repartition(n), block_rows=8).collect()) for n in (1, 5))
    assert one == two and sum(one.values()) == len(rows)


def covered_words(w, least=10):
    """Words in repeats of `least` words or more, and the longest repeat, from all pairs of places."""
    n = len(w)
    longest, cover = 0, set()
    run = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        new = [0] * (n + 1)
        for j in range(n - 1, i, -1):
            if w[i] == w[j]:
                new[j] = run[j + 1] + 1
                longest = max(longest, new[j])
                if new[j] >= least:
                    cover.update(range(i, i + new[j]), range(j, j + new[j]))
        run = new
    return len(cover), longest


def test_repetition(spark, docs):
    rng = random.Random(3)
    texts = [r["text"] for r in docs.collect() if r["text"] and len(r["text"].split()) < 400][:60]
    for _ in range(30):
        part = [rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(rng.randrange(5, 60))]
        texts.append(" ".join(part + [f"u{rng.random()}" for _ in range(rng.randrange(150))] + part * rng.randrange(4)))
    texts += ["one " * 5000, "long " * 60 + "x" * 200_000, " ".join(f"n{k}" for k in range(230)) * 2]
    got = {r["id"]: r for r in quality.repetition(spark.createDataFrame(list(enumerate(texts)), "id long, text string")).collect()}
    for k, t in enumerate(texts):
        w, r = WORD.findall(t), got[k]
        if len(w) <= 1000:
            cover, longest = covered_words(w)
            assert (r["n_covered_words"], r["longest_repeat"]) == (cover, longest)
        assert r["kept"] == (not r["base_failed"] and r["n_covered_words"] <= 0.3 * len(w) and r["longest_repeat"] <= 200)
    assert len({r["kept"] for r in got.values()}) == 2


# ---------------------------------------------------------------- the pipeline


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, kept string, size string, target map<string,int>"


@pytest.fixture(scope="module")
def odd(spark, items):
    """Nulls in each column, empty and very long texts, ties, repeated rows, extra columns whose names clash."""
    rng = random.Random(8)
    text = lambda n, tag="": " ".join(f"{tag}{rng.randrange(10**7):x}" for _ in range(n))
    base, near = text(200), text(200)
    leak = f"{text(60)} {items[min(items)]} {text(30)}"
    mail = f"{text(70)} write to jane.roe@example.org"
    rows = [
        (1, base), (2, base), (2, base), (2, text(80)), (3, near), (4, near + " more"), (None, base), (None, near), (None, near), (5, None), (6, ""), (7, " \n"), (8, "too short"), (9, leak), (9, text(90)), (None, leak), (10, mail), (10, mail),
        (11, "again and " * 400), (12, text(30_000)), (None, None), (13, mail + " a"),
    ]
    made = [(i, t, None if k % 3 else "en", [None, "a", "b"][k % 3], None if k % 4 == 0 else k, "keep", "big", {"k": k}) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(made, COLUMNS)


def bag(df):
    return collections.Counter((r["doc_id"], r["text"], r["source"], r["n_chars"], r["kept"], r["size"], str(r["target"])) for r in df.collect())


def rows_of(df):
    return [(r["doc_id"], r["text"], r) for r in df.collect()]


def test_stage_of_quality_rules(spark, odd):
    got = corpus_pipeline.quality_rules(spark, odd, SF)
    fine = {r["text"] for r in quality.repetition(odd.select("text").distinct()).filter("kept").collect()}
    assert got.columns == odd.columns and bag(got) == bag(odd.filter(F.col("text").isin(list(fine)))) and len(fine) >= 5


def test_stage_of_near_duplicates(spark, odd):
    got = corpus_pipeline.near_duplicates(spark, odd, SF)
    said = lambda t: t if WORD.search(t or "") else ""
    held = sorted({(i, said(t)) for i, t, _ in rows_of(odd) if i is not None})
    shingled = {t: collections.Counter(shingle_list(WORD.findall(t)) or [tuple(WORD.findall(t))]) for _, t in held}
    alike = lambda a, b: a == b or bool(a and b) and 0.8 * sum((shingled[a] | shingled[b]).values()) <= sum((shingled[a] & shingled[b]).values())
    gone = {i for (i, t), (j, u) in itertools.product(held, held) if j < i and alike(t, u)}
    want = {i for i, _ in held} - gone
    ids = collections.Counter(i for i, _, _ in rows_of(got))
    assert got.columns == odd.columns and {i for i in ids if i is not None} == want and all(ids[i] == 1 for i in want)
    # rows without an id go with the classes of those that have one
    bare = {said(t) for i, t, _ in rows_of(odd) if i is None}
    shingled |= {t: collections.Counter(shingle_list(WORD.findall(t)) or [tuple(WORD.findall(t))]) for t in bare}
    assert ids[None] == sum(not any(alike(t, u) for _, u in held) for t in bare)


def test_near_copies_without_ids(spark):
    """Rows without an id are linked among themselves; one of each class stays."""
    rng = random.Random(12)
    one, two = (" ".join(f"{rng.randrange(10**6)}" for _ in range(100)) for _ in range(2))
    texts = [(None, one), (None, one + " x"), (None, one + " x y"), (None, two), (None, two), (7, two + " z"), (None, None), (None, ""), (8, "some other text of several words")]
    df = spark.createDataFrame([(i, t, None, None, k, "k", "s", None) for k, (i, t) in enumerate(texts)], COLUMNS)
    got = near_dup.near_duplicates(df).collect()
    assert collections.Counter((r["doc_id"], r["class_id"]) for r in got) == collections.Counter({(None, None): 5, (None, 7): 2, (7, 7): 1, (8, 8): 1})
    for n in (1, 4):
        stay = corpus_pipeline.near_duplicates(spark, df.repartition(n), SF)
        assert sorted((r["doc_id"] or 0, r["text"] or "") for r in stay.collect()) == sorted([(0, one), (0, ""), (7, two + " z"), (8, "some other text of several words")])


def test_stage_of_decontamination(spark, odd, items):
    got = corpus_pipeline.decontamination(spark, odd, SF)
    holds = lambda t: any(x and len(plain(x)) >= 5 and x in (t or "") for x in items.values())
    want = collections.Counter((i, t) for i, t, _ in rows_of(odd) if not holds(t))
    assert got.columns == odd.columns and collections.Counter((i, t) for i, t, _ in rows_of(got)) == want and sum(want.values()) == odd.count() - 2


def test_stage_of_pseudonyms(spark, odd):
    spark.conf.set(corpus_pipeline.KEY_SETTING, KEY)
    got = corpus_pipeline.pseudonyms(spark, odd, SF)
    want = collections.Counter((r["doc_id"], replaced(t)[0], r["source"], r["n_chars"], r["kept"], r["size"], str(r["target"])) for _, t, r in rows_of(odd))
    assert got.columns == odd.columns and bag(got) == want and sum(replaced(t)[1] for _, t, _ in rows_of(odd)) >= 3
    spark.conf.unset(corpus_pipeline.KEY_SETTING)
    assert len(corpus_pipeline.pii_key(spark)) == 64 and corpus_pipeline.pii_key(spark) == corpus_pipeline.pii_key(spark)


def test_stage_of_mixing(spark, odd):
    got = corpus_pipeline.mix(spark, odd, SF).collect()
    plan = mixing.mixed(odd).collect()
    sign = lambda t: xxhash.xxh64_intdigest((t or "").encode(), 42)
    want = collections.Counter((r["doc_id"], r["text_key"] % 2**64, r["source"], r["copies"], r["taken"]) for r in plan if r["taken"])
    assert collections.Counter((r["doc_id"], sign(r["text"]), r["source"], r["copies"], r["taken"]) for r in got) == want
    assert all(r["taken"] == r["copies"] * r["size"] and r["size"] == len(WORD.findall(r["text"])) and r["copies"] <= 2 for r in got)


def test_reruns_agree_in_all_columns(spark):
    """Rows that tie in id, text and source, in three orders over differently many partitions."""
    rng = random.Random(5)
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(80))
    rows = [(k // 8 if k < 40 else None, long if k % 2 else "a few words here", "en", "s", k, f"k{k}", f"s{k}", {"b": k, "a": 1}) for k in range(60)]
    for stage in (corpus_pipeline.near_duplicates, corpus_pipeline.mix):
        found = []
        for n in (1, 3, 7):
            rng.shuffle(rows)
            found.append(collections.Counter(tuple(str(r[c]) for c in ("doc_id", "text", "n_chars", "kept", "target", *(["copies"] if "copies" in r else []))) for r in stage(spark, spark.createDataFrame(rows, COLUMNS).repartition(n), SF).collect()))
        assert found[0] == found[1] == found[2] and found[0]


def test_stages_of_empty_tables(spark, odd):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.limit(0), SF).count() == 0, name
