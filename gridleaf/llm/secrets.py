"""Secret scans with DataFrame functions only.

Base spans are the matches of fixed patterns. The battery adds spans of kind
"random": words of twenty characters and more, tested by their inferred
encoding (hex, base32 of either case, base64 and its URL form). Each test gives
an e-value, the likelihood ratio of its statistic in uniformly random words
against ordinary ones, of which the likeliest kind counts:

* uniformity of the alphabet: the counts of letters and of character classes,
  under the encoding's even rates against those of prose, names, constants,
  numbers and identifiers; the chi-squared statistic of the whole alphabet
  besides, which is standard normal in random words;
* runs: the changes of character class, binomial at the encoding's own rate
  against the rate of ordinary words; runs about the alphabet's median besides;
* serial correlation: the changes between vowels and consonants of neighbours,
  which alternate in ordinary words; the correlation of neighbours' values; and
  equal characters at each of the first lags, which tell a word that repeats itself.

The three besides can hardly speak for a word, but strongly against it, being
compared with a statistic five times as wide.

Their product is the word's e-value. Its inverse bounds an ordinary word's
p-value (Markov's inequality) and goes through a weighted Benjamini-Hochberg
step in each document, weights being proportional to the length of the word, so
that long words need less evidence and the share of false finds stays bounded.

Defined results: null texts are empty texts; empty texts have no spans; very
long texts are read whole, their matches placed in blocks; words of equal
evidence are let through together; rows are independent, so repeated rows
repeat their result; empty tables give empty results; other columns are
ignored, whatever their names. Positions are code points.
"""

from __future__ import annotations

import math
import operator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds, in their order, with pattern, the group whose length counts, and its least length.
KINDS = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
)
#: Maximal runs that the same kind's pattern takes whole, so that short ones need not be listed.
FAST = {"access": r"AKIA[A-Z0-9]{14,}", "hex": r"[0-9a-f]{16,}"}
#: A run of the base64url alphabet is one word, unless a piece between its hyphens is a long hex or base32 word itself.
CANDIDATE = (
    r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9_-]*+=*+(?![A-Za-z0-9+/_=-]))"
    r"(?![A-Za-z0-9_-]*?(?<![A-Za-z0-9_])(?:[0-9a-f]{20,}|[0-9A-F]{20,}|[A-Z2-7]{20,})(?![A-Za-z0-9_]))[A-Za-z0-9_=-]{20,}"
    r"|(?<![A-Za-z0-9+/_=])[A-Za-z0-9+/_=]{20,}"
)
#: Inferred encodings: pattern and alphabet; the first that fits counts.
ENCODINGS = (
    ("hex", r"^[0-9a-f]+$|^[0-9A-F]+$", "0123456789abcdef"),
    ("base32", r"^[A-Z2-7]+=*$|^[a-z2-7]+=*$", "abcdefghijklmnopqrstuvwxyz234567"),
    ("base64", r"^[A-Za-z0-9+/_]+=*$|^[A-Za-z0-9_-]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
)
#: Rate at which ordinary words of each encoding's alphabet change character class between neighbours.
WORD_RATE = {"hex": 0.06, "base32": 0.06, "base64": 0.16}
#: The same rate of uniformly random words.
RANDOM_RATE = {"hex": 2 * 10 * 6 / 16**2, "base32": 2 * 26 * 6 / 32**2, "base64": 1 - (26**2 + 26**2 + 10**2 + 2**2) / 64**2}
#: Character classes (lower, upper, digit, sign) of each alphabet, and their shares in kinds of ordinary words; alphabets of one case have their letters under lower.
CLASSES = {"hex": (6, 0, 10, 0), "base32": (26, 0, 6, 0), "base64": (26, 26, 10, 2)}
SHARES = {
    "hex": ((0.05, 1, 0.95, 1), (0.95, 1, 0.05, 1), (0.5, 1, 0.5, 1)),
    "base32": ((0.98, 1, 0.02, 1), (0.4, 1, 0.6, 1)),
    "base64": ((0.93, 0.02, 0.03, 0.02), (0.02, 0.93, 0.03, 0.02), (0.05, 0.05, 0.88, 0.02), (0.72, 0.12, 0.08, 0.08), (0.4, 0.1, 0.4, 0.1)),
}
#: Rates at which neighbouring letters change between vowel and consonant in random and in ordinary words; hex has too few letters to tell.
VOWELS, VOWEL_RATE = 5 / 26, 0.68
#: Lags of the search for repeats, and the share of equal characters at the lag of a word that repeats itself.
LAGS, EQUAL = 24, 0.9
#: Letters a to z of ordinary words, in thousandths; a tenth of the weight is spread evenly, as languages differ.
LETTERS = (82, 15, 28, 43, 127, 22, 20, 61, 70, 2, 8, 40, 24, 67, 75, 19, 1, 60, 63, 91, 28, 10, 24, 2, 20, 1)
EVEN = 0.1
#: Standard deviation of a test's statistic in words of a pattern, level of the false-discovery control, and matches placed at once.
WIDE, FALSE_SHARE, BLOCK = 5.0, 0.01, 64


def _occurs(text: Column, pattern: str) -> Column:
    """Whether a pattern matches; characters that every match holds are looked for first."""
    signs = {KINDS[0][1]: (":", "="), FAST["access"]: ("AKIA",)}.get(pattern, ())
    found = text.rlike(pattern)
    if signs:
        found = reduce(operator.or_, (F.contains(text, F.lit(c)) for c in signs)) & found
    return found


def _located(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<s, e, m, g>>: matches with code-point positions, from the
    lengths of the pieces between them; read only where the pattern occurs."""
    found, pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    groups = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    rows = F.slice(F.arrays_zip(F.transform(pieces, F.char_length).alias("gap"), found.alias("m"), groups.alias("g")), 1, F.size(found))
    kind = "STRUCT<s: INT, e: INT, m: STRING, g: STRING>"
    empty = F.expr(f"CAST(ARRAY() AS ARRAY<{kind}>)")

    def step(acc, row):
        s = acc["at"] + row["gap"]
        e = s + F.char_length(row["m"])
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e"), row["m"].alias("m"), row["g"].alias("g")))).alias("out"))

    # Arrays grow inside blocks only; a fold over the blocks then moves each to its place.
    starts = F.sequence(F.lit(1), F.greatest(F.size(found), F.lit(1)), F.lit(BLOCK))
    blocks = F.transform(starts, lambda i: F.aggregate(F.slice(rows, i, BLOCK), F.struct(F.lit(0).alias("at"), empty.alias("out")), step))

    def moved(acc, block):
        there = F.transform(block["out"], lambda x: F.struct((x["s"] + acc["at"]).alias("s"), (x["e"] + acc["at"]).alias("e"), x["m"].alias("m"), x["g"].alias("g")))
        return F.struct((acc["at"] + block["at"]).alias("at"), F.concat(acc["out"], F.array(there)).alias("out"))

    state = F.struct(F.lit(0).alias("at"), F.expr(f"CAST(ARRAY() AS ARRAY<ARRAY<{kind}>>)").alias("out"))
    walked = F.aggregate(blocks, state, moved, lambda acc: F.flatten(acc["out"]))
    return F.when(_occurs(text, pattern), walked).otherwise(empty)


def _value_in(alphabet: str):
    return lambda c: F.call_function("instr", F.lit(alphabet), c).cast("double")


def _count_in(word: Column):
    return lambda c: (F.char_length(word) - F.char_length(F.replace(word, c))).cast("double")


def _crosses(mean: float):
    return lambda x, y: ((x > mean) != (y > mean)).cast("double")


def _product_about(mean: float):
    return lambda x, y: (x - mean) * (y - mean)


def _changes(word: Column) -> Column:
    """Neighbours of different character class: lower a, upper A, digit 0, other +."""
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(word, "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "0")
    return (F.size(F.regexp_extract_all(kinds, F.lit("a+|A+|0+|[^aA0]+"), F.lit(0))) - 1).cast("double")


def _held(word: Column, pattern: str) -> Column:
    """The number of a word's characters that a pattern takes."""
    return (F.char_length(word) - F.char_length(F.regexp_replace(word, pattern, ""))).cast("double")


def _binomial_odds(hits: Column, n: Column, random: float, ordinary: float) -> Column:
    return hits * math.log(random / ordinary) + (n - hits) * math.log((1 - random) / (1 - ordinary))


def _class_odds(body: Column, name: str) -> Column:
    """Log likelihood ratio of the counts of character classes, against the likeliest kind of ordinary word."""
    counts = [_held(body, c) for c in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]")]
    total = sum(CLASSES[name])
    logs = lambda shares: reduce(operator.add, (n * math.log(x) for n, x in zip(counts, shares, strict=True) if 0 < x < 1))
    kinds = [logs(shares) for shares in SHARES[name]]
    return logs([n / total for n in CLASSES[name]]) - F.greatest(*kinds)


def _vowel_odds(body: Column) -> Column:
    """Log likelihood ratio of the changes between vowels and consonants among neighbouring letters."""
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(body), "[^a-z]", "."), "[aeiou]", "1"), "[a-z]", "2")
    pairs = _held(kinds, "[12]") - F.size(F.regexp_extract_all(kinds, F.lit("[12]+"), F.lit(0)))
    return _binomial_odds((_held(kinds, "12") + _held(kinds, "21")) / 2, pairs, 2 * VOWELS * (1 - VOWELS), VOWEL_RATE)


def _repeat_odds(values: Column, n: Column, k: int) -> Column:
    """Log likelihood ratio of the equal characters at the lag that most favours a word that repeats itself, 0 if none does."""
    size = n.cast("int")

    def at(lag: Column) -> Column:
        equal = _total(F.zip_with(F.slice(values, F.lit(1), size - lag), F.slice(values, lag + 1, size - lag), lambda x, y: (x == y).cast("double")))
        return _binomial_odds(equal, (size - lag).cast("double"), 1 / k, EQUAL)

    lags = F.sequence(F.lit(1), F.greatest(F.least(F.floor(n / 2).cast("int"), F.lit(LAGS)), F.lit(1)))
    return F.least(F.lit(0.0), F.array_min(F.transform(lags, at)) + math.log(LAGS))


def _odds_of_letters(alphabet: str) -> list[tuple[str, float]]:
    """The alphabet's letters, with the log-odds of each in random against ordinary words."""
    some = [(chr(97 + i), n) for i, n in enumerate(LETTERS) if chr(97 + i) in alphabet]
    total, k = sum(n for _, n in some), len(some)
    return [(c, -math.log((1 - EVEN) * k * n / total + EVEN)) for c, n in some]


def _normal_odds(z: Column) -> Column:
    """Log likelihood ratio of a standard normal statistic against an even mixture of it and a WIDE one."""
    half = F.least(z * z / 2, F.lit(600.0))
    return -half - F.log((F.exp(-half) + F.exp(-half / WIDE**2) / WIDE) / 2)


def _total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda acc, y: acc + y)


def battery(word: Column) -> Column:
    """struct(encoding, uniformity, runs, serial): the log e-values of the tests
    under the first encoding that fits a word; null where none does."""
    out = F.lit(None).cast("struct<encoding: string, uniformity: double, runs: double, serial: double>")
    for name, pattern, alphabet in reversed(ENCODINGS):
        k = len(alphabet)
        bare = F.regexp_replace(word, "=+$", "")
        body = F.translate(bare, "_-", "/+") if name == "base64" else F.lower(bare)
        values = F.transform(F.split(body, ""), _value_in(alphabet))
        n = F.char_length(body).cast("double")
        counts = F.transform(F.split(F.lit(alphabet), ""), _count_in(body))
        chi = _total(F.transform(counts, lambda x: x * x)) * k / n - n
        uniform = (chi - (k - 1)) / F.sqrt(2 * (k - 1) * (1 - 1 / n))
        mean = (k + 1) / 2
        var = (k * k - 1) / 12
        before, after = F.slice(values, F.lit(1), n.cast("int") - 1), F.slice(values, F.lit(2), n.cast("int") - 1)
        serial = _total(F.zip_with(before, after, _product_about(mean))) / (var * F.sqrt(n - 1))
        turns = _total(F.zip_with(before, after, _crosses(mean)))
        about = (2 * turns - (n - 1)) / F.sqrt(n - 1)
        letters = _odds_of_letters(alphabet)
        held = F.transform(F.array(*(F.lit(c) for c, _ in letters)), _count_in(F.lower(body)))
        even = _total(F.zip_with(held, F.array(*(F.lit(x) for _, x in letters)), operator.mul))
        changes = _changes(bare)
        runs = _binomial_odds(changes, n - 1, RANDOM_RATE[name], WORD_RATE[name])
        shares = _class_odds(body, name)
        if name == "base32":
            # Letters alone are an alphabet of their own, in which nothing changes; every other such word may be of it.
            alone = (changes == 0) & body.rlike("^[a-z]+$")
            runs, shares = F.when(alone, 0.0).otherwise(runs), F.when(alone, -math.log(2)).otherwise(shares)
        alternates = F.lit(0.0) if name == "hex" else _vowel_odds(body)
        tests = F.struct(
            F.lit(name).alias("encoding"), (even + shares + _normal_odds(uniform)).alias("uniformity"),
            (runs + _normal_odds(about)).alias("runs"), (alternates + _repeat_odds(values, n, k) + _normal_odds(serial)).alias("serial"),
        )
        out = F.when(word.rlike(pattern) & (F.char_length(bare) >= 20), tests).otherwise(out)
    return out


def _evidence(word: Column) -> Column:
    """A bound on the p-value of an ordinary word, the inverse of the product of
    the tests' e-values, or 1 where no encoding fits."""

    def tail(x: Column) -> Column:
        odds = x["uniformity"] + x["runs"] + x["serial"]
        return F.coalesce(F.least(F.lit(1.0), F.exp(-F.greatest(odds, F.lit(-600.0)))), F.lit(1.0))

    # An array of one element and transform() stand for a let-binding: the tests run once.
    return F.transform(F.array(battery(word)), tail)[0]


def _random(text: Column) -> Column:
    """array<struct<s, e>> of the words that the false-discovery control lets through."""
    empty = F.expr("CAST(ARRAY() AS ARRAY<STRUCT<s: INT, e: INT>>)")
    tested = F.transform(_located(text, CANDIDATE), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), _evidence(x["m"]).alias("p")))

    def controlled(rows: Column) -> Column:
        total = F.aggregate(rows, F.lit(0.0), lambda acc, x: acc + (x["e"] - x["s"]))
        m = F.size(rows)
        weighed = F.array_sort(F.transform(rows, lambda x: F.struct((x["p"] * total / (m * (x["e"] - x["s"]))).alias("q"), x["s"].alias("s"), x["e"].alias("e"))))
        ok = F.transform(weighed, lambda x, i: F.when(x["q"] <= FALSE_SHARE * (i + 1) / m, x["q"]))
        return F.transform(F.filter(weighed, lambda x: x["q"] <= F.array_max(ok)), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))

    # An array of one element and transform() stand for a let-binding: the tests run once.
    once = F.transform(F.array(tested), controlled)[0]
    return F.when(text.rlike(CANDIDATE), F.coalesce(once, empty)).otherwise(empty)


def _longer(least: int):
    return lambda x: F.char_length(x["g"]) >= least


def _span(rank: int, kind: str):
    return lambda x: F.struct(x["s"].alias("s"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), x["e"].alias("e"))


def scanned(docs: DataFrame) -> DataFrame:
    """docs' doc_id, with one array<struct<s, rank, kind, e>> for the base and one for all spans."""
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.select("doc_id", text.alias("text"))
    spans = []
    for rank, (kind, pattern, group, least) in enumerate(KINDS):
        found = F.filter(_located(F.col("text"), FAST.get(kind, pattern), group), _longer(least))
        out = out.withColumn(f"_{kind}", F.transform(found, _span(rank, kind)))
        spans.append(f"_{kind}")
    out = out.withColumn("_random", F.transform(_random(F.col("text")), _span(len(KINDS), "random")))
    return out.select("doc_id", *spans, F.array_sort(F.concat(*spans)).alias("base"), F.array_sort(F.concat(*spans, "_random")).alias("found"))


def secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random for each row of docs."""

    def joined(c: str) -> Column:
        return F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")

    counts = [F.size(f"_{kind}").cast("long").alias(f"n_{kind}") for kind, *_ in KINDS]
    return scanned(docs).select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("found").alias("spans"), (F.size("found") - F.size("base")).cast("long").alias("n_random"))
