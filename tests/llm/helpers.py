"""Small tables with the awkward cases."""

LONG = "word " * 30_000 + "end"
AWKWARD = [
    (1, None, "en", "src0", 0),
    (2, "", "en", "src0", 0),
    (3, " \n\t ", None, None, 4),
    (4, LONG, "en", "src1", len(LONG)),
    (5, LONG, "en", "src1", len(LONG)),
    (6, "alpha beta gamma delta epsilon zeta eta theta iota kappa", "en", "src1", 56),
    (6, "alpha beta gamma delta epsilon zeta eta theta iota kappa", "en", "src1", 56),
    (7, "x" * 50_000, "de", "src2", 50_000),
    (8, "Ünï 🙂 one two three four five six seven", "de", "src2", 40),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use themselves.
CLASH_NAMES = "key rep n root kept spans score posterior component_id __id label __host __path __e __l0 __l1 in0 l0 n0 s0 p_doc n_lines n_dropped chars_before row h media_id list line gone __mark __cut __new y x codes digest".split()
CLASH = "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in CLASH_NAMES) + ", lang string, source string, n_chars long"


def awkward(spark):
    return spark.createDataFrame(AWKWARD, SCHEMA)


def clashing(spark):
    rows = [(d, t, *["v"] * len(CLASH_NAMES), g, s, n) for d, t, g, s, n in AWKWARD]
    return spark.createDataFrame(rows, CLASH)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}
