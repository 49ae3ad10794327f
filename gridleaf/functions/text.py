"""Text functions as Column builders, with a pandas UDF where Spark has none."""

from __future__ import annotations

import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F



def arrow(schema: str):
    """A pandas UDF that is built at its first use, so that modules can be imported without a session."""

    def wrap(f):
        made = []

        def call(*columns):
            if not made:
                made.append(F.pandas_udf(f, schema))
            return made[0](*columns)

        call.__doc__, call.__name__ = f.__doc__, f.__name__
        return call

    return wrap


def arrow_rows(schema: str):
    """As arrow, of a function of one row's plain values; what it returns (dicts for structs) goes to Arrow as it is, without pandas."""

    def wrap(f):
        made = []

        def call(*columns):
            if not made:
                from pyspark.sql.pandas.types import to_arrow_type
                from pyspark.sql.types import DataType

                kind = to_arrow_type(DataType.fromDDL(schema))

                def run(*arrays: pa.Array) -> pa.Array:
                    return pa.array(list(map(f, *(x.to_pylist() for x in arrays))), type=kind)

                made.append(F.arrow_udf(run, schema))
            return made[0](*columns)

        call.__doc__, call.__name__ = f.__doc__, f.__name__
        return call

    return wrap


# The character classes that the scored tasks agree on.
SPACE = r"(?U)[\s\x{1C}-\x{1F}]"
PUNCTUATION = "[]{}()<>:：,，.;；。!?！？'\"`_-/\\|~"
KEY_PUNCTUATION = ":：。，、；;"
PLACEHOLDER = r"\[([^\[\]]+)\]"
LAZY_PLACEHOLDER = r"\[.*?\]"
# Institutions that count as public.
PUBLIC_SUFFIXES = (".gov", ".gov.hk", ".gov.uk", ".mil")
PUBLIC_DOMAINS = ("canada.ca", "coms-auth.hk", "cmchk.org.hk", "hongkongpost.hk", "ladhs.org", "procurement.gwu.edu", "utdallas.edu", "westonhousepractice.nhs.uk")


def without_space(x: Column) -> Column:
    return F.regexp_replace(x, SPACE, "")


def label_text(x: Column) -> Column:
    """Cell text for comparison: lower case, no white space, no punctuation."""
    return F.translate(without_space(F.lower(F.coalesce(x, F.lit("")))), PUNCTUATION, "")


def field_text(x: Column) -> Column:
    """As label_text, without middle dots and without digits at either end."""
    plain = F.translate(label_text(x), "·", "")
    return F.regexp_replace(F.regexp_replace(plain, r"(?U)^\d+", ""), r"(?U)\d+$", "")


def word_text(x: Column) -> Column:
    """Letters and digits only, in lower case."""
    return F.lower(F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)[\W_]+", ""))


def key_text(x: Column) -> Column:
    """A JSON key or value without white space and colon-like marks."""
    return F.translate(without_space(x), KEY_PUNCTUATION, "")


def stripped(x: Column) -> Column:
    """Without white space at the ends."""
    return F.regexp_replace(F.regexp_replace(x, r"(?U)^[\s\x{1C}-\x{1F}]+", ""), r"(?U)[\s\x{1C}-\x{1F}]+$", "")


def collapsed(x: Column) -> Column:
    """One space for each run of white space, none at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)[\s\x{1C}-\x{1F}]+", " "))


#: What goes from texts of ASCII alone: white space and punctuation, at once.
_ASCII_DROPPED = {i: None for i in range(128) if chr(i).isspace() or chr(i) in PUNCTUATION}


def infill_value(text: str | None) -> str:
    """Compatibility form, case-folded, no white space, no punctuation."""
    if text.__class__ is str and text.isascii():
        return text.lower().translate(_ASCII_DROPPED)
    folded = unicodedata.normalize("NFKC", "" if text is None else str(text)).casefold()
    return "".join(c for c in folded if not c.isspace() and c not in PUNCTUATION)


@arrow("string")
def infill_text(x: pd.Series) -> pd.Series:
    return x.map(infill_value)


@arrow("array<string>")
def content_tokens(x: pd.Series) -> pd.Series:
    """Words (with percent and currency signs) and single Han characters, in order."""
    import re

    word = re.compile(r"[\w%$€£¥]+|[㐀-鿿]")
    return x.map(lambda t: word.findall(unicodedata.normalize("NFKC", t or "").casefold()))


def matches(a: Column, b: Column) -> Column:
    """Whether either field text holds the other, both being non-empty."""
    na, nb = field_text(a), field_text(b)
    return (na != "") & (nb != "") & (F.contains(na, nb) | F.contains(nb, na))


def placeholders(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit(PLACEHOLDER), F.lit(1))


def lazy_placeholders(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit(LAZY_PLACEHOLDER), F.lit(0))


def unqualified(x: Column) -> Column:
    """[A-B-C] becomes [C]."""
    return F.regexp_replace(x, r"\[[^\]]*-([^\]-]*)\]", "[$1]")


def indexed_name(x: Column) -> Column:
    """struct(base, index) of a name that ends in digits, both empty otherwise."""
    return F.struct(F.regexp_extract(x, r"^(.+?)(\d+)$", 1).alias("base"), F.regexp_extract(x, r"^(.+?)(\d+)$", 2).alias("index"))


def base_parts(x: Column) -> Column:
    """A name's parts at dashes and slashes, without indices and empty ones."""
    return F.filter(F.transform(F.split(x, "[-/]"), lambda p: F.trim(F.regexp_replace(p, r"\d+$", ""))), lambda p: p != "")


def int_or(x: Column, default: int | None) -> Column:
    return F.coalesce(x.try_cast("int"), F.lit(default).cast("int"))


def double_or(x: Column, default: float | None) -> Column:
    return F.coalesce(x.try_cast("double"), F.lit(default).cast("double"))


def span_of(x: Column) -> Column:
    """The first run of digits, at least 1."""
    return F.greatest(F.lit(1), F.coalesce(F.regexp_extract(F.coalesce(x, F.lit("")), r"\d+", 0).try_cast("int"), F.lit(1)))


def strict_span(x: Column) -> Column:
    """A whole positive number, else 1."""
    n = F.trim(x).try_cast("int")
    return F.when(n > 0, n).otherwise(1)


def without_thinking(x: Column) -> Column:
    """A response without its thinking blocks and closing special tokens."""
    # The markers that models emit.
    out = F.regexp_replace(F.coalesce(x, F.lit("")), r"(?is)<think\b[^>]*>.*?</think\s*/?>", "")
    out = F.regexp_replace(out, r"(?is)<think\b[^>]*>.*?<think\s*/>", "")
    out = F.regexp_replace(out, r"(?i)(?:\s*(?:<end_of_turn>|<\|endoftext\|>|</s>|<eos>))+\s*$", "")
    return stripped(out)


def response_text(x: Column) -> Column:
    """The text of a response document, whichever API shape it has."""
    paths = ("$.output_text", "$.choices[0].message.content", "$.output[0].content[0].text", "$.content[0].text", "$.message.content", "$.text")
    return F.coalesce(*(F.get_json_object(x, p) for p in paths), F.lit(""))


def clean_html(x: Column) -> Column:
    """An HTML response without fences and without what stands before its first tag."""
    fenced = F.regexp_extract(x, r"(?s)```(?:html)?\s*(.*?)```", 1)
    body = stripped(F.when(fenced != "", fenced).otherwise(x))
    at = F.regexp_instr(F.lower(body), F.lit(r"<!doctype|<html|<body|<table|<div|<form|<style"))
    return stripped(F.when(at > 1, F.substring(body, at, F.char_length(body))).otherwise(body))


def fenced_html(x: Column) -> Column:
    trimmed = F.trim(x)
    return F.when(F.startswith(trimmed, F.lit("```")), trimmed).otherwise(F.concat(F.lit("```html\n"), trimmed, F.lit("\n```")))


def has_han(x: Column) -> Column:
    return x.rlike(r"[\x{3400}-\x{9fff}]")


def has_latin(x: Column) -> Column:
    return x.rlike("[A-Za-z]")


def domains(x: Column) -> Column:
    """Hosts (with ports) of all URLs in a text, without www."""
    urls = F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(r"https?://[^;) |]+"), F.lit(0))
    host = lambda u: F.regexp_replace(F.lower(F.regexp_extract(u, r"^https?://([^/?#]*)", 1)), r"^www\.", "")
    return F.filter(F.transform(urls, host), lambda h: h != "")


def is_public(domain: Column) -> Column:
    out = domain.isin(*PUBLIC_DOMAINS)
    for suffix in PUBLIC_SUFFIXES:
        out = out | F.endswith(domain, F.lit(suffix))
    return out


def all_public(found: Column) -> Column:
    return (F.size(found) > 0) & F.forall(found, is_public)


def split_language(x: Column) -> Column:
    return F.when(F.startswith(F.lower(x), F.lit("zh")), "zh").otherwise("en")


def language_prefix(x: Column) -> Column:
    return F.split_part(x, F.lit(" "), F.lit(1))


def model_dir(x: Column) -> Column:
    return F.translate(x, "/-", "__")


def ratio(c: Column, t: Column, places: int = 9) -> Column:
    return F.when(t > 0, F.round(c / t, places)).otherwise(0.0)


def parse_percent(x: Column) -> Column:
    return F.regexp_replace(x, "[%+]", "").try_cast("double")


@arrow("string")
def percent(x: pd.Series) -> pd.Series:
    """One decimal, rounded half to even on the binary value as Python does; empty for null."""
    return x.map(lambda v: "" if pd.isna(v) else f"{v * 100:.1f}%")


@arrow("string")
def signed_percent(x: pd.Series) -> pd.Series:
    return x.map(lambda v: "" if pd.isna(v) else f"{'+' if v >= 0 else ''}{v * 100:.1f}%")


@arrow("string")
def six_places(x: pd.Series) -> pd.Series:
    return x.map(lambda v: "" if pd.isna(v) else f"{v:.6f}")


def format_bytes(n: int) -> str:
    value = float(n)
    for unit in ("B", "KiB", "MiB", "GiB"):
        if value < 1024 or unit == "GiB":
            return f"{int(value)} B" if unit == "B" else f"{value:.1f} {unit}"
        value /= 1024
    return str(n)


@arrow("string")
def bytes_text(n: pd.Series) -> pd.Series:
    return n.map(lambda v: None if pd.isna(v) else format_bytes(int(v)))


def non_pure_text(html: Column) -> Column:
    """Whether a cell's markup holds a control or a mark to tick."""
    return html.rlike(r"(?i)<input|<select|\(√\)|\( \)|\[√\]|\[ \]|\(×\)|\[×\]")


# What may stand before a tuned model's name, and behind its base model's name.
TUNED_HEAD = r"(?iU)^(?:schema|alignment|infill)[\s_-]+(?:en|zh)[\s_-]+"
TUNED_TAILS = (r"(?i:seed=\d+)", r"checkpoint(?:[\s_-]\d+)?", r"(?i:InfillFT)(?:[\s_-].*)?", r"(?i:infill)(?:[\s_-].*)?", r"QA(?:[\s_-].*)?", r"(?i:repair)")


def tuned_name(x: Column) -> Column:
    """A tuned model's name without task and language before it, white space being underscores."""
    bare = F.regexp_replace(F.regexp_replace(x, rf"^{SPACE}+|{SPACE}+$", ""), TUNED_HEAD, "")
    return F.regexp_replace(bare, r"(?U)\s*_\s*|\s+", "_")


def tuned_base(x: Column) -> Column:
    """The name of a tuned model's base: all tails go, in any order and number."""
    return F.regexp_replace(F.regexp_replace(tuned_name(x), "^finetuned_", ""), rf"(?U)(?:[\s_-](?:{'|'.join(TUNED_TAILS)}))+$", "")


def tuning_method(x: Column) -> Column:
    return F.when(tuned_name(x).rlike(r"(?U)(?:^|[\s_-])QA(?:[\s_-]|$)"), "QA").otherwise("FT")


def tuned_version(x: Column, method: Column) -> Column:
    """The number behind the method's mark at the end of a name, 0 if there is none."""
    number = lambda mark: F.regexp_extract(x, rf"(?iU)[\s_-]{mark}[\s_-]v?(\d+)$", 1).try_cast("int")
    return F.coalesce(F.when(method == "FT", number("InfillFT")).when(method == "QA", number("QA")), F.lit(0))


def safe_language(x: Column) -> Column:
    return x.rlike(r"^[A-Za-z]{2,8}(?:[_-][A-Za-z0-9]{1,8})*$")


def safe_name(x: Column) -> Column:
    return F.regexp_replace(x, r"[^A-Za-z0-9._-]+", "_")


def data_url(content: Column) -> Column:
    return F.concat(F.lit("data:image/png;base64,"), F.base64(content))


def png_size(content: Column) -> Column:
    """struct(width, height) from a PNG's header."""
    side = lambda at: F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("int")
    return F.struct(side(17).alias("width"), side(21).alias("height"))


def api_error(message: Column) -> Column:
    """The class of an API error: what a caller would do next."""
    low = F.lower(F.coalesce(message, F.lit("")))
    has = lambda *parts: _any(F.contains(low, F.lit(p)) for p in parts)
    return F.when(has("too large", "413", "request entity"), "too_large").when(has("model") & has("missing", "required", "must provide"), "missing_model").when(has("not found", "404", "unsupported", "responses"), "fallback_to_chat").otherwise("other")


def _any(columns) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | c
    return out
