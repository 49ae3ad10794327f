"""Prompts, jobs, chat records and shards."""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import smallest
from .staging import staged

# The texts that models are asked with. {source}, {values} and {action} follow from the condition; {html} and {context} are replaced.
SYSTEM = "You are a precise table and JSON conversion assistant."
SOURCE = {"filled": {"schema": "filled HTML table", "alignment": "filled HTML form"}, "empty": {"schema": "empty HTML table template", "alignment": "empty HTML form template"}}
VALUES = {"filled": "Preserve filled values when they are present.", "empty": "Use empty strings for fillable values."}
ACTION = {"filled": "check, correct, and complete this already filled HTML table", "empty": "fill this empty HTML table template"}
PROMPTS = {
    "schema": """Convert the following {source} into a concise hierarchical JSON object.

Rules:
1. Keep the original language of all labels.
2. Preserve the table's field hierarchy and repeated structures.
3. Convert selectable fields to objects with "select" and "value" when possible.
4. {values}
5. Return only valid JSON, without markdown fences or explanations.

HTML:
{html}
""",
    "alignment": """Identify all fillable positions in the following {source}.

Return the complete HTML using the reference placeholder format. At every position that should contain user-provided data, insert an HTML input placeholder:
<input type="text" name="FieldName" value="placeholder">

Rules:
1. Keep the original table structure, text, styling, rows, and cells.
2. Do not invent field names; use the most local label text from the table as the input name.
3. For plain text fields, replace the fillable blank/value with <input type="text" name="FieldName" value="placeholder">.
4. For repeated rows, add 1-based indices to the name when needed, for example name="Item1" and name="Item2".
5. For checkbox, radio, or other selectable groups, use the same field name for every option in the group. If the option is already an <input type="checkbox"> or <input type="radio">, add name="FieldName" and value="placeholder" to that input. If the selectable mark is plain text such as ( ), [ ], or a check mark, insert a nearby <input type="text" name="FieldName" value="placeholder">.
6. Do not output square-bracket placeholders such as [Name]. The output must use HTML input placeholders with name="..." and value="placeholder".
7. Return only the final HTML, without markdown fences or explanations.

HTML:
{html}
""",
    "infill": """Use the relevant information to {action}.

Rules:
1. Keep the original HTML structure and styling.
2. Fill all fields supported by the relevant information.
3. Preserve checkbox/radio/selectable markup and set the selected option where appropriate.
4. Return only the final HTML, without markdown fences or explanations.

Relevant information:
{context}

HTML:
{html}
""",
}
# The same for models that see an image. {source}, {language}, {values}, {action} and {context} are replaced.
IMAGE_SOURCE = {"filled": "filled form/table image", "empty": "empty form/table template image"}
IMAGE_VALUES = {"filled": "Preserve visible filled values when they are present.", "empty": "Use empty strings for fillable values."}
IMAGE_ACTION = {"filled": "check, correct, and complete this already filled form/table", "empty": "fill this empty form/table template"}
IMAGE_LANGUAGE = {"zh": "Keep Chinese labels in Chinese.", "": "Keep English labels in English."}
IMAGE_PROMPTS = {
    "schema": """Convert the attached {source} into a concise hierarchical JSON object.

Rules:
1. {language}
2. Preserve the form/table field hierarchy and repeated structures.
3. Convert selectable fields to objects with "select" and "value" when possible.
4. {values}
5. Return only valid JSON, without markdown fences or explanations.""",
    "alignment": """Identify all fillable positions in the attached {source}.

Return a complete HTML table/form approximation of the image using the legacy placeholder format from the original project. At every position that should contain user-provided data, insert an HTML input placeholder:
<input type="text" name="FieldName" value="placeholder">

Rules:
1. {language}
2. Preserve the visible table structure, labels, row/column order, and fillable cells as closely as possible.
3. Do not invent field names; use the most local visible label text from the form/table as the input name.
4. For plain text fields, replace the fillable blank/value with <input type="text" name="FieldName" value="placeholder">.
5. For repeated rows, add 1-based indices to the name when needed, for example name="Item1" and name="Item2".
6. For checkbox, radio, or other selectable groups, use the same field name for every option in the group and include an input placeholder near each option.
7. Return only the final HTML, without markdown fences or explanations.""",
    "infill": """Use the relevant information to {action} shown in the attached image.

Rules:
1. {language}
2. Reconstruct the visible table/form structure as HTML as closely as possible.
3. Fill all fields supported by the relevant information.
4. Preserve checkbox/radio/selectable semantics and mark the selected option where appropriate.
5. Return only the final HTML, without markdown fences or explanations.

Relevant information:
{context}""",
}


def _pieces(task: str, condition: str) -> list[str]:
    """The template cut at its fields, fields included."""
    out, rest = [], PROMPTS[task].replace("{source}", SOURCE[condition].get(task, "")).replace("{values}", VALUES[condition]).replace("{action}", ACTION[condition])
    for name in ("{context}", "{html}"):
        if name in rest:
            head, rest = rest.split(name, 1)
            out += [head, name]
    return [*out, rest]


def prompt(task: str, condition: str, html: Column, context: Column | None = None) -> Column:
    fields = {"{html}": html, "{context}": context}
    return F.concat(*(fields[p] if p in fields else F.lit(p) for p in _pieces(task, condition)))


def sql_prompt(task: str, condition: str, html: str, context: str = "''") -> str:
    """The same as an SQL expression of SQL expressions."""
    fields = {"{html}": html, "{context}": context}
    return " || ".join(f"({fields[p]})" if p in fields else "'" + p.replace("'", "''") + "'" for p in _pieces(task, condition))


def messages(user: Column, assistant: Column | None = None) -> Column:
    said = [F.struct(F.lit("system").alias("role"), F.lit(SYSTEM).alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content"))]
    if assistant is not None:
        said.append(F.struct(F.lit("assistant").alias("role"), assistant.alias("content")))
    return F.array(*said)


def message_records(turns: DataFrame, key: str, order: str) -> DataFrame:
    """Turns of each conversation as one array of (role, content)."""
    grouped = turns.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, "role", F.col("text").alias("content")))).alias("m"))
    return grouped.select(key, F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))


def jobs(samples: DataFrame, task: str, condition: str) -> DataFrame:
    """Prepared requests of a task: a missing or blank source is a state, not a failure.
    samples: lang, sample_id, html, context, targets."""
    bad = F.col("html").isNull() | (F.trim("html") == "")
    if task == "infill":
        bad = bad | F.col("context").isNull() | (F.trim("context") == "")
    status = F.when(bad, "source_error").when((F.lit(task) != "schema") & (F.coalesce("targets", F.lit(0)) == 0), "ineligible_no_targets").otherwise("ready")
    asked = messages(prompt(task, condition, F.col("html"), F.coalesce("context", F.lit(""))))
    return samples.select("lang", "sample_id", F.lit(task).alias("task"), F.lit(condition).alias("condition"), status.alias("status"), F.when(status == "ready", F.col("targets")).alias("target_count"), F.when(status == "ready", asked).alias("messages"))


def record_id(lang: Column, sample_id: Column, style: str = "prefixed") -> Column:
    if style == "sample_id":
        return sample_id.cast("string")
    if style == "offset":
        return F.when(lang == "en", sample_id).otherwise(sample_id + 100000).cast("string")
    return F.when(F.coalesce(lang, F.lit("")) == "", sample_id.cast("string")).otherwise(F.concat(lang, F.lit("_"), sample_id.cast("string")))


def custom_id(*parts: Column) -> Column:
    return F.concat_ws("__", *parts)


def request_line(model: Column, ident: Column, said: Column) -> Column:
    body = F.struct(model.alias("model"), said.alias("messages"))
    return F.to_json(F.struct(ident.alias("custom_id"), F.lit("POST").alias("method"), F.lit("/v1/chat/completions").alias("url"), body.alias("body")))


def record_summary(records: DataFrame, keys: Sequence[str]) -> DataFrame:
    n = F.char_length("completion")
    return records.groupBy(*keys).agg(F.count("*").alias("records"), F.max(n).cast("long").alias("max_chars"), F.floor(F.avg(n)).cast("long").alias("avg_chars"))


def stripped(x: Column | str) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def image_prompt(task: str, condition: str, lang: Column, context: Column | None = None) -> Column:
    """What an image model is asked; null where an infill sample has no context."""
    language = F.when(lang == "zh", IMAGE_LANGUAGE["zh"]).otherwise(IMAGE_LANGUAGE[""])
    text = IMAGE_PROMPTS[task].replace("{source}", IMAGE_SOURCE[condition]).replace("{values}", IMAGE_VALUES[condition]).replace("{action}", IMAGE_ACTION[condition])
    head, _, rest = text.partition("{language}")
    body, with_context, _ = rest.partition("{context}")
    return F.concat(F.lit(head), language, F.lit(body), *([context] if with_context else []))


def training_samples(sources: DataFrame, task: str) -> DataFrame:
    """lang, sample_id, task, status, prompt, completion, messages of each sample
    (sources: lang, sample_id, html_empty, json_empty, placeholder_html, html_filled,
    context). A missing or blank file is a status; a gold document that is no
    JSON fails the job, as it must be mended."""
    from . import html as H

    needs = {"schema": ("html_empty", "json_empty"), "alignment": ("html_empty", "placeholder_html"), "infill": ("html_empty", "context", "html_filled")}[task]
    lost = F.filter(F.array(*(F.when(stripped(F.coalesce(c, F.lit(""))) == "", F.lit(c)) for c in needs)), lambda x: x.isNotNull())
    gold = {"schema": stripped("json_empty"), "alignment": H.inputs_for_markers(F.col("placeholder_html")), "infill": stripped("html_filled")}[task]
    if task == "schema":
        gold = F.when(F.try_parse_json(gold).isNotNull(), gold).otherwise(F.raise_error(F.concat(F.lit("gold is no JSON: "), "lang", F.lit("/"), F.col("sample_id").cast("string"))).cast("string"))
    asked = prompt(task, "empty", F.col("html_empty"), F.col("context"))
    ok = F.size(lost) == 0
    status = F.when(ok, "ok").otherwise(F.concat(F.lit("missing: "), F.array_join(lost, ", ")))
    given = lambda c: F.when(ok, c)
    return sources.select("lang", "sample_id", F.lit(task).alias("task"), status.alias("status"), given(asked).alias("prompt"), given(gold).alias("completion"), given(messages(asked, gold)).alias("messages"))


# Fixed value: what stands before the context of an instruction record.
CONTEXT_MARK = "相关内容:"


def instruction_input(task: Column, html: Column, context: Column) -> Column:
    form = F.concat(F.lit("HTML:\n"), stripped(html))
    return F.when(task == "infill", F.concat(form, F.lit(f"\n{CONTEXT_MARK}\n"), stripped(context))).otherwise(form)


def split_keys(ident: Column, seed: int) -> tuple[Column, Column]:
    """Two numbers of 60 bits that put ids in a seeded order."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), ident.cast("string")), 256)
    number = lambda at: F.conv(F.substring(digest, at, 15), 16, 10).cast("bigint")
    return number(1), number(16)


def split(samples: DataFrame, ident: str = "sample_id", test_share: float = 0.2, seed: int = 3407) -> DataFrame:
    """samples with their split, by a seeded shuffle of the distinct ids: those
    of the first share of the order of hashes are test ids, so no id is in both.
    The last test id is found by counting hashes in ranges; nothing is sorted,
    and no ids leave their tasks."""
    first, second = split_keys(F.col(ident), seed)
    ids = staged(samples.select(ident).where(F.col(ident).isNotNull()).distinct().select(first.alias("a"), second.alias("b")), "split-ids")
    n = ids.count()
    if not n:
        return samples.withColumn("split", F.lit("train"))
    last = smallest(ids, ["a", "b"], max(1, round(n * test_share)))
    own = (first < last[0]) | ((first == last[0]) & (second <= last[1]))
    return samples.withColumn("split", F.when(F.coalesce(own, F.lit(False)), "test").otherwise("train"))


def split_ids(ids: Sequence[int], test_share: float = 0.2, seed: int = 3407) -> tuple[set[int], set[int]]:
    """(train, test): the sorted ids shuffled by a seeded generator, the first share being the test ids."""
    order = sorted(set(ids))
    random.Random(seed).shuffle(order)
    cut = max(1, round(len(order) * test_share)) if order else 0
    return set(order[cut:]), set(order[:cut])


def batch_outcome(jobs_: DataFrame, outputs: DataFrame) -> DataFrame:
    """Each output line's state: unknown job, failed, empty, skip (already there) or write."""
    rows = outputs.join(jobs_.withColumn("known", F.lit(True)), "custom_id", "left")
    state = F.when(F.col("known").isNull(), "unknown").when(F.col("error").isNotNull(), "failed").when(F.coalesce(F.trim("response"), F.lit("")) == "", "empty").when(F.coalesce("has_prediction", F.lit(False)), "skip").otherwise("write")
    return rows.select("custom_id", state.alias("state"))
