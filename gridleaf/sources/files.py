"""Files of the corpus as DataFrames, and sinks.

Spark's readers leave out files of no bytes, which are a state here, so scans
start from a listing. Executors list folders and read just the listed files.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import storage
from .publish import published, recovered

# The stage folders of a workflow root, and the suffix of each.
STAGES = {
    "html_template": "html",
    "annotated_json": "json",
    "filled_json": "json",
    "filled_html": "html",
    "context": "txt",
    "placeholder_html": "html",
    "meta": "json",
    "html_b": "html",
    "json_b": "json",
}
# The folder names of the stages by what they hold, as records name them.
ALIASES = {"html_empty": "html_template", "json_empty": "annotated_json", "json_filled": "filled_json", "html_filled": "filled_html", "placeholder": "placeholder_html"}
ARTIFACT = "path string, name string, ext string, size long, mtime long"


def listing(spark: SparkSession, root: str | Sequence[str], recursive: bool = False) -> DataFrame:
    """Files below a folder, or below each of several; none where it does not exist."""
    roots = [storage.qualified(spark, r) for r in ([root] if isinstance(root, str) else root)]
    if not all(map(storage.known, roots)):
        return union_all(_listed_by_hadoop(spark, r, recursive) for r in roots)
    name = F.substring_index("path", "/", -1)
    stem = F.regexp_extract(name, r"(?s)^(.*)\.[^.]*$", 1)
    ext = F.when(F.contains(name, F.lit(".")), F.substring_index(name, ".", -1)).otherwise(name)
    return storage.listed(spark, roots, recursive).select("path", F.when(stem == "", name).otherwise(stem).alias("name"), ext.alias("ext"), "size", "mtime")


def _listed_by_hadoop(spark: SparkSession, root: str, recursive: bool) -> DataFrame:
    """As listing, on the driver, for file systems that only Hadoop knows."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    rows = []
    if fs.exists(path):
        found = fs.listFiles(path, recursive)
        while found.hasNext():
            s = found.next()
            name = s.getPath().getName()
            stem, _, ext = name.rpartition(".")
            rows.append((s.getPath().toString(), stem or name, ext, s.getLen(), s.getModificationTime()))
    return spark.createDataFrame(rows, ARTIFACT)


def numeric_files(spark: SparkSession, root: str, suffix: str) -> DataFrame:
    """Files whose stem is a whole number, the suffix in any case, as (sample_id, path, size, mtime)."""
    rows = listing(spark, root).where(F.lower("ext") == suffix.lower())
    return rows.select(F.col("name").try_cast("int").alias("sample_id"), "path", "size", "mtime").where("sample_id is not null")


def stage_path(root: str, stage: str, lang: str, sample_id: int | None = None) -> str:
    """Where a stage's files, or one sample's, lie; an unknown stage is an error."""
    name = ALIASES.get(stage, stage)
    if name not in STAGES:
        raise ValueError(f"unknown stage: {stage}")
    folder = f"{root.rstrip('/')}/{name}/data_{lang}"
    return folder if sample_id is None else f"{folder}/{sample_id}.{STAGES[name]}"


def languages(spark: SparkSession, root: str) -> DataFrame:
    """Languages that any stage of a root has numbered files of."""
    at = F.regexp_extract("path", r"/([^/]+)/data_([^/]+)/[^/]+$", 1)
    rows = listing(spark, root, recursive=True).where(at.isin(*STAGES) & F.col("name").rlike("^[0-9]+$"))
    return rows.select(F.regexp_extract("path", r"/data_([^/]+)/[^/]+$", 1).alias("lang")).distinct()


def html_files(spark: SparkSession, roots: Sequence[str]) -> DataFrame:
    """Forms below all roots, each path once, in order."""
    found = listing(spark, roots, recursive=True)
    return found.where(F.lower("ext").isin("html", "htm")).dropDuplicates(["path"]).orderBy("path")


def numeric_pngs(spark: SparkSession, root: str) -> DataFrame:
    """sample_id and path of rendered images; of files that name one id the last in order."""
    return numeric_files(spark, root, "png").groupBy("sample_id").agg(F.max("path").alias("path"))


def sibling_templates(files: DataFrame, templates: DataFrame, suffix: str = "html") -> DataFrame:
    """files (name, ...) with the template of the same name, whatever the case of its suffix; the first in order of several."""
    side = templates.where(F.lower("ext") == suffix).groupBy("name").agg(F.min("path").alias("template_path"))
    return files.join(side, "name", "left")


def meta_documents(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(path, items of each metadata document, warnings): .json files in order of
    their names, hidden ones left out; what is no list is a warning."""
    rows = contents(listing(spark, root).where((F.col("ext") == "json") & ~F.startswith("name", F.lit(".")))).orderBy("path")
    text = text_of(F.col("content"))
    kind = F.schema_of_variant(F.try_parse_json(text))
    is_list = F.coalesce(F.startswith(kind, F.lit("ARRAY")), F.lit(False))
    return rows.where(is_list).select("path", text.alias("json")), rows.where(~is_list).select("path", F.when(kind.isNull(), "no JSON").otherwise("no list").alias("warning"))


def json_documents(files: DataFrame) -> DataFrame:
    """files with their text and, as json, its document (variant; null where it cannot be read)."""
    text = text_of(F.col("content"))
    return contents(files).withColumn("text", text).withColumn("json", F.try_parse_json(text)).drop("content")


def layout_audits(spark: SparkSession, path: str) -> DataFrame:
    """output and ok of a layout audit: one document with a list of items."""
    text = spark.read.text(path, wholetext=True)
    items = F.from_json(F.get_json_object("value", "$.items"), "array<struct<output: string, ok: boolean>>")
    return text.select(F.explode(items).alias("x")).select("x.output", F.coalesce("x.ok", F.lit(False)).alias("ok"))


def first_existing(spark: SparkSession, paths: Sequence[str]) -> str | None:
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return path
    return None


def record_paths(root: str, task: str, lang: str) -> list[str]:
    """Where test records of a task and language may lie, the most special first."""
    names = [(task, lang), (task, "both"), ("all", lang), ("all", "both")]
    return list(dict.fromkeys(f"{root.rstrip('/')}/{t}_{g}_template_test.jsonl" for t, g in names))


def test_records(spark: SparkSession, root: str, task: str, lang: str, limit: int = 0) -> DataFrame:
    """Test records of the first dataset there is, in order of language and id; limit 0 means all."""
    from ..operators import selection as P

    path = first_existing(spark, record_paths(root, task, lang))
    if path is None:
        raise FileNotFoundError(f"no test records of {task} {lang} below {root}")
    rows = spark.read.json(path, schema="task string, lang string, split string, sample_id long, condition string, prompt string, completion string, gold_path string")
    return P.limited(P.test_records(rows, task, lang).orderBy("lang", "sample_id"), ["lang", "sample_id"], limit)


def gold_of(records: DataFrame, recorded: DataFrame, default: DataFrame) -> DataFrame:
    """records with their gold text: the recorded file's where it exists, else
    the stage's (recorded: gold_path, content; default: lang, sample_id, content)."""
    a = recorded.select("gold_path", F.col("content").alias("__a"))
    b = default.select("lang", "sample_id", F.col("content").alias("__b"))
    return records.join(a, "gold_path", "left").join(b, ["lang", "sample_id"], "left").withColumn("gold", F.coalesce("__a", "__b")).drop("__a", "__b")


def in_range(sample_id, start: int | None = None, end: int | None = None):
    """Inclusive range with open ends."""
    c = F.col(sample_id) if isinstance(sample_id, str) else sample_id
    low = c >= start if start is not None else F.lit(True)
    return low & (c <= end if end is not None else F.lit(True))


def contents(files: DataFrame) -> DataFrame:
    """files with their bytes, which executors read by path; files of no bytes have empty content, unreadable ones null."""
    files = files.withColumn("path", F.regexp_replace("path", "^file:/+", "file:/"))
    some = files.where("size > 0")
    first = some.select("path").first()
    none = files.where("size = 0").withColumn("content", F.lit(b""))
    if first is None:
        return none
    if storage.known(first["path"]):
        return storage.read(some).unionByName(none)
    # Only Hadoop knows the file system: Spark reads the folders, whose names reach the driver.
    folders = [r["folder"] for r in some.select(F.regexp_replace("path", "/[^/]*$", "").alias("folder")).distinct().toLocalIterator()]
    read = files.sparkSession.read.format("binaryFile").load(folders).select("path", "content")
    return some.join(read, "path", "left").unionByName(none)


def artifacts(spark: SparkSession, root: str, langs: Sequence[str], root_name: str = "main", root_order: int = 0) -> DataFrame:
    """All stage files of a root with contents, digests and issues."""
    rows = listing(spark, [stage_path(root, stage, lang) for stage in STAGES for lang in langs])
    at = lambda i: F.regexp_extract("path", r"/([^/]+)/data_([^/]+)/[^/]+$", i)
    suffix = F.create_map(*(F.lit(x) for pair in STAGES.items() for x in pair))
    rows = rows.withColumns({"stage": at(1), "lang": at(2), "sample_id": F.col("name").try_cast("int")})
    out = rows.where((F.lower("ext") == suffix[F.col("stage")]) & F.col("sample_id").isNotNull()).select("stage", "lang", "sample_id", "path", "size")
    read = contents(out)
    issue = F.when(F.col("content").isNull(), "unreadable").when(F.length("content") == 0, "empty")
    return read.select("stage", "lang", "sample_id", "path", "size", "content", F.sha2("content", 256).alias("sha256"), issue.alias("read_issue"), F.lit(root_name).alias("root"), F.lit(root_order).alias("root_order"))


def overlay_scan(spark: SparkSession, roots: Sequence[tuple[str, str]], langs: Sequence[str]) -> DataFrame:
    """Stage files of all roots (name, path), in their order, with digests and
    issues; a sample that several roots have is an issue of its later ones only
    where the contents differ."""
    rows = union_all(artifacts(spark, path, langs, name, order) for order, (name, path) in enumerate(roots))
    first = rows.groupBy("stage", "lang", "sample_id").agg(F.min_by("sha256", "root_order").alias("first_sha256"))
    out = rows.join(first, ["stage", "lang", "sample_id"], "left")
    return out.withColumn("overlay_issue", F.when(F.col("sha256") != F.col("first_sha256"), "conflict")).drop("first_sha256")


def text_of(content):
    """UTF-8 text with line ends as line feeds."""
    return F.regexp_replace(F.decode(content, "UTF-8"), "\r\n?", "\n")


def verified_text(content, sha256, issue):
    """Text of a source whose digest is still the recorded one, else null."""
    body = text_of(content)
    return F.when(issue.isNull() & (F.sha2(content, 256) == sha256) & (F.trim(body) != ""), body)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV table of strings; a byte-order mark before the first name goes."""
    df = spark.read.csv(recovered(spark, path), header=True, multiLine=True, escape='"')
    first = df.columns[0] if df.columns else ""
    return df.withColumnRenamed(first, first.lstrip("﻿")) if first.startswith("﻿") else df


def write_csv(df: DataFrame, path: str, fields: Sequence[str]) -> None:
    """Exactly the fields, in order; columns beyond them are an error. As all
    sinks here it appears when the job has ended, or not at all."""
    extra = set(df.columns) - set(fields)
    if extra:
        raise ValueError(f"columns without a field: {sorted(extra)}")
    published(df.sparkSession, path, lambda at: df.select(*fields).write.csv(at, header=True, escape='"'))


def write_csv_union(frames: Iterable[DataFrame], path: str) -> bool:
    """Rows of all frames under the ordered union of their columns; a file of no bytes without rows or columns."""
    rows = union_all(frames)
    if rows is None or not rows.columns or rows.isEmpty():
        spark = SparkSession.active()
        empty = spark.createDataFrame([], "value string").coalesce(1)
        published(spark, path, lambda at: empty.write.text(at))
        return False
    write_csv(rows, path, rows.columns)
    return True


def write_json(df: DataFrame, path: str) -> None:
    """One JSON document a line."""
    published(df.sparkSession, path, lambda at: df.write.json(at, ignoreNullFields=False))


def write_text(df: DataFrame, path: str) -> None:
    """The only column, a row a line."""
    published(df.sparkSession, path, lambda at: df.write.text(at))


def replace_predictions(rows: DataFrame, path: str, by: Sequence[str] = ("task", "condition", "lang", "model")) -> None:
    """Predictions replace those of their own partitions and leave all others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).json(path, ignoreNullFields=False)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.json(recovered(spark, path), schema=schema)


def union_all(frames: Iterable[DataFrame]) -> DataFrame | None:
    """Rows of all frames under the ordered union of their columns."""
    out = None
    for f in frames:
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    return out


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    """(sha256, path) of a checksum list."""
    parts = F.split("value", "  ", 2)
    return spark.read.text(path).where("trim(value) <> ''").select(parts[0].alias("sha256"), parts[1].alias("path"))


def exclusive(df: DataFrame, path: str, protected: Sequence[str]) -> None:
    """Write where nothing exists yet and outside protected roots."""
    if any(path.rstrip("/") == p.rstrip("/") or path.startswith(p.rstrip("/") + "/") for p in protected):
        raise ValueError(f"{path} is below a protected root")
    df.write.mode("errorifexists").json(path)


def prediction_dir(task: str, condition: str, lang: str, model: str) -> str:
    return f"{task}_{condition}/{lang}/{model.replace('/', '_').replace('-', '_')}"
