"""From jobs and predictions to scored rows, and reports."""

import json

from gridleaf.functions import dom
from gridleaf.operators import evaluate as E
from gridleaf.operators import reports as R

BLANK = "<table><tr><td>Name</td><td>[Name]</td></tr></table>"
FILLED = BLANK.replace("[Name]", "Ada  B")
META = json.dumps([{"key": "Name", "label_info": {"row": 0, "col": 0}, "placeholder_offset": {"rows": 0, "cols": 1}, "type": "SI"}])
ANSWERS = {"schema": '{"Name": "Ada"}', "alignment": BLANK.replace("[Name]", '<input name="Name">'), "infill": FILLED}


def frames(spark, **change):
    jobs = [("en", 1, "m", t, c, "ready", "e1") for t in ANSWERS for c in ("empty", "filled")]
    docs = []
    for lang, i, m, t, c, *_ in jobs:
        doc = {"lang": lang, "sample_id": i, "model": m, "task": t, "condition": c, "evidence": "e1", "raw_response": ANSWERS[t]} | change
        docs.append((lang, i, m, t, c, json.dumps(doc)))
    sources = [("en", 1, ANSWERS["schema"], ANSWERS["schema"], META, BLANK, FILLED)]
    return (
        spark.createDataFrame(jobs, "lang string, sample_id int, model string, task string, condition string, status string, evidence string"),
        spark.createDataFrame(docs, "lang string, sample_id int, model string, task string, condition string, document string"),
        spark.createDataFrame(sources, "lang string, sample_id int, json_empty string, json_filled string, meta string, placeholder_html string, html_filled string"),
    )


def run(spark, **change):
    return E.evaluated(*frames(spark, **change)).collect()


def test_gold_answers_score_one(spark):
    found = run(spark)
    assert len(found) == 6 and all(r["state"] == "scored" and r["score"] == 1.0 for r in found)


def test_states(spark):
    assert {r["state"] for r in run(spark, evidence="other")} == {"source_mismatch"}
    assert {r["state"] for r in run(spark, sample_id=True)} == {"prediction_error"}
    assert {r["state"] for r in run(spark, status="transport_error")} == {"transport_error"}
    blank = run(spark, raw_response="<think>x</think> ")
    assert {(r["state"], r["score"]) for r in blank} == {("model_format_failure", 0.0)}
    jobs, docs, sources = frames(spark)
    assert {r["state"] for r in E.evaluated(jobs, docs.limit(0), sources).collect()} == {"not_run"}
    assert {r["state"] for r in E.evaluated(jobs, docs, sources.limit(0)).collect()} == {"source_error"}


def full(spark, **change):
    """Whole jobs, predictions without a request, and sources."""
    gold = json.dumps({"Name": "Ada"})
    sources = spark.createDataFrame(
        [("en", 1, BLANK, FILLED, gold, gold, META, BLANK, "Name: Ada B")],
        "lang string, sample_id int, html_empty string, html_filled string, json_empty string, json_filled string, meta string, placeholder_html string, context string",
    )
    jobs = E.prepared(sources, "m")
    docs = jobs.select(*E.KEYS).collect()
    rows = [(*r, json.dumps({"raw_response": ANSWERS[r.task]} | change)) for r in docs]
    return jobs, spark.createDataFrame(rows, "lang string, sample_id int, model string, task string, condition string, document string"), sources


def test_prepared_jobs_stand_for_missing_requests(spark):
    jobs, docs, sources = full(spark)
    of = lambda **kw: {(r["state"], r["score"]) for r in E.evaluated(jobs, docs, sources, **kw).collect()}
    assert of() == {("source_mismatch", None)}  # a prediction that names no request, and nothing prepared
    assert of(evidence=jobs) == {("scored", 1.0)}
    other = jobs.withColumn("target_count", jobs["target_count"] + 1)
    assert of(evidence=other) == {("source_mismatch", None)}
    assert {(r["state"], r["total"]) for r in E.evaluated(jobs, docs, sources).collect()} == {("source_mismatch", 1)}
    # What is no object says nothing, so the prepared job decides, and the response is malformed.
    broken = docs.withColumn("document", E.F.lit("[1]"))
    assert {(r["state"], r["score"], r["total"]) for r in E.evaluated(jobs, broken, sources, evidence=jobs).collect()} == {("model_format_failure", 0.0, 1)}
    jobs, docs, sources = full(spark, request={"lang": "en"})
    assert {r["state"] for r in E.evaluated(jobs, docs, sources, evidence=jobs).collect()} == {"source_mismatch"}


def test_a_metric_without_backend_is_a_state(spark):
    found = {(r["task"], r["state"]) for r in E.evaluated(*frames(spark), metric="cpp").collect()}
    assert found == {("schema", "backend_error"), ("alignment", "scored"), ("infill", "scored")}


def test_reports(spark):
    rows = R.collected(spark.createDataFrame([("b", 0.5, -0.01), ("a", 0.25, None)], "model string, score double, score_diff double"), ["model"])
    assert R.markdown(rows, ["model", "score", "score_diff"], ["score"]).splitlines()[2:] == ["| a | 25.0% |  |", "| b | **50.0%** | -1.0% |"]
    assert R.latex(rows[1:], ["model", "score_diff"]) == "b & -1.0\\% \\\\\n" and R.csv_lines(rows, ["model"]) == "model\na\nb\n"


def test_reports_in_blocks():
    rows = [{"model": m, "score": x, "score_diff": d} for m, x, d in (("b", 0.5, -0.01), ("Ref", 0.9, None), ("a", 0.25, 0.5))]
    columns = ["model", "score", "score_diff"]
    assert R.with_references(rows, columns, ["Ref"], "Images", -0.125).splitlines()[2:] == ["| b | 50.0% | -1.0% |", "| a | 25.0% | +50.0% |", "", "Global Average Drop (main rows only): -12.5%", "", "| Images |  |  |", "| Ref | 90.0% |  |"]
    assert R.with_references(rows[:1], columns, ["Ref"], "Images", None).splitlines()[3:] == ["", "Global Average Drop: "]
    groups = [{"model": m, "method": t, "score": x} for m, t, x in (("Average", "Base", 0.1), ("x", "Base", 0.5), ("y", "Base", 0.5), ("x", "FT", 0.75), ("Average", "FT", None), ("y", "FT", 0.5))]
    got = R.grouped(groups, ["model", "method", "score"], "model", ["score"]).splitlines()[2:]
    assert got == ["| x | Base | 50.0% |", "| x | FT | **75.0%** |", "| y | Base | **50.0%** |", "| y | FT | **50.0%** |", "| --- | --- | --- |", "| Average | Base | **10.0%** |", "| Average | FT |  |"]


def test_grid_repairs():
    t = dom.parse('<table><tr><td>a</td><td>b</td></tr><tr><td colspan="3">c</td></tr><tr><td>d</td><td>e</td></tr><tr><td>f</td></tr></table>').all("table")[0]
    assert dom.row_widths(t) == [2, 3, 2, 1] and dom.repaired_widths(t) == {"target": 2, "repaired": 2, "unresolved": 0} and dom.row_widths(t) == [2, 2, 2, 2]
    assert dom.scanned_cells("<tr><td>a &amp; b</td><th> <b>c</b></th></tr>") == {(0, 0): "a & b", (0, 1): "c"}
    assert dom.empty_cells("<table><tr><td> </td><td><input></td></tr></table>") == [(0, 0, True), (0, 1, False)]
    out = dom.repaired_gold('<table><tr><td>x</td><td><input name="A"></td></tr></table>', "<table><tr><td>x[B]</td><td>[A]</td></tr></table>")
    assert out.count("<input") == 2 and 'name="B"' in out
