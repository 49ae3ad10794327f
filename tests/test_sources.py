"""Scans, sinks, streams, validators and record building."""

import hashlib

import pytest
from pyspark.sql import functions as F

from gridleaf.functions import text as X
from gridleaf.operators import coverage as G
from gridleaf.operators import jobs as J
from gridleaf.operators.shards import sharded
from gridleaf.operators import validate as V
from gridleaf.sources import files as S
from gridleaf.streaming import predictions as P


def test_numeric_scan_keeps_empty_files(spark, tmp_path):
    for name, body in (("1.html", "<p>a\r\nb</p>"), ("02.HTML", ""), ("x.html", "no"), ("3.json", "{}")):
        (tmp_path / name).write_bytes(body.encode())
    found = {r["sample_id"]: r for r in S.contents(S.numeric_files(spark, str(tmp_path), "html")).select("*", S.text_of(F.col("content")).alias("text")).collect()}
    assert set(found) == {1, 2} and found[2]["content"] == b"" and found[1]["text"] == "<p>a\nb</p>"
    assert S.numeric_files(spark, str(tmp_path / "none"), "html").count() == 0


def test_artifacts_have_issues_and_digests(spark, tmp_path):
    d = tmp_path / "html_template" / "data_en"
    d.mkdir(parents=True)
    (d / "7.html").write_text("<b>x</b>")
    (d / "8.html").write_text("")
    found = {r["sample_id"]: r for r in S.artifacts(spark, str(tmp_path), ["en"]).collect()}
    assert found[7]["sha256"] == hashlib.sha256(b"<b>x</b>").hexdigest() and found[7]["read_issue"] is None
    assert found[8]["read_issue"] == "empty"


def test_roots_overlay(spark, tmp_path):
    for root, body in (("a", "one"), ("b", "one"), ("c", "two")):
        d = tmp_path / root / "context" / "data_en"
        d.mkdir(parents=True)
        (d / "1.txt").write_text(body)
        (d / "2.txt").write_text("same")
    found = S.overlay_scan(spark, [(r, str(tmp_path / r)) for r in "abc"], ["en"]).collect()
    assert {(r["root"], r["sample_id"], r["overlay_issue"]) for r in found} == {*((r, i, None) for r in "ab" for i in (1, 2)), ("c", 1, "conflict"), ("c", 2, None)}


def test_csv_with_mark_and_guarded_sinks(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"\xef\xbb\xbfid,name\n1,\"x\ny\"\n")
    df = S.read_csv(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["id", "name"] and df.first()["name"] == "x\ny"
    with pytest.raises(ValueError):
        S.write_csv(df, str(tmp_path / "b"), ["id"])
    S.exclusive(df, str(tmp_path / "out"), [str(tmp_path / "in")])
    with pytest.raises(Exception, match="(?i)exist"):
        S.exclusive(df, str(tmp_path / "out"), [])
    with pytest.raises(ValueError):
        S.exclusive(df, str(tmp_path / "in/x"), [str(tmp_path / "in")])
    (tmp_path / "sums").write_text("ab  p/q r.txt\n\n")
    assert S.read_checksums(spark, str(tmp_path / "sums")).first()["path"] == "p/q r.txt"


def test_stream_scores_what_arrives_once(spark, tmp_path):
    for k in (1, 2):
        spark.createDataFrame([("infill", "empty", "en", "m", i, "r") for i in (1, 1, k)], P.SCHEMA).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        q = P.score_stream(P.arriving(spark, str(tmp_path / "in")), lambda df: df.withColumn("score", F.lit(1.0)), str(tmp_path / "out"), str(tmp_path / "ck"))
        q.awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r["batch"], r["sample_id"]) for r in out.collect()) == [(0, 1), (1, 2)]


def test_validators(spark):
    rows = spark.createDataFrame([("<table><tr><td>a</td></tr></table>", g) for g in ("", "```html```", "<p>a</p>", "<table><tr><td>a</td><td></td></tr></table>", "<table><tr><td>a</td></tr></table>", "<table><tr><td>b</td></tr></table>")], "s string, g string")
    got = [r[0]["reason"] for r in rows.select(V.generated_html(F.col("s"), F.col("g"))).collect()]
    assert got == ["empty", "fenced", "no table", "structure differs", "text unchanged", ""]
    one = spark.range(1)
    doc = lambda i: F.lit('{"model":"m","sample_id":%s,"lang":"en","task":"t","condition":"c"}' % i)
    same = [one.select(V.identity_ok(doc(i), F.lit("m"), F.lit(1), F.lit("en"), F.lit("t"), F.lit("c"))).first()[0] for i in ("1", "true", '"1"', "2")]
    assert same == [True, False, False, False]
    assert [one.select(V.score_ok(F.lit(x).cast("double"))).first()[0] for x in (0.5, float("nan"), 1.5, None)] == [True, False, False, False]
    names = one.select(V.placeholder_names(F.lit("姓名 表"), F.lit("[姓名1] [地址-电话]"))).first()[0]
    assert names == ["地址", "电话"]


def test_job_states_keep_their_order(spark):
    t, f, n = F.lit(True), F.lit(False), F.lit(None).cast("string")
    state = lambda *a: spark.range(1).select(V.job_state(*a)).first()[0]
    ready = F.lit("ready")
    assert state(F.lit("source_error"), f, f, f, f, n, n, f, t, t) == "source_error"
    assert state(ready, f, f, f, f, n, n, f, t, t) == "not_run"
    assert state(ready, t, t, f, f, F.lit("not_run"), n, f, t, t) == "source_mismatch"
    assert state(ready, t, t, t, t, F.lit("backend_error"), n, f, t, t) == "backend_error"
    assert state(ready, t, t, t, t, F.lit("odd"), n, t, f, f) == "prediction_error"
    assert state(ready, t, t, t, t, n, n, t, f, t) == "model_format_failure"
    assert state(ready, t, t, t, t, n, n, t, f, f) == "scored"


def test_jobs_shards_and_splits(spark):
    samples = spark.createDataFrame([("en", 1, "<p></p>", "c", 2), ("en", 2, "<p></p>", None, 2), ("en", 3, "<p></p>", "c", 0)], "lang string, sample_id int, html string, context string, targets int")
    assert [r["status"] for r in J.jobs(samples, "infill", "empty").orderBy("sample_id").collect()] == ["ready", "source_error", "ineligible_no_targets"]
    rows = spark.createDataFrame([("b", i, n) for i, n in enumerate((40, 70, 10, 300, 20, 90))], "b string, i long, n long")
    assert [r["shard"] for r in sharded(rows, ["b"], "i", "n", 100).orderBy("i").collect()] == [0, 1, 1, 2, 3, 4]
    train, test = J.split_ids(range(1, 829))
    assert len(train) == 662 and len(test) == 166 and not train & test
    out = J.batch_outcome(spark.createDataFrame([("a", True), ("b", False), ("c", False), ("d", False)], "custom_id string, has_prediction boolean"), spark.createDataFrame([("a", None, "x"), ("b", None, "x"), ("c", "e", None), ("d", None, " "), ("z", None, "x")], "custom_id string, error string, response string"))
    assert {r["custom_id"]: r["state"] for r in out.collect()} == {"a": "skip", "b": "write", "c": "failed", "d": "empty", "z": "unknown"}


def test_text_functions(spark):
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    assert get(X.infill_text(F.lit("ＡＢ－ß １"))) == "abss1"
    assert get(X.field_text(F.lit(" 12·姓 名: 3"))) == "姓名"
    assert get(X.percent(F.lit(0.25 / 100))) == "0.2%" and get(X.signed_percent(F.lit(0.5))) == "+50.0%"
    assert get(X.domains(F.lit("see https://www.Agency.gov/x; http://a.b:80?c"))) == ["agency.gov", "a.b:80"]
    assert get(X.all_public(F.array(F.lit("agency.gov"), F.lit("canada.ca")))) and not get(X.all_public(F.array().cast("array<string>")))
    assert get(X.clean_html(F.lit("Sure:\n```html\n<table></table>\n```"))) == "<table></table>"
    assert get(X.tuned_base(F.lit("finetuned_Org/M-7B_InfillFT_v2"))) == "Org/M-7B"
    assert X.format_bytes(1536) == "1.5 KiB"
    assert get(X.response_text(F.lit('{"choices":[{"message":{"content":"hi"}}]}'))) == "hi"


def test_overlay_and_stage_audit(spark):
    rows = [("en", 1, "a", 0, "0", "h"), ("en", 1, "b", 1, "0", "h"), ("en", 2, "a", 0, "0", "h"), ("en", 2, "b", 1, "0", "g")]
    got = {r["sample_id"]: r for r in G.overlay(spark.createDataFrame(rows, "lang string, sample_id int, root string, root_order int, stage string, sha256 string")).collect()}
    assert not got[1]["conflict"] and got[1]["root"] == "a" and got[2]["conflict"]
    want = spark.createDataFrame([("0", "en", i) for i in (1, 2, 3)], "stage string, lang string, sample_id int")
    seen = spark.createDataFrame([("0", "en", i) for i in (2, 3, 3, 9)], "stage string, lang string, sample_id int")
    r = G.stage_audit(want, seen).first()
    assert (r["missing"], r["extra"], r["duplicates"], r["complete"]) == (1, 1, 1, False)


def test_sinks_and_loaders(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a\nb", None), (2, "c", "d")], "sample_id long, text string, more string")
    S.write_json(rows, str(tmp_path / "j"))
    assert sorted(map(tuple, S.read_jsonl(spark, str(tmp_path / "j"), "sample_id long, text string, more string").collect())) == [(1, "a\nb", None), (2, "c", "d")]
    S.write_text(rows.select("more").where("more is not null"), str(tmp_path / "t"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "t")).collect()] == ["d"]
    other = spark.createDataFrame([(3, "x")], "sample_id long, extra string")
    assert S.write_csv_union([rows.drop("text"), other], str(tmp_path / "c"))
    assert S.read_csv(spark, str(tmp_path / "c")).columns == ["sample_id", "more", "extra"]
    for text in ("old", "new"):
        S.replace_predictions(spark.createDataFrame([("infill", "empty", g, "m", text) for g in ("en", "zh") if text == "old" or g == "en"], "task string, condition string, lang string, model string, raw_response string"), str(tmp_path / "p"))
    assert sorted((r["lang"], r["raw_response"]) for r in spark.read.json(str(tmp_path / "p")).collect()) == [("en", "new"), ("zh", "old")]
    assert not S.write_csv_union([rows.limit(0)], str(tmp_path / "none")) and [f.stat().st_size for f in (tmp_path / "none").glob("part-*")] == [0]


def test_metadata_scan_and_audits(spark, tmp_path):
    for name, body in (("b.json", "[1]"), ("a.json", "[]"), ("c.JSON", "[]"), (".h.json", "[]"), ("d.json", "{}"), ("e.json", "[")):
        (tmp_path / name).write_text(body)
    rows, warnings = S.meta_documents(spark, str(tmp_path))
    assert [r["path"].rsplit("/", 1)[1] for r in rows.collect()] == ["a.json", "b.json"]
    assert sorted(r["warning"] for r in warnings.collect()) == ["no JSON", "no list"]
    (tmp_path / "audit").write_text('{"items": [{"output": "x.png", "ok": true}, {"output": "y.png"}]}')
    assert [tuple(r) for r in S.layout_audits(spark, str(tmp_path / "audit")).collect()] == [("x.png", True), ("y.png", False)]
    docs = S.json_documents(S.listing(spark, str(tmp_path)).where("name = 'd' or name = 'e'"))
    assert {r["path"].rsplit("/", 1)[1]: r["json"] is None for r in docs.collect()} == {"d.json": False, "e.json": True}


def test_paths_languages_and_images(spark, tmp_path):
    assert S.stage_path("r/", "html_empty", "en", 7) == "r/html_template/data_en/7.html" and S.stage_path("r", "context", "zh") == "r/context/data_zh"
    with pytest.raises(ValueError):
        S.stage_path("r", "other", "en")
    for at in ("html_template/data_en/1.html", "context/data_fr/2.txt", "context/data_xx/note.txt", "other/data_es/1.html"):
        (tmp_path / at).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / at).write_text("x")
    assert sorted(r["lang"] for r in S.languages(spark, str(tmp_path)).collect()) == ["en", "fr"]
    assert [r["path"].rsplit("/", 1)[1] for r in S.html_files(spark, [str(tmp_path), str(tmp_path / "other")]).collect()] == ["1.html", "1.html"]
    for name in ("01.png", "1.PNG", "2.png", "x.png"):
        (tmp_path / name).write_bytes(b"p")
    found = {r["sample_id"]: r["path"].rsplit("/", 1)[1] for r in S.numeric_pngs(spark, str(tmp_path)).collect()}
    assert found == {1: "1.PNG", 2: "2.png"}
    files, templates = spark.createDataFrame([("1",), ("2",)], "name string"), spark.createDataFrame([("1", "HTML", "/t/1.HTML"), ("1", "html", "/t/1.html"), ("2", "txt", "/t/2.txt")], "name string, ext string, path string")
    assert sorted((r["name"], r["template_path"]) for r in S.sibling_templates(files, templates).collect()) == [("1", "/t/1.HTML"), ("2", None)]


def test_test_records_fall_back(spark, tmp_path):
    from gridleaf.operators import selection as C

    rows = [{"task": "infill", "lang": g, "split": s, "sample_id": i} for g, s, i in (("en", "test", 2), ("en", None, 1), ("en", "train", 3), ("zh", "test", 4))]
    (tmp_path / "all_both_template_test.jsonl").write_text("\n".join(map(__import__("json").dumps, rows)))
    assert [r["sample_id"] for r in S.test_records(spark, str(tmp_path), "infill", "en").collect()] == [1, 2]
    assert [r["sample_id"] for r in S.test_records(spark, str(tmp_path), "infill", "both", 1).collect()] == [1]
    with pytest.raises(FileNotFoundError):
        S.test_records(spark, str(tmp_path / "x"), "infill", "en")
    assert C.expand_tasks(None) == C.TASKS and C.expand_tasks(["all"]) == C.TASKS and C.expand_langs("both") == ("en", "zh")
    for bad in (lambda: C.expand_tasks(["x"]), lambda: C.expand_langs("fr")):
        with pytest.raises(ValueError):
            bad()
    chosen = spark.createDataFrame([("en", 1), ("en", 9)], "lang string, sample_id long")
    with pytest.raises(ValueError):
        C.balanced_view(spark.createDataFrame([("en", 1)], "lang string, sample_id long"), chosen, n=2)


def test_existing_outputs_and_versions(spark):
    from gridleaf.operators import workflow as W

    cell = lambda a, b: f"<table><tr><td>{a}</td><td>{b}</td></tr></table>"
    rows = spark.createDataFrame([(cell("姓名", "x"), o, cell("姓名", ""), cell("姓名", "x")) for o in (cell("姓名", "[姓名]"), cell("other", "[姓名]"), cell("姓名", "[年龄]"), " ")], "s string, o string, t string, f string")
    got = [r[0]["reason"] for r in rows.select(V.existing_placeholders(*map(F.col, "sotf"))).collect()]
    assert got == ["", "static cells changed", "names not in the source", "empty"]
    summaries = spark.createDataFrame([("infill", "m", "empty", "en", v) for v in ("legacy_v1", None, W.MATCHER)], "task string, model string, condition string, lang string, metric_version string")
    with pytest.raises(ValueError, match="legacy_v1"):
        W.require_versions(summaries)
    W.require_versions(summaries.where(F.col("metric_version") == W.MATCHER))


def test_json_repair_against_cut_documents():
    import json
    import random

    from gridleaf.functions import jsontree as T

    rng = random.Random(3)

    def made(depth):
        kind = rng.randrange(5 if depth else 3)
        if kind < 3:
            return [rng.choice(["a", "b c", 'q"u', "ü", "x\\y"]), rng.randrange(99), rng.choice([True, None, 1.5])][kind]
        return {f"k{i}": made(depth - 1) for i in range(rng.randrange(1, 4))} if kind == 3 else [made(depth - 1) for _ in range(rng.randrange(1, 4))]

    for _ in range(300):
        whole = {"first": "value", "rest": made(3)}
        text = json.dumps(whole, ensure_ascii=False)
        assert T.repaired(text) == whole
        for cut in range(20, len(text)):
            found, status = T.lenient(text[:cut])
            assert status == "repaired" and found["first"] == "value"
    assert T.lenient('{"a": 1, "b": [1, 2,], }') == ({"a": 1, "b": [1, 2]}, "repaired") and T.lenient("{'a': tru, b: two words // no\n}")[0] == {"a": "tru", "b": "two words"}
    assert T.lenient("[" * 5000)[1] == "repaired" and T.lenient("{broken")[1] == T.lenient("hello")[1] == "unrepairable"


def test_tuned_names_lose_all_tails(spark):
    from itertools import permutations

    tails = ["_seed=3", "-checkpoint-5", "_checkpoint", " repair", "-InfillFT_v2", "_infill more", "-QA x"]
    names = ["Org/M-7B" + "".join(p) for n in (1, 2, 3) for p in permutations(tails, n)]
    got = spark.createDataFrame([(x,) for x in names], "x string").select(X.tuned_base(F.col("x"))).distinct().collect()
    assert [r[0] for r in got] == ["Org/M-7B"]
    kept = ["Org/M-Checkpoint-5", "Org/M-qa", "M_seedling=3", "M-InfillFTx", "M_checkpoint_x", "M-repaired"]
    got = spark.createDataFrame([(x,) for x in kept], "x string").select("x", X.tuned_base(F.col("x"))).collect()
    assert all(r[0] == r[1] for r in got)
