"""Sources are parsed once where their predictions are scored."""

import pyarrow as pa
import pytest

from gridleaf.functions import dom
from gridleaf.operators import audit, clustered

GOLD = "<table><tr><td>Name</td><td>{0} smith</td></tr></table>"
BLANK = "<table><tr><td>Name</td><td>[Name {0}]</td></tr></table>"


def frames(spark, n, samples, hot=0):
    rows = [("infill", f"m{i}", "empty", "en", s, GOLD.format(s if i % 2 else "x")) for i in range(n) for s in range(samples)]
    rows += [("infill", f"h{i}", "empty", "en", 0, GOLD.format(0)) for i in range(hot)] + [("infill", "m", "empty", "en", 999, "no source"), ("schema", "m", "empty", "en", 0, "other task")]
    predictions = spark.createDataFrame(rows, "task string, model string, condition string, lang string, sample_id int, html string")
    sources = spark.createDataFrame([("en", s, GOLD.format(s), BLANK.format(s)) for s in range(samples)], "lang string, sample_id int, html_filled string, placeholder_html string")
    return predictions, sources


def test_counts_do_not_depend_on_the_deal(spark):
    predictions, sources = frames(spark, 4, 9, hot=700)
    got = {(r.model, r.sample_id): r.hardened_correct for r in audit.audited(predictions, sources).collect()}
    assert len(got) == 36 + 700 and all(v == (1 if m[0] == "h" or int(m[1:]) % 2 else 0) for (m, _), v in got.items())


def test_hot_sources_are_dealt_over_tasks(spark):
    predictions, sources = frames(spark, 1, 3, hot=1000)
    rows = clustered.clustered(predictions.drop("task"), sources, ("lang", "sample_id"), rows=100)
    sizes = {(r.sample_id, r["__part"]): r["count"] for r in rows.groupBy("sample_id", "__part").count().collect() if r.sample_id == 0}
    assert len(sizes) == 11 and max(sizes.values()) < 200
    assert rows.where("__source").count() == 11 + 2


def test_each_source_is_parsed_once(spark, monkeypatch):
    """40 predictions of each of 100 sources: two parses a source and one a prediction."""
    predictions, sources = frames(spark, 40, 100)
    rows = clustered.clustered(predictions.where("task = 'infill'").select("model", "lang", "sample_id", "html"), sources, ("lang", "sample_id"))
    table = pa.Table.from_pylist([r.asDict() for r in rows.collect()])
    seen, parse = [], dom.parse
    monkeypatch.setattr(dom, "parse", lambda html: seen.append(html) or parse(html))
    dom.shared_cells.cache_clear()
    dom.shared_tree.cache_clear()
    out = pa.schema([("n", pa.int64())])
    score = lambda row, source: {"n": audit.prediction_audit(row["html"], source["html_filled"], source["placeholder_html"])["hardened_total"]}
    got = list(clustered.scored(iter(table.to_batches(max_chunksize=64)), ("lang", "sample_id"), ("html_filled", "placeholder_html"), out, score))
    assert sum(b.num_rows for b in got) == 4000
    # Half of the predictions equal their gold form, which is remembered.
    assert len(seen) <= 2 * 100 + 2 * 100 and sum(h.startswith("<table><tr><td>Name</td><td>[") for h in seen) == 100


@pytest.mark.parametrize("rows", [[], [("en", 1)]])
def test_without_predictions(spark, rows):
    predictions, sources = frames(spark, 1, 2)
    assert audit.audited(predictions.where("false"), sources).count() == 0 and audit.audited(predictions, sources.where("false")).count() == 0
