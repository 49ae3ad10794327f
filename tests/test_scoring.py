"""Scoring of single documents: infill, alignment, schema, meta."""

import random

import pytest

from gridleaf.functions import dom, jsontree, meta, scoring
from gridleaf.functions.scoring import infill


def row(*cells):
    return "<table><tr>" + "".join(f"<td>{c}</td>" for c in cells) + "</tr></table>"


V2, V3 = "source_faithful_v2", "source_faithful_v3"


@pytest.mark.parametrize("pred", ["", "V", "Va"])
def test_fragments_do_not_count(pred):
    assert infill(row("L", pred), row("L", "Value"), row("L", "[X]")) == (0, 1)


def test_static_text_around_a_value():
    assert infill(row("L: V"), row("L: V"), row("L: [X]")) == (1, 1)


def test_extra_content_is_wrong():
    assert infill(row("Value and more"), row("Value"), row("[X]")) == (0, 1)


@pytest.mark.parametrize(("pred", "ok"), [("a / b", 1), ("b / a", 0), ("a /", 0)])
def test_two_markers_are_one_target(pred, ok):
    assert infill(row(pred), row("a / b"), row("[X] / [Y]")) == (ok, 1)


def test_values_count_in_their_cell_only():
    assert infill(row("L", "", "V"), row("L", "V", ""), row("L", "[X]", "")) == (0, 1)


def test_presentation_does_not_matter():
    assert infill(row("ABC-12"), row("ＡＢＣ 12"), row("[X]")) == (1, 1)


@pytest.mark.parametrize(("pred", "ok"), [("a", 1), ("b", 0)])
def test_input_values(pred, ok):
    cell = '<input type="text" value="{}">'
    assert infill(row(cell.format(pred)), row(cell.format("a")), row(cell.format("[X]"))) == (ok, 1)


def test_tick_states():
    a, b = '<input type="checkbox" checked><input type="checkbox">', '<input type="checkbox"><input type="checkbox" checked>'
    blank = row('[X]<input type="checkbox"><input type="checkbox">')
    assert infill(row(a), row(a), blank) == (1, 1)
    assert infill(row(b), row(a), blank) == (0, 1)


def test_unobservable_markers_are_no_targets():
    assert infill(row("L"), row("L"), row("L[X]"), V2) == (0, 0)


def test_all_top_level_tables_count():
    gold, blank = row("a") + row("b"), row("[X]") + row("[Y]")
    assert infill(gold, gold, blank, V3) == (2, 2)
    assert infill(row("a") + row("c"), gold, blank, V3) == (1, 2)
    assert infill(gold, gold, blank, V2) == (1, 1)


def test_later_tables_keep_their_place():
    longer = "<table><tr><td>h</td></tr><tr><td>i</td></tr></table>" + row("b")
    assert infill(longer, row("h") + row("b"), row("h") + row("[Y]"), V3) == (1, 1)


def test_div_forms():
    form = '<div class="form-container"><div class="row"><div class="col">{}</div><div class="col-half">{}</div></div></div>'
    gold, blank = form.format("a", "b"), form.format("[X]", "[Y]")
    assert infill(gold, gold, blank) == (2, 2)
    assert infill(form.format("a", "c"), gold, blank) == (1, 2)
    assert infill(gold, gold, blank, V2) == (0, 0)


def test_legacy_takes_substrings():
    assert infill(row("V"), row("Value"), row("[X]"), "legacy_v1") == (1, 1)


def test_spans_and_nested_tables():
    html = "<table><tr><td rowspan=2>a</td><td>b</td></tr><tr><td>c</td></tr></table>"
    assert {k: n.text() for k, n in dom.cells(html).items()} == {(0, 0): "a", (0, 1): "b", (1, 1): "c"}
    assert dom.row_widths(dom.parse(html).all("table")[0]) == [2, 2]


def test_tree_builder_is_tolerant():
    root = dom.parse("<table><tr><td>a<td>b</tr></b><br>&amp;<!-- x --><script>y</script>")
    assert [n.name for n in root.walk() if n.name != "#comment"] == ["table", "tr", "td", "td", "br", "script"]
    assert root.text() == "ab&"


def test_alignment_takes_each_input_once():
    gold = "<table><tr><td>Name</td></tr><tr><td>[Name]</td></tr></table>"
    want = [{"key": "Name", "name": "Name", "type": "SI", "row": 1, "col": 0, "dr": 1, "dc": 0}] * 2
    pred = gold.replace("[Name]", '<input name="Name">')
    strategy, found = scoring.alignment(pred, gold, want)
    assert strategy == "analysis" and [ok for _, ok in found] == [True, False]


def test_json_states():
    assert jsontree.lenient("  ")[1] == "empty"
    assert jsontree.lenient("null")[1] == "empty"
    assert jsontree.lenient("7")[1] == "non_string"
    assert jsontree.lenient("{broken")[1] == "unrepairable"
    assert jsontree.lenient('Here: {"a": "}"} end') == ({"a": "}"}, "ok")
    assert jsontree.object_only("[1]", "pred")[1] == "pred_non_dict:list"


def _random_json(rng, depth=0):
    kind = rng.randrange(5 if depth < 3 else 2)
    if kind == 0:
        return rng.choice(["a", "b", None, True, 1, 1.0])
    if kind == 1:
        return rng.choice("xyz")
    if kind == 2:
        return [_random_json(rng, depth + 1) for _ in range(rng.randrange(3))]
    return {k: _random_json(rng, depth + 1) for k in rng.sample("pqrs", rng.randrange(4))}


def _recursive(a, b, i=0, j=0):
    ca, cb = a.children[i], b.children[j]
    d = {(x, 0): sum(a.sizes[c] for c in ca[:x]) for x in range(len(ca) + 1)} | {(0, y): sum(b.sizes[c] for c in cb[:y]) for y in range(len(cb) + 1)}
    for x in range(1, len(ca) + 1):
        for y in range(1, len(cb) + 1):
            d[x, y] = min(d[x - 1, y] + a.sizes[ca[x - 1]], d[x, y - 1] + b.sizes[cb[y - 1]], d[x - 1, y - 1] + _recursive(a, b, ca[x - 1], cb[y - 1]))
    return (a.labels[i] != b.labels[j]) + d[len(ca), len(cb)]


def test_distance_against_recursion_and_bounds():
    rng = random.Random(4)
    for _ in range(150):
        x, y = _random_json(rng), _random_json(rng)
        a, b = jsontree.Tree(x), jsontree.Tree(y)
        d = jsontree.edit_distance(a, b)
        assert d == _recursive(a, b) == jsontree.edit_distance(b, a)
        assert jsontree.edit_distance(a, a) == 0 and jsontree.similarity(x, x) == 1
        assert abs(a.sizes[0] - b.sizes[0]) <= d <= a.sizes[0] + b.sizes[0]


def test_deep_documents_do_not_recurse():
    x = "a"
    for _ in range(900):
        x = [x]
    assert jsontree.similarity(x, x) == 1
    assert jsontree.brackets(jsontree.Tree({"k": ["v"]})) == '{\\{\\}{"k":{[]{"v"}}}}'


def test_conformity():
    t = {"n": "", "rows": [{"a": ""}], "pick": {"value": [""]}}
    assert jsontree.conforms(t, {"n": "x", "rows": [{"a": "1"}], "pick": {"value": ["p", "q"]}})[0]
    assert not jsontree.conforms(t, {"n": "x", "rows": [], "pick": {"value": []}})[0]
    assert not jsontree.conforms(t, {"n": {}, "rows": [{"a": ""}], "pick": {"value": []}})[0]


def test_meta_items_of_a_form():
    html = "<table><tr><td>Name</td><td>[Name]</td></tr><tr><td>Item</td></tr><tr><td>[Item1]</td></tr><tr><td>[Item2]</td></tr></table>"
    found = meta.meta_items(html)
    assert [(i["key"], i["type"], len(i["offsets"])) for i in found] == [("Name", "SI", 1), ("Item", "LI", 2)]


def test_meta_expansion():
    doc = [[{"key": "A", "label_info": {"row": 0, "col": 0}, "placeholder_offset": [{"rows": 1, "cols": 0}, {"rows": 2, "cols": 0}], "type": "LI"}], {"key": "B", "label_info": {"row": -1, "col": 0}, "placeholder_offset": {}, "type": "SI"}]
    assert [(e["row"], e["col"]) for e in jsontree.expected_of(doc)] == [(1, 0), (2, 0)]


def test_markers_become_inputs():
    out = dom.inputs_for_markers('<td>[A]<input type="checkbox" checked></td><td>x [B]</td>')
    assert 'name="A"' in out and "checked" not in out and 'type="text" name="B"' in out


def test_static_cells_are_restored():
    t, f, o = row("Label", "[X]"), row("Label", "v"), row("LABEL", "[Name]")
    assert dom.restored_static(t, f, o) == row("Label", "[Name]")
    assert dom.static_changes(t, f, o) == ["Label"]
