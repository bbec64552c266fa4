import json

from orrery.sources.registry import SOURCES

SALES = """table Sales
	lineageTag: t-1

	measure Total = SUM(Sales[Amount])
		lineageTag: m-1

	measure Idle = 1

	column Amount
		dataType: double

	column Key
		dataType: int64

	partition p = m
		source = let x = 1 in x
"""
RELATIONSHIPS = """relationship r1
	fromColumn: Sales.Key
	toColumn: Days.Hidden
"""


def _write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def _visual(name, *fields):
    return {"config": json.dumps({"name": name, "q": [{"Property": f} for f in fields]}), "filters": "[]"}


def test_every_edge_end_is_one_item(spark, tmp_path):
    base = tmp_path / "Shop.SemanticModel" / "definition"
    _write(base / "tables" / "Sales.tmdl", SALES)
    _write(base / "relationships.tmdl", RELATIONSHIPS)
    pages = [{"displayName": "P", "visualContainers": [_visual("v1", "Total", "Nowhere"), _visual("v2", "Total")]}, {"displayName": "Q", "visualContainers": []}]
    _write(tmp_path / "One.Report" / "report.json", json.dumps({"sections": pages}))
    _write(tmp_path / "Two.Report" / "report.json", json.dumps({"sections": [{"displayName": "P", "visualContainers": [_visual("v1", "Amount", "Nowhere")]}]}))
    tables = SOURCES["bi"](spark, {"folder": f"file://{tmp_path}", "workspace": "Retail"})
    rows = tables["items"].collect()
    items = {(r.item_type, r.item_name, r.dataset_name if r.item_type in ("PB_PAGE", "PB_VISUAL") else None): r for r in rows}
    assert len(rows) == len({r.item_id for r in rows}) == len(items)
    edges = tables["edges"].collect()
    assert {e[side] for e in edges for side in ("source_id", "target_id")} <= {r.item_id for r in rows}
    kinds = {k: sum(r.item_type == k for r in rows) for k in {r.item_type for r in rows}}
    assert kinds == {"PB_WORKSPACE": 1, "PB_TABLE": 1, "PB_MEASURE": 2, "PB_COLUMN": 3, "PB_REPORT": 2, "PB_PAGE": 3, "PB_VISUAL": 3, "PB_FIELD": 1}
    total, amount, idle, key, hidden = (items[k, n, None] for k, n in (("PB_MEASURE", "Total"), ("PB_COLUMN", "Amount"), ("PB_MEASURE", "Idle"), ("PB_COLUMN", "Key"), ("PB_COLUMN", "Hidden")))
    assert [(r.connected_reports, r.connected_report_pages, r.connected_visuals) for r in (total, amount, idle)] == [(1, 1, 2), (1, 1, 1), (0, 0, 0)]
    assert [r.is_unused for r in (total, amount, idle, key)] == [False, False, True, True]
    assert [r.is_related for r in (key, hidden, amount, items["PB_TABLE", "Sales", None])] == [True, True, False, True] and total.is_related is None
    assert hidden.named_only and not key.named_only and key.datatype == "int64" and total.lineage_tag == "m-1"
    nowhere, one = items["PB_FIELD", "Nowhere", None], items["PB_REPORT", "One", None]
    assert (nowhere.connected_reports, nowhere.connected_visuals) == (2, 2) and (one.connected_report_pages, one.connected_visuals) == (2, 2)
    named = {(e.source_type, e.source, e.target_type) for e in edges if e.target_type == "PB_VISUAL"}
    assert named == {("PB_MEASURE", "Total", "PB_VISUAL"), ("PB_FIELD", "Nowhere", "PB_VISUAL"), ("PB_COLUMN", "Amount", "PB_VISUAL")}
    # A member's edge to a visual starts at the item that the model's own edges lead to
    assert {e.source_id for e in edges if e.source == "Total"} == {total.item_id} == {e.target_id for e in edges if e.target == "Total"}
    assert {r.workspace_name for r in rows} == {"Retail"}
