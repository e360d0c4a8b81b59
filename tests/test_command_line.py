"""The command line over small files of its own."""

from __future__ import annotations

import json

import pytest

from seamline.__main__ import main
from tests.test_models import PHP, _tree


def _fk(child, col, parent, rule="NO ACTION"):
    return {"constraint": f"{child}_{col}", "child_table": child, "child_columns": [col], "parent_table": parent, "delete_rule": rule, "all_not_null": True}


@pytest.fixture
def dump(tmp_path):
    fks = [_fk("app_shop", "owned_by", "owners"), _fk("line", "shop_ref", "app_shop"), _fk("note", "line_id", "line")]
    (tmp_path / "schema.json").write_text(json.dumps({"schema": "s", "tables": ["app_shop", "owners", "line", "note", "lone"], "fks": fks}))
    return str(tmp_path / "schema.json")


@pytest.mark.parametrize("wrong", [[], ["--dsn", "x", "--schema-json", "y"], ["--rails", "x", "--yii1", "y"], ["--schema-json", "x", "--compare-graphs"], ["--schema-json", "x", "--churn", "y"], ["--yii1", "x", "--dump-schema", "y"]])
def test_wrong_use(wrong):
    with pytest.raises(SystemExit) as e:
        main(wrong)
    assert e.value.code == 2


def test_unreadable(spark, tmp_path):
    assert main(["--schema-json", str(tmp_path / "none.json")]) == 1


def test_reports(spark, dump, tmp_path, capsys):
    assert main(["--schema-json", dump, "--json", "--out", str(tmp_path / "a.json")]) == 0
    found = json.loads((tmp_path / "a.json").read_text())
    assert [(r["a"], r["b"]) for r in found["bridges"]] == [("app_shop", "line"), ("app_shop", "owners"), ("line", "note")]
    assert all(r["level"] == 2 and r["pattern"].startswith("synchronous") for r in found["bridges"])
    assert [r["table"] for r in found["isolated"]] == ["lone"]
    for form, mark in (("--mermaid", "graph LR"), ("--d2", '"line" -- "note": {style.stroke-dash: 4}'), ("--svg", "stroke-dasharray"), ("--d2-partition", '"group 1": {'), ("--html", "<!DOCTYPE html>"), ("--hub-scan", "threshold=6")):
        assert main(["--schema-json", dump, form]) == 0
        assert mark in capsys.readouterr().out
    assert main(["--schema-json", dump, "--emit-contract", "postgres"]) == 0
    assert 'ALTER TABLE "note" DROP CONSTRAINT "note_line_id";' in capsys.readouterr().out


def test_baseline(spark, dump, tmp_path, capsys):
    main(["--schema-json", dump, "--json", "--out", str(tmp_path / "a.json")])
    assert main(["--schema-json", dump, "--baseline", str(tmp_path / "a.json")]) == 0
    more = json.loads(open(dump).read())
    more["fks"].append(_fk("lone", "note_id", "note"))
    (tmp_path / "more.json").write_text(json.dumps(more))
    assert main(["--schema-json", str(tmp_path / "more.json"), "--baseline", str(tmp_path / "a.json")]) == 3


def test_catalog_with_tree(spark, dump, tmp_path, capsys):
    root = _tree(tmp_path / "app", PHP)
    assert main(["--schema-json", dump, "--yii1", root, "--compare-graphs", "--dump-schema", str(tmp_path / "d.json")]) == 0
    assert "## coverage" in capsys.readouterr().out
    assert "line" in json.loads((tmp_path / "d.json").read_text())["tables"]
