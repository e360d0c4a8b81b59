"""Queries of the registry on folders of other tables than the given ones, against their SQL."""

import os

import duckdb
import pytest

from seamline.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")


def test_isolated_tables_are_those_of_the_folder(spark, tmp_path):
    """Tables beside the usual ones are found, as one file or as parts; one that is not there is not."""
    for name in os.listdir(SF):
        if name != "events.parquet":
            os.symlink(f"{SF}/{name}", tmp_path / name)
    for name in ("returns", "audit"):
        spark.range(3).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    os.symlink(f"{SF}/region.parquet", tmp_path / "region_old.parquet")
    (tmp_path / "notes.txt").write_text("no table")
    con = duckdb.connect()
    for p in tmp_path.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}/*.parquet')" if p.is_dir() else f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    got = sorted(r["table"] for r in registry.queries()["isolated_tables"](spark, str(tmp_path)).collect())
    assert got == sorted(r[0] for r in con.execute(registry.oracle_sql()["isolated_tables"]).fetchall())
    assert got == ["audit", "benchmark", "conversations", "embeddings", "pages", "region_old", "returns"]
