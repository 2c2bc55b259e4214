"""Written intermediates and the scopes that own them."""

import glob

import pytest

from lakeward.session import checkpoint_dir, discard, materialize, scratch, scratch_database


def tables(spark):
    return {t.name for t in spark.catalog.listTables(scratch_database(spark))}


def files(spark, label):
    root = checkpoint_dir(spark).removeprefix("file:")
    return glob.glob(f"{root}/lakeward-tables/{label}*/*.parquet")


def test_scope_drops_tables_and_files(spark):
    before = tables(spark)
    with scratch(spark) as keep:
        gone = materialize(spark.range(10), "scope-gone")
        early = materialize(spark.range(5), "scope-early", bucket="id")
        assert gone.count() == 10 and early.count() == 5 and files(spark, "scope_gone") and files(spark, "scope_early")
        discard(early)
        assert not files(spark, "scope_early")
        with scratch(spark) as inner:
            stays = inner(materialize(spark.range(3), "scope-stays"))
            materialize(spark.range(3), "scope-gone")
        assert len(tables(spark) - before) == 2
        keep(stays)
    assert stays.count() == 3 and len(tables(spark) - before) == 1
    assert not files(spark, "scope_gone") and files(spark, "scope_stays")


def test_an_error_drops_all(spark):
    before = tables(spark)
    with pytest.raises(ValueError), scratch(spark) as keep:
        keep(materialize(spark.range(3), "scope-error"))
        raise ValueError
    assert tables(spark) == before
    alone = materialize(spark.range(2), "scope-alone")
    assert alone.count() == 2
