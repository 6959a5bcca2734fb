"""The driver contract: every query runs and equals its SQL on all scale factors."""

import json
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from tallymark.sources import read_table

from conftest import TESTDATA

ROOT = Path(contract.__file__).resolve().parent
SCALES = ("sf0.001", "sf0.01", "sf0.1")


# The queries of the subpackage llm have their own tests.
OWN = ("pricing_summary",)


def test_every_query_has_its_sql():
    assert set(OWN) <= contract.oracle_sql().keys() <= contract.queries().keys()


def test_entry_returns_rows_with_a_stable_schema(spark):
    first, second = contract.entry(spark), contract.entry(spark)
    assert first.schema == second.schema
    assert first.count() > 0


@pytest.mark.parametrize("scale", SCALES)
@pytest.mark.parametrize("name", OWN)
def test_query_equals_its_sql(spark, duck, name, scale):
    data_dir = str(TESTDATA / scale)
    result = contract.queries()[name](spark, data_dir)
    expected = duck(data_dir).sql(contract.oracle_sql()[name])
    assert result.columns == expected.columns
    assert sorted(map(tuple, result.collect())) == sorted(expected.fetchall())


@pytest.mark.parametrize("scale", SCALES)
def test_pricing_summary_is_close_to_sums_of_doubles(spark, duck, scale):
    data_dir = str(TESTDATA / scale)
    result = contract.queries()["pricing_summary"](spark, data_dir)
    expected = duck(data_dir).sql(
        """
        SELECT l_returnflag, l_linestatus, sum(l_quantity),
               sum(l_extendedprice * (1 - l_discount)), avg(l_discount), count(*)
        FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-12-01 00:00:00'
        GROUP BY l_returnflag, l_linestatus
        """
    )
    pairs = zip(sorted(map(tuple, result.collect())), sorted(expected.fetchall()), strict=True)
    for got, want in pairs:
        assert got[:2] == want[:2]
        assert got[2:] == pytest.approx(want[2:], abs=0.01)


@pytest.mark.parametrize("name", OWN)
@pytest.mark.parametrize(
    ("option", "value"),
    [
        ("spark.sql.adaptive.enabled", "false"),
        ("spark.sql.ansi.enabled", "false"),
        ("spark.sql.session.timeZone", "Asia/Tokyo"),
        ("spark.sql.shuffle.partitions", "200"),
        ("spark.sql.codegen.wholeStage", "false"),
    ],
)
def test_result_does_not_depend_on_session_options(spark, conf, name, option, value):
    data_dir = str(TESTDATA / "sf0.01")
    expected = sorted(map(tuple, contract.queries()[name](spark, data_dir).collect()))
    conf(option, value)
    assert sorted(map(tuple, contract.queries()[name](spark, data_dir).collect())) == expected


@pytest.mark.parametrize("null_share", [0.1, 0.95])
@pytest.mark.parametrize("hot_share", [0.4, 0.99])
def test_pricing_summary_equals_its_sql_with_nulls_and_a_hot_group(
    spark, tmp_path, null_share, hot_share
):
    lineitem = read_table(spark, str(TESTDATA / "sf0.01"), "lineitem")
    gaps = {
        name: F.when(F.rand(seed) >= null_share, F.col(name))
        for seed, name in enumerate(
            ["l_quantity", "l_extendedprice", "l_discount", "l_linestatus", "l_shipdate"]
        )
    }
    hot = F.when(F.rand(9) < hot_share, "A").otherwise(F.col("l_returnflag"))
    altered = lineitem.withColumns({**gaps, "l_returnflag": hot}).repartition(5)
    altered.write.parquet(str(tmp_path / "lineitem.parquet"))

    result = contract.queries()["pricing_summary"](spark, str(tmp_path)).collect()
    with duckdb.connect() as connection:
        files = str(tmp_path / "lineitem.parquet" / "*.parquet")
        connection.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{files}'")
        expected = connection.execute(contract.oracle_sql()["pricing_summary"]).fetchall()
    assert any(row["l_linestatus"] is None for row in result)
    assert sorted(map(tuple, result), key=str) == sorted(expected, key=str)


def test_pandas_types_equal_those_of_the_sql(spark, duck):
    data_dir = str(TESTDATA / "sf0.01")
    connection = duck(data_dir)
    for name in OWN:
        query = contract.queries()[name]
        expected = connection.sql(contract.oracle_sql()[name]).df()
        assert query(spark, data_dir).toPandas().dtypes.to_dict() == expected.dtypes.to_dict()


def run_python(*arguments, cwd, **environment):
    done = subprocess.run(
        [sys.executable, *arguments],
        cwd=cwd,
        env={**os.environ, **environment},
        capture_output=True,
        text=True,
        timeout=300,
        check=True,
    )
    return done.stdout.splitlines()


def test_contract_loads_by_path_from_anywhere(tmp_path):
    load = (
        "from importlib.util import module_from_spec, spec_from_file_location as locate\n"
        f"spec = locate('contract', {str(ROOT / '__spark_entry__.py')!r})\n"
        "contract = module_from_spec(spec)\n"
        "spec.loader.exec_module(contract)\n"
        "print(*contract.queries())"
    )
    assert run_python("-c", load, cwd=tmp_path) == [" ".join(contract.queries())]


def test_bench_prints_one_json_line(tmp_path):
    data_dir = str(TESTDATA / "sf0.001")
    lines = run_python(
        str(ROOT / "bench.py"),
        cwd=tmp_path,
        BENCH_SF_DIR=data_dir,
        BENCH_CPUS="2",
        BENCH_QUERIES=",".join(OWN),
    )
    (line,) = lines
    report = json.loads(line)
    assert report["unit"] == "sec" and report["sf"] == "0.001"
    assert report["queries"].keys() == set(OWN)
    assert report["value"] == pytest.approx(sum(report["queries"].values()), abs=1e-3)


def test_contract_stands_without_the_subpackage(tmp_path):
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    skipped = shutil.ignore_patterns("llm", "__pycache__")
    shutil.copytree(ROOT / "tallymark", tmp_path / "tallymark", ignore=skipped)
    load = "import __spark_entry__ as contract; print(*contract.queries(), *contract.oracle_sql())"
    (line,) = run_python("-c", load, cwd=tmp_path, PYTHONPATH=str(tmp_path))
    assert line == "pricing_summary pricing_summary"


def test_nothing_else_imports_the_subpackage():
    files = [*(ROOT / "tallymark").rglob("*.py"), ROOT / "bench.py", ROOT / "scale_pricing.py"]
    own = [file for file in files if "llm" not in file.parts]
    assert own and not any("tallymark.llm" in file.read_text() for file in own)
