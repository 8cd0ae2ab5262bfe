"""All registered queries against their SQL at the smallest scale."""

import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from check import connect, difference

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
# Those of the optional part are tested beside it.
QUERIES, ORACLES = entry.catalogue.queries(), entry.oracles.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_sql_has_its_query():
    assert not set(ORACLES) - set(QUERIES)
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, FOLDER)
    if name in ORACLES:
        assert difference(df, con, ORACLES[name]) is None
    else:
        assert df.count() > 0


def test_damaged_files_when_the_first_part_of_the_scan_is_empty(spark, con):
    """One row group is read by the part that holds its middle; the parts before it have no row."""
    name, most = "damaged_files", "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(most)
    spark.conf.set(most, "4k")
    try:
        df = entry.queries()[name](spark, FOLDER)
    finally:
        spark.conf.set(most, before)
    assert difference(df, con, ORACLES[name]) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_workers_need_no_installed_package(tmp_path):
    """Executors start in a folder from which the package cannot be imported."""
    root = os.path.dirname(os.path.abspath(entry.__file__))
    code = (
        f"import sys; sys.path.insert(0, {root!r})\n"
        "import __spark_entry__ as e\n"
        "from tallywire.session import local_session\n"
        "s = local_session(2, 2)\n"
        "for n in ('stream_pairing', 'stream_race'):\n"
        f"    assert e.queries()[n](s, {FOLDER!r}).count() > 0, n\n"
    )
    done = subprocess.run(
        [sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=300
    )
    assert done.returncode == 0, done.stderr[-2000:]
