"""The registered queries over whole tables, and the pipeline against its parts."""

import os
import subprocess
import sys
import zlib

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from check import connect, difference
from tallywire.llm import queries as llm
from tallywire.llm.exact_dedup import exact_dedup
from tallywire.llm.signature_join import near_duplicates

from . import cases
from .test_signature_join import brute as near

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_against_sql(spark, con, name):
    assert difference(entry.queries()[name](spark, FOLDER), con, entry.oracle_sql()[name]) is None


COLUMNS = {
    "op1_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op2_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, "
    "doc_tokens bigint, sequence_id bigint, offset bigint",
    "op3_hash_forest": "query_id bigint, rank int, vec_id bigint, score double",
    "op4_html_layout": "page_id bigint, text string",
    "op5_pitman_yor": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, "
    "train_tokens bigint, base_score double, score double",
    "op6_signature_join": "doc_id bigint, n_shingles bigint, component_id bigint",
    "op7_exact_dedup": "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, "
    "text_sha256 string",
    "op8_gear_dedup": "doc_id bigint, start bigint, length bigint, chunks bigint, "
    "first_doc_id bigint",
    "op9_url_rules": "page_id bigint, host string, path string, rule string, verdict string",
    "op10_mixing": "doc_id bigint, source string, slot bigint, position bigint",
    "op11_filter_audit": "part string, filter_order string, step int, kept bigint, "
    "removed bigint, redundant bigint, unique_fails bigint, good_lost bigint, "
    "toxic_lost bigint, shapley bigint",
    "op12_merkle_log": "doc_id bigint, leaf string, subroot string, root string, "
    "proof_sha256 string, folded_root string, verified boolean",
    "op13_pivot_index": "query_id bigint, rank int, vec_id bigint, score bigint",
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, name):
    df = entry.queries()[name](spark, FOLDER)
    kinds = dict(df.dtypes)
    for column in COLUMNS[name].split(", "):
        column, kind = column.split()
        assert kinds[column] == kind, column
    whole = {"op3": 50, "op4": 50, "op9": 50, "op11": 12_000, "op13": 50}.get(name.split("_")[0], 200)
    if name not in ("op2_packing", "op8_gear_dedup"):
        assert df.count() == whole


def test_pipeline(spark):
    """Each stage against what a few lines of Python make of the one before."""
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "exact dedup", "n-gram Jaccard join", "mixing sources", "packing"
    ]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, kept = docs.columns, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(
            stage(spark, docs, FOLDER).collect(), docs.schema
        ).repartition(3)
        assert docs.columns == columns
        kept.append([(r.doc_id, r.text) for r in docs.collect()])
    clean, unique, distinct, mixed = kept
    last: dict = {}
    for i, t in sorted(clean):
        last[cases.lower(t)] = i
    assert sorted(i for i, _ in unique) == sorted(last.values())
    assert {i for i, _ in distinct} == {c for _, _, c in near(unique, 5, 80)}
    assert sorted(mixed) == sorted(distinct)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()
    assert {r.doc_id for r in pieces} == {i for i, _ in distinct}


def test_stages_with_clashing_columns(spark):
    """Extra columns come through the stages as they are, whatever they are called."""
    docs = cases.clashing(cases.docs(spark, cases.AWKWARD))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, FOLDER)
        assert found.columns == docs.columns, name
        assert 0 < found.count() <= docs.count(), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).count() > 0
    assert exact_dedup(docs).count() == docs.count()
    assert near_duplicates(docs).count() == docs.count()


def test_executors_need_no_installed_package(tmp_path):
    """Executors start in a folder from which the package cannot be imported."""
    root = os.path.dirname(os.path.abspath(entry.__file__))
    names = [*llm.queries(), "pipeline"]
    code = (
        f"import sys; sys.path.insert(0, {root!r})\n"
        "import __spark_entry__ as e\n"
        "from tallywire.session import local_session\n"
        "s = local_session(8, 4)\n"
        f"for n in {names!r}:\n"
        f"    e.queries()[n](s, {FOLDER!r}).write.format('noop').mode('overwrite').save()\n"
    )
    done = subprocess.run(
        [sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=900
    )
    assert done.returncode == 0, done.stderr[-2000:]


def test_pipeline_run(spark):
    assert corpus_pipeline.run(spark, FOLDER).count() > 0


def test_language_model_beats_the_base_on_unseen_documents(spark):
    rows = entry.queries()["op5_pitman_yor"](spark, "/root/testdata/sf0.01").collect()
    unseen = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2) for r in rows)
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)


def test_search_finds_nine_of_ten(spark):
    from .test_hash_forest import brute, found

    table = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    want = brute([(r.vec_id, r.embedding) for r in table.collect()])
    got = found(entry.queries()["op3_hash_forest"](spark, FOLDER))
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
