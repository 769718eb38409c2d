"""Every query with SQL gives the rows of DuckDB on the same tables."""

import os
import re

import duckdb
import pytest

from strandloom.operators import assembly as A
from strandloom.plans import catalog


@pytest.fixture(scope="module")
def db(data_dir):
    con = duckdb.connect()
    for name in os.listdir(data_dir):
        con.sql(f"create view {name.removesuffix('.parquet')} as select * from '{data_dir}/{name}'")
    return con


def rows(df, cols):
    clean = df[cols].astype(object)
    return sorted(map(repr, clean.where(clean.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_matches_sql(spark, data_dir, db, name, tmp_path):
    catalog.QUERIES[name](spark, data_dir).write.parquet(str(tmp_path / "out"))
    got = duckdb.sql(f"select * from '{tmp_path}/out/*.parquet'").df()
    want = db.sql(catalog.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got, sorted(got.columns)) == rows(want, sorted(want.columns))


@pytest.fixture(scope="module")
def deep(spark, data_dir, tmp_path_factory):
    """The tables with twenty times the events, whose ids are shifted."""
    d = tmp_path_factory.mktemp("deep")
    for name in os.listdir(data_dir):
        if name != "events.parquet":
            os.symlink(f"{data_dir}/{name}", d / name)
    duckdb.sql(f"copy (select * replace (event_id + k * 1200 as event_id) from '{data_dir}/events.parquet', range(20) r(k)) to '{d}/events.parquet'")
    return str(d)


def rows_shuffled(spark):
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}


@pytest.mark.parametrize("name", ["joint_somatic", "sample_evidence"])
def test_joint_queries_shuffle_sums(spark, deep, name, tmp_path):
    """Where reads are deep, fewer rows are shuffled than reads have elements, over all jobs of a query; its rows are SQL's."""
    before = rows_shuffled(spark)
    catalog.QUERIES[name](spark, deep).write.parquet(str(tmp_path / "out"))
    shuffled = sum(n for stage, n in rows_shuffled(spark).items() if stage not in before)
    assert 0 < shuffled < catalog.views.pile(spark, deep).count()
    con = duckdb.connect()
    for table in os.listdir(deep):
        con.sql(f"create view {table.removesuffix('.parquet')} as select * from '{deep}/{table}'")
    got, want = con.sql(f"select * from '{tmp_path}/out/*.parquet'").df(), con.sql(catalog.SQL[name]).df()
    assert len(want) > 0 and rows(got, sorted(want.columns)) == rows(want, sorted(want.columns))


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_kernels_run(spark, data_dir, name):
    deeper = data_dir.replace("sf0.001", "sf0.01")  # assemblies need reads enough
    assert catalog.QUERIES[name](spark, deeper if os.path.isdir(deeper) else data_dir).count() > 0


def test_kernels_take_whole_sequences(spark, data_dir, monkeypatch):
    deeper = data_dir.replace("sf0.001", "sf0.01")
    d = deeper if os.path.isdir(deeper) else data_dir
    size = {r.id: len(r.sequence) for r in catalog.views.seqs(spark, d, "benchmark", "item_id").collect()}
    ends = {r.id: sum(int(n) for n, op in re.findall(r"(\d+)([=XID])", r.cigar) if op != "D") for r in catalog.QUERIES["affine_alignment"](spark, d).collect()}
    assert ends == {i: n - 7 for i, n in size.items() if n >= 28}
    seen, assemble = [], A.assemble_windows
    monkeypatch.setattr(A, "assemble_windows", lambda reads, windows, *a, **k: seen.append(windows) or assemble(reads, windows, *a, **k))
    catalog.QUERIES["debruijn_paths"](spark, d)
    covered = {}
    for w in seen[0].collect():
        covered.setdefault(w.contig, set()).update(range(w.start, w.start + len(w.reference)))
    assert covered == {f"b{i}": set(range(n)) for i, n in size.items() if n >= 60}


def test_germline_queries_are_what_they_say(spark, data_dir):
    assert "n_haplotypes" in catalog.QUERIES["germline_assembly"](spark, data_dir).columns
    assert "genotype_id" in catalog.QUERIES["germline_shortcut"](spark, data_dir).columns


def test_entry_contract():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
