"""The pipeline stage by stage on a small folder, and the registry of queries."""

import pytest

from .helpers import corpus, table


@pytest.fixture
def folder(spark, tmp_path):
    rows = corpus(9)
    rows += [(5000 + i, " ".join(f"q{j * 13 % 97}{i}" for j in range(60)) + " zorgfuk blatwim", "l0", "s", 10) for i in range(40)]
    rows.append((7000, "so bar1q con2q dil3q far4q gon5q hil6q jar7q kon8q lil9q mar10q end", "l0", "s", 66))
    d = str(tmp_path / "sf")
    table(spark, rows).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(r[0], int(r[0] >= 5000 and r[0] < 6000)) for r in rows if r[1]], "doc_id long, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, "Bar1q con2q dil3q far4q gon5q hil6q jar7q kon8q lil9q mar10q?")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, rows


def test_stages(spark, folder):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline as C

    d, rows = folder
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in C.STAGES[:-1]:
        docs = stage(spark, docs, d).persist()
        assert docs.columns == columns
        seen.append({r.doc_id: r.text for r in docs.collect()})
    toxic, near, cut, clean = seen
    assert not [i for i in toxic if 5000 <= i < 6000] and len(toxic) == len(rows) - 40
    assert set(near) < set(toxic) and all(near[i] == toxic[i] for i in near)
    from .test_near_dedup import brute

    assert set(near) == {i for i, v in brute([(i, t) for i, t in toxic.items()], 80).items() if v[2]}
    assert set(cut) <= set(near) and any(cut[i] != near[i] for i in cut)
    assert set(cut) - set(clean) == {7000}
    packed = C.STAGES[-1][1](spark, docs, d).collect()
    assert {p.doc_id for p in packed} == set(clean)
    assert {p.doc_id for p in C.run(spark, d).collect()} == set(clean)


def test_extra_columns_nulls_and_repeats(spark, folder):
    from pyspark.sql import functions as F

    import corpus_pipeline as C

    from .helpers import clashing

    d, rows = folder
    docs = clashing(spark.read.parquet(f"{d}/documents.parquet")).withColumns({c: F.lit(c) for c in ("kept", "n_removed", "kept_text", "text2", "toxic", "found", "ca", "bands")})
    docs = docs.unionByName(docs.filter("doc_id = 7000")).unionByName(docs.filter("doc_id = 1").withColumn("doc_id", F.lit(None).cast("long")).withColumn("text", F.lit(None).cast("string")))
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, docs, d).persist()
        assert out.columns == docs.columns and out.filter("toxic <> 'toxic' or kept <> 'kept'").count() == 0
        assert out.filter("doc_id is null").count() == 1
        docs = out
        if name == "minhash_near_dedup":
            assert docs.filter("doc_id = 7000").count() == 1
    assert C.STAGES[-1][1](spark, docs, d).filter("doc_id is null").count() == 1


def test_empty_documents(spark, folder, tmp_path):
    import corpus_pipeline as C

    d, _ = folder
    docs = spark.read.parquet(f"{d}/documents.parquet").limit(0)
    for _, stage in C.STAGES:
        assert stage(spark, docs, d).count() == 0


def test_registry():
    import __spark_entry__ as e

    names = list(e.queries())
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11)) and "pipeline" in names
