import pytest

from strandloom.llm.rollup import TokenRollup, document_rollup

from .helpers import corpus, empty, table, words


@pytest.fixture
def rollup(spark, tmp_path):
    return TokenRollup(spark, f"file://{tmp_path}/rollup")


def changes(spark, rows):
    return spark.createDataFrame(rows, "id long, source string, lang string, tokenizer string, op string, tokens long")


def totals(r):
    return {(x.source, x.lang, x.tokenizer): (x.n_docs, x.n_tokens) for x in r.totals().collect()}


def test_inserts_revisions_deletes_and_replays(spark, rollup):
    assert totals(rollup) == {}
    assert rollup.commit(1, changes(spark, [(1, "a", "en", "t", "insert", 5), (2, "a", "en", "t", "insert", 7), (3, None, None, "t", "insert", None), (None, "a", "en", "t", "insert", 9)]))
    assert totals(rollup) == {("a", "en", "t"): (2, 12), (None, None, "t"): (1, 0)}
    again = changes(spark, [(1, "a", "en", "t", "insert", 5)])
    assert not rollup.commit(1, again) and rollup.commit(2, again)  # the batch again, and the document again
    assert totals(rollup)["a", "en", "t"] == (2, 12)
    rollup.commit(3, changes(spark, [(1, "b", "en", "t", "revise", 50), (9, "b", "en", "t", "revise", 1), (2, None, None, "t", "delete", None), (8, None, None, "t", "delete", None), (3, "a", "x", "t", "odd", 1)]))
    assert totals(rollup) == {("b", "en", "t"): (1, 50), (None, None, "t"): (1, 0)}
    rollup.commit(4, changes(spark, [(2, "a", "en", "t", "insert", 8), (2, "a", "en", "t", "insert", 8), (1, "b", "en", "u", "insert", 3)]))
    assert totals(rollup) == {("b", "en", "t"): (1, 50), (None, None, "t"): (1, 0), ("a", "en", "t"): (1, 8), ("b", "en", "u"): (1, 3)}
    assert rollup.batches() == [1, 2, 3, 4]


def test_documents(spark, rollup):
    rows = corpus()
    out = {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in document_rollup(rollup, table(spark, rows)).collect()}
    texts = [r[1] or "" for r in rows]
    assert len(set(texts)) < len(texts)  # so batch 3 takes some back, and batch 4 brings them again
    assert rollup.batches() == [1, 2, 3, 4]
    assert rollup.taken(3).filter("tokenizer = 'words-1'").count() == len(texts) - len(set(texts))
    want = {}
    for r in rows:
        n, t = want.get((r[3], r[2], "words-1"), (0, 0))
        want[r[3], r[2], "words-1"] = (n + 1, t + len(words(r[1])))
    assert {k: v for k, v in out.items() if k[2] == "words-1"} == want


def test_odd_documents(spark, rollup):
    docs = spark.createDataFrame(
        [(1, "a b", "en", "s", "x"), (2, None, None, None, "x"), (None, "lost", "en", "s", "x"), (3, "a b", "en", "s", "y"), (3, "a b c", "en", "s", "y"), (4, "w " * 300_000, "en", "t", None)],
        "doc_id long, text string, lang string, source string, tokenizer string",
    )
    out = {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in document_rollup(rollup, docs).filter("tokenizer = 'words-1'").collect()}
    assert out == {("s", "en"): (2, 5), (None, None): (1, 0), ("t", "en"): (1, 300_000)}


def test_second_writer_of_a_batch_loses(spark, rollup, monkeypatch):
    rows = changes(spark, [(1, "a", "en", "t", "insert", 5)])
    late = TokenRollup(spark, rollup.root)

    class Blind:  # the first look finds no batch, as if the other writer came between
        def __init__(self, fs):
            self.fs, self.first = fs, True

        def exists(self, path):
            if self.first:
                self.first = False
                return False
            return self.fs.exists(path)

        def __getattr__(self, name):
            return getattr(self.fs, name)

    late._fs = Blind(late._fs)
    monkeypatch.setattr(late, "batches", lambda: [])
    assert rollup.commit(1, rows)
    assert not late.commit(1, rows)
    assert totals(rollup) == {("a", "en", "t"): (1, 5)}


def test_empty(spark, rollup):
    assert document_rollup(rollup, empty(spark)).count() == 0
