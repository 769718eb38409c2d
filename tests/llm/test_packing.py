import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from strandloom.llm import packing as P

from .helpers import clashing, corpus, empty, table

vocabularies = pytest.importorskip("public_tokenizers")
PATH = vocabularies.path("word_bpe_49k.json")


def check(rows, pieces, max_tokens=4096):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_seq[p.sequence_id].append(p)
    for key, text in rows:
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [2], dtype="<u4")
        at = 0
        for p in sorted(by_doc[key], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes()) and p.length > 0
            at += p.length
        assert at == len(ids)
    for parts in by_seq.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= max_tokens and at & (at - 1) == 0  # full, or a power of two


def test_pieces(spark):
    rows = corpus()
    check([r[:2] for r in rows], P.pack_documents(clashing(table(spark, rows)), PATH).collect())
    assert P.pack_documents(empty(spark), PATH).count() == 0


def test_small_tables_of_words(monkeypatch, spark):
    monkeypatch.setattr(P, "KNOWN_WORDS", 7)
    monkeypatch.setattr(P, "KNOWN_PIECES", 5)
    e = P.WordEncoder(PATH)
    texts = ["don't I'll <|endoftext|>x a b İx É Å ²y ½ _a_ 12ab34 ﬀ ẞ Ǆ", "日本語 テスト", "ΑΣ Σ", "", "a,b.c! &&& ***", "é ́x", "I'M it's 'S"]
    for t in texts:
        assert e([t.encode()])[0] == np.array(e.tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes(), t


def test_ids_column(spark):
    rows = [(1, "hello there world", None, None, None)]
    r, = P.pack_documents(table(spark, rows, 1), PATH, with_ids=True, max_tokens=4096).orderBy("start").limit(1).collect()
    assert zlib.crc32(bytes(r.ids)) == r.ids_crc32


def test_examples_hold_all_limits(spark):
    rng = random.Random(2)
    rows = [(i, rng.randrange(1, 900), 0) for i in range(500)]
    rows = [(i, n, rng.randrange(0, n + 1)) for i, n, _ in rows] + [(500, None, None)]
    df = spark.createDataFrame(rows, "example_id long, n_tokens long, n_loss long").repartition(2)
    got = P.pack_examples(df, max_tokens=2048, max_segments=5, max_loss=900 + 100).collect()
    size = {i: (n or 0, loss or 0) for i, n, loss in rows}
    bins = defaultdict(list)
    for p in got:
        bins[p.sequence_id].append(p)
    assert sorted(p.example_id for p in got) == [r[0] for r in rows]
    for parts in bins.values():
        assert sum(size[p.example_id][0] for p in parts) <= 2048 and len(parts) <= 5 and sum(size[p.example_id][1] for p in parts) <= 1000
    least = max(sum(s[0] for s in size.values()) / 2048, len(rows) / 5, sum(s[1] for s in size.values()) / 1000)
    assert len(bins) <= 1.25 * least + 2


def test_too_large_example(spark):
    with pytest.raises(Exception, match="fits no sequence"):
        P.pack_examples(spark.createDataFrame([(1, 5000, 0)], "example_id long, n_tokens long, n_loss long")).collect()


def test_cut_with_loss_limit():
    p = P.Packer(100, 3, 40, cut=True)
    p.add("a", 150, 75)
    p.add("b", 30, 0)
    bins = []
    while p.keys:
        bins.append(p.fill())
    assert sum(x[2] for b in bins for x in b) == 180 and all(sum(x[2] for x in b) <= 100 and len(b) <= 3 for b in bins)
