"""Classifier, language identification and hidden Markov model: exact parts by brute force, the rest on held-out rows."""

import itertools
import math
import random
from collections import Counter, defaultdict

import numpy as np

from strandloom.llm import hmm as H
from strandloom.llm import language as L
from strandloom.llm import toxicity as T

from .helpers import clashing, corpus, empty, rest, table, words

SYLLABLES = {"xx": ["ka", "to", "mi"], "yy": ["shu", "gre", "bol"], "zz": ["né", "ßu", "ör"]}


def speech(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_languages(spark):
    rng = random.Random(0)
    rows = [(i, speech(rng, lang := rng.choice(list(SYLLABLES)), rng.randrange(5, 400)), lang, None, None) for i in range(200)]
    rows += [(900, None, "xx", None, None), (901, "12 34 !", "yy", None, None), (902, "", None, None, None), (903, rows[0][1], None, None, None)]
    got = {r.doc_id: r for r in L.language_predictions(clashing(table(spark, rows)).drop("lang").join(table(spark, rows).select("doc_id", "lang"), "doc_id")).collect()}
    assert len(got) == len(rows)
    for i, text, lang, *_ in rows:
        r = got[i]
        assert r.held_out == (rest(i, 4) == 2) and 0 <= r.score <= 1
        if i < 900:
            assert r.lang_pred == lang
    assert {got[i].lang_pred for i in (900, 901, 902)} == {"und"} and got[903].lang_pred == rows[0][2]
    assert L.language_predictions(empty(spark)).count() == 0
    bare = table(spark, [(1, "abc", None, None, None)])
    assert L.language_predictions(bare).first().lang_pred == "und"


def longest_match_phrases(text, joined):
    """Phrases of the text by the definition: each the longest match in `joined`, or one symbol that it lacks."""
    n = at = 0
    while at < len(text):
        end = at
        while end < len(text) and text[at : end + 1] in joined:
            end += 1
        n, at = n + 1, max(end, at + 1)
    return n


def test_phrase_counts_against_longest_matches():
    rng = random.Random(3)
    for alphabet, block in ((4, 512), (4, 7), (2, 3), (40, 16), (90, 16)):
        train = [rng.randrange(1, alphabet + 1) for _ in range(300)]
        joined = "".join(map(chr, train))
        texts = [[rng.randrange(0, alphabet + 2) for _ in range(n)] for n in (0, 1, 30, block, 2 * block + 7, 40 * block + 1)]
        texts += [train[20:] + train[:200], [0] * (3 * block), train[:block] * 5]
        spans = np.cumsum([0, *map(len, texts)])
        L_block, L.BLOCK = L.BLOCK, block
        got = L.phrase_counts(np.array([s for t in texts for s in t]), spans, [L.Automaton(np.array(train), alphabet + 2), L.Automaton(np.array(train[:50]), alphabet + 2)])
        L.BLOCK = L_block
        assert got[:, 0].tolist() == [longest_match_phrases("".join(map(chr, t)), joined) for t in texts]
        assert got[:, 1].tolist() == [longest_match_phrases("".join(map(chr, t)), joined[:50]) for t in texts]


def test_language_predictions_against_phrases(spark):
    """Predictions and scores from the learned letters by plain string search; a text of over a million characters, other scripts."""
    rng = random.Random(7)
    letters = {"el": "αβγδεζηθ", "ru": "абвгдежз", "zh": "".join(chr(0x4E00 + i) for i in range(0, 3000, 7)), "en": "abcdefgh"}
    # two languages of one script, and many letters in all
    say = lambda lang, n: " ".join("".join(rng.choice(letters[lang]) for _ in range(rng.randrange(1, 6))) for _ in range(n))
    rows = [(i, say(lang := rng.choice(list(letters)), rng.randrange(3, 60)), lang, None, None) for i in range(120)]
    rows += [(500, say("ru", 200_000), None, None, None), (501, "жж 12 αα!", None, None, None)]
    df = table(spark, rows)
    got = {r.doc_id: r for r in L.language_predictions(df).collect()}
    model = L.fit(df.filter("crc32(cast(doc_id as string)) % 4 <> 2").selectExpr("text", "lang", "doc_id as key"))
    assert model.languages == sorted(letters) and len(model.chars) > 400
    learned = {}
    for i, text, lang, *_ in rows:
        if lang and rest(i, 4) != 2:
            learned.setdefault(lang, []).append(text)
    folded = {i: " " + " ".join("".join(c if c.isalpha() else " " for c in t).split()) for i, t, *_ in rows}
    for i, text, lang, *_ in rows[:30] + rows[-1:]:
        raw = text.encode()
        chars, spaces = L.letters_only(*T.folded_chars(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])))
        chars = chars[: spaces[1]]
        assert "".join(map(chr, chars)).strip() == folded[i].strip().lower()
        counts = L.phrase_counts(model.symbols(chars), np.array([0, len(chars)]), model.automata)[0]
        best = int(np.argmin(counts))
        assert got[i].lang_pred == model.languages[best]
        assert math.isclose(got[i].score, 1 - counts[best] / np.delete(counts, best).min(), abs_tol=1e-9)
    assert all(got[i].lang_pred == lang for i, _, lang, *_ in rows[:120]) and got[500].lang_pred == "ru"


def test_language_samples_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(L, "SAMPLE_ROWS", 10)
    monkeypatch.setattr(L, "SAMPLE_SYMBOLS", 1000)
    rng = random.Random(8)
    rows = [(i, speech(rng, "xx" if i % 3 else "yy", 100), "xx" if i % 3 else "yy", None, None) for i in range(300)] + [(1, "extra", "xx", None, None)]
    model = L.fit(table(spark, rows).selectExpr("text", "lang", "doc_id as key"))
    states = [len(a.flat) // a.width for a in model.automata]
    assert model.languages == ["xx", "yy"] and all(500 < s < 3000 for s in states)


def test_toxicity(spark):
    rng = random.Random(1)
    bad = ["zorgfuk", "blatwim"]
    rows, labels = [], []
    for i in range(400):
        w = speech(rng, rng.choice(list(SYLLABLES)), rng.randrange(10, 150)).split()
        toxic = int(i % 4 == 0)
        if toxic:
            w[rng.randrange(len(w))] = rng.choice(bad) + rng.choice(["", "s", "er"])
        rows.append((i, " ".join(w), None, None, None))
        labels.append((i, toxic if i % 2 == 0 or toxic else None))
    rows += [(900, None, None, None, None), (901, "", None, None, None), (902, "ZorgFuk", None, None, None)]
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in T.toxicity_scores(clashing(table(spark, rows)), lab).collect()}
    assert all(got[i].held_out == (rest(i, 3) == 1) for i in got) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    wrong = sum(got[i].predicted != (i % 4 == 0) for i in range(400))
    assert wrong <= 4 and got[900].predicted == got[901].predicted == 0 and got[900].score == got[901].score and got[902].predicted == 1
    assert T.toxicity_scores(empty(spark), lab).count() == 0
    assert T.toxicity_scores(table(spark, rows), lab.limit(0)).filter("predicted = 1").count() == 0


def test_toxicity_against_the_definition(spark):
    """Ratios, coefficients and scores by plain sets of n-grams and plain gradient descent; long, repeated and null rows."""
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(160):
        w = [rng.choice(["karo", "tomi", "mika", "sela"]) for _ in range(rng.randrange(5, 30))]
        if i % 3 == 0:
            w.insert(rng.randrange(len(w)), "grumpf")
        rows.append((i, " ".join(w), None, None, None))
        labels.append((i, int(i % 3 == 0)))
    rows += [rows[0], (500, "grumpf " + "karo tomi " * 60_000, None, None, None), (501, None, None, None, None)]
    df = table(spark, rows)
    lab = spark.createDataFrame([*labels, (None, 1), (3, None)], "id long, toxic int")
    model = T.fit(df.selectExpr("doc_id as id", "text"), lab)
    got = {r.doc_id: r.score for r in T.score(df, model, ["doc_id"]).collect()}

    def grams(t):
        t = " " + (t or "").lower() + " "
        return {t[a : a + n] for n in T.SIZES for a in range(len(t) - n + 1)} if len(t) > 2 else set()

    train = [(grams(t), y) for (i, t, *_), (_, y) in zip(rows, labels)] + [(grams(rows[0][1]), 1)]
    pos, neg = sum(y for _, y in train), sum(1 - y for _, y in train)
    ratio = {}
    for g in set().union(*(s for s, _ in train)):
        a, b = sum(g in s for s, y in train if y), sum(g in s for s, y in train if not y)
        pooled = (a + b) / len(train)
        if a + b >= T.MIN_DOCS and a + b < len(train) and abs(a / pos - b / neg) >= T.MIN_Z * math.sqrt(pooled * (1 - pooled) * (1 / pos + 1 / neg)):
            ratio[g] = math.log((a + 1) / (pos + 2)) - math.log((b + 1) / (neg + 2))
    assert len(model.grams) == len(ratio) and np.allclose(np.sort(model.ratio), sorted(ratio.values()))
    names = sorted(ratio)

    def vector(s):
        x = np.array([ratio[g] if g in s else 0.0 for g in names])
        return T.LENGTH * x / np.linalg.norm(x) if x.any() else x

    x, y = np.array([vector(s) for s, _ in train]), np.array([y for _, y in train], dtype=float)
    w, b = np.zeros(len(names)), 0.0
    for _ in range(6000):
        err = 1 / (1 + np.exp(-(x @ w + b))) - y
        w, b = w - 0.02 * (x.T @ err / len(y) + T.L2 * w), b - 0.02 * err.mean()
    for i, text, *_ in rows:
        s = vector(grams(text)) @ w + b
        assert math.isclose(got[i], 1 / (1 + math.exp(-(model.slope * s + model.shift))), abs_tol=0.02), i
    assert got[500] > 0.7 > got[501]


def test_folded_characters():
    data = "ÀB\tc d".encode()
    chars, spaces = T.folded_chars(np.frombuffer(data + b"x", dtype=np.uint8), np.array([0, len(data), len(data) + 1]))
    assert "".join(map(chr, chars)) == " àb c d x " and spaces.tolist() == [0, 7, 9]


def test_hidden_markov_scores(spark, monkeypatch):
    monkeypatch.setattr(H, "BUCKET_WORDS", 40)  # several counting buckets
    monkeypatch.setattr(H, "SYMBOLS", 30)
    rows = [r for r in corpus(3) if r[1] is None or len(r[1]) < 100_000]
    count = Counter(w for i, t, *_ in rows if rest(i, 5) != 1 for w in [*words(t, fold=True), None])
    n, v = sum(count.values()), len(count)
    got = {r.doc_id: r for r in H.language_model_scores(clashing(table(spark, rows))).collect()}
    sums = defaultdict(float)
    for i, t, *_ in rows:
        w, r = [*words(t, fold=True), None], got[i]
        base = sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (rest(i, 5) == 1, len(w), sum(count[x] > 0 for x in w), n) and math.isclose(r.base_score, base)
        sums["base"] += base
        sums["model"] += r.score
    assert sums["model"] > sums["base"]
    assert H.language_model_scores(empty(spark)).count() == 0


def all_paths(model, text):
    """(likelihood, expected starts, moves, emissions) of one text, path by path."""
    k = len(model.start)
    total, starts, moves, emissions = 0.0, np.zeros(k), np.zeros((k, k)), np.zeros(model.emit.shape)
    for path in itertools.product(range(k), repeat=len(text)):
        p = model.start[path[0]] if len(text) else 1.0
        for i, (z, x) in enumerate(zip(path, text)):
            p *= model.emit[z, x] * (model.move[path[i - 1], z] if i else 1.0)
        total += p
        if len(text):
            starts[path[0]] += p
        for i, (z, x) in enumerate(zip(path, text)):
            emissions[z, x] += p
            if i:
                moves[path[i - 1], z] += p
    return total, starts / total, moves / total, emissions / total


def small_model(states=3, symbols=4, seed=0):
    rng = np.random.default_rng(seed)
    share = lambda *shape: (lambda x: x / x.sum(axis=-1, keepdims=True))(rng.random(shape) + 0.05)
    return H.Hmm(share(states), share(states, states), share(states, symbols))


def test_forward_and_expected_counts_against_all_paths(monkeypatch):
    rng = np.random.default_rng(0)
    for segment in (512, 1, 2, 3):
        monkeypatch.setattr(H, "SEGMENT", segment)
        model = small_model(seed=segment)
        sizes = np.array([3, 0, 7, 1, 6])
        sym = rng.integers(0, 4, sizes.sum())
        texts = np.split(sym, np.cumsum(sizes)[:-1])
        want = [all_paths(model, t) for t in texts]
        got = H.log10_likelihood(model, sym, sizes)
        assert np.allclose(got, [math.log10(w[0]) for w in want], atol=1e-9)
        starts, moves, emissions, total = H.expected_counts(model, sym, sizes)
        assert np.allclose(starts, sum(w[1] for w in want), atol=1e-5) and np.allclose(moves, sum(w[2] for w in want), atol=1e-4)
        assert np.allclose(emissions, sum(w[3] for w in want), atol=1e-4) and math.isclose(total, got.sum(), rel_tol=1e-5)


def test_segments_change_no_expected_counts(monkeypatch):
    rng = np.random.default_rng(4)
    model = small_model(8, 50)
    sizes = np.array([5, 1300, 1, 64, 20_000, 65])
    sym = rng.integers(0, 50, sizes.sum())
    whole = None
    for segment in (30_000, 512, 64):
        monkeypatch.setattr(H, "SEGMENT", segment)
        found = H.expected_counts(model, sym, sizes)
        assert math.isclose(found[2].sum(), len(sym), rel_tol=1e-4) and math.isclose(found[1].sum(), len(sym) - len(sizes), rel_tol=1e-4)
        whole = whole or found
        assert all(np.allclose(a, b, rtol=1e-3) for a, b in zip(whole, found))


def test_scores_of_a_very_long_text_and_bounded_blocks(spark, monkeypatch):
    monkeypatch.setattr(H, "BLOCK_BYTES", 1000)
    rows = corpus(5)
    got = {r.doc_id: r for r in H.language_model_scores(table(spark, rows)).collect()}
    assert len(got) == len({r[0] for r in rows}) and all(r.score < 0 and r.n_tokens == len(words(t, fold=True)) + 1 for i, t, *_ in rows for r in [got[i]])
    assert max(r.n_tokens for r in got.values()) > 60_000


def test_baum_welch_raises_likelihood():
    rng = np.random.default_rng(1)
    sizes = np.array([120, 90, 100, 60])
    sym = np.concatenate([rng.choice(4, n, p=p) for n, p in zip(sizes, ([0.7, 0.3, 0, 0], [0, 0, 0.5, 0.5], [0.6, 0.4, 0, 0], [0, 0, 0.4, 0.6]))])
    model, last = H.first_model(np.full(4, 0.25)), -1e9
    for _ in range(6):
        now = H.log10_likelihood(model, sym, sizes).sum()
        assert now > last - 1e-3
        last = now
        s, m, e, total = H.expected_counts(model, sym, sizes)
        assert math.isclose(e.sum(), len(sym), rel_tol=1e-4) and math.isclose(m.sum(), len(sym) - len(sizes), rel_tol=1e-4) and math.isclose(total, now, rel_tol=1e-4)
        model = H.Hmm((s + 1e-9) / (s + 1e-9).sum(), (m + 1e-9) / (m + 1e-9).sum(axis=1, keepdims=True), (e + 1e-9) / (e + 1e-9).sum(axis=1, keepdims=True))
