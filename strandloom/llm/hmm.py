"""Hidden Markov language model.

Texts are encoded once as blocks of word numbers.  Word counts are aggregated over all blocks
by hash buckets.  The model's symbols are the most frequent training words, one each, and for
all other words a class by word ending; within a class a word keeps its share of the class's
unigram probability, so every word counts and the model's tables have a fixed size.
Baum-Welch: each task sums expected counts over its blocks' whole texts, the sums are aggregated
across tasks, and the driver normalises tables of STATES x symbols.  Scores come from the scaled
forward recursion over whole texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spark import bound_batches, cut, hold
from .textops import U, Words, buffers, chunks, scalar_mix
from .toxicity import held_out

STATES, SYMBOLS, ENDINGS = 8, 4096, 256
#: Baum-Welch ends where a round gains less than GAIN (log10 a token), or after so many rounds.
ROUNDS, GAIN = 8, 1e-3
#: Tokens of a text that are stepped through together; a longer text's segments are joined by their transfer matrices.
SEGMENT = 1024
#: Text bytes of one encoded block (a longer text is a block of its own).
BLOCK_BYTES = 4 << 20
#: Prior weight of the unigram shares in a state's emissions.
PRIOR = 20.0
#: Distinct (block, word) entries that one counting bucket takes on average.
BUCKET_WORDS = 1_000_000
END = U(scalar_mix(0xE0F))


def _pack(x: np.ndarray) -> bytes:
    return bytes(pa.compress(x.tobytes(), codec="zstd", asbytes=True)) if len(x) else b""


def _unpack(x: bytes, n: int, kind) -> np.ndarray:
    return np.frombuffer(pa.decompress(x, n * np.dtype(kind).itemsize, codec="zstd", asbytes=True), dtype=kind) if n else np.zeros(0, kind)


def _encode(batches):
    """Blocks of texts: word numbers within the block, the block's words, their endings and training counts."""
    part, count = TaskContext.get().partitionId() if TaskContext.get() else 0, 0
    for batch in batches:
        held = np.array(batch.column(2).to_pylist(), dtype=bool)
        for first_row, last_row in _runs(batch.column(1)):
            flags = held[first_row:last_row]
            hashes, endings, sizes = [], [], []
            for _, _, data, offs in chunks(batch.column(1).slice(first_row, last_row - first_row)):
                w = Words(data, offs, lower=True)
                h = w.hashes()
                last = w.data[w.end - 1].astype(np.int64)
                before = np.where(w.end - w.start > 1, w.data[np.maximum(w.end - 2, 0)], 0).astype(np.int64)
                e = ((last * 31 + before * 7) % ENDINGS).astype(np.uint8)
                # an end token after each text
                at = w.doc[1:]
                hashes.append(np.insert(h, at, END))
                endings.append(np.insert(e, at, 0))
                sizes.append(np.diff(w.doc) + 1)
            h, e, n = np.concatenate(hashes), np.concatenate(endings), np.concatenate(sizes).astype(np.int32)
            words, first, number = np.unique(h, return_index=True, return_inverse=True)
            seen = np.bincount(number[np.repeat(~flags, n)], minlength=len(words)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([(part << 32) + count]), pa.array([batch.column(0)[first_row:last_row].to_pylist()], type=pa.list_(pa.int64())), pa.array([n.tobytes()]), pa.array([flags.astype(np.uint8).tobytes()]),
                    pa.array([_pack(number.astype(np.int32))]), pa.array([words.tobytes()]), pa.array([e[first].tobytes()]), pa.array([seen.tobytes()]),
                ],
                names=["block", "ids", "sizes", "held", "tokens", "words", "endings", "seen"],
            )
            count += 1


def _runs(texts: pa.Array):
    """(first, last + 1) of runs of rows within BLOCK_BYTES (one row at least)."""
    size = buffers(texts)[1]
    lo, n = 0, len(size) - 1
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(size, size[lo] + BLOCK_BYTES, side="right")) - 1))
        yield lo, hi
        lo = hi


def _to_buckets(buckets: int):
    def kernel(batches):
        for batch in batches:
            for block, words, endings, seen in zip(*(c.to_pylist() for c in batch.columns)):
                words, endings, seen = np.frombuffer(words, U), np.frombuffer(endings, np.uint8), np.frombuffer(seen, np.int64)
                # words are sorted, so a bucket is a range of the hash space
                edges = np.searchsorted(words, (np.arange(1, buckets, dtype=object) * (1 << 64) // buckets).astype(U)) if buckets > 1 else []
                spans = [(int(a), int(b)) for a, b in zip([0, *edges], [*edges, len(words)])]
                full = [(i, a, b) for i, (a, b) in enumerate(spans) if a < b]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i for i, _, _ in full], type=pa.int32()), pa.array([block] * len(full), type=pa.int64()), *(pa.array([x[a:b].tobytes() for _, a, b in full], type=pa.binary()) for x in (words, endings, seen.astype(np.int64)))],
                    names=["bucket", "block", "words", "endings", "seen"],
                )

    return kernel


def _count_bucket(table: pa.Table) -> pa.Table:
    """One bucket's total of each word, given back to every block; with the first row, its share of the corpus statistics."""
    parts = [np.frombuffer(x, U) for x in table.column("words").to_pylist()]
    words, first, number = np.unique(np.concatenate(parts), return_index=True, return_inverse=True)
    total = np.bincount(number, weights=np.concatenate([np.frombuffer(x, np.int64) for x in table.column("seen").to_pylist()]), minlength=len(words)).astype(np.int64)
    endings = np.concatenate([np.frombuffer(x, np.uint8) for x in table.column("endings").to_pylist()])[first]
    known = total > 0
    top = np.lexsort((words, -total))[:SYMBOLS]
    top = top[total[top] > 0]
    at = np.cumsum([0, *map(len, parts)])
    n = table.num_rows
    kinds = np.bincount(endings[known], minlength=ENDINGS).astype(np.int64)
    tokens = np.bincount(endings, weights=total, minlength=ENDINGS).astype(np.int64)

    def once(x, kind):
        return pa.array([x] + [None] * (n - 1), type=kind)

    return pa.table({
        "bucket": table.column("bucket"), "block": table.column("block"),
        "totals": pa.array([total[number[a:b]].tobytes() for a, b in zip(at[:-1], at[1:])], type=pa.binary()),
        "kinds": once(kinds.tolist(), pa.list_(pa.int64())), "ntokens": once(tokens.tolist(), pa.list_(pa.int64())),
        "top": once([{"w": int(w), "c": int(c), "e": int(e)} for w, c, e in zip(words[top].view(np.int64), total[top], endings[top])], pa.list_(pa.struct([("w", pa.int64()), ("c", pa.int64()), ("e", pa.int32())]))),
    })


@dataclass
class Corpus:
    blocks: DataFrame
    counted: DataFrame
    tokens: int  # N, in training texts
    distinct: int  # V
    top: np.ndarray  # sorted hashes of the words that are symbols
    share: np.ndarray  # unigram probability of each symbol: words of top, then endings

    def symbol(self, words: np.ndarray, endings: np.ndarray) -> np.ndarray:
        if not len(self.top):
            return endings.astype(np.int32)
        at = np.minimum(np.searchsorted(self.top, words), len(self.top) - 1)
        return np.where(self.top[at] == words, at, len(self.top) + endings.astype(np.int64)).astype(np.int32)


def encode(docs: DataFrame) -> Corpus:
    """Encode (id, text, held_out) and count the words of all texts that are not held out."""
    blocks = hold(docs.select("id", "text", "held_out").mapInArrow(_encode, "block long, ids array<long>, sizes binary, held binary, tokens binary, words binary, endings binary, seen binary"))
    entries = blocks.agg(F.sum(F.length("endings"))).first()[0] or 0
    buckets = max(1, -(-entries // BUCKET_WORDS))
    spread = blocks.select("block", "words", "endings", "seen").mapInArrow(_to_buckets(buckets), "bucket int, block long, words binary, endings binary, seen binary")
    counted = cut(spread.groupBy("bucket").applyInArrow(_count_bucket, "bucket int, block long, totals binary, kinds array<long>, ntokens array<long>, top array<struct<w:long,c:long,e:int>>"))
    kinds, tokens = np.zeros(ENDINGS), np.zeros(ENDINGS)
    for r in counted.select(F.posexplode(F.arrays_zip("kinds", "ntokens")).alias("ending", "x")).groupBy("ending").agg(F.sum("x.kinds"), F.sum("x.ntokens")).collect():
        kinds[r[0]], tokens[r[0]] = r[1], r[2]
    top = counted.select(F.explode("top").alias("t")).select("t.*").orderBy(F.desc("c"), "w").limit(SYMBOLS).collect()
    n, v = int(tokens.sum()), int(kinds.sum())
    for r in top:
        kinds[r["e"]] -= 1
        tokens[r["e"]] -= r["c"]
    words = np.array([r["w"] for r in top], dtype=np.int64).view(U)
    order = np.argsort(words)
    c = np.array([r["c"] for r in top], dtype=float)[order]
    # the pseudo-word for all unseen words is spread evenly over the endings
    mass = np.concatenate([c + 0.5, tokens + 0.5 * kinds + 0.5 / ENDINGS]) / (n + 0.5 * (v + 1))
    return Corpus(blocks, counted, n, v, words[order], mass)


@dataclass
class Hmm:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # states x symbols


def first_model(share: np.ndarray, seed: int = 7) -> Hmm:
    rng = np.random.default_rng(seed)
    emit = share * rng.gamma(1.0, size=(STATES, len(share)))
    emit /= emit.sum(axis=1, keepdims=True)
    move = np.full((STATES, STATES), 0.05 / (STATES - 1))
    np.fill_diagonal(move, 0.95)
    flat = np.full(STATES, 1 / STATES)
    return Hmm(flat, move, emit)


def expected_counts(model: Hmm, sym: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(starts, moves, emissions as states x symbols, log10 likelihood) expected over whole texts.

    All segments of all texts step together.  The product of a segment's steps (a matrix of states x
    states) carries the forward state to the next segment and the backward state to the one
    before, so the counts are those of texts that were never cut.
    """
    k, s = model.emit.shape
    sizes = sizes[sizes > 0]
    per = -(-sizes // SEGMENT)
    owner = np.repeat(np.arange(len(sizes)), per)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
    begin = (np.cumsum(sizes) - sizes)[owner] + nth * SEGMENT
    size = np.minimum(SEGMENT, sizes[owner] - nth * SEGMENT)
    emit = np.ascontiguousarray(model.emit.T).astype(np.float32)
    move = model.move.astype(np.float32)
    # before its first token each segment is in state `enter`, of a text's first one the token's own state; after its last, `leave`
    enter, leave = np.tile(model.start, (len(owner), 1)), np.ones((len(owner), k))
    if (per > 1).any():
        _join_segments(model, sym, per, nth, begin, size, enter, leave)
    by = np.argsort(-size, kind="stable")
    begin, size, nth = begin[by], size[by], nth[by]
    enter, leave = enter[by].astype(np.float32), leave[by].astype(np.float32)
    steps = int(size[0]) if len(size) else 0
    live = np.searchsorted(-size, -np.arange(steps), side="left")
    head = (nth == 0)[:, None]
    alpha, seen, total = [], [], 0.0
    state = enter
    for t in range(steps):
        n = live[t]
        x = sym[begin[:n] + t]
        state = (np.where(head, state, state @ move) if t == 0 else state[:n] @ move) * emit[x]
        c = state.sum(axis=1, keepdims=True)
        state = state / c
        total += float(np.log10(c).sum())
        alpha.append(state)
        seen.append(x)
    moves = np.zeros((k, k))
    weights = [None] * steps
    beta = np.zeros((0, k), dtype=np.float32)

    def step_back(before, x, after):
        """Adds the expected moves into the tokens x; the backward states before them."""
        nonlocal moves
        onward = emit[x] * after
        onward = onward / ((before @ move) * onward).sum(axis=1, keepdims=True)
        moves += before.T.astype(np.float64) @ onward
        return onward @ move.T

    for t in range(steps - 1, -1, -1):
        n, m = live[t], len(beta)
        back = leave[:n].copy()
        if m:
            back[:m] = step_back(alpha[t][:m], seen[t + 1][:m], beta)
        beta = back
        w = alpha[t] * beta
        weights[t] = w / w.sum(axis=1, keepdims=True)
    if steps:
        inner = np.flatnonzero(nth > 0)
        step_back(enter[inner], seen[0][inner], beta[inner])
    moves *= model.move
    gamma, at = (np.concatenate(weights), np.concatenate(seen)) if steps else (np.zeros((0, k)), np.zeros(0, np.int64))
    cells = (at.astype(np.int64)[:, None] * k + np.arange(k)).ravel()
    emissions = np.bincount(cells, weights=gamma.ravel(), minlength=s * k).reshape(s, k).T
    starts = weights[0][nth == 0].sum(axis=0).astype(float) if steps else np.zeros(k)
    return starts, moves, emissions, total


def _join_segments(model: Hmm, sym, per, nth, begin, size, enter, leave) -> None:
    """Forward states before, and backward states after, the segments of texts of several ones, in place."""
    k = len(model.move)
    # products count up to a factor, so each token's largest emission is 1 and a few steps go without scaling
    emit, move = model.emit.T / model.emit.max(axis=0)[:, None], model.move.astype(np.float32)
    emit = emit.astype(np.float32)
    first = np.cumsum(per) - per
    several = np.flatnonzero(np.repeat(per > 1, per))
    order = several[np.argsort(-size[several], kind="stable")]
    product = np.tile(np.eye(k, dtype=np.float32), (len(order), 1, 1))
    head = (nth[order] == 0)[:, None, None]
    live = np.searchsorted(-size[order], -np.arange(int(size[order[0]])), side="left")
    at = begin[order]
    for t, n in enumerate(live.tolist()):
        now = (product[:n].reshape(-1, k) @ move).reshape(n, k, k)
        if t == 0:  # the first token of a text moves from nowhere: it starts in the state itself
            now = np.where(head, product, now)
        now *= emit[sym[at[:n] + t]][:, None, :]
        if t % 4 == 3:
            now /= now.max(axis=(1, 2), keepdims=True)
        product[:n] = now
    product = product.astype(np.float64)
    place = np.zeros(len(nth), dtype=np.int64)
    place[order] = np.arange(len(order))
    for j in range(1, int(per.max())):
        at = (first + j)[per > j]
        x = np.einsum("ni,nij->nj", enter[at - 1], product[place[at - 1]])
        enter[at] = x / x.sum(axis=1, keepdims=True)
        at = (first + per - 1 - j)[per > j]
        x = np.einsum("nij,nj->ni", product[place[at + 1]], leave[at + 1])
        leave[at] = x / x.max(axis=1, keepdims=True)


def _expect(corpus_symbol, model: Hmm):
    s = model.emit.shape[1]

    def kernel(batches):
        starts, moves, emissions, total = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((STATES, s)), 0.0
        for batch in batches:
            for sizes, held, tokens, words, endings in zip(*(c.to_pylist() for c in batch.columns)):
                sizes, held = np.frombuffer(sizes, np.int32).astype(np.int64), np.frombuffer(held, np.uint8).astype(bool)
                number = _unpack(tokens, int(sizes.sum()), np.int32)
                sym = corpus_symbol(np.frombuffer(words, U), np.frombuffer(endings, np.uint8))[number[np.repeat(~held, sizes)]]
                if len(sym):
                    a, b, c, d = expected_counts(model, sym, sizes[~held])
                    total += d
                    starts += a
                    moves += b
                    emissions += c
        both = np.concatenate([starts[:, None], moves, emissions], axis=1)
        i, j = np.nonzero(both)
        # the log10 likelihood is a cell of its own
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(i, 0).astype(np.int32)), pa.array(np.append(j, both.shape[1]).astype(np.int32)), pa.array(np.append(both[i, j], total))], names=["state", "cell", "n"]
        )

    return kernel


def baum_welch(corpus: Corpus, rounds: int = ROUNDS) -> Hmm:
    model = first_model(corpus.share)
    if corpus.tokens == 0:
        return model
    data = corpus.blocks.select("sizes", "held", "tokens", "words", "endings")
    symbol = Corpus(None, None, 0, 0, corpus.top, None).symbol
    last = -np.inf
    for _ in range(rounds):
        # STATES x (1 + STATES + SYMBOLS + ENDINGS) cells at most come to the driver
        sums = data.mapInArrow(_expect(symbol, model), "state int, cell int, n double").groupBy("state", "cell").agg(F.sum("n").alias("n")).toPandas()
        both = np.zeros((STATES, 2 + STATES + len(corpus.share)))
        both[sums["state"], sums["cell"]] = sums["n"]
        starts, moves, emit, likelihood = both[:, 0], both[:, 1 : 1 + STATES], both[:, 1 + STATES : -1], both[0, -1] / corpus.tokens
        emit = emit + PRIOR * corpus.share / corpus.share.sum()
        model = Hmm(
            (starts + 0.1) / (starts + 0.1).sum(), (moves + 0.1) / (moves + 0.1).sum(axis=1, keepdims=True),
            emit / emit.sum(axis=1, keepdims=True),
        )
        if likelihood < last + GAIN:
            break
        last = likelihood
    return model


def log10_likelihood(model: Hmm, sym: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """log10 probability of each text's symbols by the scaled forward recursion; longer texts first."""
    out = np.zeros(len(sizes))
    by = np.argsort(-sizes, kind="stable")
    begin, size = (np.cumsum(sizes) - sizes)[by], sizes[by]
    live = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), side="left")
    emit = np.ascontiguousarray(model.emit.T)
    total = np.zeros(len(sizes))
    state = np.tile(model.start, (len(sizes), 1))
    for t, n in enumerate(live.tolist()):
        state = (state[:n] if t == 0 else state[:n] @ model.move) * emit[sym[begin[:n] + t]]
        c = state.sum(axis=1)
        state /= c[:, None]
        total[:n] += np.log10(c)
    out[by] = total
    return out


def score(corpus: Corpus, model: Hmm, id_col: str) -> DataFrame:
    n, v, top, share = corpus.tokens, corpus.distinct, corpus.top, corpus.share
    symbol = Corpus(None, None, 0, 0, top, None).symbol

    def kernel(batches):
        for batch in batches:
            for ids, sizes, held, tokens, words, endings, totals in zip(*(c.to_pylist() for c in batch.columns)):
                sizes, held = np.frombuffer(sizes, np.int32).astype(np.int64), np.frombuffer(held, np.uint8).astype(bool)
                number = _unpack(tokens, int(sizes.sum()), np.int32)
                words = np.frombuffer(words, U)
                count = np.concatenate([np.frombuffer(t["totals"], np.int64) for t in sorted(totals, key=lambda t: t["bucket"])])
                base = np.log10((count + 0.5) / (n + 0.5 * (v + 1)))
                sym = symbol(words, np.frombuffer(endings, np.uint8))
                # a word's share of its class; words that are symbols have all of theirs
                within = np.where(sym >= len(top), base - np.log10(share[sym]), 0.0)
                first = np.cumsum(sizes) - sizes
                scores = log10_likelihood(model, sym[number], sizes) + np.add.reduceat(within[number], first)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, type=pa.int64()), pa.array(held), pa.array(sizes), pa.array(np.add.reduceat((count > 0).astype(np.int64)[number], first)),
                        pa.array(np.full(len(sizes), n, dtype=np.int64)), pa.array(np.add.reduceat(base[number], first)), pa.array(scores),
                    ],
                    names=[id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    own = corpus.counted.groupBy("block").agg(F.collect_list(F.struct("bucket", "totals")).alias("totals"))
    joined = corpus.blocks.select("block", "ids", "sizes", "held", "tokens", "words", "endings").join(own, "block").drop("block")
    return joined.mapInArrow(kernel, f"`{id_col}` long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def language_model_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (id, held_out, n_tokens, n_known, train_tokens, base_score, score).

    Learns from all texts whose crc32(id as text) mod 5 is not 1.  Tokens are words with A-Z folded and
    one end; a null or empty text is the end alone; null ids are learned from; repeated rows
    count each time; without training texts all words are unseen.  Other columns are ignored.
    """
    docs = bound_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn("held_out", held_out("id", 5, 1))
    corpus = encode(docs)
    return score(corpus, baum_welch(corpus), id_col)
