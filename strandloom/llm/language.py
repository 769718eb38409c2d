"""Language identification by cross-parsing entropy with suffix automata.

For each language a suffix automaton of bounded labelled text is built.  A text is parsed into
phrases, each the longest match that occurs in the language's text; a language's score is its
number of phrases over the number of symbols, and the language that needs fewest wins.
Symbols are letters, with one space for every run of other characters.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from .spark import bound_batches
from .textops import CHUNK_BYTES, U, chunks
from .toxicity import folded_chars, held_out

#: Bounds of the fit: symbols of labelled text per language, rows that give them in equal shares, and
#: symbols of one piece (a row's pieces are spread over its whole text).
SAMPLE_SYMBOLS, SAMPLE_ROWS, PIECE = 60_000, 400, 75
#: Symbols of all languages' samples together: about 250 MB in every Python worker.
MODEL_SYMBOLS = 16 * SAMPLE_SYMBOLS
#: Languages that one model may hold; more are an error.
MAX_LANGUAGES = 256
#: Symbols whose transitions are a dense table.
WIDTH = 48
#: A long text is parsed in blocks of so many symbols at once; what a block begins with is settled afterwards.
BLOCK = 512
UNDETERMINED = "und"

_letter = np.array([chr(c).isalpha() for c in range(0x10000)])


def is_letter(chars: np.ndarray) -> np.ndarray:
    small = chars < len(_letter)
    out = np.zeros(len(chars), dtype=bool)
    out[small] = _letter[chars[small]]
    for at in np.flatnonzero(~small):
        out[at] = chr(int(chars[at])).isalpha() if chars[at] < 0x110000 else False
    return out


def letters_only(chars: np.ndarray, spaces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters with one space for every run of other characters; where the texts' first spaces are then."""
    letter = is_letter(chars)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[spaces] = True  # a text begins with its own space
    keep[:-1] &= letter[:-1] | ~np.isin(np.arange(1, len(chars)), spaces) | np.isin(np.arange(len(chars) - 1), spaces)
    at = np.concatenate([[0], np.cumsum(keep)])
    return np.where(letter, chars, np.uint32(0x20))[keep], at[spaces]


class Automaton:
    """All substrings of a sequence of symbols (from 1 up to `symbols`); state 1 is the root, 0 none.

    Transitions by the sequence's WIDTH - 1 most frequent symbols are a dense table, all others a hash table with
    linear probing, so every symbol counts and memory follows the sequence and not the alphabet.
    """

    def __init__(self, sequence: np.ndarray, symbols: int):
        counts = np.bincount(sequence, minlength=symbols + 1)
        order = np.argsort(-counts, kind="stable")
        order = order[counts[order] > 0]
        self.own = np.zeros(symbols + 1, dtype=np.int64)  # this automaton's numbers of the symbols, 0: it has none
        self.own[order] = np.arange(1, len(order) + 1)
        self.width = min(WIDTH, len(order) + 1)
        link, length, nxt = [0, 0], [0, 0], [{}, {}]
        last = 1
        for s in self.own[sequence].tolist():
            cur = len(nxt)
            length.append(length[last] + 1)
            link.append(1)
            nxt.append({})
            p = last
            while p and s not in nxt[p]:
                nxt[p][s] = cur
                p = link[p]
            if p:
                q = nxt[p][s]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(nxt)
                    length.append(length[p] + 1)
                    link.append(link[q])
                    nxt.append(dict(nxt[q]))
                    while p and nxt[p].get(s) == q:
                        nxt[p][s] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur
        self.flat = np.zeros(len(nxt) * self.width, dtype=np.int32)
        rare = []
        for state, edges in enumerate(nxt):
            for s, t in edges.items():
                if s < self.width:
                    self.flat[state * self.width + s] = t
                else:
                    rare.append(((state << 32) | s, t))
        keys, to = np.array([k for k, _ in rare], dtype=np.int64), np.array([t for _, t in rare], dtype=np.int32)
        self.bits = max(1, int(3 * len(keys)).bit_length())
        self.rare_keys, self.to = np.zeros(1 << self.bits, dtype=np.int64), np.zeros(1 << self.bits, dtype=np.int32)
        if not len(keys):
            self.rare_keys = keys
        at, wait = self._slot(keys), np.arange(len(keys))
        while len(wait):  # the first of each free slot's keys takes it, the others go on to the next slot
            free = self.rare_keys[at[wait]] == 0
            _, first = np.unique(at[wait][free], return_index=True)
            got = wait[free][first]
            self.rare_keys[at[got]], self.to[at[got]] = keys[got], to[got]
            wait = np.setdiff1d(wait, got, assume_unique=True)
            at[wait] = (at[wait] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(U) * U(0x9E3779B97F4A7C15)) >> U(64 - self.bits)).astype(np.int64)

    def step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        if not len(self.rare_keys):
            return self.flat[state * self.width + symbol]
        rare = np.flatnonzero(symbol >= self.width)
        out = self.flat[state * self.width + np.where(symbol < self.width, symbol, 0)]
        if len(rare):
            out[rare] = self._step_rare(state[rare], symbol[rare])
        return out

    def _step_rare(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        key = (state.astype(np.int64) << 32) | symbol
        at = self._slot(key)
        found = self.rare_keys[at]
        out = np.where(found == key, self.to[at], 0)
        wait = np.flatnonzero((found != key) & (found != 0))
        while len(wait):
            at[wait] = (at[wait] + 1) & ((1 << self.bits) - 1)
            found = self.rare_keys[at[wait]]
            hit = found == key[wait]
            out[wait[hit]] = self.to[at[wait[hit]]]
            wait = wait[~hit & (found != 0)]
        return out

    def advance(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(states after the symbols, phrases that ended by then)."""
        to = self.step(state, symbol)
        ended = np.zeros(len(state), dtype=np.int32)
        miss = np.flatnonzero(to == 0)
        if len(miss):
            # a phrase ends before this symbol, or is this symbol alone where the language never has it
            fresh = self.step(np.ones(len(miss), dtype=np.int32), symbol[miss])
            ended[miss] = (state[miss] != 1).astype(np.int32) + (fresh == 0)
            to[miss] = np.where(fresh == 0, 1, fresh)
        return to, ended


@dataclass
class Model:
    languages: list[str]
    chars: np.ndarray  # sorted code points of all samples; symbol 0 stands for all others
    automata: list[Automaton]

    def symbols(self, chars: np.ndarray) -> np.ndarray:
        if not len(self.chars):
            return np.zeros(len(chars), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.chars, chars), len(self.chars) - 1)
        return np.where(self.chars[at] == chars, at + 1, 0)


def _pieces(batches):
    """(lang, order, letters) of the drawn rows: whole where short, else pieces at equal distances, shifted by the row's hash."""
    for batch in batches:
        langs, orders, shares = (batch.column(i).to_pylist() for i in (1, 2, 3))
        for lo, hi, data, offs in chunks(batch.column(0)):
            chars, spaces = letters_only(*folded_chars(data, offs))
            out = []
            for i, (a, b) in enumerate(zip(spaces[:-1].tolist(), spaces[1:].tolist())):
                own, share = chars[a:b], shares[lo + i]
                if len(own) > share:
                    n = max(1, share // PIECE)
                    step, size = len(own) / n, share // n
                    shift = (orders[lo + i] % 1024) / 1024
                    own = np.concatenate([own[at : at + size] for at in (int(j * step + shift * (step - size)) for j in range(n))])
                out.append(own.astype("<u4").tobytes().decode("utf-32-le", "replace"))
            yield pa.RecordBatch.from_arrays([pa.array(langs[lo:hi]), pa.array(orders[lo:hi], type=pa.int64()), pa.array(out, type=pa.string())], names=["lang", "order", "letters"])


def fit(docs: DataFrame) -> Model:
    """Fit on (text, lang, key): per language SAMPLE_ROWS rows by a hash of the key, SAMPLE_SYMBOLS symbols in equal shares.

    Rows without text, language or key are left out.  Only the fit is bounded; parsing takes whole texts.
    """
    rows = docs.filter("text is not null and lang is not null and key is not null")
    keys = rows.select("lang", "key", F.xxhash64("key").alias("order"))
    n_rows = {r["lang"]: r["n"] for r in keys.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(n_rows) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    samples: dict[str, list] = {}
    if n_rows:
        # the lowest hashes of each language are below a bound, so that one scan finds a few times SAMPLE_ROWS candidates
        below = F.create_map(*(F.lit(x) for lang, n in sorted(n_rows.items()) for x in (lang, min(1.0, 4 * SAMPLE_ROWS / n))))
        low = keys.filter((F.col("order") / F.lit(2.0**64) + 0.5) <= below[F.col("lang")])
        nth = F.row_number().over(Window.partitionBy("lang").orderBy("order", "key"))
        chosen = low.distinct().withColumn("nth", nth).filter(F.col("nth") <= SAMPLE_ROWS)
        share = F.floor(F.lit(min(SAMPLE_SYMBOLS, MODEL_SYMBOLS // len(n_rows))) / F.count(F.lit(1)).over(Window.partitionBy("lang"))).cast("int")
        chosen = chosen.select("lang", "key", share.alias("share"))
        # SAMPLE_ROWS keys a language at most, hence the broadcast; texts are read for these rows alone
        drawn = rows.join(F.broadcast(chosen), ["lang", "key"]).select("text", "lang", F.xxhash64("key").alias("order"), "share").mapInArrow(_pieces, "lang string, order long, letters string")
        # a key that repeats gives its texts more than once; each language keeps its bound
        for r in sorted((r["lang"], r["order"], r["letters"]) for r in drawn.distinct().groupBy("lang", "order").agg(F.min("letters").alias("letters")).collect()):
            samples.setdefault(r[0], []).append(np.frombuffer(r[2].encode("utf-32-le"), dtype="<u4"))
    languages = sorted(samples)
    texts = [np.concatenate(samples[x]) for x in languages]
    model = Model(languages, np.unique(np.concatenate(texts)) if texts else np.zeros(0, "<u4"), [])
    for t in texts:
        model.automata.append(Automaton(model.symbols(t), len(model.chars)))
    return model


def phrase_counts(symbols: np.ndarray, spans: np.ndarray, automata: list[Automaton]) -> np.ndarray:
    """Phrases (texts x languages) of the texts symbols[spans[i]:spans[i+1]].

    All blocks of all texts step together, longest first, each as if a phrase began with it.  Then
    each block but a text's first is entered with the state in which the block before it ended, up to
    where the states agree, for from there on all is the same; where they never do, the next
    block is entered anew.  So counts are those of whole texts.
    """
    n = len(spans) - 1
    sizes = np.diff(spans)
    per = -(-sizes // BLOCK)
    owner = np.repeat(np.arange(n), per)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
    start = spans[owner] + nth * BLOCK
    size = np.minimum(BLOCK, spans[owner + 1] - start)
    by = np.argsort(-size, kind="stable")
    place = np.empty(len(by), dtype=np.int64)
    place[by] = np.arange(len(by))
    # of each block, where the text's block before and after it stand
    before = np.where(nth > 0, place[np.maximum(np.arange(len(by)) - 1, 0)], -1)[by] if len(by) else by
    follows = np.zeros(len(by), dtype=bool)
    follows[:-1] = nth[1:] > 0
    after = np.where(follows, place[np.minimum(np.arange(len(by)) + 1, len(by) - 1)], -1)[by] if len(by) else by
    owner, start, size = owner[by], start[by], size[by]
    steps = int(size[0]) if len(size) else 0
    alive = np.searchsorted(-size, -np.arange(steps), side="left")
    out = np.zeros((n, len(automata)), dtype=np.int64)
    multi = bool((per > 1).any())
    given = symbols
    for lang, automaton in enumerate(automata):
        symbols = automaton.own[given]
        state = np.ones(len(start), dtype=np.int32)
        phrases = np.zeros(len(start), dtype=np.int32)
        track, ends = (np.zeros((steps, len(start)), dtype=np.int32) for _ in range(2)) if multi else (None, None)
        for j, live in enumerate(alive.tolist()):
            state[:live], ended = automaton.advance(state[:live], symbols[start[:live] + j])
            phrases[:live] += ended
            if multi:
                track[j, :live], ends[j, :live] = state[:live], phrases[:live]
        if multi:
            alone, left = phrases.copy(), state.copy()  # of blocks entered anew
            enter = np.flatnonzero(before >= 0)
            while len(enter):
                now, had = state[before[enter]], np.zeros(len(enter), dtype=np.int32)
                total, last = alone[enter].copy(), left[enter].copy()
                going = np.flatnonzero(now != 1)
                for j in range(steps):
                    if not len(going):
                        break
                    b = enter[going]
                    now[going], ended = automaton.advance(now[going], symbols[start[b] + j])
                    had[going] += ended
                    same, done = now[going] == track[j, b], j + 1 == size[b]
                    at = going[same]
                    total[at] += had[at] - ends[j, enter[at]]
                    at = going[~same & done]
                    total[at], last[at] = had[at], now[at]
                    going = going[~same & ~done]
                changed = enter[last != state[enter]]
                phrases[enter], state[enter] = total, last
                enter = after[changed]
                enter = enter[enter >= 0]
        whole = phrases + ((state != 1) & (after < 0))
        np.add.at(out[:, lang], owner, whole)
    return out


def identify(docs: DataFrame, model: Model, id_col: str, extra: list[str]) -> DataFrame:
    """(id, extra..., lang_pred, score): score is 1 - fewest / second fewest normalised phrases, 1 for a lone language, 0 for und."""

    shared = docs.sparkSession.sparkContext.broadcast(model)

    def kernel(batches):
        model = shared.value
        for batch in batches:
            for lo, hi, data, offs in chunks(batch.column(0), 4 * CHUNK_BYTES):
                chars, spaces = letters_only(*folded_chars(data, offs))
                count = phrase_counts(model.symbols(chars), spaces, model.automata)
                letters = np.concatenate([[0], np.cumsum(is_letter(chars))])
                rate = count / np.maximum(np.diff(spaces), 1)[:, None]
                names, scores = [], []
                for i in range(hi - lo):
                    if not model.languages or letters[spaces[i + 1]] == letters[spaces[i]]:
                        names.append(UNDETERMINED)
                        scores.append(0.0)
                        continue
                    best = int(np.argmin(rate[i]))
                    rest = np.delete(rate[i], best)
                    names.append(model.languages[best])
                    scores.append(1.0 if not len(rest) else float(1 - rate[i, best] / max(rest.min(), 1e-12)))
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(names, type=pa.string()), pa.array(scores)], names=[id_col, *extra, "lang_pred", "score"])

    src = bound_batches(docs).select(F.col("text").alias("__text"), id_col, *extra)
    return src.mapInArrow(kernel, StructType(src.schema.fields[1:]).add("lang_pred", StringType()).add("score", DoubleType()))


def language_predictions(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per input row: (id, held_out, lang_pred, score).

    Learns from text and non-null lang of rows whose crc32(id as text) mod 4 is not 2; ids order
    the sample only.  A null text or one without letters is `und`, as is every text if nothing was
    learned; ties go to the language that sorts first; null ids are not held out; other columns are ignored.
    """
    docs = bound_batches(docs).select(F.col(id_col).alias(id_col), "text", "lang").withColumn("held_out", held_out(id_col, 4, 2))
    model = fit(docs.filter("not held_out").select("text", "lang", F.col(id_col).alias("key")))
    return identify(docs.select(id_col, "held_out", "text"), model, id_col, ["held_out"])
