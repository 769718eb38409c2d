"""Small tables with awkward rows, and plain versions of the operators."""

import random
import re
import zlib

from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text, fold=False):
    text = text or ""
    return WORD.findall(text.translate(FOLD) if fold else text)


def rest(key, mod):
    return zlib.crc32(str(key).encode()) % mod


def corpus(seed=0, n=60):
    """Documents with exact and near copies, shared passages, nulls, empty, short, odd and very long texts, and ties."""
    rng = random.Random(seed)
    vocab = [f"{a}{b}" for a in "abdefgh" for b in ("ra", "li", "mon", "tek", "sö")] + ["The", "x.", "|", "Ça"]
    text = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    passage = text(70)
    rows = [text(rng.choice([3, 4, 5, 6, 49, 50, 51, 120, 200])) for _ in range(n)]
    for i in range(0, n, 6):
        rows.append(rows[i])  # copies
        w = rows[i].split()
        w[rng.randrange(len(w))] = "changed"
        rows.append(" ".join(w))
        rows.append(rows[i].upper().replace(" ", "\t\n"))
    for i in range(8):
        rows.append(f"{text(20)} {passage} {text(15)}")
    rows += [None, "", "   \t\n", " ", "one", "one", "word " * 300, text(60_000), "\x1fa\x1f b", "日本 語", text(55) + " " + passage[:40]]
    return [(i * 3 % 1009 + 1, t, None if i % 9 == 0 else "l" + str(i % 2), f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(rows)]


def table(spark, rows, parts=3):
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(df):
    """The table with columns that carry names the operators use inside."""
    extra = ("id", "n", "key", "rep", "comp", "u", "v", "prefix", "place", "mask", "hits", "copy", "block", "score", "predicted", "held_out", "slot", "n_words")
    return df.withColumns({c: F.lit(f"x-{c}") for c in extra})
