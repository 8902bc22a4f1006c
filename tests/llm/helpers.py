"""Plain models and rows for the tests of the training-data operators."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, row string, _text string, _k1 long, fp long, ids string, h long"


def frame(spark, rows):
    """documents with columns that bear names of helper columns; rows: (doc_id, text, source)."""
    data = [(i, t, "en", s, None if t is None else len(t), -1, "x", "y", 5, 6, "z", 7) for i, t, s in rows]
    return spark.createDataFrame(data, SCHEMA)


def words(rng, n, pool=40):
    return [rng.choice("abcdefgh") * rng.randint(1, 3) + str(rng.randrange(pool)) for _ in range(n)]


def texts(seed, n, lines=6, width=9):
    """Random texts of lines with repeats inside and across, beside the odd ones."""
    rng = random.Random(seed)
    stock = [" ".join(words(rng, rng.randint(1, width))) for _ in range(12)]
    out = ["\n".join(rng.choice(stock) if rng.random() < 0.6 else " ".join(words(rng, rng.randint(1, width))) for _ in range(rng.randint(1, lines)))
           for _ in range(n)]
    return out + [None, "", " ", "\n\n\n", "one", "Éà ñ 中文 \U0001f600", "a  b\tc\r\n d", "tail "]


def edge_rows(seed=1, n=20):
    """Rows with nulls, ties, repeats and copies under other ids."""
    some = texts(seed, n)
    rows = [(i, t, ["b", "a", None, "é"][i % 4]) for i, t in enumerate(some)]
    rows += [rows[0], rows[3], (900, some[0], "b"), (901, some[1], "a"), (3, "other text of id three", "a"), (None, "no id", "a"), (None, None, None), (None, some[2], "b")]
    rows.append((950, "\n".join(some[k % n] for k in range(300)), "b"))  # a long one
    return rows
