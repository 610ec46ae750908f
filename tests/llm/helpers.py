"""Small fixtures with every awkward row at once."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, pid int, length string, __id string, n_bytes string"
BLANKS = "[^\x20\x09-\x0d]+"


def prose(rng, n):
    return " ".join(rng.choice("the of and stone river cloud winter garden simple number seven light".split()) + rng.choice(["", "", ",", "."]) for _ in range(n))


def awkward_texts(seed=0):
    rng = random.Random(seed)
    base = [prose(rng, rng.randint(3, 90)) for _ in range(14)]
    shared = prose(rng, 30)
    out = [None, "", " \n\t ", "a", "word", "two words", "!!! ??? ...", "x" * 3000, "ab " * 700, "naïve Straße ЖЖЖ 日本語 ½", "a\x00b\x1cc"]
    out += base + [base[0], base[0], base[1] + " end", "start " + base[1], shared, base[2] + " " + shared, shared + " " + base[3]]
    return out


def awkward_rows(seed=0):
    texts = awkward_texts(seed)
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    rows += [rows[12], rows[12]]  # repeated rows
    rows += [(None, texts[11]), (None, None), (None, "no id here " * 9)]  # ids are missing
    random.Random(seed + 1).shuffle(rows)
    return rows


def frame(spark, rows):
    """documents with further columns whose names clash with the operators'."""
    full = [(i, t, "en", "s", None if t is None else len(t), "x", 7, "y", "z", "w") for i, t in rows]
    return spark.createDataFrame(full, SCHEMA)


def key(row):
    return repr(row)
