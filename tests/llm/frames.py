"""Small tables with every odd case, shared by the tests of this folder."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(rng, n, pool=400):
    return " ".join(f"w{rng.randrange(pool)}" + rng.choice(["", "a", "ère", "ß"]) for _ in range(n))


def odd_documents(seed=3):
    """Nulls in every column, empty and blank texts, ties, repeated rows, a long text,
    exact and near copies, shared passages, periodic text, other alphabets."""
    rng = random.Random(seed)
    base = [words(rng, rng.randrange(1, 160)) for _ in range(25)]
    passage = "\n".join(words(rng, 30) for _ in range(3))
    near = [words(rng, 120, 5000)]
    for _ in range(6):
        w = near[0].split(" ")
        w[rng.randrange(len(w))] = f"changed{rng.randrange(99)}"
        near.append(" ".join(w))
    texts = base + base[:6] + near + [
        None, "", " \n\t ", "one", "one two", "one two", "ONE two", passage + "\n" + words(rng, 40),
        words(rng, 9) + "\n" + passage, passage, "x" * 1500, "ab" * 900, "du " * 300,
        words(rng, 5000), "日本語 のテキスト　です " * 40, "a\x0bb\x0cc\r\nd\x85e\x1cf", "\n\n\n",
        "line\n\nline\nline\n", "Ünï cödé " * 60, "<|endoftext|> said <|im_start|>", "# * $ | <> & %"]
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["s1", "s2", None]),
             None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[0], rows[0], (None, "no id " * 30, None, None, None), (None, None, None, None, None),
             (3, "another text under a used id " * 20, "en", "s1", 1)]
    rng.shuffle(rows)
    return rows


def documents(spark, rows=None):
    return spark.createDataFrame(odd_documents() if rows is None else rows, SCHEMA)


def clashing(df):
    """The same table with extra columns whose names operators might use."""
    from pyspark.sql import functions as F
    names = ("n key id rank hits score _score start row a b x y words rare segs spans length bin shift "
             "c h ln later gone _t _d _gone _kept key_1 v top bucket").split()
    return df.withColumns({n: F.lit(1) for n in names if n not in df.columns})


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
