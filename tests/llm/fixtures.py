"""Small documents with the awkward cases, and a table of them with clashing extra columns."""

import functools
import random
import zlib

from pyspark.sql import functions as F

rnd = random.Random(11)
VOCABULARY = ["".join(rnd.choice("aeioulnrst") for _ in range(rnd.randint(2, 7))) for _ in range(400)] + ["Äpfel", "naïve", "東京", "😀x"]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


PASSAGE = prose(60, 1)


@functools.cache
def texts():
    """Texts: null, empty, blank, short, exact and near copies, shared passages, repeats inside one text, a long one."""
    base = prose(120, 2)
    near = base.split(" ")
    near[60] = "changed"
    out = [None, "", " \t\n\x0b", "one", "Two  words\n", "no break", "'s don't 'LL we'll", base, base, base + " ", " ".join(near), base.upper()]
    out += [prose(40 + i, 10 + i) + "\n" + PASSAGE + " " + prose(25, 50 + i) for i in range(4)]
    out += [PASSAGE + " " + prose(10, 90) + " " + PASSAGE, "ab " * 300, "x" * 900, prose(5000, 7) + PASSAGE, "\n".join(["same line of text here"] * 30), "1234 !!! ###"]
    return out + [prose(rnd.randint(1, 80), 100 + i) for i in range(25)]


def documents(spark, rows=None, **more):
    """doc_id, text and columns whose names operators use themselves."""
    rows = list(enumerate(texts())) if rows is None else rows
    df = spark.createDataFrame(rows, "doc_id long, text string")
    names = ["size", "t", "fp", "first", "n", "gram", "bucket", "words", "row", "path", "blob_id", "lang", "source", "n_chars", "h", "spans", "slot", "part"]
    return df.withColumns({c: F.lit(None).cast("string") for c in names}).repartition(3, "doc_id")


def crc(text):
    return zlib.crc32((text or "").encode())
