"""Documents for the tests of this folder."""

import random
import re

from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(n, seed, vocabulary=400):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


def corpus():
    """(doc_id, text, lang, source): near copies, copies, shared passages, nulls, empty
    and very long texts, repeated rows, a null id and a null source."""
    rows = []
    for i in range(24):
        rows.append((i, " ".join(words(40 + 3 * i, i)), "en" if i % 2 else "de", f"s{i % 3}"))
    base = words(60, 100)
    for i in range(12):  # a family of near copies: one to three words differ
        own = list(base)
        for k in range(1 + i % 3):
            own[5 + 13 * k] = f"x{i}_{k}"
        rows.append((30 + i, " ".join(own), "en", "s0"))
    rows += [(50 + i, "The same  copy of a text.\nTwice said.", "en", None) for i in range(5)]
    passage = " ".join(words(20, 7))
    rows += [(60 + i, f"{' '.join(words(15, 200 + i))} {passage}\n{' '.join(words(9, 300 + i))}", "fr", "s1") for i in range(6)]
    rows += [(70, None, "en", "s2"), (71, "", "en", "s2"), (72, " \t\n ", None, "s2"), (73, "one", "en", "s1"), (74, "ONE", "en", "s1"),
             (75, "two words", None, None), (76, "1234 !!", "en", "s1"), (77, "z" * 3000, "en", "s0"), (78, "naïve café 漢字 🙂 <|endoftext|> x", "fr", "s0"),
             (79, " ".join(words(6000, 9, 50)), "de", "s0"), (80, "A b " * 30, "en", "s2"), (80, "A b " * 30, "en", "s2"), (81, "same id", "en", "s0"),
             (81, "another text of one id", "en", "s0"), (None, "a text without an id", "en", "s1"), (None, None, None, None)]
    return rows


def frame(spark, rows, extra=()):
    """Rows as a table of documents, with clashing columns of the names ``extra``."""
    df = spark.createDataFrame([(i, t, la, s, None if t is None else len(t)) for i, t, la, s in rows], SCHEMA)
    for c in extra:
        df = df.withColumn(c, F.lit("clash"))
    return df
