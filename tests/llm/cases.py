"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import random

WORDS = "alpha Beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
CLASHES = "n_words string, kept string, rid string, score string, __grp string, row string, sig string, key string, bucket string, ids string, spans string, length string"


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(200)) for _ in range(n))


def edited(text, seed, edits):
    r, w = random.Random(seed), text.split(" ")
    for _ in range(edits):
        w[r.randrange(len(w))] = f"edit{r.randrange(10**6)}"
    return " ".join(w)


def documents():
    base, passage = prose(1, 120), prose(2, 60)
    texts = [base, base.upper(), base, edited(base, 3, 2), edited(base, 4, 3), edited(base, 5, 30), prose(6, 80), prose(7, 80) + "\n" + passage, passage + "\t" + prose(8, 50), passage]
    texts += [None, "", " \n\t ", "one two", "ONE two", "a b c d", "a b c d e", "a b c d e f", "é ü 漢字 ß", "x " * 300, prose(9, 30) + "\n" + prose(9, 30), " lead  and\x0btrail\r\n", prose(10, 6000)]
    texts += [edited(prose(11, 400), s, 4) for s in range(12)] + [prose(11, 400)] * 3
    rows = [(i, t, ["en", "de", None][i % 3], ["a", "b", None][i % 4 % 3], len(t or "")) for i, t in enumerate(texts)]
    rows += [(None, base, "en", "a", 1), (None, None, None, None, None), (3, texts[3], "en", "b", 1), (3, texts[3], "en", "b", 1), (7, "another text for the same id", "en", "a", 1), (-5, base, "de", "b", 2)]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA)


def with_clashes(df):
    from pyspark.sql import functions as F

    for c in CLASHES.split(", "):
        df = df.withColumn(c.split()[0], F.lit("clash"))
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
