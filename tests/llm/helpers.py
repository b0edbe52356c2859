"""Rows that every operator has to take: nulls, empty and long texts, ties, repeats, clashing names."""

ODD_SCHEMA = ("doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG, size LONG, score DOUBLE, label INT, "
              "bucket INT, shard INT, block LONG, cell INT, before LONG, place LONG, fold INT, n INT, a LONG, sid LONG, x STRING")
_REST = (1, 0.5, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, "x")


def odd_rows():
    long = " ".join(f"w{i % 977} and" for i in range(30_000))
    texts = [None, "", " \t\n", "a", "one two three four five six", "one two three four five six", "One  TWO three four five six",
             long, long + " tail", "ünï cödé ñandú   x", "<|endoftext|> it's 12 !!'s", "z" * 5_000, "\u0000 a\u0000b"]
    rows = [(i, t, "en", f"s{i % 3}", len(t or ""), *_REST) for i, t in enumerate(texts)]
    rows += [(3, "a", None, None, None, *_REST), (3, "a", None, None, None, *_REST), (None, "no id here", "en", None, 1, *_REST),
             (20, "x y z", None, "é", 5, *_REST)]
    return rows


def odd_documents(spark):
    return spark.createDataFrame(odd_rows(), ODD_SCHEMA)


def no_documents(spark):
    return spark.createDataFrame([], ODD_SCHEMA)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id LONG, quality INT, toxic INT")
