"""A small table with all that is odd: null ids and texts, empty texts, repeats, ties, a long text, clashing column names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, size string, key int"


def documents(spark, n: int = 60, seed: int = 3):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(300)]

    def prose(k):
        return " ".join(rng.choice(words) for _ in range(k))

    passage = prose(60)
    rows = []
    for i in range(n):
        text = prose(rng.randint(1, 120)).capitalize() + ".\nÉté " + prose(20)
        if i % 7 == 3:
            text += "\n" + passage
        rows.append((i, text, "en" if i % 3 else "fr", f"src{i % 4}", len(text), 5, "x", None))
    rows.append((n, rows[5][1], "en", "src1", 1, None, None, None))  # an exact copy
    rows.append((n + 1, rows[6][1] + " extra", None, None, None, 1, "", 1))  # a near copy, null columns
    rows.append((n + 2, None, None, None, None, None, None, None))
    rows.append((n + 3, "", "de", "src0", 0, None, None, None))
    rows.append((n + 4, " \n\t ", "de", "src0", 4, None, None, None))
    rows.append((None, prose(40), "en", "src0", 4, None, None, None))
    rows.append((None, None, None, None, None, None, None, None))
    rows.append(rows[8])  # a repeated row
    rows.append(rows[8])
    rows.append((n + 5, prose(40_000), "en", "src2", 1, None, None, None))
    rows.append((n + 6, "12345 !!! <|endoftext|>   x", "es", "src3", 1, None, None, None))
    return spark.createDataFrame(rows, SCHEMA)


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
