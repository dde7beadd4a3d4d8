"""Small awkward tables: nulls everywhere, empty and very long texts, ties, repeats, clashing column names."""

SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, "
    "_row string, rank string, n_words string, hash string, length string, score string, component_id string"
)
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def sentence(seed: int, n: int) -> str:
    out, x = [], seed * 2654435761 % 4294967296
    for _ in range(n):
        x = (x * 1664525 + 1013904223) % 4294967296
        out.append(WORDS[(x >> 16) % len(WORDS)] + str((x >> 8) % 7))
    return " ".join(out)


PASSAGE = sentence(99, 60)

TEXTS = [
    (0, sentence(1, 40)), (1, sentence(1, 40)), (2, sentence(1, 39) + " tail"), (3, ""), (4, None), (5, "   \n\t "),
    (6, "one"), (7, "One two\nthree"), (8, sentence(2, 30) + "\n" + PASSAGE + "\n" + sentence(3, 30)),
    (9, PASSAGE + " " + sentence(4, 200)), (10, sentence(5, 6000)), (10, sentence(6, 20)), (10, sentence(6, 20)),
    (None, sentence(7, 25)), (None, None), (12, "ünï çödé ñ 漢字 " + sentence(8, 15) + " 漢字 x"),
    (13, sentence(9, 30) + " <|endoftext|> " + sentence(9, 30)), (14, "a" * 3000), (15, "x  y \n z\r\n\tw " * 40),
    (16, sentence(5, 3000)), (17, "漢字" * 400),
]


def documents(spark, texts=TEXTS):
    rows = [(i, t, None if k % 3 else "en", None if k % 2 else "src", None, *["x"] * 7) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
