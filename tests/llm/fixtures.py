"""Small tables with every odd case the operators define a result for."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, digest string, id long, home int, key int, kept_id long"
WORDS = "the of and a in is river stone cloud market signal paper garden winter copper harbour window letter engine forest".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randint(0, 40)) for _ in range(n)) + "."


def rows() -> list[tuple]:
    base = prose(1, 120)
    words = base.split()
    near = " ".join([*words[:60], "changed", *words[61:]])
    far = " ".join(w if k % 3 else "other" for k, w in enumerate(words))
    texts = [
        (1, base),
        (2, base),  # copy
        (3, near),
        (4, far),
        (5, base.upper()),
        (6, None),
        (7, ""),
        (8, "   \n\t "),
        (9, "one two three"),
        (10, "One  two\nthree"),
        (11, prose(2, 6000)),  # long
        (12, prose(3, 40) + " " + base[:200]),
        (13, "prefix " + base[:200] + " suffix"),
        (14, "\x00" * 60 + "é" * 60 + "日本語" * 30),
        (14, "\x00" * 60 + "é" * 60 + "日本語" * 30),  # repeated row
        (None, base),
        (None, None),
        (-7, "negative id: " + prose(4, 30)),
    ]
    return [(i, t, None if k % 5 == 0 else "en", None if k % 4 == 0 else "src0", None, "x", k, 1, None, 3) for k, (i, t) in enumerate(texts)]


def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
