"""Small tables with everything that tends to break: nulls, empty and long texts, repeats, odd columns."""

import random

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "row long, `digest` string, keys array<string>, n long, component long, words string, host string"
)


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgéo") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    return " ".join(rng.choice(words) + rng.choice(["", "", "", ",", ".", ".\n"]) for _ in range(n))


def odd_texts() -> list[tuple]:
    long = prose(1, 30_000)
    base = prose(2, 400).split(" ")
    near = [*base]
    near[50] = "changed"
    passage = prose(3, 60)
    rows = [
        (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, long), (6, " ".join(base)), (7, " ".join(near)),
        (8, " ".join(base)), (9, " ".join(base).upper()), (10, prose(4, 100) + " " + passage + " " + prose(5, 100)),
        (11, prose(6, 80) + "\n" + passage), (12, passage + " " + passage), (13, "a b c " * 200), (14, "#$ %& | <> " * 60),
        (15, "same line here\n" * 30 + prose(7, 120)), (16, "Écrire À l'école İ Σ ß \x0b x\x1cy  z 中文 🙂"),
        (17, "x" * 50_000), (18, "mail a.b@c.example.com and 10.1.2.3 or 4111 1111 1111 1111, +1 (234) 555-1234 999.1.1.1"),
        (19, " " * 20_000 + "end"), (20, "\n".join(["tail"] * 5)), (21, None), (22, prose(8, 5_000)),
        (23, "x y z w v " * 20), (23, "x y z w v " * 20),
    ]
    return rows


def odd_documents(spark):
    """All odd texts, one row without id, and columns whose names the operators use themselves."""
    langs, sources = ["en", "fr", None], ["s1", "s1", None, "s2"]
    rows = [
        (i, t, langs[k % 3], sources[k % 4], None if t is None else len(t), k % 2, "d", ["k"], None, 0, "w", "h")
        for k, (i, t) in enumerate(odd_texts())
    ]
    return spark.createDataFrame(rows, SCHEMA)


def without_rows(spark):
    return spark.createDataFrame([], SCHEMA)
