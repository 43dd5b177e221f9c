import pytest

#: Ids and texts that every operator has to take: nulls, empty and blank texts, a long one, repeats of a row and of an id.
EDGES = [
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "x " * 60_000),
    (5, "red oak stands near the old mill"),
    (5, "red oak stands near the old mill"),
    (6, "red oak stands near the old mill"),
    (7, "ÉTÉ straße 中文 😀 \x00 \x85 end"),
    (None, "red oak stands near the old mill"),
]


@pytest.fixture(scope="session")
def edges(spark):
    """The edge rows, with columns whose names operators use themselves."""
    rows = [(i, t, "en", "s", 0, 1, "c", [1], "h") for i, t in EDGES]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fp long, component_id string, hash array<int>, h string")


@pytest.fixture(scope="session")
def nothing(edges):
    return edges.limit(0)


@pytest.fixture(scope="session")
def prose():
    """Invented documents: good ones, and bad ones of three kinds."""
    import random

    draw = random.Random(4)
    stems = ["ra", "to", "lin", "mer", "sa", "ko", "vel", "dun", "esh", "ti", "or", "an"]
    word = lambda: "".join(draw.choice(stems) for _ in range(draw.randint(1, 3)))
    line = lambda n: (" ".join(word() for _ in range(n))).capitalize() + "."
    good = ["\n".join(line(draw.randint(6, 14)) for _ in range(12)) for _ in range(160)]
    bad = [" ".join(w + draw.choice(["%%%", "$$$", "&&&"]) for w in line(90).split()) for _ in range(30)]
    bad += [" | ".join(word() + word() for _ in range(90)) for _ in range(30)]
    bad += [line(90).upper().replace(" ", "!! ") for _ in range(30)]
    return good, bad
