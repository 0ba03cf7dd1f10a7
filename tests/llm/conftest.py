import random

import pytest


def prose(seed, n):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("aeioulnrst") for _ in range(r.randint(2, 8))) for _ in range(300)]
    return " ".join(r.choice(vocabulary) for _ in range(n))


def messy_rows():
    """Null and empty texts, null and repeated ids, ties, copies, a long text."""
    a, b = prose(1, 120), prose(2, 90)
    near = a.replace(" ", "  ", 3)
    rows = [
        (1, a), (2, a.replace(" ", "\n", 2)), (3, near), (3, near), (None, a), (4, None), (5, ""), (6, " \t\n\x0b\x0c\r"), (None, None),
        (7, b + "\nA common line of text\n" + b[:200]), (8, "a COMMON line of text  \nother\n\n" + b), (9, "  A common line of text"),
        (10, prose(3, 49)), (11, prose(3, 50)), (12, prose(3, 50)), (13, prose(4, 60) + " " + b), (14, "short"), (15, "De " * 400),
        (16, "De " * 60 + a), (17, prose(5, 30_000)), (18, prose(6, 40) + " é ü 日本 " + prose(6, 40)), (19, "ÀB\u0085C x\x1cy " * 4),
        (7, "another text under id 7 " + prose(7, 80)), (20, " ".join(a.split()[:60]) + " changed " + " ".join(a.split()[60:])),
    ]
    return rows


@pytest.fixture(scope="session")
def rows():
    return messy_rows()


@pytest.fixture(scope="session")
def messy(spark, rows):
    """The rows with other columns, whose names clash with results."""
    data = [(i, t, ("s%d" % (n % 3)) if n % 4 else None, "own", n) for n, (i, t) in enumerate(rows)]
    return spark.createDataFrame(
        data, "doc_id long, text string, source string, kept string, n_words int"
    ).repartition(3)


@pytest.fixture(scope="session")
def no_docs(messy):
    return messy.limit(0)
