from __future__ import annotations

import random

import pytest

SYLLABLES = "er th on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()


def words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def corpus() -> list[tuple[int | None, str | None]]:
    """Clean texts, exact and near copies, a passage many share, junk, blanks, nulls, repeated rows and ids."""
    rng = random.Random(5)
    passage = " ".join(words(rng, 14))
    rows: list[tuple[int | None, str | None]] = []
    for i in range(40):
        own = words(rng, rng.randint(25, 160))
        if i % 3 == 0:
            own[5:5] = passage.split()
        rows.append((10 + i, " ".join(own)))
    for i in range(6):  # near copies of one text, and copies of those
        own = rows[1][1].split()
        own[-1 - i] = "changed"
        rows.append((100 + i, " ".join(own)))
    rows += [(200 + i, rows[2][1]) for i in range(5)]
    rows += [(5, rows[2][1]), (300, None), (301, ""), (302, " \n\t "), (303, "one"), (304, "one"), (305, "one two"), (306, "One TWO")]
    rows += [(307, "be " * 300), (308, "be " * 299 + "be"), (309, "x" * 5000), (310, "émoi " * 40), (311, "a\nb\n\na\n c \na")]
    rows += [(None, rows[0][1]), (None, None), (12, rows[2][1]), (13, "another text with an id that is there already " * 3)]
    rows += [(400, " ".join(words(rng, 6000)))]
    rows += [rows[3], rows[3]]
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The corpus with columns whose names the operators use inside."""
    clashing = "words string, n_words int, buckets int, row int, key int, n int, spans string, part int, kept int, _task int"
    data = [(i, t, "x", 1, 2, 3, 4, 5, "y", 6, 7, 8) for i, t in rows]
    return spark.createDataFrame(data, f"doc_id bigint, text string, {clashing}").repartition(5)


@pytest.fixture(scope="session")
def none(docs):
    return docs.where("false")
