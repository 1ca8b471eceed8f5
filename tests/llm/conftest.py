import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
# Columns that operators use inside, and must neither read nor trip over.
CLASHING = "text_key bigint, v string, band int, kept string, hub array<int>, line_no string, comp double, _id int, _key string, tag int, h0 int, place string"


def words(draw: random.Random, n: int) -> list[str]:
    return ["".join(draw.choice(("ba", "de", "ki", "lo", "mu", "ra", "se", "ti")) for _ in range(draw.randint(1, 4))) for _ in range(n)]


def sentence_lines(draw: random.Random, n: int) -> str:
    out = words(draw, n)
    return "".join(w + ("\n" if draw.random() < 0.08 else " ") for w in out).strip()


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in any column, empty and blank texts, ties, repeated rows, copies, a very long text."""
    draw = random.Random(5)
    base = sentence_lines(draw, 120)
    long = sentence_lines(draw, 30_000)
    near = base.replace(base.split()[60], "changed", 1)
    rows = [
        (1, base, "en", "a", 3), (2, base, None, "a", 3), (3, near, "en", None, None), (4, None, "en", "a", None), (5, "", "en", "b", 0),
        (6, " \n\t ", "en", "b", 4), (7, "one two", "en", "b", 7), (8, "one two", "en", "b", 7), (9, long, "en", "c", len(long)),
        (10, long + " tail", "en", "c", len(long) + 5), (None, base, "en", "a", 3), (None, None, None, None, None), (1, base, "en", "a", 3),
        (11, "x " * 400, "en", "a", 800), (12, "same words here again and again " * 30, "de", "a", 1), (13, "é ü ñ z y", "fr", "a", 9),
    ]
    return rows


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    names = [c.split()[0] for c in CLASHING.split(", ")]
    df = spark.createDataFrame(odd_rows, SCHEMA)
    return df.selectExpr("*", *[f"CAST(NULL AS {c.split(' ', 1)[1]}) AS `{n}`" for c, n in zip(CLASHING.split(", "), names)])


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def crowd(spark):
    """120 documents: groups of near copies of several sizes, shared passages and lines, the rest unrelated."""
    draw = random.Random(9)
    rows, passage = [], words(draw, 40)
    for group in range(12):
        base = words(draw, draw.randint(30, 140))
        for _ in range(draw.choice((1, 2, 8, 14))):
            some = list(base)
            for _ in range(draw.randint(0, 6)):
                some[draw.randrange(len(some))] = words(draw, 1)[0]
            if draw.random() < 0.3:
                at = draw.randrange(len(some))
                some[at:at] = passage[draw.randrange(10):]
            rows.append((len(rows), "".join(w + ("\n" if i % 17 == 16 else " ") for i, w in enumerate(some)).strip(), "en", "s", 0))
    draw.shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA), sorted(rows)
