import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, row string, fp int, score string, size int, marks string, spans int, `a.b` double"


def prose(seed: int, n: int) -> str:
    """Seeded sentences of invented words."""
    out, x = [], seed * 7919 + 17
    for _ in range(n):
        x = (x * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        out.append("".join("bcdfglmnprst"[(x >> s) % 12] + "aeiou"[(x >> s + 4) % 5] for s in (20, 30, 40)[: 1 + x % 3]))
    return " ".join(out)


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls in every column, empty and blank texts, a long text, repeated ids and rows, a hot source, names that clash."""
    base = [(i, prose(i, 40 + i), "en" if i % 2 else "de", "big", 1) for i in range(30)]
    odd = [
        (None, prose(3, 43), "en", "big", None),
        (None, None, None, None, None),
        (100, None, "en", "small", 0),
        (101, "", None, "small", 0),
        (102, " \t\n ", "de", None, 3),
        (103, prose(5, 45), "de", "big", 1),
        (104, prose(5, 45), "de", "small", 1),
        (104, prose(5, 45), "de", "small", 1),
        (105, prose(9, 30_000), "en", "big", 1),
        (106, "ñandú Straße 東京 \U0001f600 " * 4, "es", "tiny", 1),
        (107, 'token = "abc123XYZ789" ñ password: short7 ' + "0123456789abcdef" * 2, "en", "tiny", 1),
        (108, "x", "en", "tiny", 1),
    ]
    rows = [(*r, 1, "r", 2, "s", 3, "m", 4, 0.5) for r in base + odd]
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, int(i % 5 > 0), 0) for i in range(30)] + [(None, 1, 0), (3, None, 0), (100, 0, 0), (0, 0, 0), (0, 0, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def benchmark(spark):
    rows = [
        (1, prose(4, 44)[:200]),
        (2, " ".join(prose(6, 46).split()[10:24])),
        (3, " ".join(prose(7, 47).split()[:4])),
        (3, None),
        (4, ""),
        (None, " ".join(prose(8, 48).split()[5:20])),
        (50, " ".join(prose(9, 30_000).split()[20_000:20_012])),
    ]
    return spark.createDataFrame(rows, "item_id long, text string")
