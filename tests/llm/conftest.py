import random

import pytest

ODD = [None, "", "   \n\t", "word", "one two three", "ÀÉ ßx", "a\x1cb c\x85d", "<|endoftext|> x", "<|ENDOFTEXT|>", "日本語 テキスト。", "x" * 5000]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, ties, and extra columns with names that operators use."""
    r = random.Random(5)
    long = " ".join(f"w{r.randrange(3000)}" for _ in range(12000))
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 4 else None, len(t or "")) for i, t in enumerate([*ODD, long, long])]
    rows += [(3, "word", "en", "s0", 4), (3, "word", "en", "s0", 4), (None, "no id here", "fr", None, None), (None, None, None, None, None), (7, "another text under a used id", "de", "s1", 1)]
    extra = [(*row, "k", 1, b"d", True, "z") for row in rows]
    return spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars long, key string, size int, doc binary, kept boolean, component string")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")


def prose(r: random.Random, n: int, words: int = 400) -> list[str]:
    return [f"v{int(r.paretovariate(0.7)) % words}" for _ in range(n)]


@pytest.fixture(scope="session")
def copies(spark):
    """Texts with exact and near copies, chains of near copies, and shared passages."""
    r = random.Random(11)
    rows, i = [], 0
    passage = prose(r, 70, 10**6)
    for g in range(25):
        base = prose(r, r.randint(30, 200), 10**6)
        for _ in range(r.randint(1, 6)):
            t = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 4, 9])):
                t[r.randrange(len(t))] = f"n{r.randrange(10**6)}"
            if r.random() < 0.3:
                at = r.randrange(len(t))
                t[at:at] = passage[r.choice([0, 0, 15]) : r.choice([55, 70])]
            rows.append((i, r.choice([" ", "\n", "  "]).join(t)))
            i += 1
    loop = "again and again " * 60
    rows += [(i, loop), (i + 1, loop + "end"), (i + 2, "start " + loop)]
    r.shuffle(rows)
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
