import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = ", doc string, tag string, node string, n string, bit string, grp string, size string, hash string, spans string, words string, pos string, key string, label string"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def fixture_rows():
    """Nulls, empty and blank texts, copies, near copies, shared passages, a very long text, ties, odd characters."""
    rng = random.Random(11)
    passage = words(rng, 70)
    base = words(rng, 120)
    cut = base.split()
    near = " ".join([*cut[:60], "zz", *cut[61:]])
    less = " ".join([*cut[:20], "aa", *cut[21:50], "bb", *cut[51:80], "cc", *cut[81:]])
    texts = [
        None, "", " \t\n\x0b\x0c\r ", "one", "one two three", "One TWO three", base, base, near, less, base.upper(), f"{words(rng, 30)} {passage} {words(rng, 30)}",
        f"{passage}\n{words(rng, 20)}", f"{words(rng, 10)} x {passage}", passage + " " + passage, words(rng, 20000), "é ü 你好 \U0001f600 " * 30, "a\n\na\na\n b", " ".join(["same"] * 200),
        "  lead and trail  ", words(rng, 49), " ".join(passage.split()[:50]), " ".join(passage.split()[:49]), "▁ x ▁▁y <s> </s> <unk>", "\x00ctl\x1f words",
    ]
    rows = [(k, t, ["en", "de", None][k % 3], ["a", "b"][k % 2], len(t) if t else 0) for k, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def rows():
    return fixture_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def clashing(spark, rows):
    """The documents with further columns that have names which the operators use."""
    n = EXTRA.count(" string")
    return spark.createDataFrame([(*r, *["x"] * n) for r in rows], SCHEMA + EXTRA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
