"""Groups of which a large part is junk of one kind."""

import random

import pytest

from quern.llm import quality_rules


@pytest.mark.parametrize("percent", [15, 30, 40])
def test_many_outliers_are_rejected(spark, percent):
    rng = random.Random(percent)
    junk = 4 * percent
    rows = [(k, " ".join("x" * rng.randint(2, 9) + str(rng.randrange(10**6)) for _ in range(rng.randint(80, 300))), "en", "s") for k in range(400 - junk)]
    rows += [(1000 + k, " ".join("#$%&*" * 3 + str(rng.randrange(10**6)) for _ in range(150)), "en", "s") for k in range(junk)]
    got = {r.doc_id: r.kept for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not any(got[1000 + k] for k in range(junk))
    assert sum(got[k] for k in range(400 - junk)) >= 0.99 * (400 - junk)
