"""Names in texts against plain search."""

import random

import pytest

from boutline.operators import textops


@pytest.mark.parametrize("few", [256, 0])
def test_names_of_any_length(spark, monkeypatch, few):
    monkeypatch.setattr(textops, "FEW_NAMES", few)
    naming = textops.naming
    rng = random.Random(4)
    names = ["".join(rng.choice("abAB é😀") for _ in range(rng.randint(1, 6))) for _ in range(80)] + ["", "abc", "ABC", "İ"]
    texts = ["".join(rng.choice("abAB é😀c") for _ in range(rng.randint(0, 40))) for _ in range(200)] + [None, ""]
    t = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    n = spark.createDataFrame([(x, i) for i, x in enumerate(names)], "name string, ord int")
    got = sorted((r.id, r.ord) for r in naming(t, n, "text").collect())
    assert got == sorted((i, k) for i, x in enumerate(texts) if x for k, y in enumerate(names) if y and y.lower() in x.lower())
    if few:
        return
    plan = naming(t, n, "text")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
