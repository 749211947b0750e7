"""The bootstrap goes on while turns find new instances."""

from wayveil.llm import pii


def test_fourth_turn(spark):
    """Level j + 1 stands in patterns of level j alone, four each; level 4 is found in the fourth turn."""
    sizes = [768, 192, 48, 12, 3]
    rows = [("email" if k == 0 else None, f"m{k}-{i}", f"p{j}-{c}") for j in range(4) for k in (j, j + 1) for i in range(sizes[k]) for c in range(4)]
    found = {r.m for r in pii.bootstrap(spark.createDataFrame(rows, "kind string, m string, pattern string")).collect()}
    assert found >= {f"m{k}-{i}" for k in range(1, 5) for i in range(sizes[k])}
