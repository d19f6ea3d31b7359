"""Connected components: right on chains and cycles, and no rounds over edges that are stars already."""

from tidemark.llm import common as C


def test_components_stop_at_stars(spark, monkeypatch):
    rounds = []
    keep = C.freeze
    monkeypatch.setattr(C, "freeze", lambda df: rounds.append(1) or keep(df))
    edges = lambda rows: spark.createDataFrame(rows, "a long, b long")
    stars = C.components(edges([(2, 1), (3, 1), (1, 4), (9, 8)]))
    assert len(rounds) == 1
    assert sorted(map(tuple, stars.collect())) == [(1, 1), (2, 1), (3, 1), (4, 1), (8, 8), (9, 8)]
    chain = C.components(edges([(i, i + 1) for i in range(9)] + [(20, 22), (22, 21), (21, 20), (30, 30)]))
    assert sorted(map(tuple, chain.collect())) == [(i, 0) for i in range(10)] + [(20, 20), (21, 20), (22, 20)]
