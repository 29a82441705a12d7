"""Vectors in cells against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import semloom as sl
from semloom.operators import cells, topk
from semloom.operators.topk import VectorIndex

NEAR = [{"name": "near", "type": list[str], "desc": ""}]


def grouped(rng, n, groups, width=8, spread=0.05):
    centres = rng.normal(size=(groups, width))
    return centres[rng.integers(0, groups, n)] + rng.normal(scale=spread, size=(n, width))


def test_pairs_over_a_similarity(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x, y = grouped(rng, 300, 12), grouped(np.random.default_rng(1), 400, 12)
    odd = [None, [], [0.0] * 8, [float("nan")] * 8]
    lefts = [(f"l{i}".encode(), v) for i, v in enumerate([*x.tolist(), *odd])]
    rights = [(f"r{i}".encode(), v) for i, v in enumerate([*y.tolist(), *odd[:3]])]
    l, r = spark.createDataFrame(lefts, "__l binary, vector array<double>"), spark.createDataFrame(rights, "__r binary, vector array<double>")
    sim = cells.cosines(x, y)
    blank = {(a, b) for a, v in lefts for b, w in rights if not (v and w and any(v) and any(w) and v[0] == v[0])}
    for block, low in ((2048, 0.9), (30, 0.9), (2048, 0.2), (2048, float("-inf"))):
        monkeypatch.setattr(cells, "BLOCK", block)
        found, formed = cells.counted_pairs_over(l, r, low)
        rows = [(bytes(p["__l"]), bytes(p["__r"]), p["sim"]) for p in found.collect()]
        assert len(rows) == len({p[:2] for p in rows})
        assert {p[:2] for p in rows if p[2] is not None} == {(f"l{i}".encode(), f"r{j}".encode()) for i, j in zip(*np.nonzero(sim >= low), strict=True)}
        assert {p[:2] for p in rows if p[2] is None} == blank
        assert formed <= 300 * 400 and (low < 0.9 or formed < 0.3 * 300 * 400)


@pytest.mark.parametrize("block", [2048, 30])
def test_nearest_is_exact_and_breaks_ties_by_id(spark, monkeypatch, block):
    monkeypatch.setattr(cells, "BLOCK", block)
    rng = np.random.default_rng(2)
    v = grouped(rng, 500, 20)
    v[9], v[10], v[100] = v[11], v[11], 2 * v[11]  # the same direction: ties
    rows = [(i, f"v{i}", x) for i, x in enumerate(v.tolist())] + [(900, "zero", [0.0] * 8), (901, "none", None), (902, "empty", [])]
    index = spark.createDataFrame(rows, "id long, value string, vector array<double>")
    asked = [*range(0, 500, 7), 11]
    queries = spark.createDataFrame([(i, v[i].tolist()) for i in asked] + [(1000, [0.0] * 8), (1001, None)], "q long, vector array<double>")
    got = {}
    for r in cells.nearest(queries, index, 12).collect():
        got.setdefault(r["q"], []).append((-r["sim"], r["id"]))
    sim = cells.cosines(np.vstack([v[asked], np.zeros((1, 8))]), np.vstack([v, np.zeros((1, 8))]))
    ids = [*range(500), 900]
    for row, q in enumerate([*asked, 1000]):
        assert sorted(got[q]) == sorted((-s, i) for s, i in zip(sim[row], ids, strict=True))[:12]
    assert 1001 not in got
    some = cells.nearest(queries.where("q < 1000"), index, 5, probes=4).collect()
    right = {(q, i) for row, q in enumerate(asked) for _, i in sorted((-s, i) for s, i in zip(sim[row], ids, strict=True))[:5]}
    assert len({(r["q"], r["id"]) for r in some} & right) >= 0.9 * len(right)


def test_ties_are_the_same_on_both_sides_of_the_size_limit(spark, monkeypatch):
    rows = [(i, f"value {i}", [1.0, 0.0] if i in (9, 10) else [0.0, float(i + 1)]) for i in range(30)] + [(40, "zero", [0.0, 0.0]), (41, "none", None)]
    index = VectorIndex(spark.createDataFrame(rows, "id long, v string, e array<double>"), "id", "v", "e")
    data = sl.FrameDataset(spark.createDataFrame([(1, [2.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0]), (4, None)], "q long, e array<double>"), "q")
    config = sl.QueryProcessorConfig(optimizer_strategy="none")

    def run(k):
        return {r["q"]: r["near"] for r in data.sem_topk(index, "e", NEAR, k=k).run(config).df.collect()}

    small = {k: run(k) for k in (1, 3, 50)}
    assert small[1] == {1: ["value 9"], 2: ["value 0"], 3: ["value 0"], 4: None} and len(small[50][1]) == 31
    monkeypatch.setattr(topk, "BROADCAST_BYTES", 0)
    assert {k: run(k) for k in (1, 3, 50)} == small
    assert data.sem_topk(VectorIndex(index.df.where(F.lit(False)), "id", "value", "vector"), "e", NEAR, k=2).run(config).df.where("near is not null and size(near) > 0").count() == 0


def test_a_broadcast_index_is_searched_for_many_queries_at_once(monkeypatch):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(700, 8))
    v[3], v[4], v[5] = 0.0, np.nan, v[6]
    queries = [*v[::7], np.zeros(8), v[0], v[0]]
    monkeypatch.setattr(topk, "QUERIES", 40)
    monkeypatch.setattr(topk, "ROWS", 90)
    products = []
    monkeypatch.setattr(topk, "_directions", lambda x, own=topk._directions: products.append(len(x)) or own(x))
    sim = cells.cosines(np.nan_to_num(np.array(queries)), np.where(np.isfinite(v), v, 0.0))
    found = topk._searched(queries, list(range(700)), v, 6)
    assert found == [np.lexsort((np.arange(700), -s))[:6].tolist() for s in sim]
    assert len(products) < 40  # 101 distinct queries in three blocks meet eight blocks of rows


def test_equal_vectors_are_searched_once(monkeypatch):
    sign = np.where(np.random.default_rng(6).normal(size=(20000, 2)) > 0, 1.0, -1.0)
    kept = topk._first_copies(sign, 4)
    assert len(kept) == 16
    scored = []
    monkeypatch.setattr(cells, "exact", lambda a, b, own=cells.exact: scored.append(len(a)) or own(a, b))
    found = topk._searched(list(sign), kept.tolist(), sign[kept], 4)
    assert all(found[i] == np.flatnonzero((sign == sign[i]).all(1))[:4].tolist() for i in range(0, 20000, 97))
    assert sum(scored) <= 4 * 16


def test_a_large_index_of_few_vectors_is_thinned_and_broadcast(spark, monkeypatch):
    kinds = [[1.0, 1.0], [1.0, -1.0], [-1.0, 1.0], [0.0, 0.0], [1.0, None]]
    rows = spark.createDataFrame([((i * 7919) % 3000, kinds[i % 5]) for i in range(3000)], "id long, e array<double>").repartition(5)
    assert topk._thinned(VectorIndex(rows, "id", "id", "e").df, 2).count() <= 5 * len(kinds) * 2
    monkeypatch.setattr(topk, "BROADCAST_BYTES", 1000)
    monkeypatch.setattr(topk, "nearest", lambda *_: 1 / 0)
    index = VectorIndex(rows, "id", "id", "e")
    found = sl.FrameDataset(rows, "rows").sem_topk(index, "e", NEAR, k=4).run(sl.QueryProcessorConfig(optimizer_strategy="none")).df.collect()
    of = {}
    for r in sorted(rows.collect()):
        of.setdefault(str(r["e"]), []).append(str(r["id"]))
    assert len(found) == 3000 and index.df.count() == 3000
    assert all(r["near"] == of[str(r["e"])][:4] for r in found if r["e"] in kinds[:3])
    assert all(r["near"] == [str(i) for i in range(4)] for r in found if r["e"] not in kinds[:3])  # no direction: all are as near


def rows_written(monkeypatch):
    sizes = []

    def counted(df, name, own=cells.written):
        out = own(df, name)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(cells, "written", counted)
    return sizes


def test_a_search_copies_no_query_for_each_cell(spark, monkeypatch):
    sizes = rows_written(monkeypatch)
    monkeypatch.setattr(cells, "BLOCK", 100)
    v = np.random.default_rng(3).normal(size=(900, 16))  # bounds rule nothing out
    index = spark.createDataFrame([(i, str(i), x) for i, x in enumerate(v.tolist())], "id long, value string, vector array<double>")
    got = {}
    for r in cells.nearest(index.selectExpr("id as q", "vector"), index, 4).collect():
        got.setdefault(r["q"], []).append((-r["sim"], r["id"]))
    sim = cells.cosines(v, v)
    for i in range(900):
        assert [x for _, x in sorted(got[i])] == np.lexsort((np.arange(900), -sim[i]))[:4].tolist()
    assert max(sizes) <= 4 * 900


def test_pairs_copy_no_row_for_each_cell(spark, monkeypatch):
    sizes = rows_written(monkeypatch)
    monkeypatch.setattr(cells, "BLOCK", 100)
    v = np.random.default_rng(4).normal(size=(900, 16))
    l = spark.createDataFrame([(f"{i}".encode(), x) for i, x in enumerate(v.tolist())], "__l binary, vector array<double>")
    found = {(int(r["__l"]), int(r["__r"])) for r in cells.pairs_over(l, l.withColumnRenamed("__l", "__r"), 0.5).collect()}
    assert found == {(int(i), int(j)) for i, j in zip(*np.nonzero(cells.cosines(v, v) >= 0.5), strict=True)}
    assert max(sizes) <= 900
