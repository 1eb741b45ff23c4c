"""Hard negatives against brute force and the SQL."""

import math
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from hiresift.llm import hard_negatives as hard

SCHEMA = "vec_id long, label int, embedding array<float>"


def brute(rows, positives=5, negatives=3):
    used = []
    for vec_id, label, v in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if vec_id is not None and vec_id % 7 == 0 else label
        used.append((vec_id, label, [math.floor(256 * float(np.float32(x))) for x in v]))
    out = []
    for i, (anchor, label, v) in enumerate(used):
        if anchor is None or anchor % 50:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), j is None, j or 0, k) for k, (j, _, w) in enumerate(used) if k != i]
        near = sorted(s for s in scored if used[s[3]][1] == label)[:positives]
        far = sorted(s for s in scored if used[s[3]][1] != label)
        for p in near:
            fit = [s for s in far if 50 * -p[0] <= 100 * -s[0] <= 95 * -p[0]][:negatives]
            out += [(anchor, used[p[3]][0], rank, used[s[3]][0], -p[0], -s[0]) for rank, s in enumerate(fit, 1)]
    return sorted(out, key=str)


def clustered(seed, n, dim=16, clusters=12, scale=1.0):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(clusters, dim))
    which = r.integers(clusters, size=n)
    v = centres[which] + 0.4 * r.normal(size=(n, dim))
    v *= scale * r.uniform(0.2, 3, size=(n, 1)) / np.linalg.norm(v, axis=1)[:, None]
    return [(i, int(which[i] % 10), [float(np.float32(x)) for x in v[i]]) for i in range(n)]


def odd_vectors():
    r = random.Random(6)
    rows = clustered(1, 700)
    same = [0.5, -0.25] * 8
    rows += [(1000 + i, 3, same) for i in range(120)] + [(1000, 3, same)] * 3 + [(1100, 4, same)] * 2  # ties and repeated rows
    rows += [(1200, 1, [0.0] * 16), (1201, 1, []), (1250, 1, []), (1251, 2, [1.0]), (1300, 2, [2.0, 1.0])]  # zero and short vectors
    rows += [(None, 3, same), (None, None, same), (2000, None, same), (2050, 3, None), (2100, 3, [math.nan] * 16), (2150, 3, [math.inf, *same[1:]])]
    rows += [(2200, 3, [None, *same[1:]]), (-50, 3, [-x for x in same]), (-7, 3, same)]
    r.shuffle(rows)
    return rows


def ask(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(str(path / "embeddings.parquet"))
    return hard.op12_hard_negatives(spark, str(path))


def test_query_equals_brute_force_and_sql(spark, tmp_path):
    rows = odd_vectors()
    got = ask(spark, tmp_path, rows)
    want = brute(rows)
    assert sorted(map(tuple, got.collect()), key=str) == want and len(want) > 100
    assert got.dtypes[2] == ("rank", "int")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    short = [(v, n) for v, _, n in rows if n is not None and len(n) in (0, 1, 2)]
    lengths = ", ".join(str(v) for v, _ in short)
    con.execute(f"create table filled as select vec_id, label, case when vec_id in ({lengths}) then list_resize(embedding, 16, 0) else embedding end as embedding from embeddings")
    con.execute("drop view embeddings; create view embeddings as from filled")
    cursor = con.execute(hard.SQL["op12_hard_negatives"])
    assert [c[0] for c in cursor.description] == got.columns
    assert sorted(cursor.fetchall(), key=str) == want


@pytest.mark.parametrize("ranges,first", [(3, 1), (4096, 2), (4096, 100)])
def test_many_groups_and_small_blocks(spark, tmp_path, monkeypatch, ranges, first):
    monkeypatch.setattr(hard, "GROUP_ROWS", 60)
    monkeypatch.setattr(hard, "LEAST_ROWS", 20)
    monkeypatch.setattr(hard, "RANGES", ranges)
    monkeypatch.setattr(hard, "FIRST", first)
    rows = odd_vectors()
    assert sorted(map(tuple, ask(spark, tmp_path, rows).collect()), key=str) == brute(rows)


def test_large_integers(spark, tmp_path):
    rows = [(i, lab, [x * 2.0**70 for x in v]) for i, lab, v in clustered(3, 60, dim=3)]
    top = 2**63 - 1
    got = [tuple(r) for r in ask(spark, tmp_path, rows).collect()]
    assert all(-top - 1 <= r[4] <= top for r in got)
    rows = [(i, lab, [x * 2.0**18 for x in v]) for i, lab, v in clustered(4, 300, dim=4)]  # beyond the integers of a double
    (tmp_path / "b").mkdir()
    assert sorted(map(tuple, ask(spark, tmp_path / "b", rows).collect()), key=str) == brute(rows)


def test_nothing(spark, tmp_path):
    for k, rows in enumerate([[], [(50, 1, None)], [(50, 1, [1.0])], [(1, 1, [1.0]), (2, 2, [1.0])]]):
        (tmp_path / str(k)).mkdir()
        assert ask(spark, tmp_path / str(k), rows).collect() == []


def test_clashing_names(spark):
    rows = clustered(9, 120)
    df = spark.createDataFrame(rows, SCHEMA)
    for extra in ("row", "group", "v", "norm", "angles", "cell", "anchor", "low"):
        df = df.selectExpr("*", f"'x' as `{extra}`")
    from pyspark.sql import functions as F

    relabelled = df.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    assert sorted(map(tuple, hard.mine_hard_negatives(relabelled, F.col("vec_id") % 50 == 0).collect()), key=str) == brute(rows)


@pytest.mark.parametrize("scale", [1e-3, 1.0, 1e6])
def test_bounds_hold_and_filter(scale):
    rows = clustered(5, 600, scale=scale)
    v = np.floor(256 * np.array([x for _, _, x in rows])).astype(np.int64)
    directions = hard.choose_directions(v[:200], 16)
    norms, angles = hard.angles_to(v, directions)
    least, most = hard.angle_ranges(angles, angles, angles)
    low, high = hard.score_bounds(least, most, norms[:, None], norms, norms)
    scores = v.astype(object) @ v.T.astype(object)
    assert (low <= scores.astype(float)).all() and (scores.astype(float) <= high).all()
    if scale == 1.0:
        assert np.mean(high < 0.5 * np.outer(norms, norms)) > 0.5  # most pairs are ruled out


def test_only_overlapping_windows_are_scored(monkeypatch):
    """Rows far from the anchor get no integer score."""
    v = np.array([[100, 0], [99, 5], [0, 100], [-100, 0], [2, 100]], np.int64)
    norms, angles = hard.angles_to(v, np.eye(2))
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(5)), pa.array(range(5)), pa.array([1, 2, 2, 2, 2]), pa.array(norms), pa.array([*angles]), pa.array(v.tolist())],
        names=["row", "vec_id", "label", "norm", "angles", "v"],
    )
    group, anchors = hard.Group([batch], 2), hard.Group([batch.slice(0, 1)], 2)
    scored = []

    class Rows(np.ndarray):
        def __getitem__(self, index):
            if isinstance(index, np.ndarray):
                scored.extend(index.tolist())
            return np.asarray(self)[index]

    group.real = group.real.view(Rows)
    found = hard.best_in_windows(group, anchors, np.array([[5000.0]]), np.array([[9999.0]]), 3, False)
    assert found[4].tolist() == [1] and scored == [1]
