"""Whitening against numpy over all vectors."""

import numpy as np
import pytest

from quillspark.llm import whitening
from quillspark.llm.queries import QUERIES

from ..conftest import SF

SCHEMA = "vec_id long, embedding array<float>, n int, Deviation string"


def plain(vectors, most=8):
    x = np.floor(1024 * np.array(vectors, np.float32).astype(float)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    centred = (n * x - s) / n
    cov = centred.T @ centred / n
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1][:most], v[:, ::-1][:, :most]
    return n, ((n * x - s) ** 2).sum(axis=1), centred @ v / np.sqrt(e), e / np.trace(cov)


@pytest.mark.parametrize("block", [whitening.BLOCK_BYTES, 20_000])  # one block, many blocks
def test_query_equals_numpy(spark, duck, monkeypatch, block):
    monkeypatch.setattr(whitening, "BLOCK_BYTES", block)
    got = QUERIES["op12_whitening"](spark, SF).toPandas().sort_values(["component", "vec_id"])
    rows = duck.execute("select vec_id, embedding from embeddings order by vec_id").fetchall()
    n, deviation, whitened, explained = plain([e for _, e in rows])
    assert len(got) == 8 * n and set(got["n"]) == {n}
    for c in range(8):
        part = got[got["component"] == c + 1]
        assert part["vec_id"].tolist() == [i for i, _ in rows] and part["deviation"].tolist() == deviation.tolist()
        mine = part["whitened"].to_numpy()
        sign = np.sign(mine @ whitened[:, c])
        assert np.abs(sign * mine - whitened[:, c]).max() < 1e-9
        assert np.allclose(part["explained"], explained[c], rtol=1e-9)
    assert 0 <= got["identity_error"].max() < 1e-9 and got["identity_error"].nunique() == 1


def test_edges(spark):
    draw = np.random.default_rng(1)
    good = [(i, [float(v) for v in draw.normal(size=3)]) for i in range(40)] + [(1, [5.0, 5.0, 5.0]), (1, [5.0, 5.0, 5.0]), (None, [0.0, -1.0, 2.0])]
    bad = [(50, None), (51, []), (52, [1.0, None, 2.0]), (53, [float("nan"), 1.0, 1.0]), (54, [float("inf"), 1.0, 1.0]), (55, [1.0, 2.0])]
    got = whitening.whiten(spark.createDataFrame([(*r, 0, "") for r in good + bad], SCHEMA)).toPandas()
    n, deviation, _, _ = plain([e for _, e in good])
    assert len(got) == 3 * n and set(got["n"]) == {n}
    assert sorted(got[got["component"] == 1]["deviation"]) == sorted(deviation.tolist())
    assert len(got[got["vec_id"] == 1]) == 9 and got["vec_id"].isna().sum() == 3
    same = spark.createDataFrame([(i, [1.0, 2.0, 3.0], 0, "") for i in range(5)], SCHEMA)
    line = spark.createDataFrame([(i, [1.0 * i, 2.0 * i, 0.0], 0, "") for i in range(5)], SCHEMA)
    assert whitening.whiten(same).count() == 0 and whitening.whiten(same.limit(1)).count() == 0
    assert whitening.whiten(same.limit(0)).columns == [x.split()[0] for x in whitening._OUT.split(", ")]
    assert {r["component"] for r in whitening.whiten(line).collect()} == {1}  # one direction only


def test_large_deviations_are_exact(spark):
    rows = [(i, [float(1 << 16) * (i - 2), 1.0], 0, "") for i in range(5)]
    got = {r["vec_id"]: r["deviation"] for r in whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: (5 * ((i - 2) << 26)) ** 2 for i in range(5)}
