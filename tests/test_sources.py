import numpy as np
import pytest
from pyspark.sql import functions as F

from tensorloom.operators import fields as X
from tensorloom.sources import containers as K
from tensorloom.sources import tensors as T
from tensorloom.streaming import configurations as Q


def back(df, axes, shape):
    out = np.full(shape, np.nan, complex)
    for r in df.collect():
        out[tuple(r[a] for a in axes)] = r["re"] + 1j * r["im"]
    return out


@pytest.fixture
def x():
    rng = np.random.default_rng(0)
    return rng.standard_normal((3, 2, 4, 2)) + 1j * rng.standard_normal((3, 2, 4, 2))


def test_npy_with_pushdown(spark, tmp_path, x):
    np.save(tmp_path / "c1.ov.npy", x)
    np.save(tmp_path / "c2.ov.npy", 2 * x)
    df = T.load(spark, f"{tmp_path}/*.ov.npy", "overlap")
    axes = T.KINDS["overlap"].axes
    assert np.array_equal(back(df.where("cfg = 'c1'"), axes, x.shape), x)
    part = df.where("cfg = 'c2' AND t = 2 AND e < 1 AND p IN (0, 3)")
    assert part.count() == 1 * 1 * 2 * 2
    assert {(r.t, r.e, r.p) for r in part.collect()} == {(2, 0, 0), (2, 0, 3)}


def test_raw_and_slices(spark, tmp_path, x):
    x.tofile(tmp_path / "c1.bin")
    df = T.load(spark, f"{tmp_path}/c1.bin", "overlap", "raw", shape=x.shape)
    assert np.array_equal(back(df, T.KINDS["overlap"].axes, x.shape), x)
    with pytest.raises(ValueError):
        K.raw((2,), "S4")
    for t in range(3):
        np.save(tmp_path / f"c9.t{t:03d}.psl.npy", x[t])
    df = T.load(spark, f"{tmp_path}/c9.t*.psl.npy", "overlap").where("t = 1")
    assert {r.t for r in df.select("t").distinct().collect()} == {1} and df.count() == 16


def test_lime_and_map(spark, tmp_path):
    rng = np.random.default_rng(1)
    u = (rng.standard_normal((2, 2, 2, 2, 4, 3, 3)) + 0j).astype("<c16")
    (tmp_path / "c1.lime").write_bytes(K.lime_file(u, (2, 2, 2, 2)))
    df = T.load(spark, f"{tmp_path}/c1.lime", "gauge", "lime")
    assert np.array_equal(back(df, T.KINDS["gauge"].axes, u.shape), u)
    v = (rng.standard_normal((2, 3, 2, 2, 2, 3)) + 0j).astype("<c8")
    (tmp_path / "c1.map").write_bytes(K.map_file({(t, e): v[t, e] for t in range(2) for e in range(3)}, (2, 2, 2, 2)))
    df = T.load(spark, f"{tmp_path}/c1.map", "eigenvector", "map", shape=v.shape, dtype="<c8")
    assert np.allclose(back(df, T.KINDS["eigenvector"].axes, v.shape), v)


@pytest.mark.parametrize(("container", "suffix", "kind", "lead"), [("npy", ".ov.npy", "overlap", 1), ("npy", ".ov.npy", "overlap", 2), ("raw", ".bin", "overlap", 1), ("slices", ".psl.npy", "overlap", 1), ("map", ".map", "eigenvector", 2), ("lime", ".lime", "gauge", 1)])
def test_written_files_read_back(spark, tmp_path, container, suffix, kind, lead):
    """Two configurations written from several tasks, indices without rows being zero."""
    rng = np.random.default_rng(3)
    shape = {"overlap": (3, 2, 4, 2), "eigenvector": (2, 3, 2, 2, 2, 3), "gauge": (2, 2, 2, 2, 4, 3, 3)}[kind]
    x = rng.integers(-4, 5, (2, *shape)) + 1j * rng.integers(-4, 5, (2, *shape))
    x[0, 1] = 0
    axes = T.KINDS[kind].axes
    rows = [(f"c{i[0]}", *map(int, i[1:]), float(x[i].real), float(x[i].imag)) for i in np.ndindex(*x.shape) if x[i] != 0]
    df = spark.createDataFrame(rows, "cfg string, " + ", ".join(f"{a} long" for a in axes) + ", re double, im double").repartition(5)
    T.write_tensor(df, str(tmp_path), kind, shape, container, suffix, lead=lead)
    options = {"raw": {"shape": shape}, "map": {"shape": shape, "dtype": "<c16"}}.get(container, {})
    got = T.load(spark, f"{tmp_path}/c*{suffix}", kind, "npy" if container == "slices" else container, **options)
    for k in range(2):
        assert np.array_equal(np.nan_to_num(back(got.where(f"cfg = 'c{k}'"), axes, shape)), x[k])
    assert not (tmp_path / "_writing").exists()
    if container == "npy":
        assert np.array_equal(np.load(tmp_path / "c1.ov.npy"), x[1])


def test_writer_errors(spark, tmp_path):
    schema = "cfg string, t long, e long, p long, c long, re double, im double"
    twice = spark.createDataFrame([("c", 0, 0, 0, 0, 1.0, 0.0)] * 2, schema)
    outside = spark.createDataFrame([("c", 9, 0, 0, 0, 1.0, 0.0)], schema)
    for df in (twice, outside):
        with pytest.raises(Exception, match="two rows|outside"):
            T.write_tensor(df, str(tmp_path), "overlap", (2, 2, 2, 2))
    apart = spark.createDataFrame([("c", 0, 0, 0, i, 1.0, 0.0) for i in range(2)], schema).repartitionByRange(2, "c")
    with pytest.raises(Exception, match="two tasks"):
        apart.write.format("tensor").mode("append").option("path", str(tmp_path)).option("kind", "overlap").option("shape", "2,2,2,2").save()
    assert not list(tmp_path.iterdir())


def test_binary_route_and_strides(spark, tmp_path, x):
    np.save(tmp_path / "c1.npy", x)
    df = T.binary_tensors(spark, f"{tmp_path}/c1.npy", ("t", "e", "p", "c"))
    assert np.array_equal(back(df, ("t", "e", "p", "c"), x.shape), x)
    x.tofile(tmp_path / "x.bin")
    for key in ((1,), (slice(None), 1), ([0, 2], slice(0, 2), slice(None, None, 2)), (2, 1, 3, 1)):
        assert np.array_equal(T.strided(str(tmp_path / "x.bin"), 0, x.shape, "<c16", key), x[np.ix_(*[[k] if isinstance(k, int) else (range(*k.indices(n)) if isinstance(k, slice) else k) for k, n in zip((*key, *[slice(None)] * (4 - len(key))), x.shape, strict=True)])][tuple(0 if isinstance(k, int) else slice(None) for k in key)])


def test_sparse_pairs(spark, tmp_path):
    np.savez(tmp_path / "c1.t000.npz", type_0="identity", type_1="sparse", indices_1=np.array([[0, 1], [2, 2]]), values_1=np.ones((2, 3, 3)) * 1j)
    df = T.sparse_pairs(spark, f"{tmp_path}/c1.t000.npz", momenta=2)
    assert df.where("kind = 'identity'").count() == 2 and df.where("kind = 'sparse'").count() == 2 * 2 * 9


def test_catalogue_and_queue(spark, tmp_path):
    rows = spark.range(20).select((F.col("id") % 4).cast("string").alias("cfg"), "id", F.lit(1.0).alias("re"), F.lit(0.0).alias("im"))
    T.save(rows, f"{tmp_path}/cat")
    stream = spark.readStream.schema("id long, re double, im double, cfg string").parquet(f"{tmp_path}/cat")
    query = Q.run_queue(stream, lambda df: df.groupBy("cfg").agg(F.sum("re").alias("total")), f"{tmp_path}/out", f"{tmp_path}/check")
    assert query.awaitTermination(120)
    assert {r.total for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {5.0}
    todo = Q.unfinished(spark.createDataFrame([("0",), ("9",)], "cfg string"), Q.finished(spark, f"{tmp_path}/out").select(F.col("cfg").cast("string")))
    assert [r.cfg for r in todo.collect()] == ["9"]
    assert Q.finished(spark, f"{tmp_path}/none").count() == 0


def test_blocks():
    rng = np.random.default_rng(2)
    u = X.unitary(rng.standard_normal((3, 2, 2, 4, 3, 3)) + 1j * rng.standard_normal((3, 2, 2, 4, 3, 3)) + 4 * np.eye(3))
    assert np.abs(u @ X.dagger(u) - np.eye(3)).max() < 1e-12
    s = X.stout(u, 2, 0.1)
    assert np.abs(s @ X.dagger(s) - np.eye(3)).max() < 1e-12
    flat = X.stout(np.broadcast_to(np.eye(3, dtype=complex), u.shape), 1, 0.1)
    assert np.abs(flat - np.eye(3)).max() < 1e-12
    h = X.laplacian_matrix(u)
    assert np.abs(h - h.conj().T).max() < 1e-12
    values, modes = X.lowest_modes(u, 4)
    f = modes.reshape(4, -1)
    assert np.abs(h @ f.T - f.T * values).max() < 1e-9 and (np.diff(values) >= -1e-12).all()
