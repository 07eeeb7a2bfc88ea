"""Queries SC1-SC8: tensors written as files of each container, read back, and used by operators.

Configuration k of the fixtures has k + 1 times the derived perambulator, so rows
that met across configurations would show in every result.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorloom.catalog_correlators import REL, Base
from tensorloom.catalog_fields import LE_SQL, OL_SQL, P2P_SQL, U_SQL, WORDS, elementals_p2p, gauge
from tensorloom.operators import correlators as C
from tensorloom.plans.einsum import Tensor
from tensorloom.sources import derived as D
from tensorloom.sources import labels as L
from tensorloom.sources import tensors as T

Q: dict[str, Callable] = {}
SQL: dict[str, str] = {}
CFGS = 4
SIZES = {"t": D.LT, "s_snk": D.NS, "s_src": D.NS, "e_snk": D.NE, "e_src": D.NE, "e_l": D.NE, "e_r": D.NE, "deriv": 4, "mom": len(D.MOMENTA), "e": D.NE, "c": D.NC, "x": D.LX, "y": D.LY, "z": D.LZ}


def query(name: str, sql: str | None = None):
    def put(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def _folder(spark: SparkSession) -> str:
    return L.fixture_folder(spark, uuid.uuid4().hex)


def _written(t: Tensor, kind: str, cfgs: int | str, grow: bool = True, **options) -> str:
    """A folder of files of a kind, written by the executors: configurations c0, c1, ... with k + 1 times the tensor (or the same if not grow), or a named one."""
    spark = t.frame.sparkSession
    rows = L.file_rows(t, kind, SIZES)
    axes = T.KINDS[kind].axes
    if isinstance(cfgs, str):
        rows = rows.select(F.lit(cfgs).alias("cfg"), *axes, "re", "im")
    else:
        k = F.explode(F.sequence(F.lit(0), F.lit(cfgs - 1))).alias("k")
        rows = rows.select(k, "*").select(F.concat(F.lit("c"), F.col("k")).alias("cfg"), *axes, *[(F.col(x) * (F.col("k") + 1 if grow else F.lit(1))).alias(x) for x in ("re", "im")])
    at = _folder(spark)
    T.write_tensor(rows, at, kind, L.file_shape(kind, SIZES | ({"mu": 4, "a": 3, "b": 3} if kind == "gauge" else {})), **options)
    return at


def _tau_files(spark: SparkSession, sf: str) -> str:
    """c0.tau.npy to c3.tau.npy."""
    return _written(D.perambulators(spark, sf), "perambulator", CFGS, suffix=".tau.npy")


TAUS = f"WITH {D.TAU_SQL}\nSELECT 'c' || k.range AS cfg, s, t, j, i, b, a, re * (k.range + 1) AS re, im * (k.range + 1) AS im FROM tau, range({CFGS}) k WHERE re <> 0 OR im <> 0"


@query("sc2_npy_perambulators", TAUS)
def sc2(spark: SparkSession, sf: str) -> DataFrame:
    """Four configurations of npy files, as operators take them."""
    at = _tau_files(spark, sf)
    return L.whole(L.read_labelled(spark, f"{at}/c*.tau.npy", "perambulator", SIZES)).frame


@query("sc1_raw_perambulators", TAUS.replace(f"range({CFGS}) k", "range(1, 2) k"))
def sc1(spark: SparkSession, sf: str) -> DataFrame:
    """A headless file of complex numbers, its shape given; the second configuration."""
    at = _written(D.perambulators(spark, sf), "perambulator", CFGS, container="raw", suffix=".bin")
    return L.whole(L.read_labelled(spark, f"{at}/c1.bin", "perambulator", SIZES, "raw", shape=L.file_shape("perambulator", SIZES))).frame


@query("sc3_time_slices", f"WITH {D.TAU_SQL}\nSELECT 'c9' AS cfg, s, t, j, i, b, a, re, im FROM tau WHERE (re <> 0 OR im <> 0) AND s IN (1, 5)")
def sc3(spark: SparkSession, sf: str) -> DataFrame:
    """One file a source time; only those asked for are opened."""
    at = _written(D.perambulators(spark, sf), "perambulator", "c9", container="slices", suffix=".tau.npy")
    some = T.load(spark, f"{at}/c9.t*.tau.npy", "perambulator").where("t_src IN (1, 5)")
    return L.whole(L.labelled(some, "perambulator", SIZES)).frame


@query("sc4_lime_gauge", f"WITH {U_SQL}\nSELECT 'c0' AS cfg, t, z, y, x, mu, a, b, re, im FROM u WHERE re <> 0 OR im <> 0")
def sc4(spark: SparkSession, sf: str) -> DataFrame:
    """Links in a LIME container, big-endian, three colours of which two are used."""
    u = gauge(spark, sf)
    at = _written(Tensor(u, T.KINDS["gauge"].axes, SIZES), "gauge", "c0", container="lime", suffix=".lime")
    return L.whole(L.read_labelled(spark, f"{at}/c0.lime", "gauge", SIZES, "lime")).frame


@query("sc5_map_eigenvectors", f"WITH {D.V_SQL}\nSELECT 'c0' AS cfg, t, e, x, re, im FROM v WHERE re <> 0 OR im <> 0")
def sc5(spark: SparkSession, sf: str) -> DataFrame:
    """Modes in a map of (t, e) to offsets, single precision."""
    at, shape = _written(D.eigenvectors(spark, sf), "eigenvector", "c0", container="map", suffix=".map", dtype="<c8"), L.file_shape("eigenvector", SIZES)
    return L.whole(L.read_labelled(spark, f"{at}/c0.map", "eigenvector", SIZES, "map", shape=shape, dtype="<c8")).frame


def _from_files(spark: SparkSession, sf: str) -> DataFrame:
    """(cfg, dt, re, im): the two-point function of four configurations, propagators and elementals read from files."""
    at, other = _tau_files(spark, sf), _written(D.elementals(spark, sf), "elemental", CFGS, grow=False, suffix=".phi.npy")
    tau = L.whole(L.read_labelled(spark, f"{at}/c*.tau.npy", "perambulator", SIZES))
    elem = C.operator_elementals(D.operator_terms(spark).where("op = 0"), L.whole(L.read_labelled(spark, f"{other}/c*.phi.npy", "elemental", SIZES)))
    b = Base(spark, sf)
    c: Tensor = C.twopoint(tau, b.v(elem), b.w(elem))
    return C.relative(c, D.LT, ()).select("cfg", "dt", "re", "im")


FILES = f"{REL},\ncs AS (SELECT 'c' || k.range AS cfg, dt, re * (k.range + 1) * (k.range + 1) AS re, im * (k.range + 1) * (k.range + 1) AS im FROM rel, range({CFGS}) k WHERE op_snk = 0 AND op_src = 0)"


@query("sc7_twopoint_from_files", f"{FILES}\nSELECT cfg, dt, CAST(re AS BIGINT) AS re, CAST(im AS BIGINT) AS im FROM cs")
def sc7(spark: SparkSession, sf: str) -> DataFrame:
    """All configurations in one contraction; none meets another."""
    return _from_files(spark, sf)


@query("sc7_ensemble_from_files", f"{FILES}\nSELECT dt, count(*) AS n, avg(CAST(re AS DOUBLE)) AS mean, round(stddev_samp(CAST(re AS DOUBLE)) / sqrt(count(*)), 2) AS error FROM cs GROUP BY dt")
def sc7_ensemble(spark: SparkSession, sf: str) -> DataFrame:
    """Mean and error of the two-point function over the configurations."""
    values = _from_files(spark, sf).select("cfg", "dt", F.col("re").cast("double").alias("value"))
    return C.ensemble(values, "dt").withColumn("error", F.round("error", 2))


#: No displacement and one step each way, by their places in WORDS.
STEPS = 7


@query("sc8_sparse_pairs", f"WITH {U_SQL},\n{D.POINTS_SQL},\n{OL_SQL},\n{LE_SQL},\nall_p AS ({P2P_SQL})\nSELECT 'c' || k.range AS cfg, t, w AS disp, p_l, p_r, c_l, c_r, re, im FROM all_p, range(2) k WHERE w < {STEPS} AND (re <> 0 OR im <> 0)")
def sc8(spark: SparkSession, sf: str) -> DataFrame:
    """Point-to-point elementals of two configurations as npz files of sparse blocks, the undisplaced ones as identities, read back."""
    rows = elementals_p2p(D.points(spark, sf), gauge(spark, sf), WORDS[:STEPS]).withColumnRenamed("w", "disp")
    rows = rows.withColumn("cfg", F.explode(F.array(F.lit("c0"), F.lit("c1"))))
    at = _folder(spark)
    T.write_pairs(rows, at, identities=(0,))
    out = T.read_pairs(spark, f"{at}/c*.pairs.npz", D.NP, D.NC)
    return out.select("cfg", "t", "disp", "p_l", "p_r", "c_l", "c_r", *[F.round(c).cast("long").alias(c) for c in ("re", "im")])
