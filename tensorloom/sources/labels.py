"""From the axes of files to the labels of operators, and back.

A file counts times from its source (t_src, dt); operators use two absolute
times, s and t. Ends are called after what they hold: spins j, i and modes b, a,
points and colours p, c and q, d, the sink's first. `cfg` comes first and is a
batch label: no contraction sums over it. Zeros are left out.
"""

from __future__ import annotations

import atexit
import os
import shutil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorloom.plans.einsum import CFG, Tensor
from tensorloom.sources.tensors import KINDS, load

#: Operator labels of the file axes that are not called the same.
LABELS: dict[str, dict[str, str]] = {
    "eigenvector": {},
    "elemental": {"e_l": "b", "e_r": "c"},
    "displacement_elemental": {"e_l": "b", "e_r": "c"},
    "perambulator": {"s_snk": "j", "s_src": "i", "e_snk": "b", "e_src": "a"},
    "psv": {"s_snk": "j", "s_src": "i", "e": "a"},
    "vsp": {"s_snk": "j", "s_src": "i", "e": "b"},
    "psp": {"s_snk": "j", "s_src": "i", "p_snk": "p", "c_snk": "c", "p_src": "q", "c_src": "d"},
    "overlap": {},
    "gauge": {},
    "current_v2p": {},
    "current_p2v": {},
    "two_point": {},
    "one_point": {},
}


def labelled(df: DataFrame, kind: str, sizes: dict[str, int]) -> Tensor:
    """df (cfg, file axes, re, im) of a kind as (cfg, operator labels). sizes: extents by file axis, `t` for both times.

    A coordinate field of eigenvectors becomes one index x: colour first, then x, y, z.
    """
    names = LABELS[kind]
    axes, columns = [CFG], [F.col(CFG)]
    file_axes = KINDS[kind].axes
    extents = {names.get(k, k): v for k, v in sizes.items() if k in (*file_axes, "t")}
    if "t_src" in file_axes:
        axes += ["s", "t"]
        columns += [F.col("t_src").alias("s"), F.pmod(F.col("t_src") + F.col("dt"), F.lit(sizes["t"])).alias("t")]
        extents["s"] = extents["t"]
        file_axes = [a for a in file_axes if a not in ("t_src", "dt")]
    if kind == "eigenvector":
        axes += ["t", "e", "x"]
        nc, lx, ly = sizes["c"], sizes["x"], sizes["y"]
        columns += [F.col("t"), F.col("e"), (F.col("c") + nc * (F.col("x") + lx * (F.col("y") + ly * F.col("z")))).alias("x")]
        extents = {"t": sizes["t"], "e": sizes["e"], "x": nc * lx * ly * sizes["z"]}
    else:
        axes += [names.get(a, a) for a in file_axes]
        columns += [F.col(a).alias(names.get(a, a)) for a in file_axes]
    frame = df.where((F.col("re") != 0) | (F.col("im") != 0)).select(*columns, "re", "im")
    return Tensor(frame, tuple(axes), extents)


def read_labelled(spark: SparkSession, path: str, kind: str, sizes: dict[str, int], container: str = "npy", **options) -> Tensor:
    """Files of a kind, one configuration each, as a tensor that operators take."""
    return labelled(load(spark, path, kind, container, **options), kind, sizes)


def whole(t: Tensor) -> Tensor:
    """Entries as whole numbers; for tensors that hold such."""
    parts = [F.round(c).cast("long").alias(c) for c in ("re", "im")]
    return Tensor(t.frame.select(*t.axes, *parts), t.axes, t.sizes, t.rows, t.literal)


def file_rows(t: Tensor, kind: str, sizes: dict[str, int]) -> DataFrame:
    """A tensor with operator labels as rows (cfg if it has it, file axes, re, im): labelled() the other way round. sizes as there."""
    names = {v: k for k, v in LABELS[kind].items()}
    file_axes = KINDS[kind].axes
    columns = {names.get(a, a): F.col(a) for a in t.axes}
    if "t_src" in file_axes:
        columns |= {"t_src": F.col("s"), "dt": F.pmod(F.col("t") - F.col("s"), F.lit(sizes["t"]))}
    if kind == "eigenvector":
        x, left = F.col("x"), 1
        for a in ("c", "x", "y", "z"):
            columns[a] = (F.floor(x / left) % sizes[a]).cast("long")
            left *= sizes[a]
    return t.frame.select(*t.batch, *[columns[a].alias(a) for a in file_axes], "re", "im")


def file_shape(kind: str, sizes: dict[str, int]) -> tuple[int, ...]:
    """Extents of a kind's file axes; times by `t`."""
    return tuple(sizes.get(a, sizes["t"]) if a in ("t_src", "dt") else sizes[a] for a in KINDS[kind].axes)


def fixture_folder(spark: SparkSession, name: str) -> str:
    """A folder that driver and executors can open by path: in spark.checkpoint.dir, or a local one for local masters."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or ""
    if root.startswith("file:"):
        root = "/" + root[5:].lstrip("/")
    if not root:
        import tempfile

        if not (spark.sparkContext.master or "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        root = tempfile.gettempdir()
    folder = os.path.join(root, f"tensorloom-files-{spark.sparkContext.applicationId}", name)
    os.makedirs(folder, exist_ok=True)
    atexit.register(shutil.rmtree, os.path.dirname(folder), True)
    return folder
