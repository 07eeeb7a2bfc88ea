"""Reading tensor files as frames, and the catalogue of tensor kinds.

`spark.read.format("tensor")` is a Python data source over files that executors
can open by path: one input partition a file and leading index, filters on index
columns cut what is read. `binary_tensors` reads the same containers through
Spark's own binaryFile reader, for stores that only Spark can open and files
that fit a row.
"""

from __future__ import annotations

import glob
import io
import os
import re
import shutil
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from tensorloom.sources.containers import Block, Layout, blocks


@dataclass(frozen=True)
class Kind:
    """A kind of tensor: its axes in file order, the usual type, and how many leading axes a map file keys by."""

    axes: tuple[str, ...]
    dtype: str = "<c16"
    keys: int = 0


#: The tensor kinds with their axes, in the order of the files.
KINDS: dict[str, Kind] = {
    "gauge": Kind(("t", "z", "y", "x", "mu", "a", "b")),
    "eigenvector": Kind(("t", "e", "z", "y", "x", "c"), keys=2),
    "elemental": Kind(("deriv", "mom", "t", "e_l", "e_r")),
    "displacement_elemental": Kind(("dist", "mom", "t", "e_l", "e_r")),
    "perambulator": Kind(("t_src", "dt", "s_snk", "s_src", "e_snk", "e_src")),
    "perambulator_slice": Kind(("dt", "s_snk", "s_src", "e_snk", "e_src")),
    "psv": Kind(("t_src", "dt", "s_snk", "s_src", "p", "c", "e")),
    "vsp": Kind(("t_src", "dt", "s_snk", "s_src", "e", "p", "c")),
    "psp": Kind(("t_src", "dt", "s_snk", "s_src", "p_snk", "c_snk", "p_src", "c_src")),
    "overlap": Kind(("t", "e", "p", "c")),
    "point_source": Kind(("p", "t", "xyz"), "<i4"),
    "current_v2p": Kind(("t", "disp", "e", "p", "c")),
    "current_p2v": Kind(("t", "disp", "p", "c", "e")),
    "one_point": Kind(("op", "t")),
    "two_point": Kind(("op_src", "op_snk", "t")),
}


def _ints(text: str | None) -> tuple[int, ...] | None:
    return tuple(int(x) for x in text.split(",")) if text else None


class Piece(InputPartition):
    def __init__(self, path: str, cfg: str, block: Block, lead: int | None, fixed: dict[str, tuple[int, ...]]):
        super().__init__((path, lead))
        self.path, self.cfg, self.block, self.lead, self.fixed = path, cfg, block, lead, fixed


class TensorReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.o = options
        self.axes = options["axes"].split(",") if "axes" in options else list(KINDS[options["kind"]].axes)
        self.container = options.get("container", "npy")
        self.ranges: dict[str, set[int] | None] = {}
        self.limits: dict[str, list[tuple[str, int]]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Index filters choose indices before anything is read; the rest stays with Spark."""
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if name in (*self.axes, "cfg") and isinstance(f, (EqualTo, In)):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.ranges[name] = values if self.ranges.get(name) is None else self.ranges[name] & values
            elif name in self.axes and isinstance(f, (GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                self.limits.setdefault(name, []).append((type(f).__name__, f.value))
            else:
                yield f

    def _wanted(self, axis: str, size: int) -> list[int]:
        test = {"GreaterThan": int.__gt__, "GreaterThanOrEqual": int.__ge__, "LessThan": int.__lt__, "LessThanOrEqual": int.__le__}
        out = [i for i in range(size) if self.ranges.get(axis) is None or i in self.ranges[axis]]
        return [i for i in out if all(test[k](i, v) for k, v in self.limits.get(axis, []))]

    def partitions(self) -> list[Piece]:
        """One for each file and leading index. A name with a {cfg} pattern gives the configuration; `.t000.` in it gives a fixed first axis."""
        out = []
        for path in sorted(glob.glob(self.o["path"])):
            cfg = (re.search(self.o["cfg"], os.path.basename(path)) or [""])[-1] if "cfg" in self.o else os.path.basename(path).split(".")[0]
            if self.ranges.get("cfg") is not None and cfg not in self.ranges["cfg"]:
                continue
            slice_ = re.search(r"\.t(\d{3})\.", os.path.basename(path))
            with open(path, "rb") as f:

                def read(at: int, n: int, f=f) -> bytes:
                    f.seek(at)
                    return f.read(n)

                found = blocks(self.container, read, _ints(self.o.get("shape")), self.o.get("dtype"), int(self.o.get("keys", 0)))
            for b in found:
                b.checked(os.path.getsize(path))
                own = [int(slice_[1])] if slice_ and len(b.shape) + len(b.key) < len(self.axes) else []
                fixed = dict(zip(self.axes, [*own, *b.key], strict=False))
                if any(self.ranges.get(a) is not None and v not in self.ranges[a] for a, v in fixed.items()):
                    continue
                if any(v not in self._wanted(a, v + 1) for a, v in fixed.items()):
                    continue
                rest = self.axes[len(fixed) :]
                if len(rest) != len(b.shape):
                    raise ValueError(f"{path} has {len(b.shape)} axes, {rest} are left")
                chosen = {a: tuple(self._wanted(a, n)) for a, n in zip(rest, b.shape, strict=True)}
                for lead in chosen[rest[0]]:
                    out.append(Piece(path, cfg, b, lead, {a: (v,) for a, v in fixed.items()} | chosen))
        return out or [Piece("", "", Block(0, (), "<c16"), None, {})]

    def read(self, p: Piece) -> Iterator[pa.RecordBatch]:
        if not p.path:
            return
        rest = self.axes[len(self.axes) - len(p.block.shape) :]
        x = np.memmap(p.path, p.block.dtype, "r", p.block.offset, p.block.shape)
        picks = [(p.lead,), *[p.fixed[a] for a in rest[1:]]]
        part = np.asarray(x[np.ix_(*picks)])
        at = np.indices(part.shape).reshape(len(rest), -1)
        columns = {a: np.asarray(pick, "i8")[at[i]] for i, (a, pick) in enumerate(zip(rest, picks, strict=True))}
        n = part.size
        flat = part.reshape(-1)
        data = {"cfg": pa.array([p.cfg] * n)} if n else {"cfg": pa.array([], pa.string())}
        data |= {a: pa.array(columns[a] if a in columns else np.full(n, p.fixed[a][0], "i8")) for a in self.axes}
        data |= {"re": pa.array(flat.real.astype("f8")), "im": pa.array(flat.imag.astype("f8"))}
        yield from pa.table(data).to_batches(max_chunksize=1 << 16)


@dataclass
class Written(WriterCommitMessage):
    """Segments that a task has written: (cfg, leading index)."""

    segments: list[tuple[str, tuple[int, ...]]]


class TensorWriter(DataSourceArrowWriter):
    """Dense files, written segment by segment from the executors.

    A segment is all entries of one leading index. Its place in the file follows from
    the layout, so tasks write theirs into one file at once, and a task that runs
    again writes the same bytes. The commit adds what stands before and after the
    data, a few kilobytes a file, and only then gives files their names; what no row
    names is zero. Rows must come dealt and sorted by (cfg, leading index), as
    write_tensor() does; a segment of two tasks is an error.
    """

    def __init__(self, options: dict[str, str]):
        self.o = options
        self.axes = options["axes"].split(",") if "axes" in options else list(KINDS[options["kind"]].axes)
        self.layout = Layout(options.get("container", "npy"), _ints(options["shape"]), options.get("dtype", "<c16"), int(options.get("lead", 1)))
        self.folder, self.suffix = options["path"], options.get("suffix", ".npy")

    def _open(self, cfg: str, lead: tuple[int, ...]) -> str:
        return os.path.join(self.folder, "_writing", self.layout.name(cfg, lead, self.suffix))

    def _put(self, cfg: str, lead: tuple[int, ...], at: list[np.ndarray], values: list[np.ndarray]) -> None:
        shape = self.layout.segment
        x = np.zeros(int(np.prod(shape, dtype=int)), self.layout.dtype)
        flat, number = np.concatenate(at), np.concatenate(values)
        if len(np.unique(flat)) < len(flat):
            raise ValueError(f"two rows for one index of {cfg} {lead}")
        x[flat] = number
        path = self._open(cfg, lead)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        file = os.open(path, os.O_WRONLY | os.O_CREAT)
        try:
            body, place = memoryview(x.tobytes()), self.layout.place(lead)
            while body:
                n = os.pwrite(file, body, place)
                body, place = body[n:], place + n
            os.fsync(file)
        finally:
            os.close(file)

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        lead, shape = self.layout.lead, self.layout.shape
        done: list[tuple[str, tuple[int, ...]]] = []
        key, at, values = None, [], []
        for b in batches:
            if not b.num_rows:
                continue
            index = [b.column(a).to_numpy() for a in self.axes]
            if any((x < 0).any() or (x >= n).any() for x, n in zip(index, shape, strict=True)):
                raise ValueError(f"an index lies outside {shape}")
            cfg = np.array([str(x) for x in b.column("cfg").to_pylist()], object)
            flat = np.zeros(b.num_rows, np.int64)
            for x, n in zip(index[lead:], shape[lead:], strict=True):
                flat = flat * n + x
            number = b.column("re").to_numpy() + 1j * b.column("im").to_numpy()
            new = np.ones(b.num_rows, bool)
            new[1:] = cfg[1:] != cfg[:-1]
            for x in index[:lead]:
                new[1:] |= x[1:] != x[:-1]
            starts = np.flatnonzero(new).tolist()
            for lo, hi in zip(starts, [*starts[1:], b.num_rows], strict=True):
                own = (cfg[lo], tuple(int(x[lo]) for x in index[:lead]))
                if own != key:
                    if key is not None:
                        self._put(*key, at, values)
                        done.append(key)
                    key, at, values = own, [], []
                at.append(flat[lo:hi])
                values.append(number[lo:hi])
        if key is not None:
            self._put(*key, at, values)
            done.append(key)
        return Written(done)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        every = [x for m in messages if m is not None for x in m.segments]
        if len(set(every)) < len(every):
            self.abort(messages)
            raise ValueError("rows of one segment came to two tasks: deal them by (cfg, leading axes)")
        for cfg in sorted({cfg for cfg, _ in every}):
            for name, before, at, after, size in self.layout.frame(cfg, self.suffix, [lead for c, lead in every if c == cfg]):
                path = os.path.join(self.folder, "_writing", name)
                with open(path, "r+b") as f:
                    f.truncate(size)
                    f.write(before)
                    f.seek(at)
                    f.write(after)
                os.replace(path, os.path.join(self.folder, name))
        self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        shutil.rmtree(os.path.join(self.folder, "_writing"), ignore_errors=True)


class TensorSource(DataSource):
    """Options: path (a glob), kind or axes, container (npy, raw, lime, map), shape and dtype where the file does not tell, keys (of a map), cfg (a pattern for the file name)."""

    @classmethod
    def name(cls) -> str:
        return "tensor"

    def schema(self) -> str:
        axes = self.options["axes"].split(",") if "axes" in self.options else KINDS[self.options["kind"]].axes
        return "cfg string, " + ", ".join(f"{a} long" for a in axes) + ", re double, im double"

    def reader(self, schema) -> DataSourceReader:
        return TensorReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        """Options: path (a folder), kind or axes, shape, container (npy, raw, lime, map, slices), dtype, suffix of the file names after cfg, lead (axes of a segment's index)."""
        return TensorWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TensorSource)


def load(spark: SparkSession, path: str, kind: str, container: str = "npy", **options) -> DataFrame:
    """A tensor of a kind as (cfg, axes, re, im)."""
    register(spark)
    k = KINDS[kind]
    reader = spark.read.format("tensor").option("path", path).option("kind", kind).option("container", container)
    more = {"dtype": k.dtype, "keys": k.keys} | options if container in ("raw", "map") else options
    for name, value in more.items():
        reader = reader.option(name, ",".join(map(str, value)) if isinstance(value, (tuple, list)) else str(value))
    return reader.load()


def write_tensor(df: DataFrame, folder: str, kind: str, shape: tuple[int, ...], container: str = "npy", suffix: str = ".npy", dtype: str | None = None, lead: int | None = None) -> None:
    """Rows (cfg, axes, re, im) of a kind as dense files, a file a configuration (container `slices`: a file a leading index), written by the executors.

    folder: one that driver and executors can open by path. A task holds one segment:
    the entries of one index of the `lead` leading axes.
    """
    register(df.sparkSession)
    k = KINDS[kind]
    lead = lead or max(1, k.keys)
    keys = ["cfg", *k.axes[:lead]]
    rows = df.select(F.col("cfg").cast("string").alias("cfg"), *[F.col(a).cast("long").alias(a) for a in k.axes], F.col("re").cast("double").alias("re"), F.col("im").cast("double").alias("im"))
    out = rows.repartition(*keys).sortWithinPartitions(*keys).write.format("tensor").mode("append").option("path", folder).option("kind", kind).option("container", container)
    out.option("shape", ",".join(map(str, shape))).option("dtype", dtype or k.dtype).option("suffix", suffix).option("lead", str(lead)).save()


def binary_tensors(spark: SparkSession, path: str, axes: tuple[str, ...], container: str = "npy", shape=None, dtype: str | None = None, keys: int = 0) -> DataFrame:
    """The same through Spark's binaryFile reader; the file name up to the first dot is cfg."""
    schema = "cfg string, " + ", ".join(f"{a} long" for a in axes) + ", re double, im double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, body in zip(b["path"], b["content"], strict=True):
                view = io.BytesIO(body)

                def read(at: int, n: int, view=view) -> bytes:
                    view.seek(at)
                    return view.read(n)

                for block in blocks(container, read, shape, dtype, keys):
                    x = np.frombuffer(body, block.dtype, int(np.prod(block.shape)), block.checked(len(body)).offset)
                    at = np.indices(block.shape).reshape(len(block.shape), -1)
                    fixed = [np.full(x.size, k) for k in block.key]
                    columns = dict(zip(axes, [*fixed, *at], strict=True))
                    yield pd.DataFrame({"cfg": os.path.basename(name).split(".")[0], **columns, "re": x.real.astype("f8"), "im": x.imag.astype("f8")})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)


def sparse_pairs(spark: SparkSession, path: str, momenta: int = 1) -> DataFrame:
    """npz files of 3 x 3 blocks between points (identity or sparse), one entry a displacement, repeated for each momentum: (cfg, disp, mom, kind, p_l, p_r, c_l, c_r, re, im); identities are one row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, body in zip(b["path"], b["content"], strict=True):
                z = np.load(io.BytesIO(body), allow_pickle=False)
                cfg, out = os.path.basename(name).split(".")[0], []
                for d in range(sum(k.startswith("type_") for k in z.files)):
                    if str(z[f"type_{d}"]) == "identity":
                        out.append((cfg, d, "identity", None, None, None, None, 1.0, 0.0))
                        continue
                    for (l, r), v in zip(z[f"indices_{d}"], z[f"values_{d}"], strict=True):
                        out += [(cfg, d, "sparse", int(l), int(r), i, j, float(v[i, j].real), float(v[i, j].imag)) for i, j in product(range(v.shape[0]), range(v.shape[1]))]
                frame = pd.DataFrame(out, columns=["cfg", "disp", "kind", "p_l", "p_r", "c_l", "c_r", "re", "im"])
                yield frame.astype({c: "Int64" for c in ("p_l", "p_r", "c_l", "c_r")})

    base = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "cfg string, disp long, kind string, p_l long, p_r long, c_l long, c_r long, re double, im double")
    return base.crossJoin(spark.range(momenta).withColumnRenamed("id", "mom"))


def write_pairs(df: DataFrame, folder: str, suffix: str = ".pairs.npz", identities: tuple[int, ...] = ()) -> int:
    """Rows (cfg, t, disp, p_l, p_r, c_l, c_r, re, im) as npz files of blocks between points, a file a configuration and time, written by the executors.

    folder: one that driver and executors can open by path. Displacements named in
    identities are stored by that name. A task holds one file's pairs. Returns the number of files.
    """

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, np.ndarray | str] = {}
        colours = int(max(rows["c_l"].max(), rows["c_r"].max())) + 1
        for d in range(int(rows["disp"].max()) + 1):
            own = rows[rows["disp"] == d]
            if d in identities:
                out[f"type_{d}"] = "identity"
                continue
            pairs, at = np.unique(own[["p_l", "p_r"]].to_numpy("int64").reshape(-1, 2), axis=0, return_inverse=True)
            values = np.zeros((len(pairs), colours, colours), complex)
            values[at.reshape(-1), own["c_l"].to_numpy(int), own["c_r"].to_numpy(int)] = own["re"].to_numpy(float) + 1j * own["im"].to_numpy(float)
            out |= {f"type_{d}": "sparse", f"indices_{d}": pairs, f"values_{d}": values}
        name = f"{key[0]}.t{int(key[1]):03d}{suffix}"
        path = os.path.join(folder, f".{uuid.uuid4().hex}{name}")
        np.savez(path, **out)
        os.replace(path, os.path.join(folder, name))
        return pd.DataFrame({"file": [name]})

    return df.groupBy("cfg", "t").applyInPandas(run, "file string").distinct().count()


def read_pairs(spark: SparkSession, path: str, points: int, colours: int) -> DataFrame:
    """npz files of write_pairs() as (cfg, t, disp, p_l, p_r, c_l, c_r, re, im): identities written out over all points and colours, zeros left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, body in zip(b["path"], b["content"], strict=True):
                z = np.load(io.BytesIO(body), allow_pickle=False)
                cfg, t = re.match(r"(.*)\.t(\d{3})\.", os.path.basename(name)).groups()
                for d in range(sum(k.startswith("type_") for k in z.files)):
                    if str(z[f"type_{d}"]) == "identity":
                        left, value = np.repeat(np.arange(points), colours), np.ones(points * colours, complex)
                        own = {"p_l": left, "p_r": left, "c_l": np.tile(np.arange(colours), points), "c_r": np.tile(np.arange(colours), points)}
                    else:
                        k, i, j = np.nonzero(z[f"values_{d}"])
                        value, pairs = z[f"values_{d}"][k, i, j], z[f"indices_{d}"].reshape(-1, 2)
                        own = {"p_l": pairs[k, 0], "p_r": pairs[k, 1], "c_l": i, "c_r": j}
                    yield pd.DataFrame({"cfg": cfg, "t": int(t), "disp": d, **own, "re": value.real, "im": value.imag})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "cfg string, t long, disp long, p_l long, p_r long, c_l long, c_r long, re double, im double")


def strided(path: str, offset: int, shape: tuple[int, ...], dtype: str, key: tuple) -> np.ndarray:
    """A slice of a raw file by seek and read, without mapping it: ints, slices with steps, lists of indices. What is contiguous is read at once."""
    full = [k if not isinstance(k, int) else [k] for k in key] + [slice(None)] * (len(shape) - len(key))
    picks = [list(range(*k.indices(n))) if isinstance(k, slice) else [i % n for i in k] for k, n in zip(full, shape, strict=True)]
    tail = len(shape)
    while tail and picks[tail - 1] == list(range(shape[tail - 1])):
        tail -= 1
    size, run = np.dtype(dtype).itemsize, int(np.prod(shape[tail:], dtype=int))
    strides = [int(np.prod(shape[i + 1 :], dtype=int)) for i in range(len(shape))]
    out = np.empty((int(np.prod([len(p) for p in picks[:tail]], dtype=int)), run), dtype)
    with open(path, "rb") as f:
        for row, index in enumerate(product(*picks[:tail])):
            f.seek(offset + size * sum(i * s for i, s in zip(index, strides, strict=False)))
            out[row] = np.frombuffer(f.read(run * size), dtype)
    out = out.reshape([len(p) for p in picks])
    return out[tuple(0 if isinstance(k, int) else slice(None) for k in key)]


def save(df: DataFrame, path: str, mode: str = "append") -> None:
    """The catalogue's own format: Parquet by configuration, sorted by the first axes so that filters skip row groups."""
    axes = [c for c in df.columns if c not in ("cfg", "re", "im")]
    df.repartition("cfg").sortWithinPartitions("cfg", *axes).write.mode(mode).partitionBy("cfg").parquet(path)

