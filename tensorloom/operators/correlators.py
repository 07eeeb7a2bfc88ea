"""Correlators as contractions over named axes.

tau(s, t, j, i, b, a) is a propagator from time s to time t (absolute times),
bw its backward partner, V(op, t, j, k, b, c) an operator's vertex and
W(op, s, l, i, d, a) a source's daggered vertex. There is no loop over source
times or operators: both are labels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tensorloom.plans.einsum import Tensor, contract, contract_blocks, evaluate, pair
from tensorloom.sources.derived import backward

BW = ("s", "t", "i", "j", "a", "b")
TAU = ("s", "t", "k", "l", "c", "d")
SINK = ("op_snk", "t", "j", "k", "b", "c")
SOURCE = ("op_src", "s", "l", "i", "d", "a")


def operator_elementals(terms: DataFrame, phi: Tensor) -> Tensor:
    """Per operator and spin matrix the weighted sum of elementals: (op, gamma, t, b, c), after cfg where phi has it."""
    t = terms.select("op", "gamma", "coeff", F.col("deriv").alias("d2"), F.col("mom").alias("m2"))
    rows = phi.frame.join(t, (F.col("deriv") == F.col("d2")) & (F.col("mom") == F.col("m2")))
    axes = (*phi.batch, "op", "gamma", "t", "b", "c")
    frame = rows.groupBy(*axes).agg(F.sum(F.col("coeff") * F.col("re")).alias("re"), F.sum(F.col("coeff") * F.col("im")).alias("im"))
    return Tensor(frame, axes, {**phi.sizes, "op": 4, "gamma": 16}, rows=8.0 * phi.sizes["t"] * phi.sizes["b"] * phi.sizes["c"])


def vertex(elem: Tensor, gammas: Tensor) -> Tensor:
    """(op, t, j, k, b, c) = sum over an operator's matrices of gamma[j, k] * elemental[b, c]."""
    g = gammas.renamed("gamma", "j", "k")
    return pair(elem, g, {"op", "t", "j", "k", "b", "c"}).ordered(*elem.batch, "op", "t", "j", "k", "b", "c")


def source_vertex(elem: Tensor, source_gammas: Tensor) -> Tensor:
    """The daggered vertex at a source: (op, s, l, i, d, a), elementals conjugated and turned round."""
    g = source_gammas.renamed("gamma", "l", "i")
    turned = elem.conj().relabelled(t="s", b="a", c="d")
    return pair(turned, g, {"op", "s", "l", "i", "d", "a"}).ordered(*elem.batch, "op", "s", "l", "i", "d", "a")


def twopoint_terms(tau: Tensor, v: Tensor, w: Tensor) -> list[Tensor]:
    return [backward(tau), v.relabelled(op="op_snk"), tau.relabelled(j="k", i="l", b="c", a="d"), w.relabelled(op="op_src")]


def twopoint(tau: Tensor, v: Tensor, w: Tensor, out: tuple[str, ...] = ("op_snk", "op_src"), blocks: bool | None = None) -> Tensor:
    """-tr(bw V tau W) for every pair of times: labels out + (s, t), and cfg where tau has it.

    blocks: dense blocks a pair of times, or joins; None: blocks where they fit a task.
    """
    labels = (*out, "s", "t")
    terms = twopoint_terms(tau, v, w)
    if blocks is None:
        return evaluate(terms, labels, ("s", "t")).scaled(-1)
    return (contract_blocks(terms, labels, ("s", "t")) if blocks else contract(terms, labels)).scaled(-1)


def relative(c: Tensor, lt: int, keep: tuple[str, ...]) -> DataFrame:
    """Sum over sources at fixed dt = (t - s) mod lt, configuration by configuration."""
    frame = c.frame.withColumn("dt", F.pmod(F.col("t") - F.col("s"), F.lit(lt)))
    return frame.groupBy(*c.batch, *keep, "dt").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))


def source_average(c: Tensor, lt: int, keep: tuple[str, ...]) -> DataFrame:
    """Mean over sources at fixed dt; sources without entries count as zero."""
    out = relative(c, lt, keep)
    return out.withColumn("re", F.col("re") / lt).withColumn("im", F.col("im") / lt)


def loops(tau: Tensor, v: Tensor) -> Tensor:
    """tr(tau(t, t) V(t)) per operator: (op, t)."""
    same = Tensor(tau.frame.where("s = t").drop("s"), tuple(a for a in tau.axes if a != "s"), tau.sizes)
    return contract([same.relabelled(j="k", i="j", b="c", a="b"), v], ("op", "t"))


def isoscalar(connected: DataFrame, sink_loop: Tensor, source_loop: Tensor, lt: int, flavours: int) -> DataFrame:
    """(op_snk, op_src, dt): connected + flavours * sum over s of loop(t) conj loop(s)."""
    a = sink_loop.relabelled(op="op_snk")
    b = source_loop.relabelled(op="op_src", t="s").conj()
    keys = (*a.batch, "op_snk", "op_src", "dt")
    loops_ = relative(pair(a, b, {"op_snk", "op_src", "s", "t"}), lt, ("op_snk", "op_src"))
    both = connected.select(*keys, "re", "im").unionByName(loops_.select(*keys, (F.col("re") * flavours).alias("re"), (F.col("im") * flavours).alias("im")))
    return both.groupBy(*keys).agg(F.sum("re").alias("re"), F.sum("im").alias("im"))


def effective_mass(c: DataFrame, lt: int, key: str = "op") -> DataFrame:
    """arccosh((C(t + 1) + C(t - 1)) / 2 C(t)), periodic in dt; null where it is not defined."""

    def at(step: int, name: str) -> DataFrame:
        return c.select(F.col(key).alias(f"{name}_k"), F.pmod(F.col("dt") - step, F.lit(lt)).alias(f"{name}_t"), F.col("re").cast("double").alias(name))

    up, down = at(1, "up"), at(-1, "down")
    both = c.join(up, (F.col(key) == F.col("up_k")) & (F.col("dt") == F.col("up_t"))).join(down, (F.col(key) == F.col("down_k")) & (F.col("dt") == F.col("down_t")))
    x = (F.col("up") + F.col("down")) / (2 * F.col("re").cast("double"))
    return both.select(key, "dt", F.when((F.col("re") != 0) & (x >= 1), F.acosh(x)).alias("mass"))


def open_ratio(c: DataFrame, key: str = "op") -> DataFrame:
    """log(C(t) / C(t + 1)) along an open time axis, by a window; null at the end and where it is not defined."""
    nxt = F.lead(F.col("re").cast("double")).over(Window.partitionBy(key).orderBy("dt"))
    x = F.col("re").cast("double") / nxt
    return c.select(key, "dt", F.when((nxt != 0) & (x > 0), F.ln(x)).alias("mass"))


def ensemble(values: DataFrame, key: str, by: str = "cfg") -> DataFrame:
    """(key, n, mean, error) over configurations: error = sample deviation / sqrt(n), null for one."""
    n = F.count(F.lit(1))
    return values.groupBy(key).agg(n.cast("long").alias("n"), F.avg("value").alias("mean"), (F.stddev_samp("value") / F.sqrt(n)).alias("error"))


def ensemble_covariance(values: DataFrame, key: str, by: str = "cfg") -> DataFrame:
    """(key, other, cov): sample covariance over configurations of each pair of keys."""
    other = values.select(F.col(by).alias("by2"), F.col(key).alias("other"), F.col("value").alias("value2"))
    both = values.join(other, F.col(by) == F.col("by2"))
    return both.groupBy(key, "other").agg(F.covar_samp("value", "value2").alias("cov"))


def overlap(v: Tensor, pts: DataFrame, lx: int, ly: int, nc: int) -> Tensor:
    """M(t, e, p, c): eigenvectors at the points, one look-up join on coordinates."""
    x = F.col("x")
    at = v.frame.select(*v.batch, "t", "e", (x % nc).alias("c"), (F.floor(x / nc) % lx).cast("long").alias("vx"), (F.floor(x / (nc * lx)) % ly).cast("long").alias("vy"), F.floor(x / (nc * lx * ly)).cast("long").alias("vz"), "re", "im")
    p = pts.select(F.col("t").alias("pt"), "p", F.col("x").alias("px"), F.col("y").alias("py"), F.col("z").alias("pz"))
    frame = at.join(p, (F.col("t") == F.col("pt")) & (F.col("vx") == F.col("px")) & (F.col("vy") == F.col("py")) & (F.col("vz") == F.col("pz")))
    axes = (*v.batch, "t", "e", "p", "c")
    return Tensor(frame.select(*axes, "re", "im"), axes, {"t": v.sizes["t"], "e": v.sizes["e"], "p": 12, "c": nc})
