"""Best-fit packing by a configuration linear program.

Only the histogram of piece lengths (fewer than seq_len numbers) comes to the
driver. There the program "as few sequences as cover the histogram" is solved by
multiplicative weights. A length's price is its weight a piece; a bounded
knapsack dynamic program prices the best configuration (a multiset of lengths
that fits a sequence) about every length; those close to the best of all are
used, each for a step that covers no length by more than a fixed share of its
pieces; weights then fall exponentially with what is covered. Prices over the
best configuration's value are feasible for the dual, so every round also gives
a lower bound of the number of sequences.

The fractional solution is rounded to whole copies, and the program is solved
again for the pieces that this leaves, until none are left. Where that stays
further than TOLERANCE from the bound, the program is solved to a stated gap: as a
game of weights of lengths against shares of the configurations found so far, both
updated multiplicatively (`played`), the averages being a solution and its dual,
with new configurations priced by the dynamic program until the two meet. The plan
with the fewest sequences counts; only if packing what some round leaves by best
fit needs fewer, that rest is packed so.
The plan says for every length which ranks go where; its size depends on
seq_len, not on the corpus. Executors rank the pieces of a length and look up
their places. Full pieces are sequences of their own and need neither.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tensorloom.llm.staging import ship_code, stage
from tensorloom.llm.token_output import SEQ_LEN, token_pieces
from tensorloom.llm.tokens import vocabulary

#: Pieces that one task ranks, about; lengths are dealt into so many salts that none has more.
RANKED = 250_000
Config = tuple[tuple[int, int], ...]


@dataclass(frozen=True)
class Effort:
    """rounds: at most, of the weights. step: the share of a length's pieces that a round covers. rate: how fast weights
    fall. slack: how far from the best a configuration may be. least: a round that covers less of the volume is the last."""

    rounds: int = 40
    step: float = 0.34
    rate: float = 1.0
    slack: float = 0.01
    least: float = 0.03


#: Where the first effort stays further from the bound than TOLERANCE, the program is solved to GAP for up to LENGTHS
#: lengths and PLAYS products of weights with entries of configurations; with more lengths the finer effort is tried, for at
#: most WORK layers of the dynamic program. PHASES: how often a rest is solved again. All of them bound the driver's time only.
COARSE, FINE = Effort(), Effort(rounds=120, step=0.02, rate=16.0, least=0.001)
TOLERANCE, WORK = 0.001, 400_000
GAP, LENGTHS, PLAYS = 0.004, 400, 1.5e10
PHASES = 64


class Knapsack:
    """The best configurations under prices; no length is used more often than it has pieces.

    lengths rise. A layer is `times` pieces of one length (binary parts, a single
    piece last), so value[i] is that of the best configuration whose longest piece
    is length i, and best that of the best of all.
    """

    def __init__(self, lengths: np.ndarray, counts: np.ndarray, prices: np.ndarray, capacity: int):
        self.lengths, self.prices, self.capacity = lengths.tolist(), prices.tolist(), capacity
        self.of: list[int] = []
        self.times: list[int] = []
        self.single: list[int] = []
        for i, n in enumerate(np.minimum(counts, capacity // lengths).tolist()):
            part, n = 1, n - 1
            while n > 0:
                self.of.append(i)
                self.times.append(min(part, n))
                n -= part
                part *= 2
            self.single.append(len(self.of))
            self.of.append(i)
            self.times.append(1)
        best = np.zeros(capacity + 1)
        take = np.zeros((len(self.of), capacity + 1), bool)
        self.value = np.zeros(len(lengths))
        for layer, (i, k) in enumerate(zip(self.of, self.times, strict=True)):
            w, v = self.lengths[i] * k, self.prices[i] * k
            if layer == self.single[i]:
                self.value[i] = v + best[capacity - w]
            used = best[: capacity + 1 - w] + v
            np.greater_equal(used, best[w:], out=take[layer, w:])
            np.maximum(used, best[w:], out=best[w:])
        self.best = float(best[capacity])
        self.take = np.ascontiguousarray(take.T)

    def about(self, head: int, open_: list[float], floor: list[float]) -> tuple[dict[int, int], float]:
        """The configuration with `head` as its longest piece, and its value; lengths with less than `floor` open are passed over."""
        config, value = {head: 1}, self.prices[head]
        room, top = self.capacity - self.lengths[head], self.single[head]
        while top > 0:
            row = self.take[room, :top][::-1]
            at = int(row.argmax())
            if not row[at]:
                break
            top -= at + 1
            i, k = self.of[top], self.times[top]
            if open_[i] > floor[i]:
                config[i] = config.get(i, 0) + k
                room -= self.lengths[i] * k
                value += self.prices[i] * k
        return config, value


def fractional(counts: dict[int, int], capacity: int, effort: Effort = COARSE) -> tuple[dict[Config, float], float, int]:
    """Configurations and how often each is used (no length more often than it has pieces), a lower bound of the sequences, and layers worked."""
    lengths = np.array(sorted(counts), np.int64)
    need = np.array([counts[x] for x in lengths.tolist()], np.int64)
    used = np.zeros(len(lengths))
    out: dict[Config, float] = {}
    bound, work, volume = 0.0, 0, float(lengths @ need)
    for _ in range(effort.rounds):
        covered = used / need
        live = np.flatnonzero(covered < 1 - 1e-9)
        if not len(live):
            break
        prices = lengths[live] * np.exp(-effort.rate * (covered[live] - covered[live].min()))
        sack = Knapsack(lengths[live], need[live], prices, capacity)
        work += len(sack.of)
        bound = max(bound, float(prices @ need[live]) / sack.best)
        near = (1 - effort.slack) * sack.best
        heads = np.lexsort((-lengths[live], -np.round(sack.value / sack.best, 6)))
        open_ = np.minimum(effort.step * need, need - used)[live].tolist()
        floor = [x / 4 for x in open_]
        before = float(lengths @ used)
        for head in heads[sack.value[heads] >= near].tolist():
            while open_[head] > floor[head]:
                config, value = sack.about(head, open_, floor)
                if value < near:
                    break
                x = min(open_[i] / k for i, k in config.items())
                for i, k in config.items():
                    open_[i] -= x * k
                    used[live[i]] += x * k
                key = tuple(sorted(((sack.lengths[i], k) for i, k in config.items()), reverse=True))
                out[key] = out.get(key, 0.0) + x
        if float(lengths @ used) - before < effort.least * volume:
            break
    return out, bound, work


def played(cover: np.ndarray, weights: np.ndarray, shares: np.ndarray, gap: float, most: int, rate: float = 0.2) -> tuple[np.ndarray, np.ndarray, float, float, int]:
    """The game of lengths against configurations: cover[i, c] is the share of length i's pieces that a copy of c takes.

    Weights fall with what is covered, shares of configurations rise with the
    weights they take, each step foreseeing the next by the last change. Returns the
    average weights and shares, the number of copies that cover everything, the
    least number by the weights (over these configurations), and steps. weights and
    shares come and go as logarithms.
    """
    def normal(x: np.ndarray) -> np.ndarray:
        x = np.exp(x)
        return x / x.sum()

    w, p = normal(weights), normal(shares)
    last_w, last_p = cover @ p, w @ cover
    sum_w, sum_p = np.zeros_like(w), np.zeros_like(p)
    for step in range(1, most + 1):
        now_w, now_p = cover @ p, w @ cover
        by = rate / max(float(now_p.max()), 1e-300)
        weights -= by * (2 * now_w - last_w)
        shares += by * (2 * now_p - last_p)
        weights -= weights.max()
        np.maximum(shares - shares.max(), -40, out=shares)
        last_w, last_p = now_w, now_p
        w, p = normal(weights), normal(shares)
        sum_w += step * w
        sum_p += step * p
        if step % 200 == 0 or step == most:
            mean_w, mean_p = sum_w / sum_w.sum(), sum_p / sum_p.sum()
            copies, least = 1 / float((cover @ mean_p).min()), 1 / float((mean_w @ cover).max())
            if copies <= least * (1 + gap):
                break
    return mean_w, mean_p, copies, least, step


def converged(counts: dict[int, int], capacity: int, gap: float = GAP, plays: float = PLAYS) -> tuple[dict[Config, float], float]:
    """Configurations and how often each is used, to within gap of the returned lower bound, unless plays runs out first."""
    lengths = np.array(sorted(counts), np.int64)
    need = np.array([counts[x] for x in lengths.tolist()], np.int64)
    pool: dict[tuple[tuple[int, int], ...], float] = {((i, int(min(capacity // x, n))),): 0.0 for i, (x, n) in enumerate(zip(lengths.tolist(), need.tolist(), strict=True))}
    w = lengths * need / (lengths @ need)
    weights, bound, best, found = np.log(w), 0.0, np.inf, {}
    free = [np.inf] * len(lengths), [0.0] * len(lengths)
    while plays > 0:
        sack = Knapsack(lengths, need, w / need, capacity)
        bound = max(bound, 1 / sack.best)
        if best <= bound * (1 + gap):
            break
        usual, before = float(np.mean(list(pool.values()))), len(pool)
        for head in np.flatnonzero(sack.value >= 0.9 * sack.best).tolist():
            pool.setdefault(tuple(sorted(sack.about(head, *free)[0].items())), usual)
        cover = np.zeros((len(lengths), len(pool)))
        for c, config in enumerate(pool):
            for i, k in config:
                cover[i, c] = k / need[i]
        most = max(200, min(4000 if len(pool) > before else 40_000, int(plays / cover.size)))
        w, p, copies, _, steps = played(cover, weights, np.array(list(pool.values())), gap / 4, most)
        plays -= steps * cover.size
        if copies < best:
            best, found = copies, {config: copies * float(x) for config, x in zip(pool, p, strict=True)}
        pool = {config: float(np.log(max(x, 1e-9))) for config, x in zip(pool, p, strict=True) if x > 1e-6 or len(config) == 1}
    return {tuple((int(lengths[i]), k) for i, k in reversed(config)): x for config, x in found.items()}, bound


def settled(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, Config]], list[tuple[int, Config]], float]:
    """As programmed(), from the converged program: whole copies, then what they leave by the coarse effort."""
    shares, bound = converged(counts, capacity)
    copies, left = rounded(shares, counts)
    more, rest, _ = programmed(left, capacity, COARSE) if left else ([], [], 0.0)
    return copies + more, rest, bound


def rounded(shares: dict[Config, float], counts: dict[int, int]) -> tuple[list[tuple[int, Config]], dict[int, int]]:
    """Whole copies: every share rounded down, then single copies of what the fractions add up to, as far as the pieces allow. And the rest of the histogram."""
    left, out, more = dict(counts), [], 0.0
    order = sorted(shares, key=lambda c: (-shares[c], -sum(x * k for x, k in c), c))
    for whole in (True, False):
        for config in order:
            if whole:
                n = int(shares[config] + 1e-9)
                more += shares[config] - n
                n = min(n, *(left[x] // k for x, k in config))
            else:
                n = int(more > 0 and all(left[x] >= k for x, k in config))
                more -= n
            if n:
                out.append((n, config))
                for x, k in config:
                    left[x] -= n * k
    return out, {x: n for x, n in left.items() if n}


def programmed(counts: dict[int, int], capacity: int, effort: Effort, work: int = 1 << 62) -> tuple[list[tuple[int, Config]], list[tuple[int, Config]], float]:
    """Copies of rounded configurations, the rest by best fit (nothing, unless that saves sequences or nothing fits any more), the bound."""
    left, copies, bound = dict(counts), [], 0.0
    least, at, total = None, 0, 0
    for phase in range(PHASES + 1):
        rest = sum(n for n, _ in best_fit_classes(left, capacity))
        if least is None or total + rest <= least:
            least, at = total + rest, len(copies)
        if not left or phase == PHASES or work < 0:
            break
        shares, low, done = fractional(left, capacity, effort)
        work -= done
        bound = bound or low
        got, after = rounded(shares, left)
        if not got:
            break
        left = after
        copies += got
        total += sum(n for n, _ in got)
    copies = copies[:at]
    left = dict(counts)
    for n, config in copies:
        for x, k in config:
            left[x] -= n * k
    return copies, best_fit_classes({x: n for x, n in left.items() if n}, capacity), bound


def best_fit_classes(counts: dict[int, int], capacity: int) -> list[tuple[int, Config]]:
    """Best-fit decreasing over classes: equal sequences are one entry with a count."""
    rooms: list[int] = []
    groups: dict[int, list[tuple[int, list[int]]]] = {}

    def put(room: int, n: int, held: list[int]) -> None:
        if room not in groups:
            bisect.insort(rooms, room)
            groups[room] = []
        groups[room].append((n, held))

    for x in sorted(counts, reverse=True):
        todo = counts[x]
        while todo:
            i = bisect.bisect_left(rooms, x)
            if i == len(rooms):
                each = capacity // x
                full, some = divmod(todo, each)
                if full:
                    put(capacity - each * x, full, [x] * each)
                if some:
                    put(capacity - some * x, 1, [x] * some)
                break
            room = rooms[i]
            n, held = groups[room].pop()
            if not groups[room]:
                del groups[room], rooms[i]
            each = min(room // x, -(-todo // n))
            some = min(n, todo // each)
            if some < n:
                put(room, n - some, held)
            put(room - each * x, some, held + [x] * each)
            todo -= some * each
    out = []
    for room in groups:
        for n, held in groups[room]:
            out.append((n, tuple(sorted(((x, held.count(x)) for x in set(held)), reverse=True))))
    return sorted(out, key=lambda g: g[1], reverse=True)


@dataclass(frozen=True)
class Plan:
    """table: rows (key, times, sequence, offset): from rank key % 2**40 on, pieces of length key // 2**40 lie `times` a
    sequence from `sequence` and `offset` on. The first `by_program` of the `sequences` are rounded configurations; fewer
    than `bound` sequences are impossible."""

    table: pd.DataFrame
    sequences: int
    by_program: int
    bound: int


def plan(counts: dict[int, int], capacity: int) -> Plan:
    """The places of all pieces of a histogram; no pieces give no places."""
    copies, rest, bound = programmed(counts, capacity, COARSE)

    def size(x: list[tuple[int, Config]]) -> int:
        return sum(n for n, _ in x)

    if size(copies) + size(rest) > (1 + TOLERANCE) * max(1, int(np.ceil(bound - 1e-6))):
        again = settled(counts, capacity) if len(counts) <= LENGTHS else programmed(counts, capacity, FINE, WORK)
        bound = max(bound, again[2])
        if size(again[0]) + size(again[1]) < size(copies) + size(rest):
            copies, rest = again[:2]
    rank: dict[int, int] = {}
    rows, sequence = [], 0
    for n, config in copies + rest:
        offset = 0
        for x, k in config:
            rows.append((x << 40 | rank.get(x, 0), k, sequence, offset))
            rank[x] = rank.get(x, 0) + n * k
            offset += x * k
        sequence += n
    table = pd.DataFrame(rows, columns=["key", "times", "sequence", "offset"]).astype("int64").sort_values("key", ignore_index=True)
    return Plan(table, sequence, size(copies), int(np.ceil(bound - 1e-6)))


def _pieces(path: str, seq_len: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list = []

        def frame() -> pd.DataFrame:
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            return out.astype({"doc_id": "Int64"})

        for doc, piece, start, ids in token_pieces(batches, path, seq_len):
            rows.append((doc, piece, start, len(ids), zlib.crc32(ids.tobytes())))
            if len(rows) == 20_000:
                yield frame()
                rows = []
        yield frame()

    return run


def _places(table, by_program: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = table.value
        keys, times, sequence, offset = (p[c].to_numpy() for c in ("key", "times", "sequence", "offset"))
        for b in batches:
            length = b["length"].to_numpy("int64")
            key = length << 40 | b.pop("rank").to_numpy("int64")
            i = np.searchsorted(keys, key, side="right") - 1
            copy, nth = np.divmod(key - keys[i], times[i])
            own = sequence[i] + copy
            yield b.assign(doc_id=b["doc_id"].astype("Int64"), sequence_id=own, offset=offset[i] + nth * length, by_program=own < by_program)

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, seq_len: int = SEQ_LEN) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, by_program, least_sequences.

    A document is its ids and the end id 1; null and empty texts are that id
    alone, very long ones as many pieces as they need. Only documents longer than
    seq_len are cut. Every sequence is gapless from offset 0. Ties (pieces of one
    length) are dealt by row, repeated rows are packed each; null ids stay null;
    extra columns, whatever their names, are not read; no rows give no rows.
    by_program: the sequence is a rounded configuration (a full piece is its own),
    not best fit. least_sequences: the dual bound, the same in all rows.
    """
    spark = docs.sparkSession
    ship_code(spark)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = base.mapInPandas(_pieces(path or vocabulary(), seq_len), "doc_id long, piece int, start long, length long, ids_crc32 long")
    pieces = stage(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")
    counts = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    whole = counts.pop(seq_len, 0)
    solved = plan(counts, seq_len)
    table = spark.sparkContext.broadcast(solved.table)
    salts = max(64, max(counts.values(), default=0) // RANKED)
    part = pieces.where(F.col("length") < seq_len).withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int"))
    sizes = stage(part.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")), "piece-sizes")
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("row"))
    ranked = part.withColumn("own", own).join(shift, ["length", "salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("own") + F.col("shift") - 1).alias("rank"))
    kind = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, by_program boolean"
    out = ranked.mapInPandas(_places(table, solved.by_program), kind)
    full = pieces.where(F.col("length") == seq_len)
    full = full.select("doc_id", "piece", "start", "length", "ids_crc32", (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(True).alias("by_program"))
    return out.unionByName(full).withColumn("least_sequences", F.lit(whole + solved.bound).cast("long"))
