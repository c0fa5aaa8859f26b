"""Mixing sources to target weights by Pfair scheduling.

A source's rows form blocks.  With u of W units of weight, its k-th block is released at floor(k W / u) and due by
ceil((k + 1) W / u), and each slot goes to the released block with the earliest deadline, so a source is never a whole
block away from its share.  Units are whole and exact: the least whole numbers in the ratio of the weights.  The schedule
repeats every W slots: one period, or less where a source runs out before, is scheduled on the driver, bounded by the
lesser of W and the number of blocks, and the place of any block follows from it by arithmetic in the tasks.  When a
source has no block left, the others go on among themselves, so every row gets a place.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from fractions import Fraction
from math import gcd, lcm

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orogena.llm.common import stash

REST = "(rest)"
#: What op3_pfair_mix and the pipeline mix to: the relative share of each source's blocks while all have some left.
TARGET_WEIGHTS: dict[str, float] = {f"src{k}": 1 + k % 4 for k in range(20)}
_LONG = (1 << 63) - 1


def exact_units(weights: dict[str, float]) -> dict[str, int]:
    """The least whole numbers in the ratio of the weights; a float is the decimal fraction that it is written as."""
    exact = {k: w if isinstance(w, Fraction) else Fraction(str(w)) for k, w in weights.items()}
    if not exact or min(exact.values()) <= 0:
        raise ValueError("weights must be positive")
    scale = lcm(*[w.denominator for w in exact.values()])
    whole = {k: int(w * scale) for k, w in exact.items()}
    common = gcd(*whole.values())
    return {k: u // common for k, u in whole.items()}


def whole_units(weights: dict[str, float], units: int | None = None) -> dict[str, int]:
    """Weights in whole units: exact ones, or where that takes more than ``units``, as many by largest remainders."""
    out = exact_units(weights)
    if units is None or sum(out.values()) <= units:
        return out
    total = sum(weights.values())
    exact = {k: w * units / total for k, w in weights.items()}
    out = {k: max(1, int(x)) for k, x in exact.items()}
    for k in sorted(exact, key=lambda k: (int(exact[k]) - exact[k], k))[: max(0, units - sum(out.values()))]:
        out[k] += 1
    return out


def period(units: dict[str, int], blocks: dict[str, int] | None = None) -> dict[str, list[int]]:
    """The slots of each source in one period: earliest deadline first among released blocks, ties to the name.

    With ``blocks`` it ends with the first source's last block, if that comes before the period's end.
    """
    w = sum(units.values())
    waiting = [(0, s, 0) for s in sorted(units)]  # release, source, block
    ready: list[tuple[int, str, int]] = []  # deadline, source, block
    out: dict[str, list[int]] = {s: [] for s in units}
    slot = 0
    while slot < w:
        while waiting and waiting[0][0] <= slot:
            _, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * w // units[s]), s, k))
        _, s, k = heapq.heappop(ready)
        out[s].append(slot)
        if blocks and k + 1 == blocks[s]:
            break
        if k + 1 < units[s]:
            heapq.heappush(waiting, ((k + 1) * w // units[s], s, k + 1))
        slot += 1
    return out


@dataclass
class Phase:
    """From a slot on, while the same sources have blocks: blocks from first[s] up to last[s], by the period's slots."""

    start: int
    units: dict[str, int]
    slots: dict[str, list[int]]
    first: dict[str, int]
    last: dict[str, int]


def phases(blocks: dict[str, int], units: dict[str, int]) -> list[Phase]:
    """The schedule of all blocks: at most one phase for each source; a phase ends with a source's last block."""
    left, done, start, out = {s: n for s, n in blocks.items() if n}, dict.fromkeys(blocks, 0), 0, []
    while left:
        common = gcd(*[units[s] for s in left])
        u = {s: units[s] // common for s in left}
        w, slots = sum(u.values()), period(u, left)
        place = lambda s, k: k // u[s] * w + slots[s][k % u[s]]
        over = [s for s, n in left.items() if len(slots[s]) == n and n <= u[s]]
        end = min(place(s, left[s] - 1) for s in over or left) + 1
        took = {s: end // w * u[s] + sum(x < end % w for x in slots[s]) for s in left}
        out.append(Phase(start, u, slots, {s: done[s] for s in left}, {s: done[s] + took[s] for s in left}))
        for s in [*left]:
            done[s] += took[s]
            left[s] -= took[s]
            if not left[s]:
                del left[s]
        start += end
    return out


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, block: int = 64, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """A place for each row: doc_id, source, turn, seq, block, release, deadline, slot, position.

    ``weights`` gives target weights by source, which hold exactly; without it all sources weigh the same.  Each of them
    takes turns by itself, and only sources without a weight take one common turn of average weight (turn "(rest)").
    Inside a source rows go by a hash of their id.  Position counts from 0 without gaps.  A null source is the source "";
    rows with null or repeated ids get a place like any other; other columns are ignored; an empty table gives an empty
    result.  release and deadline are slots inside the block's phase, and start_slot is where that phase starts.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"))
    turn = F.col("source") if weights is None else F.when(F.col("source").isin([*weights]), F.col("source")).otherwise(REST)

    # one order by turn and hash; a row's number in its turn comes from counts for each written partition
    order = [F.col("turn"), F.xxhash64("doc_id"), F.col("doc_id")]
    listed = stash(
        rows.withColumn("turn", turn).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()),
        "listed",
    ).withColumn("part", F.shiftright("at", 33))
    parts = listed.groupBy("turn", "part").agg(F.count("*").alias("n"), F.min("at").alias("from"))
    parts = stash(parts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("turn").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))), "parts")
    sizes = {r["turn"]: r["n"] for r in parts.groupBy("turn").agg(F.sum("n").alias("n")).collect()}
    given = {s: Fraction(str(w)) for s, w in (weights or dict.fromkeys(sizes, 1)).items() if s in sizes}
    given |= {s: sum(given.values()) / len(given) if given else Fraction(1) for s in sizes if s not in given}
    plan = phases({s: -(-n // block) for s, n in sizes.items()}, exact_units(given)) if sizes else []

    # a source's last block may fall short of rows; it ends its phase, so later phases alone move forward
    table, missing = [], 0
    for p in plan:
        w = sum(p.units.values())
        for s, u in p.units.items():
            if p.last[s] > p.first[s]:
                turns = [(x, k * w // u, min(-(-(k + 1) * w // u), _LONG)) for k, x in enumerate(p.slots[s])]
                table.append((s, p.first[s], p.last[s], p.start, w if len(turns) == u else 0, missing, turns))
        missing += sum(-sizes[s] % block for s in p.units if p.last[s] * block >= sizes[s])
    schedule = spark.createDataFrame(table, "turn string, first long, last long, start_slot long, w long, missing long, slots array<struct<slot: long, release: long, deadline: long>>")

    seq = F.col("before") + F.col("at") - F.col("from")
    k, u = F.col("block") - F.col("first"), F.size("slots")
    lap = F.floor(k / u) * F.col("w")
    return (
        listed.join(parts.select("turn", "part", "before", "from"), ["turn", "part"])
        .withColumn("seq", seq)
        .withColumn("block", F.floor(F.col("seq") / block))
        .join(F.broadcast(schedule), "turn")
        .where((F.col("block") >= F.col("first")) & (F.col("block") < F.col("last")))
        .withColumn("x", F.get("slots", (k % u).cast("int")))
        .withColumn("release", lap + F.col("x.release"))
        .withColumn("deadline", lap + F.col("x.deadline"))
        .withColumn("slot", F.col("start_slot") + lap + F.col("x.slot"))
        .withColumn("position", F.col("slot") * block + F.col("seq") % block - F.col("missing"))
        .select("doc_id", "source", "turn", "seq", "block", "release", "deadline", "start_slot", "slot", "position")
    )


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, block: int = 64, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """``docs`` in the order of the mix, columns unchanged and every row kept; rows that share an id go together."""
    place = stash(mix_sources(docs, weights, block, id_col, source_col).groupBy("doc_id").agg(F.min("position").alias("__position")), "places")
    return docs.join(place, docs[id_col].cast("long").eqNullSafe(place["doc_id"])).orderBy(place["__position"]).select(*[docs[c] for c in docs.columns])
