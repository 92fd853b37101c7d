"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions only."""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator, Mapping
from fractions import Fraction
from itertools import islice
from math import ceil, gcd, lcm

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import BROADCAST_BYTES, Scratch, gapless, table
from tessera.sources import files

#: Rows of one source that are scheduled together.
BLOCK_ROWS = 64

#: Slots that the driver makes, holds and writes at once. The schedule doesn't depend on it.
PERIOD = 1 << 18

#: Without target weights, a source weighs as its rows to this power: small sources are repeated, no row is left out.
SMOOTHING = 0.85

#: Rows of a block that is numbered together: small, so that several blocks of a hot source that meet in a task weigh little.
ROWS_PER_TASK = 512

#: Times that a row is repeated at once, and sources that a mix may have.
TURNS_AT_ONCE, SOURCES = 64, 1 << 20


def whole_parts(weights: Mapping[str, float], period: int) -> dict[str, int]:
    """Positive whole parts in proportion to the weights, which add up to the period (largest remainders first)."""
    total = sum(weights.values())
    exact = {s: w / total * period for s, w in weights.items()}
    parts = {s: max(1, int(x)) for s, x in exact.items()}
    by_rest = sorted(exact, key=lambda s: (int(exact[s]) - exact[s], s))
    i = 0
    while (short := period - sum(parts.values())) != 0:
        s = by_rest[i % len(by_rest)] if short > 0 else max(parts, key=lambda x: (parts[x] - exact[x], parts[x], x))
        parts[s] += 1 if short > 0 else -1
        i += 1
    return parts


def exact_parts(weights: Mapping[str, float]) -> dict[str, int]:
    """The smallest whole parts in exactly the proportion of the weights."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    scale = lcm(*(x.denominator for x in exact.values()))
    parts = {s: int(x * scale) for s, x in exact.items()}
    common = gcd(*parts.values())
    return {s: p // common for s, p in parts.items()}


def pfair(parts: Mapping[str, int]) -> Iterator[tuple[str, int]]:
    """The endless schedule: the (source, its block) of each slot.

    The j-th block (from 0) of a source with p of P parts is released at slot floor(j P / p) and due by slot
    ceil((j + 1) P / p); among the released blocks the earliest deadline runs, ties to the smaller source. So after t slots
    a source has had more than t p / P - 1 and less than t p / P + 1 blocks, for any t, and exactly p after P.
    """
    period = sum(parts.values())
    waiting = [(0, s, 0) for s in sorted(parts)]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    t = 0
    while True:
        while waiting and waiting[0][0] <= t:
            _, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * period // parts[s]), s, j))
        due, s, j = heapq.heappop(ready)
        if due <= t:
            raise AssertionError("a block missed its deadline")
        yield s, j
        heapq.heappush(waiting, ((j + 1) * period // parts[s], s, j + 1))
        t += 1


def pfair_period(parts: Mapping[str, int]) -> list[tuple[str, int]]:
    """One period of the schedule."""
    return list(islice(pfair(parts), sum(parts.values())))


def _slots(parts: Mapping[str, int], end: int, at_once: int, had: list[int]) -> Iterator[bytes]:
    """The schedule's first slots as lines (slot, number of the source by name, its block), in lots; counts the blocks that
    each source has had."""
    number = {s: i for i, s in enumerate(sorted(parts))}
    schedule = pfair(parts)
    for start in range(0, end, at_once):
        lines = []
        for slot, (s, j) in enumerate(islice(schedule, min(at_once, end - start)), start):
            had[number[s]] += 1
            lines.append(f"{slot},{number[s]},{j}\n")
        yield "".join(lines).encode()


def mix(
    frame: DataFrame,
    source: str,
    order: list[str],
    weights: Mapping[str | None, float] | None = None,
    block_rows: int = BLOCK_ROWS,
    period: int = PERIOD,
) -> DataFrame:
    """The rows in mixed order: each source's blocks of rows in the slots that the Pfair schedule gives it.

    Every row comes at least once: the mix ends with the slot by which the last source is due to have gone through all its
    rows; sources that are through sooner start again (``epoch`` counts from 0). Adds ``epoch``, ``block`` (number of the
    block in its source), ``slot`` (of the block in the mix) and ``position`` (of the row in the mix, gapless from 0),
    behind the frame's own columns, which all stay as they are. An own column with one of these names (in any case) is then
    there beside the added one, and has to be renamed before or after to be selected by name or stored.
    Rows with a null source are a source of their own. ``weights`` must name every source with a positive weight, and may
    name others, which are ignored. Ties in ``order`` come in any order. An empty table gives an empty result.
    The driver sees one count for each source, of which there may be SOURCES, and no rows. It makes the slots of the whole
    mix from the exact weights, so no rounding adds up; ``period`` of them at a time are held, and written to the shared
    folder as a file of lines that Spark reads. A row that comes very often is repeated in two steps, with a shuffle between
    them.
    """
    spark = frame.sparkSession
    scratch = Scratch(spark, "mixing")
    named = frame.withColumn("__source", F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("-")))
    counted = named.groupBy("__source").agg(F.count(F.lit(1)).alias("n")).limit(SOURCES + 1).collect()
    if len(counted) > SOURCES:
        raise ValueError(f"more than {SOURCES} different sources")
    counts = {r["__source"]: r["n"] for r in counted}
    if weights is None:
        wanted = {s: n**SMOOTHING for s, n in counts.items()}
    else:
        given = {"-" if s is None else f"={s}": w for s, w in weights.items()}
        if missing := sorted(s[1:] or "null" for s in counts if not given.get(s, 0) > 0):
            raise ValueError(f"no positive target weight for: {', '.join(missing)}")
        wanted = {s: given[s] for s in counts}
    parts = exact_parts(wanted) if counts else {}
    whole = sum(parts.values())
    # the slot by which the last block that a source needs is due
    end = max((-(-ceil(n / block_rows) * whole // parts[s]) for s, n in counts.items()), default=0)
    had = [0] * len(counts)
    size = 0
    for k, lot in enumerate(_slots(parts, end, period, had)):
        files.write_bytes(spark, f"{scratch.root}/slots/{k}.csv", [lot])
        size += len(lot)
    plan = [{"__source": s, "__no": i, "__rows": counts[s], "__total": had[i] * block_rows} for i, s in enumerate(sorted(counts))]
    lines = "".join(json.dumps(p) + "\n" for p in plan).encode()
    files.write_bytes(spark, f"{scratch.root}/slots/{end}.csv", [b""])
    files.write_bytes(spark, f"{scratch.root}/sources.json", [lines])
    slots = spark.read.schema("__slot long, __no int, __block_no long").csv(f"{scratch.root}/slots")
    sources = spark.read.schema("__source string, __no int, __rows long, __total long").json(f"{scratch.root}/sources.json")
    small = lambda found, held: F.broadcast(found) if held <= BROADCAST_BYTES else found
    blocks = max(1, ceil(sum(counts.values()) / ROWS_PER_TASK))
    ranked = gapless(named, ["__source"], order, "__rank", blocks).join(small(sources, len(lines)), "__source")
    last = F.floor((F.col("__total") - 1 - F.col("__rank")) / F.col("__rows")).cast("long")
    turns = ranked.withColumn("__last", last).where("__last >= 0")
    if max((p["__total"] // p["__rows"] for p in plan), default=0) > TURNS_AT_ONCE:
        turns = turns.withColumn("__lot", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("__last") / TURNS_AT_ONCE))))
        turns = turns.repartition("__source", "__rank", "__lot")
    else:
        turns = turns.withColumn("__lot", F.lit(0).cast("long"))
    first = F.col("__lot") * TURNS_AT_ONCE
    turns = turns.withColumn("__epoch", F.explode(F.sequence(first, F.least(F.col("__last"), first + TURNS_AT_ONCE - 1))))
    here = F.col("__rank") + F.col("__epoch") * F.col("__rows")
    placed = turns.withColumns({"__here": here, "__block_no": F.floor(here / block_rows).cast("long")})
    position = F.col("__slot") * block_rows + F.col("__here") % block_rows
    own = [F.col(f"`{c}`") for c in frame.columns]
    return (
        placed.join(small(slots, size), ["__no", "__block_no"])
        .select(*own, F.col("__epoch").cast("int"), "__block_no", "__slot", position.cast("long"))
        .toDF(*frame.columns, "epoch", "block", "slot", "position")
    )


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, mixed to weights that grow as a source's rows to the power 0.85."""
    rows = table(spark, sf_dir, "documents", "doc_id", "source")
    return mix(rows, "source", ["doc_id"])


def in_mixed_order(mixed: DataFrame) -> DataFrame:
    """The mixed rows dealt to partitions by ranges of their position, and sorted in each."""
    return mixed.repartitionByRange("position").sortWithinPartitions("position")
