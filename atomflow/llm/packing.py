"""Packing of token sequences into rows of a fixed capacity.

``plan``: a whole corpus is packed through the histogram of its piece lengths, which has at most
``capacity`` entries however large the corpus is. First comes the Martello-Toth dominance reduction: for every length, from the
longest down and again until no rule fires, the small set that dominates every alternative is permanently fixed and taken out of the instance: the
piece alone when nothing fits beside it; a pair that fills the row exactly; the piece with the largest
partner that fits when no two others fit, or when that partner is at least as long as any two
others that fit and no three do; a pair beside it that fills the row when nothing longer than either fits. What remains is
packed by best fit, from long to short: each piece goes to the row with the least room that takes it. Rows with the same
lengths are handled as one, so the number of patterns is bounded by the capacity, not by the corpus.

``assigned`` then deals out the pieces: those of one length are numbered over a
salted, two-level count, and a piece's number and length name its row and its place there. No task gets
more than one salt's share of a length, and only the pattern table is broadcast.
"""

from __future__ import annotations

import bisect
import logging
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from atomflow.llm.scratch import shuffle_partitions

log = logging.getLogger("atomflow")


def _dominating(piece: int, room: int, counts: dict[int, int], lengths: list[int]) -> list[int] | None:
    """The partners of a piece in the set that dominates all others, or None if no rule settles it.

    lengths: those with a count above 0, ascending; counts don't include the piece itself.
    """
    fitting = lengths[: bisect.bisect_right(lengths, room)]
    if not fitting:
        return []
    if fitting[-1] == room:
        return [room]
    smallest: list[int] = []
    for x in fitting:
        smallest += [x] * min(counts[x], 3 - len(smallest))
        if len(smallest) == 3:
            break
    if sum(smallest[:2]) > room or len(smallest) < 2:
        return [fitting[-1]]
    if sum(smallest) > room or len(smallest) < 3:
        best, hi = 0, len(fitting) - 1
        for lo, x in enumerate(fitting):
            while hi >= 0 and fitting[hi] + x > room:
                hi -= 1
            at = hi
            while at > lo and best < fitting[at] + x <= room:
                best = fitting[at] + x
            if at == lo and counts[x] > 1 and 2 * x <= room:
                best = max(best, 2 * x)
        if fitting[-1] >= best:
            return [fitting[-1]]
        pair = _pair(best, fitting, counts)
        if best == room and pair:
            return pair if fitting[-1] <= min(pair) else None
    return None


def _pair(total: int, fitting: list[int], counts: dict[int, int]) -> list[int] | None:
    for x in reversed(fitting):
        y = total - x
        if y > x:
            continue
        if counts.get(y, 0) > (x == y):
            return [x, y]
    return None


def reduced(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, tuple[int, ...]]], dict[int, int]]:
    """Fixed sets (number of rows, lengths in a row) and the histogram of what no rule settles.

    A rule that holds for a piece goes on to hold when pieces are taken out, so a set is fixed as often as its lengths allow.
    """
    counts = {x: n for x, n in histogram.items() if n > 0}
    fixed: list[tuple[int, tuple[int, ...]]] = []
    again = True
    while again:
        again = False
        for x in sorted(counts, reverse=True):
            while counts.get(x):
                counts[x] -= 1
                lengths = sorted(y for y, n in counts.items() if n)
                partners = _dominating(x, capacity - x, counts, lengths)
                counts[x] += 1
                if partners is None:
                    break
                row = tuple(sorted([x, *partners], reverse=True))
                times = min(counts[y] // row.count(y) for y in set(row))
                fixed.append((times, row))
                for y in row:
                    counts[y] -= times
                again = True
        counts = {x: n for x, n in counts.items() if n}
    return fixed, counts


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Rows (number, lengths) of best fit from long to short.

    Of the open rows with the least room that takes a piece, one takes pieces of that length while they fit, since it goes on to have
    the least room; so rows of equal room are filled alike.
    """
    rooms: dict[int, list[list]] = {}
    done: list[tuple[int, tuple[int, ...]]] = []

    def put(times: int, row: tuple[int, ...], room: int) -> None:
        if times and room:
            rooms.setdefault(room, []).append([times, row])
        elif times:
            done.append((times, row))

    for x in sorted(histogram, reverse=True):
        left = histogram[x]
        for room in sorted(r for r in rooms if r >= x):
            q = room // x
            while left and rooms[room]:
                times, row = rooms[room].pop()
                full = min(times, left // q)
                put(full, row + (x,) * q, room - q * x)
                left -= full * q
                if full < times and left:  # one row takes the rest
                    put(1, row + (x,) * left, room - left * x)
                    left, full = 0, full + 1
                put(times - full, row, room)
                if full < times:
                    break
            if not rooms[room]:
                del rooms[room]
            if not left:
                break
        q = capacity // x
        put(left // q, (x,) * q, capacity - q * x)
        put(int(left % q > 0), (x,) * (left % q), capacity - left % q * x)
    return done + [(times, row) for parts in rooms.values() for times, row in parts]


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...], str]]:
    """Patterns (number of rows, lengths in a row, fixed or best fit) that use up the histogram; the fixed ones come first."""
    if any(x < 1 or x > capacity for x, n in histogram.items() if n):
        raise ValueError("a piece is empty or longer than a row")
    fixed, rest = reduced(histogram, capacity)
    rows = best_fit(rest, capacity)
    least = -(-sum(x * n for x, n in histogram.items()) // capacity)
    log.info("packing: %d rows fixed by dominance, %d by best fit, at least %d needed", sum(n for n, _ in fixed), sum(n for n, _ in rows), least)
    return [(n, row, "fixed") for n, row in fixed] + [(n, row, "best fit") for n, row in rows]


def intervals(patterns: Iterable[tuple[int, tuple[int, ...], str]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first number, past-last number, first row, pieces of that length in a row, place of the first one)."""
    used: dict[int, int] = {}
    row0, out = 0, []
    for times, row, _ in patterns:
        at = 0
        for x in sorted(set(row), reverse=True):
            q = row.count(x)
            lo = used.get(x, 0)
            out.append((x, lo, lo + q * times, row0, q, at))
            used[x] = lo + q * times
            at += q * x
        row0 += times
    return out


def numbered(pieces: DataFrame, length: str, key: list[str], salts: int) -> DataFrame:
    """Adds ``number``: 0, 1, 2 ... among the pieces of each length, through counts per length and salt."""
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(*key), F.lit(salts)))
    before = W.partitionBy(length).orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)
    counts = salted.groupBy(length, "_salt").agg(F.count("*").alias("_n"))
    first = counts.withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    own = W.partitionBy(length, "_salt").orderBy(*key)
    ranked = salted.withColumn("_own", F.row_number().over(own) - 1)
    return ranked.join(first, [length, "_salt"]).withColumn("number", F.col("_first") + F.col("_own")).drop("_salt", "_own", "_first")


def assigned(pieces: DataFrame, capacity: int, key: list[str], length: str = "length", salts: int | None = None) -> DataFrame:
    """Adds ``sequence_id`` (a number for each row of the packing) and ``offset`` (the place in it).

    pieces is read several times: give a stored table. key names what tells its pieces apart.
    """
    spark = pieces.sparkSession
    histogram = {r[length]: r["n"] for r in pieces.groupBy(length).agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    table = intervals(plan(histogram, capacity))
    if not table:
        return pieces.withColumns({"sequence_id": F.lit(0).cast("bigint"), "offset": F.lit(0).cast("bigint")}).limit(0)
    parts: dict[int, list[tuple]] = {}
    for x, *interval in table:
        parts.setdefault(x, []).append(tuple(interval))
    # One row for a length, so at most capacity rows.
    by_length = spark.createDataFrame(list(parts.items()), "l bigint, parts array<struct<lo: bigint, hi: bigint, row0: bigint, q: bigint, at: bigint>>")
    ranked = numbered(pieces, length, key, salts or shuffle_partitions(spark))
    found = ranked.join(F.broadcast(by_length), F.col(length) == F.col("l"))
    part = F.filter("parts", lambda p: (F.col("number") >= p["lo"]) & (F.col("number") < p["hi"]))[0]
    found = found.withColumn("_p", part)
    step = F.col("number") - F.col("_p.lo")
    return found.withColumns({
        "sequence_id": F.col("_p.row0") + F.floor(step / F.col("_p.q")).cast("bigint"),
        "offset": F.col("_p.at") + (step % F.col("_p.q")) * F.col(length),
    }).drop("_p", "l", "parts", "number")
