"""Links between 64-bit fingerprints within a Hamming radius, by meet-in-the-middle ball hashing.

Two fingerprints within `radius` bits have a common variant within half of it from
each. Every fingerprint has all its variants on all 64 bits (2,081 for a radius of
4), and those that share one are linked. The shuffle is on the variants' low bits:
of the ball, a task deals a fingerprint once to each value that its low bits take
(137 for 16 bits), and there the rest of the ball, the variants of the high bits, is
made and met, some buckets at a time. So each variant is in one task, but 12 bytes
are shuffled for many of them.

Fingerprints that share a variant are within the radius by the triangle inequality,
which is verified all the same. Links are contracted in the task that finds them, so a
dense group of m near copies gives at most m - 1 links a time, never all pairs.
Memory is the VARIANTS that a task makes at a time, and the balls of one bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import lean
from .components import contract

LINKS = "a long, b long"
#: Least number of low bits, variants of a shuffle bucket and of a step on average, and fingerprints that a task deals out at a time.
LOW, BUCKET, VARIANTS, DEAL = 16, 1 << 23, 1 << 21, 1 << 14
#: Bits of a filter of the variants that meet.
FILTER = 20


def ball(bits: int, radius: int) -> np.ndarray:
    """Masks of up to `radius` of so many bits."""
    return np.array([sum(1 << i for i in chosen) for r in range(radius + 1) for chosen in combinations(range(bits), r)], np.uint64)


def ball_size(bits: int, radius: int) -> int:
    return len(ball(bits, radius)) if radius else 1


def _spread(x: np.ndarray, bits: int) -> np.ndarray:
    return (x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)


def deal(fps: np.ndarray, low: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(low bits of a variant, fingerprint): each fingerprint once for each value."""
    masks = ball(low, radius // 2)
    part = fps & np.uint64((1 << low) - 1)
    return (part[:, None] ^ masks).reshape(-1).astype(np.uint32), np.repeat(fps, len(masks))


def meetings(lows: np.ndarray, fps: np.ndarray, low: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified links of fingerprints (as dealt by deal()) that have a variant in common, to the least that has it."""
    half, lows = radius // 2, lows.astype(np.uint64)
    used = np.bitwise_count((fps & np.uint64((1 << low) - 1)) ^ lows)
    made, owners, starts, at = [], [], [], 0
    for flips in range(half + 1):  # what the low bits leave of the ball is spent on the high ones
        mine = np.flatnonzero(used == flips)
        masks = ball(64 - low, half - flips) << np.uint64(low)
        base = fps[mine] >> np.uint64(low) << np.uint64(low) | lows[mine]
        made.append((base[:, None] ^ masks).reshape(-1))
        owners.append((fps[mine], len(masks)))
        starts.append(at)
        at += len(made[-1])
    variants = np.concatenate(made)
    ranked = np.sort(variants)
    met = ranked[1:][ranked[1:] == ranked[:-1]]
    if not len(met):
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    met = met[np.r_[True, met[1:] != met[:-1]]]
    known = np.zeros(1 << FILTER, bool)
    known[_spread(met, FILTER)] = True
    places = np.flatnonzero(known[_spread(variants, FILTER)])
    number = np.searchsorted(met, variants[places])
    right = met[np.minimum(number, len(met) - 1)] == variants[places]
    places, number = places[right], number[right]
    kind = np.searchsorted(starts, places, side="right") - 1
    owner = np.empty(len(places), np.uint64)
    for flips, (values, n) in enumerate(owners):
        some = np.flatnonzero(kind == flips)
        owner[some] = values[(places[some] - starts[flips]) // n]
    order = np.lexsort((owner, number))
    number, owner = number[order], owner[order]
    opens = np.r_[True, number[1:] != number[:-1]]
    least = owner[np.flatnonzero(opens)][np.cumsum(opens) - 1]
    near = (owner != least) & (np.bitwise_count(owner ^ least) <= radius)
    return least[near], owner[near]


def _deal(low: int, radius: int, per: int):
    def emit(held):
        lows, fps = deal(np.concatenate(held).view(np.uint64), low, radius)
        bucket = (_spread(lows.astype(np.uint64), 32) % np.uint64(per)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=per)
        ends, some = np.cumsum(sizes), np.flatnonzero(sizes)
        lows, fps = lows[order], fps[order]
        cut = lambda x, b: x[ends[b] - sizes[b] : ends[b]].tobytes()
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([cut(lows, b) for b in some], pa.binary()), pa.array([cut(fps, b) for b in some], pa.binary())], names=["bucket", "lows", "fps"])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy()
            for at in range(0, len(values), DEAL):
                yield from emit([values[at : at + DEAL]])

    return run


def _meet(low: int, radius: int):
    def steps(lows: np.ndarray, fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Parts of whole low values with about VARIANTS variants."""
        order = np.argsort(lows, kind="stable")
        lows, fps = lows[order], fps[order]
        used = np.bitwise_count((fps & np.uint64((1 << low) - 1)) ^ lows.astype(np.uint64))
        cost = np.array([ball_size(64 - low, radius // 2 - f) for f in range(radius // 2 + 1)])[used]
        total = np.cumsum(cost)
        opens = np.flatnonzero(np.r_[True, lows[1:] != lows[:-1]])
        ends = np.r_[opens[1:], len(lows)]
        at = 0
        while at < len(opens):
            spent = total[opens[at]] - cost[opens[at]]
            stop = max(at + 1, int(np.searchsorted(total[ends - 1], spent + VARIANTS, side="right")))
            yield lows[opens[at] : ends[stop - 1]], fps[opens[at] : ends[stop - 1]]
            at = stop

    def emit(held: list[tuple[bytes, bytes]]):
        lows, fps = (np.frombuffer(b"".join(x), kind) for x, kind in zip(zip(*held, strict=True), (np.uint32, np.uint64), strict=True))
        found = [meetings(x, y, low, radius) for x, y in steps(lows, fps)]
        a, b = (np.concatenate(x).view(np.int64) for x in zip(*found, strict=True))
        if len(a):
            a, b = contract(a, b)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for bucket, lows, fps in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != now and held:
                    yield from emit(held)
                    held = []
                now = bucket
                held.append((lows, fps))
        if held:
            yield from emit(held)

    return run


def ball_links(fps: DataFrame, radius: int, count: int) -> DataFrame:
    """Links (a, b) that connect the distinct values of the single column of fps, about `count`
    of them, that differ in at most `radius` bits, an even number."""
    if radius % 2 or not 0 <= radius <= 8:
        raise ValueError("radius must be 0, 2, 4, 6 or 8")
    per = max(1, -(-count * ball_size(64, radius // 2) // BUCKET))
    low = min(32, max(LOW, per.bit_length() + 4))
    dealt = fps.mapInArrow(_deal(low, radius, per), "bucket long, lows binary, fps binary")
    return dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_meet(low, radius), LINKS)
