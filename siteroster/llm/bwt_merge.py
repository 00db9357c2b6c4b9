"""Sorted suffixes of shards, their Burrows-Wheeler transforms, and merging by interleave refinement.

A shard's suffixes are read up to ``depth`` symbols of eight bytes. Its order
starts from given buckets and is refined symbol by symbol: a bucket falls apart
where symbols differ, which gives the common prefix of neighbours. Shards are
merged without sorting their suffixes anew: the interleave of the shards' orders
starts as one run per bucket and is refined the same way, a symbol at a time; a
run that holds suffixes of one shard only is settled, as that shard has its
order and common prefixes already.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Shard:
    """``start`` of suffixes in ``data`` in order, ``bucket`` of each, ``lcp`` with the one before (symbols), ``bwt`` symbols."""

    start: np.ndarray
    bucket: np.ndarray
    lcp: np.ndarray
    bwt: np.ndarray


def symbols(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Eight bytes from each place as one big-endian number."""
    return data[places[:, None] + np.arange(8)].view(">u8").ravel().astype(np.uint64)


def _refine(data, start, bucket, depth, settled=None):
    """Order and common prefixes of suffixes given in bucket order; ``settled(order, edges)`` names runs to leave."""
    n = len(start)
    order, lcp = np.arange(n), np.full(n, -1, np.int32)
    first = np.r_[True, bucket[1:] != bucket[:-1]]
    run = np.cumsum(first) - 1
    lcp[first] = 0
    active = np.arange(n)  # places in the order that are not settled, run by run
    for k in range(depth):
        sizes = np.bincount(run[active], minlength=run[-1] + 1) if len(active) else np.zeros(1, int)
        keep = sizes > 1
        if settled is not None and len(active):
            keep &= ~settled(order[active], run[active], len(sizes))
        active = active[keep[run[active]]]
        if not len(active):
            break
        symbol = symbols(data, start[order[active]] + 8 * k)
        by = np.lexsort((symbol, run[active]))  # runs stay together, and within a run the symbols rise
        order[active] = order[active][by]
        symbol, runs = symbol[by], run[active]
        new = np.r_[True, (symbol[1:] != symbol[:-1]) | (runs[1:] != runs[:-1])]
        fresh = active[new & np.r_[False, runs[1:] == runs[:-1]]]
        lcp[fresh] = k
        run[active] = np.cumsum(new) - 1
        # settled runs keep numbers of their own beyond the active ones
    return order, lcp, active


def build(data: np.ndarray, start: np.ndarray, bucket: np.ndarray, depth: int) -> Shard:
    by = np.argsort(bucket, kind="stable")
    start, bucket = start[by], bucket[by]
    order, lcp, _ = _refine(data, start, bucket, depth)
    lcp[lcp < 0] = depth
    start = start[order]
    return Shard(start, bucket, lcp, symbols(data, start - 8))


def merge(data: np.ndarray, shards: list[Shard], depth: int) -> Shard:
    start = np.concatenate([s.start for s in shards])
    bucket = np.concatenate([s.bucket for s in shards])
    owner = np.repeat(np.arange(len(shards)), [len(s.start) for s in shards])
    own_lcp = np.concatenate([s.lcp for s in shards])
    bwt = np.concatenate([s.bwt for s in shards])
    by = np.argsort(bucket, kind="stable")  # the first interleave: shard after shard within a bucket
    start, bucket, owner, own_lcp, bwt = start[by], bucket[by], owner[by], own_lcp[by], bwt[by]

    def one_shard(order: np.ndarray, run: np.ndarray, n: int) -> np.ndarray:
        most, least = np.full(n, -1), np.full(n, len(shards))
        np.maximum.at(most, run, owner[order])
        np.minimum.at(least, run, owner[order])
        return most == least

    order, lcp, _ = _refine(data, start, bucket, depth, one_shard)
    # inside settled runs neighbours are of one shard; their common prefix is the shard's own
    inside = lcp < 0
    same = inside & np.r_[False, owner[order][1:] == owner[order][:-1]]
    lcp = np.where(same, own_lcp[order], np.where(inside, depth, lcp))
    return Shard(start[order], bucket, lcp, bwt[order])


def repeated(shard: Shard, depth: int) -> np.ndarray:
    """Marks suffixes that share their whole depth with a neighbour: the repeated intervals."""
    joined = shard.lcp >= depth
    return joined | np.r_[joined[1:], False]
