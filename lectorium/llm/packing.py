"""Filling fixed-capacity containers.

Method: swap-based local search.  Items are placed best-fit decreasing; while there are more containers than the
sum of sizes needs, the emptiest ones are dissolved: documents are moved, exchanged one for one, two for one or
one for two with fuller containers, each time by the step of all that carries most over, so the sum of squared
fills grows, until the container is empty or no step is left.  Containers too full for that move and exchange one
for one, which gathers free room.  Passes end with ``PATIENCE`` that empty no container.

Scale: items are dealt by hash to groups of about ``GROUP`` items, each of which packs alone, so a group
has the size mix of the whole.  The items of each group's emptiest container are dealt again and packed
together, until they fit one group, so the loss is about one container for each such round, not for each group.
Only ids and sizes move.

Defined results: a null or empty text is no item; a text longer than the capacity is divided into full
pieces, one container each, and a rest that is an item like any other; equal sizes are placed by id.
"""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectorium.session import stored

GROUP = 2000


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Item numbers of each container, best-fit decreasing."""
    bins: list[list[int]] = []
    free: list[tuple[int, int]] = []  # (space, container), sorted
    for i in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        at = bisect.bisect_left(free, (sizes[i], -1))
        if at < len(free):
            space, b = free.pop(at)
            bins[b].append(i)
        else:
            b, space = len(bins), capacity
            bins.append([i])
        if space > sizes[i]:
            bisect.insort(free, (space - sizes[i], b))
    return bins


def _pairs(items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(len(items), 1)


def _over(give: np.ndarray, back: np.ndarray, room: np.ndarray) -> tuple[int, int, int]:
    """(gain, place in give, place in back) of the exchange that carries most over within the room of each."""
    best = (0, -1, -1)
    step = max(1, 2_000_000 // max(len(back), 1))
    for k in range(0, len(give), step):
        moved = give[k : k + step, None] - back[None]
        moved[moved > room[None]] = 0
        at = int(moved.argmax())
        i, j = divmod(at, len(back))
        if moved[i, j] > best[0]:
            best = (int(moved[i, j]), k + i, j)
    return best


def _swap(a: int, mine: np.ndarray, sizes: np.ndarray, where: np.ndarray, fill: np.ndarray, capacity: int):
    """The move or one-for-one exchange that carries most out of container a into a fuller one: (container, items
    out, items back)."""
    room = np.where((fill >= fill[a]) & (fill > 0), capacity - fill, 0)
    room[a] = 0
    best, step = 0, None
    open_ = np.flatnonzero(room)
    if len(open_):
        got = _over(sizes[mine], np.zeros(len(open_), np.int64), room[open_])
        if got[0]:
            best, step = got[0], (int(open_[got[2]]), [int(mine[got[1]])], [])
        item = np.flatnonzero(room[where] > best)
        if len(item):
            got = _over(sizes[mine], sizes[item], room[where[item]])
            if got[0] > best:
                step = int(where[item[got[2]]]), [int(mine[got[1]])], [int(item[got[2]])]
    return step


def _step(a: int, bins: list[list[int]], sizes: np.ndarray, where: np.ndarray, fill: np.ndarray, capacity: int):
    """As ``_swap``, and two for one and one for two."""
    mine = np.array(bins[a])
    step = _swap(a, mine, sizes, where, fill, capacity)
    best = 0 if step is None else int(sizes[step[1]].sum() - sizes[step[2]].sum())
    room = np.where((fill >= fill[a]) & (fill > 0), capacity - fill, 0)
    room[a] = 0
    p, q = _pairs(mine)
    item = np.flatnonzero(room[where] > best)
    if len(p) and len(item):
        got = _over(sizes[mine[p]] + sizes[mine[q]], sizes[item], room[where[item]])
        if got[0] > best:
            best, step = got[0], (int(where[item[got[2]]]), [int(mine[p[got[1]]]), int(mine[q[got[1]]])], [int(item[got[2]])])
    for b in np.flatnonzero(room > best).tolist():  # two come back for one
        if room[b] <= best or len(bins[b]) < 2:
            continue
        h = np.array(bins[b])
        p, q = _pairs(h)
        got = _over(sizes[mine], sizes[h[p]] + sizes[h[q]], np.full(len(p), room[b]))
        if got[0] > best:
            best, step = got[0], (b, [int(mine[got[1]])], [int(h[p[got[2]]]), int(h[q[got[2]]])])
    return step


#: Passes in a row that may empty no container before the search ends (all items stay placed).
PATIENCE = 3


def improve(bins: list[list[int]], sizes: list[int], capacity: int) -> list[list[int]]:
    """Local search; every step raises the sum of squared fills."""
    size = np.array(sizes, np.int64)
    fill = np.array([size[b].sum() for b in bins], np.int64)
    where = np.zeros(len(size), np.int64)
    for k, b in enumerate(bins):
        where[b] = k
    total, count = int(fill.sum()), sum(map(bool, bins))
    least, left = -(-total // capacity), PATIENCE
    while left and count > least:
        left -= 1
        moved_any = False
        for a in sorted((b for b in range(len(bins)) if bins[b] and fill[b] < capacity), key=lambda b: (fill[b], b)):
            while bins[a] and count > least:
                # what is free elsewhere could take all of it: every kind of step; else only steps that make room
                whole = fill[a] <= (count - 1) * capacity - (total - fill[a])
                step = _step(a, bins, size, where, fill, capacity) if whole else _swap(a, np.array(bins[a]), size, where, fill, capacity)
                if step is None:
                    break
                b, out, back = step
                bins[a] = [i for i in bins[a] if i not in out] + back
                bins[b] = [i for i in bins[b] if i not in back] + out
                where[out], where[back] = b, a
                moved = int(size[out].sum() - size[back].sum())
                fill[a] -= moved
                fill[b] += moved
                moved_any = True
            if not bins[a]:
                count -= 1
                left = PATIENCE
        if not moved_any:
            break
    return [b for b in bins if b]


def pack(sizes: list[int], capacity: int) -> list[list[int]]:
    return improve(best_fit(sizes, capacity), sizes, capacity)


def packed(items: DataFrame, capacities: DataFrame) -> DataFrame:
    """items: doc_id, tokens.  capacities: capacity_name, capacity_tokens (a short table, its rows are few).

    Gives capacity_name, capacity_tokens, container_id, doc_id, part, token_start, tokens.
    """
    sizes = capacities.where("capacity_tokens > 0").select("capacity_name", "capacity_tokens").collect()  # a row for each kind of container
    each = F.array(*[F.struct(F.lit(r.capacity_name).alias("capacity_name"), F.lit(r.capacity_tokens).cast("int").alias("capacity_tokens")) for r in sizes])
    d = items.where("tokens > 0").select("doc_id", "tokens", F.inline(each)) if sizes else items.limit(0).withColumns({"capacity_name": F.lit(""), "capacity_tokens": F.lit(1)})
    whole = F.floor(F.col("tokens") / F.col("capacity_tokens"))
    d = d.withColumn("_full", F.when(F.col("tokens") > F.col("capacity_tokens"), whole).otherwise(F.lit(0)).cast("int"))
    rest = F.col("tokens") - F.col("_full") * F.col("capacity_tokens")
    full = d.where("_full > 0").select("capacity_name", "capacity_tokens", "doc_id", F.explode(F.sequence(F.lit(0), F.col("_full") - 1)).alias("part"), F.col("capacity_tokens").alias("tokens"))
    full = full.withColumn("token_start", F.col("part") * F.col("capacity_tokens")).withColumn("container_id", F.concat_ws("-", "doc_id", "part"))
    left = d.where(rest > 0).select("capacity_name", "capacity_tokens", "doc_id", F.col("_full").alias("part"), (F.col("_full") * F.col("capacity_tokens")).alias("token_start"), rest.cast("int").alias("tokens"))
    schema = "capacity_name string, capacity_tokens int, container_id string, doc_id long, part int, token_start int, tokens int"
    names = [x.split()[0] for x in schema.split(", ")]
    out = full.select(*[F.col(c).cast("int") if c in ("part", "token_start", "tokens", "capacity_tokens") else F.col(c) for c in names])
    n, level = items.where("tokens > 0").count(), 0
    while True:
        groups = max(1, -(-n // GROUP))
        some = left.withColumn("_g", F.pmod(F.xxhash64("doc_id", F.lit(level)), F.lit(groups)).cast("int")).groupBy("capacity_name", "_g").applyInPandas(_packer(level, names, groups > 1), schema + ", emptiest boolean")
        if groups == 1:
            return out.unionByName(some.select(names))
        some = stored(some)
        out = out.unionByName(some.where("NOT emptiest").select(names))
        left = some.where("emptiest").select("capacity_name", "capacity_tokens", "doc_id", "part", "token_start", "tokens")
        most = left.groupBy("capacity_name").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        if most >= n:  # each item fills a container of its own
            return out.unionByName(some.where("emptiest").select(names))
        n, level = most, level + 1


def _packer(level: int, names: list[str], mark: bool):
    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["doc_id", "part"], ignore_index=True)
        g, capacity = int(f["_g"].iloc[0]), int(f["capacity_tokens"].iloc[0])
        size = f["tokens"].tolist()
        bins = pack(size, capacity)
        fill = [sum(size[i] for i in b) for b in bins]
        last = min(range(len(bins)), key=lambda k: (fill[k], k))
        where, emptiest = [""] * len(f), np.zeros(len(f), bool)
        for k, b in enumerate(bins):
            for i in b:
                where[i] = f"g{level}-{g}-{k}"
                emptiest[i] = mark and k == last and fill[k] < capacity
        return f.assign(container_id=where, emptiest=emptiest)[[*names, "emptiest"]]

    return run
