"""Sharding into files of near equal bytes by Karmarkar-Karp differencing.

Equal texts form a group that stays together. A group starts as a partition with all of its bytes in one of the
places; the two partitions of largest spread are combined, the one's fullest place with the other's emptiest, until
one partition is left. Groups are differenced in buckets of bounded size, one task each; the partitions that result
(one row for each bucket and place) are differenced in the same way, level by level, until one is left. A row's
shard follows from its group's place through the levels.

Edge cases: null text counts as empty (1 byte for its end); an empty table gives no rows; repeated rows are rows of
one group; null doc_ids are kept. A single text that outweighs a shard's share keeps its shard to itself.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilstream.llm.common import cut, numbered

#: Groups, or partitions of a lower level, that one task differences.
AT_A_TIME = 4000
#: Buckets of the first level at least, so that the work is spread on small inputs too.
LEAST = 64


def difference(items: list[list[int]], places: int) -> list[list[int]]:
    """For each item (bytes by place, places may stay empty) the place that each of its places ends in."""
    heap = []
    for i, sums in enumerate(items):
        slots = sorted(((s, (i, p)) for p, s in enumerate(sums) if s), key=lambda x: (-x[0], x[1]))
        slots += [(0, None)] * (places - len(slots))
        heap.append((slots[-1][0] - slots[0][0], i, slots))
    heapq.heapify(heap)
    n = len(items)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        both = [(x + y, p if q is None else q if p is None else (p, q, None)) for (x, p), (y, q) in zip(a, reversed(b), strict=True)]
        both.sort(key=lambda x: -x[0])
        heapq.heappush(heap, (both[-1][0] - both[0][0], n, both))
        n += 1
    out = [[-1] * places for _ in items]
    for place, (_, tree) in enumerate(heap[0][2] if heap else []):
        todo = [tree] if tree is not None else []
        while todo:
            t = todo.pop()
            if len(t) == 3:
                todo += t[:2]
            else:
                out[t[0]][t[1]] = place
    return out


def _first_level(places: int):
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("bytes", "descending"), ("h", "ascending"), ("crc", "ascending")])
        got = difference([[b] + [0] * (places - 1) for b in group["bytes"].to_pylist()], places)
        return group.select(["h", "crc", "size", "bytes", "node"]).append_column("place", pa.array([g[0] for g in got], pa.int32()))

    return run


def _next_level(places: int):
    def run(group: pa.Table) -> pa.Table:
        nodes: dict[int, list[int]] = {}
        for node, place, b in zip(*(group[c].to_pylist() for c in ("node", "place", "bytes")), strict=True):
            nodes.setdefault(node, [0] * places)[place] = b
        names = sorted(nodes)
        got = difference([nodes[x] for x in names], places)
        rows = [(x, p, to, nodes[x][p]) for x, g in zip(names, got, strict=True) for p, to in enumerate(g) if to >= 0]
        up = group["up"][0].as_py()
        return pa.table({"node": [r[0] for r in rows], "place": pa.array([r[1] for r in rows], pa.int32()), "to": pa.array([r[2] for r in rows], pa.int32()), "bytes": [r[3] for r in rows], "up": [up] * len(rows)})

    return run


def shard_groups(groups: DataFrame, shards: int) -> DataFrame:
    """(h, crc, size, shard) for groups (h, crc, size, bytes)."""
    n = max(LEAST, -(-groups.count() // AT_A_TIME))
    first = groups.withColumn("node", F.pmod("h", F.lit(n)))
    placed = cut(first.groupBy("node").applyInArrow(_first_level(shards), "h long, crc long, size long, bytes long, node long, place int"))
    moves = placed.groupBy("node", "place").agg(F.sum("bytes").alias("bytes"))
    while n > 1:
        n_up = -(-n // AT_A_TIME)
        up = cut(moves.withColumn("up", F.pmod("node", F.lit(n_up))).groupBy("up").applyInArrow(_next_level(shards), "node long, place int, to int, bytes long, up long"))
        placed = placed.join(up.select("node", "place", "to", "up"), ["node", "place"]).select("h", "crc", "size", F.col("up").alias("node"), F.col("to").alias("place"))
        moves = up.groupBy(F.col("up").alias("node"), F.col("to").alias("place")).agg(F.sum("bytes").alias("bytes"))
        n = n_up
    return placed.select("h", "crc", "size", F.col("place").alias("shard"))


def shard(docs: DataFrame, shards: int = 16) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for each row of docs (doc_id, text)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("crc"), F.xxhash64(text).alias("h")))
    key = ["h", "crc", "size"]
    placed = shard_groups(cut(rows.groupBy(*key).agg(F.sum("size").alias("bytes"))), shards)
    out = cut(rows.join(placed, key).select("doc_id", "size", F.col("crc").alias("text_crc32"), "shard"))
    out = numbered(out, ["shard"], [F.col("doc_id"), F.col("text_crc32"), F.col("size")], "slot", max(LEAST, out.count() // 50_000))
    return out.select("doc_id", "size", "text_crc32", "shard", "slot")
