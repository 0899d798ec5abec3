"""Sharding by fixed virtual slots.

Records are hashed into thousands of slots, bytes and rows are summed for each slot, and a versioned map from slots to
shards is stored. Rebalancing edits the map: only the slots that it names move.

Defined results: null text has size 1 and the checksum of no bytes; null ids are hashed like any value; rows that are
repeated share a slot; an empty table gives a map of even slot ranges and no rows; other columns pass through unless
they clash with the columns that are added, which replace them.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

N_SLOTS = 4096


@dataclass(frozen=True)
class SlotMap:
    """One version of the slot-to-shard map; moved lists (slot, from, to) against the version before."""

    version: int
    n_shards: int
    shard_of: tuple[int, ...]
    moved: tuple[tuple[int, int, int], ...] = ()

    def rows(self) -> list[tuple[int, int, int, int, int | None]]:
        """(version, slot, shard, number of shards, shard in the version before where the slot moved)."""
        came = {slot: source for slot, source, _ in self.moved}
        return [(self.version, slot, shard, self.n_shards, came.get(slot)) for slot, shard in enumerate(self.shard_of)]


def initial_map(n_shards: int, n_slots: int = N_SLOTS) -> SlotMap:
    """Version 1: even ranges of slots."""
    return SlotMap(1, n_shards, tuple(slot * n_shards // n_slots for slot in range(n_slots)))


def rebalance(old: SlotMap, weight: dict[int, int], n_shards: int | None = None) -> SlotMap:
    """The next version: moves or swaps slots between the heaviest and the lightest shard while that evens them out.

    n_shards may be larger than before: the new shards begin empty. Slots without weight stay.
    """
    n = n_shards or old.n_shards
    if n < old.n_shards:
        raise ValueError("shards can be added, not taken away")
    shard_of = list(old.shard_of)
    held: list[list[tuple[int, int]]] = [[] for _ in range(n)]  # of each shard (weight, slot), sorted
    for slot, shard in enumerate(shard_of):
        if weight.get(slot, 0) > 0:
            held[shard].append((weight[slot], slot))
    load = [0] * n
    for shard, slots in enumerate(held):
        slots.sort()
        load[shard] = sum(w for w, _ in slots)

    def move(at: int, source: int, target: int) -> None:
        w, slot = item = held[source].pop(at)
        held[target].insert(bisect_left(held[target], item), item)
        load[source] -= w
        load[target] += w
        shard_of[slot] = target

    for _ in range(4 * len(shard_of)):
        high, low = max(range(n), key=lambda s: (load[s], -s)), min(range(n), key=lambda s: (load[s], s))
        gap = load[high] - load[low]
        best = (0, -1, -1)  # gain, index in high, index in low or -1
        for j, less in [(-1, 0), *((j, w) for j, (w, _) in enumerate(held[low]))]:
            i = bisect_left(held[high], (less + gap // 2 + 1, -1)) - 1
            for k in (i, i + 1):
                if 0 <= k < len(held[high]) and 0 < (d := held[high][k][0] - less) < gap:
                    best = max(best, (min(d, gap - d), k, j))
        if best[0] <= 0:
            break
        _, i, j = best
        back = held[low][j] if j >= 0 else None
        move(i, high, low)
        if back:
            move(held[low].index(back), low, high)
    moved = tuple((s, a, b) for s, (a, b) in enumerate(zip(old.shard_of, shard_of, strict=True)) if a != b)
    return SlotMap(old.version + 1, n, tuple(shard_of), moved)


def write_map(spark: SparkSession, slot_map: SlotMap, path: str) -> None:
    """Append this version to the table of versions at path."""
    spark.createDataFrame(slot_map.rows(), "version int, slot int, shard int, n_shards int, moved_from int").coalesce(1).write.mode("append").partitionBy("version").parquet(path)


def read_map(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
    """A stored version, by default the newest. The map has one row for each slot, so its size is bounded."""
    df = spark.read.parquet(path)
    version = df.agg(F.max("version")).first()[0] if version is None else version
    rows = sorted(df.where(F.col("version") == version).collect(), key=lambda r: r.slot)
    if not rows:
        raise ValueError(f"no version {version} of the map")
    moved = tuple((r.slot, r.moved_from, r.shard) for r in rows if r.moved_from is not None)
    return SlotMap(version, rows[0].n_shards, tuple(r.shard for r in rows), moved)


def with_slots(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_slots: int = N_SLOTS) -> DataFrame:
    """Adds size, text_crc32 and virtual_slot (from id and text, so that copies and repeated ids spread)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumns({
        "size": (F.octet_length(text) + 1).cast("long"),
        "text_crc32": F.crc32(text.cast("binary")),
        "virtual_slot": F.pmod(F.xxhash64(F.col(id_col), text), F.lit(n_slots)).cast("int"),
    })


def slot_stats(slotted: DataFrame) -> dict[int, tuple[int, int]]:
    """Bytes and rows of each slot; at most one row for each slot comes to the driver."""
    return {r[0]: (r[1], r[2]) for r in slotted.groupBy("virtual_slot").agg(F.sum("size"), F.count("*")).collect()}


def place(slotted: DataFrame, slot_map: SlotMap, stats: dict[int, tuple[int, int]], order: list[str]) -> DataFrame:
    """Adds shard and position: the place in the shard, without gaps from 0.

    A slot's first position comes from the counts of the slots before it in its shard, so rows are numbered within
    slots only and no task holds a shard.
    """
    first, used = [], [0] * slot_map.n_shards
    for slot, shard in enumerate(slot_map.shard_of):
        first.append((slot, shard, used[shard]))
        used[shard] += stats.get(slot, (0, 0))[1]
    places = slotted.sparkSession.createDataFrame(first, "virtual_slot int, shard int, first_position long")
    number = F.row_number().over(Window.partitionBy("virtual_slot").orderBy(*order))
    return (
        slotted.withColumn("in_slot", number)
        .join(F.broadcast(places), "virtual_slot")  # one row for each slot
        .withColumn("position", F.col("first_position") + F.col("in_slot") - 1)
        .drop("first_position", "in_slot")
    )
