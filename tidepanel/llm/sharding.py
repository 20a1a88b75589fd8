"""Sharding by fixed virtual slots.

Records hash into thousands of slots; bytes are summed per slot; a versioned slot-to-shard map, a small table, says
where each slot lives.  Balancing edits the map, so only the rows of the moved slots change shard.
"""

from __future__ import annotations

import heapq
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidepanel.llm._shared import materialize, shared_dir

#: Bytes that a record takes besides its text.
OVERHEAD = 16

#: The map has one row per slot, at most this many, so that it can be broadcast and packed on the driver.
MAX_SLOTS = 65_536

MAP_SCHEMA = "version int, vslot int, shard int, bytes long, rows long"


def pack(loads: dict[int, tuple[int, int]], shards: int) -> dict[int, int]:
    """Slot -> shard for a first map: the largest slot next, to the shard with the fewest bytes so far."""
    heap = [(0, 0, s) for s in range(shards)]
    out = {}
    for slot, (size, _) in sorted(loads.items(), key=lambda x: (-x[1][0], x[0])):
        total, n, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (total + size, n + 1, shard))
    return out


def edit(old: dict[int, int], loads: dict[int, tuple[int, int]], shards: int, slack: float = 0.02) -> dict[int, int]:
    """A new version of ``old`` for new loads or another shard count, which moves few slots.

    Slots of shards that no longer exist, and new slots, go to the emptiest shard.  Then slots leave every shard that
    is over (1 + slack) times the mean, largest that fits first, until no move helps.
    """
    members: dict[int, set[int]] = {s: set() for s in range(shards)}
    size = {slot: b for slot, (b, _) in loads.items()}
    homeless = []
    for slot in sorted(size):
        shard = old.get(slot, -1)
        (members[shard].add(slot) if 0 <= shard < shards else homeless.append(slot))
    total = {s: sum(size[x] for x in m) for s, m in members.items()}

    def move(slot, to):
        members[to].add(slot)
        total[to] += size[slot]

    for slot in sorted(homeless, key=lambda x: (-size[x], x)):
        move(slot, min(total, key=lambda s: (total[s], s)))
    mean = sum(size.values()) / shards
    for shard in sorted(total, key=lambda s: (-total[s], s)):
        for slot in sorted(members[shard], key=lambda x: (-size[x], x)):
            if total[shard] <= mean * (1 + slack):
                break
            to = min(total, key=lambda s: (total[s], s))
            if to != shard and total[to] + size[slot] < total[shard]:
                members[shard].discard(slot)
                total[shard] -= size[slot]
                move(slot, to)
    return {slot: s for s, m in members.items() for slot in m}


def slotted(docs: DataFrame, slots: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, size, text_crc32, vslot)``; a null text is 0 bytes, a null id is spread by its text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    crc = F.crc32(text.cast("binary"))
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        crc.alias("text_crc32"),
        F.pmod(F.xxhash64(F.col(id_col).cast("long"), crc), F.lit(slots)).cast("int").alias("vslot"),
    )


def slot_loads(rows: DataFrame, slots: int) -> dict[int, tuple[int, int]]:
    """Bytes and rows of every slot, empty ones too: at most ``MAX_SLOTS`` rows reach the driver, whatever the input's size."""
    got = rows.groupBy("vslot").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()
    return dict.fromkeys(range(slots), (0, 0)) | {r["vslot"]: (r["b"], r["n"]) for r in got}


def map_table(spark: SparkSession, version: int, where: dict[int, int], loads: dict[int, tuple[int, int]]) -> DataFrame:
    """The map as a table: a row for each slot, whether it holds rows now or not."""
    return spark.createDataFrame([(version, k, s, *loads[k]) for k, s in sorted(where.items())], MAP_SCHEMA)


def newest_map(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest version of the map under ``path``, where each version is a folder ``version=n``; null if there is none."""
    try:
        versions = spark.read.parquet(path)
    except AnalysisException:  # nothing there yet
        return None
    newest = versions.agg(F.max("version")).first()[0]
    return None if newest is None else versions.where(F.col("version") == newest)


def shard(
    docs: DataFrame, shards: int = 40, slots: int = 8192, map_path: str | None = None, previous: DataFrame | None = None,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Place all documents: ``(doc_id, size, text_crc32, vslot, map_version, shard, slot)``.

    ``slot`` is the record's place in its shard, gapless from 0: slots of a shard lie one after the other, and rows of
    a slot by (doc_id, crc, size), nulls last.  The newest map under ``map_path`` (or ``previous``, a map table) is
    edited, and the edited one is written beside it as the next version; without an earlier map a first one is packed.
    Without ``map_path`` the map lives as long as the application.  Sizes of shards are near equal as far as single
    records allow.

    Equal texts are separate records, spread by id over slots as any others are.  Null ids and texts, repeated rows and
    empty texts are ordinary records (rows that repeat id and text share a slot); an empty table gives an empty result;
    other columns are ignored.
    """
    if not 0 < slots <= MAX_SLOTS or shards < 1:
        raise ValueError(f"slots must be in 1..{MAX_SLOTS} and shards positive")
    spark = docs.sparkSession
    rows = materialize(slotted(docs, slots, id_col, text_col), "slotted")
    loads = slot_loads(rows, slots)
    if previous is None and map_path:
        previous = newest_map(spark, map_path)
    old = previous.collect() if previous is not None else []
    version = max((r["version"] for r in old), default=0) + 1
    old = {r["vslot"]: r["shard"] for r in old if r["version"] == version - 1}
    where = edit(old, loads, shards) if old else pack(loads, shards)
    path = f"{map_path or shared_dir(spark) + '/maps-' + uuid.uuid4().hex}/version={version}"
    map_table(spark, version, where, loads).drop("version").coalesce(1).write.parquet(path)
    placed = spark.read.schema("vslot int, shard int, bytes long, rows long").parquet(path).withColumn("version", F.lit(version))
    offset = F.sum("rows").over(W.partitionBy("shard").orderBy("vslot").rowsBetween(W.unboundedPreceding, -1))
    placed = placed.withColumn("offset", F.coalesce(offset, F.lit(0)))
    place = F.row_number().over(W.partitionBy("vslot").orderBy(F.col("doc_id").asc_nulls_last(), "text_crc32", "size"))
    return (
        rows.withColumn("place", place)
        .join(F.broadcast(placed.select("vslot", "version", "shard", "offset")), "vslot")
        .select(
            "doc_id", "size", "text_crc32", "vslot", F.col("version").alias("map_version"), "shard",
            (F.col("offset") + F.col("place") - 1).alias("slot"),
        )
    )


def op9_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "vslot", "map_version",
    )
