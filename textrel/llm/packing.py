"""Documents packed into containers of fixed capacity: first-fit decreasing in randomised groups.

Documents are dealt to groups by a seeded hash; a group holds about GROUP_TOKENS tokens and GROUP_ITEMS documents, so
its size does not grow with the corpus, and groups are packed independently. Within a group, documents come by falling
size; each goes to the first container with room, found by descending a tournament tree of the room that is left (each
inner node has the larger of its two children). The only loss against packing all at once is the last, partly filled
container of a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textrel.session import checkpointed

GROUP_TOKENS = 8_000_000
GROUP_ITEMS = 50_000


class Tournament:
    """Room left in containers 0, 1, ...; finds the first with enough."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.leaves = 1
        self.room = [capacity, capacity]  # node 1 is the root; leaves start at self.leaves

    def _grow(self) -> None:
        n = self.leaves
        old = self.room[n:]
        self.leaves = 2 * n
        self.room = [0] * (2 * n) + old + [self.capacity] * n
        for i in range(2 * n - 1, 0, -1):
            self.room[i] = max(self.room[2 * i], self.room[2 * i + 1])

    def place(self, size: int) -> int:
        """Put an item into the first container with room for it; its number."""
        if size > self.capacity:
            raise ValueError(f"an item of {size} does not fit a container of {self.capacity}")
        room = self.room
        while room[1] < size:
            self._grow()
            room = self.room
        i = 1
        while i < self.leaves:
            i *= 2
            if room[i] < size:
                i += 1
        at = i - self.leaves
        room[i] -= size
        i //= 2
        while i:
            top = max(room[2 * i], room[2 * i + 1])
            if room[i] == top:
                break
            room[i] = top
            i //= 2
        return at


def pack_documents(sizes: DataFrame, specs: DataFrame, seed: int = 17, group_tokens: int = GROUP_TOKENS, group_items: int = GROUP_ITEMS) -> DataFrame:
    """Containers of documents: spec_name, container_id, position, doc_id, piece_no, token_start, token_end.

    ``sizes`` has doc_id (unique) and n_tokens; ``specs`` (spec_name, capacity_tokens) is a small fixed table with
    capacities of at least 1. A document beyond the capacity is cut into full containers of its own; its rest is packed
    like a short document. Documents without tokens (0 or null) take no room and stand in some container, so that every
    document is there once. Without specs there are no rows. ``sizes`` is written to the checkpoint folder, since two passes read it.
    """
    held = checkpointed(sizes.select(F.col("doc_id"), F.coalesce("n_tokens", F.lit(0)).cast("bigint").alias("n_tokens")))
    total, items = held.agg(F.sum("n_tokens"), F.count("*")).first()
    groups = max(1, ceil((total or 0) / group_tokens), ceil(items / group_items))
    kinds = [F.struct(F.lit(r["spec_name"]).alias("spec_name"), F.lit(r["capacity_tokens"]).cast("bigint").alias("capacity")) for r in specs.collect()]
    kind = dict(sizes.dtypes)["doc_id"]
    if not kinds:
        return held.sparkSession.createDataFrame([], f"spec_name string, container_id string, position int, doc_id {kind}, piece_no int, token_start long, token_end long")
    each = held.select("*", F.inline(F.array(*kinds)))
    each = each.withColumn("whole", F.expr("n_tokens div capacity")).withColumn("rest", F.col("n_tokens") - F.col("whole") * F.col("capacity"))
    full = each.where("whole > 0").select("spec_name", "doc_id", "capacity", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("whole") - 1)).alias("piece"))
    full = full.select(
        "spec_name",
        F.concat_ws("-", "spec_name", F.lit("d"), F.col("doc_id").cast("string"), F.col("piece").cast("string")).alias("container_id"),
        F.lit(1).alias("position"),
        "doc_id",
        F.col("piece").cast("int").alias("piece_no"),
        (F.col("piece") * F.col("capacity")).alias("token_start"),
        ((F.col("piece") + 1) * F.col("capacity")).alias("token_end"),
    )
    loose = each.where("rest > 0 OR whole = 0").select("spec_name", "capacity", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(groups)).alias("grp"), "doc_id", "whole", "rest")

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, tree, inside = None, None, []
        for b in batches:
            out = []
            for spec, capacity, grp, doc, whole, rest in b.itertuples(index=False):
                if (spec, grp) != at:
                    at, tree, inside = (spec, grp), Tournament(capacity), []
                k = tree.place(rest)
                while len(inside) <= k:
                    inside.append(0)
                inside[k] += 1
                out.append((spec, f"{spec}-g-{grp}-{k}", inside[k], doc, whole, whole * capacity, whole * capacity + rest))
            yield pd.DataFrame(out, columns=["spec_name", "container_id", "position", "doc_id", "piece_no", "token_start", "token_end"])

    sorted_groups = loose.repartition("spec_name", "grp").sortWithinPartitions("spec_name", "grp", F.desc("rest"), "doc_id")
    packed = sorted_groups.mapInPandas(pack, f"spec_name string, container_id string, position int, doc_id {kind}, piece_no int, token_start long, token_end long")
    return full.unionByName(packed)


def fill_report(packed: DataFrame, specs: DataFrame) -> DataFrame:
    """Per spec: containers, tokens in them, share of their room that is filled, pieces, and documents cut."""
    per = packed.groupBy("spec_name", "container_id").agg(F.sum(F.col("token_end") - F.col("token_start")).alias("tokens"), F.count("*").alias("pieces"), F.sum((F.col("piece_no") == 1).cast("int")).alias("cut"))
    sums = per.groupBy("spec_name").agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"), F.sum("pieces").alias("pieces"), F.sum("cut").alias("documents_cut"))
    return sums.join(F.broadcast(specs.select("spec_name", "capacity_tokens")), "spec_name").select("spec_name", "capacity_tokens", "containers", "tokens", "pieces", "documents_cut", (F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("filled"))
