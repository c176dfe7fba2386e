"""Sources mixed to target weights by capped water-filling.

The tokens of each source are summed. A source can give at most its tokens times its cap of repeats. For a wanted total,
each source gets its share; sources beyond their cap are clamped, and what they lack is redistributed over the others in
proportion to their shares, until nothing exceeds its cap. A source's epochs (allotted / available tokens) are whole
repeats of all its documents plus a fraction of them: the documents first in a seeded order, up to the fraction's tokens.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textrel.session import checkpointed

#: Parts of a source's seeded order; the border of the fraction is found by part, then within one part.
PARTS = 4096


@dataclass(frozen=True)
class Source:
    name: str
    share: float
    tokens: int
    cap: int


def largest_exact_total(sources: list[Source]) -> float:
    """The largest total at which every source that has tokens can give exactly its share.

    What sources without any tokens should give is spread over the others in proportion, as water_fill does.
    """
    able = [s for s in sources if s.share > 0 and s.cap * s.tokens > 0]
    weight = sum(s.share for s in able)
    return min((s.cap * s.tokens * weight / s.share for s in able), default=0.0)


def water_fill(sources: list[Source], total: float) -> dict[str, float]:
    """Tokens allotted to each source, of ``total`` or as much as the caps allow."""
    limit = {s.name: float(s.cap * s.tokens) for s in sources}
    out = {s.name: 0.0 for s in sources}
    active = {s.name: s.share for s in sources if s.share > 0 and limit[s.name] > 0}
    left = total
    while active and left > 0:
        weight = sum(active.values())
        over = [n for n, w in active.items() if left * w / weight > limit[n] * (1 + 1e-12)]
        if not over:
            for n, w in active.items():
                out[n] = min(limit[n], left * w / weight)
            break
        for n in over:
            out[n] = limit[n]
            left -= limit[n]
            del active[n]
    return out


def mix_sources(sizes: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 23) -> tuple[DataFrame, DataFrame]:
    """(chosen, report). chosen: doc_id, source, n_tokens, repeats of each document drawn at least once. report: source,
    target_share, max_repeats, available_tokens, drawn_documents, drawn_tokens, actual_share, mean_repeats.

    ``sizes`` has doc_id (unique), source (as in ``targets``; others and null are never drawn) and n_tokens. ``targets``
    (source, target_share, max_repeats) is a small fixed table. ``total`` is the wanted number of tokens; by default the
    largest at which the target shares hold exactly (a source without tokens gives nothing, the others its part). Documents without tokens are drawn with whole repeats only. The
    fraction misses its tokens by less than one document. ``sizes`` is written to the checkpoint folder.
    """
    small = F.broadcast(targets.select("source", "target_share", "max_repeats"))
    held = checkpointed(sizes.join(small.select("source"), "source", "left_semi").select("doc_id", "source", F.coalesce("n_tokens", F.lit(0)).cast("bigint").alias("n_tokens"), F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(PARTS)).cast("int").alias("part")))
    parts = held.groupBy("source", "part").agg(F.sum("n_tokens").alias("tokens")).collect()  # at most sources x PARTS rows
    by_source: dict[str, dict[int, int]] = {}
    for r in parts:
        by_source.setdefault(r["source"], {})[r["part"]] = r["tokens"]
    sources = [Source(r["source"], r["target_share"], sum(by_source.get(r["source"], {}).values()), r["max_repeats"]) for r in targets.collect()]
    allotted = water_fill(sources, largest_exact_total(sources) if total is None else total)
    plan = []
    for s in sources:
        epochs = allotted[s.name] / s.tokens if s.tokens else 0.0
        whole = min(int(epochs + 1e-9), s.cap)
        need = max(0.0, allotted[s.name] - whole * s.tokens) if whole < s.cap else 0.0
        border, got = -1, 0
        for part in sorted(by_source.get(s.name, {})):
            n = by_source[s.name][part]
            if got + n > need:
                border = part
                break
            got += n
        plan.append((s.name, whole, need >= 1, border, float(need - got)))
    spark = sizes.sparkSession
    planned = F.broadcast(spark.createDataFrame(plan, "source string, whole int, has_rest boolean, border int, room double"))
    drawn = held.join(planned, "source")
    order = Window.partitionBy("source", "part").orderBy(F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = drawn.where("has_rest AND part = border").withColumn("so_far", F.sum("n_tokens").over(order)).withColumn("extra", (F.col("so_far") <= F.col("room")).cast("int")).drop("so_far")
    rest = drawn.where("NOT (has_rest AND part = border)").withColumn("extra", (F.col("has_rest") & ((F.col("part") < F.col("border")) | (F.col("border") < 0))).cast("int"))
    chosen = edge.unionByName(rest).withColumn("repeats", F.col("whole") + F.col("extra")).where("repeats > 0").select("doc_id", "source", "n_tokens", "repeats")
    sums = chosen.groupBy("source").agg(F.count("*").alias("drawn_documents"), F.sum(F.col("n_tokens") * F.col("repeats")).alias("drawn_tokens"))
    available = F.broadcast(spark.createDataFrame([(s.name, s.tokens) for s in sources], "source string, available_tokens long"))
    report = targets.select("source", "target_share", "max_repeats").join(available, "source", "left").join(sums, "source", "left").na.fill(0, ["drawn_documents", "drawn_tokens"])
    everything = Window.partitionBy()  # over the few rows of the targets
    report = report.withColumn("actual_share", F.try_divide("drawn_tokens", F.sum("drawn_tokens").over(everything))).withColumn("mean_repeats", F.try_divide("drawn_tokens", "available_tokens"))
    return chosen, report
