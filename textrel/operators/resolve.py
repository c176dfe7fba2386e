"""Key alignment between tables, resolution of mentions, similarity joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textrel.functions.similarity import edit_ratio
from textrel.functions.text import folded, normalized
from textrel.operators.components import components
from textrel.operators.skew import salted_join

#: Similarity of a block, of a match, neighbours per mention, and the lexical threshold of augmented joins.
BLOCK_SIMILARITY, MATCH_SIMILARITY, NEIGHBOURS, JOIN_SIMILARITY = 0.75, 0.95, 20, 0.85


def alignment_map(left: DataFrame, left_key: str, right: DataFrame, right_key: str) -> DataFrame:
    """(variant, canonical) of the spellings of keys found on both sides when letter case, punctuation and blanks are ignored.

    The canonical spelling is the shortest of the right side (trimmed), then the alphabetically first in lower case.
    """
    sides = left.select(F.col(left_key).alias("variant"), F.lit(False).alias("is_right")).unionByName(right.select(F.col(right_key).alias("variant"), F.lit(True).alias("is_right")))
    spellings = sides.where(F.col("variant").isNotNull()).distinct().withColumn("_n", normalized(F.col("variant"))).where("_n <> ''")
    order = F.struct(F.length(F.trim("variant")), folded(F.col("variant")), F.col("variant"))
    chosen = spellings.groupBy("_n").agg(F.min_by("variant", F.when(F.col("is_right"), order)).alias("canonical"), F.count_distinct("is_right").alias("_s")).where("_s = 2")
    return spellings.select("_n", "variant").distinct().join(chosen, "_n").where("variant <> canonical").select("variant", "canonical")


def similar_alignment_map(left: DataFrame, left_key: str, right: DataFrame, right_key: str, threshold: float = MATCH_SIMILARITY) -> DataFrame:
    """(variant, canonical) for keys of the left side that alignment_map leaves without a partner: the most similar right key whose
    normalized form has an edit ratio of at least ``threshold``, ties by name. Right keys are never rewritten, so keys that agreed
    before still do."""
    mine = left.select(F.col(left_key).alias("variant")).where(F.col("variant").isNotNull()).distinct().withColumn("_n", normalized(F.col("variant"))).where("_n <> ''")
    theirs = right.select(F.col(right_key).alias("canonical")).where(F.col("canonical").isNotNull()).distinct().withColumn("_m", normalized(F.col("canonical"))).where("_m <> ''")
    order = F.struct(F.length(F.trim("canonical")), folded(F.col("canonical")), F.col("canonical"))
    theirs = theirs.groupBy("_m").agg(F.min_by("canonical", order).alias("canonical"))
    left_over = mine.join(theirs.select(F.col("_m").alias("_n")), "_n", "left_anti")
    words = left_over.select(F.col("_n").alias("v")).unionByName(theirs.select(F.col("_m").alias("v")))
    pairs = similar_pairs(words, "v", threshold)
    both = pairs.select(F.col("a").alias("_n"), F.col("b").alias("_m"), "ratio").unionByName(pairs.select(F.col("b").alias("_n"), F.col("a").alias("_m"), "ratio"))
    best = both.join(theirs, "_m").groupBy("_n").agg(F.min_by("canonical", F.struct(-F.col("ratio"), folded(F.col("canonical")), F.col("canonical"))).alias("canonical"))
    return left_over.join(best, "_n").select("variant", "canonical")


def apply_map(df: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """The rows with ``column`` rewritten by (variant, canonical); other values stay. Hot values are spread."""
    named = mapping.select(F.col("variant").alias(column), F.col("canonical").alias("_canonical"))
    return salted_join(df, named, [column], df.columns, "left").withColumn(column, F.coalesce("_canonical", column)).select(*df.columns)


#: A part of words that more than this many words have is spread over SALTS tasks.
CROWDED_PART, SALTS = 5_000, 32


def similar_pairs(mentions: DataFrame, column: str, threshold: float = MATCH_SIMILARITY, block: int = 3) -> DataFrame:
    """Pairs a < b of distinct mentions whose edit ratio reaches ``threshold``: a, b, ratio.

    Every pair within the threshold is found: with d edits allowed, a string of n characters is cut into d + 1 parts, of
    which a similar string has one unchanged, moved by at most d places; pairs meet on such parts, by length. Distinct
    mentions only, so copies are no work; ``block`` is the least length of a mention that takes part (shorter mentions match
    when equal only, which gives no pair). A part that many words share at the same place is salted: its words are split
    over SALTS tasks, and each of them is compared with the longer words once.
    """
    words = mentions.select(F.col(column).alias("v")).where(F.length(column) >= block).distinct().withColumn("n", F.length("v"))
    edits = lambda n: F.floor(n * F.lit(1 - threshold) + F.lit(1e-9)).cast("int")
    # The longer of a pair has n characters and allows d(n) edits; its parts are looked for in words of n - d(n) .. n characters.
    d = edits(F.col("n"))
    part = lambda i: F.struct(i.alias("i"), F.floor(i * F.col("n") / (d + 1)).cast("int").alias("at"), F.floor((i + 1) * F.col("n") / (d + 1)).cast("int").alias("to"))
    parts = words.select(F.col("v").alias("long"), "n", F.explode(F.transform(F.sequence(F.lit(0), d), part)).alias("p"))
    parts = parts.select("long", "n", F.col("p.i").alias("i"), F.expr("substring(long, p.at + 1, p.to - p.at)").alias("s"))
    lengths = words.groupBy("n").agg(F.count("*").alias("_c")).select(F.col("n").alias("m"))
    longer = lengths.select("m").withColumn("d", edits(F.col("m"))).withColumn("k", F.explode(F.sequence(F.col("m") - F.col("d"), F.col("m"))))
    targets = words.join(F.broadcast(longer), F.col("n") == F.col("k")).select(F.col("v").alias("short"), "m", "d", F.col("n").alias("k"))
    spots = targets.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("d"))))
    spots = spots.withColumn("at", F.floor(F.col("i") * F.col("m") / (F.col("d") + 1)).cast("int")).withColumn("len", F.floor((F.col("i") + 1) * F.col("m") / (F.col("d") + 1)).cast("int") - F.col("at"))
    first = F.greatest(F.lit(0), F.col("at") - F.col("d"))
    last = F.least(F.col("at") + F.col("d"), F.col("k") - F.col("len"))
    spots = spots.where(last >= first).select("short", F.col("m").alias("n"), "i", F.explode(F.expr("transform(sequence(greatest(0, at - d), least(at + d, k - len)), x -> substring(short, x + 1, len))")).alias("s")).distinct()
    at = ["n", "i", "s"]
    crowded = spots.groupBy(*at).count().where(F.col("count") > CROWDED_PART).select(*at, F.lit(SALTS).alias("_salts"))
    salts = F.coalesce("_salts", F.lit(1))
    spots = spots.join(crowded, at, "left").withColumn("_salt", F.pmod(F.xxhash64("short"), salts).cast("int")).drop("_salts")
    parts = parts.join(crowded, at, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    met = parts.join(spots, [*at, "_salt"]).where("long <> short").select(F.least("long", "short").alias("a"), F.greatest("long", "short").alias("b"))
    return met.withColumn("ratio", edit_ratio(F.col("a"), F.col("b"))).where(F.col("ratio") >= threshold).distinct()


def resolved_by_type(mentions: DataFrame, threshold: float = MATCH_SIMILARITY) -> DataFrame:
    """Mentions of all tables resolved per semantic type, so that types never mix: semantic_type, key (trimmed, lower case), canonical
    (the longest similar mention, then the alphabetically last). ``mentions`` has semantic_type and value. Types are few; each is
    resolved over all its tables at once, and mentions without a similar one stand for themselves."""
    tagged = mentions.where(F.trim("value") != "").select("semantic_type", F.lower(F.trim("value")).alias("value")).distinct()
    mark = F.concat_ws("\u0001", "semantic_type", "value")
    out = None
    for t in sorted(r[0] for r in tagged.select("semantic_type").distinct().collect() if r[0] is not None):  # the types of a schema
        pairs = similar_pairs(tagged.where(F.col("semantic_type") == t), "value", threshold)
        one = pairs.select(F.concat_ws("\u0001", F.lit(t), "a").alias("a"), F.concat_ws("\u0001", F.lit(t), "b").alias("b"))
        out = one if out is None else out.unionByName(one)
    if out is None:
        return tagged.select("semantic_type", F.col("value").alias("key"), F.col("value").alias("canonical"))
    forms = canonical_forms(cluster_labels(out)).select("mention", "canonical")
    named = tagged.withColumn("mention", mark).join(forms, "mention", "left")
    return named.select("semantic_type", F.col("value").alias("key"), F.coalesce(F.substring_index("canonical", "\u0001", -1), "value").alias("canonical"))


def cluster_labels(pairs: DataFrame) -> DataFrame:
    """(mention, cluster): the smallest mention reachable over the pairs (a, b), for every mention in a pair."""
    return components(pairs).select(F.col("node").alias("mention"), F.col("label").alias("cluster"))


def canonical_forms(labels: DataFrame) -> DataFrame:
    """Per cluster: mention, canonical (the longest mention, then the alphabetically last), confidence (1 for one mention, else 0.7)."""
    best = labels.groupBy("cluster").agg(F.max_by("mention", F.struct(F.length("mention"), F.col("mention"))).alias("canonical"), F.count("*").alias("_n"))
    return labels.join(best, "cluster").select("mention", "canonical", F.when(F.col("_n") == 1, F.lit(1.0)).otherwise(F.lit(0.7)).alias("confidence"))


def canonical_map(forms: DataFrame) -> DataFrame:
    """Lookup by trimmed lower-case mention: key, canonical (of mentions that share a key, the longest canonical form)."""
    return forms.groupBy(F.lower(F.trim("mention")).alias("key")).agg(F.max_by("canonical", F.struct(F.length("canonical"), F.col("canonical"))).alias("canonical"))


def mentions_of(rows: DataFrame, row: str, columns: dict[str, str]) -> DataFrame:
    """Non-blank cells as mentions: row, column_name, semantic_type, value. ``columns`` maps a column to its semantic type."""
    types = F.create_map(*[x for c, t in columns.items() for x in (F.lit(c), F.lit(t))])
    long = rows.select(row, *[F.col(c).cast("string").alias(c) for c in columns]).unpivot([row], list(columns), "column_name", "value").where(F.trim("value") != "")
    return long.select(row, "column_name", F.element_at(types, F.col("column_name")).alias("semantic_type"), "value")


#: Vectors of one matrix of the queries and of one matrix of all vectors.
QUERY_ROWS, VECTOR_ROWS = 512, 4096


def _matrices(df: DataFrame, key: str, column: str, rows: int) -> DataFrame:
    """Vectors of unit length gathered to matrices of up to ``rows``: ids, dim, data (doubles, row by row). Zero vectors and nulls are
    left out. A matrix is filled within a partition, so nothing is shuffled."""

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids: dict[int, list] = {}
        held: dict[int, list] = {}

        def packed(d: int) -> pd.DataFrame:
            out = pd.DataFrame({"ids": [ids.pop(d)], "dim": [d], "data": [np.array(held.pop(d)).tobytes()]})
            return out

        for b in batches:
            for i, v in zip(b["_id"], b["_v"]):
                a = np.asarray(v, dtype=np.float64)
                length = float(np.sqrt((a * a).sum())) if len(a) else 0.0
                if not length > 0 or not np.isfinite(length):
                    continue
                ids.setdefault(len(a), []).append(i)
                held.setdefault(len(a), []).append(a / length)
                if len(ids[len(a)]) == rows:
                    yield packed(len(a))
        for d in list(ids):
            yield packed(d)

    some = df.where(F.col(key).isNotNull() & F.col(column).isNotNull()).select(F.col(key).cast("bigint").alias("_id"), F.col(column).cast("array<double>").alias("_v"))
    return some.mapInPandas(gather, "ids array<long>, dim int, data binary")


def nearest_vectors(queries: DataFrame, vectors: DataFrame, k: int, query_id: str = "vec_id", vector_id: str = "vec_id", column: str = "embedding", parts: int = 64) -> DataFrame:
    """The k vectors of highest cosine to each query, other than itself: query_id, vec_id, cosine, rank. Ties by vec_id.

    Exact: both sides become matrices; the queries' are copied to ``parts`` groups, each matrix of all vectors goes to one
    group, and their product gives the k best of each query per pair of matrices, which are cut to k before and after the
    final shuffle. Vectors are moved once, queries ``parts`` times. Zero vectors, nulls and vectors of another length than
    the query's have no part in it.
    """
    q = _matrices(queries, query_id, column, QUERY_ROWS).select(F.col("ids").alias("q_ids"), F.col("dim").alias("dim"), F.col("data").alias("q_data"))
    q = q.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    v = _matrices(vectors, vector_id, column, VECTOR_ROWS).withColumn("_part", F.pmod(F.xxhash64("ids"), F.lit(parts)).cast("int"))

    def product(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for ids, dim, data, q_ids, q_data in b[["ids", "dim", "data", "q_ids", "q_data"]].itertuples(index=False):
                ids, q_ids = np.asarray(ids), np.asarray(q_ids)
                scores = np.frombuffer(q_data).reshape(-1, dim) @ np.frombuffer(data).reshape(-1, dim).T
                scores[q_ids[:, None] == ids[None, :]] = -np.inf
                least = np.partition(scores, -k, axis=1)[:, -k] if len(ids) > k else np.full(len(q_ids), -np.inf)
                rows, cols = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))  # ties at the border stay for the ranking
                yield pd.DataFrame({"query_id": q_ids[rows], "vec_id": ids[cols], "cosine": scores[rows, cols]})

    scored = v.join(q.hint("shuffle_hash"), ["dim", "_part"]).mapInPandas(product, "query_id long, vec_id long, cosine double")
    order = [F.desc("cosine"), F.col("vec_id")]
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k).select("query_id", "vec_id", "cosine", "rank")


def augment_keys(documents: DataFrame, key: str, queries: DataFrame, query_key: str, threshold: float = JOIN_SIMILARITY, k: int = 3) -> DataFrame:
    """Rows of ``documents`` plus copies under similar query keys, so that an exact join finds them too.

    For each distinct query key, the ``k`` most similar other document keys (edit ratio of at least ``threshold``, ties by
    key) give copies whose key is the query's. Copies are marked by is_augmented.
    """
    left = documents.select(F.col(key).alias("v")).where(F.col("v").isNotNull()).distinct()
    right = queries.select(F.col(query_key).alias("v")).where(F.col("v").isNotNull()).distinct()
    pairs = similar_pairs(left.unionByName(right).distinct(), "v", threshold)
    both = pairs.select(F.col("a").alias("doc_key"), F.col("b").alias("query_key"), "ratio").unionByName(pairs.select(F.col("b").alias("doc_key"), F.col("a").alias("query_key"), "ratio"))
    usable = both.join(left.withColumnRenamed("v", "doc_key"), "doc_key", "left_semi").join(right.withColumnRenamed("v", "query_key"), "query_key", "left_semi")
    top = usable.withColumn("_r", F.row_number().over(Window.partitionBy("query_key").orderBy(F.desc("ratio"), "doc_key"))).where(F.col("_r") <= k)
    copies = documents.join(top.select(F.col("doc_key").alias(key), "query_key"), key).withColumn(key, F.col("query_key")).select(*documents.columns)
    return documents.withColumn("is_augmented", F.lit(False)).unionByName(copies.withColumn("is_augmented", F.lit(True)))


def merge_batches(batches: list[DataFrame], key: str, column: str) -> DataFrame:
    """Column batches of extracted records joined by place: for each key, the n-th records of all batches become one map; keys of
    earlier batches win. Batches of fewer records leave the keys of theirs out."""
    merged = None
    for b in batches:
        part = b.select(key, F.posexplode(column).alias("_p", "_m"))
        if merged is None:
            merged = part
            continue
        both = merged.join(part.withColumnRenamed("_m", "_n"), [key, "_p"], "full")
        empty = F.create_map().cast("map<string,string>")
        mine, more = F.coalesce("_m", empty), F.coalesce("_n", empty)
        merged = both.select(key, "_p", F.map_concat(mine, F.map_filter(more, lambda k, _: ~F.map_contains_key(mine, k))).alias("_m"))
    return merged.select(key, F.col("_p").alias("position"), F.col("_m").alias("record"))
