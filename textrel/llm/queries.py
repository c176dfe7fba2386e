"""Named queries of the operators for training data; ORACLES holds their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textrel.functions.text import is_missing, match_key
from textrel.llm.garbled import find_garbled, find_lost_marks, pair_counts
from textrel.llm.mixing import Source, mix_sources, water_fill
from textrel.llm.packing import fill_report, pack_documents
from textrel.llm.pieces import split_texts
from textrel.llm.sentences import learn, sentence_units
from textrel.llm.survivors import sortable, surviving_values, tokens_of
from textrel.llm.tokens import token_count
from textrel.llm.variants import pairs_of, variant_groups_of
from textrel.operators.skew import salted_join
from textrel.session import checkpointed, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under the name of its function, with the SQL it is checked against."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _names_and_chunks(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    player = table(spark, folder, "player").select(F.lit("player").alias("table_name"), F.col("id").cast("string").alias("record_key"), F.inline(F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(c).alias("value")) for c in ("name", "college")])))
    chunks = table(spark, folder, "raw_chunks").select(F.lit("raw_chunks").alias("table_name"), F.col("chunk_id").alias("record_key"), F.lit("content").alias("field_name"), F.col("content").alias("value"))
    return player, chunks


def _garbled(spark: SparkSession, folder: str) -> DataFrame:
    """Damaged values of players' names and colleges and of chunks, against the pairs of all documents."""
    model = pair_counts(table(spark, folder, "documents"), "text")
    player, chunks = _names_and_chunks(spark, folder)
    return find_garbled(player.unionByName(chunks), "value", model)


@query()
def p1_found(spark, folder):
    return _garbled(spark, folder).select("table_name", "record_key", "field_name").distinct()


@query()
def p1_restored(spark, folder):
    """The damaged values with their text as it was, where that can be known."""
    return _garbled(spark, folder).select("table_name", "record_key", "field_name", "restored", "partly_restored", "encodings")


@query()
def p1_lost_marks(spark, folder):
    """Values in which question marks stand for letters that an encoding lacked: a loss of another kind than p1_found's."""
    player, chunks = _names_and_chunks(spark, folder)
    found = find_lost_marks(player, "value", names=True).unionByName(find_lost_marks(chunks, "value"))
    return found.select("table_name", "record_key", "field_name").distinct()


def _chunks(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "raw_chunks").withColumn("table_name", F.split_part("doc_id", F.lit("/"), F.lit(1)))


@query("""SELECT chunk_id FROM raw_chunks JOIN chunk_limits ON table_name = split_part(doc_id, '/', 1) WHERE length(content) > max_chars""")
def p4_found(spark, folder):
    """Texts that their boundary tables show to be too long."""
    rows = _chunks(spark, folder).select("chunk_id", "table_name", "content")
    pieces = split_texts(rows, "chunk_id", "content", table(spark, folder, "chunk_limits"), content=False)
    return pieces.where("piece_no = 0 AND n_chars > max_chars").select("chunk_id")


@query()
def p4_pieces(spark, folder):
    """All chunks as pieces within the limits. chunk_index orders the pieces of a document: the old index, then the piece."""
    chunks = _chunks(spark, folder).select("chunk_id", "table_name", "content", "doc_id", F.col("chunk_index").alias("old_index"))
    pieces = split_texts(chunks, "chunk_id", "content", table(spark, folder, "chunk_limits"), keep=("doc_id", "old_index"))
    return pieces.select("chunk_id", "doc_id", (F.col("old_index").cast("bigint") * (1 << 20) + F.col("piece_no")).alias("chunk_index"), "piece_no", "start", "end", "content")


@query("""WITH c AS (SELECT chunk_id, doc_id, content, coalesce(length(content), 0) AS n, max_chars FROM raw_chunks LEFT JOIN chunk_limits ON table_name = split_part(doc_id, '/', 1))
SELECT chunk_id, CAST(n AS BIGINT) AS n_chars, true AS covered, n > max_chars AS is_split, true AS within_limit, true AS overlaps, content AS rejoined FROM c""")
def p4_rejoined(spark, folder):
    """Each chunk put together again from its pieces, and whether they cover it, keep to the limit, and share what they should."""
    limits = table(spark, folder, "chunk_limits")
    pieces = split_texts(_chunks(spark, folder).select("chunk_id", "table_name", "content"), "chunk_id", "content", limits, keep=("table_name",)).join(F.broadcast(limits.select("table_name", "overlap_chars")), "table_name", "left")
    each = F.struct("piece_no", "start", "end", "content")
    p = F.array_sort(F.collect_list(each))
    one = pieces.groupBy("chunk_id", "n_chars", "max_chars", "overlap_chars").agg(p.alias("p"))  # the pieces of one chunk
    steps = F.transform(F.sequence(F.lit(1), F.size("p") - 1), lambda i: F.get("p", i - 1).end - F.get("p", i).start)
    seams = F.when(F.size("p") > 1, steps).otherwise(F.array().cast("array<bigint>"))
    fresh = F.transform("p", lambda x, i: F.when(i == 0, x.content).otherwise(F.substr(x.content, (F.get("p", i - 1).end - x.start + 1).cast("int"))))
    covered = (F.get("p", 0).start == 0) & (F.element_at("p", -1).end == F.col("n_chars")) & F.forall(seams, lambda s: s >= 0)
    return one.select("chunk_id", "n_chars", covered.alias("covered"), (F.size("p") > 1).alias("is_split"), F.forall("p", lambda x: F.coalesce(F.char_length(x.content), F.lit(0)) <= F.greatest("max_chars", F.lit(0))).alias("within_limit"), F.forall(seams, lambda s: s == F.col("overlap_chars")).alias("overlaps"), F.when(F.get("p", 0).content.isNotNull(), F.array_join(fresh, "")).alias("rejoined"))


def _variants(spark: SparkSession, folder: str) -> DataFrame:
    return variant_groups_of({t: table(spark, folder, t) for t in ("player", "owner", "team")})


@query()
def p5_found(spark, folder):
    return pairs_of(_variants(spark, folder), ("table_name", "entity_id"))


@query()
def p5_groups(spark, folder):
    """One row per id with the smallest id of the same person, organisation or club."""
    return _variants(spark, folder)


def _records(spark: SparkSession, folder: str) -> DataFrame:
    """The records of all results in which an entity is named, one row each, with the priority of their result."""
    trust = F.broadcast(table(spark, folder, "extractor_trust"))  # a fixed table
    results = table(spark, folder, "extraction_result").join(trust, "extractor", "left")
    r = results.select("result_id", "table_name", "chunk_id", (-F.col("trust_rank")).alias("tier"), sortable(-F.col("trust_rank"), F.unix_micros("extracted_at"), F.col("result_id")).alias("priority"), F.explode("records").alias("record"))
    name = F.when(F.col("table_name") == "team", F.try_element_at("record", F.lit("team_name"))).otherwise(F.try_element_at("record", F.lit("name")))
    return r.where(F.col("record").isNotNull()).withColumn("_name", name).where(~is_missing(F.col("_name"))).select("*", match_key(F.col("_name")).alias("entity_key")).drop("_name")


def _survivors(spark: SparkSession, folder: str, rule: str) -> DataFrame:
    records = _records(spark, folder)
    entity = ["table_name", "entity_key"]
    several = records.groupBy(*entity).agg(F.count("*").alias("n")).where("n > 1").drop("n")
    records = salted_join(records, several, entity, ["result_id"])
    fields = records.select(*entity, F.col("result_id").cast("string").alias("winner_id"), "priority", "tier", F.explode("record").alias("field_name", "value")).where((F.col("field_name") != "row_id") & ~is_missing(F.col("value")))
    fields = fields.select(*entity, "field_name", "value", tokens_of(F.col("value")).alias("tokens"), "priority", F.lit(1.0).alias("weight"), "winner_id", "tier")
    rows = records.select(*entity, F.try_element_at("record", F.lit("row_id")).alias("row_id")).where(~is_missing(F.col("row_id"))).distinct()
    ids = F.array_sort(F.array_distinct(F.filter("chunk_ids", lambda x: x.isNotNull() & (F.trim(x) != ""))))
    proved = table(spark, folder, "row_provenance").select("row_id", F.coalesce(ids, F.array().cast("array<string>")).alias("tokens"), F.unix_micros("created_at").alias("made"))
    size = F.size("tokens")
    lists = rows.join(proved, "row_id").select(*entity, F.lit("chunk_ids").alias("field_name"), F.array_join("tokens", " ").alias("value"), "tokens", F.concat(sortable(size, F.col("made")), "row_id").alias("priority"), size.cast("double").alias("weight"), F.col("row_id").alias("winner_id"), size.alias("tier"))
    if rule == "votes":  # every record has a say, however far it is trusted
        fields, lists = fields.drop("tier"), lists.drop("tier")
    return surviving_values(fields.unionByName(lists), [*entity, "field_name"], rule)


@query("""WITH r AS (SELECT result_id, table_name, extracted_at, trust_rank, unnest(records) AS record FROM extraction_result LEFT JOIN extractor_trust USING (extractor)),
e AS (SELECT *, lower(trim(regexp_replace(CASE WHEN table_name = 'team' THEN record['team_name'] ELSE record['name'] END, '\\s+', ' ', 'g'))) AS entity_key FROM r WHERE record IS NOT NULL),
n AS (SELECT *, count(*) OVER (PARTITION BY table_name, entity_key) AS n FROM e WHERE entity_key NOT IN ('', 'n/a', 'none', 'null', 'unknown')),
f AS (SELECT table_name, entity_key, result_id, trust_rank, extracted_at, unnest(map_entries(record)) AS x FROM n WHERE n > 1),
w AS (SELECT table_name, entity_key, x.key AS field_name, first(CAST(result_id AS VARCHAR) ORDER BY trust_rank ASC NULLS LAST, extracted_at DESC NULLS LAST, result_id DESC) AS winner_id
  FROM f WHERE x.key <> 'row_id' AND lower(trim(regexp_replace(x.value, '\\s+', ' ', 'g'))) NOT IN ('', 'n/a', 'none', 'null', 'unknown') GROUP BY 1, 2, 3),
c AS (SELECT DISTINCT table_name, entity_key, x.value AS row_id FROM f WHERE x.key = 'row_id'),
p AS (SELECT c.table_name, c.entity_key, c.row_id, q.created_at, len(list_distinct(list_filter(q.chunk_ids, lambda y: y IS NOT NULL AND trim(y) <> ''))) AS k FROM c JOIN row_provenance q USING (row_id))
SELECT * FROM w UNION ALL SELECT table_name, entity_key, 'chunk_ids', first(row_id ORDER BY k DESC, created_at DESC NULLS LAST, row_id DESC) FROM p GROUP BY 1, 2""")
def p6_found(spark, folder):
    return _survivors(spark, folder, "trust").select("table_name", "entity_key", "field_name", "winner_id")


@query()
def p6_entities(spark, folder):
    """One record per entity with several records: its fields by trust, and the chunks that prove it."""
    kept = _survivors(spark, folder, "trust")
    fields = F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("field_name") != "chunk_ids", F.struct("field_name", "value")))))
    sources = F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("field_name") != "chunk_ids", F.struct("field_name", "winner_id")))))
    chunks = F.max(F.when(F.col("field_name") == "chunk_ids", F.split("value", " ")))
    return kept.groupBy("table_name", "entity_key").agg(fields.alias("record"), sources.alias("from_results"), chunks.alias("chunk_ids"))


@query()
def p6_votes(spark, folder):
    """The values closest to the consensus of all records, each record one vote."""
    return _survivors(spark, folder, "votes").where("field_name != 'chunk_ids'").select("table_name", "entity_key", "field_name", "value", "winner_id", "n_values", "n_records")


def _sizes(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", F.lower(F.trim("source")).alias("source"), token_count(F.col("text")).alias("n_tokens"))


@query()
def p8_containers(spark, folder):
    """All documents in containers of each capacity."""
    return pack_documents(_sizes(spark, folder).drop("source"), table(spark, folder, "pack_specs"))


@query()
def p8_fill(spark, folder):
    """How full the containers of each capacity are."""
    specs = table(spark, folder, "pack_specs")
    return fill_report(pack_documents(_sizes(spark, folder).drop("source"), specs), specs)


def _mix_of_budget(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    sizes = checkpointed(_sizes(spark, folder))
    total = sizes.agg(F.sum("n_tokens")).first()[0] or 0
    return mix_sources(sizes, table(spark, folder, "mix_targets"), float(total))


@query()
def p9_mix(spark, folder):
    """The documents to draw, with repeats, for as many tokens as all documents have: sources that cannot give their share within
    their caps give all they can, and the others take over what is lacking in proportion."""
    return _mix_of_budget(spark, folder)[0]


@query()
def p9_shares(spark, folder):
    """Shares reached by that mixture."""
    return _mix_of_budget(spark, folder)[1]


@query()
def p9_mix_exact(spark, folder):
    """The documents to draw for the largest mixture in which no cap keeps a source from its exact share."""
    return mix_sources(_sizes(spark, folder), table(spark, folder, "mix_targets"))[0]


@query()
def p9_shares_exact(spark, folder):
    """Shares reached by that mixture."""
    return mix_sources(_sizes(spark, folder), table(spark, folder, "mix_targets"))[1]


@query("""WITH s AS (SELECT source, target_share AS w, CAST(max_repeats AS DOUBLE) * coalesce(n, 0) AS room FROM mix_targets LEFT JOIN (SELECT lower(trim(source)) AS source, sum(length(text)) AS n FROM documents GROUP BY 1) USING (source)),
t AS (SELECT CAST(sum(length(text)) AS DOUBLE) AS total FROM documents), a AS (SELECT *, row_number() OVER (ORDER BY room / w, source) AS k FROM s WHERE w > 0 AND room > 0),
c AS (SELECT a.*, coalesce(sum(room) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used, sum(w) OVER (ORDER BY k DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS open FROM a),
l AS (SELECT (total - used) / open AS level FROM c, t WHERE (total - used) / open <= room / w ORDER BY k LIMIT 1)
SELECT source, round(CASE WHEN w > 0 AND room > 0 THEN least(room, coalesce((SELECT level FROM l), 1e300) * w) ELSE 0 END, 2) AS allotted FROM s""")
def p9_allotted(spark, folder):
    """Characters allotted to each source when as many are wanted as all documents have (the level to which all open sources fill up,
    found by SQL from the sources in order of their room)."""
    chars = table(spark, folder, "documents").select(F.lower(F.trim("source")).alias("source"), F.coalesce(F.char_length("text"), F.lit(0)).cast("bigint").alias("n"))
    total = chars.agg(F.sum("n")).first()[0] or 0
    sums = {r["source"]: r["n"] for r in chars.join(F.broadcast(table(spark, folder, "mix_targets").select("source")), "source").groupBy("source").agg(F.sum("n").alias("n")).collect()}  # a row per target
    sources = [Source(r["source"], r["target_share"], sums.get(r["source"], 0), r["max_repeats"]) for r in table(spark, folder, "mix_targets").collect()]
    return spark.createDataFrame([(n, round(x, 2)) for n, x in water_fill(sources, float(total)).items()], "source string, allotted double")


@query()
def p10_found(spark, folder):
    documents = table(spark, folder, "documents").select("doc_id", "text", "lang")
    return sentence_units(documents, learn(documents, lang="lang"), lang="lang").select("doc_id", "sent_start", "sent_end")
