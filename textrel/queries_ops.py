"""Named queries of the corpus, store, index, resolution, extraction, evaluation and planning operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from textrel.functions import similarity as sim
from textrel.functions import text as tx
from textrel.operators import attributes as ai
from textrel.operators import chunks as ch
from textrel.operators import evaluate as ev
from textrel.operators import extract as ex
from textrel.operators import resolve as rs
from textrel.operators import store as st
from textrel.plans import delta as dl
from textrel.plans import rewrite as rw
from textrel.plans.engine import Engine
from textrel.plans.lattice import build, name_variations
from textrel.plans.profile import Predicate, profile
from textrel.queries import query
from textrel.queries_sql import STATEMENTS
from textrel.session import table
from textrel.streaming.ingest import windowed_counts

KEYWORDS = ["points", "stake", "arena", "overall pick", "percent"]
_LOW = "lower(replace({0}, 'İ', 'i'))"
_NORM = "trim(regexp_replace(regexp_replace(lower(replace({0}, 'İ', 'i')), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
_SQUEEZE = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"
_MISSING = "('', 'n/a', 'none', 'null', 'unknown')"


# Corpus


@query("SELECT doc_id, CAST(i // 1800 AS INTEGER) AS chunk_index, substring(text, CAST(i + 1 AS BIGINT), 2000) AS content FROM (SELECT doc_id, text, unnest(range(0, length(text), 1800)) AS i FROM documents WHERE length(text) > 0)")
def chunk_stride(spark, folder):
    return ch.stride_chunks(table(spark, folder, "documents"), "doc_id", "text")


@query("""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(0, len(w), 500)) AS i FROM w WHERE len(w) > 0)
SELECT doc_id, CAST(i // 500 AS INTEGER) AS chunk_index, array_to_string(w[i + 1 : i + 500], ' ') AS content, CAST(len(w[i + 1 : i + 500]) AS INTEGER) AS n_words FROM i""")
def chunk_word_windows(spark, folder):
    return ch.word_windows(table(spark, folder, "documents"), "doc_id", "text")


@query()
def chunk_recursive(spark, folder):
    return ch.recursive_chunks(table(spark, folder, "documents"), "doc_id", "text").withColumn("chunk_id", ch.chunk_id(F.col("doc_id"), F.col("chunk_index")))


@query("WITH once AS (SELECT doc_id, chunk_index, min(content) AS content FROM raw_chunks GROUP BY 1, 2) SELECT doc_id, chunk_index, coalesce(right(lag(content) OVER (PARTITION BY doc_id ORDER BY chunk_index), 200), '') AS lead FROM once")
def chunk_overlap_lead(spark, folder):
    once = table(spark, folder, "raw_chunks").groupBy("doc_id", "chunk_index").agg(F.min("content").alias("content"))
    return ch.with_lead(once, "doc_id", "chunk_index", "content").select("doc_id", "chunk_index", "lead")


@query("WITH old AS (SELECT * FROM raw_chunks WHERE created_at < TIMESTAMPTZ '2025-01-01 00:00:00+00'), fresh AS (SELECT * FROM raw_chunks WHERE created_at >= TIMESTAMPTZ '2025-01-01 00:00:00+00') SELECT doc_id, chunk_index, min(content) AS content FROM fresh WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.doc_id = fresh.doc_id AND old.chunk_index = fresh.chunk_index) GROUP BY 1, 2")
def chunk_sink_new(spark, folder):
    chunks = table(spark, folder, "raw_chunks")
    cut = F.lit("2025-01-01 00:00:00").cast("timestamp")
    return ch.new_chunks(chunks.where(F.col("created_at") < cut), chunks.where(F.col("created_at") >= cut).select("doc_id", "chunk_index", "content"))


@query("SELECT doc_id, chunk_index, chunk_id FROM raw_chunks ORDER BY doc_id, chunk_index, chunk_id LIMIT 100")
def chunk_scan_ordered(spark, folder):
    return table(spark, folder, "raw_chunks").select("doc_id", "chunk_index", "chunk_id").orderBy("doc_id", "chunk_index", "chunk_id").limit(100)


@query("SELECT chunk_id, doc_id, content FROM raw_chunks WHERE chunk_id IN (SELECT unnest(chunk_ids) FROM row_provenance)")
def chunk_lookup(spark, folder):
    ids = table(spark, folder, "row_provenance").select(F.explode("chunk_ids").alias("chunk_id"))
    return ch.chunks_by_id(table(spark, folder, "raw_chunks"), ids).select("chunk_id", "doc_id", "content")


@query("SELECT chunk_id FROM raw_chunks WHERE contains(lower(content), 'stake for') OR contains(lower(content), 'ph.d.')")
def chunk_prefilter(spark, folder):
    return table(spark, folder, "raw_chunks").where(ch.any_literal(F.col("content"), ["stake for", "Ph.D."])).select("chunk_id")


@query(f"SELECT doc_id FROM documents WHERE regexp_matches(text, '{ch.keyword_pattern(KEYWORDS)}')")
def sieve_keywords(spark, folder):
    return ch.sieve(table(spark, folder, "documents"), "text", KEYWORDS).select("doc_id")


@query("SELECT doc_id, " + ", ".join(f"regexp_matches(text, '{p}') AS has_{k}" for k, p in ch.PATTERNS.items()) + " FROM documents")
def sieve_patterns(spark, folder):
    return table(spark, folder, "documents").select("doc_id", *[F.col("text").rlike(p).alias(f"has_{k}") for k, p in ch.PATTERNS.items()])


@query("""WITH t AS (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+')) AS term FROM documents), c AS (SELECT term, count(*) AS n_rows FROM t WHERE length(term) >= 4 GROUP BY term)
SELECT term, n_rows FROM c WHERE n_rows >= greatest(2, (SELECT ceil(count(*) * 0.1) FROM documents)) ORDER BY n_rows DESC, term LIMIT 60""")
def keyword_top_terms(spark, folder):
    return ch.keyword_counts(table(spark, folder, "documents"), "text")


@query("""SELECT id FROM player WHERE age IS NOT NULL AND age >= 30 AND nationality IS NOT NULL AND lower(nationality) = 'american' AND draft_year IS NOT NULL AND draft_year != 0""")
def record_predicates(spark, folder):
    p = table(spark, folder, "player")
    test = ch.matches_predicate(F.col("age").cast("string"), ">=", "30") & ch.matches_predicate(F.col("nationality"), "=", "American") & ch.matches_predicate(F.col("draft_year").cast("string"), "!=", "0")
    return p.where(test).select("id")


# Functions


@query(f"SELECT id, {_NORM.format('college')} AS norm, trim(regexp_replace(replace({_LOW.format('college')}, ',', ''), '\\s+', ' ', 'g')) AS match_norm FROM player")
def text_normalized(spark, folder):
    return table(spark, folder, "player").select("id", tx.normalized(F.col("college")).alias("norm"), tx.normalized_for_match(F.col("college")).alias("match_norm"))


@query("SELECT DISTINCT k, trim(regexp_replace(regexp_replace(lower(regexp_replace(k, '([a-z0-9])([A-Z])', '\\1_\\2', 'g')), '[\\s\\-]+', '_', 'g'), '_+', '_', 'g'), '_') AS canon FROM (SELECT unnest(schema_keys) AS k FROM extraction_result)")
def attribute_canonical(spark, folder):
    keys = table(spark, folder, "extraction_result").select(F.explode("schema_keys").alias("k")).distinct()
    return keys.select("k", tx.canonical_attribute(F.col("k")).alias("canon"))


@query("SELECT id, list_filter(list_transform(string_split(replace(nationality, ';', '||'), '||'), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '') AS parts FROM player WHERE nationality IS NOT NULL")
def multi_value_parts(spark, folder):
    rows = table(spark, folder, "player").where("nationality IS NOT NULL")
    return rows.select("id", tx.multi_values(F.regexp_replace("nationality", ";", "||")).alias("parts"))


@query(f"SELECT id, CASE WHEN lower({_SQUEEZE.format('gdp')}) NOT IN {_MISSING} THEN gdp END AS gdp FROM city")
def missing_to_null(spark, folder):
    return table(spark, folder, "city").select("id", tx.missing_to_null(F.col("gdp")).alias("gdp"))


@query("SELECT id, TRY_CAST(regexp_replace(trim(population), '[,%]', '', 'g') AS DOUBLE) AS population, TRY_CAST(replace(trim(area), ',', '') AS DOUBLE) AS area FROM city")
def numeric_coercion(spark, folder):
    return table(spark, folder, "city").select("id", tx.number_or_null(F.col("population")).alias("population"), sim.finite_number(F.col("area")).alias("area"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def json_property(spark, folder):
    return table(spark, folder, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("SELECT doc_id, CASE WHEN coalesce(length(text), 0) = 0 THEN 0 ELSE greatest(1, CAST(floor(length(text) / 4) AS BIGINT)) END AS tokens FROM documents")
def token_estimate(spark, folder):
    return table(spark, folder, "documents").select("doc_id", tx.token_estimate(F.col("text")).alias("tokens"))


@query("SELECT chunk_id, split_part(doc_id, '/', 1) AS source_table, regexp_extract(doc_id, '([^/]+)\\.txt$', 1) AS stem, md5(chunk_id || ':' || split_part(doc_id, '/', 1)) AS cache_key FROM raw_chunks")
def chunk_names(spark, folder):
    t = F.split_part("doc_id", F.lit("/"), F.lit(1))
    return table(spark, folder, "raw_chunks").select("chunk_id", t.alias("source_table"), F.regexp_extract("doc_id", r"([^/]+)\.txt$", 1).alias("stem"), F.md5(F.concat_ws(":", "chunk_id", t)).alias("cache_key"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 6) AS length FROM embeddings")
def vector_norm(spark, folder):
    return table(spark, folder, "embeddings").select("vec_id", F.round(sim.norm(sim.vector(F.col("embedding"))), 6).alias("length"))


@query()
def canonical_names(spark, folder):
    return table(spark, folder, "owner").where("name IS NOT NULL").select("id", sim.canonical_name(F.col("name")).alias("canonical"))


@query()
def lexical_ratio(spark, folder):
    """Edit ratio and matching-block ratio of all similar but different spellings of owners (brute force checks both in the tests)."""
    names = table(spark, folder, "owner").select(F.lower(F.trim("name")).alias("name"))
    return rs.similar_pairs(names, "name", 0.85).select("a", "b", F.col("ratio").alias("edit_ratio"), sim.gestalt_ratio("a", "b").alias("ratio"))


# Store


@query("SELECT user_id, first(event_type ORDER BY event_id) FILTER (WHERE event_type IS NOT NULL) AS event_type, first(value ORDER BY event_id) FILTER (WHERE value IS NOT NULL) AS value FROM events GROUP BY user_id")
def first_value_merge(spark, folder):
    return st.first_values(table(spark, folder, "events"), ["user_id"], ["event_type", "value"], "event_id")


_MERGED = """WITH o AS (SELECT *, lower(replace(trim(name), 'İ', 'i')) AS k FROM owner WHERE name IS NOT NULL AND lower(trim(regexp_replace(name, '\\s+', ' ', 'g'))) NOT IN ('', 'n/a', 'none', 'null', 'unknown')),
old AS (SELECT id, k, name, age, nationality FROM o WHERE ingested_at < TIMESTAMPTZ '2025-01-01 00:00:00+00'),
neu AS (SELECT k, first(name ORDER BY id, name) AS name, first(age ORDER BY id, age) FILTER (WHERE age IS NOT NULL) AS age, first(nationality ORDER BY id, nationality) FILTER (WHERE nationality IS NOT NULL) AS nationality
  FROM o WHERE ingested_at >= TIMESTAMPTZ '2025-01-01 00:00:00+00' GROUP BY k)
SELECT old.id, old.name, coalesce(old.age, neu.age) AS age, coalesce(old.nationality, neu.nationality) AS nationality FROM old LEFT JOIN neu USING (k)"""


def _upsert(spark, folder, known_only):
    rows = table(spark, folder, "owner").where(~tx.is_missing(F.col("name")))
    cut = F.lit("2025-01-01 00:00:00").cast("timestamp")
    old = rows.where(F.col("ingested_at") < cut).select("id", "name", "age", "nationality")
    new = rows.where(F.col("ingested_at") >= cut).select(F.col("id").alias("seen"), "name", "age", "nationality")
    return st.upsert_by_entity(old, new, "name", known_only, "seen")


@query(_MERGED + " UNION ALL SELECT CAST(NULL AS BIGINT), neu.name, neu.age, neu.nationality FROM neu WHERE k NOT IN (SELECT k FROM old)")
def upsert_coalesce(spark, folder):
    return _upsert(spark, folder, False)


@query(_MERGED)
def upsert_known_only(spark, folder):
    return _upsert(spark, folder, True)


@query("""WITH v AS (SELECT user_id, event_type AS v, count(*) AS n, min(event_id) AS f FROM events GROUP BY 1, 2), w AS (SELECT user_id, first(v ORDER BY n DESC, f, v) AS event_type FROM v GROUP BY 1)
SELECT user_id, event_type, n_rows FROM w JOIN (SELECT user_id, count(*) AS n_rows FROM events GROUP BY 1) USING (user_id)""")
def frequent_value_merge(spark, folder):
    return st.consolidate(table(spark, folder, "events"), "user_id", ["event_type"], "event_id")


@query("SELECT row_id, list_sort(list_distinct(list_filter(flatten(list(chunk_ids)), lambda x: x IS NOT NULL AND trim(x) <> ''))) AS chunk_ids FROM row_provenance GROUP BY row_id HAVING len(chunk_ids) > 0")
def provenance_merge(spark, folder):
    return st.merged_sources(table(spark, folder, "row_provenance"), "row_id", "chunk_ids")


@query("SELECT DISTINCT p.row_id, p.table_name, p.chunk_id, c.doc_id FROM (SELECT row_id, table_name, unnest(chunk_ids) AS chunk_id FROM row_provenance WHERE table_name = 'player') p LEFT JOIN raw_chunks c ON c.chunk_id = p.chunk_id WHERE trim(p.chunk_id) <> ''")
def lineage_lookup(spark, folder):
    return st.lineage(table(spark, folder, "row_provenance"), table(spark, folder, "raw_chunks"), "player")


@query("""WITH c AS (SELECT id, src, ingested_at, 'population' AS column_name FROM city WHERE population IS NOT NULL UNION ALL SELECT id, src, ingested_at, 'area' FROM city WHERE area IS NOT NULL UNION ALL SELECT id, src, ingested_at, 'gdp' FROM city WHERE gdp IS NOT NULL)
SELECT id, column_name, first(src ORDER BY ingested_at, src) AS src FROM c GROUP BY id, column_name""")
def cell_provenance(spark, folder):
    return st.cell_provenance(table(spark, folder, "city"), "id", ["population", "area", "gdp"], ["src"], "ingested_at")


@query("SELECT id, count(*) AS n_rows FROM player GROUP BY id HAVING count(*) > 1")
def duplicate_keys(spark, folder):
    return st.duplicate_keys(table(spark, folder, "player"), ["id"])


_REGISTRY_SQL = """WITH r AS (SELECT table_name, unnest(schema_keys) AS column_name, extractor, error, extracted_at, result_id FROM extraction_result)
SELECT table_name, column_name, list_sort(list_distinct(list(extractor))) AS predicate_scope, CASE WHEN bool_or(error IS NULL) THEN 'FULL' ELSE 'PARTIAL' END AS status, epoch_us(max(extracted_at)) AS last_updated,
first(result_id ORDER BY extracted_at DESC, result_id DESC) AS record_count FROM r GROUP BY 1, 2"""


def _registry(spark, folder):
    r = table(spark, folder, "extraction_result").select("table_name", F.explode("schema_keys").alias("column_name"), F.array("extractor").alias("predicate_scope"), F.when(F.col("error").isNull(), "FULL").otherwise("PARTIAL").alias("status"), F.col("extracted_at").alias("last_updated"), F.col("result_id").alias("record_count"))
    return st.apply_registry(r.limit(0), r)


@query(_REGISTRY_SQL)
def registry_merge(spark, folder):
    return _registry(spark, folder).withColumn("last_updated", F.unix_micros("last_updated"))


@query("SELECT table_name, chunk_id, CAST(max(extraction_time) AS DOUBLE) AS relevance_score FROM extraction_result WHERE extractor <> 'rules_v1' AND NOT EXISTS (SELECT 1 FROM extraction_result x WHERE x.extractor = 'rules_v1' AND x.table_name = extraction_result.table_name AND x.chunk_id = extraction_result.chunk_id) GROUP BY 1, 2")
def candidates_new(spark, folder):
    c = table(spark, folder, "extraction_result").select("extractor", "table_name", "chunk_id", F.col("extraction_time").alias("relevance_score"))
    return st.new_candidates(c.where("extractor = 'rules_v1'").drop("extractor"), c.where("extractor <> 'rules_v1'").drop("extractor"))


@query("SELECT chunk_id, md5(chunk_id || ':player') AS cache_key FROM raw_chunks WHERE chunk_id NOT IN (SELECT chunk_id FROM extraction_result WHERE table_name = 'player' AND chunk_id IS NOT NULL)")
def cache_misses(spark, folder):
    done = table(spark, folder, "extraction_result").where("table_name = 'player'").select(F.md5(F.concat_ws(":", "chunk_id", F.lit("player"))).alias("cache_key"))
    return st.not_cached(table(spark, folder, "raw_chunks").select("chunk_id"), done, "player")


@query("SELECT id, team_name, founded_year FROM team WHERE championship IS NOT NULL OR founded_year IS NULL UNION ALL SELECT id, team_name, founded_year + 1 FROM team WHERE championship IS NULL AND founded_year IS NOT NULL")
def point_update(spark, folder):
    t = table(spark, folder, "team")
    changed = t.where("championship IS NULL AND founded_year IS NOT NULL").select("id", "team_name", (F.col("founded_year") + 1).alias("founded_year"))
    return st.replace_rows(t.select("id", "team_name", "founded_year"), changed, "id")


@query("SELECT id, team_name FROM team WHERE id NOT IN (SELECT id FROM team WHERE deleted_at IS NOT NULL)")
def point_delete(spark, folder):
    t = table(spark, folder, "team")
    return st.delete_rows(t.select("id", "team_name"), t.where("deleted_at IS NOT NULL"), "id")


@query("SELECT result_id, r['name'] AS name, r['team'] AS team, TRY_CAST(r['draft_year'] AS BIGINT) AS draft_year FROM (SELECT result_id, unnest(records) AS r FROM extraction_result WHERE table_name = 'player') WHERE r IS NOT NULL")
def record_insert_typed(spark, folder):
    r = table(spark, folder, "extraction_result").where("table_name = 'player'").select("result_id", F.explode("records").alias("r")).where("r IS NOT NULL")
    return st.records_to_rows(r, "r", {"name": "string", "team": "string", "draft_year": "bigint"}, keep=("result_id",))


@query("SELECT f AS field_name, count(*) AS n_records FROM (SELECT unnest(map_entries(r)) AS e FROM (SELECT unnest(records) AS r FROM extraction_result) WHERE r IS NOT NULL) t(e), LATERAL (SELECT e.key AS f, e.value AS v) WHERE trim(v) <> '' GROUP BY 1 ORDER BY n_records DESC, field_name LIMIT 20")
def frequent_fields(spark, folder):
    """The 20 most frequent fields of all records."""
    r = table(spark, folder, "extraction_result").select(F.explode("records").alias("r")).where("r IS NOT NULL")
    return st.frequent_fields(r, "r")


@query("SELECT chunk_id, CAST(max(extraction_time) AS DOUBLE) AS relevance_score FROM extraction_result WHERE table_name = 'player' GROUP BY chunk_id ORDER BY relevance_score DESC NULLS LAST, chunk_id")
def candidates_ordered(spark, folder):
    c = table(spark, folder, "extraction_result").groupBy("table_name", "chunk_id").agg(F.max("extraction_time").alias("relevance_score"))
    return st.ordered_candidates(c, "player")


@query("""WITH f AS (SELECT bool_and(ok) AS all_full FROM (SELECT table_name, k, bool_or(error IS NULL) AS ok FROM (SELECT table_name, unnest(schema_keys) AS k, error FROM extraction_result) GROUP BY 1, 2)),
n AS (SELECT (SELECT count(DISTINCT chunk_id) FROM extraction_result) AS n_candidates, (SELECT count(DISTINCT chunk_id) FROM raw_chunks) AS n_indexed, (SELECT count(DISTINCT chunk_id) FROM raw_chunks WHERE chunk_id IN (SELECT chunk_id FROM extraction_result WHERE chunk_id IS NOT NULL)) AS n_shared)
SELECT CAST(all_full AS INTEGER) AS all_full, n_candidates, n_indexed, n_shared, all_full AND n_candidates > 0 AND n_shared > 0 AS ready FROM f, n""")
def snapshot_state(spark, folder):
    r = table(spark, folder, "extraction_result")
    return st.snapshot_state(_registry(spark, folder), r.select("chunk_id"), table(spark, folder, "raw_chunks").select("chunk_id"))


# Attribute index


def _discoveries(spark, folder):
    return table(spark, folder, "extraction_result").select("table_name", "chunk_id", F.explode("schema_keys").alias("raw_attr"))


@query("SELECT table_name, lower(k) AS attribute, list_sort(list_distinct(list(k))) AS variants, count(DISTINCT chunk_id) AS n_chunks FROM (SELECT table_name, chunk_id, unnest(schema_keys) AS k FROM extraction_result) GROUP BY 1, 2")
def index_build(spark, folder):
    return ai.build_index(_discoveries(spark, folder))


@query("SELECT table_name, k AS attribute, count(DISTINCT chunk_id) AS n_chunks FROM (SELECT table_name, chunk_id, unnest(schema_keys) AS k FROM extraction_result) GROUP BY 1, 2")
def index_coverage(spark, folder):
    return ai.coverage(ai.entries(_discoveries(spark, folder)))


@query("""WITH e AS (SELECT DISTINCT table_name, chunk_id, unnest(schema_keys) AS k FROM extraction_result), t AS (SELECT table_name, count(DISTINCT chunk_id) AS n_indexed FROM e GROUP BY 1)
SELECT table_name, k AS attribute, count(DISTINCT chunk_id) AS n_chunks, n_indexed FROM e JOIN t USING (table_name) GROUP BY table_name, k, n_indexed HAVING count(DISTINCT chunk_id) <= 0.9 * n_indexed""")
def index_selective(spark, folder):
    return ai.selective_attributes(ai.entries(_discoveries(spark, folder)), 0.9)


@query("SELECT DISTINCT chunk_id FROM (SELECT table_name, chunk_id, unnest(schema_keys) AS k FROM extraction_result) WHERE table_name = 'player' AND k IN ('college', 'draft_year') ORDER BY chunk_id LIMIT 50")
def index_chunks(spark, folder):
    wanted = [a for w in ("colege", "draft_year") for a in ai.fuzzy_attributes(w, ["name", "birth_date", "college", "draft_year", "team", "position", "nationality"], most=1)]
    return ai.chunks_for(ai.entries(_discoveries(spark, folder)), "player", wanted, ai.REPORTED_CHUNKS)


@query("SELECT DISTINCT chunk_id FROM extraction_result WHERE table_name = 'team' AND len(schema_keys) > 0 AND chunk_id IN (SELECT chunk_id FROM raw_chunks WHERE doc_id LIKE 'team/%')")
def index_candidates(spark, folder):
    candidates = table(spark, folder, "raw_chunks").where("doc_id LIKE 'team/%'").select(F.lit("team").alias("table_name"), "chunk_id")
    return ai.indexed_candidates(ai.entries(_discoveries(spark, folder)), candidates, "team")


@query("""WITH k AS (SELECT unnest(map_keys(r)) AS key FROM (SELECT unnest(records) AS r FROM extraction_result) WHERE r IS NOT NULL), c AS (SELECT key, count(*) AS n FROM k GROUP BY 1)
SELECT key, n, n / (SELECT sum(n) FROM c) AS share, n / (SELECT sum(n) FROM c) >= 0.2 AS frozen FROM c""")
def schema_key_frequencies(spark, folder):
    r = table(spark, folder, "extraction_result").select(F.explode("records").alias("r")).where("r IS NOT NULL")
    return ai.key_frequencies(r, "r")


# Resolution


_ALIGN = f"""WITH s AS (SELECT DISTINCT team AS v, false AS r FROM player WHERE team IS NOT NULL UNION SELECT DISTINCT team_name, true FROM team WHERE team_name IS NOT NULL),
n AS (SELECT v, r, {_NORM.format('v')} AS n FROM s), c AS (SELECT n, first(v ORDER BY length(trim(v)), lower(replace(v, 'İ', 'i')), v) FILTER (WHERE r) AS canonical FROM n WHERE n <> '' GROUP BY n HAVING count(DISTINCT r) = 2)
SELECT DISTINCT v AS variant, canonical FROM n JOIN c USING (n) WHERE v <> canonical"""


def _team_map(spark, folder):
    p, t = table(spark, folder, "player"), table(spark, folder, "team")
    return p, rs.alignment_map(p, "team", t, "team_name")


@query(_ALIGN)
def align_exact(spark, folder):
    return _team_map(spark, folder)[1]


@query(f"WITH m AS ({_ALIGN}) SELECT id, coalesce(canonical, team) AS team FROM player LEFT JOIN m ON team = variant")
def align_apply(spark, folder):
    p, mapping = _team_map(spark, folder)
    return rs.apply_map(p.select("id", "team"), "team", mapping)


@query()
def similar_names(spark, folder):
    """Pairs of similar spellings of owners (brute force checks it in the tests)."""
    return rs.similar_pairs(table(spark, folder, "owner").select(F.lower(F.trim("name")).alias("name")), "name", 0.85)


@query()
def mention_clusters(spark, folder):
    names = table(spark, folder, "owner").select(F.lower(F.trim("name")).alias("name"))
    return rs.canonical_map(rs.canonical_forms(rs.cluster_labels(rs.similar_pairs(names, "name", 0.85))))


@query("SELECT id, column_name, semantic_type, value FROM (SELECT id, 'name' AS column_name, 'PERSON' AS semantic_type, name AS value FROM owner UNION ALL SELECT id, 'nba_team', 'ORG', nba_team FROM owner) WHERE trim(value) <> ''")
def mentions(spark, folder):
    return rs.mentions_of(table(spark, folder, "owner"), "id", {"name": "PERSON", "nba_team": "ORG"})


@query()
def resolved_by_type(spark, folder):
    """Names of owners and players' clubs resolved per semantic type, over all tables that mention the type."""
    o, p = table(spark, folder, "owner"), table(spark, folder, "player")
    m = rs.mentions_of(o, "id", {"name": "PERSON", "nba_team": "ORG"}).unionByName(rs.mentions_of(p, "id", {"team": "ORG"}))
    return rs.resolved_by_type(m, 0.9)


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), s AS (SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(q.v, e.v) AS c FROM e q JOIN e ON q.vec_id <> e.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, vec_id) AS rank FROM s) SELECT query_id, vec_id, round(c, 5) AS cosine, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 20""")
def nearest_vectors(spark, folder):
    """The 20 nearest of all vectors for each vector whose id is divisible by 100."""
    e = table(spark, folder, "embeddings")
    return rs.nearest_vectors(e.where("vec_id % 100 = 0"), e, 20).withColumn("cosine", F.round("cosine", 5))


@query()
def semantic_join(spark, folder):
    """Players joined with teams by exact name after copies of the teams under similar names were added."""
    p, t = table(spark, folder, "player"), table(spark, folder, "team")
    teams = rs.augment_keys(t.select(F.col("id").alias("team_id"), tx.match_key(F.col("team_name")).alias("k")), "k", p.select(tx.match_key(F.col("team")).alias("k")), "k")
    return p.select(F.col("id").alias("player_id"), tx.match_key(F.col("team")).alias("k")).join(teams, "k").select("player_id", "team_id", "is_augmented").distinct()


@query("""WITH a AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders WHERE o_orderstatus = 'O')
SELECT a.o_custkey, CAST(a.k AS INTEGER) AS pair_no, a.o_orderkey AS gold_o_orderkey, b.o_orderkey AS found_o_orderkey FROM a JOIN b ON a.o_custkey = b.o_custkey AND a.k = b.k""")
def row_pairing(spark, folder):
    o = table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return ev.paired_rows(o.where("o_orderstatus = 'F'").drop("o_orderstatus"), o.where("o_orderstatus = 'O'").drop("o_orderstatus"), ["o_custkey"], "o_orderkey")


@query()
def column_batches(spark, folder):
    r = table(spark, folder, "extraction_result").where("records IS NOT NULL AND size(records) > 0").select("result_id", F.filter("records", lambda m: m.isNotNull()).alias("records"))
    first = r.withColumn("records", F.transform("records", lambda m: F.map_filter(m, lambda k, v: k.isin("name", "team_name", "team"))))
    other = r.withColumn("records", F.transform("records", lambda m: F.map_filter(m, lambda k, v: ~k.isin("name", "team_name"))))
    return rs.merge_batches([first, other], "result_id", "records")


# Extraction and identity


def _chunks_of(spark, folder, t):
    return table(spark, folder, "raw_chunks").where(F.startswith("doc_id", F.lit(t + "/"))).select("chunk_id", "content")


def _rule_sql(t):
    cells = ", ".join("nullif(regexp_extract(content, '{}', 1), '') AS {}".format(p.replace("'", "''"), c) for c, p in ex.RULES[t].items())
    kept = " OR ".join(f"{c} IS NOT NULL" for c in ex.RULES[t])
    return f"SELECT * FROM (SELECT chunk_id, {cells} FROM raw_chunks WHERE starts_with(doc_id, '{t}/')) WHERE {kept}"


def _rules(spark, folder, t):
    found = ex.rule_extractor(ex.RULES[t])(_chunks_of(spark, folder, t)).select("chunk_id", F.explode("records").alias("r"))
    return found.select("chunk_id", *[F.try_element_at("r", F.lit(c)).alias(c) for c in ex.RULES[t]])


@query(_rule_sql("owner"))
def extract_owner(spark, folder):
    return _rules(spark, folder, "owner")


@query(_rule_sql("team"))
def extract_team(spark, folder):
    return _rules(spark, folder, "team")


@query(_rule_sql("player"))
def extract_player(spark, folder):
    return _rules(spark, folder, "player")


_IDENTITY = """SELECT doc_id, table_name, text, r AS reject_reason, CASE WHEN r IS NULL THEN h END AS identity FROM (SELECT doc_id, table_name, text, h, CASE WHEN coalesce(trim(text), '') = '' THEN 'blank' WHEN h IS NULL OR lower(trim(regexp_replace(h, '\\s+', ' ', 'g'))) IN ('', 'n/a', 'none', 'null', 'unknown') THEN 'missing' WHEN regexp_full_match(h, '[\\d\\s.,]+') THEN 'digits'
WHEN regexp_matches(h, '[.!?…。！？।][''"”’»)\\]]*$') AND NOT regexp_matches(h, '\\b(Jr|Sr)\\.$') THEN 'sentence' WHEN len(regexp_split_to_array(h, '\\s+')) > 8 THEN 'too_long' END AS r
FROM (SELECT doc_id, table_name, text, trim(regexp_extract(text, '^\\s*([^\\n]+)', 1)) AS h FROM documents))"""


@query(f"SELECT doc_id, reject_reason, identity FROM ({_IDENTITY})")
def document_identity(spark, folder):
    return ex.document_identity(table(spark, folder, "documents").select("doc_id", "text"), "text").select("doc_id", "reject_reason", "identity")


@query()
def identity_scores(spark, folder):
    return ex.identity_scores(table(spark, folder, "player"), ["name", "nationality", "team", "position", "college", "age", "id"])


@query("""SELECT subject, lang, CAST(n AS BIGINT) AS n, n / a AS share FROM (SELECT subject, first(lang ORDER BY n DESC, lang DESC) AS lang, max(n) AS n, sum(n) AS a FROM (SELECT subject, lang, count(*) AS n FROM documents WHERE subject IS NOT NULL GROUP BY 1, 2) GROUP BY subject) WHERE n >= 2 AND n / a >= 0.6""")
def dominant_language(spark, folder):
    d = table(spark, folder, "documents").where("subject IS NOT NULL")
    return ex.dominant_type(d, "subject", "lang")


@query("""SELECT r.result_id, r.name, coalesce(contains(c.content, r.name) OR contains(trim(regexp_replace(replace(lower(replace(c.content, 'İ', 'i')), ',', ''), '\\s+', ' ', 'g')), trim(regexp_replace(replace(lower(replace(r.name, 'İ', 'i')), ',', ''), '\\s+', ' ', 'g'))), false) AS grounded
FROM (SELECT result_id, chunk_id, unnest(records)['name'] AS name FROM extraction_result WHERE table_name = 'owner') r JOIN raw_chunks c USING (chunk_id) WHERE r.name IS NOT NULL""")
def grounded_values(spark, folder):
    r = table(spark, folder, "extraction_result").where("table_name = 'owner'").select("result_id", "chunk_id", F.explode("records").alias("r")).select("result_id", "chunk_id", F.try_element_at("r", F.lit("name")).alias("name"))
    both = r.where(F.col("name").isNotNull()).join(table(spark, folder, "raw_chunks").select("chunk_id", "content"), "chunk_id")
    return both.select("result_id", "name", ex.is_grounded(F.col("name"), F.col("content")).alias("grounded"))


@query()
def response_parsing(spark, folder):
    """Records read back from answers that wrap them in prose."""
    r = table(spark, folder, "extraction_result").where("records IS NOT NULL").select("result_id", F.concat(F.lit("Here [is] the result:\n"), F.to_json("records"), F.lit("\nDone {ok}")).alias("answer"))
    return r.select("result_id", ex.response_records(F.col("answer"), ["name", "team_name", "team", "age", "college"]).alias("records"))


@query()
def validated_records(spark, folder):
    r = _rules(spark, folder, "owner").join(_chunks_of(spark, folder, "owner"), "chunk_id")
    return ex.validated(r, {"stake": "number", "price": "text", "trade": "text"}, "content").drop("content")


_VARIATIONS = {c: name_variations(c) for c in ("draft_pick", "college", "stake", "points", "home_games")}


@query(" UNION ALL ".join(f"SELECT chunk_id, '{c}' AS attribute FROM raw_chunks WHERE regexp_matches(content, '{ch.keyword_pattern(v)}')" for c, v in _VARIATIONS.items()))
def attribute_discovery(spark, folder):
    """The attributes each chunk speaks of, by the ways their names are written."""
    return ex.discovered_attributes(table(spark, folder, "raw_chunks").select("chunk_id", "content"), _VARIATIONS)


@query(r"""WITH m AS (SELECT chunk_id, unnest(regexp_extract_all(content, '(\p{Lu}[\p{L}’''-]+(?: \p{Lu}[\p{L}’''-]+)+)', 1)) AS mention FROM raw_chunks), c AS (SELECT chunk_id, mention, count(*) AS n FROM m GROUP BY 1, 2)
SELECT chunk_id, first(mention ORDER BY n DESC, mention) AS mention, max(n) AS n FROM c GROUP BY 1""")
def chunk_mentions(spark, folder):
    """The name that each chunk repeats most."""
    return ex.chunk_mentions(table(spark, folder, "raw_chunks").select("chunk_id", "content"))


@query()
def dominant_kind(spark, folder):
    """What the names that chunks repeat most are: persons, organisations or places."""
    return ex.dominant_kind(table(spark, folder, "raw_chunks").select("chunk_id", "content"))


_VOCABULARY = {"player": ["player", "overall pick", "drafted", "points"], "team": ["home games", "arena", "season"], "owner": ["stake", "owner", "company", "bought"]}


@query()
def document_summaries(spark, folder):
    """What each document says about the vocabulary of the tables, and which table it speaks of."""
    d = table(spark, folder, "documents").select("doc_id", "table_name", ex.summary(F.col("text"), [w for v in _VOCABULARY.values() for w in v]).alias("summary"))
    return d.select("doc_id", "table_name", "summary", ex.table_of(F.col("summary"), _VOCABULARY).alias("spoken_table"))


def _spoken_sql() -> str:
    counts = {t: " + ".join(f"CAST(contains(lower(coalesce(text, '')), '{w}') AS INTEGER)" for w in v) for t, v in _VOCABULARY.items()}
    each = " UNION ALL ".join(f"SELECT doc_id, '{t}' AS t, {n} AS n FROM documents" for t, n in counts.items())
    return f"SELECT doc_id, CASE WHEN max(n) > 0 THEN first(t ORDER BY n DESC, t) END AS spoken_table FROM ({each}) GROUP BY doc_id"


@query(_spoken_sql())
def spoken_tables(spark, folder):
    """The table whose vocabulary each whole document uses most."""
    return table(spark, folder, "documents").select("doc_id", ex.table_of(F.col("text"), _VOCABULARY).alias("spoken_table"))


@query("""WITH r AS (SELECT result_id, unnest(records) AS m, generate_subscripts(records, 1) - 1 AS position FROM extraction_result), e AS (SELECT result_id, CAST(position AS INTEGER) AS position, unnest(map_entries(m)) AS x FROM r WHERE m IS NOT NULL)
SELECT result_id, position, x.key AS field_name, nullif(trim(x.value), '') AS value, x.key AS span FROM e WHERE x.key IN ('name', 'team_name', 'team', 'age') AND x.value IS NOT NULL AND lower(trim(x.value)) NOT IN ('n/a', 'none', 'null', 'unknown', '') AND NOT starts_with(trim(x.value), '[')""")
def passage_answers(spark, folder):
    """Cells read back from answers that give a value and the words that prove it (here the field's name)."""
    r = table(spark, folder, "extraction_result").where("records IS NOT NULL")
    boxed = F.transform("records", lambda m: F.transform_values(m, lambda k, v: F.struct(v.alias("value"), k.alias("span"))))
    answers = r.select("result_id", F.concat(F.lit("Sure:\n```json\n"), F.to_json(F.struct(boxed.alias("passage_1")), {"ignoreNullFields": "false"}), F.lit("\n```")).alias("answer"))
    found = ex.passage_records(answers, "result_id", "answer", ["name", "team_name", "team", "age"])
    cells = found.select("result_id", "position", "spans", F.explode("record").alias("field_name", "value")).where(F.col("value").isNotNull() & ~F.startswith("value", F.lit("[")))
    return cells.select("result_id", "position", "field_name", "value", F.try_element_at("spans", F.col("field_name")).alias("span"))


@query()
def refined_records(spark, folder):
    """One record per document from the records of its chunks; later grounded values replace earlier ones."""
    c = table(spark, folder, "raw_chunks").select("chunk_id", "doc_id", "chunk_index", "content")
    r = table(spark, folder, "extraction_result").select("chunk_id", F.explode("records").alias("record")).where("record IS NOT NULL")
    return ex.refined(r.join(c, "chunk_id"), "doc_id", "chunk_index", "record", "content")


@query()
def refined_by_passages(spark, folder):
    """Records of players' chunks read in passages of 100 words."""
    return ex.refined_by_passages(_chunks_of(spark, folder, "player"), ex.rule_extractor(ex.RULES["player"]), 100)


# Evaluation


def _scored(spark, folder):
    """Orders against a copy in which some prices are off, some priorities are in lower case and some rows are missing."""
    o = table(spark, folder, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority", "o_custkey")
    found = o.where("o_orderkey % 7 <> 0").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 5 == 0, F.col("o_totalprice") + 10).otherwise(F.col("o_totalprice"))).withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 3 == 0, F.lower("o_orderpriority")).otherwise(F.col("o_orderpriority")))
    return o, found


_FOUND = "SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice + 10 ELSE o_totalprice END AS p, CASE WHEN o_orderkey % 3 = 0 THEN lower(o_orderpriority) ELSE o_orderpriority END AS r FROM orders WHERE o_orderkey % 7 <> 0"
_METRICS = f"""WITH f AS ({_FOUND}), j AS (SELECT sum(CASE WHEN abs(o.o_totalprice - f.p) <= 0.01 THEN 1.0 ELSE 0.0 END) AS price, sum(CASE WHEN lower(o.o_orderpriority) = lower(f.r) THEN 1.0 ELSE 0.0 END) AS priority FROM orders o JOIN f USING (o_orderkey)),
n AS (SELECT (SELECT count(*) FROM orders) AS g, (SELECT count(*) FROM f) AS p), m AS (SELECT 'price' AS column_name, price / p AS precision, price / g AS recall FROM j, n UNION ALL SELECT 'priority', priority / p, priority / g FROM j, n)"""


def _metrics(spark, folder):
    gold, found = _scored(spark, folder)
    pairs = ev.paired_rows(gold, found, ["o_orderkey"], "o_custkey")
    scores = {"price": ev.number_score(F.col("gold_o_totalprice"), F.col("found_o_totalprice"), 0.01), "priority": ev.string_score(F.col("gold_o_orderpriority"), F.col("found_o_orderpriority"))}
    return ev.column_metrics(pairs, scores, gold.count(), found.count())


@query(_METRICS + " SELECT column_name, CAST(round(precision, 6) AS DOUBLE) AS precision, CAST(round(recall, 6) AS DOUBLE) AS recall, CAST(round(2 * precision * recall / (precision + recall), 6) AS DOUBLE) AS f1 FROM m")
def column_metrics(spark, folder):
    return _metrics(spark, folder).select("column_name", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(_METRICS + " SELECT CAST(round(avg(precision), 6) AS DOUBLE) AS macro_precision, CAST(round(avg(recall), 6) AS DOUBLE) AS macro_recall, CAST(round(avg(2 * precision * recall / (precision + recall)), 6) AS DOUBLE) AS macro_f1 FROM m")
def macro_metrics(spark, folder):
    m = ev.macro(_metrics(spark, folder))
    return m.select(*[F.round(c, 6).alias(c) for c in m.columns])


_ERRORS = """WITH g AS (SELECT c_nationkey, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS gold_value FROM customer GROUP BY 1), f AS (SELECT c_nationkey, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS found_value FROM customer WHERE c_acctbal > 0 AND c_nationkey > 2 GROUP BY 1),
e AS (SELECT c_nationkey, gold_value, found_value, CASE WHEN gold_value IS NULL OR found_value IS NULL THEN 1.0 WHEN gold_value = 0 THEN abs(found_value) ELSE abs(found_value - gold_value) / abs(gold_value) END AS error FROM g FULL JOIN f USING (c_nationkey))"""


def _errors(spark, folder):
    c = table(spark, folder, "customer")
    total = lambda df: df.groupBy("c_nationkey").agg(F.sum(F.col("c_acctbal").cast("decimal(18,2)")).cast("double").alias("v"))
    return ev.group_errors(total(c), total(c.where("c_acctbal > 0 AND c_nationkey > 2")), ["c_nationkey"], "v")


@query(_ERRORS + " SELECT c_nationkey, gold_value, found_value, round(error, 6) AS error FROM e")
def aggregate_errors(spark, folder):
    return _errors(spark, folder).withColumn("error", F.round("error", 6))


@query(_ERRORS + " SELECT round(avg(error), 6) AS mean_error, count(*) AS n_groups FROM e")
def mean_aggregate_error(spark, folder):
    return ev.mean_error(_errors(spark, folder)).withColumn("mean_error", F.round("mean_error", 6))


@query("""WITH l AS (SELECT o_custkey, list_sort(list(o_orderpriority)) AS g, list_sort(list(o_orderpriority) FILTER (WHERE o_orderstatus = 'O')) AS f FROM orders GROUP BY 1), c AS (SELECT o_custkey, o_orderpriority, count(*) AS a, count(*) FILTER (WHERE o_orderstatus = 'O') AS b FROM orders GROUP BY 1, 2),
s AS (SELECT o_custkey, sum(a) AS a, sum(b) AS b, sum(least(a, b)) AS s FROM c GROUP BY 1) SELECT o_custkey, round(CASE WHEN b > 0 THEN s / b ELSE 0 END, 6) AS precision, round(CASE WHEN a > 0 THEN s / a ELSE 0 END, 6) AS recall FROM s""")
def list_cell_scores(spark, folder):
    o = table(spark, folder, "orders").select("o_custkey", "o_orderpriority", "o_orderstatus")
    s = ev.list_scores(o, o.where("o_orderstatus = 'O'"), ["o_custkey"], "o_orderpriority")
    return s.select("o_custkey", F.round(F.col("precision").cast("double"), 6).alias("precision"), F.round(F.col("recall").cast("double"), 6).alias("recall"))


@query()
def name_match_levels(spark, folder):
    """Names of owners matched to players' and clubs' owners: the rows still living are the gold side of all rows."""
    owners = table(spark, folder, "owner")
    return ev.name_matches(owners.where("deleted_at IS NULL").select("name"), owners.where("age IS NULL OR own_year IS NULL").select("name"), "name")


# Planning


WORKLOAD = [STATEMENTS[n] for n in ("sql_join4", "sql_left_join", "sql_many_aggregates", "sql_min_text", "sql_text_range", "sql_per_table_filters")]


@query()
def workload_lattice(spark, folder):
    return build(spark, WORKLOAD).as_frame(spark)


@query()
def workload_hints(spark, folder):
    lattice = build(spark, [*WORKLOAD, "SELECT name FROM owner WHERE nationality = 'American' OR nationality = 'Serbian'"])
    rows = [(t, c, v, name_variations(c)) for t in sorted(lattice.tables) for c, v in lattice.hints(t).items()]
    return spark.createDataFrame(rows, "table_name string, column_name string, literals array<string>, variations array<string>")


@query()
def delta_plans(spark, folder):
    """The delta plan of each statement of the SQL surface when only the players' names, ages and teams are there."""
    registry = dl.Registry()
    for c in ("name", "age", "team", "id"):
        registry.mark("player", c, "FULL")
    registry.mark("player", "nationality", "PARTIAL")
    rows = []
    for name, sql in sorted(STATEMENTS.items()):
        p = dl.plan_for(profile(spark, sql), registry)
        rows.append((name, p.kind.value, sorted(f"{t}.{c}" for t, cs in p.missing_columns.items() for c in cs), len(p.missing_predicates), float(p.cost)))
    return spark.createDataFrame(rows, "statement string, kind string, missing_columns array<string>, missing_predicates int, cost double")


def _align_sql(n: int, left: str, lc: str, right: str, rc: str) -> str:
    """CTE m<n> (variant, canonical): keys equal but for letter case, punctuation and blanks, and the most similar right keys of left ones without such a partner."""
    norm = _NORM.format("v")
    return f"""s{n} AS (SELECT v, r, {norm} AS n FROM (SELECT DISTINCT {lc} AS v, false AS r FROM {left} WHERE {lc} IS NOT NULL UNION SELECT DISTINCT {rc}, true FROM {right} WHERE {rc} IS NOT NULL)),
c{n} AS (SELECT n, first(v ORDER BY length(trim(v)), lower(replace(v, 'İ', 'i')), v) AS canonical FROM s{n} WHERE r AND n <> '' GROUP BY n),
o{n} AS (SELECT v, n FROM s{n} WHERE NOT r AND n <> '' AND n NOT IN (SELECT n FROM c{n})),
b{n} AS (SELECT o.n, first(c.canonical ORDER BY levenshtein(o.n, c.n) / greatest(length(o.n), length(c.n)), lower(replace(c.canonical, 'İ', 'i')), c.canonical) AS canonical FROM (SELECT DISTINCT n FROM o{n}) o JOIN c{n} c
  ON length(o.n) >= 3 AND length(c.n) >= 3 AND levenshtein(o.n, c.n) <= 0.05 * greatest(length(o.n), length(c.n)) + 1e-9 GROUP BY o.n),
m{n} AS (SELECT s.v AS variant, c.canonical FROM s{n} s JOIN c{n} c USING (n) WHERE s.v <> c.canonical AND n IN (SELECT n FROM s{n} WHERE NOT r) UNION SELECT o.v, b.canonical FROM o{n} o JOIN b{n} b USING (n))"""


@query(f"""WITH {_align_sql(1, 'player', 'team', 'team', 'team_name')},
p AS (SELECT age, coalesce(canonical, team) AS team FROM player LEFT JOIN m1 ON team = variant), t AS (SELECT coalesce(canonical, team_name) AS team_name, location FROM team LEFT JOIN m1 ON team_name = variant),
{_align_sql(2, 't', 'location', 'city', 'city_name')},
u AS (SELECT team_name, coalesce(canonical, location) AS location FROM t LEFT JOIN m2 ON location = variant), c AS (SELECT coalesce(canonical, city_name) AS city_name FROM city LEFT JOIN m2 ON city_name = variant)
SELECT u.location, count(*) AS n_players, max(p.age) AS oldest FROM p JOIN u ON p.team = u.team_name JOIN c ON u.location = c.city_name WHERE p.age > 20 GROUP BY u.location""")
def engine_aligned_query(spark, folder):
    """A join answered by the engine: keys that differ in letter case, punctuation or blanks only are brought to one spelling first, then
    those that are only similar."""
    engine = Engine(spark).load({t: table(spark, folder, t) for t in ("player", "team", "city")})
    return engine.query("SELECT t.location, COUNT(*) AS n_players, MAX(p.age) AS oldest FROM player p JOIN team t ON p.team = t.team_name JOIN city c ON t.location = c.city_name WHERE p.age > 20 GROUP BY t.location").rows


def _documents(spark, folder):
    return table(spark, folder, "documents").select("doc_id", "table_name", "text")


@query()
def engine_synthesis(spark, folder):
    """A table synthesized from all documents in chunks for a workload, then queried (the tests follow it step by step in Python)."""
    engine = Engine(spark).preprocess(["SELECT name, birth_date, team, college, points FROM player WHERE draft_year > 1980"], _documents(spark, folder))
    return engine.query("SELECT name, birth_date, team, college, points FROM player").rows


def _synthesis_sql(columns: list[str]) -> str:
    rules = ex.RULES["player"]
    cells = ", ".join("nullif(regexp_extract(text, '{}', 1), '') AS {}".format(p.replace("'", "''"), "found_name" if c == "name" else c) for c, p in rules.items())
    some = " OR ".join(f"{'found_name' if c == 'name' else c} IS NOT NULL" for c in rules)
    best = "".join(f", {c}_ AS (SELECT e, first(v ORDER BY n DESC, f, v) AS {c} FROM (SELECT e, {c} AS v, count(*) AS n, min(chunk_id) AS f FROM r WHERE {c} IS NOT NULL GROUP BY 1, 2) GROUP BY e)" for c in columns)
    joins = "".join(f" LEFT JOIN {c}_ USING (e)" for c in columns)
    return f"""WITH d AS ({_IDENTITY}), x AS (SELECT doc_id, trim(identity) AS identity, sha256(doc_id || '|0') AS chunk_id, {cells} FROM d WHERE table_name = 'player'),
r AS (SELECT *, coalesce(identity, found_name) AS name, CASE WHEN identity IS NULL THEN 'doc:' || doc_id ELSE lower(replace(identity, 'İ', 'i')) END AS e FROM x WHERE {some}){best}
SELECT {', '.join(columns)} FROM (SELECT DISTINCT e FROM r){joins}"""


@query(_synthesis_sql(["name", "birth_date", "team", "college", "points"]))
def engine_whole_documents(spark, folder):
    """A table synthesized from documents that are read as one piece each."""
    engine = Engine(spark, whole_documents=True).preprocess(["SELECT name, birth_date, team, college, points FROM player"], _documents(spark, folder))
    return engine.query("SELECT name, birth_date, team, college, points FROM player").rows


@query(_synthesis_sql(["name", "points", "college", "draft_pick"]))
def engine_column_delta(spark, folder):
    """Columns that the workload did not name, added by the query that asks for them: the same values as if they had been there at once."""
    engine = Engine(spark, whole_documents=True).preprocess(["SELECT name, birth_date, team FROM player"], _documents(spark, folder))
    engine.query("SELECT points, college FROM player")
    return engine.query("SELECT name, points, college, draft_pick FROM player").rows


@query(_synthesis_sql(["name", "birth_date", "team", "draft_year"]) + " WHERE TRY_CAST(draft_year AS DOUBLE) >= 2000")
def engine_row_delta(spark, folder):
    """Rows outside what a partial table holds, added by the query that asks for them."""
    engine = Engine(spark, whole_documents=True).preprocess(["SELECT name, birth_date, team, draft_year FROM player"], _documents(spark, folder))
    held = engine.tables["player"].where("draft_year < '1990'")
    engine.registry = dl.Registry()
    engine.load({"player": held}, {("player", "draft_year"): frozenset([Predicate("player", "draft_year", "<", "1990")])})
    return engine.query("SELECT name, birth_date, team, draft_year FROM player WHERE draft_year >= 2000").rows


@query()
def engine_preflight(spark, folder):
    """The checks before synthesis of a workload that asks for a table without texts and columns that no rule can find."""
    found = Engine(spark).preflight(["SELECT name, height FROM player", "SELECT city_name FROM city", "SELECT FROM nothing WHERE"], _documents(spark, folder))
    return spark.createDataFrame([(f.check, f.passed, f.detail) for f in found], "check string, passed boolean, detail string")


@query()
def statement_types(spark, folder):
    """Type of each statement, the keys that tell its rows apart, and its text with id columns for rows to be matched by."""
    rows = [(n, rw.query_type(p := profile(spark, s)), rw.result_keys(p), rw.with_columns(spark, s)) for n, s in sorted(STATEMENTS.items())]
    return spark.createDataFrame(rows, "statement string, kind string, result_keys array<string>, with_ids string")


@query("SELECT player.id AS player_id, t.id AS team_id FROM player JOIN team t ON player.team = t.team_name WHERE player.nationality = 'French'")
def canonical_literals(spark, folder):
    """A statement whose literal is a variant of a known value, answered with the canonical form in its place."""
    engine = Engine(spark, align_keys=False).load({t: table(spark, folder, t) for t in ("player", "team")})
    engine.forms = spark.createDataFrame([("frensh", "French"), ("the french", "French")], "key string, canonical string")
    return engine.query("SELECT player.id AS player_id, t.id AS team_id FROM player JOIN team t ON player.team = t.team_name WHERE player.nationality = 'Frensh'").rows


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, folder):
    return windowed_counts(table(spark, folder, "events")).withColumn("total", F.round("total", 2))


@query("SELECT operation, count(*) AS calls, CAST(sum(t) AS BIGINT) AS tokens FROM (SELECT extractor AS operation, CASE WHEN length(content) = 0 THEN 0 ELSE greatest(1, CAST(floor(length(content) / 4) AS BIGINT)) END AS t FROM extraction_result JOIN raw_chunks USING (chunk_id)) GROUP BY 1")
def call_counters(spark, folder):
    calls = table(spark, folder, "extraction_result").select("extractor", "chunk_id").join(table(spark, folder, "raw_chunks").select("chunk_id", "content"), "chunk_id")
    return st.call_counters(calls, "extractor", tx.token_estimate(F.col("content")))
