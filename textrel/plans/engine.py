"""The two entries of the engine: synthesize tables for a workload, and answer queries, adding what is missing.

Everything that took work is stored once: chunks, the records found in each chunk, the index of their attributes, tables,
and their provenance. With a folder they are Parquet below it, else checkpoints. A query that needs nothing new reads stored
tables only; deltas read stored records, and texts only of chunks that no extractor has seen.

A column is FULL when every chunk of its table was read for it. A column that an extractor cannot find is never FULL: it is
null, and planned as missing again by the next query, which costs no reading.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textrel.functions.text import folded
from textrel.operators.attributes import candidate_chunks, fuzzy_attributes, selective_attributes
from textrel.operators.chunks import chunk_id, matches_predicate, recursive_chunks
from textrel.operators.extract import ANCHORS, IDENTITY_TYPES, RULES, Extractor, document_identity, grounded_records, identity_scores, rule_extractor
from textrel.operators.resolve import alignment_map, apply_map, similar_alignment_map
from textrel.operators.store import consolidate, evolve, merged_sources, not_cached, row_id, snapshot_state, upsert_salted
from textrel.plans.delta import Delta, DeltaPlan, Registry, plan_for
from textrel.plans.lattice import Lattice, build, name_variations
from textrel.plans.profile import Predicate, profile
from textrel.plans.rewrite import rewrite_bare_columns, rewrite_values
from textrel.session import checkpointed
from textrel.sources.files import exists, read_text, read_workload, write_text


@dataclass
class Answer:
    """A lazy result, the plan it took, and the rewritten statement."""

    rows: DataFrame
    plan: DeltaPlan
    sql: str


@dataclass(frozen=True)
class Finding:
    """One check before synthesis."""

    check: str
    passed: bool
    detail: str


class NotReady(RuntimeError):
    """The checks before synthesis failed, or a stored engine lacks its index."""


def _default_extractors() -> dict[str, Extractor]:
    return {t: rule_extractor(r, ANCHORS[t]) for t, r in RULES.items()}


def _covers(extractor: Extractor, column: str) -> bool:
    known = getattr(extractor, "columns", None)
    return known is None or column in known


@dataclass
class Engine:
    """Synthesized tables, their chunks, found records, provenance and index, and the registry of what is complete.

    ``folder`` keeps all of it (restore reads it back); without one it lives in the checkpoint folder. ``unassigned`` tells
    whether documents without a valid identity become a row each (else they are left out, and counted in stats).
    ``whole_documents`` reads each document as one chunk. ``gate`` leaves out documents that speak of another table than
    theirs. ``align_keys`` lets joins bring their keys to one spelling, ``similar_keys`` lets them align keys that are only similar, after those that are equal but for letter case and
    punctuation.
    """

    spark: SparkSession
    folder: str | None = None
    unassigned: bool = True
    whole_documents: bool = False
    gate: bool = False
    align_keys: bool = True
    similar_keys: bool = True
    tables: dict[str, DataFrame] = field(default_factory=dict)
    chunks: DataFrame | None = None
    documents: DataFrame | None = None
    records: dict[str, DataFrame] = field(default_factory=dict)
    provenance: dict[str, DataFrame] = field(default_factory=dict)
    index: DataFrame | None = None
    maps: dict[tuple, DataFrame] = field(default_factory=dict)
    forms: DataFrame | None = None
    identity: dict[str, str | None] = field(default_factory=dict)
    registry: Registry = field(default_factory=Registry)
    statements: list[str] = field(default_factory=list)
    lattice: Lattice = field(default_factory=Lattice)
    extractors: dict[str, Extractor] = field(default_factory=_default_extractors)
    versions: dict[str, int] = field(default_factory=dict)

    # Storage

    def _keep(self, name: str, df: DataFrame) -> DataFrame:
        """Store a table once and read it from there; earlier versions stay for results that still read them."""
        if self.folder is None:
            return checkpointed(df)
        self.versions[name] = self.versions.get(name, 0) + 1
        path = f"{self.folder}/{name}/v{self.versions[name]}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def _state(self) -> str:
        entries = [[*k, status, [[p.table, p.column, p.op, p.value] for p in sorted(scope, key=str)]] for k, (status, scope) in sorted(self.registry.entries.items())]
        return json.dumps({"versions": self.versions, "registry": entries, "statements": self.statements, "identity": self.identity, "options": [self.unassigned, self.whole_documents, self.gate, self.align_keys, self.similar_keys]})

    def _save_state(self) -> None:
        if self.folder is not None:
            write_text(self.spark, f"{self.folder}/state.json", self._state())

    def save(self, folder: str) -> None:
        """Write everything below ``folder``, from where restore reads it."""
        copy = Engine(self.spark, folder, self.unassigned, self.whole_documents, self.gate, self.align_keys, self.similar_keys, identity=self.identity, registry=self.registry, statements=self.statements)
        for name, df in self._stored().items():
            copy._keep(name, df)
        copy._save_state()

    def _stored(self) -> dict[str, DataFrame]:
        single = {"chunks": self.chunks, "documents": self.documents, "index": self.index}
        out = {n: d for n, d in single.items() if d is not None}
        for kind, held in (("tables", self.tables), ("provenance", self.provenance), ("records", self.records)):
            out |= {f"{kind}/{t}": d for t, d in held.items()}
        return out

    @staticmethod
    def restore(spark: SparkSession, folder: str, extractors: dict[str, Extractor] | None = None) -> "Engine":
        """An engine as it was stored. One without an index cannot plan deltas and raises NotReady."""
        if not exists(spark, f"{folder}/state.json"):
            raise NotReady(f"no stored engine in {folder}")
        state = json.loads(read_text(spark, f"{folder}/state.json"))
        out = Engine(spark, folder, *state["options"], versions=state["versions"], identity=state["identity"], statements=state["statements"])
        out.extractors |= extractors or {}
        for t, c, status, scope in state["registry"]:
            out.registry.mark(t, c, status, frozenset(Predicate(*p) for p in scope))
        if state["statements"] and "index" not in state["versions"]:
            raise NotReady(f"the engine in {folder} has no index")
        for name, v in state["versions"].items():
            df = spark.read.parquet(f"{folder}/{name}/v{v}")
            kind, _, t = name.partition("/")
            if t:
                getattr(out, kind)[t] = df
            else:
                setattr(out, kind, df)
        out.lattice = build(spark, out.statements)
        return out

    def reset(self, keep_records: bool = False) -> None:
        """Forget tables, registry and chunks; with ``keep_records`` what extractors found stays and is not looked for again."""
        self.tables, self.provenance, self.maps, self.registry = {}, {}, {}, Registry()
        self.chunks = self.documents = self.index = None
        if not keep_records:
            self.records = {}
        kept = {n: v for n, v in self.versions.items() if keep_records and n.startswith("records/")}
        self.versions = kept
        self._save_state()

    def load(self, tables: dict[str, DataFrame], scope: dict[tuple[str, str], frozenset[Predicate]] | None = None) -> "Engine":
        """Take over tables: their columns are FULL, but for those with a ``scope``, whose rows are there only for its predicates."""
        for t, df in tables.items():
            self.tables[t.lower()] = df
            self._forget_maps(t.lower())
            for c in df.columns:
                asked = (scope or {}).get((t.lower(), c.lower()))
                self.registry.mark(t.lower(), c.lower(), "FULL" if asked is None else "PARTIAL", asked or frozenset())
        return self

    # Synthesis

    def preflight(self, workload: str | list[str], documents: DataFrame) -> list[Finding]:
        """What would keep synthesis from working, looked at before any text is read."""
        statements = self._statements(workload)
        lattice = build(self.spark, statements)
        out = [Finding("statements", bool(statements) and not lattice.failed, f"{len(statements)} statements, {len(lattice.failed)} cannot be parsed")]
        lacking = sorted({"doc_id", "table_name", "text"} - set(documents.columns))
        out.append(Finding("documents", not lacking, f"columns missing: {', '.join(lacking) or 'none'}"))
        counts = {} if lacking else {r["table_name"]: r["n"] for r in documents.where(F.col("table_name").isin(sorted(lattice.tables))).groupBy("table_name").agg(F.count("*").alias("n")).collect()}  # a row per table
        for t in sorted(lattice.tables):
            columns = {c for (x, c) in lattice.columns if x == t}
            out.append(Finding(f"texts of {t}", counts.get(t, 0) > 0, f"{counts.get(t, 0)} documents"))
            out.append(Finding(f"extractor of {t}", t in self.extractors, "there" if t in self.extractors else "none is registered"))
            if t in self.extractors:
                unknown = sorted(c for c in columns if c != self._identity_column(t, lattice) and not _covers(self.extractors[t], c))
                out.append(Finding(f"columns of {t}", not unknown, f"not to be found: {', '.join(unknown) or 'none'}"))
            who = self._identity_column(t, lattice)
            out.append(Finding(f"identity of {t}", who is not None, who or "none: every record becomes a row"))
            if t in self.tables:
                gone = sorted(columns - set(self.tables[t].columns))
                out.append(Finding(f"stored table {t}", not gone, f"columns to be added: {', '.join(gone) or 'none'}"))
        probe = self.folder or self.spark.sparkContext.getCheckpointDir() or self.spark.conf.get("spark.checkpoint.dir", None)
        shared = probe is not None or self.spark.sparkContext.master.startswith("local")
        if self.folder is not None:
            try:
                write_text(self.spark, f"{self.folder}/probe", "x")
            except Exception as e:  # whatever the file system says
                shared, probe = False, str(e).splitlines()[0]
        out.append(Finding("storage", shared, str(probe)))
        return out

    def _statements(self, workload: str | list[str]) -> list[str]:
        return [s.sql for s in read_workload(self.spark, workload)] if isinstance(workload, str) else list(workload)

    def _identity_column(self, t: str, lattice: Lattice | None = None) -> str | None:
        """The column that names a table's rows: the only one of a person, organisation or place; of several, one called name or the
        table's name, else the one that best tells the rows of a loaded table apart, else the first; None without any."""
        if t in self.identity:
            return self.identity[t]
        columns = [c for (x, _), c in sorted((lattice or self.lattice).columns.items()) if x == t]
        named = [c.name for c in columns if c.semantic in IDENTITY_TYPES]
        if len(named) > 1:
            liked = [c for w in ("name", f"{t}_name", t) for c in named if c == w] or [c for c in named if c.endswith("name")]
            if not liked and t in self.tables:
                held = [c for c in named if c in self.tables[t].columns]
                liked = [r["column_name"] for r in identity_scores(self.tables[t], held).orderBy(F.desc("score"), "column_name").collect()] if held else []
            named = liked or named
        return named[0] if named else None

    def preprocess(self, workload: str | list[str], documents: DataFrame, check: bool = False) -> "Engine":
        """Synthesize the workload's tables from documents (doc_id unique, table_name, text): chunk, extract once for all statements,
        merge by the document's identity, consolidate, and store tables, provenance and an attribute index. ``workload`` is a path
        or statements. With ``check``, failed preflight checks raise NotReady. Records of chunks read before are not looked for
        again."""
        self.statements = self._statements(workload)
        if check and (bad := [f for f in self.preflight(self.statements, documents) if not f.passed]):
            raise NotReady("; ".join(f"{f.check}: {f.detail}" for f in bad))
        self.lattice = build(self.spark, self.statements)
        words = {t: sorted({t, *(v for (x, _), c in self.lattice.columns.items() if x == t for v in name_variations(c.name))}) for t in self.lattice.tables} if self.gate else None
        named = document_identity(documents.select("doc_id", "table_name", "text"), "text", vocabulary=words)
        kept = named if self.unassigned else named.where(F.col("identity").isNotNull())
        kept = kept.where(~F.coalesce(F.col("reject_reason") == "other_table", F.lit(False)))
        self.documents = self._keep("documents", named.select("doc_id", "table_name", "identity", "reject_reason"))
        pieces = kept.where(F.col("text").rlike(r"\S")).select("doc_id", F.lit(0).alias("chunk_index"), F.col("text").alias("content")) if self.whole_documents else recursive_chunks(kept, "doc_id", "text")
        pieces = pieces.withColumn("chunk_id", chunk_id(F.col("doc_id"), F.col("chunk_index")))
        self.chunks = self._keep("chunks", pieces.join(self.documents.select("doc_id", "table_name", "identity"), "doc_id"))
        for t in sorted(self.lattice.tables):
            columns = [c.name for (x, _), c in sorted(self.lattice.columns.items()) if x == t]
            if columns and t in self.extractors:
                self.identity.setdefault(t, self._identity_column(t))
                self._extract(t)
                self._synthesize(t, columns)
        self._index()
        self._save_state()
        return self

    def _own(self, t: str) -> DataFrame:
        return self.chunks.where(F.col("table_name") == t)

    def _extract(self, t: str) -> None:
        """Look for records in the chunks of a table that were not read yet. What the extractor's sieve passes over holds nothing."""
        extractor, own = self.extractors[t], self._own(t).select("chunk_id", "content")
        new = not_cached(own, self.records[t], t) if t in self.records else own.withColumn("cache_key", F.md5(F.concat_ws(":", "chunk_id", F.lit(t))))
        if hasattr(extractor, "sieve"):
            new = new.where(extractor.sieve(F.col("content")))
        found = extractor(new.select("chunk_id", "content"))
        if not getattr(extractor, "verbatim", False):
            found = grounded_records(found, new)
        found = found.join(new.select("chunk_id", "cache_key"), "chunk_id").select("cache_key", "chunk_id", "records")
        self.records[t] = self._keep(f"records/{t}", self.records[t].unionByName(found) if t in self.records else found)

    def _found(self, t: str) -> DataFrame:
        """Records in the chunks at hand: chunk_id, doc_id, entity, identity, and the record ``_r`` with its place ``_p``."""
        who = F.col("identity")
        entity = F.when(who.isNull(), F.concat(F.lit("doc:"), F.col("doc_id").cast("string"))).otherwise(folded(F.trim(who)))
        own = self._own(t).select("chunk_id", "doc_id", F.trim("identity").alias("identity"), entity.alias("entity"))
        found = self.records[t].select("chunk_id", F.posexplode("records").alias("_p", "_r")).join(own, "chunk_id")
        if self.identity.get(t) is None:  # nothing names the rows: every record is one
            return found.withColumn("entity", F.concat_ws("#", "chunk_id", "_p"))
        return found

    def _cells(self, found: DataFrame, t: str, columns: list[str]) -> DataFrame:
        who = self.identity.get(t)
        return found.select(row_id(F.lit(t), F.col("entity")).alias("row_id"), "chunk_id", *[(F.coalesce("identity", F.try_element_at("_r", F.lit(c))) if c == who else F.try_element_at("_r", F.lit(c))).alias(c) for c in columns])

    def _synthesize(self, t: str, columns: list[str]) -> None:
        who = self.identity.get(t)
        names = [who, *[c for c in columns if c != who]] if who else columns
        rows = self._cells(self._found(t), t, names)
        self.tables[t] = self._keep(f"tables/{t}", consolidate(rows, "row_id", names, "chunk_id").drop("n_rows"))
        self.provenance[t] = self._keep(f"provenance/{t}", merged_sources(rows.select("row_id", F.array("chunk_id").alias("chunk_ids")), "row_id", "chunk_ids"))
        for c in names:
            if c == who or _covers(self.extractors[t], c):
                self.registry.mark(t, c, "FULL")

    def _index(self) -> None:
        """Which chunk speaks of which attribute, from all records."""
        out = None
        for t, r in sorted(self.records.items()):
            e = r.select(F.lit(t).alias("table_name"), "chunk_id", F.explode("records").alias("_r")).select("table_name", F.explode(F.map_keys("_r")).alias("attribute"), "chunk_id").distinct()
            out = e if out is None else out.unionByName(e)
        if out is not None:
            self.index = self._keep("index", out)

    # Deltas

    def attribute_of(self, t: str, column: str) -> str | None:
        """The indexed attribute that a column means: itself, else the most similar one, else None."""
        known = sorted(r[0] for r in self.index.where(F.col("table_name") == t).select("attribute").distinct().collect())  # a schema's attributes
        return next(iter(fuzzy_attributes(column, known, most=1)), None)

    def chunks_for(self, t: str, columns: list[str]) -> DataFrame:
        """The chunks that may tell about one of the columns: those the index names, all of them, or every chunk of the table where an
        attribute is unknown or so common that the index selects nothing. An index that knows none of the table's chunks raises
        StaleIndexError."""
        everything = self._own(t).select("chunk_id")
        attributes = [self.attribute_of(t, c) for c in columns]
        if None in attributes:
            return everything
        selective = {r["attribute"] for r in selective_attributes(self.index.where(F.col("table_name") == t)).where(F.col("attribute").isin(attributes)).collect()}  # at most as many as columns
        if not set(attributes) <= selective:
            return everything
        return candidate_chunks(self.index, everything.withColumn("table_name", F.lit(t)), t, attributes)

    def _fill(self, plan: DeltaPlan) -> None:
        """Row and column deltas of a plan, if there is something to extract from."""
        if self.chunks is None or self.index is None:
            return
        changed = False
        for t, columns in plan.missing_columns.items():
            if t not in self.tables or t not in self.extractors or "row_id" not in self.tables[t].columns:
                continue
            able = [c for c in columns if _covers(self.extractors[t], c)]
            if unable := [c for c in columns if c not in able]:
                self.tables[t] = evolve(self.tables[t], {c: "string" for c in unable})
            if not able:
                continue
            self._extract_new(t)
            hit = self.chunks_for(t, able)
            cells = self._cells(self._found(t).join(hit, "chunk_id", "left_semi"), t, able)
            values = consolidate(cells, "row_id", able, "chunk_id").drop("n_rows")
            self.tables[t] = self._keep(f"tables/{t}", upsert_salted(evolve(self.tables[t], {c: "string" for c in able}), values, "row_id"))
            for c in able:
                self.registry.mark(t, c, "FULL")
            self._forget_maps(t)
            changed = True
        for t in sorted({x.table for x in plan.missing_predicates}):
            if t in self.tables and t in self.extractors and "row_id" in self.tables[t].columns:
                self._add_rows(t, [x for x in plan.missing_predicates if x.table == t])
                changed = True
        if changed:
            self._save_state()

    def _extract_new(self, t: str) -> None:
        if t not in self.records:
            self.identity.setdefault(t, self._identity_column(t))
            self._extract(t)
            self._index()

    def _add_rows(self, t: str, asked: list[Predicate]) -> None:
        """Add the rows for which a predicate holds in some chunk, each from all records of its entity, and fill the nulls of known
        rows."""
        self._extract_new(t)
        who = self.identity.get(t)
        names = [c for c in self.tables[t].columns if c != "row_id"]
        found = self._found(t)
        columns = sorted({x.column for x in asked})
        near = found if who in columns else found.join(self.chunks_for(t, columns), "chunk_id", "left_semi")
        cells = self._cells(near, t, columns)
        hit: Column = F.lit(False)
        for x in asked:
            v = F.col(x.column)
            hit = hit | (matches_predicate(v, x.op, x.value) if x.op in ("=", "!=", "<", "<=", ">", ">=") else v.isNotNull())
        wanted = cells.where(hit).select("row_id").distinct()
        rows = consolidate(self._cells(found, t, names).join(wanted, "row_id", "left_semi"), "row_id", names, "chunk_id").drop("n_rows")
        old = self.tables[t]
        kinds = dict(old.dtypes)
        rows = rows.select("row_id", *[F.col(c).try_cast(kinds[c]).alias(c) for c in names])
        fresh = rows.join(old.select("row_id"), "row_id", "left_anti")
        self._forget_maps(t)
        self.tables[t] = self._keep(f"tables/{t}", upsert_salted(old, rows, "row_id").unionByName(fresh.select(*old.columns)))
        for x in asked:
            self.registry.mark(t, x.column, "PARTIAL", frozenset([x]))

    # Queries

    def _key_map(self, left: tuple[str, str], right: tuple[str, str], tables: dict[str, DataFrame]) -> DataFrame | None:
        (lt, lc), (rt, rc) = left, right
        if (left, right) in self.maps:
            return self.maps[left, right]
        if lt not in tables or rt not in tables or lt == rt or dict(tables[lt].dtypes).get(lc) != "string" or dict(tables[rt].dtypes).get(rc) != "string":
            return None
        mapping = alignment_map(tables[lt], lc, tables[rt], rc)
        if self.similar_keys:
            mapping = mapping.unionByName(similar_alignment_map(tables[lt], lc, tables[rt], rc))
        return checkpointed(mapping)  # read for both sides; a row per spelling that changes

    def align(self, joins: tuple) -> dict[str, DataFrame]:
        """The tables with join keys rewritten to one spelling: first where only letter case, punctuation or blanks differ, then, for
        keys without such a partner, to the most similar one. The stored tables stay as they are."""
        out = dict(self.tables)
        for left, right in joins:
            mapping = self._key_map(left, right, out)
            if mapping is not None:
                (lt, lc), (rt, rc) = left, right
                out[lt], out[rt] = apply_map(out[lt], lc, mapping), apply_map(out[rt], rc, mapping)
        return out

    def _forget_maps(self, t: str) -> None:
        self.maps = {k: m for k, m in self.maps.items() if t not in (k[0][0], k[1][0])}

    def align_workload(self) -> int:
        """Store the key maps of all join pairs of the workload (a pair and its reverse once), so that queries need not make them. How
        many there are."""
        for left, right in self.lattice.joins:
            if (left, right) not in self.maps and (right, left) not in self.maps:
                mapping = self._key_map(left, right, self.tables)
                if mapping is not None:
                    self.maps[left, right] = self.maps[right, left] = mapping
        return len(self.maps) // 2

    def query(self, sql: str) -> Answer:
        """Answer a statement: plan, add what is missing, align join keys, replace literals by their canonical forms (where ``forms`` has
        key and canonical), rewrite bare grouped columns, and hand it to Spark."""
        p = profile(self.spark, sql)
        plan = plan_for(p, self.registry)
        if plan.kind in (Delta.COLUMN, Delta.ROW, Delta.MIXED):
            self._fill(plan)
        tables = self.align(plan.joins) if plan.joins and self.align_keys else self.tables
        text = rewrite_bare_columns(self.spark, sql if self.forms is None else rewrite_values(sql, self.forms))
        for t in p.tables:
            if t in tables:
                tables[t].createOrReplaceTempView(t)
        return Answer(self.spark.sql(text), plan, text)

    def stats(self) -> dict[str, int]:
        """Tables, columns, complete columns, join pairs, and documents left out or without an identity."""
        full = sum(s == "FULL" for s, _ in self.registry.entries.values())
        out = {"tables": len(self.tables), "columns": len(self.registry.entries), "full_columns": full, "join_pairs": len(self.lattice.joins)}
        if self.documents is not None:
            out["unassigned_documents"] = self.documents.where("identity IS NULL").count()
        return out

    def ready(self) -> bool:
        """Whether a query of the workload would find everything: all columns FULL, and an index that knows the chunks at hand."""
        if self.index is None or self.chunks is None:
            return False
        rows = [(t, c, s) for (t, c), (s, _) in self.registry.entries.items()]
        state = snapshot_state(self.spark.createDataFrame(rows, "table_name string, column_name string, status string"), self.chunks.select("chunk_id"), self.index.select("chunk_id"))
        return bool(state.first()["ready"])
