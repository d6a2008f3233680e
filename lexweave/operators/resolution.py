"""Entity resolution: the exact sequential fold, micro-batches against a snapshot, a bulk forest, and the clean-up.

Types never interact, as both candidate channels ask for equal types. The fold is the specification and the tests'
oracle: it holds one type's entities in one task and refuses more rows than a bound. Production runs in micro-batches,
where two equal mentions of one batch may both found an entity, and repairs that with the clean-up.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexweave import schemas
from lexweave.config import Settings
from lexweave.durable import append, components, discard, materialize
from lexweave.functions import names as N
from lexweave.functions import similarity as S
from lexweave.models import Judge
from lexweave.operators import candidates as C
from lexweave.operators import judgment as J

#: What the fold takes at most; larger inputs go through ``resolve_batches``.
FOLD_ROWS = 20_000

MENTIONS = (
    "mention_id string, chunk_id string, entity_index int, source_file string, chunk_index int, name string, type string, "
    "role string, textual_evidence string, confidence string, mention_text string, snippet string, vector array<float>"
)
RESOLVED = "mention_id string, type string, entity_id string, is_new boolean, flags array<struct<entity_id:string,reason:string>>"


def mention_rows(mentions: DataFrame) -> DataFrame:
    """Mention rows with their key; the founding mention's key makes an entity's id."""
    return mentions.withColumn("mention_id", F.concat_ws("#", "chunk_id", F.col("entity_index").cast("string")))


def entity_id(chunk_id, entity_index):
    """Deterministic id of the entity that a mention founds: a retry gives the same one."""
    return F.substring(F.sha2(F.concat_ws("|", chunk_id, entity_index.cast("string")), 256), 1, 24)


def founded(source, chunk_index, index):
    """A sortable key of the order of creation."""
    return F.concat_ws("|", source, F.lpad(chunk_index.cast("string"), 10, "0"), F.lpad(index.cast("string"), 6, "0"))


def _keyed(mentions: DataFrame) -> DataFrame:
    rows = mentions if "mention_id" in mentions.columns else mention_rows(mentions)
    return rows.withColumn("_new", entity_id(F.col("chunk_id"), F.col("entity_index"))).withColumn("_order", founded(F.col("source_file"), F.col("chunk_index"), F.col("entity_index")))


def fold(mentions: DataFrame, judge: Judge, settings: Settings = Settings(), rows: int = FOLD_ROWS) -> DataFrame:
    """Every mention in order of source, chunk and index, each seeing all entities founded before it."""
    if mentions.limit(rows + 1).count() > rows:
        raise ValueError(f"the fold takes {rows} mentions at most; use resolve_batches")
    k, threshold, guard = settings.candidates, settings.name_threshold, settings.guard_threshold

    def run(part: pd.DataFrame) -> pd.DataFrame:
        ids: list[str] = []
        names: list[str] = []
        name_of: dict[str, str] = {}
        vectors: list[np.ndarray] = []
        owners: list[tuple[str, str, str, str]] = []  # mention, entity, chunk, snippet
        out = []
        for m in part.sort_values("_order").to_dict("records"):
            found: dict[str, dict] = {}
            if ids:
                scores = S.jaro_winkler_arrays([m["name"] or ""] * len(ids), names)
                for i in np.flatnonzero(scores >= threshold)[:k]:
                    found[ids[i]] = {"entity_id": ids[i], "name": names[i], "source": "jaro_winkler", "chunk_id": None, "snippet": None}
            vector = None if m["vector"] is None else np.asarray(m["vector"], float)
            usable = vector is not None and np.linalg.norm(vector) > 0
            if usable and vectors:
                known = np.array(vectors)
                distance = np.round(1 - known @ vector / (np.linalg.norm(known, axis=1) * np.linalg.norm(vector)), 6)
                for i in sorted(range(len(owners)), key=lambda i: (distance[i], owners[i][0]))[:k]:
                    _, owner, chunk, text = owners[i]
                    if N.keep_context_match(m["name"], name_of[owner]):
                        found.setdefault(owner, {"entity_id": owner, "name": name_of[owner], "source": "embedding", "chunk_id": chunk, "snippet": text})
            chosen = list(found.values())[:k]
            merged, flags = None, []
            if chosen:
                verdicts = judge.judge(m, chosen)
                if len(verdicts) != len(chosen):
                    raise ValueError(f"{len(verdicts)} judgments for {len(chosen)} candidates")
                for c, (verdict, reason) in zip(chosen, verdicts):
                    if verdict == "same" and c["source"] != "jaro_winkler" and not N.looks_generic(m["name"]) and not N.looks_generic(c["name"]):
                        if S.jaro_winkler_arrays([m["name"]], [c["name"]])[0] < guard:
                            verdict, reason = "unsure", f'only context supports "{m["name"]}" being "{c["name"]}", the names are unlike'
                    if verdict == "same" and merged is None:
                        merged = c["entity_id"]
                    elif verdict == "unsure":
                        flags.append({"entity_id": c["entity_id"], "reason": reason})
            owner = merged or m["_new"]
            if merged is None:
                ids.append(owner)
                names.append(m["name"] or "")
                name_of[owner] = m["name"]
            if usable:
                vectors.append(vector)
                owners.append((m["mention_id"], owner, m["chunk_id"], m["snippet"]))
            out.append((m["mention_id"], m["type"], owner, merged is None, [] if merged else flags))
        return pd.DataFrame(out, columns=["mention_id", "type", "entity_id", "is_new", "flags"])

    return _keyed(mentions).groupBy("type").applyInPandas(run, RESOLVED)


@dataclass
class Graph:
    """The graph tables in a folder, one sub-folder per batch: writing a batch again replaces it, so retries add nothing."""

    spark: SparkSession
    path: str

    TABLES = {
        "entities": schemas.ENTITIES + ", founded string",
        "mentioned_in": schemas.MENTIONED_IN,
        "possible_duplicates": schemas.POSSIBLE_DUPLICATES,
        "entity_mentions": "vector_id string, " + schemas.ENTITY_MENTIONS,
    }

    def read(self, table: str, before: int | None = None) -> DataFrame:
        """The table, or what was there before a batch."""
        schema = self.TABLES[table] + ", batch long"
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}")
        if not folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(f"{self.path}/{table}")
        return rows if before is None else rows.where(F.col("batch") < before)

    def write(self, table: str, rows: DataFrame, batch: int) -> None:
        columns = [f.split()[0] for f in self.TABLES[table].split(", ")]
        rows.select(*columns).write.mode("overwrite").parquet(f"{self.path}/{table}/batch={batch}")


def resolve_batch(mentions: DataFrame, graph: Graph, batch: int, judge: Judge, extractions: DataFrame | None = None, settings: Settings = Settings()) -> DataFrame:
    """Resolve one batch against what the graph held before it, and write entities, edges, flags and mention vectors.

    Mentions without candidates found an entity and never reach the judge. Failed judgments come back as rows with an
    ``error`` and write nothing, so a later batch can take them up again.
    """
    rows = materialize(_keyed(mentions), "batch")
    entities, edges, known = (graph.read(t, batch) for t in ("entities", "mentioned_in", "entity_mentions"))
    by_name = C.name_candidates(rows, entities, settings.name_threshold, settings.candidates)
    by_context = C.context_candidates(rows, known, entities, settings.candidates)
    found = C.union_candidates(by_name, by_context, settings.candidates)
    asked = materialize(rows.join(found, "mention_id", "left"), "candidates")
    with_any = asked.where(F.size(F.coalesce("candidates", F.array().cast(asked.schema["candidates"].dataType))) > 0)
    flat = with_any.select("mention_id", F.explode("candidates").alias("c")).select("mention_id", "c.*")
    first = edges.withColumn("_n", F.row_number().over(Window.partitionBy("entity_id", "chunk_id").orderBy("entity_index"))).where("_n = 1")
    facts = extractions if extractions is not None else graph.spark.createDataFrame([], "chunk_id string, docket_numbers array<string>, dates array<string>")
    told = J.enrich(flat, entities, first, facts)
    block = J.facts_text(F.col("pos"), F.col("name"), F.col("snippet"), F.col("role"), F.col("textual_evidence"), F.col("docket_numbers"), F.col("dates"))
    blocks = told.groupBy("mention_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", block.alias("b")))), lambda x: x["b"]).alias("_blocks"))
    own = with_any.join(blocks, "mention_id")
    none = F.array().cast("array<string>")
    question = J.prompt(F.col("name"), F.col("type"), F.col("textual_evidence"), F.coalesce("docket_numbers", none) if "docket_numbers" in own.columns else none, F.coalesce("dates", none) if "dates" in own.columns else none, F.col("_blocks"))
    # judgments are written before use: a model must not be asked twice
    judged = judged_table = materialize(J.ask(own.select("mention_id", "name", "type", "textual_evidence", "candidates", question.alias("prompt")), judge, settings.model_partitions), "judgments")
    wrong = J.count_mismatch(F.col("candidates"), F.col("judgments"))
    judged = judged.withColumn("error", F.coalesce("error", wrong))
    pairs = judged.where("error is null").select("mention_id", F.col("name").alias("mention_name"), F.posexplode(J.zip_judgments(F.col("candidates"), F.col("judgments"))).alias("_i", "z"))
    candidate, judgment = F.col("z.candidate"), F.col("z.judgment")
    pairs = pairs.select("mention_id", "mention_name", *(candidate[c].alias(c) for c in ("pos", "entity_id", "name", "source")), judgment["verdict"].alias("verdict"), judgment["reason"].alias("reason"))
    outcomes = J.outcome(J.guard_rows(pairs, settings.guard_threshold))
    failed = judged.where("error is not null").select("mention_id", "error")
    resolved = rows.join(outcomes, "mention_id", "left").join(failed, "mention_id", "left")
    resolved = resolved.withColumn("entity_id", F.when(F.col("error").isNull(), F.coalesce("merged_into", "_new")))
    resolved = resolved.withColumn("is_new", F.col("error").isNull() & F.col("merged_into").isNull())
    done = materialize(resolved, "resolved")
    good = done.where("error is null")
    graph.write("entities", good.where("is_new").select("entity_id", "name", "type", F.col("_order").alias("founded")), batch)
    graph.write("possible_duplicates", J.flag_edges(good.where("is_new and flags is not null")), batch)
    graph.write("mentioned_in", good, batch)
    discard(rows, asked, judged_table)
    graph.write("entity_mentions", good.where("vector is not null").select(F.col("mention_id").alias("vector_id"), "entity_id", "mention_text", F.col("snippet").alias("context_snippet"), "vector", F.col("type").alias("entity_type"), "chunk_id"), batch)
    return done.select("mention_id", "type", "entity_id", "is_new", F.coalesce("flags", F.array().cast("array<struct<entity_id:string,reason:string>>")).alias("flags"), "error")


def resolve_batches(mentions: DataFrame, graph: Graph, judge: Judge, size: int, extractions: DataFrame | None = None, settings: Settings = Settings(), first: int = 0) -> DataFrame | None:
    """All mentions in order, ``size`` at a time, in batches numbered from ``first``. Returns the failed mentions' errors.

    The driver sees only the number of batches. The mentions are written first, so that each one's vector is computed
    once; errors are appended to a table.
    """
    ordered = materialize(_keyed(mentions).drop("_new"), "mentions")
    total = ordered.select("_order").distinct().count()
    ranked = materialize(_global_rank(ordered), "ordered")
    discard(ordered)
    errors = None
    for batch in range(-(-total // size)):
        part = ranked.where((F.col("_rank") >= batch * size) & (F.col("_rank") < (batch + 1) * size)).drop("_rank", "_order")
        failed = resolve_batch(part, graph, first + batch, judge, extractions, settings).where("error is not null").select("mention_id", "error")
        errors = materialize(failed, "errors") if errors is None else append(errors, failed)
    discard(ranked)
    return errors


def _global_rank(rows: DataFrame) -> DataFrame:
    """Ranks in the order of creation, from range partitions and their sizes: no window over all rows in one task."""
    parts = materialize(rows.repartitionByRange("_order").sortWithinPartitions("_order").withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = parts.groupBy("_part").count()
    before = sizes.select("_part", F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_part").orderBy("_order")
    return parts.withColumn("_n", F.row_number().over(within) - 1).join(before, "_part").withColumn("_rank", F.col("_n") + F.col("_before")).drop("_part", "_n", "_before")


def resolve_bulk(mentions: DataFrame, threshold: float = 0.93, variant: S.Variant = S.PUBLISHED) -> DataFrame:
    """All mentions at once by names: each takes at most one parent, the first earlier mention that is alike, and roots are entities.

    A parent forest never merges two roots, unlike components over all alike pairs. It isn't the fold: there a name is
    compared with an entity's founding name only.
    """
    rows = materialize(_keyed(mentions).select("mention_id", "type", "name", "_order", "_new"), "bulk")
    named = rows.groupBy("type", "name").agg(F.min(F.struct("_order", "mention_id", "_new")).alias("first"))
    named = materialize(named.select("type", "name", "first.*"), "bulk-names")
    pairs = C.similar_names(named, named, threshold, variant)
    left = named.select("type", "name", F.col("_order").alias("_at"))
    right = named.select("type", F.col("name").alias("other"), F.col("_order").alias("_earlier"))
    earlier = pairs.join(left, ["type", "name"]).join(right, ["type", "other"]).where("_earlier < _at")
    parent = earlier.groupBy("type", "name").agg(F.min(F.struct("_earlier", "other")).alias("p")).select("type", "name", F.col("p.other").alias("up"))
    links = materialize(named.join(parent, ["type", "name"], "left").select("type", "name", F.coalesce("up", "name").alias("up")), "parents")
    while True:  # pointer jumping: the depth halves in every round
        over = links.select("type", F.col("name").alias("up"), F.col("up").alias("top"))
        after = materialize(links.join(over, ["type", "up"]).select("type", "name", F.col("top").alias("up")), "parents")
        same = after.join(links, ["type", "name", "up"], "left_anti").isEmpty()
        links = after
        if same:
            break
    roots = links.join(named.select("type", F.col("name").alias("up"), F.col("_new").alias("entity_id")), ["type", "up"])
    return rows.join(roots.select("type", "name", "entity_id"), ["type", "name"]).select("mention_id", "type", "entity_id")


def clean_up(entities: DataFrame, judge: Judge, settings: Settings = Settings()) -> DataFrame:
    """Duplicates among the entities themselves: ``entity_id, root`` for all of them.

    Pairs of similar names go to the judge; those judged the same are merged into the earliest founded. Of a name that
    many entities bear, each is compared with the earliest of that name, and other names with that one only: the
    number of pairs grows with the entities and not with their square.
    """
    own = entities.select("type", "name", F.col("entity_id").alias("a"), F.col("founded").alias("fa"))
    named = own.groupBy("type", "name").agg(F.min(F.struct("fa", "a")).alias("first"))
    named = materialize(named.select("type", "name", F.col("first.a").alias("a"), F.col("first.fa").alias("fa")), "names")
    other = named.select("type", F.col("name").alias("other"), F.col("a").alias("b"), F.col("fa").alias("fb"))
    across = C.similar_names(named, named, settings.name_threshold).where("name <> other").select("type", "name", "other")
    across = across.join(named, ["type", "name"]).join(other, ["type", "other"]).where("fb < fa")
    within = own.join(other.withColumn("name", F.col("other")), ["type", "name"]).where("a <> b")
    columns = ["a", "b", "fa", "fb", "name", "other"]
    both = across.select(*columns).union(within.select(*columns))
    item = F.struct(F.lit(1).alias("pos"), F.col("b").alias("entity_id"), F.col("other").alias("name"), F.lit("jaro_winkler").alias("source"))
    judged = materialize(J.ask(both.select("a", "b", "fa", "fb", "name", F.array(item).alias("candidates")), judge, settings.model_partitions), "clean-up")
    same = judged.where((F.try_element_at("judgments", F.lit(1))["verdict"] == "same") & F.col("error").isNull())
    # ids that sort by founding, so that the smallest of a component is the earliest
    key = lambda f, i: F.concat_ws("\x00", f, i)
    roots = components(same.select(key(F.col("fa"), F.col("a")).alias("a"), key(F.col("fb"), F.col("b")).alias("b")), "clean-up")
    roots = roots.select(F.element_at(F.split("node", "\x00"), -1).alias("entity_id"), F.element_at(F.split("root", "\x00"), -1).alias("root"))
    return entities.select("entity_id").join(roots, "entity_id", "left").select("entity_id", F.coalesce("root", "entity_id").alias("root"))


def repoint(rows: DataFrame, roots: DataFrame, *columns: str) -> DataFrame:
    """``rows`` with entity ids in ``columns`` replaced by their roots; flags of an entity with itself go."""
    for c in columns:
        to = roots.select(F.col("entity_id").alias("_from"), F.col("root").alias("_to"))
        rows = rows.join(to, rows[c] == to["_from"], "left").withColumn(c, F.coalesce("_to", c)).drop("_from", "_to")
    return rows.where(F.col(columns[0]) != F.col(columns[1])) if len(columns) == 2 else rows
