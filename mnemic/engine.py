"""Facade: one object that holds a store and answers queries over it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemic import schemas
from mnemic.functions import kernels
from mnemic.functions import vectors as V
from mnemic.operators import addressing, beliefs, compose, encoder, hierarchy, planner, propagate, prototypes, roles, substrate, writer
from mnemic.session import materialize, ship
from mnemic.sources.store import Store


class Memory:
    """A graph memory: texts and beliefs in, ranked entities, subgraph vectors, attributions and facts out.

    Every method runs DataFrame plans over the store's current snapshot; ``read`` answers a batch of queries, each by
    itself. Parts can be exchanged: ``extract`` (text to triples), ``plan`` (queries to plans), ``query_vector``
    (text column to vector column, for routing), ``summarize`` (parent rows to their names and descriptions).
    """

    def __init__(self, spark: SparkSession, path: str | None = None, kernel: str = "ternary", top_k: int = 8, temperature: float = addressing.TEMPERATURE, weights: dict[str, float] | None = None, extract=writer.triples_of, plan=planner.plans, dim: int = 1024, query_vector=None, summarize=None, beam: int = 3, routed: bool = False, key: str | None = None, store: Store | None = None) -> None:
        if temperature <= 0:
            raise ValueError("the temperature must be positive")
        self.kernel = kernels.kernel(kernel, dim)
        ship(spark)
        self.spark, self.store = spark, store or Store(spark, path, key=key)
        self.top_k, self.temperature, self.weights = top_k, temperature, weights
        self.extract, self.plan, self.summarize = extract, plan, summarize
        self.query_vector = query_vector or self.kernel.seed
        self.beam, self.routed = beam, routed
        self.propagation = propagate.Weights()
        self.encoder: encoder.ScalarEncoder | None = None
        self.classes: DataFrame | None = None

    def close(self) -> None:
        """Leave the store's versions as they are and forget the snapshot."""
        self.store.tables = {t: schemas.empty(self.spark, t) for t in schemas.TABLES}
        self.classes = self.encoder = None

    # --- writing ---------------------------------------------------------------------------------------

    def ingest(self, texts: DataFrame, now: float) -> int:
        """Add documents (anchor, text), extract their triples, and write these. Returns the number of distinct
        triples. Documents whose anchor is known are left as they are."""
        s = self.store
        docs = texts.select("anchor", "text").dropDuplicates(["anchor"]).join(s["documents"].select("anchor"), "anchor", "left_anti").withColumn("doc_id", F.xxhash64("anchor"))
        docs = materialize(docs, "new-documents")
        t = writer.triples(docs, self.extract).join(docs.select("doc_id", "anchor"), "doc_id").select("head", "relation", "tail", F.col("anchor").alias("source"))
        n = self.ingest_triples(t, now)
        s.put("documents", materialize(s["documents"].unionByName(docs.select("doc_id", "anchor", "text", F.lit(now).alias("created_at"))), "documents"))
        return n

    def ingest_triples(self, triples: DataFrame, now: float) -> int:
        """Write triples (head, relation, tail[, source]): entities that are missing are created with their vector and
        themselves as an alias; a triple weighs the less, the more its relation was seen before it; known edges are
        reinforced up to the greatest weight. Returns the number of distinct triples."""
        s = self.store
        source = F.col("source") if "source" in triples.columns else F.lit("")
        t = materialize(triples.select("head", "relation", "tail", F.coalesce(source, F.lit("")).alias("source")).dropna(), "triples")
        names = t.select(F.col("head").alias("surface")).union(t.select("tail")).distinct()
        found = self._ensured(names, now)
        at = lambda k: found.select(F.col("surface").alias(k), F.col("entity_id").alias(f"{k}_id"))
        new = t.join(at("head"), "head").join(at("tail"), "tail").filter("head_id <> tail_id").select("head_id", "tail_id", "relation", "source", F.pmod(F.xxhash64("head_id", "tail_id", "relation", "source"), F.lit(1 << 40)).alias("row"))
        # the tally of a relation: its edges in the store, then its new triples in order
        tally = s["edges"].groupBy("relation").agg(F.count(F.lit(1)).alias("before"))
        counted = substrate.running_count(materialize(new, "new-edges"), "relation", "row", 1 << 24)
        counted = counted.join(tally, "relation", "left").withColumn("weight", substrate.base_weight(F.col("tally") + F.coalesce("before", F.lit(0))))
        new = counted.select("head_id", "tail_id", "relation", "weight", "source", F.lit(now).alias("created_at"), F.xxhash64("head_id", "tail_id", "relation").alias("id"), F.lit(1).alias("is_new"))
        keep = s["edges"].select("head_id", "tail_id", "relation", "weight", "source", "created_at", "id", F.lit(0).alias("is_new")).unionByName(new)
        first = F.struct("is_new", "id", "source")
        merged = keep.groupBy("head_id", "tail_id", "relation").agg(F.min_by("id", first).alias("id"), F.least(F.sum("weight"), F.lit(schemas.MAX_WEIGHT)).alias("weight"), F.min_by("source", first).alias("source"), F.min_by("created_at", first).alias("created_at"))
        meta = s["edges"].drop("weight", "source", "created_at", "head_id", "tail_id", "relation")
        s.put("edges", materialize(merged.join(meta, "id", "left"), "edges"))
        return t.select("head", "relation", "tail").distinct().count()

    def _ensured(self, names: DataFrame, now: float, kind: str = "concept") -> DataFrame:
        """(surface, entity_id) of names (surface), whose missing entities are created with vector and alias."""
        s = self.store
        fresh = substrate.ensure_entities(names, s["entities"], s["aliases"]).select(F.xxhash64("canonical").alias("id"), "canonical", F.lit(kind).alias("type"), F.lit("").alias("description"), self.kernel.seed(F.col("canonical")).cast("array<double>").alias("hv"), F.lit(self.kernel.name).alias("hv_kernel"), F.lit(now).alias("created_at"), F.lit(0).alias("layer"))
        entities = materialize(s["entities"].unionByName(fresh), "entities")
        found = materialize(substrate.resolve(names, entities, s["aliases"]).select("surface", "entity_id"), "resolved")
        surfaces = found.unionByName(fresh.select(F.col("canonical").alias("surface"), F.col("id").alias("entity_id"))).distinct()
        alias = surfaces.select(F.xxhash64("entity_id", "surface").alias("id"), "entity_id", "surface", F.lit(now).alias("created_at"))
        alias = alias.join(s["aliases"].select("entity_id", "surface"), ["entity_id", "surface"], "left_anti").select(*s["aliases"].columns)
        s.put("aliases", materialize(s["aliases"].unionByName(alias), "aliases")).put("entities", entities)
        return found

    def set_vectors(self, vectors: DataFrame) -> None:
        """Set the vectors of entities (id, hv) under this memory's kernel."""
        e = self.store["entities"].join(vectors.select("id", F.col("hv").cast("array<double>").alias("new")), "id", "left")
        e = e.withColumn("hv", F.coalesce("new", "hv")).withColumn("hv_kernel", F.when(F.col("new").isNotNull(), self.kernel.name).otherwise(F.col("hv_kernel")))
        self.store.put("entities", materialize(e, "entities"))

    def set_layer(self, layers: DataFrame) -> None:
        """Move entities (id, layer) to a layer."""
        e = self.store["entities"].join(layers.select("id", F.col("layer").alias("new")), "id", "left")
        self.store.put("entities", materialize(e.withColumn("layer", F.coalesce("new", "layer")), "entities"))

    # --- beliefs ---------------------------------------------------------------------------------------

    def assert_beliefs(self, rows: DataFrame, now: float) -> None:
        """Assert (head, relation, tail, kind[, confidence]) as beliefs with the default confidence of their source
        kind where they have none; what a model asserts is quarantined. Of several rows of one belief all count
        for its weight, the last by confidence for the rest."""
        rows = materialize(rows, "assertions")
        found = self._ensured(rows.select(F.col("head").alias("surface")).union(rows.select("tail")).distinct(), now)
        at = lambda k: found.select(F.col("surface").alias(k), F.col("entity_id").alias(f"{k}_id"))
        c = F.col("confidence") if "confidence" in rows.columns else F.lit(None).cast("double")
        log = rows.withColumn("c", F.coalesce(c, beliefs.default_confidence(F.col("kind")))).join(at("head"), "head").join(at("tail"), "tail")
        new = log.groupBy("head_id", "tail_id", "relation").agg(F.sum("c").alias("w"), F.max_by("kind", "c").alias("kind"), F.max("c").alias("c"))
        self._merge(new.select("head_id", "tail_id", "relation", "w", F.col("kind").alias("source_type"), F.col("c").alias("confidence"), (F.col("kind") == "model").alias("quarantined")), now)

    def _merge(self, new: DataFrame, now: float) -> None:
        """Edges after belief rows (head_id, tail_id, relation, w, source_type, confidence, quarantined)."""
        s, key = self.store, ["head_id", "tail_id", "relation"]
        old = s["edges"]
        n = new.select(*key, "w", *[F.col(c).alias(f"n_{c}") for c in ("source_type", "confidence", "quarantined")])
        j = old.join(n, key, "full")
        hit = F.col("w").isNotNull()
        added = {"id": F.coalesce("id", F.xxhash64(*key)), "weight": F.when(hit, F.least(F.coalesce("weight", F.lit(0.0)) + F.col("w"), F.lit(schemas.MAX_WEIGHT))).otherwise(F.col("weight")), "created_at": F.coalesce("created_at", F.lit(now)), "revised_at": F.when(hit, F.lit(now)).otherwise(F.col("revised_at"))}
        for c in ("source_type", "confidence", "quarantined"):
            added[c] = F.coalesce(f"n_{c}", c)
        s.put("edges", materialize(j.select(*[added.get(c, F.col(c)).alias(c) for c in old.columns]), "edges"))

    def revise(self, rows: DataFrame, now: float) -> DataFrame:
        """Revise beliefs by rows (seq, head, relation, tail, kind, confidence) in order of seq, after what the store
        holds: the belief that ends up active stays, others of its (head, relation) are demoted. Returns the outcome
        per (head_id, relation)."""
        rows = materialize(rows, "revisions")
        found = self._ensured(rows.select(F.col("head").alias("surface")).union(rows.select("tail")).distinct(), now)
        at = lambda k: found.select(F.col("surface").alias(k), F.col("entity_id").alias(f"{k}_id"))
        new = rows.join(at("head"), "head").join(at("tail"), "tail").select("head_id", "relation", F.struct(F.lit(1), "seq").alias("id"), "tail_id", "kind", F.coalesce("confidence", beliefs.default_confidence(F.col("kind"))).alias("confidence"))
        old = beliefs.assertions(self.store["edges"].filter("not quarantined")).select("head_id", "relation", F.struct(F.lit(0), F.col("id").alias("seq")).alias("id"), "tail_id", "kind", "confidence").join(new.select("head_id", "relation").distinct(), ["head_id", "relation"], "left_semi")
        out = materialize(beliefs.revised(old.unionByName(new)), "revised")
        won = out.filter("tail_id is not null")
        self._merge(won.join(new.select("head_id", "relation", "tail_id").distinct(), ["head_id", "relation", "tail_id"], "left_semi").select("head_id", "tail_id", "relation", F.col("confidence").alias("w"), F.col("kind").alias("source_type"), "confidence", F.lit(False).alias("quarantined")), now)
        e = self.store["edges"].join(won.select("head_id", "relation", F.col("tail_id").alias("won")), ["head_id", "relation"], "left")
        lost = (F.col("won") != F.col("tail_id")) & ~F.col("quarantined")
        e = e.withColumn("confidence", F.when(lost, schemas.DEMOTED_CONFIDENCE).otherwise(F.col("confidence"))).withColumn("revised_at", F.when(lost, F.lit(now)).otherwise(F.col("revised_at"))).withColumn("quarantined", F.col("quarantined") | F.coalesce(lost, F.lit(False)))
        self.store.put("edges", materialize(e.select(*self.store["edges"].columns), "edges"))
        return out

    def corroborate(self, rows: DataFrame) -> int:
        """Evidence (head, relation, tail, kind) for beliefs the store holds: quarantined ones are released, active ones
        gain confidence. Returns how many changed."""
        names = rows.select(F.col("head").alias("surface")).union(rows.select("tail")).distinct()
        found = materialize(substrate.resolve(names, self.store["entities"], self.store["aliases"]).select("surface", "entity_id"), "resolved")
        at = lambda k: found.select(F.col("surface").alias(k), F.col("entity_id").alias(f"{k}_id"))
        evidence = rows.join(at("head"), "head").join(at("tail"), "tail").select("head_id", "relation", "tail_id", "kind")
        held = self.store["edges"].withColumn("kind", beliefs.source_kind(F.col("source_type")))
        c = materialize(beliefs.corroborated(held, evidence).filter("changed"), "corroborated")
        self.store.put("edges", materialize(substrate.patch(self.store["edges"], c.select("id", F.col("kind").alias("source_type"), "confidence", "quarantined")), "edges"))
        return c.count()

    def consolidate_beliefs(self) -> int:
        """Keep the best of contradicting beliefs and demote the others; returns the number of demoted ones."""
        held = self.store["edges"].withColumn("kind", beliefs.source_kind(F.col("source_type")))
        c = materialize(beliefs.consolidated(held).filter("demoted"), "consolidated")
        self.store.put("edges", materialize(substrate.patch(self.store["edges"], c.select("id", "confidence", "quarantined")), "edges"))
        return c.count()

    def decay(self, now: float, half_life: float, floor: float = 0.0) -> None:
        e = self.store["edges"]
        self.store.put("edges", e.withColumn("weight", substrate.decayed(F.col("weight"), F.col("last_used"), F.col("created_at"), now, half_life, floor)))

    def build_hierarchy(self, max_layer: int = 4, node_cap: int = 8) -> int:
        """Replace the summary layers; returns the number of summary nodes."""
        s = self.store
        leaves, aliases, edges = substrate.cleared(s["entities"], s["aliases"], s["edges"])
        leaves = materialize(leaves, "leaves")
        pairs = materialize(roles.collapsed_sum(substrate.leaf_graph(edges, leaves)), "pairs")
        parents, tree = hierarchy.build(leaves.select("id", "canonical"), pairs, self._vectors(leaves), max_layer, node_cap, self.kernel)
        if self.summarize is not None:
            parents = materialize(self.summarize(parents), "summarized")
        up = parents.withColumn("type", F.lit("summary")).withColumn("hv_kernel", F.lit(self.kernel.name))
        s.put("entities", materialize(leaves.unionByName(up, allowMissingColumns=True), "entities"))
        s.put("aliases", aliases).put("edges", edges)
        s.put("hierarchy", materialize(tree.withColumn("id", F.xxhash64("parent_id", "child_id")), "hierarchy"))
        return parents.count()

    # --- reading ---------------------------------------------------------------------------------------

    def _vectors(self, entities: DataFrame) -> DataFrame:
        """(id, hv): stored vectors of this kernel and size, and for other entities the vector of their name."""
        own = (F.col("hv_kernel") == self.kernel.name) & (F.size("hv") == self.kernel.dim)
        have = entities.filter(own).select("id", F.col("hv").cast("array<double>").alias("hv"))
        made = entities.filter(~F.coalesce(own, F.lit(False)) & F.col("canonical").isNotNull()).select("id", self.kernel.seed(F.col("canonical")).cast("array<double>").alias("hv"))
        return have.unionByName(made)

    def _candidates(self, plans: DataFrame) -> DataFrame:
        """(query_id, id): routed leaves, their neighbours, and entities that a cue of the query names."""
        s = self.store
        q = plans.select("query_id", self.query_vector(F.col("text")).alias("hv"))
        kept, self.last_route = hierarchy.route(q, s["entities"], s["hierarchy"], self._vectors(s["entities"]), self.beam, kernel=self.kernel)
        seeds = materialize(kept.filter("layer = 0").select("query_id", "id"), "routed")
        leaf = s["entities"].filter("layer = 0").select("id")
        hop = seeds.join(substrate.neighbours(s["edges"], leaf), "id").select("query_id", F.col("neighbour").alias("id"))
        cues = plans.select("query_id", F.explode(F.array_distinct(F.concat("mentions", "aliases"))).alias("surface"))
        named = cues.join(substrate.resolve(cues, s["entities"], s["aliases"]).filter("entity_id is not null"), "surface").select("query_id", F.col("entity_id").alias("id"))
        return materialize(seeds.union(hop).union(named.join(leaf, "id", "left_semi").select("query_id", "id")).distinct(), "candidates")

    def read(self, queries: DataFrame, routed: bool | None = None, target: DataFrame | None = None) -> dict[str, DataFrame]:
        """Answers for queries (query_id, text), each by itself: 'plans', 'activated' (query_id, rank, id, activation),
        'edges' (the activated subgraph), 'composed' (query_id, pos, s, n, x), 'classes' (query_id, predicted, score,
        margin; without rows if no classes are known), 'paths' and 'attribution' (against the prototype of the
        predicted class, else of ``target`` (query_id, label), else the composed vector itself), 'documents'
        (query_id, anchor, text). ``routed`` scores only entities that routing finds; a query for which it finds none
        is scored against all. An empty store gives empty answers."""
        s = self.store
        plans = materialize(self.plan(queries), "plans")
        e, a = s["entities"], s["aliases"]
        if self.routed if routed is None else routed:
            found = self._candidates(plans)
            scores = addressing.channels(plans, e, a, candidates=found)
            lost = plans.join(found.select("query_id").distinct(), "query_id", "left_anti")
            scores = scores.unionByName(addressing.channels(lost, e, a))
        else:
            scores = addressing.channels(plans, e, a)
        acts = materialize(addressing.activations(scores, self.temperature, self.weights), "activations")
        graph = substrate.leaf_graph(s["edges"], e)
        after = propagate.propagate(graph, acts.select("query_id", "id", "activation"), self.propagation, states=True)
        self.states = after = materialize(after, "states")
        lifted = acts.join(after.select("query_id", "id", (F.col("final") - F.col("initial")).alias("lift")), ["query_id", "id"], "left").select("query_id", "id", (F.col("activation") + F.coalesce("lift", F.lit(0.0))).alias("activation"))
        top = materialize(addressing.top_k(lifted, self.top_k), "activated")
        inner = s["edges"].filter("not quarantined")
        ends = lambda k: top.select("query_id", F.col("id").alias(k))
        inner = inner.join(ends("head_id"), "head_id").join(ends("tail_id"), ["query_id", "tail_id"]).select("query_id", "id", "head_id", "relation", "tail_id", "weight")
        inner = materialize(inner, "subgraph")
        vectors = materialize(self._vectors(e).join(top.select("id").distinct(), "id", "left_semi"), "vectors")
        paths = materialize(compose.paths(inner, top, vectors, self.kernel), "paths")
        whole = materialize(compose.composed(paths, self.kernel, top, vectors), "composed")
        predicted = self._predict(whole)
        reference = self._reference(whole, predicted, target)
        similar = materialize(compose.path_similarity(paths, reference, self.kernel), "similar")
        importance = compose.leave_one_out(paths, whole, reference, self.kernel)
        docs = s["edges"].filter("not quarantined and source <> ''").select(F.explode(F.array("head_id", "tail_id")).alias("id"), substrate.source_anchor(F.col("source")).alias("anchor"))
        docs = docs.join(top.select("query_id", "id"), "id").select("query_id", "anchor").distinct().join(s["documents"].select("anchor", "text"), "anchor").select("query_id", "anchor", "text")
        return {"plans": plans, "activated": top, "edges": inner, "composed": whole, "classes": predicted, "paths": compose.top_paths(similar), "attribution": importance, "documents": docs}

    def _predict(self, whole: DataFrame) -> DataFrame:
        if self.classes is None:
            return self.spark.createDataFrame([], "query_id long, predicted long, score double, margin double")
        return materialize(prototypes.predict(V.assembled(whole, ["query_id"]).select("query_id", F.col("hv").cast("array<double>").alias("hv")), self.classes, "query_id"), "predicted")

    def _reference(self, whole: DataFrame, predicted: DataFrame, target: DataFrame | None) -> DataFrame:
        """(query_id, pos, x) that attributions of each query refer to."""
        own = whole.select("query_id", "pos", F.col("x").cast("double").alias("x"))
        if self.classes is None:
            return own
        label = predicted.select("query_id", F.col("predicted").alias("label"))
        if target is not None:
            label = label.unionByName(target.join(label, "query_id", "left_anti").select("query_id", "label"))
        chosen = label.join(self.classes, "label").select("query_id", F.posexplode("hv").alias("pos", "x"))
        return chosen.unionByName(own.join(chosen.select("query_id").distinct(), "query_id", "left_anti").select("query_id", "pos", "x"))

    def recall(self, cue: str, max_items: int = 8) -> str:
        """At most ``max_items`` lines of what the store knows about a cue, documents of the activated entities before
        relations between them; '' where there is nothing."""
        s = self.store
        if max_items < 1 or not s["entities"].limit(1).collect():
            return ""
        found = self.read(self.spark.createDataFrame([(1, cue)], "query_id long, text string"))
        lines = [f"- ({r['anchor']}) {(r['text'] or '').strip()}" for r in found["documents"].orderBy("anchor").limit(max_items).collect()]
        if len(lines) < max_items:
            name = lambda k: s["entities"].select(F.col("id").alias(f"{k}_id"), F.col("canonical").alias(k))
            rows = found["edges"].join(name("head"), "head_id").join(name("tail"), "tail_id").orderBy(F.desc("weight"), "id").limit(max_items - len(lines)).collect()
            lines += [f"- {r['head']} {'relates to' if r['relation'].startswith('__') else r['relation']} {r['tail']}" for r in rows]
        return "\n".join(["[recalled memory]", *lines]) if lines else ""

    def believe(self) -> DataFrame:
        """Best active belief of every (head, relation), null where the store abstains."""
        return beliefs.recalled(beliefs.asserted(beliefs.assertions(self.store["edges"])))

    # --- scalars ---------------------------------------------------------------------------------------

    def fit_classes(self, samples: DataFrame, params: list[str], label: str, groups: dict[str, list[str]] | None = None, dim: int = 256) -> DataFrame:
        """Fit the scalar encoder and one prototype per class."""
        self.encoder = encoder.ScalarEncoder(params, dim).fit(samples)
        self.groups = groups or {"all": params}
        rows = samples.select(F.col(label).alias("label"), self.encoder.grouped(self.groups).alias("hv"))
        self.classes = materialize(prototypes.fit(rows), "classes")
        return self.classes

    def classify(self, samples: DataFrame, key: str) -> DataFrame:
        if self.classes is None or self.encoder is None:
            raise RuntimeError("no classes are fitted")
        return prototypes.predict(samples.select(key, self.encoder.grouped(self.groups).alias("hv")), self.classes, key)

    def register_class(self, label: int, vectors: DataFrame) -> None:
        """Add a class, or bundle more vectors (hv) into its present prototype."""
        new = vectors.select(F.lit(label).cast("long").alias("label"), F.col("hv").cast("array<double>").alias("hv"))
        old = self.classes.select(F.col("label").cast("long").alias("label"), "hv") if self.classes is not None else None
        mine = prototypes.fit(new if old is None else new.unionByName(old.filter(F.col("label") == label)))
        self.classes = materialize(mine if old is None else mine.unionByName(old.filter(F.col("label") != label)), "classes")

    def separability(self, components: DataFrame) -> DataFrame:
        """Alignment and separation of component vectors (component, label, hv) against the classes."""
        if self.classes is None:
            raise RuntimeError("no classes are fitted")
        return prototypes.separability(components, self.classes)

    def group_attribution(self, samples: DataFrame, key: str) -> DataFrame:
        """(key, group, similarity) of every parameter group's vector to the predicted class's prototype."""
        if self.classes is None or self.encoder is None:
            raise RuntimeError("no classes are fitted")
        best = self.classify(samples, key).select(key, F.col("predicted").alias("label")).join(self.classes, "label").select(key, F.col("hv").alias("prototype"))
        parts = [samples.select(key, F.lit(g).alias("group"), self.encoder.grouped({g: params}).alias("hv")) for g, params in self.groups.items()]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out.join(best, key).select(key, "group", F.round(V.cosine(F.col("hv"), F.col("prototype")), 6).alias("similarity"))

    def save_classes(self, path: str) -> None:
        """Write the prototypes as packed real vectors."""
        if self.classes is None:
            raise RuntimeError("no classes are fitted")
        self.classes.select("label", F.size("hv").alias("dim"), V.pack_real("hv").alias("packed")).write.mode("overwrite").parquet(path)

    def load_classes(self, path: str) -> None:
        self.classes = materialize(self.spark.read.parquet(path).select("label", V.unpack_real("packed", "dim").alias("hv")), "classes")

    def summary(self) -> dict[str, int]:
        return self.store.counts()
