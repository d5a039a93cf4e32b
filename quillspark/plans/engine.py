"""The query engine: question to evidence, over one artifact table with vectors.

All pools of a round are one job: the index is filtered to the wanted layouts (which prunes its
partitions), scored once, and ranked per pool with window functions.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark import dims
from quillspark.functions import text as T
from quillspark.functions import vectors as V
from quillspark.operators import assemble, ingest, lexical, retrieval
from quillspark.plans import reflect
from quillspark.plans.intent import Intent, intent_of, name_dictionary
from quillspark.runtime import stage

VECTORS = ["content_vector", "token_vecs", "fde"]


@dataclass
class Engine:
    """``index``: artifacts, with ``content_vector``, ``token_vecs`` and ``fde`` (as ``functions.vectors.represent`` gives) or without.

    A vector that the index lacks is made from the text of every row that is scored, by the embedder (sent to the
    workers), and never stored. ``once``: few questions will be asked, so texts are scanned and no postings written.
    """

    spark: SparkSession
    index: DataFrame
    year: int
    embedder: V.Embedder = field(default_factory=V.HashedEmbedder)
    filter_text_branch: bool = True
    parity: bool = False
    min_score: float = dims.MIN_SCORE
    names: tuple[str, ...] = ()
    postings: lexical.Index | lexical.Scan | None = None
    once: bool = False
    _names: set[str] | None = None

    def intent(self, question: str) -> Intent:
        if self._names is None:
            self._names = name_dictionary(self.index, configured=self.names)
        return intent_of(question, self._names, self.year, self.parity)

    def lexical(self) -> lexical.Index | lexical.Scan:
        """The postings of the artifacts, written once per engine unless given, or a scan in their place."""
        if self.postings is None:
            texts = self.index.select("urn_id", "verbatim_text", "drug_name_generic", F.array_join("drug_name_brand", " ").alias("brands"))
            make = lexical.Scan if self.once else lexical.Index.build
            self.postings = make(texts, "urn_id", ["verbatim_text", "drug_name_generic", "brands"], synonyms=not self.parity)
        return self.postings

    def vectors(self, question: str) -> tuple[list[float], list[list[float]], list[float]]:
        words = question.split()[: V.MAX_TOKENS]
        tokens = self.embedder(words)[:, : V.TOKEN_DIM] if words else np.zeros((0, V.TOKEN_DIM), np.float32)
        tokens = tokens / (np.linalg.norm(tokens, axis=1, keepdims=True) + 1e-9)
        return self.embedder([question])[0].tolist(), tokens.tolist(), V.pooled_encoding(tokens).tolist()

    def closeness(self, query: list[float], column: str) -> Column:
        """The dot product with a vector of the index's rows, stored or made."""
        if column in self.index.columns:
            return V.dot(F.col(column), retrieval.literal_vector(query))
        embedder = self.embedder
        return V.similarity(query, column, lambda: embedder)(F.col("verbatim_text"))

    def with_tokens(self, hits: DataFrame) -> DataFrame:
        """The few rows of ``hits`` with their ``token_vecs``, stored or made, and no other vector."""
        if "token_vecs" not in hits.columns:
            embedder = self.embedder
            hits = hits.withColumn("token_vecs", V.token_vectors(lambda: embedder)(F.col("verbatim_text")))
        return hits.drop("content_vector", "fde")

    def retrieve(self, intent: Intent, hard_dates: bool = False, k: int = 50, best: int = 10, mode: str = "fde") -> DataFrame:
        """Re-ranked hits of all pools, each key in its first pool. ``mode='content'`` scores the text vector instead, filtered by layout only."""
        content, tokens, fde = self.vectors(intent.question)
        pools = intent.pools(4 if self.parity else None)
        named = F.arrays_overlap(
            F.array_union(T.folded_tokens(F.coalesce("drug_name_generic", F.lit(""))), F.flatten(F.transform(F.coalesce("drug_name_brand", F.array().cast("array<string>")), T.folded_tokens))),
            F.array(*[F.lit(w) for d in intent.drugs for w in d.split()]) if intent.drugs else F.array().cast("array<string>"),
        )
        pool_of = F.col("layout_type") if self.parity else F.when(F.col("layout_type") == "structured_fact", "dosing").otherwise(F.col("layout_type"))
        rows = self.index.withColumn("pool", pool_of)
        inside = F.col("pool").isin(pools)
        if mode == "fde":
            if intent.drugs:
                inside = inside & named
            if intent.population:
                inside = inside & ((F.col("pool") != "dosing") | (F.col("patient_population") == intent.population))
            if hard_dates:
                inside = inside & ingest.label_date(F.col("label_version_date").cast("string")).cast("string").between(intent.date_from, intent.date_to)
        query, column = (fde, "fde") if mode == "fde" else (content, "content_vector")
        vector_scores = rows.where(inside).select("pool", F.col("urn_id").alias("id"), self.closeness(query, column).alias("score"))
        w = Window.partitionBy("pool").orderBy(F.desc("score"), "id")
        # Nulls come last. Dropped here, not before, they don't have each score computed twice.
        vector_scores = vector_scores.withColumn("r", F.row_number().over(w)).where((F.col("r") <= k) & F.col("score").isNotNull()).drop("r")

        text_rows = (rows.where(inside) if self.filter_text_branch else rows).select(F.col("urn_id").alias("id"), "pool", F.col("label_version_date").cast("string").alias("d"))
        weights = {"verbatim_text": dims.FIELD_WEIGHTS["text"], "drug_name_generic": dims.FIELD_WEIGHTS["generic"], "brands": dims.FIELD_WEIGHTS["brand"]}
        text_scores = self.lexical().search(" ".join([*intent.drugs, intent.question]), weights, dims.TEXT_BOOST).join(text_rows, "id")
        recent = retrieval.recency(F.col("score"), ingest.label_date(F.col("d")), retrieval.cutoff_of(F.lit(f"{self.year}-07-01").cast("date")), neutral=1.0 if self.parity else 0.0)
        text_scores = text_scores.select("pool", "id", recent.alias("score")).withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).drop("r")

        both = vector_scores.select("pool", "id", ((1 + F.col("score")) / 2).alias("vs")).join(text_scores.withColumnRenamed("score", "ts"), ["pool", "id"], "full")
        scored = both.select("pool", "id", (F.coalesce("vs", F.lit(0.0)) + F.coalesce("ts", F.lit(0.0))).alias("score"))
        top = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        hits = self.index.join(F.broadcast(top.withColumnRenamed("id", "urn_id")), "urn_id")
        ranked = retrieval.rerank(self.with_tokens(hits), tokens, "token_vecs", best, ["pool"])
        order = F.array_position(F.array(*map(F.lit, pools)), F.col("pool"))
        first = retrieval.union_first(ranked.withColumn("pool_ord", order), "urn_id", ["pool_ord", "pool_rank"])
        position = F.row_number().over(Window.orderBy("pool_ord", "pool_rank", "urn_id"))
        return first.withColumn("origin", F.lit("pool")).withColumn("rank", position)

    def lookup(self, name: str, hits: DataFrame, intent: Intent) -> DataFrame:
        """The extra hits of a rewriting: parents of the hits, or the best of their class neighbours."""
        plain = self.index.drop(*VECTORS)
        if name == "parents":
            return assemble.parents(hits, plain)
        near = assemble.class_neighbours(self.index, hits, intent.preferred)
        _, tokens, fde = self.vectors(intent.question)
        scored = near.select(F.col("urn_id").alias("id"), self.closeness(fde, "fde").alias("score"))
        top = retrieval.best_scores(scored, 30).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))
        found = near.join(F.broadcast(top.withColumnRenamed("id", "urn_id")), "urn_id").withColumn("pool", F.lit("neighbours"))
        return retrieval.rerank(self.with_tokens(found), tokens, "token_vecs", 5, ["pool"]).drop("pool").withColumn("origin", F.lit("class"))

    def ask(self, question: str, max_rounds: int = dims.MAX_ROUNDS) -> tuple[DataFrame, list[dict], Intent]:
        """``section, ...`` evidence of a question, the reports of its rounds, and the final intent. One round is the plain pipeline."""
        intent = self.intent(question)
        hits, reports, intent = reflect.reflect(
            intent, lambda i, n: self.retrieve(i, hard_dates=intent.explicit_years and n == 1), self.lookup, self.year, stage, max_rounds, self.min_score,
        )
        return self.evidence(hits, intent), reports, intent

    def prompt(self, evidence: DataFrame, intent: Intent, rounds: int = 1) -> DataFrame:
        """The prompt of an answer, with the dose conflicts among its evidence."""
        conflicts = assemble.dose_conflicts(evidence, parity=self.parity)
        return assemble.prompt(evidence, intent.question, intent.query_type, list(intent.drugs), intent.population, rounds, conflicts)

    def evidence(self, hits: DataFrame, intent: Intent) -> DataFrame:
        """Hits as locked and calibrated nodes by section, with the rows their references name."""
        plain = self.index.drop(*VECTORS)
        nodes = assemble.calibrated(assemble.locked(assemble.nodes(hits)), plain, parity=self.parity)
        nodes = nodes.withColumn("section", F.when(F.col("verbatim_locked"), "verbatim").otherwise("paraphrase"))
        wanted = [c for c, on in (("interaction_ids", intent.wants_interaction or intent.query_type in ("causal", "comparative")), ("raptor_cluster", intent.query_type in ("strategic", "comparative")), ("table_ref", True)) if on and c in nodes.columns]
        if not wanted:
            return nodes
        return nodes.unionByName(assemble.nodes(assemble.expansion(nodes, plain, wanted)), allowMissingColumns=True)
