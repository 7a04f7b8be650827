"""The facade: extract knowledge from a corpus, query it, embed it, keep it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Config
from .functions import scores
from .operators import distill as D
from .operators import el, graph, kg, linking, ontology, rules, similarity, verify
from .operators.extract import RuleExtractor
from .plans.partitions import balanced
from .plans.prompts import LanguageModel
from .plans.sparql import is_select, sparql
from .sources import rdf


@dataclass
class Knowledge:
    """What was extracted: entities, relations, triples and a summary row for each document."""

    entities: DataFrame
    relations: DataFrame
    triples: DataFrame
    summary: DataFrame

    def to_graph(self, name: str = "kg") -> kg.KnowledgeGraph:
        return kg.to_graph(self, name)


class Engine:
    """One engine for a session. Every method works on whole corpora: documents have doc_id and text."""

    def __init__(self, spark: SparkSession, config: Config | None = None, extractor=None, model: LanguageModel | None = None):
        self.spark, self.config = spark, config or Config()
        self.extractor, self.model = extractor or RuleExtractor(), model
        self.ontology: ontology.Ontology | None = None
        self.policies = verify.Policies()

    def load_ontology(self, path: str) -> ontology.Ontology:
        self.ontology = rdf.read_owl(self.spark, path)
        return self.ontology

    def extract_knowledge(self, docs: DataFrame, verify_triples: bool = False, confidence_threshold: float | None = None, rejected: DataFrame | None = None, refuted: DataFrame | None = None, types: DataFrame | None = None) -> Knowledge:
        """Extract, validate, and then verify or filter. Verified results are not filtered; a threshold of None or 0
        is the default. rejected and refuted hold statements (s, p, o) that break rules; without them all are valid, but for
        what the policies refute where types (uri, type) of the entities are given."""
        cfg = self.config.extraction
        o = self.ontology
        x = D.distill(balanced(docs), self.extractor, cfg, o.classes if o else None, o.object_properties if o else None)
        valid = verify.validate(x.triples, rejected).filter("valid")
        summary = D.summaries(x.extracted, valid, ontology_uri=o.uri if o else None)
        if verify_triples:
            v = self.config.verification
            if refuted is None and self.policies.by_name and types is not None:
                refuted = self.policies.refuted(valid, types)
            triples = verify.verify(valid, v.gate, refuted) if v.enable_verification else valid
        else:
            triples = valid.filter(F.col("confidence") >= scores.threshold(confidence_threshold, cfg.confidence_threshold))
        return Knowledge(x.entities, x.relations, triples, summary)

    def extract_to_graph(self, docs: DataFrame, name: str = "kg", **options) -> kg.KnowledgeGraph:
        return self.extract_knowledge(docs, **options).to_graph(name)

    def query(self, question: str, triples: DataFrame) -> DataFrame:
        """A SELECT query, or a question that the language model turns into one."""
        if is_select(question):
            return sparql(question, triples)
        if self.model is None:
            raise ValueError("a question in words needs a language model")
        return sparql(self.model.to_sparql(question, self.ontology.prompt_schema() if self.ontology else ""), triples)

    def reason(self, triples: DataFrame, program: str = rules.OWL_RL, **relations: DataFrame) -> dict[str, DataFrame]:
        """What rules derive from the graph (triple, and type of its rdf:type statements), the loaded ontology's relations and any others
        that are given: a table for each predicate that the rules define."""
        return rules.evaluate(program, self._known(triples) | relations)

    def explain(self, triples: DataFrame, predicate: str, program: str = rules.OWL_RL, **relations: DataFrame) -> DataFrame:
        """Every minimal set of given facts that is enough for each row of a derived predicate."""
        return rules.supports(program, self._known(triples) | relations, predicate)

    def _known(self, triples: DataFrame) -> dict[str, DataFrame]:
        typed = F.col("p") == ontology.TYPE
        return {"triple": triples.filter(~typed).select("s", "p", "o"), "type": triples.filter(typed).select("s", "o")} | (self.ontology or ontology.empty(self.spark)).relations()

    def classify(self) -> DataFrame:
        """(child, parent): the subsumptions that follow from the loaded ontology."""
        if self.ontology is None:
            raise ValueError("no ontology is loaded")
        return el.classify(self.ontology.axioms, self.ontology.classes)

    def link_entities(self, mentions: DataFrame, links: DataFrame | None = None) -> DataFrame:
        return linking.link_entities(mentions, links)

    def build_embeddings(self, triples: DataFrame, method: str = "rdf_walk") -> DataFrame:
        return graph.embed(triples, self.config.embedding, method)

    def find_similar(self, vectors: DataFrame, uri: str, k: int = 10, metric: str = "cosine") -> DataFrame:
        return similarity.find_similar(vectors, uri, k, metric)

    def hybrid_search(self, query: str, triples: DataFrame, vectors: DataFrame, uri: str, var: str, k: int = 10) -> DataFrame:
        """Answers of a query ranked by how similar their `var` is to an entity."""
        answers = self.query(query, triples)
        q = vectors.filter(F.col("uri") == uri).select(F.col("vec").alias("q")).limit(1)
        scored = answers.join(vectors.withColumnRenamed("uri", var), var).join(F.broadcast(q))
        return scored.withColumn("similarity", similarity.similarity(F.col("vec"), F.col("q"))).drop("vec", "q").orderBy(F.desc("similarity"), var).limit(k)

    def save_graph(self, graph_: kg.KnowledgeGraph, path: str, fmt: str = "turtle") -> None:
        rdf.write(graph_, path, fmt)

    def load_graph(self, path: str, fmt: str = "turtle", name: str = "kg") -> kg.KnowledgeGraph:
        return rdf.read(self.spark, path, fmt, name)

    def statistics(self) -> dict:
        return {
            "config": self.config.to_dict(),
            "components": {"extractor": type(self.extractor).__name__, "model": self.model is not None, "ontology": ontology.statistics(self.ontology), "ontology_loaded": self.ontology is not None, "policies": sorted(self.policies.by_name)},
        }
