"""Ontologies as tables: classes, properties, axioms; closures, types, checks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import local_name
from .infer import closure

TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
SUBCLASS = "http://www.w3.org/2000/01/rdf-schema#subClassOf"
DOMAIN = "http://www.w3.org/2000/01/rdf-schema#domain"
RANGE = "http://www.w3.org/2000/01/rdf-schema#range"


@dataclass
class Ontology:
    """classes(ord, uri, label, description, parents), properties(ord, kind, uri, label, description, domain, range), axioms,
    and individuals(uri, label, types) if any are known."""

    classes: DataFrame
    properties: DataFrame
    axioms: DataFrame
    uri: str | None = None
    individuals: DataFrame | None = None

    @property
    def object_properties(self) -> DataFrame:
        return self.properties.filter(F.col("kind") == "object")

    def subclass_pairs(self) -> DataFrame:
        """child, parent: direct ones."""
        return self.classes.select(F.col("uri").alias("child"), F.explode("parents").alias("parent"))

    def hierarchy(self) -> DataFrame:
        """Each class's direct subclasses, sorted."""
        return self.subclass_pairs().groupBy("parent").agg(F.sort_array(F.collect_set("child")).alias("children"))

    def ancestors(self) -> DataFrame:
        """child, parent: all, through any number of steps."""
        return closure(self.subclass_pairs().select(F.col("child").alias("s"), F.col("parent").alias("o"))).select(F.col("s").alias("child"), F.col("o").alias("parent"))

    def statistics(self) -> DataFrame:
        """kind, n: classes, properties of each kind, individuals and axioms; kinds without any count zero."""
        parts = [self.classes.select(F.lit("classes").alias("kind")), self.properties.select(F.concat("kind", F.lit("_properties")).alias("kind")), self.axioms.select(F.lit("axioms").alias("kind"))]
        if self.individuals is not None:
            parts.append(self.individuals.select(F.lit("individuals").alias("kind")))
        kinds = self.classes.sparkSession.createDataFrame([(k,) for k in ("classes", "object_properties", "data_properties", "individuals", "axioms")], "kind string")
        rows = kinds.withColumn("one", F.lit(0))
        for p in parts:
            rows = rows.unionByName(p.withColumn("one", F.lit(1)))
        return rows.groupBy("kind").agg(F.sum("one").alias("n"))

    def types(self) -> DataFrame:
        """s, p, o: the types that the ontology asserts of its individuals."""
        if self.individuals is None:
            return self.classes.limit(0).select(F.col("uri").alias("s"), F.lit(TYPE).alias("p"), F.col("uri").alias("o"))
        return self.individuals.select(F.col("uri").alias("s"), F.lit(TYPE).alias("p"), F.explode("types").alias("o"))

    def to_triples(self) -> DataFrame:
        """The statements of the schema: subclasses, domains and ranges."""
        sub = self.subclass_pairs().select(F.col("child").alias("s"), F.lit(SUBCLASS).alias("p"), F.col("parent").alias("o"))
        part = lambda col, p: self.properties.filter(F.col(col).isNotNull()).select(F.col("uri").alias("s"), F.lit(p).alias("p"), F.col(col).alias("o"))
        return sub.unionByName(part("domain", DOMAIN)).unionByName(part("range", RANGE))

    def normalized(self) -> DataFrame:
        """Axioms in normal form: an equivalence becomes two subclass axioms, a conjunction on the right one axiom for each part."""
        a = self.axioms.select("axiom_type", "components")
        two = a.filter("axiom_type = 'EquivalentClasses'").select(F.explode(F.array(F.col("components"), F.reverse("components"))).alias("components"))
        sub = a.filter("axiom_type = 'SubClassOf'").select("components").unionByName(two)
        split = sub.select(F.explode(F.transform(F.slice("components", F.lit(2), F.greatest(F.size("components") - 1, F.lit(0))), lambda c: F.array(F.col("components")[0], c))).alias("components"))
        rest = a.filter("axiom_type not in ('EquivalentClasses', 'SubClassOf')")
        return split.select(F.lit("SubClassOf").alias("axiom_type"), "components").unionByName(rest)

    def relations(self) -> dict[str, DataFrame]:
        """The schema as relations of the rules in `rules.OWL_RL`: its axioms and the classes' parents."""
        a = self.normalized()
        of = lambda kinds, n: a.filter(F.col("axiom_type").isin(kinds) & (F.size("components") == n)).select(*[F.col("components")[k].alias(f"c{k}") for k in range(n)])
        same = of(["EquivalentObjectProperties", "EquivalentDataProperties"], 2)
        return {
            "subproperty": of(["SubObjectPropertyOf", "SubDataPropertyOf"], 2).unionByName(same).unionByName(same.select(F.col("c1").alias("c0"), F.col("c0").alias("c1"))),
            "chain": of(["SubObjectPropertyOf"], 3), "transitive": of(["TransitiveObjectProperty"], 1), "symmetric": of(["SymmetricObjectProperty"], 1), "inverse": of(["InverseObjectProperties"], 2),
            "domain": of(["ObjectPropertyDomain"], 2), "range": of(["ObjectPropertyRange"], 2),
            "subclass": of(["SubClassOf"], 2).unionByName(self.subclass_pairs().select(F.col("child").alias("c0"), F.col("parent").alias("c1"))),
        }

    def prompt_schema(self, n: int = 20) -> str:
        """The first n classes and object properties as prompt lines."""
        line = lambda r: f"- {r.label}: {r.description or ''}"
        classes = self.classes.orderBy("ord").limit(n).collect()
        props = self.object_properties.orderBy("ord").limit(n).collect()
        return "\n".join(["Classes:", *map(line, classes), "Relations:", *map(line, props)])


def empty(spark: SparkSession) -> Ontology:
    from ..schemas import AXIOM, ONTO_CLASS, ONTO_PROPERTY

    return Ontology(*(spark.createDataFrame([], s) for s in (ONTO_CLASS, ONTO_PROPERTY, AXIOM)))


def verbalize(axioms: DataFrame) -> DataFrame:
    """Axioms in words, by type."""
    name = lambda i: local_name(F.try_element_at("components", F.lit(i)))
    text = (
        F.when(F.col("axiom_type") == "SubClassOf", F.concat(F.lit("every "), name(1), F.lit(" is a "), name(2)))
        .when(F.col("axiom_type") == "DisjointClasses", F.concat(F.lit("nothing is both a "), name(1), F.lit(" and a "), name(2)))
        .when(F.col("axiom_type") == "ObjectPropertyDomain", F.concat(F.lit("whatever has "), name(1), F.lit(" is a "), name(2)))
        .when(F.col("axiom_type") == "ObjectPropertyRange", F.concat(F.lit("whatever is the value of "), name(1), F.lit(" is a "), name(2)))
        .when(F.col("axiom_type").isin("FunctionalObjectProperty", "FunctionalDataProperty"), F.concat(name(1), F.lit(" has at most one value")))
        .otherwise(F.concat(F.col("axiom_type"), F.lit("("), F.array_join("components", ", "), F.lit(")")))
    )
    return axioms.withColumn("verbalization", text)


def entity_types(triples: DataFrame, ontology: Ontology) -> DataFrame:
    """uri, type: asserted types and all classes above them."""
    asserted = triples.filter(F.col("p") == TYPE).select(F.col("s").alias("uri"), F.col("o").alias("type")).distinct()
    above = asserted.join(ontology.ancestors(), F.col("type") == F.col("child")).select("uri", F.col("parent").alias("type"))
    return asserted.unionByName(above).distinct()


def with_inferred_types(entities: DataFrame, types: DataFrame) -> DataFrame:
    """Entities with inferred_types, sorted; entities without types keep what they have (null if nothing)."""
    found = types.groupBy("uri").agg(F.sort_array(F.collect_set("type")).alias("found"))
    kept = F.col("inferred_types") if "inferred_types" in entities.columns else F.lit(None).cast("array<string>")
    return entities.join(found, "uri", "left").withColumn("inferred_types", F.coalesce(kept, "found")).drop("found")


def domain_range_violations(triples: DataFrame, types: DataFrame, properties: DataFrame) -> DataFrame:
    """Triples whose subject (object) has types, none of which is the property's domain (range). Untyped ends are valid."""
    p = properties.select(F.col("uri").alias("p"), "domain", "range")
    t = triples.join(p, "p")

    def wrong(end: str, col: str) -> DataFrame:
        typed = types.select(F.col("uri").alias(end)).distinct()
        fits = types.select(F.col("uri").alias(end), F.col("type").alias(col))
        return t.filter(F.col(col).isNotNull()).join(typed, end, "left_semi").join(fits, [end, col], "left_anti").select("s", "p", "o", F.lit(col).alias("violation"))

    return wrong("s", "domain").unionByName(wrong("o", "range"))


def functional_violations(triples: DataFrame, functional: list[str]) -> DataFrame:
    """Subjects with several values of a functional property."""
    return triples.filter(F.col("p").isin(functional)).groupBy("s", "p").agg(F.count_distinct("o").alias("n_values")).filter("n_values > 1")


def disjoint_violations(types: DataFrame, axioms: DataFrame) -> DataFrame:
    """Entities with two classes of a disjointness axiom, which may name any number."""
    each = axioms.filter("axiom_type = 'DisjointClasses'").select(F.posexplode("components").alias("i", "a"), "components")
    pairs = each.select("a", F.explode(F.slice("components", F.col("i") + 2, F.size("components"))).alias("b")).distinct()
    x = types.join(pairs, F.col("type") == F.col("a")).select("uri", "a", "b")
    return x.join(types.withColumnRenamed("type", "b"), ["uri", "b"]).select("uri", "a", "b").distinct()


def statistics(ontology: Ontology | None) -> dict:
    """loaded, and if so the counts of the ontology's parts."""
    if ontology is None:
        return {"loaded": False}
    return {"loaded": True} | {r.kind: r.n for r in ontology.statistics().collect()}


def is_consistent(*violations: DataFrame) -> bool:
    """No row in any of the violation tables."""
    return all(v.limit(1).count() == 0 for v in violations)
