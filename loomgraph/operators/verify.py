"""Validation and verification of scored triples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


GATE = 0.8


def validate(triples: DataFrame, rejected: DataFrame | None = None) -> DataFrame:
    """Triples with `valid` and a message. Without types nothing is rejected, which is the default; with a table of
    rejected (s, p, o) those lose nine tenths of their confidence and are marked."""
    t = triples.withColumn("path", F.format_string("(%s, %s, %s)", "s", "p", "o"))
    if rejected is None:
        return t.withColumn("valid", F.lit(True)).withColumn("path", F.concat(F.lit("Validated: "), "path"))
    bad = rejected.select("s", "p", "o").distinct().withColumn("bad", F.lit(True))
    t = t.join(bad, ["s", "p", "o"], "left").withColumn("valid", F.col("bad").isNull()).drop("bad")
    return (
        t.withColumn("path", F.concat(F.when(F.col("valid"), "Validated: ").otherwise("Rejected: "), "path"))
        .withColumn("confidence", F.when(F.col("valid"), F.col("confidence")).otherwise(F.col("confidence") * 0.1))
        .withColumn("confidence_level", F.when(F.col("valid"), F.col("confidence_level")).otherwise("uncertain"))
    )


def reasoning_paths(validated: DataFrame) -> DataFrame:
    """Per document, the messages in triple order."""
    items = F.array_sort(F.collect_list(F.struct("seq", "path")))
    return validated.groupBy("doc_id").agg(F.transform(items, lambda x: x["path"]).alias("reasoning_path"))


def verify(triples: DataFrame, gate: float = GATE, refuted: DataFrame | None = None) -> DataFrame:
    """Triples from the gate on are tried: refuted ones (s, p, o) fall to a tenth and `uncertain`, all others are
    verified with confidence 1; below the gate nothing changes. Document confidences are not taken anew."""
    t = triples
    if refuted is not None:
        t = t.join(refuted.select("s", "p", "o").distinct().withColumn("refuted", F.lit(True)), ["s", "p", "o"], "left")
    else:
        t = t.withColumn("refuted", F.lit(None).cast("boolean"))
    tried = F.col("confidence") >= gate
    status = F.when(~tried, "unknown").when(F.col("refuted"), "refuted").otherwise("verified")
    proof = F.when(F.col("status") == "verified", "Consistent with the rules").when(F.col("status") == "refuted", "REFUTED: breaks a rule")
    return (
        t.withColumn("status", status)
        .withColumn("confidence_level", F.when(F.col("status") == "verified", "verified").when(F.col("status") == "refuted", "uncertain").otherwise(F.col("confidence_level")))
        .withColumn("confidence", F.when(F.col("status") == "verified", 1.0).when(F.col("status") == "refuted", F.col("confidence") * 0.1).otherwise(F.col("confidence")))
        .withColumn("verification_proof", proof).drop("refuted")
    )


def verify_summary(verified: DataFrame) -> DataFrame:
    agg = verified.groupBy("doc_id").agg(F.count_if(F.col("status") == "verified").alias("n_verified"), F.count_if(F.col("status") == "refuted").alias("n_refuted"), F.count("*").alias("n_total"))
    return agg.withColumn("summary", F.format_string("Verified: %d, Refuted: %d, Total: %d", "n_verified", "n_refuted", "n_total"))


def certificates(verified: DataFrame, solver: str = "parity", soundness: float = 0.99) -> DataFrame:
    """A text record of each tried triple: with its time where the table has one, and how it was extracted."""
    time = F.concat(F.lit("\nTime: "), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ssXXX")) if "ts" in verified.columns else F.lit("")
    how = F.coalesce(F.concat(F.lit("\nExtracted by: "), F.col("provenance.extraction_method")), F.lit(""))
    text = F.format_string(
        "Proof certificate\nTriple: (%s, %s, %s)\nStatus: %s\nConfidence: %s\nProof: %s\nSource: %s\nSolver: " + solver + f"\nSoundness threshold: {soundness}",
        "s", "p", "o", "status", F.format_string("%.4f", F.col("confidence")), F.coalesce("verification_proof", F.lit("none")), F.col("provenance.source_chunk"),
    )
    text = F.concat(text, how, time)
    return verified.filter("status <> 'unknown'").select("doc_id", "seq", text.alias("certificate"))


class Policies:
    """Named lists of axioms; a later one of the same name replaces the earlier.

    An axiom is a type and components, as in an ontology's table; sentences without are kept and refute nothing.
    `refuted` compiles the axioms to violation queries: their result is what `verify` takes as refuted."""

    def __init__(self) -> None:
        self.by_name: dict[str, list] = {}

    def add(self, name: str, axioms: list) -> None:
        """axioms: sentences, or (axiom_type, [components])."""
        self.by_name[name] = list(axioms)

    def add_ontology(self, ontology) -> None:
        """The axioms of an ontology as one policy."""
        rows = ontology.axioms.select("axiom_type", "components").collect()  # axioms, not data
        self.add("ontology", [(r.axiom_type, list(r.components)) for r in rows])

    def axioms(self, kind: str) -> list[list[str]]:
        return [list(a[1]) for some in self.by_name.values() for a in some if not isinstance(a, str) and a[0] == kind]

    def refuted(self, triples: DataFrame, types: DataFrame) -> DataFrame:
        """s, p, o of the triples that break a policy, given (uri, type) with all classes above asserted ones: an end of a
        type that is no domain (range) of the predicate, several values of a functional property, or an end whose types
        are disjoint. Ends without types break nothing."""
        from . import ontology as O

        spark = triples.sparkSession
        # A row for each axiom: a property with several domains (ranges) breaks each that it does not fit.
        rows = sorted({(p, c, None) for p, c in self.axioms("ObjectPropertyDomain")}) + sorted({(p, None, c) for p, c in self.axioms("ObjectPropertyRange")})
        properties = spark.createDataFrame(rows, "uri string, domain string, range string")
        out = O.domain_range_violations(triples, types, properties).select("s", "p", "o")
        functional = [a[0] for kind in ("FunctionalObjectProperty", "FunctionalDataProperty") for a in self.axioms(kind)]
        if functional:
            out = out.unionByName(triples.join(O.functional_violations(triples, functional), ["s", "p"], "left_semi").select("s", "p", "o"))
        apart = [("DisjointClasses", a) for a in self.axioms("DisjointClasses")]
        if apart:
            bad = O.disjoint_violations(types, spark.createDataFrame(apart, "axiom_type string, components array<string>")).select("uri").distinct()
            for end in ("s", "o"):
                out = out.unionByName(triples.join(bad.withColumnRenamed("uri", end), end, "left_semi").select("s", "p", "o"))
        return out.distinct()
