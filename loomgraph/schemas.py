"""Column types of the engine's tables, as Spark DDL."""

RESPONSE = (
    "struct<entities:array<struct<text:string,type:string,span:array<int>>>,"
    "relations:array<struct<subject:string,predicate:string,object:string>>>"
)
CHUNK = (
    "struct<chunk:string,entities:array<struct<text:string,type:string>>,"
    "relations:array<struct<subject:string,predicate:string,object:string>>>"
)
ENTITY = (
    "graph_id string, seq long, uri string, label string, entity_type string, ontology_type string, mentions array<string>,"
    " inferred_types array<string>, attributes map<string,string>, embedding array<float>, confidence double, source string"
)
RELATION = (
    "graph_id string, seq long, uri string, label string, domain string, range string, properties map<string,string>,"
    " is_functional boolean, is_transitive boolean, is_symmetric boolean"
)
TRIPLE = (
    "graph_id string, seq long, s string, p string, o string, o_is_literal boolean, confidence double, confidence_level string,"
    " provenance struct<source_chunk:string,extraction_method:string>, verification_proof string, ts timestamp, id string"
)
ONTO_CLASS = "ord int, uri string, label string, description string, parents array<string>"
ONTO_PROPERTY = "ord int, kind string, uri string, label string, description string, domain string, range string"
AXIOM = "axiom_type string, components array<string>, verbalization string, logical_form string"

ENTITY_TYPES = ("class", "individual", "literal", "blank_node")
LEVELS = ("verified", "high", "medium", "low", "uncertain")
STATUSES = ("verified", "refuted", "unknown", "timeout", "error")
