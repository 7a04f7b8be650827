"""Registered queries of graph patterns, paths, rules and classification, each with its SQL (DuckDB) beside it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from .operators import el, linking, rules, vector_store
from .plans.sparql import sparql
from .plans.written import new_path
from .streaming import state
from .tables import order_history, read, relational_kg

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The graph of tables.relational_kg, without its numbers, as a view of each table so that filters on p leave the others out.
KG = """kg AS (
  SELECT 'kg:nation/' || n_nationkey AS s, 'kg:inRegion' AS p, 'kg:region/' || n_regionkey AS o FROM nation
  UNION ALL SELECT 'kg:customer/' || c_custkey, 'kg:locatedIn', 'kg:nation/' || c_nationkey FROM customer
  UNION ALL SELECT 'kg:supplier/' || s_suppkey, 'kg:locatedIn', 'kg:nation/' || s_nationkey FROM supplier
  UNION ALL SELECT 'kg:order/' || o_orderkey, 'kg:placedBy', 'kg:customer/' || o_custkey FROM orders
  UNION ALL SELECT 'kg:order/' || l_orderkey, 'kg:contains', 'kg:part/' || l_partkey FROM lineitem
  UNION ALL SELECT 'kg:part/' || l_partkey, 'kg:suppliedBy', 'kg:supplier/' || l_suppkey FROM lineitem
  UNION ALL SELECT 'kg:user/' || user_id, 'kg:performed', 'kg:event/' || event_type FROM events),
place AS MATERIALIZED (SELECT * FROM kg WHERE p IN ('kg:locatedIn', 'kg:inRegion'))"""


def register(f: Callable, sql: str | None) -> None:
    QUERIES[f.__name__] = f
    if sql is not None:
        ORACLES[f.__name__] = f"WITH RECURSIVE {KG}{sql}"


def query(sql: str | None) -> Callable:
    """Registers a query, with the rest of its SQL after the graph."""

    def put(f: Callable) -> Callable:
        register(f, sql)
        return f

    return put


def pattern(name: str, text: str, sql: str, history: bool = False) -> None:
    """Registers a SELECT query over the relational graph, with the order history if that is asked for."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        triples = relational_kg(spark, sf_dir).select("s", "p", "o")
        return sparql(f"PREFIX kg: <kg:> {text}", triples.unionByName(order_history(spark, sf_dir)) if history else triples)

    run.__name__ = name
    register(run, sql)


# Paths.

pattern(
    "path_closure",
    "SELECT ?x ?y WHERE { ?x (kg:locatedIn|kg:inRegion)+ ?y }",
    ", r AS (SELECT s, o FROM place UNION SELECT r.s, k.o FROM r JOIN place k ON k.s = r.o) SELECT s AS x, o AS y FROM r",
)
pattern(
    "path_from_constant",
    "SELECT ?x WHERE { <kg:region/2> (^kg:inRegion|^kg:locatedIn)* ?x }",
    ", r AS (SELECT 'kg:region/2' AS x UNION SELECT k.s FROM r JOIN place k ON k.o = r.x) SELECT x FROM r",
)
pattern(
    "path_to_constant",
    "SELECT ?x WHERE { ?x kg:placedBy?/kg:locatedIn/kg:inRegion <kg:region/1> }",
    """, m AS (SELECT a.s FROM place a JOIN place b ON b.s = a.o WHERE b.p = 'kg:inRegion' AND b.o = 'kg:region/1')
SELECT s AS x FROM m UNION ALL SELECT k.s FROM (SELECT DISTINCT s, o FROM kg WHERE p = 'kg:placedBy') k JOIN m ON m.s = k.o""",
)
pattern(
    "path_from_bound",
    "SELECT ?a ?b WHERE { ?a kg:followedBy+ ?b . ?a kg:placedBy ?c . ?c kg:locatedIn <kg:nation/7> }",
    """, h AS (SELECT o_orderkey AS a, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS b, c_nationkey AS n FROM orders JOIN customer ON c_custkey = o_custkey),
r AS (SELECT a, b FROM h WHERE b IS NOT NULL AND n = 7 UNION SELECT r.a, h.b FROM r JOIN h ON h.a = r.b WHERE h.b IS NOT NULL)
SELECT 'kg:order/' || a AS a, 'kg:order/' || b AS b FROM r""",
    history=True,
)
pattern(
    "path_of_every_pair",
    "SELECT ?a (COUNT(?b) AS ?n) WHERE { ?a kg:followedBy* ?b . ?b kg:placedBy ?c } GROUP BY ?a",
    """, h AS (SELECT o_orderkey AS a, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS b FROM orders),
r AS (SELECT a, a AS b FROM h UNION SELECT r.a, h.b FROM r JOIN h ON h.a = r.b WHERE h.b IS NOT NULL)
SELECT 'kg:order/' || a AS a, count(*) AS n FROM r GROUP BY 1""",
    history=True,
)
pattern(
    "path_negated",
    "SELECT ?y (COUNT(?x) AS ?n) WHERE { ?x !(kg:contains|kg:suppliedBy|kg:performed) ?y } GROUP BY ?y HAVING(COUNT(?x) > 5 && MIN(?x) != ?y)",
    " SELECT o AS y, count(*) AS n FROM kg WHERE p NOT IN ('kg:contains', 'kg:suppliedBy', 'kg:performed') GROUP BY o HAVING count(*) > 5 AND min(s) <> o",
)

# Groups within groups.

pattern(
    "bgp_exists",
    "SELECT ?o ?c WHERE { ?o kg:placedBy ?c . FILTER EXISTS { ?o kg:followedBy ?x . ?o kg:contains ?p . ?x kg:contains ?p } }",
    """, h AS (SELECT o_orderkey AS o, o_custkey AS c, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS x FROM orders)
SELECT 'kg:order/' || o AS o, 'kg:customer/' || c AS c FROM h WHERE o IN (SELECT h.o FROM h JOIN lineitem a ON a.l_orderkey = h.o JOIN lineitem b ON b.l_orderkey = h.x AND b.l_partkey = a.l_partkey)""",
    history=True,
)
pattern(
    "bgp_not_exists",
    "SELECT ?o ?n WHERE { ?o kg:placedBy ?c . ?c kg:locatedIn ?n . FILTER(?n != <kg:nation/0> && NOT EXISTS { ?o kg:followedBy ?x }) }",
    """ SELECT 'kg:order/' || max(o_orderkey) AS o, 'kg:nation/' || any_value(c_nationkey) AS n FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey <> 0 GROUP BY o_custkey""",
    history=True,
)
pattern(
    "bgp_minus",
    "SELECT DISTINCT ?p WHERE { ?o kg:contains ?p MINUS { ?p kg:suppliedBy ?s . ?s kg:locatedIn <kg:nation/3> } MINUS { ?a kg:inRegion ?b } }",
    " SELECT DISTINCT 'kg:part/' || l_partkey AS p FROM lineitem WHERE l_partkey NOT IN (SELECT l_partkey FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE s_nationkey = 3)",
)
pattern(
    "bgp_having_bind",
    "SELECT ?r (COUNT(?c) AS ?n) (COUNT(?c) / COUNT(DISTINCT ?m) AS ?mean) WHERE { ?c kg:locatedIn ?m . ?m kg:inRegion ?r . BIND(STRLEN(?c) - 1 AS ?len) FILTER(?len > 12) }"
    " GROUP BY ?r HAVING(COUNT(?c) >= 2 * COUNT(DISTINCT ?m))",
    """ SELECT b.o AS r, count(*) AS n, count(*) / count(DISTINCT b.s) AS mean FROM place a JOIN place b ON b.s = a.o WHERE length(a.s) - 1 > 12 AND b.p = 'kg:inRegion'
GROUP BY b.o HAVING count(*) >= 2 * count(DISTINCT b.s)""",
)
pattern(
    "bgp_optional_outer",
    "SELECT ?o ?p ?s WHERE { ?c kg:locatedIn ?n . FILTER(?n IN (<kg:nation/5>, <kg:nation/6>)) ?o kg:placedBy ?c . OPTIONAL { ?o kg:contains ?p . ?p kg:suppliedBy ?s . ?s kg:locatedIn ?m . FILTER(?m = ?n) } }",
    """, f AS (SELECT a.l_orderkey AS o, a.l_partkey AS p, b.l_suppkey AS s, s_nationkey AS n FROM lineitem a JOIN lineitem b ON b.l_partkey = a.l_partkey JOIN supplier ON s_suppkey = b.l_suppkey)
SELECT 'kg:order/' || o_orderkey AS o, 'kg:part/' || p AS p, 'kg:supplier/' || s AS s FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN f ON f.o = o_orderkey AND f.n = c_nationkey
WHERE c_nationkey IN (5, 6)""",
)
pattern(
    "bgp_unbound_sides",
    "SELECT ?x ?n ?r WHERE { { ?x kg:locatedIn ?n } UNION { ?x kg:inRegion ?r } { ?n kg:inRegion ?r } }",
    """, k AS (SELECT s, o FROM place WHERE p = 'kg:inRegion')
SELECT a.s AS x, k.s AS n, k.o AS r FROM place a JOIN k ON k.s = a.o WHERE a.p = 'kg:locatedIn' UNION ALL SELECT a.s, k.s, k.o FROM k a JOIN k ON k.o = a.o""",
)
pattern(
    "bgp_subquery",
    "SELECT ?n ?k ?r WHERE { VALUES ?n { <kg:nation/1> <kg:nation/2> <kg:nation/24> } { SELECT ?n (COUNT(?c) AS ?k) WHERE { ?c kg:locatedIn ?n } GROUP BY ?n } ?n kg:inRegion ?r }",
    " SELECT 'kg:nation/' || n_nationkey AS n, count(*) AS k, any_value('kg:region/' || n_regionkey) AS r FROM place JOIN nation ON o = 'kg:nation/' || n_nationkey WHERE n_nationkey IN (1, 2, 24) GROUP BY n_nationkey",
)


# Rules.

PLACES = """
within(X, Y) :- located(X, Y).
within(X, Z) :- located(X, Y), within(Y, Z).
"""


def _located(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational_kg(spark, sf_dir).filter("p in ('kg:locatedIn', 'kg:inRegion')").select("s", "o")


def _schema(spark: SparkSession) -> dict[str, DataFrame]:
    """What the rules of the relational graph are about: a fixed schema of its predicates."""
    rows = {
        "subproperty": [("kg:locatedIn", "kg:within"), ("kg:inRegion", "kg:within")], "transitive": [("kg:within",)], "symmetric": [("kg:beside",)], "inverse": [("kg:within", "kg:holds")],
        "chain": [("kg:placedBy", "kg:within", "kg:orderedIn")], "domain": [("kg:contains", "onto:Order"), ("kg:suppliedBy", "onto:Part"), ("kg:within", "onto:Resident")],
        "range": [("kg:contains", "onto:Part"), ("kg:suppliedBy", "onto:Supplier"), ("kg:placedBy", "onto:Customer"), ("kg:within", "onto:Place")],
        "subclass": [("onto:Customer", "onto:Agent"), ("onto:Supplier", "onto:Agent"), ("onto:Agent", "onto:Thing"), ("onto:Place", "onto:Thing")],
    }
    return {n: spark.createDataFrame(r, ", ".join(f"c{k} string" for k in range(len(r[0])))) for n, r in rows.items()}


def _owl_rl(spark: SparkSession, sf_dir: str, wanted: str) -> DataFrame:
    triples = relational_kg(spark, sf_dir).filter("p <> 'kg:performed'").select("s", "p", "o")
    return rules.evaluate(rules.OWL_RL, _schema(spark) | {"triple": triples}, {wanted})[wanted]


WITHIN = ", w AS (SELECT s, o FROM place UNION SELECT w.s, k.o FROM w JOIN place k ON k.s = w.o)"


@query(WITHIN + """ SELECT s, 'kg:within' AS p, o FROM w UNION SELECT o, 'kg:holds', s FROM w
UNION SELECT k.s, 'kg:orderedIn', w.o FROM kg k JOIN w ON w.s = k.o WHERE k.p = 'kg:placedBy'""")
def owl_rl_triples(spark, sf_dir):
    """The statements that the rules of OWL RL add to the graph."""
    return _owl_rl(spark, sf_dir, "triple").toDF("s", "p", "o").filter("p in ('kg:within', 'kg:holds', 'kg:orderedIn')")


@query(WITHIN + """, t AS (
  SELECT s AS x, 'onto:Order' AS c FROM kg WHERE p = 'kg:contains' UNION SELECT s, 'onto:Part' FROM kg WHERE p = 'kg:suppliedBy' UNION SELECT s, 'onto:Resident' FROM w
  UNION SELECT o, 'onto:Part' FROM kg WHERE p = 'kg:contains' UNION SELECT o, 'onto:Supplier' FROM kg WHERE p = 'kg:suppliedBy' UNION SELECT o, 'onto:Customer' FROM kg WHERE p = 'kg:placedBy'
  UNION SELECT o, 'onto:Place' FROM w),
up(c, d) AS (VALUES ('onto:Customer', 'onto:Agent'), ('onto:Supplier', 'onto:Agent'), ('onto:Agent', 'onto:Thing'), ('onto:Place', 'onto:Thing')),
r AS (SELECT x, c FROM t UNION SELECT x, d FROM r JOIN up USING (c)) SELECT x AS uri, c AS type FROM r""")
def owl_rl_types(spark, sf_dir):
    """The types that domains, ranges and superclasses give what stands in the graph."""
    return _owl_rl(spark, sf_dir, "type").toDF("uri", "type")


@query(""" SELECT 'kg:order/' || min(o_orderkey) AS first, 'kg:order/' || max(o_orderkey) AS last FROM orders GROUP BY o_custkey HAVING count(*) > 1""")
def rules_with_negation(spark, sf_dir):
    """The first and last order of every customer who has two, by following each order to the next: recursion between two negations."""
    program = """
    later(Y) :- followed(X, Y).
    earlier(X) :- followed(X, Y).
    since(X, Y) :- followed(X, Y), not later(X).
    since(X, Z) :- since(X, Y), followed(Y, Z).
    ends(X, Y) :- since(X, Y), not earlier(Y).
    """
    followed = order_history(spark, sf_dir).select("s", "o")
    return rules.evaluate(program, {"followed": followed}, {"ends"})["ends"].toDF("first", "last")


@query(""", r AS (SELECT 'kg:region/1' AS x UNION SELECT k.s FROM r JOIN place k ON k.o = r.x) SELECT x AS "X" FROM r WHERE x <> 'kg:region/1'""")
def rules_asked_backwards(spark, sf_dir):
    """What lies within one region, derived from that region on."""
    return rules.ask(PLACES, {"located": _located(spark, sf_dir)}, 'within(X, "kg:region/1")')


@query(""", h AS (SELECT o_orderkey AS a, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS b, o_custkey AS c FROM orders),
s AS (SELECT min(o_orderkey) AS a FROM orders WHERE o_custkey = (SELECT max(o_custkey) FROM orders)),
r AS (SELECT h.b FROM h JOIN s USING (a) WHERE b IS NOT NULL UNION SELECT h.b FROM r JOIN h ON h.a = r.b WHERE h.b IS NOT NULL) SELECT 'kg:order/' || b AS "Y" FROM r""")
def rules_asked_forwards(spark, sf_dir):
    """The orders after the first one of the customer with the highest number, from that order on."""
    first = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("o")).orderBy(F.desc("o_custkey")).first()
    program = "since(X, Y) :- followed(X, Y). since(X, Z) :- since(X, Y), followed(Y, Z)."
    return rules.ask(program, {"followed": order_history(spark, sf_dir).select("s", "o")}, f'since("kg:order/{first.o}", Y)')


@query(""", d AS (SELECT DISTINCT l_orderkey AS o, l_suppkey AS s FROM lineitem)
SELECT 'kg:order/' || o AS "order", 'kg:region/' || n_regionkey AS region,
  'bought(kg:order/' || o || ', kg:supplier/' || s || ') & located(kg:nation/' || n_nationkey || ', kg:region/' || n_regionkey || ') & located(kg:supplier/' || s || ', kg:nation/' || n_nationkey || ')' AS support
FROM d JOIN supplier ON s_suppkey = s JOIN nation ON n_nationkey = s_nationkey""")
def inference_supports(spark, sf_dir):
    """From which regions an order's goods come, with every minimal set of facts that is enough to say so."""
    uri = lambda kind, c: F.concat(F.lit(f"kg:{kind}/"), F.col(c).cast("string"))
    bought = read(spark, sf_dir, "lineitem").select(uri("order", "l_orderkey"), uri("supplier", "l_suppkey"))
    regions = read(spark, sf_dir, "region").select(uri("region", "r_regionkey"))
    program = PLACES + "comes(O, R) :- bought(O, S), within(S, R), region(R)."
    x = rules.supports(program, {"bought": bought, "located": _located(spark, sf_dir), "region": regions}, "comes")
    support = F.filter("why", lambda f: ~F.startswith(f, F.lit("region(")))
    return x.select(F.col("c0").alias("order"), F.col("c1").alias("region"), F.array_join(support, " & ").alias("support"))


# Classification.


def part_axioms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts as classes of an ontology (axiom_type, components): what they are, which adjective and brand they have, who
    supplies them; places as chains of roles; and definitions over these."""
    cat = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in xs])
    some = lambda role, x: cat(f"ObjectSomeValuesFrom({role} ", x, ")")
    words = F.split("p_name", " ")
    noun, adjective = cat("kind:", F.element_at(words, -1)), cat("adj:", F.element_at(words, 1))
    t = lambda name: read(spark, sf_dir, name)
    sub = lambda df, a, b: df.select(F.lit("SubClassOf").alias("axiom_type"), F.array(a, b).alias("components")).distinct()
    part, col = lambda c: cat("kg:part/", F.col(c)), F.col
    made = cat("ObjectIntersectionOf(", noun, " ", some("kg:adjective", adjective), " ", some("kg:brand", cat("brand:", col("p_brand"))), ")")
    region = cat("kg:region/", col("r_regionkey"))
    out = [
        sub(t("part"), part("p_partkey"), made),
        sub(t("part"), noun, F.lit("onto:Product")),
        sub(t("lineitem"), part("l_partkey"), some("kg:suppliedBy", cat("kg:supplier/", col("l_suppkey")))),
        sub(t("supplier"), cat("kg:supplier/", col("s_suppkey")), some("kg:locatedIn", cat("kg:nation/", col("s_nationkey")))),
        sub(t("nation"), cat("kg:nation/", col("n_nationkey")), some("kg:inRegion", cat("kg:region/", col("n_regionkey")))),
        sub(t("region"), some("kg:comesFrom", region), cat("onto:From/", col("r_regionkey"))),
    ]
    fixed = [
        ("EquivalentClasses", ["onto:RedRing", "ObjectIntersectionOf(kind:ring ObjectSomeValuesFrom(kg:adjective adj:red))"]),
        ("SubClassOf", ["ObjectIntersectionOf(kind:widget ObjectSomeValuesFrom(kg:brand brand:Brand#17))", "owl:Nothing"]),
        ("SubObjectPropertyOf", ["kg:locatedIn", "kg:inRegion", "kg:within"]), ("SubObjectPropertyOf", ["kg:suppliedBy", "kg:within", "kg:comesFrom"]),
    ]
    for x in out[1:]:
        out[0] = out[0].unionByName(x)
    return out[0].unionByName(spark.createDataFrame(fixed, "axiom_type string, components array<string>"))


CLASSIFIED = """, pt AS (SELECT 'kg:part/' || p_partkey AS x, split_part(p_name, ' ', -1) AS noun, split_part(p_name, ' ', 1) AS adj, p_brand AS brand, p_partkey FROM part),
ok AS (SELECT * FROM pt WHERE NOT (noun = 'widget' AND brand = 'Brand#17')),
up AS (
  SELECT x AS child, 'kind:' || noun AS parent FROM ok UNION SELECT x, 'onto:Product' FROM ok UNION SELECT x, 'onto:RedRing' FROM ok WHERE noun = 'ring' AND adj = 'red'
  UNION SELECT x, 'onto:From/' || n_regionkey FROM ok JOIN lineitem ON l_partkey = p_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey
  UNION SELECT 'kind:' || noun, 'onto:Product' FROM pt UNION SELECT 'onto:RedRing', 'kind:ring' UNION SELECT 'onto:RedRing', 'onto:Product' WHERE EXISTS (SELECT 1 FROM pt WHERE noun = 'ring')
  UNION SELECT x, 'owl:Nothing' FROM pt WHERE noun = 'widget' AND brand = 'Brand#17')"""


@query(CLASSIFIED + " SELECT child, parent FROM up")
def el_classification(spark, sf_dir):
    """Every subsumption that follows from the ontology of the parts, classes without possible members among them."""
    return el.classify(part_axioms(spark, sf_dir))


@query(CLASSIFIED + " SELECT child, parent FROM up WHERE NOT EXISTS (SELECT 1 FROM up a JOIN up b ON b.child = a.parent WHERE a.child = up.child AND b.parent = up.parent)")
def el_direct_parents(spark, sf_dir):
    """The classified hierarchy without what follows from the rest."""
    return el.direct(el.classify(part_axioms(spark, sf_dir)))


# Entity linking.


def order_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, name, around): every order as a document that mentions its customer in one of six spellings, by the hash of its number, with
    what else it says of the customer: nation, and segment where it is not left out."""
    x = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    number = F.regexp_extract("c_name", "([0-9]+)$", 1)
    spelled = F.array(
        F.col("c_name"), F.concat(F.lit("customer "), number.cast("long").cast("string")), F.concat(F.lit("CUSTOMER NO. "), number), F.regexp_replace("c_name", "st", "ts"),
        F.concat(F.lit("Cust. "), F.substring(number, 2, 20)), F.concat(number, F.lit(" (Customer)")),
    )
    kind = F.pmod(F.crc32(F.col("o_orderkey").cast("string").cast("binary")), F.lit(6)).cast("int")
    around = F.array(F.concat(F.lit("nation:"), F.col("c_nationkey").cast("string")), F.when(kind != 3, F.concat(F.lit("segment:"), F.col("c_mktsegment"))))
    return x.select(F.col("o_orderkey").alias("id"), F.element_at(spelled, kind + 1).alias("name"), around.alias("around"))


@query(" SELECT o_orderkey AS id, min(o_orderkey) OVER (PARTITION BY o_custkey) AS cluster FROM orders JOIN customer ON c_custkey = o_custkey")
def entity_links(spark, sf_dir):
    """The mentions of all orders, put together by customer from spelling and surroundings alone."""
    return linking.link_entities(order_mentions(spark, sf_dir))


# Vector store.


def _stored(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame, DataFrame]:
    """The embeddings as a store, their table, and the queries: every row whose number is divisible by 50."""
    v = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("uri"), F.col("embedding").alias("vec"))
    path = new_path(spark, "vectors")
    vector_store.build(v, path)
    return path, v, v.filter("uri % 50 = 0")


EXACT = """, v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings),
x AS (SELECT q.id AS query, c.id AS uri, list_cosine_similarity(q.e, c.e) AS s FROM v q JOIN v c ON q.id % 50 = 0 AND c.id <> q.id),
r AS (SELECT query, (row_number() OVER (PARTITION BY query ORDER BY s DESC, uri))::INTEGER AS rank, uri, round(s, 6) AS similarity FROM x)"""


@query(EXACT + " SELECT query, rank, uri, similarity FROM r WHERE rank <= 10")
def vector_store_exact(spark, sf_dir):
    """The ten nearest of each query where all lists are probed and all their rows ranked by whole vectors."""
    path, v, q = _stored(spark, sf_dir)
    n = v.count()
    return vector_store.search(spark, path, q, 10, probes=n, refine=-(-n // 10)).withColumn("similarity", F.round("similarity", 6))


@query(EXACT + " SELECT count(DISTINCT query) AS queries, true AS recalled, true AS pruned FROM r")
def vector_store_recall(spark, sf_dir):
    """Whether a search of three quarters of the lists finds nine tenths of the exact answers, and reads less than the whole store. The
    given vectors lie nearly alike in all directions, where lists help least: half of them hold 0.83 to 0.9 of the answers."""
    path, v, q = _stored(spark, sf_dir)
    lists = len(vector_store.load(spark, path).centres)
    found = vector_store.search(spark, path, q, 10, probes=-(-3 * lists // 4), refine=30)
    exact = vector_store.search(spark, path, q, 10, probes=lists, refine=-(-v.count() // 10))
    read_rows = vector_store.probed(spark, path, v.filter("uri = 0"), -(-3 * lists // 4)).agg(F.count("*").alias("n"))
    whole = v.agg(F.count("*").alias("all"))
    x = vector_store.recall(found, exact).join(F.broadcast(read_rows)).join(F.broadcast(whole))  # single rows
    return x.select("queries", (F.col("recall") >= 0.9).alias("recalled"), (F.col("n") < 0.9 * F.col("all")).alias("pruned"))


# Streams with state.


def _replayed(spark: SparkSession, df: DataFrame, order: str, parts: int, start: Callable[[DataFrame, str], DataStreamWriter]) -> str:
    """df as a stream of `parts` batches in the order of a number, each of as many files as tasks write it, in a session whose state is
    kept by RocksDB: what is started goes on from its state whenever a batch has come. The folder of what the stream writes."""
    low, high = df.agg(F.min(order), F.max(order)).first()
    path, session = new_path(spark, "replay"), spark.newSession()
    session.conf.set("spark.sql.streaming.stateStore.providerClass", state.STATE_STORE)
    edges = [low + (high - low + 1) * k // parts for k in range(parts + 1)] if low is not None else []
    for batch in [F.col(order).between(a, b - 1) for a, b in zip(edges, edges[1:])] or [F.lit(True)]:
        df.filter(batch).write.mode("append").parquet(f"{path}/in")
        start(session.readStream.schema(df.schema).parquet(f"{path}/in"), path).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return path


@query(""", e AS (SELECT 'kg:user/' || user_id AS uri, event_id AS seq, ts FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
l AS (SELECT *, ts < max(ts) OVER (PARTITION BY uri, seq % 4 ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 1 HOUR AS late FROM e)
SELECT uri, count(*) AS n, (count(*) FILTER (late))::BIGINT AS late, arg_min(seq, (ts, seq)) AS first_seq, arg_max(seq, (ts, seq)) AS last_seq FROM l GROUP BY uri""")
def stream_entities(spark, sf_dir):
    """What a stream of events has told of each user when it ends: state kept from batch to batch."""
    events = read(spark, sf_dir, "events").select(F.concat(F.lit("kg:user/"), "user_id").alias("uri"), F.col("event_id").cast("long").alias("seq"), F.col("ts").cast("timestamp").alias("ts"))
    path = _replayed(spark, events, "seq", 3, lambda stream, path: state.entity_updates(stream, slots=4).writeStream.format("parquet").option("path", f"{path}/out"))
    return state.entity_table(spark.read.schema(f"uri string, slot int, {state.STATE}").parquet(f"{path}/out"))


@query(""", h AS (SELECT o_orderkey AS a, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS b FROM orders),
r AS (SELECT a, b FROM h WHERE b IS NOT NULL UNION SELECT r.a, h.b FROM r JOIN h ON h.a = r.b WHERE h.b IS NOT NULL) SELECT 'kg:order/' || a AS s, 'kg:order/' || b AS o FROM r""")
def stream_closure(spark, sf_dir):
    """Which orders follow each other at any distance, kept up to date while the orders come in."""
    edges = order_history(spark, sf_dir).select("s", "o", F.regexp_extract("o", "([0-9]+)$", 1).cast("long").alias("seq"))
    closure = state.GrowingClosure(spark, new_path(spark, "closure"))
    _replayed(spark, edges, "seq", 3, lambda stream, _: stream.writeStream.foreachBatch(closure.extend))
    return closure.pairs()
