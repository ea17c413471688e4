"""The registered queries of the graph engine: SPARQL over the driver's tables, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ternion.engine import Engine
from ternion.functions.values import Template
from ternion.plans.solution import Info
from ternion.sources.mapping import Field, Table, table
from ternion.sources.store import COLUMNS, TripleStore
from ternion.terms import IRI_KIND, LITERAL, OWL, RDFS, STRING, TYPE

BASE = "http://example.org/"
PREFIXES = f"PREFIX ex: <{BASE}> PREFIX xsd: <http://www.w3.org/2001/XMLSchema#> PREFIX rdf: <http://www.w3.org/1999/02/22-rdf-syntax-ns#> PREFIX rdfs: <{RDFS}> PREFIX owl: <http://www.w3.org/2002/07/owl#> "
KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "lineitem": None, "events": "event_id"}
LINKS = {"o_custkey": "customer", "l_orderkey": "orders", "l_partkey": "part", "l_suppkey": "supplier", "c_nationkey": "nation", "s_nationkey": "nation", "n_regionkey": "region"}


@lru_cache(maxsize=256)
def _reader(spark: SparkSession, path: str) -> DataFrame:
    """A table's plan: reading the footers for its schema costs a job, so it is done once for a path and session."""
    return spark.read.parquet(path)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return _reader(spark, f"{sf_dir}/{name}.parquet")


def engine(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = tuple(KEYS), more: tuple[Table, ...] = ()) -> Engine:
    """The driver's tables as a graph."""
    return Engine(spark, [*(table(read(spark, sf_dir, n), n, KEYS[n], BASE, LINKS) for n in names), *more])


def _sequels(spark: SparkSession, sf_dir: str) -> Table:
    """Each order's next order of the same customer, as ex:next."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    nxt = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    df = orders.select("o_orderkey", nxt.alias("next"))
    return Table(df, f"{BASE}orders/", None, "o_orderkey", {f"{BASE}next": Field("next", Info("iri", Template(f"{BASE}orders/", "bigint")))})


def _ring(spark: SparkSession, sf_dir: str) -> Table:
    """Each nation's successor by key among those of its region; the last one's is the first: cycles."""
    w = Window.partitionBy("n_regionkey").orderBy("n_nationkey")
    first = F.first("n_nationkey").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    df = read(spark, sf_dir, "nation").select("n_nationkey", F.coalesce(F.lead("n_nationkey").over(w), first).alias("after"))
    return Table(df, f"{BASE}nation/", None, "n_nationkey", {f"{BASE}after": Field("after", Info("iri", Template(f"{BASE}nation/", "int")))})


def _sparql(text: str, *extra: Callable[[SparkSession, str], Table], names: tuple[str, ...] = tuple(KEYS)) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return engine(spark, sf_dir, names, tuple(f(spark, sf_dir) for f in extra)).sparql(PREFIXES + text)

    return run


_RECURSIVE_NEXT = "WITH RECURSIVE e AS (SELECT o_orderkey a, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) b FROM orders), s AS (SELECT a, b FROM e WHERE b IS NOT NULL), w(a, b) AS (SELECT a, b FROM s UNION SELECT w.a, s.b FROM w JOIN s ON w.b = s.a)"
_RECURSIVE_RING = "WITH RECURSIVE s AS (SELECT n_nationkey a, coalesce(lead(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey), min(n_nationkey) OVER (PARTITION BY n_regionkey)) b FROM nation), w(a, b) AS (SELECT a, b FROM s UNION SELECT w.a, s.b FROM w JOIN s ON w.b = s.a)"

#: Queries by name: SPARQL, SQL, and more tables that the graph has.
SPARQL: dict[str, tuple] = {
    "revenue_by_nation": (
        """SELECT ?nation (ROUND(SUM(?price * (1 - ?discount))) AS ?revenue) (COUNT(*) AS ?items) WHERE {
             ?line ex:l_orderkey ?order ; ex:l_extendedprice ?price ; ex:l_discount ?discount .
             ?order ex:o_custkey/ex:c_nationkey/ex:n_name ?nation ; ex:o_orderdate ?date .
             FILTER(?date >= "1996-01-01T00:00:00Z"^^xsd:dateTime && ?date < "1998-01-01T00:00:00Z"^^xsd:dateTime)
           } GROUP BY ?nation""",
        "SELECT n_name nation, round(sum(l_extendedprice * (1 - l_discount))) revenue, count(*) items FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1998-01-01' GROUP BY n_name",
    ),
    # basic graph patterns
    "bgp_star": ("SELECT ?name ?bal WHERE { ?c ex:c_name ?name ; ex:c_acctbal ?bal ; ex:c_mktsegment 'BUILDING' }", "SELECT c_name name, c_acctbal bal FROM customer WHERE c_mktsegment = 'BUILDING'"),
    "bgp_chain": ("SELECT ?o ?n WHERE { ?o ex:o_custkey ?c . ?c ex:c_nationkey ?k . ?k ex:n_name ?n }", "SELECT 'http://example.org/orders/' || o_orderkey o, n_name n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"),
    "bgp_subject_bound": ("SELECT ?n ?r WHERE { <http://example.org/nation/7> ex:n_name ?n ; ex:n_regionkey ?r }", "SELECT n_name n, 'http://example.org/region/' || n_regionkey r FROM nation WHERE n_nationkey = 7"),
    "bgp_object_bound": ("SELECT ?n WHERE { ?x ex:n_regionkey <http://example.org/region/2> ; ex:n_name ?n }", "SELECT n_name n FROM nation WHERE n_regionkey = 2"),
    "bgp_all_bound": ("SELECT (COUNT(*) AS ?n) WHERE { <http://example.org/nation/7> a ex:Nation }", "SELECT count(*) n FROM nation WHERE n_nationkey = 7"),
    "bgp_variable_predicate": (
        "SELECT ?p ?o WHERE { <http://example.org/nation/3> ?p ?o }",
        "SELECT 'http://example.org/n_name' p, n_name o FROM nation WHERE n_nationkey = 3 UNION ALL SELECT 'http://example.org/n_nationkey', CAST(n_nationkey AS VARCHAR) FROM nation WHERE n_nationkey = 3 UNION ALL SELECT 'http://example.org/n_regionkey', 'http://example.org/region/' || n_regionkey FROM nation WHERE n_nationkey = 3 UNION ALL SELECT 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', 'http://example.org/Nation'",
    ),
    "bgp_object_only": ("SELECT ?s ?p WHERE { ?s ?p <http://example.org/region/1> }", "SELECT 'http://example.org/nation/' || n_nationkey s, 'http://example.org/n_regionkey' p FROM nation WHERE n_regionkey = 1"),
    "bgp_everything": ("SELECT ?p (COUNT(*) AS ?n) WHERE { ?s ?p ?o } GROUP BY ?p", "SELECT 'http://example.org/' || c p, count(*) n FROM (SELECT unnest(['r_regionkey', 'r_name']) c FROM region UNION ALL SELECT unnest(['n_nationkey', 'n_name', 'n_regionkey']) FROM nation) GROUP BY c UNION ALL SELECT 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', (SELECT count(*) FROM region) + (SELECT count(*) FROM nation)", {"names": ("region", "nation")}),
    "bgp_repeated_variable": ("SELECT ?i WHERE { ?e ex:event_id ?i ; ex:user_id ?i }", "SELECT event_id i FROM events WHERE event_id = user_id"),
    "bgp_blank_node": ("SELECT ?t WHERE { [] ex:o_totalprice ?t ; ex:o_custkey [ ex:c_nationkey <http://example.org/nation/4> ] }", "SELECT o_totalprice t FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 4"),
    "bgp_unknown_constant": ("SELECT ?x WHERE { ?x ex:no_such_predicate ?y ; ex:n_name ?z }", "SELECT n_name x FROM nation WHERE false"),
    "bgp_anonymous_rows": ("SELECT ?q (COUNT(?l) AS ?n) WHERE { ?l ex:l_quantity ?q ; ex:l_returnflag 'R' } GROUP BY ?q", "SELECT l_quantity q, count(*) n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1"),
    "bgp_types": ("SELECT ?t (COUNT(*) AS ?n) WHERE { ?x a ?t ; ex:r_name ?y } GROUP BY ?t", "SELECT 'http://example.org/Region' t, count(*) n FROM region"),
    "bgp_cartesian": ("SELECT ?a ?b WHERE { ?x ex:r_name ?a . ?y ex:n_name ?b }", "SELECT r_name a, n_name b FROM region, nation"),
    "bgp_triangle": ("SELECT (COUNT(*) AS ?n) WHERE { ?l ex:l_orderkey ?o ; ex:l_suppkey ?s . ?o ex:o_custkey ?c . ?c ex:c_nationkey ?k . ?s ex:s_nationkey ?k }", "SELECT count(*) n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey AND s_nationkey = c_nationkey"),
    "theta_filter": ("SELECT ?a ?b WHERE { ?x ex:n_regionkey ?r ; ex:n_name ?a . ?y ex:n_regionkey ?r ; ex:n_name ?b FILTER(?a < ?b) }", "SELECT a.n_name a, b.n_name b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_name < b.n_name"),
    # filters
    "filter_range": ("SELECT ?k ?t WHERE { ?o ex:o_orderkey ?k ; ex:o_totalprice ?t FILTER(?t >= 100000 && ?t <= 110000) }", "SELECT o_orderkey k, o_totalprice t FROM orders WHERE o_totalprice BETWEEN 100000 AND 110000"),
    "filter_logic": ("SELECT ?k WHERE { ?p ex:p_partkey ?k ; ex:p_size ?s ; ex:p_brand ?b FILTER((?s < 5 || ?s > 45) && !(?b = 'Brand#1')) }", "SELECT p_partkey k FROM part WHERE (p_size < 5 OR p_size > 45) AND p_brand <> 'Brand#1'"),
    "filter_in": ("SELECT ?k WHERE { ?p ex:p_partkey ?k ; ex:p_size ?s FILTER(?s IN (1, 2, 3)) FILTER(?k NOT IN (5, 6)) }", "SELECT p_partkey k FROM part WHERE p_size IN (1, 2, 3) AND p_partkey NOT IN (5, 6)"),
    "filter_error": ("SELECT ?n WHERE { ?x ex:n_name ?n FILTER(?n > 5 || true) }", "SELECT n_name n FROM nation"),
    "filter_iri_text": ("SELECT ?x WHERE { ?x ex:n_name ?n FILTER(STRENDS(STR(?x), '/1')) }", "SELECT 'http://example.org/nation/1' x"),
    # optional, union, minus, exists
    "optional": ("SELECT ?n ?s WHERE { ?x ex:n_name ?n OPTIONAL { ?y ex:s_nationkey ?x ; ex:s_name ?s } }", "SELECT n_name n, s_name s FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey"),
    "optional_filter": ("SELECT ?c ?t WHERE { ?x ex:c_custkey ?c OPTIONAL { ?o ex:o_custkey ?x ; ex:o_totalprice ?t FILTER(?t > 400000) } }", "SELECT c_custkey c, o_totalprice t FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 400000"),
    "optional_outer_filter": ("SELECT ?c ?t WHERE { ?x ex:c_custkey ?c ; ex:c_acctbal ?b OPTIONAL { ?o ex:o_custkey ?x ; ex:o_totalprice ?t FILTER(?t > ?b * 40) } }", "SELECT c_custkey c, o_totalprice t FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > c_acctbal * 40"),
    "optional_unbound": ("SELECT (COUNT(*) AS ?n) WHERE { ?x ex:c_custkey ?c OPTIONAL { ?o ex:o_custkey ?x ; ex:o_orderstatus 'P' } FILTER(!BOUND(?o)) }", "SELECT count(*) n FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')"),
    "optional_then_join": (
        "SELECT ?n ?r WHERE { ?x ex:n_name ?n OPTIONAL { ?x ex:n_regionkey ?g . ?g ex:r_name ?r FILTER(?r < 'B') } ?g ex:r_name ?r }",
        "SELECT n_name n, r_name r FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name < 'B' UNION ALL SELECT n_name, b.r_name FROM nation JOIN region a ON n_regionkey = a.r_regionkey, region b WHERE a.r_name >= 'B'",
    ),
    "union": ("SELECT ?n ?b WHERE { { ?x ex:c_name ?n ; ex:c_acctbal ?b } UNION { ?x ex:s_name ?n ; ex:s_acctbal ?b } FILTER(?b > 9000) }", "SELECT c_name n, c_acctbal b FROM customer WHERE c_acctbal > 9000 UNION ALL SELECT s_name, s_acctbal FROM supplier WHERE s_acctbal > 9000"),
    "union_different_variables": ("SELECT ?r ?n WHERE { { ?x ex:r_name ?r } UNION { ?y ex:n_name ?n } }", "SELECT r_name r, NULL n FROM region UNION ALL SELECT NULL, n_name FROM nation"),
    "minus": ("SELECT ?c WHERE { ?x ex:c_custkey ?c MINUS { ?o ex:o_custkey ?x ; ex:o_orderpriority '1-URGENT' } }", "SELECT c_custkey c FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')"),
    "minus_disjoint": ("SELECT ?n WHERE { ?x ex:n_name ?n MINUS { ?y ex:r_name ?m } }", "SELECT n_name n FROM nation"),
    "exists": ("SELECT ?s WHERE { ?x ex:s_name ?s FILTER EXISTS { ?l ex:l_suppkey ?x ; ex:l_quantity 5.0e1 } }", "SELECT s_name s FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity = 50)"),
    "not_exists": ("SELECT ?c WHERE { ?x ex:c_custkey ?c FILTER NOT EXISTS { ?o ex:o_custkey ?x ; ex:o_orderstatus 'P' } }", "SELECT c_custkey c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')"),
    "exists_correlated": ("SELECT ?c WHERE { ?x ex:c_custkey ?c ; ex:c_acctbal ?b FILTER EXISTS { ?o ex:o_custkey ?x ; ex:o_totalprice ?t FILTER(?t > ?b * 50) } }", "SELECT c_custkey c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > c_acctbal * 50)"),
    "exists_in_or": ("SELECT ?c WHERE { ?x ex:c_custkey ?c ; ex:c_acctbal ?b FILTER(?b > 9500 || EXISTS { ?o ex:o_custkey ?x ; ex:o_orderstatus 'P' }) }", "SELECT c_custkey c FROM customer WHERE c_acctbal > 9500 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')"),
    "exists_in_union": (
        "SELECT ?c WHERE { ?x ex:c_custkey ?c ; ex:c_acctbal ?b FILTER EXISTS { { ?o ex:o_custkey ?x ; ex:o_totalprice ?t FILTER(?t > ?b * 50) } UNION { ?o ex:o_custkey ?x ; ex:o_orderstatus 'P' } } }",
        "SELECT c_custkey c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND (o_totalprice > c_acctbal * 50 OR o_orderstatus = 'P'))",
    ),
    "exists_nested_group": (
        "SELECT ?c WHERE { ?x ex:c_custkey ?c ; ex:c_acctbal ?b FILTER NOT EXISTS { ?o ex:o_custkey ?x { ?o ex:o_totalprice ?t FILTER(?t > ?b * 50) } } }",
        "SELECT c_custkey c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > c_acctbal * 50)",
    ),
    "exists_optional": (
        "SELECT ?c WHERE { ?x ex:c_custkey ?c ; ex:c_acctbal ?b FILTER EXISTS { ?o ex:o_custkey ?x OPTIONAL { ?o ex:o_totalprice ?t FILTER(?t > ?b * 50) } FILTER(!BOUND(?t)) } }",
        "SELECT c_custkey c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND NOT o_totalprice > c_acctbal * 50)",
    ),
    "optional_exists": (
        "SELECT ?n ?s WHERE { ?x ex:n_name ?n OPTIONAL { ?y ex:s_nationkey ?x ; ex:s_name ?s FILTER NOT EXISTS { ?l ex:l_suppkey ?y ; ex:l_quantity 5.0e1 } } }",
        "SELECT n_name n, s_name s FROM nation LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity = 50)) ON s_nationkey = n_nationkey",
    ),
    "optional_chain": (
        "SELECT ?c ?g ?r WHERE { ?x ex:c_custkey ?c OPTIONAL { ?x ex:c_nationkey ?n . ?n ex:n_regionkey ?g FILTER(?g != <http://example.org/region/0>) } OPTIONAL { ?g ex:r_name ?r } }",
        "SELECT c_custkey c, 'http://example.org/region/' || r_regionkey g, r_name r FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON n_regionkey = 0 OR r_regionkey = n_regionkey",
    ),
    "minus_unbound": (
        "SELECT ?c ?g WHERE { ?x ex:c_custkey ?c OPTIONAL { ?x ex:c_nationkey ?n . ?n ex:n_regionkey ?g FILTER(?g != <http://example.org/region/0>) } MINUS { ?g ex:r_name ?r FILTER(?r < 'B') } }",
        "SELECT c_custkey c, CASE WHEN n_regionkey <> 0 THEN 'http://example.org/region/' || n_regionkey END g FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 0 OR n_regionkey NOT IN (SELECT r_regionkey FROM region WHERE r_name < 'B')",
    ),
    # values, bind, subqueries
    "values": ("SELECT ?k ?n WHERE { VALUES ?k { 1 3 99 } ?x ex:n_nationkey ?k ; ex:n_name ?n }", "SELECT CAST(n_nationkey AS BIGINT) k, n_name n FROM nation WHERE n_nationkey IN (1, 3, 99)"),
    "values_iris": ("SELECT ?x ?n WHERE { VALUES (?x ?y) { (<http://example.org/nation/1> 1) (<http://example.org/region/1> 2) } ?x ex:n_name ?n }", "SELECT 'http://example.org/nation/1' x, n_name n FROM nation WHERE n_nationkey = 1"),
    "values_undef": ("SELECT ?r ?n WHERE { VALUES (?r ?n) { (<http://example.org/region/1> UNDEF) (UNDEF 'NATION_2') } ?x ex:n_regionkey ?r ; ex:n_name ?n }", "SELECT 'http://example.org/region/' || n_regionkey r, n_name n FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'http://example.org/region/' || n_regionkey, n_name FROM nation WHERE n_name = 'NATION_2'"),
    "bind": ("SELECT ?k ?v WHERE { ?p ex:p_partkey ?k ; ex:p_size ?s BIND(?s * 2 + 1 AS ?v) FILTER(?v > 90) }", "SELECT p_partkey k, CAST(p_size * 2 + 1 AS BIGINT) v FROM part WHERE p_size * 2 + 1 > 90"),
    "bind_constant": ("SELECT ?n WHERE { BIND(<http://example.org/region/3> AS ?r) ?x ex:n_regionkey ?r ; ex:n_name ?n }", "SELECT n_name n FROM nation WHERE n_regionkey = 3"),
    "bind_error": ("SELECT ?n ?v WHERE { ?x ex:n_name ?n BIND(?n + 1 AS ?v) }", "SELECT n_name n, CAST(NULL AS DOUBLE) v FROM nation"),
    "subquery": ("SELECT ?n ?m WHERE { ?x ex:n_name ?n { SELECT ?x (COUNT(*) AS ?m) WHERE { ?c ex:c_nationkey ?x } GROUP BY ?x } FILTER(?m > 55) }", "SELECT n_name n, count(*) m FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_nationkey, n_name HAVING count(*) > 55"),
    "subquery_limit": ("SELECT ?n ?b WHERE { { SELECT ?c ?b WHERE { ?c ex:c_acctbal ?b } ORDER BY DESC(?b) LIMIT 7 } ?c ex:c_name ?n }", "SELECT c_name n, c_acctbal b FROM customer ORDER BY c_acctbal DESC LIMIT 7"),
    # modifiers
    "distinct": ("SELECT DISTINCT ?b ?t WHERE { ?p ex:p_brand ?b ; ex:p_type ?t }", "SELECT DISTINCT p_brand b, p_type t FROM part"),
    "reduced": ("SELECT REDUCED ?t WHERE { ?p ex:p_type ?t }", "SELECT DISTINCT p_type t FROM part"),
    "order_limit": ("SELECT ?k ?t WHERE { ?o ex:o_orderkey ?k ; ex:o_totalprice ?t } ORDER BY DESC(?t) ?k LIMIT 20", "SELECT o_orderkey k, o_totalprice t FROM orders ORDER BY t DESC, k LIMIT 20"),
    "order_offset": ("SELECT ?k WHERE { ?p ex:p_partkey ?k ; ex:p_size ?s } ORDER BY ?s ?k LIMIT 15 OFFSET 30", "SELECT p_partkey k FROM part ORDER BY p_size, p_partkey LIMIT 15 OFFSET 30"),
    "order_expression": ("SELECT ?k WHERE { ?p ex:p_partkey ?k ; ex:p_retailprice ?r ; ex:p_size ?s } ORDER BY DESC(?r / ?s) ?k LIMIT 10", "SELECT p_partkey k FROM part ORDER BY p_retailprice / p_size DESC, p_partkey LIMIT 10"),
    "order_iri": ("SELECT ?c WHERE { ?c ex:c_name ?n } ORDER BY ?c LIMIT 12", "SELECT 'http://example.org/customer/' || c_custkey c FROM customer ORDER BY c LIMIT 12"),
    "order_unbound": ("SELECT ?n ?s WHERE { ?x ex:n_name ?n OPTIONAL { ?y ex:s_nationkey ?x ; ex:s_name ?s FILTER(?s < 'Supplier#000000020') } } ORDER BY ?s ?n LIMIT 12", "SELECT n_name n, s_name s FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_name < 'Supplier#000000020' ORDER BY s NULLS FIRST, n LIMIT 12"),
    # aggregates
    "group_count": ("SELECT ?s (COUNT(*) AS ?n) WHERE { ?o ex:o_orderstatus ?s } GROUP BY ?s", "SELECT o_orderstatus s, count(*) n FROM orders GROUP BY 1"),
    "group_sum_avg": ("SELECT ?f (SUM(?q) AS ?total) (ROUND(AVG(?p) * 100) AS ?mean) WHERE { ?l ex:l_returnflag ?f ; ex:l_quantity ?q ; ex:l_extendedprice ?p } GROUP BY ?f", "SELECT l_returnflag f, sum(l_quantity) total, round(avg(l_extendedprice) * 100) mean FROM lineitem GROUP BY 1"),
    "group_min_max": ("SELECT ?t (MIN(?r) AS ?least) (MAX(?r) AS ?most) (MIN(?n) AS ?first) WHERE { ?p ex:p_type ?t ; ex:p_retailprice ?r ; ex:p_name ?n } GROUP BY ?t", "SELECT p_type t, min(p_retailprice) least, max(p_retailprice) most, min(p_name) first FROM part GROUP BY 1"),
    "group_count_distinct": ("SELECT ?t (COUNT(DISTINCT ?b) AS ?n) (SUM(DISTINCT ?s) AS ?m) WHERE { ?p ex:p_type ?t ; ex:p_brand ?b ; ex:p_size ?s } GROUP BY ?t", "SELECT p_type t, count(DISTINCT p_brand) n, CAST(sum(DISTINCT p_size) AS BIGINT) m FROM part GROUP BY 1"),
    "group_concat": ("SELECT ?r (GROUP_CONCAT(?n ; SEPARATOR=',') AS ?all) WHERE { ?x ex:n_regionkey ?r ; ex:n_name ?n } GROUP BY ?r", "SELECT 'http://example.org/region/' || n_regionkey r, string_agg(n_name, ',' ORDER BY n_name) \"all\" FROM nation GROUP BY 1"),
    "group_concat_distinct": ("SELECT (GROUP_CONCAT(DISTINCT ?t) AS ?all) WHERE { ?p ex:p_type ?t }", "SELECT string_agg(t, ' ' ORDER BY t) \"all\" FROM (SELECT DISTINCT p_type t FROM part)"),
    "group_sample": ("SELECT ?r (SAMPLE(?n) AS ?one) WHERE { ?x ex:n_regionkey ?r ; ex:n_name ?n } GROUP BY ?r", "SELECT 'http://example.org/region/' || n_regionkey r, min(n_name) one FROM nation GROUP BY 1"),
    "group_expression": ("SELECT ?y (COUNT(*) AS ?n) WHERE { ?o ex:o_orderdate ?d } GROUP BY (YEAR(?d) AS ?y)", "SELECT year(o_orderdate) y, count(*) n FROM orders GROUP BY 1"),
    "group_unbound_key": ("SELECT ?s (COUNT(*) AS ?n) WHERE { ?x ex:n_name ?m OPTIONAL { ?y ex:s_nationkey ?x ; ex:s_name ?s FILTER(?s < 'Supplier#000000010') } } GROUP BY ?s", "SELECT s_name s, count(*) n FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_name < 'Supplier#000000010' GROUP BY 1"),
    "group_implicit": ("SELECT (COUNT(?k) AS ?n) (SUM(?s) AS ?m) (MAX(?s) AS ?x) WHERE { ?p ex:p_partkey ?k ; ex:p_size ?s }", "SELECT count(*) n, CAST(sum(p_size) AS BIGINT) m, CAST(max(p_size) AS BIGINT) x FROM part"),
    "group_implicit_empty": ("SELECT (COUNT(*) AS ?n) (SUM(?s) AS ?m) WHERE { ?p ex:p_size ?s FILTER(?s > 1000) }", "SELECT CAST(0 AS BIGINT) n, CAST(0 AS BIGINT) m"),
    "having": ("SELECT ?b (COUNT(*) AS ?n) WHERE { ?p ex:p_brand ?b } GROUP BY ?b HAVING(COUNT(*) > 80)", "SELECT p_brand b, count(*) n FROM part GROUP BY 1 HAVING count(*) > 80"),
    # property paths
    "path_sequence": ("SELECT ?o ?r WHERE { ?o ex:o_custkey/ex:c_nationkey/ex:n_regionkey ?r }", "SELECT 'http://example.org/orders/' || o_orderkey o, 'http://example.org/region/' || n_regionkey r FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"),
    "path_bag": ("SELECT ?r WHERE { ?r ^ex:n_regionkey/^ex:s_nationkey ?s }", "SELECT 'http://example.org/region/' || n_regionkey r FROM nation JOIN supplier ON s_nationkey = n_nationkey"),
    "path_inverse": ("SELECT ?r ?n WHERE { ?r ^ex:n_regionkey ?x . ?x ex:n_name ?n }", "SELECT 'http://example.org/region/' || n_regionkey r, n_name n FROM nation"),
    "path_alternative": ("SELECT ?x ?k WHERE { ?x ex:c_nationkey|ex:s_nationkey ?k }", "SELECT 'http://example.org/customer/' || c_custkey x, 'http://example.org/nation/' || c_nationkey k FROM customer UNION ALL SELECT 'http://example.org/supplier/' || s_suppkey, 'http://example.org/nation/' || s_nationkey FROM supplier"),
    "path_negated": ("SELECT ?o WHERE { <http://example.org/nation/5> !(ex:n_name|rdf:type) ?o }", "SELECT CAST(n_nationkey AS VARCHAR) o FROM nation WHERE n_nationkey = 5 UNION ALL SELECT 'http://example.org/region/' || n_regionkey FROM nation WHERE n_nationkey = 5"),
    "path_plus": ("SELECT ?a ?b WHERE { ?a ex:next+ ?b }", f"{_RECURSIVE_NEXT} SELECT 'http://example.org/orders/' || a a, 'http://example.org/orders/' || b b FROM w", {"extra": (_sequels,), "names": ()}),
    "path_plus_cycle": ("SELECT ?a ?b WHERE { ?a ex:after+ ?b }", f"{_RECURSIVE_RING} SELECT 'http://example.org/nation/' || a a, 'http://example.org/nation/' || b b FROM w", {"extra": (_ring,), "names": ()}),
    "path_star_from": ("SELECT ?b WHERE { <http://example.org/nation/2> ex:after* ?b }", f"{_RECURSIVE_RING} SELECT 'http://example.org/nation/' || b b FROM w WHERE a = 2 UNION SELECT 'http://example.org/nation/2'", {"extra": (_ring,), "names": ()}),
    "path_plus_to": ("SELECT ?a WHERE { ?a ex:after+ <http://example.org/nation/7> }", f"{_RECURSIVE_RING} SELECT 'http://example.org/nation/' || a a FROM w WHERE b = 7", {"extra": (_ring,), "names": ()}),
    "path_star": ("SELECT ?a ?b WHERE { ?a ex:after* ?b }", f"{_RECURSIVE_RING} SELECT 'http://example.org/nation/' || a a, 'http://example.org/nation/' || b b FROM w", {"extra": (_ring,), "names": ()}),
    "path_optional": ("SELECT ?b WHERE { <http://example.org/nation/2> ex:after? ?b }", f"{_RECURSIVE_RING} SELECT 'http://example.org/nation/' || b b FROM s WHERE a = 2 UNION SELECT 'http://example.org/nation/2'", {"extra": (_ring,), "names": ()}),
    "path_between": ("SELECT (COUNT(*) AS ?n) WHERE { <http://example.org/nation/2> ex:after+ <http://example.org/nation/7> }", f"{_RECURSIVE_RING} SELECT count(*) n FROM w WHERE a = 2 AND b = 7", {"extra": (_ring,), "names": ()}),
    "path_join": ("SELECT ?n ?m WHERE { ?x ex:n_name ?n . ?x ex:after+ ?y . ?y ex:n_name ?m FILTER(?n = 'NATION_3') }", f"{_RECURSIVE_RING} SELECT x.n_name n, y.n_name m FROM w JOIN nation x ON a = x.n_nationkey JOIN nation y ON b = y.n_nationkey WHERE x.n_name = 'NATION_3'", {"extra": (_ring,), "names": ("nation",)}),
    # functions
    "fn_arithmetic": ("SELECT ?k ((?s + 3) AS ?a) ((?s - ?k) AS ?b) ((?s * 2) AS ?c) ((-?s) AS ?d) ((?s / 4) AS ?e) ((?k / 0) AS ?z) WHERE { ?p ex:p_partkey ?k ; ex:p_size ?s }", "SELECT p_partkey k, CAST(p_size + 3 AS BIGINT) a, p_size - p_partkey b, CAST(p_size * 2 AS BIGINT) c, CAST(-p_size AS BIGINT) d, p_size / 4.0::DOUBLE e, CAST(NULL AS DOUBLE) z FROM part"),
    "fn_numeric": ("SELECT ?k (ABS(?b) AS ?a) (ROUND(?b) AS ?r) (CEIL(?b) AS ?c) (FLOOR(?b) AS ?f) WHERE { ?x ex:c_custkey ?k ; ex:c_acctbal ?b }", "SELECT c_custkey k, abs(c_acctbal) a, round(c_acctbal) r, ceil(c_acctbal) c, floor(c_acctbal) f FROM customer"),
    "fn_strings": (
        "SELECT ?k (STRLEN(?n) AS ?len) (UCASE(?n) AS ?u) (LCASE(?b) AS ?l) (SUBSTR(?n, 2, 3) AS ?s) (SUBSTR(?n, 4) AS ?t) (CONCAT(?n, '-', ?b) AS ?c) (STRBEFORE(?n, ' ') AS ?before) (STRAFTER(?n, ' ') AS ?after) WHERE { ?p ex:p_partkey ?k ; ex:p_name ?n ; ex:p_brand ?b }",
        "SELECT p_partkey k, length(p_name) len, upper(p_name) u, lower(p_brand) l, substring(p_name, 2, 3) s, substring(p_name, 4) t, p_name || '-' || p_brand c, split_part(p_name, ' ', 1) before, substring(p_name, strpos(p_name, ' ') + 1) after FROM part",
    ),
    "fn_string_tests": ("SELECT ?k WHERE { ?p ex:p_partkey ?k ; ex:p_name ?n ; ex:p_type ?t FILTER(STRSTARTS(?n, 'blue') && (CONTAINS(?n, 'bolt') || STRENDS(?t, 'L'))) }", "SELECT p_partkey k FROM part WHERE p_name LIKE 'blue%' AND (p_name LIKE '%bolt%' OR p_type LIKE '%L')"),
    "fn_regex": ("SELECT ?k WHERE { ?p ex:p_partkey ?k ; ex:p_name ?n FILTER(REGEX(?n, '^RED.*(ring|bolt)$', 'i')) }", "SELECT p_partkey k FROM part WHERE regexp_matches(p_name, '^RED.*(ring|bolt)$', 'i')"),
    "fn_replace": ("SELECT ?k (REPLACE(?n, '([aeiou])', '<$1>') AS ?v) WHERE { ?p ex:p_partkey ?k ; ex:p_name ?n }", "SELECT p_partkey k, regexp_replace(p_name, '([aeiou])', '<\\1>', 'g') v FROM part"),
    "fn_encode": ("SELECT ?k (ENCODE_FOR_URI(?n) AS ?v) WHERE { ?p ex:p_partkey ?k ; ex:p_name ?n }", "SELECT p_partkey k, url_encode(p_name) v FROM part"),
    "fn_hash": ("SELECT ?k (MD5(?n) AS ?a) (SHA1(?n) AS ?b) (SHA256(?n) AS ?c) WHERE { ?x ex:n_nationkey ?k ; ex:n_name ?n }", "SELECT CAST(n_nationkey AS BIGINT) k, md5(n_name) a, sha1(n_name) b, sha256(n_name) c FROM nation"),
    "fn_hash_long": ("SELECT ?k (STRLEN(SHA384(?n)) AS ?a) (STRLEN(SHA512(?n)) AS ?b) WHERE { ?x ex:n_nationkey ?k ; ex:n_name ?n }", "SELECT CAST(n_nationkey AS BIGINT) k, CAST(96 AS BIGINT) a, CAST(128 AS BIGINT) b FROM nation"),
    "fn_dates": ("SELECT ?k (YEAR(?d) AS ?y) (MONTH(?d) AS ?m) (DAY(?d) AS ?a) (HOURS(?d) AS ?h) (MINUTES(?d) AS ?i) WHERE { ?e ex:event_id ?k ; ex:ts ?d }", "SELECT event_id k, year(ts) y, month(ts) m, day(ts) a, hour(ts) h, minute(ts) i FROM events"),
    "fn_seconds": ("SELECT ?k (SECONDS(?d) AS ?s) (TZ(?d) AS ?z) WHERE { ?e ex:event_id ?k ; ex:ts ?d }", "SELECT event_id k, CAST(second(ts) AS DOUBLE) s, 'Z' z FROM events"),
    "fn_if_coalesce": ("SELECT ?k (IF(?s > 25, 'large', 'small') AS ?v) (COALESCE(?no, ?k / 0, ?s) AS ?w) WHERE { ?p ex:p_partkey ?k ; ex:p_size ?s }", "SELECT p_partkey k, CASE WHEN p_size > 25 THEN 'large' ELSE 'small' END v, CAST(p_size AS VARCHAR) w FROM part"),
    "fn_kinds": ("SELECT ?k (ISIRI(?x) AS ?a) (ISLITERAL(?n) AS ?b) (ISNUMERIC(?k) AS ?c) (ISBLANK(?x) AS ?d) (DATATYPE(?k) AS ?e) (LANG(?n) AS ?f) (STR(?x) AS ?g) WHERE { ?x ex:n_nationkey ?k ; ex:n_name ?n }", "SELECT CAST(n_nationkey AS BIGINT) k, true a, true b, true c, false d, 'http://www.w3.org/2001/XMLSchema#integer' e, '' f, 'http://example.org/nation/' || n_nationkey g FROM nation"),
    "fn_lang": ("SELECT ?k (LANG(?t) AS ?l) (STR(?t) AS ?s) (LANGMATCHES(LANG(?t), 'en') AS ?m) (DATATYPE(?t) AS ?d) WHERE { ?x ex:n_nationkey ?k ; ex:n_name ?n BIND(STRLANG(?n, 'en-GB') AS ?t) }", "SELECT CAST(n_nationkey AS BIGINT) k, 'en-GB' l, n_name s, true m, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#langString' d FROM nation"),
    "fn_casts": ("SELECT ?k (xsd:integer(?b) AS ?i) (xsd:double(?k) AS ?d) (xsd:string(?k) AS ?s) (xsd:boolean(?one) AS ?t) (xsd:integer('x') AS ?e) WHERE { ?x ex:c_custkey ?k ; ex:c_acctbal ?b BIND('1' AS ?one) }", "SELECT c_custkey k, CAST(trunc(c_acctbal) AS BIGINT) i, CAST(c_custkey AS DOUBLE) d, CAST(c_custkey AS VARCHAR) s, true t, CAST(NULL AS BIGINT) e FROM customer"),
    "fn_iri": ("SELECT ?n WHERE { ?x ex:r_name ?m BIND(IRI(CONCAT('http://example.org/nation/', STR(STRLEN(?m)))) AS ?y) ?y ex:n_name ?n }", "SELECT n_name n FROM region JOIN nation ON n_nationkey = length(r_name)"),
    "fn_same_term": ("SELECT (COUNT(*) AS ?n) WHERE { ?x ex:n_nationkey ?a ; ex:n_regionkey ?r . ?r ex:r_regionkey ?b FILTER(SAMETERM(?a, ?b)) }", "SELECT count(*) n FROM nation WHERE n_nationkey = n_regionkey"),
    "fn_strdt": ("SELECT ?k (DATATYPE(?v) AS ?d) ((?v + 1) AS ?w) WHERE { ?x ex:n_nationkey ?k BIND(STRDT(STR(?k), xsd:integer) AS ?v) }", "SELECT CAST(n_nationkey AS BIGINT) k, 'http://www.w3.org/2001/XMLSchema#integer' d, CAST(n_nationkey + 1 AS VARCHAR) w FROM nation"),
    "fn_documents": ("SELECT ?k (STRLEN(?t) AS ?n) WHERE { ?d ex:doc_id ?k ; ex:text ?t ; ex:lang 'en' FILTER(CONTAINS(?t, 'Licensed under')) }", "SELECT doc_id k, length(text) n FROM documents WHERE lang = 'en' AND contains(text, 'Licensed under')", {"extra": (lambda spark, sf: table(read(spark, sf, "documents"), "documents", "doc_id", BASE),), "names": ()}),
    # forms
    "construct": ("CONSTRUCT { ?r ex:has ?n . ?x ex:in ?r } WHERE { ?x ex:n_regionkey ?r ; ex:n_name ?n }", "SELECT 1 sk, 'http://example.org/region/' || n_regionkey s, 'http://example.org/has' p, 2 k, n_name v, 'http://www.w3.org/2001/XMLSchema#string' dt, '' lang FROM nation UNION SELECT 1, 'http://example.org/nation/' || n_nationkey, 'http://example.org/in', 1, 'http://example.org/region/' || n_regionkey, '', '' FROM nation"),
    "describe": ("DESCRIBE <http://example.org/region/1>", "SELECT 1 sk, 'http://example.org/region/1' s, 'http://example.org/r_name' p, 2 k, r_name v, 'http://www.w3.org/2001/XMLSchema#string' dt, '' lang FROM region WHERE r_regionkey = 1 UNION ALL SELECT 1, 'http://example.org/region/1', 'http://example.org/r_regionkey', 2, '1', 'http://www.w3.org/2001/XMLSchema#integer', '' UNION ALL SELECT 1, 'http://example.org/region/1', 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', 1, 'http://example.org/Region', '', ''"),
}


# Queries over stored triples


def _graph(spark: SparkSession, sf_dir: str, *names: str) -> Engine:
    """The named tables as stored triples."""
    e = engine(spark, sf_dir, names)
    e.store, e.mapping = TripleStore(e.triples()), None
    return e


def _ask(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir, ("nation",))
    texts = ("ASK { ?x ex:n_name 'NATION_3' }", "ASK { ?x ex:n_name 'ATLANTIS' }")
    return spark.createDataFrame([(i, e.sparql(PREFIXES + q)) for i, q in enumerate(texts)], "q int, answer boolean")


def _store_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir, "nation", "region", "customer").sparql(PREFIXES + "SELECT ?c ?r WHERE { ?c ex:c_nationkey ?n ; ex:c_acctbal ?b . ?n ex:n_regionkey ?g . ?g ex:r_name ?r FILTER(?b > 9000) }")


def _store_mixed_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A predicate that has IRIs, integers and strings: ordering, filters and aggregates over mixed kinds."""
    e = _graph(spark, sf_dir, "nation")
    e.update(PREFIXES + "INSERT { ?x ex:any ?v } WHERE { { ?x ex:n_name ?v } UNION { ?x ex:n_nationkey ?v } UNION { ?x ex:n_regionkey ?v } }")
    return e.sparql(PREFIXES + "SELECT ?kind (COUNT(*) AS ?n) (MIN(?v) AS ?least) (MAX(?v) AS ?most) WHERE { ?x ex:any ?v BIND(IF(ISIRI(?v), 'iri', IF(ISNUMERIC(?v), 'number', 'text')) AS ?kind) } GROUP BY ?kind")


def _update(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _graph(spark, sf_dir, "nation", "region")
    e.update(
        PREFIXES
        + """INSERT DATA { ex:new ex:n_name "NEW" . <http://example.org/region/0> ex:note "first"@en } ;
             DELETE DATA { <http://example.org/region/4> ex:r_name "MIDDLE EAST" } ;
             DELETE { ?x ex:n_regionkey ?r } INSERT { ?x ex:in ?r } WHERE { ?x ex:n_regionkey ?r FILTER(?r = <http://example.org/region/1>) } ;
             DELETE WHERE { <http://example.org/nation/0> ?p ?o }"""
    )
    return e.triples().select("s", "p", "v")


_UPDATED = """
WITH cells AS (
  SELECT 'http://example.org/nation/' || n_nationkey s, unnest(['n_nationkey', 'n_name', 'n_regionkey', 'type']) p, unnest([CAST(n_nationkey AS VARCHAR), n_name, 'http://example.org/region/' || n_regionkey, 'http://example.org/Nation']) v, n_regionkey r FROM nation WHERE n_nationkey <> 0
  UNION ALL SELECT 'http://example.org/region/' || r_regionkey, unnest(['r_regionkey', 'r_name', 'type']), unnest([CAST(r_regionkey AS VARCHAR), r_name, 'http://example.org/Region']), NULL FROM region)
SELECT s, CASE WHEN p = 'type' THEN 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type' WHEN p = 'n_regionkey' AND r = 1 THEN 'http://example.org/in' ELSE 'http://example.org/' || p END p, v
FROM cells WHERE NOT (p = 'r_name' AND v = 'MIDDLE EAST')
UNION ALL SELECT 'http://example.org/new', 'http://example.org/n_name', 'NEW'
UNION ALL SELECT 'http://example.org/region/0', 'http://example.org/note', 'first'
"""


def _clear(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _graph(spark, sf_dir, "region")
    n = e.update("CLEAR DEFAULT ; CREATE GRAPH <http://example.org/g>")
    return spark.createDataFrame([(n, e.triples().count())], "cleared long, left_over long")


def _round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples written as N-Triples by the executors and read back."""
    from ternion.plans.checkpoints import shared_dir
    from ternion.sources import io, ntriples

    import uuid

    e = engine(spark, sf_dir, ("nation", "customer"))
    path = f"{shared_dir(spark)}/ternion-{spark.sparkContext.applicationId}/export-{uuid.uuid4().hex}"
    ntriples.lines(e.triples()).write.text(path)
    return io.load(spark, path, "ntriples").groupBy("p").agg(F.count("*").alias("n"), F.count_distinct("v").alias("values"))


def _turtle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small graph written as Turtle and read back."""
    e = engine(spark, sf_dir, ("nation", "region"))
    again = Engine(spark)
    again.load_string(e.export(format="turtle", prefixes={"ex": BASE}))
    return again.sparql(PREFIXES + "SELECT ?n ?r WHERE { ?x ex:n_name ?n ; ex:n_regionkey/ex:r_name ?r }")


def _histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ternion import stats

    return stats.predicate_histogram(_graph(spark, sf_dir, "nation", "customer").store)


def _numeric_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ternion import stats

    return stats.numeric_histogram(_graph(spark, sf_dir, "part").store, f"{BASE}p_size", 7).select("bucket", "count")


def _range_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ternion import stats

    return stats.range_scan(_graph(spark, sf_dir, "part").store, f"{BASE}p_retailprice", 920, 950)


def _triple(s, p: str, o, literal: bool = False) -> list:
    return [F.lit(IRI_KIND).alias("sk"), s.alias("s"), F.lit(p).alias("p"), F.lit(LITERAL if literal else IRI_KIND).alias("k"), o.alias("v"), F.lit(STRING if literal else "").alias("dt"), F.lit("").alias("lang")]


def _reason_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts typed by p_type, types below brands of types, places in each other (transitive)."""
    part, nation, customer = (read(spark, sf_dir, n) for n in ("part", "nation", "customer"))
    iri = lambda kind, c: F.concat(F.lit(f"{BASE}{kind}/"), F.col(c).cast("string"))
    facts = part.select(*_triple(iri("part", "p_partkey"), TYPE, iri("type", "p_type")))
    types = part.select("p_type").distinct()
    facts = facts.union(types.select(*_triple(iri("type", "p_type"), RDFS + "subClassOf", F.concat(F.lit(f"{BASE}initial/"), F.substring("p_type", 1, 1)))))
    facts = facts.union(types.select(F.substring("p_type", 1, 1).alias("i")).distinct().select(*_triple(iri("initial", "i"), RDFS + "subClassOf", F.lit(f"{BASE}Thing"))))
    facts = facts.union(customer.select(*_triple(iri("customer", "c_custkey"), f"{BASE}in", iri("nation", "c_nationkey"))))
    facts = facts.union(nation.select(*_triple(iri("nation", "n_nationkey"), f"{BASE}in", iri("region", "n_regionkey"))))
    schema = [(f"{BASE}in", TYPE, "http://www.w3.org/2002/07/owl#TransitiveProperty"), (f"{BASE}in", RDFS + "domain", f"{BASE}Located"), (f"{BASE}in", "http://www.w3.org/2002/07/owl#inverseOf", f"{BASE}holds")]
    return facts.union(spark.createDataFrame([(IRI_KIND, s, p, IRI_KIND, o, "", "") for s, p, o in schema], facts.schema))


def _reason(profile: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from ternion.reason import fixpoint
        from ternion.reason.rules import rules_of

        return fixpoint.materialize(_reason_graph(spark, sf_dir), rules_of(profile)).derived.select("s", "p", "v")

    return run


_RDFS_SQL = """
WITH t AS (SELECT DISTINCT p_type, p_type[1] i FROM part)
SELECT 'http://example.org/part/' || p_partkey s, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type' p, unnest(['http://example.org/initial/' || p_type[1], 'http://example.org/Thing']) v FROM part
UNION ALL SELECT 'http://example.org/type/' || p_type, 'http://www.w3.org/2000/01/rdf-schema#subClassOf', 'http://example.org/Thing' FROM t
UNION ALL SELECT s, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', 'http://example.org/Located' FROM (SELECT 'http://example.org/customer/' || c_custkey s FROM customer UNION SELECT 'http://example.org/nation/' || n_nationkey FROM nation)
"""
_OWL_SQL = (
    _RDFS_SQL
    + """
UNION ALL SELECT 'http://example.org/customer/' || c_custkey, 'http://example.org/in', 'http://example.org/region/' || n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT 'http://example.org/region/' || n_regionkey, 'http://example.org/holds', 'http://example.org/customer/' || c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT 'http://example.org/nation/' || c_nationkey, 'http://example.org/holds', 'http://example.org/customer/' || c_custkey FROM customer
UNION ALL SELECT 'http://example.org/region/' || n_regionkey, 'http://example.org/holds', 'http://example.org/nation/' || n_nationkey FROM nation
"""
)


def _same_as(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All suppliers, merged by their own nation."""
    return _merged(spark, read(spark, sf_dir, "supplier"), F.col("s_nationkey"))


def _merged(spark: SparkSession, s: DataFrame, nation) -> DataFrame:
    from ternion.reason import fixpoint
    from ternion.reason.rules import rules_of

    iri = F.concat(F.lit(f"{BASE}supplier/"), F.col("s_suppkey").cast("string"))
    facts = s.select(*_triple(iri, f"{BASE}at", F.concat(F.lit(f"{BASE}nation/"), nation.cast("string"))))
    facts = facts.union(s.select(*_triple(iri, f"{BASE}name", F.col("s_name"), True)))
    facts = facts.union(spark.createDataFrame([(IRI_KIND, f"{BASE}at", TYPE, IRI_KIND, "http://www.w3.org/2002/07/owl#InverseFunctionalProperty", "", "")], facts.schema))
    rules = rules_of("custom", names=("prp_ifp", "eq_sym", "eq_trans", "eq_rep_s"))
    return fixpoint.materialize(facts, rules, spread=False).derived.filter(F.col("p") == f"{BASE}name").select("s", "v")


#: Facts of the queries of single rules: nations in regions and the reverse, what they are, and customers in nations.
_PLACES = {
    "in": ("nation", "nation/", "n_nationkey", f"{BASE}in", "region/", "n_regionkey"),
    "holds": ("nation", "region/", "n_regionkey", f"{BASE}holds", "nation/", "n_nationkey"),
    "of": ("customer", "customer/", "c_custkey", f"{BASE}in", "nation/", "c_nationkey"),
    "region": ("region", "region/", "r_regionkey", TYPE, "Region", None),
    "nation": ("nation", "nation/", "n_nationkey", TYPE, "Nation", None),
    "customer": ("customer", "customer/", "c_custkey", TYPE, "Listed", None),
    "member": ("nation", "nation/", "n_nationkey", TYPE, "Of", "n_regionkey"),
    "below": ("nation", "nation/", "n_nationkey", RDFS + "subPropertyOf", "region/", "n_regionkey"),
    "top": ("region", "region/", "r_regionkey", RDFS + "subPropertyOf", "top", None),
    "same": ("region", "region/", "r_regionkey", OWL + "sameAs", "area/", "r_regionkey"),
    "value": ("region", "Of", "r_regionkey", OWL + "hasValue", "region/", "r_regionkey"),
    "on": ("region", "Of", "r_regionkey", OWL + "onProperty", "in", None),
}


def _one_rule(name: str, places: str, *schema: tuple[str, str, str]) -> Callable[[SparkSession, str], DataFrame]:
    """What a rule alone derives from facts of whole tables and a few schema triples."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from ternion.reason import fixpoint
        from ternion.reason.rules import rules_of

        facts = None
        for place in places.split():
            table, before, key, p, after, value = _PLACES[place]
            o = F.concat(F.lit(BASE + after), F.col(value).cast("string")) if value else F.lit(BASE + after)
            one = read(spark, sf_dir, table).select(*_triple(F.concat(F.lit(BASE + before), F.col(key).cast("string")), p, o))
            facts = one if facts is None else facts.union(one)
        if schema:
            facts = facts.union(spark.createDataFrame([(IRI_KIND, s, p, IRI_KIND, o, "", "") for s, p, o in schema], facts.schema))
        return fixpoint.materialize(facts, rules_of("custom", names=(name,))).derived.select("s", "p", "v")

    return run


def _rule_sql(s: str, p: str, v: str, rest: str) -> str:
    return f"SELECT DISTINCT {s} s, '{p}' p, {v} v FROM {rest}"


_NATION, _REGION, _CUSTOMER = (f"'{BASE}{x}/' || {k}" for x, k in (("nation", "n_nationkey"), ("region", "n_regionkey"), ("customer", "c_custkey")))
_IN, _SOME = f"{BASE}in", f"{BASE}Some"
RULE_QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "rule_scm_spo": (_one_rule("scm_spo", "below top"), _rule_sql(_NATION, RDFS + "subPropertyOf", f"'{BASE}top'", "nation")),
    "rule_prp_spo1": (_one_rule("prp_spo1", "of", (_IN, RDFS + "subPropertyOf", f"{BASE}within")), _rule_sql(_CUSTOMER, f"{BASE}within", f"'{BASE}nation/' || c_nationkey", "customer")),
    "rule_prp_rng": (_one_rule("prp_rng", "of", (_IN, RDFS + "range", f"{BASE}Nation")), _rule_sql(f"'{BASE}nation/' || c_nationkey", TYPE, f"'{BASE}Nation'", "customer")),
    "rule_prp_symp": (_one_rule("prp_symp", "of", (_IN, TYPE, OWL + "SymmetricProperty")), _rule_sql(f"'{BASE}nation/' || c_nationkey", _IN, _CUSTOMER, "customer")),
    "rule_prp_fp": (_one_rule("prp_fp", "holds", (f"{BASE}holds", TYPE, OWL + "FunctionalProperty")), _rule_sql(f"'{BASE}nation/' || a.n_nationkey", OWL + "sameAs", f"'{BASE}nation/' || b.n_nationkey", "nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey")),
    "rule_eq_ref": (_one_rule("eq_ref", "of"), _rule_sql(_CUSTOMER, OWL + "sameAs", _CUSTOMER, "customer")),
    "rule_eq_rep_p": (_one_rule("eq_rep_p", "of", (_IN, OWL + "sameAs", f"{BASE}isIn")), _rule_sql(_CUSTOMER, f"{BASE}isIn", f"'{BASE}nation/' || c_nationkey", "customer")),
    "rule_eq_rep_o": (_one_rule("eq_rep_o", "in same"), _rule_sql(_NATION, _IN, f"'{BASE}area/' || n_regionkey", "nation")),
    "rule_cls_hv1": (_one_rule("cls_hv1", "member value on"), _rule_sql(_NATION, _IN, _REGION, "nation")),
    "rule_cls_hv2": (_one_rule("cls_hv2", "in value on"), _rule_sql(_NATION, TYPE, f"'{BASE}Of' || n_regionkey", "nation")),
    "rule_cls_svf1": (_one_rule("cls_svf1", "of nation", (_SOME, OWL + "someValuesFrom", f"{BASE}Nation"), (_SOME, OWL + "onProperty", _IN)), _rule_sql(_CUSTOMER, TYPE, f"'{_SOME}'", "customer")),
    "rule_cls_svf2": (_one_rule("cls_svf2", "of", (_SOME, OWL + "someValuesFrom", OWL + "Thing"), (_SOME, OWL + "onProperty", _IN)), _rule_sql(_CUSTOMER, TYPE, f"'{_SOME}'", "customer")),
    "rule_cls_avf": (_one_rule("cls_avf", "of customer", (f"{BASE}Listed", OWL + "allValuesFrom", f"{BASE}Place"), (f"{BASE}Listed", OWL + "onProperty", _IN)), _rule_sql(f"'{BASE}nation/' || c_nationkey", TYPE, f"'{BASE}Place'", "customer")),
}


def _incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived triples after adding and removing facts step by step, as if derived from scratch."""
    from ternion.reason import fixpoint
    from ternion.reason.rules import rules_of

    rules = rules_of("owl2rl")
    every = _reason_graph(spark, sf_dir)
    late = (F.col("p") == f"{BASE}in") & F.col("s").startswith(f"{BASE}nation/")
    gone = every.filter((F.col("p") == RDFS + "subClassOf") & F.col("s").startswith(f"{BASE}initial/"))
    first = every.filter(~late)
    derived = fixpoint.materialize(first, rules).derived
    more = fixpoint.add(first, derived, every.filter(late), rules).derived
    return fixpoint.remove(every, derived.unionByName(more), gone, rules).select("s", "p", "v")


_INCREMENTAL_SQL = _OWL_SQL.replace("unnest(['http://example.org/initial/' || p_type[1], 'http://example.org/Thing'])", "'http://example.org/initial/' || p_type[1]").replace("UNION ALL SELECT 'http://example.org/type/' || p_type, 'http://www.w3.org/2000/01/rdf-schema#subClassOf', 'http://example.org/Thing' FROM t\n", "")


def _prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir, ("nation",))
    q = e.prepare(PREFIXES + "SELECT ?n WHERE { ?x ex:n_regionkey $region ; ex:n_name ?n ; ex:n_nationkey ?k FILTER(?k > $least) }")
    return e.execute(q, {"region": f"{BASE}region/1", "least": 3})


#: Queries that are more than one SPARQL text: function and SQL.
PROGRAMS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "ask": (_ask, "SELECT 0 q, true answer UNION ALL SELECT 1, false"),
    "store_join": (_store_join, "SELECT 'http://example.org/customer/' || c_custkey c, r_name r FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_acctbal > 9000"),
    "store_mixed_objects": (_store_mixed_objects, "SELECT 'iri' kind, count(DISTINCT n_nationkey) n, min('http://example.org/region/' || n_regionkey) least, max('http://example.org/region/' || n_regionkey) most FROM nation UNION ALL SELECT 'number', count(*), CAST(min(n_nationkey) AS VARCHAR), CAST(max(n_nationkey) AS VARCHAR) FROM nation UNION ALL SELECT 'text', count(*), min(n_name), max(n_name) FROM nation"),
    "update": (_update, _UPDATED),
    "update_clear": (_clear, "SELECT 3 * count(*) cleared, CAST(0 AS BIGINT) left_over FROM region"),
    "ntriples_round_trip": (
        _round_trip,
        "SELECT 'http://example.org/' || c p, count(*) n, count(DISTINCT v) \"values\" FROM (SELECT unnest(['n_nationkey', 'n_name', 'n_regionkey']) c, unnest([CAST(n_nationkey AS VARCHAR), n_name, CAST(n_regionkey AS VARCHAR)]) v FROM nation UNION ALL SELECT unnest(['c_custkey', 'c_name', 'c_nationkey', 'c_acctbal', 'c_mktsegment']), unnest([CAST(c_custkey AS VARCHAR), c_name, CAST(c_nationkey AS VARCHAR), CAST(c_acctbal AS VARCHAR), c_mktsegment]) FROM customer) GROUP BY c UNION ALL SELECT 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer), 2",
    ),
    "turtle_round_trip": (_turtle, "SELECT n_name n, r_name r FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "stats_predicates": (_histogram, "SELECT 'http://example.org/' || c p, count(*) \"count\" FROM (SELECT unnest(['n_nationkey', 'n_name', 'n_regionkey']) c FROM nation UNION ALL SELECT unnest(['c_custkey', 'c_name', 'c_nationkey', 'c_acctbal', 'c_mktsegment']) FROM customer) GROUP BY c UNION ALL SELECT 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer)"),
    "stats_numbers": (_numeric_histogram, "WITH b AS (SELECT min(p_size) a, (max(p_size) - min(p_size)) / 7.0::DOUBLE w FROM part) SELECT least(CAST(floor((p_size - a) / w) AS INT), 6) bucket, count(*) \"count\" FROM part, b GROUP BY 1"),
    "range_scan": (_range_scan, "SELECT 'http://example.org/part/' || p_partkey s, p_retailprice x FROM part WHERE p_retailprice BETWEEN 920 AND 950"),
    "prepared": (_prepared, "SELECT n_name n FROM nation WHERE n_regionkey = 1 AND n_nationkey > 3"),
    "reason_rdfs": (_reason("rdfs"), _RDFS_SQL),
    "reason_owl2rl": (_reason("owl2rl"), _OWL_SQL),
    "reason_same_as": (_same_as, "SELECT 'http://example.org/supplier/' || a.s_suppkey s, b.s_name v FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey"),
    "reason_incremental": (_incremental, _INCREMENTAL_SQL),
    **RULE_QUERIES,
}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["revenue_by_nation"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {}
    for name, (text, _, *options) in SPARQL.items():
        given = options[0] if options else {}
        out[name] = _sparql(text, *given.get("extra", ()), names=given.get("names", tuple(KEYS)))
    return out | {name: run for name, (run, _) in PROGRAMS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q[1] for name, q in SPARQL.items()} | {name: sql for name, (_, sql) in PROGRAMS.items() if sql}


__all__ = ["COLUMNS", "flagship", "oracle_sql", "queries"]
