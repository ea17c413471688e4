"""Synthetic graphs for benchmarks: an e-commerce graph and a university graph, made by the executors.

All choices come from hashes of ids and a seed, so a size and seed always give the same graph.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ternion import terms as t
from ternion.sources.store import COLUMNS
from ternion.terms import OWL, RDFS, TYPE

SHOP = "http://example.org/shop/"
UNIVERSITY = "http://example.org/university/"
LABEL, COMMENT = RDFS + "label", RDFS + "comment"


def _pick(n: int | Column, salt: int, *keys: Column) -> Column:
    """A number from 0 to n - 1 that depends on the keys."""
    return F.pmod(F.xxhash64(*keys, F.lit(salt)), n if isinstance(n, Column) else F.lit(n))


def _iri(kind: str, *ids: Column, base: str = SHOP) -> Column:
    return F.concat(F.lit(base + kind), F.concat_ws("_", *(i.cast("string") for i in ids)))


def _cells(df: DataFrame, subject: Column, cells: list[tuple[str, Column, str]]) -> DataFrame:
    """Triples of each row's subject; a cell is a predicate, an object and ``iri`` or a datatype."""
    made = [
        F.struct(F.lit(t.IRI_KIND).alias("sk"), subject.alias("s"), F.lit(p).alias("p"), F.lit(t.IRI_KIND if dt == "iri" else t.LITERAL).alias("k"), o.cast("string").alias("v"), F.lit("" if dt == "iri" else dt).alias("dt"), F.lit("").alias("lang"))
        for p, o, dt in cells
    ]
    return df.select(F.inline(F.array(*made))).select(*COLUMNS)


def _each(df: DataFrame, least: int, most: int, salt: int, key: Column) -> DataFrame:
    """A row for each of ``least`` to ``most`` parts of a row, numbered by n."""
    return df.withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(least - 1) + _pick(most - least + 1, salt, key))))


def _date(salt: int, *keys: Column) -> Column:
    return F.date_add(F.lit("2020-01-01").cast("date"), _pick(1500, salt, *keys).cast("int"))


def shop(spark: SparkSession, products: int = 1000, seed: int = 42) -> DataFrame:
    """Products with features, producers, vendors' offers and reviews; about 140 triples a product."""
    base = 100 * seed
    types, producers, vendors, people = 10, max(1, products // 50), max(1, products * 3 // 100), max(1, products // 2)
    ident = F.col("id")
    n = F.col("n")
    cls = lambda name: F.lit(SHOP + name)
    parts = []
    kinds = _each(spark.range(types), 5, 10, base + 1, ident)
    feature = _iri("ProductFeature", ident, n)
    parts.append(_cells(kinds, feature, [(TYPE, cls("ProductFeature"), "iri"), (LABEL, F.concat(F.lit("Feature"), ident, F.lit("_"), n), t.STRING), (SHOP + "publishDate", _date(base + 2, ident, n), t.DATE)]))
    sites = spark.range(10)
    parts.append(_cells(sites, _iri("ReviewSite", ident), [(TYPE, cls("ReviewSite"), "iri"), (LABEL, F.concat(F.lit("Site"), ident), t.STRING)]))
    for kind, count, salt in (("Producer", producers, 3), ("Vendor", vendors, 4)):
        subject = _iri(kind, ident)
        cells = [(TYPE, cls(kind), "iri"), (LABEL, F.concat(F.lit(kind), ident), t.STRING), (SHOP + "country", F.concat(F.lit(SHOP + "country/"), F.element_at(F.array(*(F.lit(c) for c in ("US", "DE", "FR", "GB", "JP"))), (_pick(5, base + salt, ident) + 1).cast("int"))), "iri"), (SHOP + "publisher", subject, "iri")]
        if kind == "Vendor":
            cells.append((SHOP + "homepage", F.concat(F.lit("http://vendor"), ident, F.lit(".example.org/")), t.STRING))
        parts.append(_cells(spark.range(count), subject, cells))
    product = _iri("Product", ident)
    kind = _pick(types, base + 5, ident)
    rows = spark.range(products)
    parts.append(
        _cells(
            rows, product,
            [(TYPE, cls("Product"), "iri"), (TYPE, _iri("ProductType", kind), "iri"), (LABEL, F.concat(F.lit("Product"), ident), t.STRING), (COMMENT, F.concat(F.lit("About product "), ident), t.STRING), (SHOP + "producer", _iri("Producer", _pick(producers, base + 6, ident)), "iri"),
             (SHOP + "productPropertyNumeric1", 1 + _pick(2000, base + 7, ident), t.INTEGER), (SHOP + "productPropertyNumeric2", 1 + _pick(2000, base + 8, ident), t.INTEGER), (SHOP + "productPropertyTextual1", F.concat(F.lit("text "), _pick(500, base + 9, ident)), t.STRING), (SHOP + "productPropertyTextual2", F.concat(F.lit("words "), _pick(500, base + 10, ident)), t.STRING), (SHOP + "publisher", _iri("Producer", _pick(producers, base + 6, ident)), "iri")],
        )
    )
    parts.append(_cells(_each(rows, 5, 10, base + 11, ident), product, [(SHOP + "productFeature", _iri("ProductFeature", kind, _pick(5, base + 12, ident, n)), "iri")]))
    price = F.round((1 + _pick(50_000, base + 13, ident, n)) / 100.0, 2)
    parts.append(
        _cells(
            _each(rows, 5, 20, base + 14, ident), _iri("Offer", ident, n),
            [(TYPE, cls("Offer"), "iri"), (SHOP + "product", product, "iri"), (SHOP + "vendor", _iri("Vendor", _pick(vendors, base + 15, ident, n)), "iri"), (SHOP + "price", price, t.DOUBLE), (SHOP + "validFrom", _date(base + 16, ident, n), t.DATE), (SHOP + "validTo", F.date_add(_date(base + 16, ident, n), 90), t.DATE)],
        )
    )
    reviewer = _iri("Person", _pick(people, base + 17, ident, n))
    parts.append(
        _cells(
            _each(rows, 3, 10, base + 18, ident), _iri("Review", ident, n),
            [(TYPE, cls("Review"), "iri"), (SHOP + "reviewFor", product, "iri"), (SHOP + "reviewer", reviewer, "iri"), (SHOP + "reviewDate", _date(base + 19, ident, n), t.DATE), (SHOP + "rating1", 1 + _pick(10, base + 20, ident, n), t.INTEGER), (SHOP + "rating2", 1 + _pick(10, base + 21, ident, n), t.INTEGER), (SHOP + "publisher", _iri("ReviewSite", _pick(10, base + 22, ident, n)), "iri")],
        )
    )
    parts.append(_cells(spark.range(people), _iri("Person", ident), [(TYPE, cls("Person"), "iri")]))
    return reduce(DataFrame.unionAll, parts).dropDuplicates(COLUMNS)


#: The class tree and the property axioms of the university graph, as in the LUBM ontology.
CLASSES = {
    "Person": "Thing", "Employee": "Person", "Faculty": "Employee", "Professor": "Faculty", "FullProfessor": "Professor", "AssociateProfessor": "Professor", "AssistantProfessor": "Professor", "Chair": "Professor", "Lecturer": "Faculty", "Student": "Person", "UndergraduateStudent": "Student",
    "GraduateStudent": "Student", "Organization": "Thing", "University": "Organization", "Department": "Organization", "ResearchGroup": "Organization", "Work": "Thing", "Course": "Work", "GraduateCourse": "Course", "Publication": "Work",
}
PROPERTIES = [("headOf", "subPropertyOf", "worksFor"), ("worksFor", "subPropertyOf", "memberOf"), ("undergraduateDegreeFrom", "subPropertyOf", "degreeFrom"), ("mastersDegreeFrom", "subPropertyOf", "degreeFrom"), ("doctoralDegreeFrom", "subPropertyOf", "degreeFrom"), ("degreeFrom", "inverseOf", "hasAlumnus")]


def university_schema(spark: SparkSession) -> DataFrame:
    u = UNIVERSITY
    rows = [(u + c, RDFS + "subClassOf", u + d) for c, d in CLASSES.items()]
    rows += [(u + p, (OWL if x == "inverseOf" else RDFS) + x, u + q) for p, x, q in PROPERTIES]
    rows.append((u + "subOrganizationOf", TYPE, OWL + "TransitiveProperty"))
    return spark.createDataFrame([(t.IRI_KIND, s, p, t.IRI_KIND, o, "", "") for s, p, o in rows], ", ".join(f"{c} {'int' if c in ('sk', 'k') else 'string'}" for c in COLUMNS))


def university(spark: SparkSession, universities: int = 1, seed: int = 42, departments: int = 15) -> DataFrame:
    """Departments with faculty, students, courses and publications; about 23,000 triples a university."""
    base, b = 100 * seed, UNIVERSITY
    ident, n = F.col("id"), F.col("n")
    iri = lambda kind, *ids: _iri(kind, *ids, base=b)
    cls = lambda name: F.lit(b + name)
    named = lambda kind, *ids: F.concat(F.lit(kind), F.concat_ws("_", *(i.cast("string") for i in ids)))
    parts = [_cells(spark.range(universities), iri("University", ident), [(TYPE, cls("University"), "iri"), (b + "name", named("University", ident), t.STRING)])]
    d = spark.range(universities * departments)
    uni = F.floor(ident / departments)
    dep = iri("Department", ident)
    parts.append(_cells(d, dep, [(TYPE, cls("Department"), "iri"), (b + "name", named("Department", ident), t.STRING), (b + "subOrganizationOf", iri("University", uni), "iri")]))
    parts.append(_cells(_each(d, 10, 15, base + 1, ident), iri("ResearchGroup", ident, n), [(TYPE, cls("ResearchGroup"), "iri"), (b + "subOrganizationOf", dep, "iri")]))
    faculty = _each(d, 28, 34, base + 2, ident).cache()
    kind = F.element_at(F.array(cls("FullProfessor"), cls("AssociateProfessor"), cls("AssistantProfessor")), (n % 3 + 1).cast("int"))
    who = F.concat(kind, ident.cast("string"), F.lit("_"), n.cast("string"))
    degree = lambda salt, *k: iri("University", _pick(universities, salt, *k))
    mail = lambda label, *k: F.concat(named(label, *k), F.lit("@example.org"))
    parts.append(
        _cells(
            faculty, who,
            [(TYPE, kind, "iri"), (b + "name", named("Faculty", ident, n), t.STRING), (b + "worksFor", dep, "iri"), (b + "emailAddress", mail("faculty", ident, n), t.STRING), (b + "telephone", F.lit("xxx-xxx-xxxx"), t.STRING), (b + "undergraduateDegreeFrom", degree(base + 3, ident, n), "iri"), (b + "mastersDegreeFrom", degree(base + 4, ident, n), "iri"), (b + "doctoralDegreeFrom", degree(base + 5, ident, n), "iri")],
        )
    )
    parts.append(_cells(faculty.filter("n = 0"), who, [(b + "headOf", dep, "iri")]))
    # each faculty member teaches a course and a graduate course
    parts.append(_cells(faculty, iri("Course", ident, n), [(TYPE, cls("Course"), "iri"), (b + "name", named("Course", ident, n), t.STRING)]))
    parts.append(_cells(faculty, iri("GraduateCourse", ident, n), [(TYPE, cls("GraduateCourse"), "iri"), (b + "name", named("GraduateCourse", ident, n), t.STRING)]))
    parts.append(_cells(faculty, who, [(b + "teacherOf", iri("Course", ident, n), "iri"), (b + "teacherOf", iri("GraduateCourse", ident, n), "iri")]))
    papers = faculty.withColumnRenamed("n", "f").withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(4))))
    f = F.col("f")
    writer = F.concat(F.element_at(F.array(cls("FullProfessor"), cls("AssociateProfessor"), cls("AssistantProfessor")), (f % 3 + 1).cast("int")), ident.cast("string"), F.lit("_"), f.cast("string"))
    parts.append(_cells(papers, iri("Publication", ident, f, n), [(TYPE, cls("Publication"), "iri"), (b + "name", named("Publication", ident, f, n), t.STRING), (b + "publicationAuthor", writer, "iri")]))
    teacher = lambda salt: _pick(28, salt, ident, n)
    advisor = lambda salt: F.concat(F.element_at(F.array(cls("FullProfessor"), cls("AssociateProfessor"), cls("AssistantProfessor")), (teacher(salt) % 3 + 1).cast("int")), ident.cast("string"), F.lit("_"), teacher(salt).cast("string"))
    under = _each(d, 120, 160, base + 6, ident)
    parts.append(_cells(under, iri("UndergraduateStudent", ident, n), [(TYPE, cls("UndergraduateStudent"), "iri"), (b + "name", named("UndergraduateStudent", ident, n), t.STRING), (b + "memberOf", dep, "iri"), (b + "emailAddress", mail("under", ident, n), t.STRING), *((b + "takesCourse", iri("Course", ident, teacher(base + 10 + i)), "iri") for i in range(3))]))
    parts.append(_cells(under.filter("n % 5 = 0"), iri("UndergraduateStudent", ident, n), [(b + "advisor", advisor(base + 7), "iri")]))
    grad = _each(d, 40, 60, base + 8, ident)
    parts.append(_cells(grad, iri("GraduateStudent", ident, n), [(TYPE, cls("GraduateStudent"), "iri"), (b + "name", named("GraduateStudent", ident, n), t.STRING), (b + "memberOf", dep, "iri"), (b + "emailAddress", mail("grad", ident, n), t.STRING), (b + "undergraduateDegreeFrom", degree(base + 9, ident, n), "iri"), (b + "advisor", advisor(base + 13), "iri"), *((b + "takesCourse", iri("GraduateCourse", ident, teacher(base + 14 + i)), "iri") for i in range(2))]))
    return reduce(DataFrame.unionAll, parts).dropDuplicates(COLUMNS)


_S = f"PREFIX s: <{SHOP}> PREFIX rdfs: <{RDFS}> "

#: Benchmark queries over shop().
SHOP_QUERIES = {
    "shop_q1": _S + "SELECT ?product ?label WHERE { ?product a s:ProductType1 ; rdfs:label ?label ; s:productFeature s:ProductFeature1_2 ; s:productPropertyNumeric1 ?v FILTER(?v > 200) } ORDER BY ?label LIMIT 10",
    "shop_q2": _S + "SELECT ?product ?label ?comment ?producer ?t1 ?t2 ?n1 ?n2 WHERE { ?product a s:ProductType1 ; rdfs:label ?label ; rdfs:comment ?comment ; s:producer ?producer ; s:productPropertyTextual1 ?t1 ; s:productPropertyTextual2 ?t2 ; s:productPropertyNumeric1 ?n1 ; s:productPropertyNumeric2 ?n2 }",
    "shop_q3": _S + "SELECT ?product ?label WHERE { ?product a s:ProductType2 ; rdfs:label ?label ; s:productFeature s:ProductFeature2_1 ; s:productPropertyNumeric1 ?v FILTER(?v > 100 && ?v < 1500) } ORDER BY ?label LIMIT 10",
    "shop_q4": _S + "SELECT ?product ?label WHERE { ?product a s:ProductType1 ; rdfs:label ?label { ?product s:productFeature s:ProductFeature1_1 } UNION { ?product s:productFeature s:ProductFeature1_3 } } ORDER BY ?label LIMIT 10",
    "shop_q5": _S + 'SELECT ?product WHERE { ?product rdfs:label "Product17" }',
    "shop_q6": _S + "SELECT ?label ?comment ?producer ?n1 WHERE { BIND(s:Product12 AS ?product) ?product rdfs:label ?label ; rdfs:comment ?comment ; s:producer ?producer ; s:productPropertyNumeric1 ?n1 }",
    "shop_q7": _S + "SELECT ?product ?offer ?price ?vendor WHERE { ?offer s:product ?product ; s:vendor ?vendor ; s:price ?price . ?product a s:ProductType1 FILTER(?price >= 50 && ?price <= 500) } ORDER BY ?price LIMIT 20",
    "shop_q8": _S + "SELECT ?review ?reviewer ?r1 ?r2 ?date WHERE { ?review s:reviewFor s:Product3 ; s:reviewer ?reviewer ; s:rating1 ?r1 ; s:rating2 ?r2 ; s:reviewDate ?date } ORDER BY DESC(?date) LIMIT 20",
    "shop_q9": _S + "SELECT ?p ?o WHERE { s:Product3 ?p ?o }",
    "shop_q10": _S + "SELECT ?offer ?vendor ?price ?from ?to WHERE { ?offer s:product s:Product3 ; s:vendor ?vendor ; s:price ?price ; s:validFrom ?from ; s:validTo ?to } ORDER BY ?price LIMIT 10",
    "shop_q11": _S + "SELECT ?offer ?product ?vendor ?price WHERE { ?offer s:product ?product ; s:vendor ?vendor ; s:price ?price . ?vendor s:country <http://example.org/shop/country/US> FILTER(?price >= 50 && ?price <= 500) } ORDER BY ?price LIMIT 10",
    "shop_q12": _S + "CONSTRUCT { s:Product3 rdfs:label ?label ; s:producer ?producer ; s:productFeature ?feature } WHERE { s:Product3 rdfs:label ?label ; s:producer ?producer ; s:productFeature ?feature }",
}

_U = f"PREFIX u: <{UNIVERSITY}> "

#: Benchmark queries over university() with the derived triples.
UNIVERSITY_QUERIES = {
    "uni_q1": _U + "SELECT ?x WHERE { ?x a u:GraduateStudent ; u:takesCourse u:GraduateCourse0_1 }",
    "uni_q2": _U + "SELECT ?x ?y ?z WHERE { ?x a u:GraduateStudent ; u:memberOf ?z ; u:undergraduateDegreeFrom ?y . ?y a u:University . ?z a u:Department ; u:subOrganizationOf ?y }",
    "uni_q3": _U + "SELECT ?x WHERE { ?x a u:Publication ; u:publicationAuthor u:AssociateProfessor0_1 }",
    "uni_q4": _U + "SELECT ?x ?n ?e ?t WHERE { ?x a u:Professor ; u:worksFor u:Department0 ; u:name ?n ; u:emailAddress ?e ; u:telephone ?t }",
    "uni_q5": _U + "SELECT ?x WHERE { ?x a u:Person ; u:memberOf u:Department0 }",
    "uni_q6": _U + "SELECT ?x WHERE { ?x a u:Student }",
    "uni_q7": _U + "SELECT ?x ?y WHERE { ?x a u:Student ; u:takesCourse ?y . ?y a u:Course . u:AssociateProfessor0_1 u:teacherOf ?y }",
    "uni_q8": _U + "SELECT ?x ?y ?e WHERE { ?x a u:Student ; u:memberOf ?y ; u:emailAddress ?e . ?y a u:Department ; u:subOrganizationOf u:University0 }",
    "uni_q9": _U + "SELECT ?x ?y ?z WHERE { ?x a u:Student ; u:advisor ?y ; u:takesCourse ?z . ?y a u:Faculty ; u:teacherOf ?z . ?z a u:Course }",
    "uni_q10": _U + "SELECT ?x WHERE { ?x a u:Student ; u:takesCourse u:GraduateCourse0_1 }",
    "uni_q11": _U + "SELECT ?x WHERE { ?x a u:ResearchGroup ; u:subOrganizationOf u:University0 }",
    "uni_q12": _U + "SELECT ?x ?y WHERE { ?x a u:Professor ; u:headOf ?y . ?y a u:Department ; u:subOrganizationOf u:University0 }",
    "uni_q13": _U + "SELECT ?x WHERE { ?x a u:Person . u:University0 u:hasAlumnus ?x }",
    "uni_q14": _U + "SELECT ?x WHERE { ?x a u:UndergraduateStudent }",
}
