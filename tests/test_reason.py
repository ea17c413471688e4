"""Rules and fixpoints, against a plain forward chainer."""

import random

import pytest

from ternion.engine import Engine
from ternion.errors import ReasoningError
from ternion.reason import fixpoint
from ternion.reason.rules import BY_NAME, RULES, Rule, by_category, rule, rules_of
from ternion.sources.store import triples
from ternion.terms import IRI, OWL, RDFS, TYPE, Literal

E = "http://e/"


def closure(facts, rules):
    """All derived facts over tuples of strings, rule by rule until nothing is new."""

    def match(pattern, fact, row):
        row = dict(row)
        for x, v in zip(pattern, fact):
            if x[0] == "?":
                if row.setdefault(x, v) != v:
                    return None
            elif x != v:
                return None
        return row

    known = set(facts)
    while True:
        new = set()
        for r in rules:
            rows = [{}]
            for p in r.body:
                rows = [m for row in rows for f in known if (m := match(p, f, row)) is not None]
            for row in rows:
                if all(test[0] != "different" or row[test[1]] != row[test[2]] for test in r.tests):
                    head = tuple(row.get(x, x) for x in r.head)
                    if not head[0].startswith('"'):
                        new.add(head)
        if new <= known:
            return known - set(facts)
        known |= new


def frame(spark, facts):
    return triples(spark, [(IRI(s), IRI(p), Literal(o[1:]) if o[0] == '"' else IRI(o)) for s, p, o in facts])


def found(df):
    return {(r.s, r.p, '"' + r.v if r.k == 2 else r.v) for r in df.collect()}


def e(*names):
    return tuple(n if n.startswith("http") or n[0] == '"' else E + n for n in names)


SUB, DOM, RNG, SPO = (RDFS + x for x in ("subClassOf", "domain", "range", "subPropertyOf"))
CASES = {
    "scm_sco": [e("A", SUB, "B"), e("B", SUB, "C"), e("C", SUB, "D"), e("D", SUB, "B")],
    "scm_spo": [e("p", SPO, "q"), e("q", SPO, "r")],
    "cax_sco": [e("x", TYPE, "A"), e("A", SUB, "B")],
    "prp_spo1": [e("p", SPO, "q"), e("x", "p", "y"), e("x", "p", '"lit')],
    "prp_dom": [e("p", DOM, "C"), e("x", "p", "y")],
    "prp_rng": [e("p", RNG, "C"), e("x", "p", "y"), e("x", "p", '"lit')],
    "prp_trp": [e("p", TYPE, OWL + "TransitiveProperty"), *(e(f"n{i}", "p", f"n{i + 1}") for i in range(6)), e("n0", "q", "n9")],
    "prp_symp": [e("p", TYPE, OWL + "SymmetricProperty"), e("x", "p", "y"), e("x", "p", '"lit')],
    "prp_inv1": [e("p", OWL + "inverseOf", "q"), e("x", "p", "y")],
    "prp_inv2": [e("p", OWL + "inverseOf", "q"), e("x", "q", "y")],
    "prp_fp": [e("p", TYPE, OWL + "FunctionalProperty"), e("x", "p", "y"), e("x", "p", "z")],
    "prp_ifp": [e("p", TYPE, OWL + "InverseFunctionalProperty"), e("x", "p", "y"), e("z", "p", "y")],
    "eq_ref": [e("x", "p", "y")],
    "eq_sym": [e("x", OWL + "sameAs", "y")],
    "eq_trans": [e("x", OWL + "sameAs", "y"), e("y", OWL + "sameAs", "z")],
    "eq_rep_s": [e("x", OWL + "sameAs", "y"), e("x", "p", '"v')],
    "eq_rep_p": [e("p", OWL + "sameAs", "q"), e("x", "p", "y")],
    "eq_rep_o": [e("y", OWL + "sameAs", "z"), e("x", "p", "y")],
    "cls_hv1": [e("c", OWL + "hasValue", "v"), e("c", OWL + "onProperty", "p"), e("x", TYPE, "c")],
    "cls_hv2": [e("c", OWL + "hasValue", "v"), e("c", OWL + "onProperty", "p"), e("x", "p", "v"), e("y", "p", "w")],
    "cls_svf1": [e("r", OWL + "someValuesFrom", "c"), e("r", OWL + "onProperty", "p"), e("x", "p", "y"), e("y", TYPE, "c"), e("x2", "p", "y2")],
    "cls_svf2": [e("r", OWL + "someValuesFrom", OWL + "Thing"), e("r", OWL + "onProperty", "p"), e("x", "p", "y")],
    "cls_avf": [e("r", OWL + "allValuesFrom", "c"), e("r", OWL + "onProperty", "p"), e("x", TYPE, "r"), e("x", "p", "y")],
}


def test_there_are_23_rules():
    assert len(RULES) == 23 and CASES.keys() == BY_NAME.keys()


def test_each_rule(spark):
    """Every rule alone, all in one graph each under its own names, so one run does."""
    for name, facts in CASES.items():
        want = closure(facts, [BY_NAME[name]])
        assert want, name
        if name in ("scm_sco", "prp_trp", "prp_fp", "eq_rep_o", "cls_svf1", "cls_avf", "prp_rng", "prp_symp", "cls_hv2"):
            assert found(fixpoint.materialize(frame(spark, facts), [BY_NAME[name]]).derived) == want, name


def test_all_rules_together(spark):
    facts = {f for name, fs in CASES.items() if name.startswith(("scm", "cax", "prp_d", "prp_r", "prp_s", "prp_t", "prp_i", "cls")) for f in fs}
    rules = [r for r in rules_of("owl2rl") if not r.name.startswith("eq_rep")]
    assert found(fixpoint.materialize(frame(spark, facts), rules).derived) == closure(facts, rules)


def random_facts(seed, n):
    rng = random.Random(seed)
    out = {e("in", TYPE, OWL + "TransitiveProperty"), e("in", DOM, "Place"), e("near", TYPE, OWL + "SymmetricProperty"), e("near", SPO, "in"), e("Place", SUB, "Thing")}
    while len(out) < n:
        out.add(e(f"x{rng.randint(0, 8)}", rng.choice(["in", "near", "has"]), f"x{rng.randint(0, 8)}"))
    return out


def test_adding_and_removing_is_like_from_scratch(spark):
    rules = rules_of("owl2rl")
    facts = sorted(random_facts(3, 16))
    first, more, gone = facts[:11], facts[11:], [facts[2], facts[12], facts[6]]
    derived = fixpoint.materialize(frame(spark, first), rules).derived
    added = fixpoint.add(frame(spark, first), derived, frame(spark, more), rules).derived
    every = derived.unionByName(added)
    assert found(every) - set(facts) == closure(facts, rules)
    left = fixpoint.remove(frame(spark, facts), every, frame(spark, gone), rules)
    rest = [f for f in facts if f not in gone]
    assert found(left) == closure(rest, rules)
    assert fixpoint.add(frame(spark, first), derived, frame(spark, first[:2]), rules).count == 0


def test_profiles():
    assert len(rules_of("rdfs")) == 6 and len(rules_of("owl2rl")) == 22 and len(rules_of("all")) == 23
    assert rules_of("none") == [] and [r.name for r in rules_of("custom", names=["eq_sym"])] == ["eq_sym"]
    assert "prp_trp" not in {r.name for r in rules_of("owl2rl", exclude=["prp_trp"])}
    assert {r.name for r in by_category("class")} == {"cls_hv1", "cls_hv2", "cls_svf1", "cls_svf2", "cls_avf"}
    for bad in (lambda: rules_of("x"), lambda: rules_of("rdfs", exclude=["x"]), lambda: rule("x", "?a ?b => ?a ?b ?c"), lambda: Rule("x", (("?a", "p", "?b"),), ("?a", "p", "?c"))):
        with pytest.raises(ReasoningError):
            bad()


def test_engine(spark):
    eng = Engine(spark)
    eng.load_string("@prefix : <http://e/> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . :x a :A . :A rdfs:subClassOf :B . :x :uncle :y .")
    own = rule("nephew", "?x <http://e/uncle> ?y => ?y <http://e/nephew> ?x", "iri ?y")
    report = eng.materialize(rules=[*rules_of("rdfs"), own])
    assert report["derived"] == 2 and eng.reasoning_status()["state"] == "materialized"
    q = "SELECT ?t { <http://e/x> a ?t }"
    assert eng.sparql(q).count() == 2 and eng.sparql(q, source="explicit").count() == 1 and eng.sparql(q, source="derived").count() == 1
    eng.update("INSERT DATA { <http://e/z> a <http://e/A> }")
    assert eng.reasoning_status()["needs_rematerialization"]


def test_engine_step_by_step(spark):
    eng = Engine(spark)
    sub = IRI(SUB)
    eng.load_string("@prefix : <http://e/> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . :x a :A . :A rdfs:subClassOf :B .")
    eng.materialize("rdfs")
    step = [(IRI(E + "B"), sub, IRI(E + "C"))]
    assert eng.add_with_reasoning(step, "rdfs", preview=True)["derived"] == 2
    assert eng.add_with_reasoning(step, "rdfs")["derived"] == 2
    q = "SELECT ?t { <http://e/x> a ?t }"
    assert eng.sparql(q).count() == 3
    assert eng.delete_with_reasoning([(IRI(E + "A"), sub, IRI(E + "B"))], "rdfs", preview=True) == {"kept": 0, "lost": 3}
    eng.delete_with_reasoning([(IRI(E + "A"), sub, IRI(E + "B"))], "rdfs")
    assert eng.sparql(q).count() == 1


def test_equality_by_classes(spark):
    """Classes give what the rules give pair by pair, and no join of pairs."""
    from ternion.reason import equality

    names = ("prp_ifp", "eq_sym", "eq_trans", "eq_rep_s")
    rules = rules_of("custom", names=names)
    same, kind = OWL + "sameAs", OWL + "InverseFunctionalProperty"
    facts = [e("key", TYPE, kind), e("key", same, "code"), *(e(f"x{i}", "key", f"k{i % 3}") for i in range(7)), e("y1", "code", "c"), e("y2", "code", "c"), e("y2", "key", "k1")]
    facts += [e("x0", "name", '"zero'), e("x3", "name", '"zero'), e("x1", "name", '"one'), e("x1", same, "x4"), e("z", same, "z"), e("z", "p", '"z'), e("u", same, '"lit'), e("u", same, "v")]
    facts = frame(spark, facts)
    found = equality.derived(fixpoint.saved(fixpoint.encoded(facts).distinct(), "facts"), rules)[0]
    assert equality.fits(rules) and not equality.fits(rules_of("owl2rl"))
    start = fixpoint.saved(fixpoint.encoded(facts).distinct(), "facts")
    want = sorted(map(tuple, fixpoint._closed(rules, start, start)[0].collect()))
    assert sorted(map(tuple, found.select("s", "p", "o").collect())) == want and want
    assert fixpoint.materialize(facts, rules).count == len(want)
    assert fixpoint.materialize(facts.limit(0), rules).count == 0


def test_same_as_makes_no_cubes(spark):
    """400 terms of one class: 64 million rows if pairs were joined to pairs."""
    rules = rules_of("custom", names=("prp_ifp", "eq_sym", "eq_trans", "eq_rep_s"))
    facts = frame(spark, [e("key", TYPE, OWL + "InverseFunctionalProperty"), *(e(f"x{i}", "key", "k") for i in range(400))])
    made = []
    before = fixpoint.derive
    fixpoint.derive = lambda *a, **k: made.append(1) or before(*a, **k)
    try:
        assert fixpoint.materialize(facts, rules).count == 400 * 400 and not made
    finally:
        fixpoint.derive = before


def test_removal_reads_the_schema_apart(spark, monkeypatch):
    """Deletion and re-derivation take schema patterns from a table of their own, over more rounds than are read apart."""
    seen = []
    before = fixpoint.derive
    monkeypatch.setattr(fixpoint, "derive", lambda rules, facts, delta, known, schema=None: seen.append(schema is not None) or before(rules, facts, delta, known, schema))
    rules = rules_of("custom", names=("prp_spo1", "prp_inv1", "scm_spo"))
    facts = [e(f"p{i}", SPO, f"p{i + 1}") for i in range(3)] + [e("x", "p0", "y"), e("x", "p1", "y"), e("q", SPO, "p1"), e("x", "q", "y"), e("p3", OWL + "inverseOf", "r")]
    gone = facts[:1]
    derived = fixpoint.materialize(frame(spark, facts), rules).derived
    seen.clear()
    left = found(fixpoint.remove(frame(spark, facts), derived, frame(spark, gone), rules))
    assert left == closure([f for f in facts if f not in gone], rules) and seen and all(seen)
