"""Rules as data: patterns that hold together imply another, as in RDFS and OWL 2 RL."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from ternion.errors import ReasoningError
from ternion.terms import OWL, RDF, RDFS, TYPE

_PREFIXES = {"rdf": RDF, "rdfs": RDFS, "owl": OWL}

#: A variable is a string with a question mark, anything else an IRI.
Pattern = tuple[str, str, str]
#: Tests on variables that rules may have.
TESTS = ("different", "iri", "blank", "literal")


@dataclass(frozen=True)
class Rule:
    name: str
    body: tuple[Pattern, ...]
    head: Pattern
    tests: tuple[tuple[str, ...], ...] = ()
    category: str = ""

    def __post_init__(self) -> None:
        known = {x for p in self.body for x in p if x[0] == "?"}
        free = {x for x in self.head if x[0] == "?"} - known
        if free:
            raise ReasoningError(f"rule {self.name}: {sorted(free)[0]} is not in the body")
        if any(test[0] not in TESTS for test in self.tests):
            raise ReasoningError(f"rule {self.name}: unknown test")


def rule(name: str, text: str, *tests: str, category: str = "") -> Rule:
    """A rule written as ``?x rdf:type ?c ; … => ?x rdf:type ?d``; tests like ``different ?x ?y``."""
    body, _, head = text.partition("=>")

    def term(x: str) -> str:
        if x[0] == "?":
            return x
        if x == "a":
            return TYPE
        if x[0] == "<":
            return x[1:-1]
        prefix, _, local = x.partition(":")
        return _PREFIXES[prefix] + local

    patterns = [tuple(term(x) for x in part.split()) for part in re.split(r"\s;\s", body.strip())]
    if any(len(p) != 3 for p in patterns) or len(head.split()) != 3:
        raise ReasoningError(f"rule {name}: a pattern has three terms")
    return Rule(name, tuple(patterns), tuple(term(x) for x in head.split()), tuple(tuple(x.split()) for x in tests), category)


#: The rules of RDFS and of OWL 2 RL (W3C, OWL 2 Web Ontology Language Profiles, section 4.3)
#: that are supported, under their names there.
RULES = [
    rule("scm_sco", "?a rdfs:subClassOf ?b ; ?b rdfs:subClassOf ?c => ?a rdfs:subClassOf ?c", category="rdfs"),
    rule("scm_spo", "?a rdfs:subPropertyOf ?b ; ?b rdfs:subPropertyOf ?c => ?a rdfs:subPropertyOf ?c", category="rdfs"),
    rule("cax_sco", "?c rdfs:subClassOf ?d ; ?x a ?c => ?x a ?d", category="rdfs"),
    rule("prp_spo1", "?p rdfs:subPropertyOf ?q ; ?x ?p ?y => ?x ?q ?y", category="rdfs"),
    rule("prp_dom", "?p rdfs:domain ?c ; ?x ?p ?y => ?x a ?c", category="rdfs"),
    rule("prp_rng", "?p rdfs:range ?c ; ?x ?p ?y => ?y a ?c", category="rdfs"),
    rule("prp_trp", "?p a owl:TransitiveProperty ; ?x ?p ?y ; ?y ?p ?z => ?x ?p ?z", category="property"),
    rule("prp_symp", "?p a owl:SymmetricProperty ; ?x ?p ?y => ?y ?p ?x", category="property"),
    rule("prp_inv1", "?p owl:inverseOf ?q ; ?x ?p ?y => ?y ?q ?x", category="property"),
    rule("prp_inv2", "?p owl:inverseOf ?q ; ?x ?q ?y => ?y ?p ?x", category="property"),
    rule("prp_fp", "?p a owl:FunctionalProperty ; ?x ?p ?y ; ?x ?p ?z => ?y owl:sameAs ?z", "different ?y ?z", category="property"),
    rule("prp_ifp", "?p a owl:InverseFunctionalProperty ; ?x ?p ?y ; ?z ?p ?y => ?x owl:sameAs ?z", "different ?x ?z", category="property"),
    rule("eq_ref", "?x ?p ?y => ?x owl:sameAs ?x", category="equality"),
    rule("eq_sym", "?x owl:sameAs ?y => ?y owl:sameAs ?x", category="equality"),
    rule("eq_trans", "?x owl:sameAs ?y ; ?y owl:sameAs ?z => ?x owl:sameAs ?z", category="equality"),
    rule("eq_rep_s", "?x owl:sameAs ?y ; ?x ?p ?o => ?y ?p ?o", category="equality"),
    rule("eq_rep_p", "?p owl:sameAs ?q ; ?x ?p ?o => ?x ?q ?o", category="equality"),
    rule("eq_rep_o", "?o owl:sameAs ?y ; ?x ?p ?o => ?x ?p ?y", category="equality"),
    rule("cls_hv1", "?c owl:hasValue ?v ; ?c owl:onProperty ?p ; ?x a ?c => ?x ?p ?v", category="class"),
    rule("cls_hv2", "?c owl:hasValue ?v ; ?c owl:onProperty ?p ; ?x ?p ?v => ?x a ?c", category="class"),
    rule("cls_svf1", "?r owl:someValuesFrom ?c ; ?r owl:onProperty ?p ; ?x ?p ?y ; ?y a ?c => ?x a ?r", category="class"),
    rule("cls_svf2", "?r owl:someValuesFrom owl:Thing ; ?r owl:onProperty ?p ; ?x ?p ?y => ?x a ?r", category="class"),
    rule("cls_avf", "?r owl:allValuesFrom ?c ; ?r owl:onProperty ?p ; ?x a ?r ; ?x ?p ?y => ?y a ?c", category="class"),
]
BY_NAME = {r.name: r for r in RULES}


def rules_of(profile: str = "owl2rl", exclude: Iterable[str] = (), names: Iterable[str] = ()) -> list[Rule]:
    """The rules of a profile: none, rdfs, owl2rl (all but eq_ref, which only adds x = x), all, or custom with names."""
    gone = set(exclude)
    if unknown := (gone | set(names)) - BY_NAME.keys():
        raise ReasoningError(f"unknown rule {sorted(unknown)[0]}")
    if profile == "none":
        return []
    if profile == "custom":
        return [BY_NAME[n] for n in names if n not in gone]
    if profile == "rdfs":
        return [r for r in RULES if r.category == "rdfs" and r.name not in gone]
    if profile in ("owl2rl", "all"):
        return [r for r in RULES if r.name not in gone and (profile == "all" or r.name != "eq_ref")]
    raise ReasoningError(f"unknown profile {profile}")


def by_category(category: str) -> list[Rule]:
    return [r for r in RULES if r.category == category]
