"""Random safe programs over random graphs against a naive evaluator."""

import random

import pytest

from lodestone.engine import RuleEngine
from lodestone.graph import Graph
from lodestone.model import IRI, Not, Rule, RuleSet, Triple, Var
from lodestone.plans.stratify import StratificationError, strata

PREDICATES = ["p", "q", "r", "s"]


def term(x):
    return IRI("http://t/" + x)


def program(rng):
    """Two to four rules with joins, sometimes a negation."""
    rules = []
    for _ in range(rng.randint(2, 4)):
        names = ["x", "y", "z"]
        body = []
        for k in range(rng.randint(1, 3)):
            a, b = rng.sample(names[: k + 2], 2)
            body.append(Triple(Var(a), term(rng.choice(PREDICATES)), Var(b) if rng.random() < 0.85 else term(rng.choice("abc"))))
        bound = sorted({v.name for t in body for v in (t.subject, t.object) if isinstance(v, Var)})
        if rng.random() < 0.4:
            body.append(Not((Triple(Var(rng.choice(bound)), term(rng.choice(PREDICATES)), Var(rng.choice([*bound, "w"]))),)))
        rules.append(Rule((Triple(Var(rng.choice(bound)), term(rng.choice(PREDICATES)), Var(rng.choice(bound))),), tuple(body)))
    return rules


def naive(rules, facts):
    def matches(elements, env, known):
        if not elements:
            yield env
            return
        el, rest = elements[0], elements[1:]
        if isinstance(el, Not):
            if not any(True for _ in matches(list(el.elements), env, known)):
                yield from matches(rest, env, known)
            return
        for s, p, o in known:
            if p != el.predicate.value:
                continue
            new = dict(env)
            if all((new.setdefault(v.name, x) == x) if isinstance(v, Var) else v.value == x for v, x in ((el.subject, s), (el.object, o))):
                yield from matches(rest, new, known)

    known = set(facts)
    for own in strata(rules):
        while True:
            new = {(env[r.head[0].subject.name], r.head[0].predicate.value, env[r.head[0].object.name]) for r in (rules[i] for i in own) for env in matches(list(r.body), {}, known)} - known
            if not new:
                break
            known |= new
    return known


def own_negation(rules):
    from lodestone.plans.stratify import heads, reads

    return any(heads(r) & reads(r.body)[1] for r in rules)


@pytest.mark.parametrize("seed", range(12))
def test_random_program(spark, seed):
    rng = random.Random(seed)
    while True:
        rules = program(rng)
        try:
            strata(rules)
        except StratificationError:
            continue
        if not own_negation(rules):
            break
    facts = {tuple("http://t/" + x for x in (rng.choice("abcde"), rng.choice(PREDICATES), rng.choice("abcde"))) for _ in range(9)}
    g = Graph(spark).add_triples([Triple(*map(IRI, f)) for f in facts])
    got = {(r.s.v, r.p.v, r.o.v) for r in RuleEngine(RuleSet(rules=rules)).evaluate(g, inplace=False).triples().collect()}
    assert got == naive(rules, facts)
