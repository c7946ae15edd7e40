"""What a rule program is made of. Everything here is plain, hashable and known before any data is read."""

from __future__ import annotations

from dataclasses import dataclass, field

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
XSD = "http://www.w3.org/2001/XMLSchema#"
RDF_TYPE = RDF + "type"
LANG_STRING = RDF + "langString"


@dataclass(frozen=True)
class IRI:
    value: str


@dataclass(frozen=True)
class Literal:
    value: str
    datatype: str = ""
    language: str = ""


@dataclass(frozen=True)
class Blank:
    label: str


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class TripleTerm:
    subject: object
    predicate: object
    object: object


# property paths; a plain IRI is one as well
@dataclass(frozen=True)
class Inverse:
    path: object


@dataclass(frozen=True)
class Sequence:
    parts: tuple


@dataclass(frozen=True)
class Alternative:
    parts: tuple


@dataclass(frozen=True)
class Repeat:
    """``+`` (least 1), ``*`` (least 0) or, with ``once``, ``?``."""

    path: object
    least: int
    once: bool = False


@dataclass(frozen=True)
class Negated:
    """Any predicate but these; ``inverse``: any backwards but those."""

    forward: tuple
    backward: tuple = ()


@dataclass(frozen=True)
class Triple:
    subject: object
    predicate: object
    object: object


# expressions; variables and terms are ones as well
@dataclass(frozen=True)
class Op:
    name: str
    args: tuple


@dataclass(frozen=True)
class Call:
    """A built-in (upper-case name) or, with an IRI, a custom function."""

    name: object
    args: tuple


@dataclass(frozen=True)
class Exists:
    elements: tuple
    negated: bool = False


# body elements; a Triple is one as well
@dataclass(frozen=True)
class Filter:
    expression: object


@dataclass(frozen=True)
class Bind:
    expression: object
    variable: Var


@dataclass(frozen=True)
class Not:
    elements: tuple


@dataclass(frozen=True)
class Rule:
    head: tuple
    body: tuple
    source: str = "rule"


@dataclass(frozen=True)
class Declaration:
    kind: str  # transitive, symmetric, inverse, reflexive
    iris: tuple


@dataclass
class RuleSet:
    rules: list = field(default_factory=list)
    data: list = field(default_factory=list)
    declarations: list = field(default_factory=list)
    prefixes: dict = field(default_factory=dict)
    base: str = ""
    version: str = ""
    imports: list = field(default_factory=list)


class WellFormednessError(ValueError):
    """A rule breaks a condition on its variables."""


def path_predicates(path) -> set:
    """IRIs a path reads; None stands for any."""
    match path:
        case IRI(value):
            return {value}
        case Inverse(p) | Repeat(p, 1):
            return path_predicates(p)
        case Repeat(p, _, _):
            return path_predicates(p) | {None}
        case Sequence(parts) | Alternative(parts):
            return set().union(*map(path_predicates, parts))
        case _:
            return {None}


def variables(x) -> set[str]:
    """Names of all variables in a term, triple, expression or element, nested groups included."""
    match x:
        case Var(name):
            return {name}
        case Triple() | TripleTerm():
            return variables(x.subject) | variables(x.predicate) | variables(x.object)
        case Op(_, args) | Call(_, args):
            return set().union(set(), *map(variables, args))
        case Exists(elements, _) | Not(elements):
            return set().union(set(), *map(variables, elements))
        case Filter(expression):
            return variables(expression)
        case Bind(expression, v):
            return variables(expression) | {v.name}
        case _:
            return set()


def check_rule(rule: Rule) -> None:
    """Raises WellFormednessError unless every variable is bound before it is used, none is assigned twice, head
    variables come from the body and heads are triples that a graph can hold."""
    bound: set[str] = set()

    def expression(e, known: set[str], what: str) -> None:
        match e:
            case Var(name):
                if name not in known:
                    raise WellFormednessError(f"{what} uses ?{name} before it is bound")
            case Call("BOUND" | "COALESCE", _):
                pass
            case Op(_, args) | Call(_, args):
                for a in args:
                    expression(a, known, what)
            case Exists(elements, _):
                group(elements, set(known))

    def group(elements, known: set[str]) -> None:
        for el in elements:
            match el:
                case Triple():
                    known |= variables(el)
                case Filter(e):
                    expression(e, known, "FILTER")
                case Bind(e, v):
                    expression(e, known, "BIND")
                    if v.name in known:
                        raise WellFormednessError(f"BIND assigns ?{v.name}, which is bound already")
                    known.add(v.name)
                case Not(inner):
                    group(inner, set(known))

    group(rule.body, bound)
    for t in rule.head:
        if missing := sorted(variables(t) - bound):
            raise WellFormednessError(f"head variable ?{missing[0]} is not bound in the body")
        if isinstance(t.subject, Literal):
            raise WellFormednessError("a head's subject is a literal")
        if not isinstance(t.predicate, (IRI, Var)):
            raise WellFormednessError("a head's predicate is neither an IRI nor a variable")
