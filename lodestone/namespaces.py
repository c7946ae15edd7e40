"""Prefixes."""

from __future__ import annotations

#: Prefixes known without a declaration (fixed values).
KNOWN = {
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#",
    "rdfs": "http://www.w3.org/2000/01/rdf-schema#",
    "xsd": "http://www.w3.org/2001/XMLSchema#",
    "sh": "http://www.w3.org/ns/shacl#",
    "owl": "http://www.w3.org/2002/07/owl#",
    "dc": "http://purl.org/dc/elements/1.1/",
    "dcterms": "http://purl.org/dc/terms/",
    "foaf": "http://xmlns.com/foaf/0.1/",
    "skos": "http://www.w3.org/2004/02/skos/core#",
}


class Namespaces:
    """Prefix table: register, expand ``p:local``, abbreviate an IRI."""

    def __init__(self, known: dict[str, str] | None = None):
        self._by_prefix = dict(KNOWN if known is None else known)

    def register(self, prefix: str, iri: str) -> None:
        self._by_prefix[prefix] = iri

    def get(self, prefix: str) -> str | None:
        return self._by_prefix.get(prefix)

    def expand(self, name: str) -> str:
        prefix, colon, local = name.partition(":")
        if not colon or prefix not in self._by_prefix:
            raise KeyError(f"unknown prefix in {name!r}")
        return self._by_prefix[prefix] + local

    def abbreviate(self, iri: str) -> str:
        fits = [(ns, p) for p, ns in self._by_prefix.items() if ns and iri.startswith(ns)]
        if not fits:
            return f"<{iri}>"
        ns, p = max(fits, key=lambda x: len(x[0]))
        return f"{p}:{iri[len(ns):]}"

    def items(self):
        return self._by_prefix.items()
