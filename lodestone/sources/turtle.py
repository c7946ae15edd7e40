"""Turtle and TriG text to triples, in the driver: for vocabularies and other small graphs."""

from __future__ import annotations

from ..model import IRI, RDF, XSD, Blank, Literal, Triple
from ..namespaces import Namespaces
from ..parser import Parser


class _Turtle(Parser):
    def __init__(self, text: str):
        super().__init__(text)
        self.out.prefixes = {}
        self.triples: list[Triple] = []

    def directive(self) -> bool:
        dotted = self.kind == "lang" and self.value in ("@prefix", "@base")
        if not dotted and not (self.says("PREFIX", "BASE") and self.peek()[0] in ("pname", "iri")):
            return False
        what = self.next().lstrip("@").upper()
        if what == "PREFIX":
            if self.kind != "pname" or not self.value.endswith(":"):
                raise self.error("expected a prefix such as ex:")
            prefix = self.next()[:-1]
            self.out.prefixes[prefix] = self.iri_text(self.next())
        else:
            self.out.base = self.iri_text(self.next())
        if dotted:
            self.expect(".")
        return True

    def read(self, named_graphs: bool = False) -> list[Triple]:
        while self.kind != "end":
            if self.directive():
                continue
            if named_graphs and self.says("GRAPH"):
                self.next()
            if named_graphs and (self.sees("{") or self.peek()[1] == "{" or self.peek()[1] == "]" and self.peek(2)[1] == "{"):
                if not self.sees("{"):
                    self.node([], False)
                self.triples += self.triples_block(False)
                continue
            self.subject_triples(self.triples, False)
            self.expect(".")
        return self.triples


def parse_turtle(text: str, named_graphs: bool = False) -> list[Triple]:
    """Triples of a Turtle document (TriG with ``named_graphs``: all graphs' triples together)."""
    return _Turtle(text).read(named_graphs)


def parse_xml(text: str) -> list[Triple]:
    """RDF/XML: node and property elements, typed nodes, resource and datatype attributes, nesting, parseType Resource
    and Collection."""
    import xml.etree.ElementTree as ET
    from urllib.parse import urljoin

    root, out, blanks = ET.fromstring(text), [], iter(range(1, 1 << 60))
    lang_key, base_key = "{http://www.w3.org/XML/1998/namespace}lang", "{http://www.w3.org/XML/1998/namespace}base"
    a = lambda name: f"{{{RDF}}}{name}"
    full = lambda tag: tag[1:].replace("}", "", 1)

    def subject(el, base):
        if (x := el.get(a("about"))) is not None:
            return IRI(urljoin(base, x) if base else x)
        if (x := el.get(a("ID"))) is not None:
            return IRI(f"{base}#{x}")
        return Blank(el.get(a("nodeID")) or f"x{next(blanks)}")

    def node(el, base, lang):
        base, lang = el.get(base_key, base), el.get(lang_key, lang)
        s = subject(el, base)
        if el.tag != a("Description"):
            out.append(Triple(s, IRI(RDF + "type"), IRI(full(el.tag))))
        for k, v in el.attrib.items():
            if not k.startswith(f"{{{RDF}}}") and k.startswith("{") and k not in (lang_key, base_key):
                out.append(Triple(s, IRI(full(k)), Literal(v, "", lang)))
            elif k == a("type"):
                out.append(Triple(s, IRI(RDF + "type"), IRI(v)))
        properties(s, el, base, lang)
        return s

    def properties(s, el, base, lang):
        item = 0
        for p in el:
            name = full(p.tag)
            if name == RDF + "li":
                item += 1
                name = f"{RDF}_{item}"
            own_lang, kind = p.get(lang_key, lang), p.get(a("parseType"))
            if (x := p.get(a("resource"))) is not None:
                o = IRI(urljoin(base, x) if base else x)
            elif (x := p.get(a("nodeID"))) is not None:
                o = Blank(x)
            elif kind == "Resource":
                o = Blank(f"x{next(blanks)}")
                properties(o, p, base, own_lang)
            elif kind == "Collection":
                items = [node(c, base, own_lang) for c in p]
                cells = [Blank(f"x{next(blanks)}") for _ in items]
                for k, (cell, one) in enumerate(zip(cells, items)):
                    out.append(Triple(cell, IRI(RDF + "first"), one))
                    out.append(Triple(cell, IRI(RDF + "rest"), cells[k + 1] if k + 1 < len(cells) else IRI(RDF + "nil")))
                o = cells[0] if cells else IRI(RDF + "nil")
            elif len(p):
                o = node(p[0], base, own_lang)
            else:
                dt = p.get(a("datatype"), "")
                o = Literal(p.text or "", dt, "" if dt else own_lang)
            out.append(Triple(s, IRI(name), o))

    base = root.get(base_key, "")
    for el in root if root.tag == a("RDF") else [root]:
        node(el, base, root.get(lang_key, ""))
    return out


def parse_json_ld(text: str) -> list[Triple]:
    """JSON-LD with inline contexts: prefixes, terms, @vocab, @id, @type, @value, @language, @list, @graph, nesting."""
    import json

    out, blanks = [], iter(range(1, 1 << 60))

    def iri(name: str, ctx: dict) -> str:
        own = ctx.get(name)
        if isinstance(own, dict):
            own = own.get("@id")
        if own:
            return iri(own, {k: v for k, v in ctx.items() if k != name}) if ":" in own and "//" not in own else own
        prefix, colon, local = name.partition(":")
        if colon and not local.startswith("//") and isinstance(ctx.get(prefix), str):
            return ctx[prefix] + local
        return name if colon else ctx.get("@vocab", "") + name

    def value(x, ctx, rule=None):
        if isinstance(x, dict):
            if "@value" in x:
                inner = x["@value"]
                if "@type" in x:
                    return Literal(str(inner), iri(x["@type"], ctx))
                return Literal(inner, "", x.get("@language", "").lower()) if isinstance(inner, str) else value(inner, ctx)
            if "@list" in x:
                cells = [Blank(f"j{next(blanks)}") for _ in x["@list"]]
                for k, (cell, one) in enumerate(zip(cells, x["@list"])):
                    out.append(Triple(cell, IRI(RDF + "first"), value(one, ctx)))
                    out.append(Triple(cell, IRI(RDF + "rest"), cells[k + 1] if k + 1 < len(cells) else IRI(RDF + "nil")))
                return cells[0] if cells else IRI(RDF + "nil")
            return node(x, ctx)
        if isinstance(x, bool):
            return Literal(str(x).lower(), XSD + "boolean")
        if isinstance(x, int):
            return Literal(str(x), XSD + "integer")
        if isinstance(x, float):
            return Literal(str(x), XSD + "double")
        kind = rule.get("@type") if isinstance(rule, dict) else None
        if kind == "@id":
            return reference(x, ctx)
        return Literal(x, iri(kind, ctx)) if kind else Literal(x, "", ctx.get("@language", "") or "")

    def reference(x, ctx):
        return Blank(x[2:]) if x.startswith("_:") else IRI(iri(x, ctx) if ":" in x else ctx.get("@base", "") + x)

    def node(x, ctx):
        ctx = {**ctx, **(x.get("@context") or {})} if isinstance(x.get("@context"), dict) else ctx
        s = reference(x["@id"], ctx) if "@id" in x else Blank(f"j{next(blanks)}")
        for k, v in x.items():
            each = v if isinstance(v, list) else [v]
            if k == "@type":
                out.extend(Triple(s, IRI(RDF + "type"), IRI(iri(t, ctx))) for t in each)
            elif k == "@graph":
                for one in each:
                    node(one, ctx)
            elif not k.startswith("@"):
                for one in each:
                    out.append(Triple(s, IRI(iri(k, ctx)), value(one, ctx, ctx.get(k))))
        return s

    for top in (lambda d: d if isinstance(d, list) else [d])(json.loads(text)):
        node(top, {})
    return out


def write_turtle(rows, namespaces: Namespaces | None = None) -> str:
    """Turtle of (s, p, o) rows of general terms, grouped by subject; for graphs that the driver can hold."""
    ns = namespaces or Namespaces()
    used: set[str] = set()

    def text(t) -> str:
        if t.k == 1:
            short = ns.abbreviate(t.v)
            local = short.partition(":")[2]
            if short.startswith("<") or not local.replace("_", "").replace("-", "").isalnum():
                return f"<{t.v}>"
            used.add(short.partition(":")[0])
            return short
        if t.k == 2:
            return f"_:{t.v}"
        if t.k == 4:
            return f"<<( {t.v} )>>"
        body = '"' + t.v.translate({0x22: '\\"', 0x5C: "\\\\", 0x0A: "\\n", 0x0D: "\\r"}) + '"'
        if t.lang:
            return f"{body}@{t.lang}"
        if not t.dt:
            return body
        short = ns.abbreviate(t.dt)
        if not short.startswith("<"):
            used.add(short.partition(":")[0])
        return f"{body}^^{short}"

    by: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r.s.v, r.p.v, r.o.v, r.o.dt, r.o.lang)):
        by.setdefault(text(r.s), []).append(f"{text(r.p)} {text(r.o)}")
    lines = [f"{s} " + " ;\n    ".join(ps) + " ." for s, ps in by.items()]
    head = [f"@prefix {p}: <{iri}> ." for p, iri in sorted(ns.items()) if p in used]
    return "\n".join([*head, "", *lines, ""])


