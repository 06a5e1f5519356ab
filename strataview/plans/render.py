"""Type declarations, labels and DDL of a spec (driver side, over its node table)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from strataview.functions.hierarchy import ancestors, kind, path_above

#: Nodes that may be brought to the driver for rendering.
MAX_NODES = 200_000


@dataclass
class Type:
    """A node of a position's type tree, with the positions it holds if it is generic."""

    path: str
    name: str
    n: int = 0
    subtypes: list[Type] = field(default_factory=list)
    parameters: list[tuple[str, Type]] = field(default_factory=list)
    #: Lists of field names that records of this name and size have, where there are several.
    variants: list[list[str]] = field(default_factory=list)


def collect_nodes(nodes: DataFrame) -> list[tuple[str, str, int]]:
    rows = nodes.select("path", "class", "n").limit(MAX_NODES + 1).collect()
    if len(rows) > MAX_NODES:
        raise ValueError(f"more than {MAX_NODES} nodes; narrow the spec by path first")
    return sorted((r["path"], r["class"], r["n"]) for r in rows)


def build(rows: list[tuple[str, str, int]], path: str = "$", fields: list[str] = (), records: list[tuple[str, str, list[str]]] = ()) -> Type:
    """The type tree at ``path``; ``fields``: paths of record fields in their order; ``records``: (path, class, names) of known records.

    A record of a known class holds its own fields only; where a position has records of several classes, each has those of its schemas.
    """
    order = {p: k for k, p in enumerate(fields)}
    known: dict[tuple[str, str], list[list[str]]] = {}
    for p, name, names in records:
        known.setdefault((p, name), []).append(list(names))
    positions: dict[str, list[tuple[str, int]]] = {}
    for p, name, n in rows:
        positions.setdefault(p, []).append((name, n))
    inside: dict[str, list[str]] = {}
    for p in positions:
        if (above := path_above(p)) is not None:
            inside.setdefault(above, []).append(p)

    def position(p: str) -> Type:
        made = {name: Type(p, name, n) for name, n in positions.get(p, [])}
        tops = []
        for name, node in made.items():
            above = next((made[a] for a in ancestors(name) if a in made), None)
            (above.subtypes if above else tops).append(node)
            lists = known.get((p, name), [])
            node.variants = lists if len(lists) > 1 else []
            own = {f"{p}.{x}" for names in lists for x in names}
            if kind(name) == "generic":
                for q in sorted(inside.get(p, []), key=lambda q: (order.get(q, len(order)), q)):
                    if q[len(p) :] in {"nonempty_list": ("[]",), "improper_list": ("[]", "[|]")}.get(name, (q[len(p) :],) if q[len(p)] == "." else ()):
                        if not own or q in own:
                            node.parameters.append((q[len(p) :].lstrip("."), position(q)))
        for node in made.values():
            node.subtypes.sort(key=lambda t: (-t.n, t.name))
        tops.sort(key=lambda t: (-t.n, t.name))
        if len(tops) == 1:
            return tops[0]
        return Type(p, "term", sum(t.n for t in tops), tops)

    return position(path)


#: Names that are written in a way of their own (fixed values).
LITERALS = {"0": "0", "<<>>": "<<>>", "{}": "{}", "[]": "[]", "map": "map()", "term": "term()"}


def form_record(t: Type, given: list[tuple[str, Type]]) -> str:
    """A record with its fields and their types."""
    fields_ = [f"{k or f'field{i + 2}'} :: {' | '.join(form(p))}" for i, (k, p) in enumerate(given)]
    if not fields_:
        fields_ = [f"field{i} :: term()" for i in range(2, int(t.name.rpartition("/")[2]) + 1)]
    return t.name.rpartition("/")[0] + "{" + ", ".join(fields_) + "}"


def form(t: Type) -> list[str]:
    """Alternatives of a type, nested unions flattened."""
    if kind(t.name) == "union":
        return [x for s in t.subtypes for x in form(s)] or ["term()"]
    if t.name in LITERALS:
        return [LITERALS[t.name]]
    if t.name == "nonempty_list":
        return ["[" + " | ".join(x for _, p in t.parameters for x in form(p)) + "]"]
    if t.name == "improper_list":
        return ["improper_list(" + ", ".join(" | ".join(form(p)) for _, p in t.parameters) + ")"]
    if t.name.startswith("tuple/"):
        return ["{" + ", ".join(" | ".join(form(p)) for _, p in t.parameters) + "}"]
    if t.name.startswith("#"):
        given = t.parameters or []
        if t.variants:
            types = dict(given)
            return [form_record(t, [(x, types[x]) for x in names if x in types]) for names in t.variants]
        return [form_record(t, given)]
    if t.name.startswith("fun/"):
        return ["fun()"]
    return [f"{t.name}()"]


def declaration(t: Type) -> str:
    """Type declaration, one alternative a line."""
    return " |\n".join(form(t)) + "\n"


def attribute_label(record: str | None, number: int, name: str) -> str:
    """``E2 #rec.field`` for records, ``E2`` for tuples, else the name."""
    if record and record.startswith("#"):
        return f"E{number} {record.rpartition('/')[0]}.{name}" if name else f"E{number}"
    if record and record.startswith("tuple/"):
        return f"E{number}"
    return name


#: Narrowest Spark type that holds a class (fixed values).
DDL = {"boolean": "BOOLEAN", "float": "DOUBLE", "decimal": "DECIMAL(38,18)", "timestamp": "TIMESTAMP", "date": "DATE", "0": "SMALLINT", "byte": "SMALLINT", "char": "INT", "non_neg_integer": "BIGINT", "neg_integer": "BIGINT", "integer": "BIGINT", "atom": "STRING", "binary": "STRING", "<<>>": "STRING", "bitstring": "STRING"}
_WIDTH = ["SMALLINT", "INT", "BIGINT", "DECIMAL(38,18)", "DOUBLE"]


def ddl(t: Type) -> str:
    """A Spark type that can hold every value of the position; VARIANT if nothing narrower can."""
    leaves = [x for x in _leaves(t) if x.name != "null"]
    if not leaves:
        return "VOID"
    if all(x.name.startswith("#") for x in leaves) and len(leaves) == 1:
        return "STRUCT<" + ", ".join(f"{k}: {ddl(p)}" for k, p in leaves[0].parameters) + ">"
    if all(x.name in ("nonempty_list", "[]") for x in leaves):
        item = next((p for x in leaves for _, p in x.parameters), None)
        return f"ARRAY<{ddl(item) if item else 'VOID'}>"
    if all(x.name == "map" for x in leaves):
        kinds = {ddl(p) for _, p in leaves[0].parameters}
        return f"MAP<STRING, {kinds.pop() if len(kinds) == 1 else 'VARIANT'}>"
    names = {DDL.get(x.name, "VARIANT") for x in leaves}
    if len(names) == 1:
        return names.pop()
    return max(names, key=_WIDTH.index) if names <= set(_WIDTH) else "VARIANT"


def _leaves(t: Type) -> list[Type]:
    below = [x for s in t.subtypes for x in _leaves(s)]
    return below if kind(t.name) == "union" else [t, *below] if t.n or not below else below
