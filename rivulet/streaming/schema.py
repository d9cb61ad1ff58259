"""Types of events and contexts with their parents, and what an event of a type needs."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Hierarchy:
    """Types by name: {"parents": [...], "requires": [...]}."""

    types: dict[str, dict] = field(default_factory=dict)

    def __post_init__(self):
        for name, own in self.types.items():
            missing = [p for p in own.get("parents", []) if p not in self.types]
            if missing:
                raise ValueError(f"parents of {name} aren't known: {missing}")
        for name in self.types:
            self.above(name)

    def names(self) -> list[str]:
        return sorted(self.types)

    def above(self, name: str, below: tuple[str, ...] = ()) -> set[str]:
        """The type and all that it inherits from."""
        if name in below:
            raise ValueError(f"{name} inherits from itself")
        out = {name}
        for parent in self.types[name].get("parents", []):
            out |= self.above(parent, (*below, name))
        return out

    def under(self, name: str) -> set[str]:
        """The type and all that inherit from it."""
        return {k for k in self.types if name in self.above(k)}

    def required(self, name: str) -> set[str]:
        return {r for t in self.above(name) for r in self.types[t].get("requires", [])}

    def extended(self, more: dict[str, dict]) -> Hierarchy:
        """With new types, and more parents and needs of known ones."""
        types = {k: {x: list(y) for x, y in v.items()} for k, v in self.types.items()}
        for name, own in more.items():
            mine = types.setdefault(name, {})
            for key, values in own.items():
                mine[key] = [*mine.get(key, []), *[v for v in values if v not in mine.get(key, [])]]
        return Hierarchy(types)

    def table(self) -> Column:
        """A map from each type to the sorted types that it inherits from, itself among them."""
        return F.create_map(*[x for k in self.names() for x in (F.lit(k), F.array(*[F.lit(a) for a in sorted(self.above(k))]))])


@dataclass(frozen=True)
class EventSchema:
    events: Hierarchy = field(default_factory=Hierarchy)
    contexts: Hierarchy = field(default_factory=Hierarchy)

    def __post_init__(self):
        missing = {r for e in self.events.types for r in self.events.required(e)} - set(self.contexts.types)
        if missing:
            raise ValueError(f"events need contexts that aren't known: {sorted(missing)}")

    def extended(self, events: dict[str, dict] | None = None, contexts: dict[str, dict] | None = None) -> EventSchema:
        return EventSchema(self.events.extended(events or {}), self.contexts.extended(contexts or {}))

    def required(self) -> dict[str, list[str]]:
        """Contexts that each type of event needs, also through what it inherits from."""
        return {e: sorted(self.events.required(e)) for e in self.events.names()}

    def event_types(self, kind: Column) -> Column:
        """All types of an event, sorted; null for unknown ones."""
        return F.try_element_at(self.events.table(), kind)

    def hydrated(self, contexts: Column) -> Column:
        """JSON contexts with _types: all types of each; null for unknown ones."""
        maps = F.from_json(contexts, "array<map<string,string>>")
        table = self.contexts.table()
        return F.to_json(F.transform(maps, lambda c: F.map_concat(F.map_filter(c, lambda k, v: k != "_types"), F.create_map(F.lit("_types"), F.to_json(F.try_element_at(table, c["_type"]))))))

    def known_contexts(self, contexts: Column) -> Column:
        """Whether all contexts are of known types."""
        kinds = F.transform(F.from_json(contexts, "array<map<string,string>>"), lambda c: c["_type"])
        return F.size(F.array_except(kinds, F.array(*[F.lit(k) for k in self.contexts.names()]).cast("array<string>"))) <= 0
