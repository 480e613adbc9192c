"""Components by category and identifier, with the JSON schemas of their parameters."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pydantic import BaseModel


class Registry:
    def __init__(self) -> None:
        self._types: dict[str, dict[str, type]] = {}

    def add(self, category: str, identifier: str) -> Callable[[type], type]:
        """Class decorator; a later class of the same name replaces the earlier one."""

        def put(cls: type) -> type:
            self._types.setdefault(category, {})[identifier] = cls
            return cls

        return put

    def has(self, category: str, identifier: str) -> bool:
        return identifier in self._types.get(category, {})

    def categories(self) -> list[str]:
        return list(self._types)

    def components(self, category: str) -> list[str]:
        if category not in self._types:
            raise ValueError(f"no category {category!r}; there are {', '.join(self._types)}")
        return list(self._types[category])

    def get(self, category: str, identifier: str) -> type:
        if identifier not in self.components(category):
            raise ValueError(f"no {identifier!r} in {category}; there are {', '.join(self._types[category])}")
        return self._types[category][identifier]

    def get_schema(self, category: str, identifier: str) -> dict[str, Any]:
        cls = self.get(category, identifier)
        if not issubclass(cls, BaseModel):
            raise ValueError(f"{category}/{identifier} has no parameter schema")
        return cls.model_json_schema() | {"$id": f"corpusflow://{category}/{identifier}", "title": f"{category} {identifier}"}

    def get_all_schemas(self, category: str | None = None) -> dict[str, Any]:
        every = {c: {i: self.get_schema(c, i) for i, k in own.items() if issubclass(k, BaseModel)} for c, own in self._types.items() if category in (None, c)}
        return every.get(category, {}) if category else every

    def export_schemas(self, path: str, category: str | None = None) -> None:
        with open(path, "w") as f:
            json.dump(self.get_all_schemas(category), f, indent=2)

    def validate_config(self, category: str, identifier: str, params: dict[str, Any]) -> dict[str, Any]:
        """The parameters with defaults filled in; no side effect."""
        cls = self.get(category, identifier)
        return cls.model_validate(params).model_dump() if issubclass(cls, BaseModel) else params


components = Registry()
