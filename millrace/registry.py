"""Hooks by name: languages, source adapters, validators and token counters."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Language:
    id: str
    aliases: tuple[str, ...] = ()
    extensions: tuple[str, ...] = ()
    validators: tuple[str, ...] = ()


@dataclass
class Registry:
    """Names to things; a name is taken once, in whatever case."""

    kind: str
    known: dict[str, Any] = field(default_factory=dict)

    def add(self, name: str, thing: Any, *others: str) -> Any:
        for key in {n.lower() for n in (name, *others)}:
            if key in self.known:
                raise ValueError(f"{self.kind} {key} is registered already")
            self.known[key] = thing
        return thing

    def get(self, name: str) -> Any:
        try:
            return self.known[name.lower()]
        except KeyError:
            raise LookupError(f"no {self.kind} {name}; known: {', '.join(sorted(self.known))}") from None


LANGUAGES = Registry("language")
EXTENSIONS = Registry("extension")
SOURCES = Registry("source adapter")
TOKEN_COUNTS = Registry("token count")


def add_language(language: Language) -> Language:
    LANGUAGES.add(language.id, language, *language.aliases)
    for extension in language.extensions:
        EXTENSIONS.add(extension, language)
    return language


def load(reference: str) -> Callable:
    """The hook that package.module:attribute names."""
    module, _, name = reference.partition(":")
    if not module or not name:
        raise ValueError(f"{reference!r} is not package.module:attribute")
    hook = getattr(importlib.import_module(module), name, None)
    if not callable(hook):
        raise TypeError(f"{reference} is not callable")
    return hook


PYTHON = add_language(Language("python", ("py", "python3"), (".py",), ("millrace.operators.filters:python_validator",)))
