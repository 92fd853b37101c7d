"""Layered configuration, typed sections, and catalogs and pipelines named in it."""

from __future__ import annotations

import dataclasses
import importlib
import inspect
import json
import os
import types
import typing
from collections.abc import Callable, Mapping
from pathlib import Path

#: The variable that names the environment, those looked at after it (fixed names), and the environment if none does.
ENVIRONMENT_VARIABLE, DEFAULT_ENVIRONMENT = "TESSERA_ENV", "Production"
FALL_BACKS = ("DOTNET_ENVIRONMENT", "ASPNETCORE_ENVIRONMENT")

#: The section that the application itself reads.
ROOT = "Tessera"


class ConfigError(ValueError):
    """A configuration that is missing something or is wrong."""


def environment(explicit: str | None = None, variable: str | None = ENVIRONMENT_VARIABLE) -> str:
    """The environment's name: given, else from the variable (none: it is not looked at), else from the general ones, else
    Production."""
    named_by = (os.environ.get(v) for v in (variable, *FALL_BACKS) if v)
    return explicit or next(filter(None, named_by), DEFAULT_ENVIRONMENT)


def _merged(low: Mapping, high: Mapping) -> dict:
    """Both mappings, key by key in any case; the second wins, mappings in both are merged."""
    out = dict(low)
    names = {str(k).lower(): k for k in out}
    for k, v in high.items():
        k = names.get(str(k).lower(), k)  # noqa: PLW2901
        out[k] = _merged(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else v
    return out


def load_config(folder: str = ".", name: str = "appsettings", env: str | None = None, yaml_support: bool = True) -> dict:
    """The layers, later ones over earlier: name.json (which must be there), name.yaml, then both of the environment, then
    both of ``Local``."""
    env = environment(env)
    config: dict = {}
    for layer in ("", f".{env}", ".Local"):
        for ending in ("json", "yaml", "yml"):
            path = Path(folder, f"{name}{layer}.{ending}")
            if not path.is_file():
                if not layer and ending == "json":
                    raise ConfigError(f"{path} does not exist")
                continue
            if ending == "json":
                found = json.loads(path.read_text("utf-8-sig"))
            elif yaml_support:
                import yaml

                found = yaml.safe_load(path.read_text("utf-8"))
            else:
                continue
            config = _merged(config, found or {})
    return config


def section(config: Mapping, path: str, default: object = None) -> object:
    """What stands at a path like ``Tessera:Pipelines:Science``, in any case."""
    at: object = config
    for part in path.split(":"):
        if not isinstance(at, Mapping):
            return default
        at = next((v for k, v in at.items() if str(k).lower() == part.lower()), None)
        if at is None:
            return default
    return at


def in_range(low: float | None = None, high: float | None = None, default: object = dataclasses.MISSING) -> object:
    """A dataclass field whose value must lie in a range."""
    more = {} if default is dataclasses.MISSING else {"default": default}
    return dataclasses.field(metadata={"range": (low, high)}, **more)


def bind(config: Mapping, path: str, kind: type) -> object:
    """A section as a dataclass, nested ones too; raises for a missing section, a missing value, a value of another type
    or out of its range, naming all that is wrong."""
    found = section(config, path)
    if not isinstance(found, Mapping):
        raise ConfigError(f"there is no section {path}")
    errors: list[str] = []
    made = _bound(found, kind, path, errors)
    if errors:
        raise ConfigError("; ".join(errors))
    return made


def _bound(values: Mapping, kind: type, path: str, errors: list[str]) -> object:
    by_name = {str(k).lower().replace("_", ""): v for k, v in values.items()}
    hints = typing.get_type_hints(kind)
    given = {}
    for f in dataclasses.fields(kind):
        name = f.name.replace("_", "").lower()
        where = f"{path}:{f.name}"
        if name not in by_name:
            if f.default is dataclasses.MISSING and f.default_factory is dataclasses.MISSING:
                errors.append(f"{where} is missing")
            continue
        value, hint = by_name[name], hints[f.name]
        if typing.get_origin(hint) in (typing.Union, types.UnionType):
            hint = next(a for a in typing.get_args(hint) if a is not type(None))
            if value is None:
                given[f.name] = None
                continue
        try:
            if dataclasses.is_dataclass(hint):
                value = _bound(value, hint, where, errors)
            elif hint is bool:
                value = value if isinstance(value, bool) else {"true": True, "false": False}[str(value).lower()]
            elif hint in (int, float, str):
                value = hint(value)
        except (TypeError, ValueError, KeyError, AttributeError):
            errors.append(f"{where} is no {getattr(hint, '__name__', hint)}: {value!r}")
            continue
        low, high = f.metadata.get("range", (None, None))
        if (low is not None and value < low) or (high is not None and value > high):
            errors.append(f"{where} must be from {low} to {high}, not {value}")
        given[f.name] = value
    try:
        return kind(**given)
    except TypeError:
        return None  # what is missing is in the errors


def named(path: str) -> object:
    """What ``module:name`` or ``module.name`` names."""
    module, _, name = path.replace(":", ".").rpartition(".")
    try:
        return getattr(importlib.import_module(module), name)
    except (ImportError, AttributeError, ValueError) as e:
        raise ConfigError(f"cannot find {path}: {e}") from e


def build_catalog(config: Mapping) -> object | None:
    """The catalog that Tessera:Catalog names, or None: Type, ConstructorArgs (in any case), BasePath, ConnectionString."""
    options = section(config, f"{ROOT}:Catalog")
    kind = section(options, "Type") if isinstance(options, Mapping) else None
    if not kind:
        return None
    cls = named(kind)
    given = {str(k).lower().replace("_", ""): v for k, v in (section(options, "ConstructorArgs") or {}).items()}
    for name, value in (("basepath", section(options, "BasePath")), ("connection", section(options, "ConnectionString")), ("connectionstring", section(options, "ConnectionString"))):
        if value is not None:
            given.setdefault(name, value)
    own = inspect.signature(cls).parameters.values()
    args = {p.name: given[p.name.replace("_", "").lower()] for p in own if p.name.replace("_", "").lower() in given}
    if missing := [p.name for p in own if p.default is p.empty and p.kind in (p.POSITIONAL_OR_KEYWORD, p.KEYWORD_ONLY) and p.name not in args]:
        raise ConfigError(f"{kind} needs: {', '.join(missing)}")
    return cls(**args)


def discover(config: Mapping) -> dict[str, tuple[Callable, object, Mapping]]:
    """The pipelines that Tessera:Pipelines names by a Type: factory method (default ``create``), parameters (bound to the
    method's second annotation if that is a dataclass), and the rest of the section. Sections without a Type are skipped."""
    found = {}
    for name, options in (section(config, f"{ROOT}:Pipelines") or {}).items():
        kind = section(options, "Type") if isinstance(options, Mapping) else None
        if not kind:
            continue
        method = section(options, "FactoryMethod") or "create"
        factory = getattr(named(kind), method, None)
        if not callable(factory):
            raise ConfigError(f"{kind} has no factory method {method}")
        parameters = section(options, "Parameters")
        hints = [h for n, h in typing.get_type_hints(factory).items() if n != "return"]
        if parameters is not None and len(hints) > 1 and dataclasses.is_dataclass(hints[1]):
            parameters = bind(config, f"{ROOT}:Pipelines:{name}:Parameters", hints[1])
        found[name] = (factory, parameters, options)
    return found
