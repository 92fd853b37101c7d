"""Catalogs: classes whose entries are made once, when first asked for."""

from __future__ import annotations

import itertools
import threading
from collections.abc import Callable, Iterator

from tessera.sources.base import CatalogEntry
from tessera.sources.tables import NullDataset


class entry:  # noqa: N801  used as a decorator
    """Marks a catalog's method that makes an entry; each catalog makes it once. ``services`` of the catalog, if any, are
    whatever the constructor was given, so a method may use them."""

    def __init__(self, make: Callable) -> None:
        self.make, self.__doc__ = make, make.__doc__

    def __set_name__(self, owner: type, name: str) -> None:
        self.name = name

    def __get__(self, catalog: Catalog | None, owner: type):  # noqa: ANN204
        if catalog is None:
            return self
        with catalog._lock:  # noqa: SLF001
            made = catalog._made  # noqa: SLF001
            if self.name not in made:
                found = self.make(catalog)
                if not isinstance(found, CatalogEntry):
                    raise TypeError(f"{self.name} is no catalog entry")
                made[self.name] = found
            return made[self.name]


class Catalog:
    """Base of catalogs. Keyword arguments become attributes; ``base_path`` and ``connection`` are always there."""

    def __init__(self, base_path: str = "data", connection: str | None = None, **services: object) -> None:
        self._lock, self._made = threading.RLock(), {}
        self.base_path, self.connection = base_path, connection
        for name, value in services.items():
            setattr(self, name, value)

    def path(self, *parts: str) -> str:
        """A path below the base path."""
        return "/".join([self.base_path.rstrip("/"), *parts])

    def entries(self) -> dict[str, CatalogEntry]:
        """All entries by the names of their methods, made if they weren't yet."""
        names = dict.fromkeys(n for cls in reversed(type(self).__mro__) for n, v in vars(cls).items() if isinstance(v, entry))
        return {n: getattr(self, n) for n in names}

    def __iter__(self) -> Iterator[CatalogEntry]:
        return iter(self.entries().values())

    def clear(self) -> None:
        """Forgets the entries made so far."""
        with self._lock:
            self._made.clear()


_numbers = itertools.count(1)


class NoData:
    """Ports of nodes that read or give nothing; each use is an entry of its own, so they never meet."""

    @staticmethod
    def port(kind: str = "none") -> NullDataset:
        return NullDataset(f"_nodata_{kind}_{next(_numbers)}")

    @staticmethod
    def input() -> NullDataset:
        return NoData.port("input")

    @staticmethod
    def output() -> NullDataset:
        return NoData.port("output")

    @staticmethod
    def discard() -> NullDataset:
        return NoData.port("discard")

    none = output

    @staticmethod
    def result() -> None:
        """What a node returns that only has a side effect."""
        return
