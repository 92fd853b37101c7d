"""The application: registered pipelines over a catalog, run from code or the command line."""

from __future__ import annotations

import argparse
import logging
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import SparkSession

from tessera.app.config import ROOT, ConfigError, bind, build_catalog, discover, load_config, section
from tessera.meta.exporters import MetadataOptions, export
from tessera.plans import Execution, Pipeline, PipelineResult, format_result
from tessera.validation import Level, ValidationOptions

log = logging.getLogger("tessera")


@dataclass
class Registration:
    """A pipeline's factory and what is known of it."""

    factory: Callable[..., Pipeline]
    parameters: object = None
    description: str = ""
    tags: tuple[str, ...] = ()
    validation: ValidationOptions = field(default_factory=ValidationOptions)


class Registry:
    """Pipelines by name, in the order of registration."""

    def __init__(self) -> None:
        self.found: dict[str, Registration] = {}
        self.last: Registration | None = None

    def register(self, name: str, factory: Callable[..., Pipeline], parameters: object = None) -> Registry:
        """A factory takes the catalog and, if there are any, the parameters."""
        if not name or not name.strip():
            raise ValueError("a pipeline needs a name")
        if name in self.found:
            raise ValueError(f"a pipeline {name!r} is registered already")
        self.last = self.found[name] = Registration(factory, parameters)
        return self

    def _last(self) -> Registration:
        if self.last is None:
            raise ValueError("no pipeline was registered yet")
        return self.last

    def with_description(self, text: str) -> Registry:
        self._last().description = text
        return self

    def with_tags(self, *tags: str) -> Registry:
        self._last().tags += tags
        return self

    def with_validation(self, configure: Callable[[ValidationOptions], object]) -> Registry:
        configure(self._last().validation)
        return self


class ApplicationBuilder(Registry):
    """Collects what an application is made of. What code says comes before what the configuration says."""

    def __init__(self) -> None:
        super().__init__()
        self.config: dict | None = None
        self.catalog: object = None
        self.execution = Execution()
        self.formatter: Callable[[PipelineResult], str] = format_result
        self.metadata: MetadataOptions | None = None
        self.services: dict[str, object] = {}
        self._make_catalog: Callable[..., object] | None = None

    def use_configuration(self, folder: str = ".", name: str = "appsettings", env: str | None = None) -> ApplicationBuilder:
        self.config = load_config(folder, name, env)
        return self

    def use_catalog(self, catalog: object) -> ApplicationBuilder:
        """A catalog, or a function that makes it when the application is built (with the services, if it takes one)."""
        if callable(catalog):
            self._make_catalog = catalog
        else:
            self.catalog = catalog
        return self

    def configure_services(self, **services: object) -> ApplicationBuilder:
        self.services |= services
        return self

    def configure_logging(self, level: int | str = logging.INFO) -> ApplicationBuilder:
        logging.basicConfig(level=level, format="%(levelname)s %(name)s: %(message)s")
        log.setLevel(level)
        return self

    def configure_execution(self, **options: object) -> ApplicationBuilder:
        self.execution = replace(self.execution, **options)
        return self

    def format_results(self, formatter: Callable[[PipelineResult], str]) -> ApplicationBuilder:
        self.formatter = formatter
        return self

    def include_metadata(self, folder: str = "metadata", **options: object) -> ApplicationBuilder:
        self.metadata = MetadataOptions(folder=folder, **options)
        return self

    def register_from_config(self, name: str, factory: Callable[..., Pipeline], path: str, kind: type) -> ApplicationBuilder:
        """Registers a pipeline whose parameters are a section of the configuration."""
        if self.config is None:
            raise ConfigError("use_configuration comes before register_from_config")
        self.register(name, factory, bind(self.config, path, kind))
        return self

    def register_all(self, registry: Callable[[Registry], object] | type) -> ApplicationBuilder:
        """Registers what a function, or a class with ``pipelines``, adds."""
        (registry().pipelines if isinstance(registry, type) else registry)(self)
        return self

    def build(self) -> Application:
        config = self.config or {}
        catalog = self.catalog
        if catalog is None and self._make_catalog is not None:
            catalog = self._make_catalog(self.services) if self.services else self._make_catalog()
        if catalog is None:
            catalog = build_catalog(config)
        for name, (factory, parameters, options) in (discover(config) if config else {}).items():
            if name in self.found:
                continue
            self.register(name, factory, parameters)
            own = self._last()
            own.description = str(section(options, "Description") or "")
            own.tags = tuple(section(options, "Tags") or ())
            for key, level in (section(options, "Validation") or {}).items():
                own.validation.inspect(key, Level[str(level).upper()])
        if self.found and catalog is None:
            raise ConfigError("there is no catalog: call use_catalog or name one in the configuration")
        if self.metadata is None and isinstance(found := section(config, f"{ROOT}:Metadata"), Mapping):
            self.metadata = MetadataOptions.from_config(found)
        if level := section(config, f"{ROOT}:Logging:MinimumLevel"):
            log.setLevel(str(level).upper())
        pipelines = {}
        for name, r in self.found.items():
            made = r.factory(catalog) if r.parameters is None else r.factory(catalog, r.parameters)
            made.name, made.description, made.tags = name, r.description or made.description, r.tags or made.tags
            made.steps = [replace(s, pipeline=name) for s in made.steps]
            made.layers = None
            made.validation = made.validation.merged([r.validation.levels])
            pipelines[name] = made.build()
        return Application(catalog, pipelines, self.execution, self.formatter, self.metadata)


class Application:
    """Built pipelines, ready to run."""

    def __init__(self, catalog, pipelines, execution, formatter, metadata) -> None:  # noqa: ANN001
        self.catalog, self.pipelines, self.execution = catalog, pipelines, execution
        self.formatter, self.metadata = formatter, metadata

    @staticmethod
    def create(configure: Callable[[ApplicationBuilder], object]) -> Application:
        builder = ApplicationBuilder()
        configure(builder)
        return builder.build()

    def _selected(self, name: str | None) -> Pipeline:
        if name is not None:
            if name not in self.pipelines:
                raise KeyError(f"no pipeline {name!r}; there are: {', '.join(self.pipelines)}")
            return self.pipelines[name]
        if not self.pipelines:
            raise KeyError("no pipeline is registered")
        return Pipeline.merge(self.pipelines).build()

    def run_pipeline(self, spark: SparkSession, name: str | None = None, dry_run: bool = False) -> PipelineResult:
        """One pipeline, or all of them merged: its graph is exported, its external inputs are inspected (a failure raises
        before any node runs), then it runs, unless this is a dry run."""
        pipeline = self._selected(name)
        if self.metadata is not None and self.metadata.enabled:
            export(pipeline, self.metadata)
        pipeline.validate(spark).raise_if_invalid()
        result = pipeline.dry_run() if dry_run else pipeline.run(spark, self.execution)
        print(self.formatter(result))  # noqa: T201  the report
        return result

    def main(self, argv: list[str], spark: SparkSession) -> int:
        """The command line: ``[pipeline] [--dry-run]``. Returns 0, or 1 after any failure, which is logged."""
        parser = argparse.ArgumentParser(description="Runs one pipeline, or all of them.")
        parser.add_argument("pipeline", nargs="?", help=", ".join(self.pipelines))
        parser.add_argument("--dry-run", action="store_true", help="validate, but run nothing")
        try:
            args = parser.parse_args(argv)
            return 0 if self.run_pipeline(spark, args.pipeline, args.dry_run).success else 1
        except SystemExit as e:
            return 1 if e.code else 0
        except Exception as e:  # noqa: BLE001  the exit code tells
            log.error("%s", e)
            return 1
