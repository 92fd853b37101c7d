"""Applications: configuration, registered pipelines, command line."""

from tessera.app.application import Application, ApplicationBuilder, Registry
from tessera.app.config import ConfigError, build_catalog, bind, discover, environment, load_config, section

__all__ = [
    "Application", "ApplicationBuilder", "ConfigError", "Registry", "bind", "build_catalog", "discover", "environment", "load_config",
    "section",
]
