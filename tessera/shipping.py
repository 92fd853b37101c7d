"""Makes this package importable in Python workers, wherever the driver was started."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Bytes of rows that go to a Python worker at once, unless the session says otherwise: long texts would else make batches
#: of any size, which the executor holds outside its heap and the worker once more.
BATCH_BYTES = 4 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def on_workers(spark: SparkSession) -> None:
    """Bounds what Python workers get at once by bytes, and adds the package's files to the session's Python files, once;
    no files if the package came as such a file itself."""
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))
    context, here = spark.sparkContext, Path(__file__).resolve().parent
    if getattr(context, "_tessera_added", False) or not here.is_dir():
        return
    path = Path(tempfile.mkdtemp(prefix="tessera-"), "tessera.zip")
    atexit.register(shutil.rmtree, path.parent, ignore_errors=True)
    with zipfile.ZipFile(path, "w") as out:
        for f in sorted(here.rglob("*.py")):
            out.write(f, f"tessera/{f.relative_to(here).as_posix()}")
    context.addPyFile(str(path))
    context._tessera_added = True  # noqa: SLF001
