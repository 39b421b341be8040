"""The languages that are parsed, their file extensions and how their imports resolve."""

from __future__ import annotations

import posixpath
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Language:
    id: str
    extensions: tuple[str, ...]
    imports: str = "none"


#: Language ids, extensions and import styles.
LANGUAGES = (
    Language("javascript", (".js", ".jsx", ".mjs", ".cjs"), "esm-relative"),
    Language("typescript", (".ts", ".mts", ".cts"), "esm-relative"),
    Language("tsx", (".tsx",), "esm-relative"),
    Language("python", (".py", ".pyi"), "python"),
    Language("go", (".go",)),
    Language("csharp", (".cs",)),
    Language("java", (".java",)),
    Language("rust", (".rs",)),
)
#: Languages that may call each other.
JS_FAMILY = ("javascript", "typescript", "tsx")
_BY_EXTENSION = {e: x for x in LANGUAGES for e in x.extensions}


def language_for_extension(extension: str) -> Language | None:
    return _BY_EXTENSION.get(extension.lower())


def language_of(path: str) -> Language | None:
    return language_for_extension(posixpath.splitext(path)[1])


def supported_extensions() -> list[str]:
    return list(_BY_EXTENSION)


def languages_table(spark: SparkSession) -> DataFrame:
    """One row an extension: ext, language, import_style, family. A dozen rows, whatever is scanned."""
    rows = [(e, x.id, x.imports, "js" if x.id in JS_FAMILY else x.id) for e, x in _BY_EXTENSION.items()]
    return spark.createDataFrame(rows, "ext string, language string, import_style string, family string")
