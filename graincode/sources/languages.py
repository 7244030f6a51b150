"""Languages by file extension, and what can be parsed of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graincode.functions.scalars import extension

#: Extensions of each language.
EXTENSIONS: dict[str, tuple[str, ...]] = {
    "python": (".py",),
    "javascript": (".js", ".jsx", ".mjs", ".cjs"),
    "typescript": (".ts", ".tsx", ".mts"),
    "go": (".go",),
    "java": (".java",),
    "rust": (".rs",),
    "c": (".c", ".h"),
    "cpp": (".cpp", ".hpp", ".cc", ".cxx", ".hh"),
    "ruby": (".rb",),
    "php": (".php",),
    "kotlin": (".kt", ".kts"),
    "swift": (".swift",),
    "scala": (".scala", ".sc"),
    "dart": (".dart",),
    "c_sharp": (".cs",),
    "lua": (".lua",),
    "zig": (".zig",),
    "elixir": (".ex", ".exs"),
    "html": (".html", ".htm"),
    "css": (".css",),
    "scss": (".scss",),
    "sass": (".sass",),
    "less": (".less",),
    "json": (".json",),
    "yaml": (".yaml", ".yml"),
    "xml": (".xml", ".svg"),
    "markdown": (".md",),
    "sql": (".sql",),
    "graphql": (".graphql", ".gql"),
    "protobuf": (".proto",),
}
#: Languages read as raw text.
RAW = ("html", "css", "scss", "sass", "less", "json", "yaml", "xml", "markdown", "sql", "graphql", "protobuf")
#: Languages with symbol patterns of their own; all others are read as raw text too.
PARSED = ("go", "java", "javascript", "php", "python", "rust", "typescript")


def detect_language(path: Column) -> Column:
    """Language of a path by its last extension; null where it is unknown."""
    pairs = [F.lit(x) for language, names in EXTENSIONS.items() for e in names for x in (e, language)]
    return F.try_element_at(F.create_map(*pairs), extension(path))


def support_matrix(spark: SparkSession) -> DataFrame:
    """language, kind (ast or raw) and parsed (has patterns of its own)."""
    rows = [(language, "raw" if language in RAW else "ast", language in PARSED) for language in EXTENSIONS]
    return spark.createDataFrame(rows, "language string, kind string, parsed boolean")
