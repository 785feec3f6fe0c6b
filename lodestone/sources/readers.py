"""Readers. Schemas are given, never inferred."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import fixed
from ..functions.paths import file_language

USAGE_SCHEMA = ("repo string, dependency string, weighted_score double, manifest_match boolean, "
                "source_match boolean, total_imports bigint, total_calls bigint, file_count bigint")
LOCK_SCHEMA = ("repo_url string, lock_type string, cargo_lock_found boolean, "
               "cargo_lock_total_packages bigint, cargo_lock_external_estimate bigint, "
               "go_sum_found boolean, go_sum_unique_modules bigint, branch_used string")
REGISTRY_SCHEMA = ("repo_url string, depsdev_found boolean, depsdev_ecosystem string, "
                   "depsdev_package string, depsdev_version string, depsdev_direct_deps bigint, "
                   "depsdev_transitive_deps bigint")
SIGNAL_SCHEMA = ("repo_url string, implements_from_scratch string, defines_new_protocol string, "
                 "has_novel_algorithms string, is_foundational_infrastructure string, "
                 "implements_core_logic string, is_wrapper_or_integration string, "
                 "is_template_or_scaffold string, is_thin_wrapper string, "
                 "is_heavy_dependency string, is_glue_code_or_middleware string, "
                 "is_utility_library_only string, originality_score string, reasoning string")
README_SCHEMA = "repo_url string, readme_found boolean, readme_excerpt string"
ANCHOR_SCHEMA = "repo string, average_originality double"

# Names of manifest files.
MANIFEST_FILES = ("Cargo.toml", "go.mod", "Godeps.json", "package.json", "requirements*.txt",
                  "pyproject.toml", "*.csproj", "*.fsproj")


def read_csv(spark: SparkSession, path: str, schema: str | StructType,
             multi_line: bool = False) -> DataFrame:
    """CSV with a header; quoted commas and quotes in values are kept.

    Large files are split. ``multi_line=True`` also keeps line breaks inside values, at the
    cost of one task a file.
    """
    return (spark.read.schema(schema).option("header", True).option("escape", '"')
            .option("multiLine", multi_line).option("nanValue", "nan").csv(path))


def optional(read, spark: SparkSession, schema: str | StructType) -> DataFrame:
    """What ``read()`` gives, or an empty table of the schema where the path is absent."""
    try:
        return read()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def adjacency(values: DataFrame, column: str = "value") -> DataFrame:
    """JSON objects ``{url: [url, ...]}`` as ``src, targets``, one row per key.

    Lines of JSON split across tasks; for one giant object see ``read_giant_edges``.
    """
    parsed = F.from_json(column, "map<string, array<string>>")
    return values.select(F.explode(parsed).alias("src", "targets"))


def edges_of(adjacent: DataFrame) -> DataFrame:
    return adjacent.select("src", F.explode("targets").alias("dst"))


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """Edge table of a file or folder of JSON adjacency lines."""
    return edges_of(adjacency(spark.read.text(path)))


def read_giant_edges(spark: SparkSession, path: str) -> DataFrame:
    """Edge table of files that each hold one JSON object ``{url: [url, ...], ...}`` of any size.

    The object is cut where a list ends, which no name contains, so one file is read by as many
    tasks as its size asks for. A piece that is no entry fails the run.
    """
    lists = spark.read.option("lineSep", "]").text(path)
    entry = F.regexp_extract("value", r'(?s)^[\s{,]*("(?:[^"\\]|\\.)*")\s*:\s*\[(.*)\z', 1)
    rest = F.regexp_extract("value", r'(?s)^[\s{,]*"(?:[^"\\]|\\.)*"\s*:\s*\[(.*)\z', 1)
    key = F.from_json(F.concat(F.lit("["), entry, F.lit("]")), "array<string>")[0]
    targets = F.from_json(F.concat(F.lit("["), rest, F.lit("]")), "array<string>")
    broken = F.raise_error(F.concat(F.lit("no entry of an adjacency object: "), F.left("value", F.lit(80))))
    bare = F.col("value").rlike(r"^[\s{}]*$")  # what is around the entries
    bad = ~bare & ((entry == "") | targets.isNull())
    whole = F.when(bad, broken.cast("array<string>")).otherwise(targets)
    return edges_of(lists.select(key.alias("src"), whole.alias("targets")))


def decode_text(content: Column) -> Column:
    """Bytes to text; what is no UTF-8 is dropped."""
    clean = F.make_valid_utf8(content.cast("string"))
    return F.replace(clean, F.lit("�"), F.lit(""))


def tree_files(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """``repo, path, content`` of the files below ``root/<repo>/...`` whose names match.

    Spark lists and reads the files on the executors. Names are filtered ahead of the read.
    Spark's file sources pass over files of zero bytes, so those have no row.
    """
    raw = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
           .option("pathGlobFilter", glob).load(root))
    base = root.rstrip("/") + "/"
    inner = F.substring(F.col("path"), F.instr(F.col("path"), base) + len(base),
                        F.length("path"))
    repo = F.substring_index(inner, "/", 1)
    return raw.select(repo.alias("repo"),
                      F.substring(inner, F.length(repo) + 2, F.length(inner)).alias("path"),
                      decode_text(F.col("content")).alias("content"))


def read_source_tree(spark: SparkSession, root: str) -> DataFrame:
    """Source files below ``root``, their extensions in any mixture of case. Blank files stay,
    as they count as files of their project; those of zero bytes are not seen (``tree_files``)."""
    ext = sorted({e for exts in fixed.EXTENSIONS.values() for e in exts})
    glob = "*.{" + ",".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in e) for e in ext) + "}"
    return tree_files(spark, root, glob).filter(file_language(F.col("path")).isNotNull())


def read_manifest_tree(spark: SparkSession, root: str) -> DataFrame:
    """Manifest files below ``root``, for ``manifests.extract_all``, which leaves out those in
    folders of other projects' code."""
    return tree_files(spark, root, "{" + ",".join(MANIFEST_FILES) + "}")


def only_source(files: DataFrame) -> DataFrame:
    """Rows that are source code and not blank."""
    return files.filter(file_language(F.col("path")).isNotNull()
                        & F.col("content").rlike(r"(?U)\S"))
