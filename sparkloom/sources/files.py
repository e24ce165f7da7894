"""Sources that are files of their own kinds, and copies of tables that can be brought back."""

from __future__ import annotations

import tomllib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Suffixes of texts that the readers here understand.
SUFFIXES = ("txt", "md", "json", "jsonl", "toml", "html", "csv")

# The field that a category of attributes is kept in.
CATEGORY_FIELDS = {"damage_type": "damage_types", "damage": "damage_types", "creature_type": "creature_types", "creature": "creature_types", "condition": "conditions", "alignment": "alignments", "rarity": "rarities", "size": "sizes", "spell_school": "spell_schools", "school": "spell_schools"}

LAYOUT = "pages array<struct<page: int, elements: array<struct<role: string, text: string, x: double, y: double>>>>"


def field_of(category: str) -> str:
    """The field of a category, whatever its case; metadata for those without one."""
    return CATEGORY_FIELDS.get(category.lower(), "metadata")


def supported(spark: SparkSession, path: str, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """(path, modificationTime, length) of the files below a path whose suffix is among ``suffixes``, whatever its case; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "modificationTime", "length")
    return files.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*suffixes))


def frequencies(spark: SparkSession, path: str, boost: float = 1.0) -> DataFrame:
    """(word, n) of files with a word and its count on each line, a space between; counts are multiplied by ``boost``, words that repeat are added up, other lines left out."""
    line = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.col("value").rlike(r"^\s*\S+\s+\d+\s*$")).select(F.lower(line[0]).alias("word"), line[1].cast("long").alias("n"))
    return rows.groupBy("word").agg((F.sum("n") * boost).cast("long").alias("n"))


def pair_frequencies(spark: SparkSession, path: str) -> DataFrame:
    """(pair, n) of files with two words and their count on each line."""
    line = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.col("value").rlike(r"^\s*\S+\s+\S+\s+\d+\s*$"))
    return rows.groupBy(F.lower(F.concat_ws(" ", line[0], line[1])).alias("pair")).agg(F.sum(line[2].cast("long")).alias("n"))


def synonyms(spark: SparkSession, path: str) -> DataFrame:
    """(word, synonym, priority) of TOML files: in multi_way each word of a set has the others, in one_way the key has the values; all in lower case.

    Such files are written by hand, small and few; each is parsed whole on the driver.
    """
    rows: set[tuple[str, str, int]] = set()
    for r in spark.read.text(path, wholetext=True).collect():
        spec = tomllib.loads(r.value)
        for key, values in spec.get("multi_way", {}).items():
            group = list(dict.fromkeys(w.lower() for w in (key, *values)))
            rows |= {(a, b, k) for a in group for k, b in enumerate(x for x in group if x != a)}
        rows |= {(key.lower(), v.lower(), k) for key, values in spec.get("one_way", {}).items() for k, v in enumerate(values)}
    return spark.createDataFrame(sorted(rows), "word string, synonym string, priority int").groupBy("word", "synonym").agg(F.min("priority").alias("priority"))


def layout_elements(spark: SparkSession, path: str, roles: tuple[str, ...] | None = None) -> DataFrame:
    """(page, number, role, text, x, y) of layout files in JSON, of some roles or all, in the order of the file."""
    pages = spark.read.schema(LAYOUT).option("multiLine", "true").json(path).select(F.explode("pages").alias("p"))
    rows = pages.select("p.page", F.posexplode("p.elements").alias("number", "e")).select("page", "number", "e.*")
    return rows if roles is None else rows.where(F.col("role").isin(*roles))


def layout_pages(elements: DataFrame) -> DataFrame:
    """(page, text) of layout elements: the texts of a page in order, a line for each."""
    listed = F.array_sort(F.collect_list(F.struct("number", "text")))
    return elements.groupBy("page").agg(F.array_join(listed["text"], "\n").alias("text"))


def backup(tables: dict[str, DataFrame], folder: str, version: int) -> None:
    """Write tables as a version of a backup; a version that is there already is an error."""
    for name, df in tables.items():
        df.write.parquet(f"{folder}/version={version}/{name}")


def restored(spark: SparkSession, folder: str, version: int, name: str) -> DataFrame:
    """A table of a version."""
    return spark.read.parquet(f"{folder}/version={version}/{name}")


def backups(spark: SparkSession, folder: str) -> DataFrame:
    """(version, name, files, bytes) of what is there, the newest version first."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(folder).select("path", "length")
    at = r"/version=(\d+)/([^/]+)/[^/]+$"
    rows = files.select(F.regexp_extract("path", at, 1).cast("int").alias("version"), F.regexp_extract("path", at, 2).alias("name"), "length")
    return rows.groupBy("version", "name").agg(F.count("*").alias("files"), F.sum("length").alias("bytes")).orderBy(F.desc("version"), "name")
