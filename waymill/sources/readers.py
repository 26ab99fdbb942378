"""Readers of JSON tables, archives, feature collections, separated text and recorded samples.

Schemas are declared; files are read by the executors. Paths that are missing are all told at once.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymill.functions.keys import token, uid
from waymill.operators import relational as rel
from waymill.sources.schemas import GEOJSON, KEYS, PADDING, SCHEMAS, TELEMETRY


def missing(spark: SparkSession, paths: list[str]) -> list[str]:
    """Paths that don't exist."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    found = lambda p: (h := jvm.org.apache.hadoop.fs.Path(p)).getFileSystem(conf).exists(h)
    return [p for p in paths if not found(p)]


def require(spark: SparkSession, paths: list[str]) -> None:
    if gone := missing(spark, paths):
        raise FileNotFoundError("missing: " + ", ".join(sorted(gone)))


def with_uids(df: DataFrame) -> DataFrame:
    """Columns named uid or ...Uid, and arrays named ...Uids, in reference form."""
    out = {}
    for f in df.schema:
        if (f.name == "uid" or f.name.endswith(("Uid", "_uid"))) and isinstance(f.dataType, T.StringType):
            out[f.name] = uid(f.name)
        elif f.name.endswith(("Uids", "_uids")) and isinstance(f.dataType, T.ArrayType):
            out[f.name] = F.transform(f.name, uid)
    return df.withColumns(out) if out else df


def json_table(spark: SparkSession, path: str, schema: str, keep: Column | None = None, lines: bool = False) -> DataFrame:
    """A table from files that hold one JSON array each, or with `lines` one object a line (which splits large files);
    rows are filtered before uids are formed."""
    df = spark.read.schema(schema).option("multiLine", not lines).json(path)
    return with_uids(df.filter(keep) if keep is not None else df)


class MapTables:
    """Tables of one map in a folder of `{map}-{table}.json` files, read lazily with focus, overrides and hidden rules."""

    def __init__(self, spark: SparkSession, folder: str, map_name: str, names: list[str], lines: bool = False):
        self.spark, self.folder, self.map_name, self.lines = spark, folder, map_name, lines
        if unknown := set(names) - SCHEMAS.keys():
            raise ValueError(f"unknown tables: {sorted(unknown)}")
        require(spark, [self.path(n) for n in names])
        self.names = names

    def path(self, name: str) -> str:
        return f"{self.folder}/{self.map_name}-{name}.json"

    def read(self, name: str, centre: tuple[float, float] | None = None, radius: float | None = None, secret: DataFrame | None = None, hidden: bool = False) -> DataFrame:
        """One table. secret: uids (uid) that are forced secret and visible. Later rows of a key win."""
        df = json_table(self.spark, self.path(name), SCHEMAS[name], lines=self.lines)
        if name in KEYS:
            df = df.withColumn("_at", F.monotonically_increasing_id())
            df = rel.keep_last(df, [KEYS[name]], ["_at"]).drop("_at")
        if secret is not None and "secret" in df.columns and "hidden" in df.columns:
            df = rel.force(df, secret, "uid", secret=F.lit(True), hidden=F.lit(None).cast("boolean"))
        if "hidden" in df.columns and not hidden:
            companies = self.read("companies") if name == "prefabs" and "companies" in self.names else None
            if companies is not None:
                exempt = companies.select(F.col("prefabUid").alias("uid"))
                df = rel.without_hidden(df.withColumnRenamed("hidden", "is_hidden"), exempt, "uid").withColumnRenamed("is_hidden", "hidden")
            else:
                df = df.filter(~F.coalesce("hidden", F.lit(False)))
        pad = PADDING.get(name)
        if radius is not None and pad is not None:
            df = rel.focus(df, centre, radius, pad)
        return df.withColumn("map", F.lit(self.map_name))


def zipped(spark: SparkSession, path: str) -> DataFrame:
    """(name, content) of the files in zip archives by base name, whatever their folder; the later of two wins.

    An archive is read by one task; its entries are read one at a time.
    """
    return unzipped(spark.read.format("binaryFile").load(path).select("path", "content"))


def unzipped(files: DataFrame) -> DataFrame:
    """zipped() of archives given as rows (path, content)."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for archive, content in zip(pdf["path"], pdf["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for i, e in enumerate(z.infolist()):
                        if not e.is_dir():
                            yield pd.DataFrame([(e.filename.rsplit("/", 1)[-1], archive, i, z.read(e).decode("utf-8", "replace"))], columns=["name", "archive", "ord", "content"])

    rows = files.mapInPandas(unpack, "name string, archive string, ord int, content string")
    return rel.keep_last(rows, ["name"], ["archive", "ord"]).select("name", "content")


def layered(*archives: DataFrame) -> DataFrame:
    """Union of archives (path, content): of a path that several hold, the last archive's content counts."""
    marked = reduce(DataFrame.unionByName, [a.select("path", "content").withColumn("_rank", F.lit(i)) for i, a in enumerate(archives)])
    return rel.keep_last(marked, ["path"], ["_rank"]).drop("_rank")


def features(spark: SparkSession, path: str) -> DataFrame:
    """Features of feature-collection files: id, kind, coordinates (JSON), properties."""
    f = spark.read.schema(GEOJSON).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    return f.select("f.id", F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("coordinates"), F.col("f.properties").alias("properties"))


def feature_lines(spark: SparkSession, path: str) -> DataFrame:
    """features() of files that hold one feature a line: large files are split."""
    f = spark.read.text(path).select(F.from_json("value", "id string, geometry struct<type string, coordinates string>, properties string").alias("f"))
    return f.select("f.id", F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("coordinates"), F.col("f.properties").alias("properties"))


def adjacency(df: DataFrame) -> DataFrame:
    """Edges from rows (key, forward, backward) whose lists hold neighbours: (node, dir, ord, neighbour fields)."""
    parts = [df.select(F.col("key").alias("node"), F.lit(d).alias("dir"), F.posexplode(d).alias("ord", "v")).select("node", "dir", "ord", "v.*") for d in ("forward", "backward")]
    return with_uids(parts[0].unionByName(parts[1]))


def villages(spark: SparkSession, path: str, countries: list[str]) -> DataFrame:
    """Semicolon-separated places (name, country_code, x, y, note): known countries only, noted exclusions dropped; y is
    the file's fifth column, whose header names a z."""
    raw = spark.read.option("sep", ";").option("header", True).option("enforceSchema", False).schema("name string, countryCode string, xCoord double, yCoord double, zCoord double, notes string").csv(path)
    own = raw.select(F.trim("name").alias("name"), F.trim("countryCode").alias("country_code"), F.col("xCoord").alias("x"), F.col("zCoord").alias("y"), F.trim("notes").alias("note"))
    return own.filter(F.col("country_code").isin(countries) & ~F.coalesce(F.col("note").contains("HoR"), F.lit(False)))


def locale_entries(df: DataFrame) -> DataFrame:
    """(keys, vals) arrays of files as rows (key, val), the last of equal keys of a file wins; extra keys or values are left out."""
    rows = df.select("file", F.posexplode(F.arrays_zip(F.col("keys").alias("key"), F.col("vals").alias("val"))).alias("ord", "e")).select("file", "ord", "e.*")
    rows = rows.filter("key IS NOT NULL AND val IS NOT NULL")
    return rel.keep_last(rows, ["file", "key"], ["ord"]).select("file", "key", "val")


def telemetry(spark: SparkSession, path: str, stream: bool = False, per_batch: int = 1) -> DataFrame:
    """Recorded samples, one JSON object a line (gzip or plain), as a batch or a stream; samples without a position are
    dropped."""
    reader = spark.readStream.option("maxFilesPerTrigger", per_batch) if stream else spark.read
    df = reader.schema(TELEMETRY).json(path)
    p = F.col("truck.position")
    return df.filter((p["X"] != 0) | (p["Y"] != 0) | (p["Z"] != 0))


def game_state(df: DataFrame) -> DataFrame:
    """Samples in map axes: x east, y south, z up; milliseconds rounded down."""
    t = F.col("truck")
    return df.select("device", F.floor(F.col("game.timestamp") / 1000).alias("ms"), t["speed"].alias("speed"), t["position"]["X"].alias("x"), t["position"]["Z"].alias("y"), t["position"]["Y"].alias("z"), t["heading"].alias("heading"), F.coalesce("game.paused", F.lit(False)).alias("paused"))


def resolved_tokens(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, token(column))
