"""Versioned, hash-bucketed index tables on shared storage, changed bucket by bucket.

Every table of an index is cut by a hash of ``url`` into the same number of
buckets; a bucket is one directory of a *generation* (one write).  A version
is a small manifest ``_versions/v<number>.json`` that names, for each table
and bucket, the generation that holds it.  A write replaces the buckets it
touches and leaves all others where they are (copy on write), so its cost
follows the change and not the table, and any older version can still be read.

A manifest is written under another name first and moved to its number only if
that number is free: a reader sees either the old version or the new one with
all its tables, and of two writers one fails and can build on the other's
version.  Works on any Hadoop-compatible filesystem Spark is configured for.

Readers get a bucketed Spark table whose partitions are located where the
manifest says.  Spark then knows the hash layout: tables of one index join on
``url`` without a shuffle.  Files are sorted by url and carry a Bloom filter
on it, so a lookup reads a few row groups.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERSIONS = "_versions"
KEY, BUCKET = "url", "_bucket"
#: Session setting: buckets of an index that is created (default: the session's shuffle partitions).
BUCKETS_CONF = "spark.tessera.index.buckets"
#: Bytes of a row group, and urls that a file's Bloom filter is sized for.
ROW_GROUP, BLOOM_NDV = 8 << 20, 1_000_000
#: A lookup of at most so many urls becomes a filter; larger ones are joined.
MAX_LOOKUP = 256


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _path(spark, path)
    out = fs.create(p, False)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def _move_if_absent(spark: SparkSession, src: str, dst: str) -> None:
    """Rename that fails when ``dst`` exists."""
    sc = spark.sparkContext
    jvm = sc._jvm
    option = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = sc._gateway.new_array(option, 1)
    options[0] = option.NONE
    _, a = _path(spark, src)
    fs, b = _path(spark, dst)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), sc._jsc.hadoopConfiguration())
    context.rename(a, b, options)


def current_version(spark: SparkSession, root: str) -> int:
    """The highest published version, 0 if none is."""
    fs, p = _path(spark, f"{root.rstrip('/')}/{VERSIONS}")
    if not fs.exists(p):
        return 0
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return max([int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")], default=0)


def manifest(spark: SparkSession, root: str, version: int | None = None) -> dict | None:
    """A version's manifest (default: the current one): buckets, tables, note."""
    version = version or current_version(spark, root)
    if not version:
        return None
    fs, p = _path(spark, f"{root.rstrip('/')}/{VERSIONS}/v{version:012d}.json")
    stream = fs.open(p)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def bucket_of(url: Column | str, buckets: int) -> Column:
    """The bucket of a url: the hash by which Spark itself buckets tables."""
    return F.pmod(F.hash(url), F.lit(buckets))


def _write_generation(spark: SparkSession, root: str, name: str, df: DataFrame, buckets: int) -> tuple[str, list[int]]:
    """Write the rows as a new generation; its directory and the buckets that it has."""
    path, passing = f"{root}/{name}/gen-{uuid.uuid4().hex}", f"tessera_w_{uuid.uuid4().hex}"
    rows = df.withColumn(BUCKET, bucket_of(KEY, buckets)).repartition(buckets, KEY)
    (rows.write.format("parquet").partitionBy(BUCKET).bucketBy(buckets, KEY).sortBy(KEY).option("path", path)
     .option("parquet.block.size", ROW_GROUP).option(f"parquet.bloom.filter.enabled#{KEY}", "true")
     .option(f"parquet.bloom.filter.expected.ndv#{KEY}", BLOOM_NDV).saveAsTable(passing))
    spark.sql(f"DROP TABLE {passing}")  # a table with a path of its own: the files stay
    fs, p = _path(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return path, sorted(int(n.split("=")[1]) for n in names if n.startswith(f"{BUCKET}="))


def publish_index(spark: SparkSession, root: str, tables: dict[str, DataFrame], note: dict | None = None, *,
                  touched: Sequence[int] | None = None, buckets: int | None = None) -> int:
    """Write ``tables`` (rows with a url) and publish them as the next version; its number.

    ``touched``: only these buckets are replaced, by the tables' rows in them,
    and all other buckets stay as the current version has them; without it,
    the tables are replaced whole.  ``buckets`` sets their number when the
    index is created.  ``note`` is kept in the manifest (a stream's batch
    number, say).  Rows with a null url are in the bucket that Spark hashes
    null to; an empty table has no files.
    """
    root = root.rstrip("/")
    version = current_version(spark, root) + 1
    old = manifest(spark, root, version - 1) if version > 1 else None
    n = old["buckets"] if old else buckets or int(spark.conf.get(BUCKETS_CONF, spark.conf.get("spark.sql.shuffle.partitions")))
    out = dict(old["tables"]) if old and touched is not None else {}
    for name, df in tables.items():
        rows = df if touched is None else df.where(bucket_of(KEY, n).isin(list(touched)))
        path, written = _write_generation(spark, root, name, rows, n)
        before = out.get(name, {"gens": [], "of": [-1] * n})
        of = list(before["of"])
        for b in range(n) if touched is None else touched:
            of[b] = -1
        for b in written:
            of[b] = len(before["gens"])
        used = sorted({g for g in of if g >= 0})
        gens = [*before["gens"], path]
        out[name] = {"schema": df.schema.jsonValue(), "gens": [gens[g] for g in used], "of": [used.index(g) if g >= 0 else -1 for g in of]}
    draft = f"{root}/{VERSIONS}/draft-{uuid.uuid4().hex}"
    _write_text(spark, draft, json.dumps({"version": version, "buckets": n, "tables": out, "note": note or {}}))
    _move_if_absent(spark, draft, f"{root}/{VERSIONS}/v{version:012d}.json")
    return version


def read_current(spark: SparkSession, root: str, table: str, version: int | None = None, buckets: Sequence[int] | None = None) -> DataFrame | None:
    """A table of the current (or a given) version, or None when it was never published.

    ``buckets``: only these, by partition pruning.  The table keeps its hash
    layout, so a join on url with another table of the index has no shuffle."""
    m = manifest(spark, root, version)
    if not m or table not in m["tables"]:
        return None
    entry, n = m["tables"][table], m["buckets"]
    schema = T.StructType.fromJson(entry["schema"])
    if all(g < 0 for g in entry["of"]):
        return spark.createDataFrame([], schema)
    name = "tessera_v_" + hashlib.md5(f"{root.rstrip('/')}|{table}|{m['version']}|{entry['gens']}".encode()).hexdigest()
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}, `{BUCKET}` INT) USING parquet PARTITIONED BY (`{BUCKET}`) "
                  f"CLUSTERED BY (`{KEY}`) SORTED BY (`{KEY}`) INTO {n} BUCKETS LOCATION '{entry['gens'][0]}'")
        places = [f"PARTITION (`{BUCKET}`={b}) LOCATION '{entry['gens'][g]}/{BUCKET}={b}'" for b, g in enumerate(entry["of"]) if g >= 0]
        for k in range(0, len(places), 500):
            spark.sql(f"ALTER TABLE {name} ADD IF NOT EXISTS {' '.join(places[k:k + 500])}")
    df = spark.table(name)
    return (df if buckets is None else df.where(F.col(BUCKET).isin(list(buckets)))).drop(BUCKET)


def lookup(spark: SparkSession, root: str, table: str, urls: DataFrame) -> DataFrame | None:
    """The stored rows of the requested urls (column url; distinct, nulls match nothing).

    A few urls (``MAX_LOOKUP``) become a filter that prunes buckets, row
    groups and pages; more are joined with the table, which keeps its layout,
    so only the request is shuffled."""
    wanted = urls.where(F.col(KEY).isNotNull()).select(KEY).distinct()
    few = [r[0] for r in wanted.limit(MAX_LOOKUP + 1).collect()]
    m = manifest(spark, root)
    if m is None:
        return None
    if len(few) > MAX_LOOKUP:
        stored = read_current(spark, root, table)
        return stored.join(wanted.repartition(m["buckets"], KEY), KEY, "left_semi") if stored is not None else None
    of = spark.range(1).select(F.explode(F.array(*[bucket_of(F.lit(u), m["buckets"]) for u in few]) if few else F.array().cast("array<int>")))
    stored = read_current(spark, root, table, buckets=sorted({r[0] for r in of.collect()}))
    return stored.where(F.col(KEY).isin(few)) if stored is not None else None


def files_of(spark: SparkSession, root: str, version: int | None = None) -> dict[str, set[str]]:
    """Bucket directories of each table of a version."""
    m = manifest(spark, root, version)
    return {t: {f"{e['gens'][g]}/{BUCKET}={b}" for b, g in enumerate(e["of"]) if g >= 0} for t, e in m["tables"].items()} if m else {}


def vacuum(spark: SparkSession, root: str, keep: int = 10) -> int:
    """Delete the generations that none of the last ``keep`` versions names, and older manifests; how many generations."""
    root, last = root.rstrip("/"), current_version(spark, root)
    kept = [v for v in range(max(1, last - keep + 1), last + 1)]
    named = {g for v in kept for e in (manifest(spark, root, v) or {"tables": {}})["tables"].values() for g in e["gens"]}
    gone = 0
    for table in (manifest(spark, root) or {"tables": {}})["tables"]:
        fs, p = _path(spark, f"{root}/{table}")
        for status in fs.listStatus(p):
            if f"{root}/{table}/{status.getPath().getName()}" not in named:
                gone += fs.delete(status.getPath(), True)
    for v in range(max(1, last - keep - 1000), max(1, last - keep + 1)):
        fs, p = _path(spark, f"{root}/{VERSIONS}/v{v:012d}.json")
        fs.delete(p, False)
    return gone
