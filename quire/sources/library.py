"""Sources and sinks: catalog snapshots, formats, page texts, contract files, inventories, digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

#: Columns of a report's JSON object.
REPORT = "report_id string, source string, page long, kind string, quoted string, proposed string, created_at timestamp"


def read_catalog(books: DataFrame, authors: DataFrame, tags: DataFrame) -> DataFrame:
    """book_id, title, authors, tags: lists in their order; books without any keep empty lists."""
    ordered = lambda rows, name: rows.groupBy("book_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "name"))), lambda x: x["name"]).alias(name))
    empty = F.array().cast("array<string>")
    rows = books.join(ordered(authors, "authors"), "book_id", "left").join(ordered(tags, "tags"), "book_id", "left")
    return rows.select("book_id", "title", F.coalesce("authors", empty).alias("authors"), F.coalesce("tags", empty).alias("tags"))


def select_format(formats: DataFrame) -> DataFrame:
    """book_id, format, name, status: a single EPUB, else the only file if it is a PDF or DJVU, else rejected."""
    epub = F.col("format") == "EPUB"
    counted = formats.groupBy("book_id").agg(
        F.count_if(epub).alias("epubs"), F.count("*").alias("n"), F.min(F.when(epub, F.col("name"))).alias("epub_name"), F.min("format").alias("only"), F.min("name").alias("only_name")
    )
    single = (F.col("epubs") == 0) & (F.col("n") == 1) & F.col("only").isin("PDF", "DJVU")
    chosen = F.when(F.col("epubs") == 1, "EPUB").when(single, F.col("only"))
    name = F.when(F.col("epubs") == 1, F.col("epub_name")).when(single, F.col("only_name"))
    return counted.select("book_id", chosen.alias("format"), name.alias("name"), F.when(chosen.isNull(), "rejected").otherwise("selected").alias("status"))


def page_units(pages: DataFrame, least: int = 40) -> DataFrame:
    """page, title, text, needs_ocr: a unit per page; a page with fewer word characters needs OCR."""
    letters = F.length(F.regexp_replace("text", r"(?U)\W", ""))
    return pages.select("page", F.concat(F.lit("Page "), F.col("page")).alias("title"), "text", (letters < least).alias("needs_ocr"))


def read_contract(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(rows, errors) of JSON lines that must have exactly the schema's fields with its types."""
    lines = spark.read.text(path).withColumn("file", F.input_file_name())
    wanted = F.array_sort(F.array(*[F.lit(f.name) for f in schema.fields]))
    broken = T.StructType([*schema.fields, T.StructField("_broken", T.StringType())])
    row = F.from_json("value", broken, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken", "allowNonNumericNumbers": "false"})
    keys = F.array_sort(F.json_object_keys("value"))
    read = lines.withColumn("r", row)
    reason = F.when(keys.isNull() | F.col("r._broken").isNotNull(), "not valid").when(keys != wanted, "other keys")
    read = read.withColumn("reason", reason)
    return read.where("reason is null").select(*[F.col(f"r.{f.name}") for f in schema.fields]), read.where("reason is not null").select("file", "value", "reason")


def read_observations(kinds: dict[str, tuple[DataFrame, Column, Column]]) -> tuple[DataFrame, DataFrame]:
    """(records, coverage): observations of several kinds in one shape.

    kinds: a frame with source, title and at, the rule that a row must meet, and its state.
    """
    records = None
    for kind, (rows, rule, state) in kinds.items():
        part = rows.select(F.lit(kind).alias("kind"), "source", "title", "at", state.alias("state"), F.coalesce(rule, F.lit(False)).alias("sound"))
        records = part if records is None else records.unionByName(part)
    coverage = records.groupBy("kind").agg(F.count_if("sound").alias("accepted"), F.count_if(~F.col("sound")).alias("rejected"), F.countDistinct("source").alias("sources"))
    return records.where("sound").drop("sound"), coverage


def inventory(objects: DataFrame, roles: dict[str, str], other: str = "other") -> DataFrame:
    """path, sha256, size, role from objects(path, content); the role goes by the path's prefix."""
    role = F.lit(other)
    for prefix, name in sorted(roles.items(), key=lambda x: len(x[0])):
        role = F.when(F.startswith("path", F.lit(prefix)), F.lit(name)).otherwise(role)
    return objects.select("path", F.sha2("content", 256).alias("sha256"), F.length("content").cast("long").alias("size"), role.alias("role"))


def dump_digest(rows: DataFrame, by: str, order: str, columns: list[str]) -> DataFrame:
    """A digest of each group's rows as canonical JSON lines: keys sorted, in the order of a column."""
    line = F.to_json(F.struct(*sorted(columns)))
    digest = F.sha2(F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("k"), line.alias("line")))), lambda x: x["line"]), "\n"), F.lit("\n")), 256)
    return rows.groupBy(by).agg(digest.alias("digest"), F.count("*").alias("n"))


MANIFEST = "name string, rows long, digest long, keyed boolean, buckets int"


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("source"), F.lit(buckets)).cast("int")


def _row_digest(columns: list[str]) -> Column:
    """A digest of a row; null and absent values differ from empty ones."""
    return F.xxhash64(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}))


def _contents(columns: list[str]) -> list[Column]:
    """Rows, and a digest that their order doesn't change: what repeats counts as often as it does."""
    return [F.count("*").alias("rows"), F.coalesce(F.sum(F.pmod(_row_digest(columns), F.lit(1 << 31))), F.lit(0).cast("long")).alias("digest")]


def write_publication(tables: dict[str, DataFrame], path: str, buckets: int = 16, search: str = "search") -> None:
    """Write every table once under a new path; its manifest, one file, comes last, and nothing is readable before.

    Tables with a source are partitioned by its bucket, so a reader of some sources opens their buckets only.
    Of the table `search`, rows whose `searchable` isn't true are left out. Rows and digests for the manifest
    are counted while the tables are written. A path that has anything is never written to again:
    a publication that failed half-way stays unreadable, and the next one takes another path.
    """
    spark = next(iter(tables.values())).sparkSession
    held = []
    for name, df in tables.items():
        if name == search and "searchable" in df.columns:
            df = df.where("searchable")
        columns, seen, keyed = df.columns, Observation(), "source" in df.columns
        out = df.observe(seen, *_contents(columns))
        if keyed:
            out.withColumn("bucket", _bucket(buckets)).write.mode("errorifexists").partitionBy("bucket").parquet(f"{path}/{name}")
        else:
            out.write.mode("errorifexists").parquet(f"{path}/{name}")
        held.append((name, seen.get["rows"], seen.get["digest"], keyed, buckets))
    spark.createDataFrame(held, MANIFEST).coalesce(1).write.mode("errorifexists").parquet(f"{path}/_manifest")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest of a whole publication; an error without one."""
    return spark.read.parquet(f"{path}/_manifest")


def read_publication(spark: SparkSession, path: str, name: str, sources: list[str] | None = None) -> DataFrame:
    """A table of a whole publication, of some sources if they are named."""
    entry = read_manifest(spark, path).where(F.col("name") == name).first()
    if entry is None:
        raise KeyError(f"the publication has no {name}")
    rows = spark.read.parquet(f"{path}/{name}")
    if not entry["keyed"]:
        return rows
    if sources is not None:
        wanted = spark.createDataFrame([(s,) for s in sources], "source string").select(_bucket(entry["buckets"]).alias("b"))
        rows = rows.where(F.col("bucket").isin(*{r["b"] for r in wanted.collect()}) & F.col("source").isin(*sources))
    return rows.drop("bucket")


def changed_tables(spark: SparkSession, path: str) -> list[str]:
    """Names of tables that no longer have the rows of the manifest."""
    out = []
    for entry in read_manifest(spark, path).collect():  # one row for each table
        rows = read_publication(spark, path, entry["name"])
        now = rows.agg(*_contents(rows.columns)).first()
        if (now["rows"], now["digest"]) != (entry["rows"], entry["digest"]):
            out.append(entry["name"])
    return out


def read_reports(spark: SparkSession, path: str, content_id: Column) -> DataFrame:
    """Reports of JSON files, oldest first; only those whose id is the one that their content gives."""
    rows = spark.read.schema(REPORT).option("recursiveFileLookup", "true").json(path)
    return rows.where(F.col("report_id") == content_id).orderBy("created_at", "report_id")
