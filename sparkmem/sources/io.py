"""Readers and writers: source trees, question sets, chunked exchange, archives, note vaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# File endings of source languages, and folders that are never read.
LANGUAGES = {"go": "go", "py": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "rs": "rust", "sql": "sql", "java": "java", "kt": "kotlin", "cs": "csharp", "fs": "fsharp", "vb": "vbnet", "c": "c", "h": "c", "cpp": "cpp", "hpp": "cpp", "php": "php", "rb": "ruby", "swift": "swift"}
IGNORED = ["node_modules", "vendor", "dist", "build", "target", "__pycache__"]


def source_tree(spark: SparkSession, path: str, limit: int | None = 500) -> DataFrame:
    """path, language, content, hash of the source files under a folder, in order of path."""
    ending = F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1))
    language = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where(~F.col("path").rlike(r"/(\.[^/]+|" + "|".join(IGNORED) + ")/"))
    out = files.withColumn("language", F.try_element_at(language, ending)).where(F.col("language").isNotNull())
    out = out if limit is None else out.orderBy("path").limit(limit)
    return out.select("path", "language", F.col("content").cast("string").alias("content"), F.sha2("content", 256).alias("hash"), F.col("modificationTime").alias("modified"))


def dialogue_questions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Turns and questions of a dialogue set: its sessions are keys session_1, session_2, ... of a map."""
    schema = "sample_id string, conversation map<string,string>, qa array<struct<question:string,answer:string,evidence:array<string>,category:int>>"
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    held = raw.select("sample_id", F.explode(F.map_filter("conversation", lambda k, v: k.rlike(r"^session_\d+$"))).alias("session", "turns"), "conversation")
    turns = held.select("sample_id", F.regexp_extract("session", r"(\d+)", 1).cast("int").alias("session"), F.try_element_at("conversation", F.concat("session", F.lit("_date_time"))).alias("at"), F.posexplode(F.from_json("turns", "array<struct<speaker:string,dia_id:string,text:string>>")).alias("n", "t"))
    return turns.select("sample_id", "session", "at", "n", "t.*"), raw.select("sample_id", F.posexplode("qa").alias("n", "q")).select("sample_id", "n", "q.*")


def history_questions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id string, question string, answer string, category string, chat_history array<struct<role:string,content:string,session_id:int,timestamp:string>>").option("multiLine", True).json(path)


def persona_dialogues(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("personas array<array<string>>, dialog array<struct<text:string,id:string>>, previous_dialogs array<struct<dialog:array<struct<text:string>>>>, self_instruct map<string,string>").json(path)


def labelled_corpus(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Records and queries with their labels of one corpus document."""
    record = "id string, project string, type string, kind string, scope string, topic_key string, content string, recorded_at string, valid_from string, valid_until string, tags array<string>, source string"
    labels = "struct<relevant:array<struct<episode_id:string,fact_id:string>>,hard_negative_ids:array<string>,no_answer:boolean,temporal:struct<valid_at:string,eligible_evidence_ids:array<string>>,isolation:struct<principal_project:string,eligible_ids:array<string>,excluded_ids:array<string>>>"
    raw = spark.read.schema(f"records array<struct<{record.replace(' ', ':').replace(',:', ',')}>>, queries array<struct<id:string,text:string,query_class:string,labels:{labels}>>").option("multiLine", True).json(path)
    return raw.select(F.inline("records")), raw.select(F.inline("queries"))


def chunk_id(payload: Column) -> Column:
    """Content address of a chunk: the first eight hex digits of its digest."""
    return F.substring(F.sha2(payload, 256), 1, 8)


def export_chunks(df: DataFrame, manifest: DataFrame | None, path: str, rows: int = 1000) -> DataFrame:
    """Write rows as JSON chunks that the manifest (chunk) doesn't list yet; returns their chunk ids and sizes."""
    part = F.floor((F.col("id") / rows)).cast("long")
    lines = df.select(part.alias("part"), F.col("id"), F.to_json(F.struct("*")).alias("line"))
    chunks = lines.groupBy("part").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", "line"))), lambda x: x["line"]), "\n").alias("payload"), F.count("*").alias("n"))
    new = chunks.select(chunk_id(F.col("payload")).alias("chunk"), "payload", "n")
    if manifest is not None:
        new = new.join(manifest.select("chunk"), "chunk", "left_anti")
    new.select("chunk", F.col("payload").alias("value")).write.partitionBy("chunk").mode("append").text(path)
    return new.select("chunk", "n")


def import_chunks(spark: SparkSession, path: str, schema: str, known: DataFrame | None = None) -> DataFrame:
    """Rows of chunks that aren't known yet; a chunk's id is text, whatever it looks like."""
    raw = spark.read.schema("value string, chunk string").text(path)
    if known is not None:
        raw = raw.join(known.select("chunk"), "chunk", "left_anti")
    return raw.select("chunk", F.from_json("value", schema).alias("r")).select("chunk", "r.*")


def export_archive(tables: dict[str, DataFrame], path: str, limits: dict[str, int] | None = None) -> None:
    """One folder of JSON lines for each table."""
    for name, df in tables.items():
        (df.limit(limits[name]) if limits and name in limits else df).write.mode("overwrite").json(f"{path}/{name}")


def restore_archive(spark: SparkSession, path: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    return {name: spark.read.schema(schema).json(f"{path}/{name}") for name, schema in schemas.items()}


def vault_notes(obs: DataFrame, edges: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """name, hash, note: a Markdown note for each observation, with front matter and links; unchanged ones (name, hash) are left out."""
    out = edges.join(obs.select(F.col("id").alias("to_id"), F.col("title").alias("to_title")), "to_id")
    links = out.groupBy(F.col("from_id").alias("id")).agg(F.array_join(F.transform(F.sort_array(F.collect_set(F.struct("relation", "to_id", "to_title"))), lambda x: F.concat(F.lit("- "), x["relation"], F.lit(": [["), x["to_id"].cast("string"), F.lit("-"), x["to_title"], F.lit("]]"))), "\n").alias("links"))
    front = F.concat_ws("\n", F.lit("---"), *(F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in ("id", "type", "project", "scope", "topic_key", "created_at")), F.lit("---"))
    note = F.concat_ws("\n", front, F.concat(F.lit("# "), F.col("title")), F.lit(""), F.col("content"), F.when(F.col("links").isNotNull(), F.concat(F.lit("\n## Links\n"), F.col("links"))))
    made = obs.join(links, "id", "left").select(F.concat(F.col("id").cast("string"), F.lit(".md")).alias("name"), note.alias("note")).withColumn("hash", F.sha2("note", 256))
    return made if known is None else made.join(known.select("name", "hash"), ["name", "hash"], "left_anti")
