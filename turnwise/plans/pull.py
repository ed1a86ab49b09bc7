"""Pull ingest: stored objects found by their metadata, calls that are due, what became of them, recordings attached later.

A sweep lists objects without reading them, groups a call's objects and takes
those calls whose newest object has settled and is newer than the agent's
watermark, or that failed before. Outcomes are a log with a folder per sweep, and
watermark and retry list are read from it: a sweep that is repeated writes its
folder anew, so nothing counts twice, and a failed call is asked for again
whatever newer calls of its agent did, ``MOST_TRIES`` times in all.

Defined cases: objects that no rule matches or that name no call go; a null time
never settles; a listing without objects gives no calls; several objects of one
kind stay with their call.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .records import by_first_rule

OUTCOME = "agent_id string, call_id string, latest timestamp, ok boolean"
MOST_TRIES = 5


def listing(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """uri, modified, bytes of every object below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    return files.select(F.col("path").alias("uri"), F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"))


def calls_found(objects: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """agent_id, call_id, latest, objects (kind, uri) of objects (agent_id, uri, modified), by the first rule that matches."""
    named = by_first_rule(objects, "uri", rules)
    return named.groupBy("agent_id", "call_id").agg(F.max("modified").alias("latest"), F.sort_array(F.collect_set(F.struct("kind", "uri"))).alias("objects"))


def watermarks(log: DataFrame) -> DataFrame:
    """agent_id, high: the newest object of a call that went well."""
    return log.where("ok").groupBy("agent_id").agg(F.max("latest").alias("high"))


def retries(log: DataFrame, most: int = MOST_TRIES) -> DataFrame:
    """agent_id, call_id, tries of calls whose last outcome is a failure and that have tries left. ``log``: OUTCOME and sweep.

    Failures since the call's last success count.
    """
    last = log.groupBy("agent_id", "call_id").agg(F.max_by("ok", "sweep").alias("_ok"), F.max(F.when(F.col("ok"), F.col("sweep"))).alias("_well"), F.collect_set(F.when(~F.col("ok"), F.col("sweep"))).alias("_bad"))
    tries = F.size(F.filter("_bad", lambda s: s > F.coalesce("_well", s - 1)))
    return last.where("not _ok").select("agent_id", "call_id", tries.alias("tries")).where(F.col("tries") < most)


def due(found: DataFrame, log: DataFrame, cutoff: Column, most: int = MOST_TRIES) -> DataFrame:
    """Calls to read now, with why (new or retry): settled by ``cutoff``, and newer than the watermark or failed before."""
    named = found.join(watermarks(log), "agent_id", "left").join(retries(log, most), ["agent_id", "call_id"], "left")
    fresh = F.col("high").isNull() | (F.col("latest") > F.col("high"))
    # a call that failed for good comes back only with a newer object than it failed with
    last = log.groupBy("agent_id", "call_id").agg(F.max("latest").alias("_seen"))
    told = named.join(last, ["agent_id", "call_id"], "left")
    fresh &= F.col("_seen").isNull() | (F.col("latest") > F.col("_seen"))
    why = F.when(F.col("tries").isNotNull(), "retry").when(fresh, "new")
    return told.withColumn("why", why).where((F.col("latest") <= cutoff) & F.col("why").isNotNull()).drop("high", "tries", "_seen")


def outcomes(spark: SparkSession, path: str) -> DataFrame:
    """The log of all sweeps, empty before the first."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    schema = f"{OUTCOME}, sweep long"
    if not folder.getFileSystem(conf).exists(folder):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", path).parquet(path)


def record(results: DataFrame, path: str, sweep: int) -> None:
    """Log what became of a sweep's calls (OUTCOME); a repeated sweep replaces its own."""
    results.select("agent_id", "call_id", "latest", "ok").write.mode("overwrite").parquet(f"{path}/sweep={sweep}")


def attached(recordings: DataFrame, calls: DataFrame, tombstones: DataFrame, media: DataFrame, cutoff: Column) -> DataFrame:
    """call_id, kind, uri of settled recordings (agent_id, call_id, kind, uri, modified) to attach.

    The call has to be known to its agent and not erased, the kind new to it; of
    several recordings of a kind the first by name counts.
    """
    settled = recordings.where(F.col("modified") <= cutoff).where("kind is not null and call_id is not null")
    known = settled.join(calls.select("agent_id", "call_id"), ["agent_id", "call_id"], "left_semi").join(tombstones.select("call_id"), "call_id", "left_anti")
    new = known.join(media.select("call_id", "kind"), ["call_id", "kind"], "left_anti")
    return new.groupBy("call_id", "kind").agg(F.min("uri").alias("uri"))


def with_media(calls: DataFrame, new: DataFrame) -> DataFrame:
    """calls (call_id, spans_complete, media_ready, status) after recordings came: ready, and ingested where the spans are complete."""
    got = new.select("call_id").distinct().withColumn("_new", F.lit(True))
    both = calls.join(got, "call_id", "left")
    changed = F.coalesce("_new", F.lit(False))
    return both.withColumns({"media_ready": F.col("media_ready") | changed, "status": F.when(changed & F.col("spans_complete"), "ingested").otherwise(F.col("status"))}).drop("_new")


#: page addresses as object keys: section gives the kind, the number the call
RULES = [("transcript", r"/en/([0-9]+)"), ("trace", r"/es/([0-9]+)"), ("audio", r"/([0-9]+)(?:[?#]|$)")]


def objects_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as objects: the host is the agent, a page's number its time in minutes."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    time = F.timestamp_seconds(F.col("page_id") * 60)
    return pages.select(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("agent_id"), F.col("url").alias("uri"), time.alias("modified"), "page_id")


def pull_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the second sweep reads: the first went up to the middle page, calls of numbers divisible by seven failed in it."""
    objects = objects_of_pages(spark, sf_dir)
    last = objects.agg(F.max("page_id")).first()[0] or 0
    first, second = (F.timestamp_seconds(F.lit(n * 60)) for n in (last // 2, last - 5))
    found = calls_found(objects.where(F.col("modified") <= first), RULES)
    log = found.select("agent_id", "call_id", "latest", (F.col("call_id").cast("long") % 7 != 0).alias("ok"), F.lit(1).cast("long").alias("sweep"))
    rows = due(calls_found(objects, RULES), log, second)
    return rows.select("agent_id", "call_id", F.unix_seconds("latest").alias("latest"), F.size("objects").alias("n_objects"), "why")


def reconcile_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as recordings of documents: those of numbers divisible by 13 are erased, by 5 have audio already."""
    objects = by_first_rule(objects_of_pages(spark, sf_dir), "uri", RULES).withColumn("agent_id", F.lit("a"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("string").alias("call_id"), F.lit("a").alias("agent_id"))
    number = F.col("call_id").cast("long")
    erased, media = docs.where(number % 13 == 0), docs.where(number % 5 == 0).select("call_id", F.lit("audio").alias("kind"))
    return attached(objects, docs, erased, media, F.timestamp_seconds(F.lit(10**9)))


QUERIES = {"pull_due": pull_due, "reconcile_media": reconcile_media}

_NAMED = r"""with m as (select max(page_id) as last from pages), o as (select regexp_extract(url, '^https?://([^/]+)', 1) as agent_id, url, page_id, case when regexp_matches(url, '/en/([0-9]+)') then ['transcript', regexp_extract(url, '/en/([0-9]+)', 1)]
when regexp_matches(url, '/es/([0-9]+)') then ['trace', regexp_extract(url, '/es/([0-9]+)', 1)] when regexp_matches(url, '/([0-9]+)(?:[?#]|$)') then ['audio', regexp_extract(url, '/([0-9]+)(?:[?#]|$)', 1)] end as r from pages),
n as (select agent_id, r[2] as call_id, r[1] as kind, url, page_id from o where r[2] <> '')"""

ORACLE_SQL = {
    "pull_due": f"""{_NAMED}, f as (select agent_id, call_id, max(page_id) as latest, count(distinct (kind, url)) as k from n group by all),
g as (select agent_id, call_id, max(page_id) as latest, cast(call_id as bigint) % 7 <> 0 as ok from n, m where page_id <= last // 2 group by agent_id, call_id),
w as (select agent_id, max(latest) as high from g where ok group by 1),
d as (select f.agent_id, f.call_id, f.latest, k, case when not g.ok then 'retry' when (high is null or f.latest > high) and (g.latest is null or f.latest > g.latest) then 'new' end as why
from f left join w using (agent_id) left join g on g.agent_id = f.agent_id and g.call_id = f.call_id, m where f.latest <= last - 5)
select agent_id, call_id, latest * 60 as latest, k as n_objects, why from d where why is not null""",
    "reconcile_media": f"""{_NAMED} select call_id, kind, min(url) as uri from n where call_id in (select cast(doc_id as varchar) from documents)
and cast(call_id as bigint) % 13 <> 0 and not (kind = 'audio' and cast(call_id as bigint) % 5 = 0) group by all""",
}
