"""Transcripts, turn pairing, judgments, exports and clusters on the text tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.ordered import position

POINT_CAP = 3000
KNN_ROWS, KNN_QUERIES = 4096, 512  # of a block


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def transcript_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spoken lines in order with their speaker, whole; empty ones and system prompts are left out."""
    rows = table(spark, sf_dir, "conversations").where((F.col("role") != "system") & (F.trim("text") != ""))
    speaker = F.when(F.col("role") == "user", "caller").otherwise("agent")
    return rows.select("conv_id", position(["conv_id"], F.col("turn")).alias("line"), F.concat(speaker, F.lit(": "), F.col("text")).alias("said"))


def turn_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Caller text opens a turn (a later one replaces an unanswered one), the agent's reply closes it; a trailing caller is kept."""
    own = W.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").where(F.col("role").isin("user", "assistant")).withColumns(
        {"before": F.lag("role").over(own), "heard": F.lag("turn").over(own), "after": F.lead("role").over(own)}
    )
    reply = F.col("role") == "assistant"
    trailing = (F.col("role") == "user") & F.col("after").isNull()
    out = rows.where(reply | trailing).select(
        "conv_id", F.when(reply & (F.col("before") == "user"), F.col("heard")).when(trailing, F.col("turn")).alias("caller_turn"), F.when(reply, F.col("turn")).alias("agent_turn")
    )
    return out.select("conv_id", position(["conv_id"], F.coalesce("agent_turn", "caller_turn")).alias("turn_index"), "caller_turn", "agent_turn")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation as one digest of its alternating messages."""
    rows = table(spark, sf_dir, "conversations").where(F.trim("text") != "")
    list_ = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    said = F.array_join(F.transform(list_, lambda m: F.concat(m.role, F.lit("|"), m.text)), "\n")
    return rows.groupBy("conv_id").agg(F.count("*").alias("messages"), F.sha2(said, 256).alias("sha"))


def disposition(spoke: Column, duration: Column, failed: Column) -> Column:
    """connected if the caller said anything; no_answer without a duration (zero is none) or when failed; else unknown."""
    none = F.coalesce(duration, F.lit(0)) == 0
    return F.when(spoke, "connected").when(failed | none, "no_answer").otherwise("unknown")


def dispositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    found = disposition(F.col("o_orderpriority").startswith("1"), (F.col("o_orderkey") % 4), F.col("o_orderstatus") == "F")
    return orders.groupBy(found.alias("disposition")).agg(F.count("*").alias("calls"))


def coerced(value: Column, allowed: tuple[str, ...], fallback: str) -> Column:
    clean = F.lower(F.trim(value))
    return F.when(clean.isin(*allowed), clean).otherwise(F.lit(fallback))


def enum_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    noisy = F.concat(F.lit(" "), F.upper("o_orderstatus"), F.lit("  "))
    return table(spark, sf_dir, "orders").groupBy(coerced(noisy, ("o", "f"), "other").alias("status")).agg(F.count("*").alias("n"))


def failure_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judged documents that fail: toxic is a violation, low quality an objective not achieved."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    objective = F.when(F.col("quality") == 1, "achieved").otherwise("not_achieved")
    fails = (F.col("toxic") == 1) | objective.isin("not_achieved", "partial")
    return rows.groupBy("lang").agg(F.count("*").alias("judged"), F.count_if(fails).alias("failed"), F.count_if((F.col("toxic") == 1)).alias("violations"))


def missing_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, vectors = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return docs.join(vectors, "doc_id", "left_anti").groupBy("lang").agg(F.count("*").alias("missing"))


DIMS = ("lang", "source", "quality", "toxic")


def lifted(rows: DataFrame, dims: tuple[str, ...] = DIMS, min_count: int = 2) -> DataFrame:
    """Combinations with count, lift over independent marginals and share within the first dimension.

    Counted before any window: the windows run over combinations, not rows.
    """
    combos = rows.groupBy(*dims).agg(F.count("*").alias("n"))
    total = F.sum("n").over(W.partitionBy(F.lit(1)))
    chance = F.lit(1.0)
    for d in dims:
        chance = chance * F.sum("n").over(W.partitionBy(d)) / total
    out = combos.withColumns({"lift": F.round(F.col("n") / (total * chance), 2), "consistency": F.round(F.col("n") / F.sum("n").over(W.partitionBy(dims[0])), 3)})
    return out.where(F.col("n") >= min_count)


def archetypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("quality"), F.col("toxic").cast("string").alias("toxic"))
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(judged, "doc_id", "left")
    return lifted(rows.withColumns({c: F.coalesce(c, F.lit("-")) for c in ("quality", "toxic")}))


def cluster_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster sizes with their first five members."""
    own = W.partitionBy("label").orderBy("vec_id")
    rows = table(spark, sf_dir, "embeddings").select("label", "vec_id").withColumn("r", F.row_number().over(own))
    shown = F.array_join(F.array_sort(F.collect_list(F.when(F.col("r") <= 5, F.col("vec_id")))), ",")
    return rows.groupBy("label").agg(F.count("*").alias("size"), shown.alias("exemplars"))


def scatter(spark: SparkSession, sf_dir: str, most: int = POINT_CAP) -> DataFrame:
    """Per cluster every (n // most + 1)-th point above ``most`` points."""
    own = W.partitionBy("label")
    rows = table(spark, sf_dir, "embeddings").withColumns({"r": F.row_number().over(own.orderBy("vec_id")) - 1, "n": F.count("*").over(own)})
    stride = F.floor(F.col("n") / most) + 1
    return rows.where(F.col("r") % F.when(F.col("n") > most, stride).otherwise(1) == 0).select("label", "vec_id", F.round(F.col("embedding")[0].cast("double"), 6).alias("x"))


def knn(spark: SparkSession, sf_dir: str, k: int = 5, every: int = 100) -> DataFrame:
    """The k nearest by cosine within the same cluster for each vector whose id is divisible by ``every``.

    A cluster's rows and queries are dealt in blocks; each pair of blocks is one
    matrix product and leaves k rows per query for the shuffle.
    """
    rows = table(spark, sf_dir, "embeddings").where(F.col("embedding").isNotNull()).select("label", "vec_id", "embedding")
    salt = F.xxhash64(F.lit(7), "vec_id")
    probe = F.col("vec_id") % every == 0
    sizes = rows.groupBy("label").agg(F.ceil(F.count("*") / KNN_ROWS).cast("int").alias("nr"), F.ceil(F.count_if(probe) / KNN_QUERIES).cast("int").alias("nq")).where("nq > 0")
    placed = rows.join(F.broadcast(sizes.withColumnRenamed("label", "_label")), F.col("label").eqNullSafe(F.col("_label")))
    each = placed.withColumns({"rb": F.pmod(salt, "nr").cast("int"), "qb": F.explode(F.sequence(F.lit(0), F.col("nq") - 1))}).select("label", "rb", "qb", "vec_id", "embedding", F.lit(False).alias("asks"))
    asked = placed.where(probe).withColumns({"qb": F.pmod(salt, "nq").cast("int"), "rb": F.explode(F.sequence(F.lit(0), F.col("nr") - 1))}).select("label", "rb", "qb", "vec_id", "embedding", F.lit(True).alias("asks"))

    def best_of_block(both: pd.DataFrame) -> pd.DataFrame:
        q, e, out = both[both["asks"]], both[~both["asks"]], []
        if len(q) and len(e):
            a, b = (np.array(x["embedding"].tolist(), np.float64) for x in (q, e))
            a, b = (x / np.where((n := np.sqrt((x * x).sum(1, keepdims=True))) == 0, 1, n) for x in (a, b))
            cosine, ids = np.round(a @ b.T, 6), e["vec_id"].to_numpy()
            for i, own in enumerate(q["vec_id"]):
                other = ids != own
                order = np.lexsort((ids[other], -cosine[i][other]))[:k]
                out += [(own, ids[other][j], cosine[i][other][j]) for j in order]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "cosine"])

    near = asked.unionByName(each).groupBy("label", "rb", "qb").applyInPandas(best_of_block, "query_id long, vec_id long, cosine double")
    best = W.partitionBy("query_id").orderBy(F.desc("cosine"), "vec_id")
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def props_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(n).alias("with_k"), F.sum(n).alias("sum_k"), F.max(n).alias("max_k"))


def sft_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One training row per assistant message: digests of what came before and of the reply."""
    rows = table(spark, sf_dir, "conversations")
    own = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, -1)
    before = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text")).over(own)), lambda m: F.concat(m.role, F.lit(":"), m.text))
    made = rows.withColumn("context", F.array_join(before, "\n")).where("role = 'assistant'")
    return made.select("conv_id", "turn", F.sha2("context", 256).alias("context_sha"), F.sha2("text", 256).alias("reply_sha"))


def dpo_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preference pairs: the corrected reply is preferred to the faulty one, found by a needle of its first 60 characters.

    The fault is the first assistant message that holds the needle; the context
    is what stands before it. Corrections stand in as the last reply with a prefix.
    """
    rows = table(spark, sf_dir, "conversations")
    talk = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    last = F.element_at(F.filter("m", lambda x: x.role == "assistant"), -1)
    needle = F.lower(F.substring(last.text, 1, 60))
    found = talk.where(F.exists("m", lambda x: x.role == "assistant")).withColumns({"observed": last.text, "needle": needle})
    hit = F.filter(F.transform("m", lambda x, i: F.when((x.role == "assistant") & F.contains(F.lower(x.text), F.col("needle")), i)), lambda i: i.isNotNull())
    placed = found.withColumn("at", F.coalesce(F.get(hit, F.lit(0)), F.size("m")))
    context = F.array_join(F.transform(F.slice("m", F.lit(1), F.col("at")), lambda x: F.concat(x.role, F.lit(":"), x.text)), "\n")
    return placed.select("conv_id", "at", F.sha2(context, 256).alias("prompt_sha"), F.sha2(F.concat(F.lit("fixed: "), "observed"), 256).alias("chosen_sha"), F.sha2("observed", 256).alias("rejected_sha"))


def sql_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the ad-hoc SQL surface promises: date_trunc, avg, percentile_cont, corr and regression."""
    e = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_id", "value", "event_type")
    k = (F.col("event_id") % 17).cast("double")
    return e.groupBy("event_type").agg(
        F.round(F.avg("value"), 6).alias("mean"),
        F.round(F.percentile("value", 0.95), 6).alias("p95_cont"),
        F.round(F.corr("value", k), 6).alias("corr"),
        F.round(F.regr_slope("value", k), 6).alias("slope"),
        F.round(F.regr_r2("value", k), 6).alias("r2"),
        F.countDistinct(F.date_trunc("day", "ts")).alias("days"),
    )


QUERIES = {
    "transcript_lines": transcript_lines,
    "turn_pairing": turn_pairing,
    "conversation_messages": messages,
    "disposition_rules": dispositions,
    "enum_coercion": enum_coercion,
    "failure_gate": failure_gate,
    "missing_embeddings": missing_embeddings,
    "archetype_lift": archetypes,
    "cluster_sizes": cluster_sizes,
    "scatter_stride": scatter,
    "knn_cosine": knn,
    "json_attr_extract": props_extract,
    "sft_rows": sft_rows,
    "dpo_rows": dpo_rows,
    "agent_sql_stats": sql_daily,
}

ORACLE_SQL = {
    "transcript_lines": """select conv_id, cast(row_number() over (partition by conv_id order by turn) - 1 as integer) as line,
case when role = 'user' then 'caller' else 'agent' end || ': ' || text as said from conversations where role <> 'system' and trim(text) <> ''""",
    "turn_pairing": """with a as (select *, lag(role) over w as before, lag(turn) over w as heard, lead(role) over w as after from conversations where role in ('user', 'assistant') window w as (partition by conv_id order by turn)),
b as (select conv_id, case when role = 'assistant' and before = 'user' then heard when role = 'user' then turn end as caller_turn, case when role = 'assistant' then turn end as agent_turn from a where role = 'assistant' or after is null)
select conv_id, cast(row_number() over (partition by conv_id order by coalesce(agent_turn, caller_turn)) - 1 as integer) as turn_index, caller_turn, agent_turn from b""",
    "conversation_messages": "select conv_id, count(*) as messages, sha256(string_agg(role || '|' || text, chr(10) order by turn)) as sha from conversations where trim(text) <> '' group by 1",
    "disposition_rules": """select case when o_orderpriority like '1%' then 'connected' when o_orderstatus = 'F' or o_orderkey % 4 = 0 then 'no_answer' else 'unknown' end as disposition, count(*) as calls from orders group by 1""",
    "enum_coercion": "select case when lower(o_orderstatus) in ('o', 'f') then lower(o_orderstatus) else 'other' end as status, count(*) as n from orders group by 1",
    "failure_gate": """select lang, count(*) as judged, count(*) filter (toxic = 1 or quality <> 1) as failed, count(*) filter (toxic = 1) as violations from labels join documents using (doc_id) group by 1""",
    "missing_embeddings": "select lang, count(*) as missing from documents where doc_id not in (select vec_id from embeddings) group by 1",
    "archetype_lift": """with r as (select lang, source, coalesce(cast(quality as varchar), '-') as quality, coalesce(cast(toxic as varchar), '-') as toxic from documents left join labels using (doc_id)),
c as (select lang, source, quality, toxic, count(*) as n from r group by 1, 2, 3, 4),
w as (select *, sum(n) over () as t, sum(n) over (partition by lang) as a, sum(n) over (partition by source) as b, sum(n) over (partition by quality) as q, sum(n) over (partition by toxic) as x from c)
select lang, source, quality, toxic, n, round(n / (t * (1.0 * a / t * b / t * q / t * x / t)), 2) as lift, round(n / a, 3) as consistency from w where n >= 2""",
    "cluster_sizes": """select label, count(*) as size, array_to_string(list_slice(list(vec_id order by vec_id), 1, 5), ',') as exemplars from embeddings group by 1""",
    "scatter_stride": """with a as (select *, row_number() over (partition by label order by vec_id) - 1 as r, count(*) over (partition by label) as n from embeddings)
select label, vec_id, round(cast(embedding[1] as double), 6) as x from a where r % case when n > 3000 then n // 3000 + 1 else 1 end = 0""",
    "knn_cosine": """with s as (select p.vec_id as query_id, e.vec_id, round(list_cosine_similarity(cast(p.embedding as double[]), cast(e.embedding as double[])), 6) as cosine
from embeddings p join embeddings e on p.label = e.label and p.vec_id <> e.vec_id where p.vec_id % 100 = 0)
select query_id, vec_id, cosine, cast(rank as integer) as rank from (select *, row_number() over (partition by query_id order by cosine desc, vec_id) as rank from s) where rank <= 5""",
    "json_attr_extract": """select event_type, count(json_extract(props, '$.k')) as with_k, sum(cast(json_extract(props, '$.k') as bigint)) as sum_k, max(cast(json_extract(props, '$.k') as bigint)) as max_k from events group by 1""",
    "sft_rows": """select conv_id, turn, sha256(coalesce((select string_agg(b.role || ':' || b.text, chr(10) order by b.turn) from conversations b where b.conv_id = a.conv_id and b.turn < a.turn), '')) as context_sha,
sha256(text) as reply_sha from conversations a where role = 'assistant'""",
    "dpo_rows": """with n as (select *, row_number() over (partition by conv_id order by turn) - 1 as i, count(*) over (partition by conv_id) as c from conversations),
l as (select conv_id, max_by(text, turn) as observed, any_value(c) as c from n where role = 'assistant' group by 1),
f as (select l.*, coalesce((select min(i) from n where n.conv_id = l.conv_id and role = 'assistant' and contains(lower(text), lower(substr(observed, 1, 60)))), c) as "at" from l)
select conv_id, cast(f.at as integer) as "at", sha256(coalesce((select string_agg(role || ':' || text, chr(10) order by i) from n where n.conv_id = f.conv_id and i < f.at), '')) as prompt_sha,
sha256('fixed: ' || observed) as chosen_sha, sha256(observed) as rejected_sha from f""",
    "agent_sql_stats": """select event_type, round(avg(value), 6) as mean, round(quantile_cont(value, 0.95), 6) as p95_cont, round(corr(value, event_id % 17), 6) as corr,
round(regr_slope(value, event_id % 17), 6) as slope, round(regr_r2(value, event_id % 17), 6) as r2, count(distinct date_trunc('day', ts)) as days from events group by 1""",
}
