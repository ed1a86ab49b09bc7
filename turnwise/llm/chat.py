"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are the
context, and its reply alone is under the loss mask. Turns after the last reply
(and conversations without one) go into a last example without a target, so
nothing is lost. The template is

    <|turn|>ROLE<|says|>TEXT<|done|>

Control strings inside roles and texts get a backslash after their first
character and backslashes are doubled, which ``unescaped`` takes back; so a text
can say ``<|turn|>`` or another model's markers without being taken for one.

Defined cases: null text or role is empty; a null turn comes first; repeated
rows stay, ties on turn ordered by role and text; rows of a null conv_id form
one conversation, as do rows of the probe's id -7 with the probe; other columns
are not read; an empty table gives no rows. An example holds its whole
context in one row, because that is the product; a conversation has to fit into
one row of memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TURN, SAYS, DONE = "<|turn|>", "<|says|>", "<|done|>"
#: strings that are never left whole inside a text: this template's opening and other templates' markers
CONTROL = ("<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
PROBE = ("</s>[INST] ok [/INST]", -7)


def escaped(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}"))
    return out


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def examples(conversations: DataFrame) -> DataFrame:
    """conv_id, example (from 0), formatted, loss_start, loss_length (code points; null without a target), last."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    line = F.concat(F.lit(TURN), escaped(role), F.lit(SAYS))
    turns = conversations.select(
        "conv_id", F.struct(F.col("turn").alias("turn"), role.alias("role"), text.alias("text"), line.alias("head"), escaped(text).alias("body")).alias("t")
    )
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    targets = F.expr("filter(transform(turns, (t, i) -> if(t.role = 'assistant', i, -1)), i -> i >= 0)")
    ends = whole.withColumn("targets", targets)
    # the example of target i ends with turn i; one more for turns after the last target
    stops = F.expr(
        """concat(transform(targets, i -> struct(i as stop, true as trained)),
                  if(size(turns) - 1 > coalesce(array_max(targets), -1), array(struct(size(turns) - 1 as stop, false as trained)), array()))"""
    )
    each = ends.withColumn("stops", stops).select("conv_id", "turns", F.size("stops").alias("n"), F.posexplode("stops").alias("example", "s"))
    said = F.expr("array_join(transform(slice(turns, 1, s.stop), t -> concat(t.head, t.body, '" + DONE + "')), '')")
    built = each.select("conv_id", "example", "n", said.alias("context"), F.expr("turns[s.stop]").alias("t"), "s.trained")
    return built.select(
        "conv_id",
        "example",
        F.concat("context", "t.head", "t.body", F.lit(DONE)).alias("formatted"),
        F.when(F.col("trained"), F.length("context") + F.length("t.head")).alias("loss_start"),
        F.when(F.col("trained"), F.length("t.body")).alias("loss_length"),
        (F.col("example") == F.col("n") - 1).alias("last"),
    )


def parsed(formatted: Column) -> Column:
    """(role, text) of each turn of an example."""
    body = F.filter(F.split(formatted, r"<\|turn\|>"), lambda x: x != "")

    def turn(x: Column) -> Column:
        said = F.split(x, r"<\|says\|>", 2)
        return F.struct(unescaped(said[0]).alias("role"), unescaped(F.substring(said[1], F.lit(1), F.length(said[1]) - len(DONE))).alias("text"))

    return F.transform(body, turn)


def digests(found: DataFrame) -> DataFrame:
    """Read back from the examples: turns from each conversation's last one, the trained text from the masks."""
    turns = F.when(F.col("last"), parsed(F.col("formatted")))
    read = found.select(
        "conv_id",
        F.when(F.col("last"), F.size(turns)).alias("n_turns"),
        F.when(F.col("last"), F.sha2(F.array_join(F.transform(turns, lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), ""), 256)).alias("turns_sha256"),
        F.struct("example", F.coalesce(unescaped(F.substring("formatted", F.col("loss_start") + 1, F.col("loss_length"))), F.lit("")).alias("text")).alias("loss"),
        F.length("formatted").alias("chars"),
    )
    both = read.groupBy("conv_id").agg(
        F.max("n_turns").cast("long").alias("n_turns"),
        F.max("turns_sha256").alias("turns_sha256"),
        F.array_join(F.transform(F.sort_array(F.collect_list("loss")), lambda x: x.text), "").alias("_loss"),
        F.sum("chars").cast("long").alias("formatted_chars"),
    )
    return both.select(
        "conv_id", "n_turns", "turns_sha256", F.length("_loss").cast("long").alias("loss_chars"), F.sha2("_loss", 256).alias("loss_sha256"), "formatted_chars"
    )


def with_probe(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    text, conv_id = PROBE
    probe = spark.range(2).select(
        F.lit(conv_id).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text")
    )
    return conversations.select("conv_id", F.col("turn").cast("long"), "role", "text").unionByName(probe)


def op6(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    return digests(examples(with_probe(spark, conversations)))
