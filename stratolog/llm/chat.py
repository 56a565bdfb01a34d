"""Chat formatting by event sourcing, in built-in functions only.

A log of events (conversation, seq, message, kind, role, text) is folded to final messages: 'delta'
appends its text, 'edit' replaces all before it, 'regenerate' starts the message anew with its text.
The messages are rendered in the order of their first event and can be read back exactly.

Null text and role count as empty; an empty log gives an empty table; events with equal seq are taken in
the order of kind, role and text; repeated rows are events of their own. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A turn is HEAD role MIDDLE text END. The escapes leave no '#', '<' or lone '\' in a text, nor ':' in a role.
HEAD, MIDDLE, END = "### ", ": ", " </turn>\n"
_ESCAPES = (("\\", "\\\\"), ("<", "\\l"), ("#", "\\h"), (":", "\\c"))
LOSS_ROLE = "assistant"


def escape(c: Column, role: bool = False) -> Column:
    for plain, coded in _ESCAPES[: 3 + role]:
        c = F.replace(c, F.lit(plain), F.lit(coded))
    return c


def unescape(c: Column) -> Column:
    """Undo escape: between doubled backslashes, which stand for themselves, each pair is unambiguous."""

    def part(x: Column) -> Column:
        for plain, coded in _ESCAPES[1:]:
            x = F.replace(x, F.lit(coded), F.lit(plain))
        return x

    return F.array_join(F.transform(F.split(c, "\\\\\\\\"), part), "\\")


def fold_events(events: DataFrame) -> DataFrame:
    """(conv_id, message, first_seq, role, text): each message's final state.

    Only the events since a message's last edit or regeneration are gathered, per message.
    """
    e = events.select("conv_id", "message", "seq", "kind", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = F.struct("seq", "kind", "role", "text")
    by = Window.partitionBy("conv_id", "message")
    reset = F.max(F.when(F.col("kind").isin("edit", "regenerate"), order)).over(by)
    kept = e.withColumns({"_order": order, "_reset": reset, "_first": F.min(order).over(by)}).filter(F.col("_reset").isNull() | (F.col("_order") >= F.col("_reset")))
    parts = F.sort_array(F.collect_list("_order"))
    return kept.groupBy("conv_id", "message").agg(F.min("_first").alias("_first"), F.array_join(F.transform(parts, lambda x: x["text"]), "").alias("text")).select("conv_id", "message", F.col("_first.seq").alias("first_seq"), F.col("_first.role").alias("role"), "text")


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, n_turns, formatted, loss_spans): loss_spans are (turn, start, length) in code points.

    start counts within the rendered turn, so that reading the spans back is linear.
    """
    role, text = escape(F.col("role"), role=True), escape(F.col("text"))
    head = F.concat(F.lit(HEAD), role, F.lit(MIDDLE))
    turn = F.struct("first_seq", "message", F.concat(head, text, F.lit(END)).alias("turn"), (F.col("role") == LOSS_ROLE).alias("loss"), F.length(head).alias("start"), F.length(text).alias("length"))
    t = F.col("_turns")
    spans = F.filter(F.transform(t, lambda x, i: F.struct(i.alias("turn"), x["start"].alias("start"), x["length"].alias("length"), x["loss"].alias("loss"))), lambda x: x["loss"])
    return (
        messages.groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(turn)).alias("_turns"))
        .select("conv_id", F.size(t).cast("long").alias("n_turns"), F.array_join(F.transform(t, lambda x: x["turn"]), "").alias("formatted"), F.transform(spans, lambda x: F.struct(x["turn"].alias("turn"), x["start"].alias("start"), x["length"].alias("length"))).alias("loss_spans"))
    )


def read_back(rendered: DataFrame) -> DataFrame:
    """(conv_id, turns, loss_text, formatted) from the rendered string and its loss spans alone."""
    raw = F.split("formatted", END)
    body = lambda x: F.substr(x, F.lit(len(HEAD) + 1))
    at = lambda x: F.locate(MIDDLE, x)
    turn = lambda x: F.struct(unescape(F.substr(x, F.lit(1), at(x) - 1)).alias("role"), unescape(F.substr(x, at(x) + len(MIDDLE))).alias("text"))
    df = rendered.withColumn("_raw", F.filter(raw, lambda x: x != ""))
    loss = F.transform("loss_spans", lambda s: unescape(F.substr(F.get(F.col("_raw"), s["turn"]), s["start"] + 1, s["length"])))
    return df.select("conv_id", F.transform("_raw", lambda x: turn(body(x))).alias("turns"), F.array_join(loss, "").alias("loss_text"), "formatted")


def query(spark: SparkSession, sf: str) -> DataFrame:
    """Every row of conversations as one message, in the order of turn, role and text."""
    said = "\\### Assistant: </turn> ok"
    rows = spark.read.schema("conv_id long, turn long, role string, text string").parquet(f"{sf}/conversations.parquet")
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    events = rows.unionByName(more).select("conv_id", F.row_number().over(order).alias("message"), F.lit("delta").alias("kind"), "role", "text").withColumn("seq", F.col("message"))
    back = read_back(render(fold_events(events)))
    said_all = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said_all, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role,'') r, coalesce(text,'') t FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, replace(replace(replace(t,'\','\\'),'<','\l'),'#','\h') et,
  replace(replace(replace(replace(r,'\','\\'),'<','\l'),'#','\h'),':','\c') er FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r||chr(10)||t||chr(10), '' ORDER BY turn, r, t)) AS turns_sha256,
 CAST(coalesce(sum(CASE WHEN r='assistant' THEN length(t) END),0) AS bigint) AS loss_chars,
 sha256(coalesce(string_agg(t, '' ORDER BY turn, r, t) FILTER (WHERE r='assistant'),'')) AS loss_sha256,
 CAST(sum(4+length(er)+2+length(et)+9) AS bigint) AS formatted_chars
FROM e GROUP BY conv_id"""
