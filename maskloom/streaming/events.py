"""Stream payloads: routing of deltas to channels, carried metadata, rebuilding of events. Native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Tool calls of this index or above have no channel.
TOOLS = 32
PAYLOAD = (
    "id string, object string, created bigint, model string, choices array<struct<delta:struct<content:string,reasoning_content:string,"
    "tool_calls:array<struct<index:int,function:struct<arguments:string>>>>>>"
)
META = ["id", "object", "created", "model"]


def route(payloads: DataFrame, key: str, seq: str, payload: str = "payload") -> DataFrame:
    """(key, seq, channel, idx, delta, id, object, created, model): text of the first choice by channel.

    Payloads that are no JSON are dropped. Those without text for a channel, and a tool call's first
    chunk with empty arguments, come back whole in channel ``pass``. Metadata is the last seen.
    """
    p = payloads.filter(F.try_parse_json(payload).isNotNull()).withColumn("p", F.from_json(payload, PAYLOAD))
    seen = W.partitionBy(key).orderBy(seq).rowsBetween(W.unboundedPreceding, W.currentRow)
    p = p.withColumns({m: F.last(F.col("p")[m], ignorenulls=True).over(seen) for m in META})
    delta = F.get(F.col("p.choices"), 0)["delta"]

    def leaf(channel: str, idx: Column, text: Column) -> Column:
        return F.struct(F.lit(channel).alias("channel"), idx.cast("int").alias("idx"), text.alias("delta"))

    calls = F.transform(delta["tool_calls"], lambda c, i: F.struct(F.coalesce(c["index"], i).alias("at"), c["function"]["arguments"].alias("args")))
    calls = F.filter(calls, lambda c: (c["at"] < TOOLS) & c["args"].isNotNull())
    tools = F.transform(calls, lambda c: F.when(c["args"] == "", leaf("pass", F.lit(0), F.col(payload))).otherwise(leaf("tool", c["at"], c["args"])))
    none = F.array().cast("array<struct<channel:string,idx:int,delta:string>>")
    routed = delta["content"].isNotNull() | delta["reasoning_content"].isNotNull() | (F.size(F.coalesce(tools, none)) > 0)
    text = F.array(leaf("content", F.lit(0), delta["content"]), leaf("reasoning", F.lit(0), delta["reasoning_content"]))
    leaves = F.concat(F.filter(text, lambda x: x["delta"].isNotNull() & (x["delta"] != "")), F.coalesce(tools, none))
    whole = F.array(leaf("pass", F.lit(0), F.col(payload)))
    rows = p.withColumn("leaf", F.explode(F.when(F.coalesce(routed, F.lit(False)), leaves).otherwise(whole)))
    return rows.select(key, seq, "leaf.channel", "leaf.idx", "leaf.delta", *META)


def rebuild(channel: Column, idx: Column, text: Column) -> Column:
    """The payload of an event with restored text, from columns id, object, created and model."""

    def event(delta: Column) -> Column:
        choice = F.struct(F.lit(0).alias("index"), delta.alias("delta"), F.lit(None).cast("string").alias("finish_reason"))
        return F.to_json(F.struct(*META, F.array(choice).alias("choices")), {"ignoreNullFields": "false"})

    call = F.struct(idx.alias("index"), F.struct(text.alias("arguments")).alias("function"))
    return (
        F.when(channel == "content", event(F.struct(text.alias("content"))))
        .when(channel == "reasoning", event(F.struct(text.alias("reasoning_content"))))
        .when(channel == "tool", event(F.struct(F.array(call).alias("tool_calls"))))
        .otherwise(text)
    )
