"""Text leaves of nested chat documents, and their way back into the document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: A request's typed part. ``content`` is text or a list of parts, so it is read as raw JSON.
REQUEST = (
    "model string, stream boolean, temperature float, max_tokens bigint, messages array<struct<role:string,content:string,reasoning_content:string,"
    "tool_calls:array<struct<id:string,type:string,function:struct<name:string,arguments:string>>>,tool_call_id:string,name:string>>"
)
PARTS = "array<struct<type:string,text:string>>"


def parse(df: DataFrame, body: str = "body", longest: int = 8 << 20) -> DataFrame:
    """``df`` with ``request`` (null if not a JSON object with messages) and ``error`` (TooLarge, BadRequest or null)."""
    parsed = F.from_json(body, REQUEST)
    ok = F.try_parse_json(body).isNotNull() & parsed["messages"].isNotNull()
    error = F.when(F.octet_length(body) > longest, "TooLarge").when(~F.coalesce(ok, F.lit(False)), "BadRequest")
    return df.withColumn("request", F.when(error.isNull(), parsed)).withColumn("error", error)


def chat_fields(df: DataFrame, key: str, request: str = "request") -> DataFrame:
    """One row per text leaf, in the order content or text parts, reasoning, tool arguments of each message."""
    m = df.select(key, F.posexplode(F.col(request)["messages"]).alias("msg_idx", "m"))
    text_parts = F.from_json(F.when(F.col("m.content").startswith("["), F.col("m.content")), PARTS)

    def leaf(channel: str, idx: Column, text: Column) -> Column:
        return F.struct(F.lit(channel).alias("channel"), idx.cast("int").alias("idx"), text.alias("text"))

    whole = F.array(leaf("content", F.lit(0), F.when(text_parts.isNull(), F.col("m.content"))))
    parts = F.transform(text_parts, lambda p, i: leaf("part", i, F.when(p["type"] == "text", p["text"])))
    reasoning = F.array(leaf("reasoning", F.lit(0), F.col("m.reasoning_content")))
    tools = F.transform("m.tool_calls", lambda c, i: leaf("tool_args", i, c["function"]["arguments"]))
    empty = F.array().cast("array<struct<channel:string,idx:int,text:string>>")
    leaves = F.concat(whole, F.coalesce(parts, empty), reasoning, F.coalesce(tools, empty))
    rows = m.select(key, "msg_idx", F.posexplode(F.filter(leaves, lambda x: x["text"].isNotNull())).alias("leaf_idx", "leaf"))
    return rows.select(key, "msg_idx", "leaf_idx", "leaf.channel", "leaf.idx", "leaf.text")


def prompt_fields(df: DataFrame, key: str, prompt: str = "prompt") -> DataFrame:
    """Leaves of a legacy prompt: one text, or a JSON list of texts."""
    many = F.from_json(F.when(F.col(prompt).startswith("["), F.col(prompt)), "array<string>")
    return df.select(key, F.posexplode(F.coalesce(many, F.array(prompt))).alias("idx", "text")).filter(F.col("text").isNotNull())


def response_fields(df: DataFrame, key: str, body: str = "body") -> DataFrame:
    """(key, choice, channel, idx, text) of ``choices[].message`` (text or text parts, reasoning, tool arguments) and of
    legacy ``choices[].text``; a body of another shape has none and passes through as it is."""
    shape = (
        "choices array<struct<message:struct<content:string,reasoning_content:string,tool_calls:array<struct<function:struct<arguments:string>>>>,text:string>>"
    )
    c = df.select(key, F.posexplode(F.from_json(body, shape)["choices"]).alias("choice", "c"))
    parts = F.from_json(F.when(F.col("c.message.content").startswith("["), F.col("c.message.content")), PARTS)

    def leaf(channel: str, idx: Column, text: Column) -> Column:
        return F.struct(F.lit(channel).alias("channel"), idx.cast("int").alias("idx"), text.alias("text"))

    empty = F.array().cast("array<struct<channel:string,idx:int,text:string>>")
    leaves = F.concat(
        F.array(leaf("content", F.lit(0), F.when(parts.isNull(), F.col("c.message.content")))),
        F.coalesce(F.transform(parts, lambda p, i: leaf("part", i, F.when(p["type"] == "text", p["text"]))), empty),
        F.array(leaf("reasoning", F.lit(0), F.col("c.message.reasoning_content"))),
        F.coalesce(F.transform("c.message.tool_calls", lambda t, i: leaf("tool_args", i, t["function"]["arguments"])), empty),
        F.array(leaf("legacy", F.lit(0), F.col("c.text"))),
    )
    return c.select(key, "choice", F.inline(F.filter(leaves, lambda x: x["text"].isNotNull())))


def audit_fields(df: DataFrame, key: str, request: str = "request") -> DataFrame:
    """The leaves of ``chat_fields`` in the order of an audit: content, then tool arguments, then reasoning of each message."""
    rank = F.when(F.col("channel") == "tool_args", 1).when(F.col("channel") == "reasoning", 2).otherwise(0)
    order = W.partitionBy(key, "msg_idx").orderBy(rank, "leaf_idx")
    return chat_fields(df, key, request).withColumn("leaf_idx", F.row_number().over(order) - 1)


def legacy_requests(df: DataFrame, body: str = "body") -> DataFrame:
    """``df`` with ``prompt`` (raw JSON text or list), and ``error``: BadRequest for no JSON, no prompt, or ``stream`` set."""
    parsed = F.from_json(body, "prompt string, stream boolean")
    bad = F.try_parse_json(body).isNull() | parsed["prompt"].isNull() | F.coalesce(parsed["stream"], F.lit(False))
    error = F.when(F.coalesce(bad, F.lit(True)), "BadRequest")
    return df.withColumn("prompt", F.when(error.isNull(), parsed["prompt"])).withColumn("error", error)


def json_strings(body: Column) -> Column:
    """Every string value of a JSON text at any depth, in order, without object keys; none if it is no JSON."""
    literal = r'"(?:[^"\\]|\\.)*+"(?:\s*:)?+'
    values = F.filter(F.regexp_extract_all(body, F.lit(literal), F.lit(0)), lambda x: ~x.endswith(":"))
    decoded = F.transform(values, lambda x: F.try_variant_get(F.try_parse_json(x), "$", "string"))
    return F.when(F.try_parse_json(body).isNotNull(), decoded).otherwise(F.array().cast("array<string>"))


_OBJECT = "map<string,variant>"


def _object(v: Column) -> Column:
    return F.try_variant_get(v, "$", _OBJECT)


def _objects(v: Column) -> Column:
    return F.try_variant_get(v, "$", f"array<{_OBJECT}>")


def _new_message(message: Column, texts: Column, at: Column) -> Column:
    """A message (a map of variants) with its leaves taken from ``texts`` (place/channel/idx to text); all else stays."""

    def text(channel: str, idx: Column) -> Column:
        return F.try_element_at(texts, F.concat_ws("/", at.cast("string"), F.lit(channel), idx.cast("string")))

    def put(v: Column, new: Column) -> Column:
        return F.coalesce(new.cast("variant"), v)

    def parts(v: Column) -> Column:
        each = F.transform(_objects(v), lambda p, i: F.transform_values(p, lambda k, x: F.when(k == "text", put(x, text("part", i))).otherwise(x)))
        return F.to_variant_object(each)

    def calls(v: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            def function(f: Column) -> Column:
                new = F.transform_values(_object(f), lambda k, x: F.when(k == "arguments", put(x, text("tool_args", i))).otherwise(x))
                return F.coalesce(F.to_variant_object(new), f)

            return F.transform_values(c, lambda k, x: F.when(k == "function", function(x)).otherwise(x))

        return F.to_variant_object(F.transform(_objects(v), one))

    return F.transform_values(
        message,
        lambda k, v: F.when(k == "content", F.coalesce(parts(v), put(v, text("content", F.lit(0)))))
        .when(k == "reasoning_content", put(v, text("reasoning", F.lit(0))))
        .when(k == "tool_calls", F.coalesce(calls(v), v)).when(k == "text", put(v, text("legacy", F.lit(0)))).otherwise(v),
    )


def _with_list(body: Column, name: str, change) -> Column:
    top = _object(F.try_parse_json(body))
    new = F.transform_values(top, lambda k, v: F.when(k == name, F.coalesce(F.to_variant_object(F.transform(_objects(v), change)), v)).otherwise(v))
    return F.to_json(new)


def with_texts(body: Column, texts: Column) -> Column:
    """A request with leaves of its messages replaced in place; ``texts`` maps msg_idx/channel/idx, as ``chat_fields``
    names them, to new text. Leaves not named, other parts and unknown fields stay; null if the body is no JSON object."""
    return _with_list(body, "messages", lambda m, i: _new_message(m, texts, i))


def with_response_texts(body: Column, texts: Column) -> Column:
    """A response with leaves of its choices replaced in place; ``texts`` maps choice/channel/idx to new text."""

    def choice(c: Column, i: Column) -> Column:
        def message(v: Column) -> Column:
            return F.coalesce(F.to_variant_object(_new_message(_object(v), texts, i)), v)

        return F.transform_values(c, lambda k, v: F.when(k == "message", message(v)).when(k == "text", F.coalesce(F.try_element_at(texts, F.concat_ws("/", i.cast("string"), F.lit("legacy"), F.lit("0"))).cast("variant"), v)).otherwise(v))

    return _with_list(body, "choices", choice)


def mask_requests(df: DataFrame, key: str, secret: bytes, body: str = "body", disabled: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(key, body, error, quasi_flagged) with every text leaf of the chat requests masked in place, and the requests' registry.

    Bodies that can't be parsed keep their error and have no masked body.
    """
    from maskloom.operators import detect

    parsed = parse(df, body)
    leaves = chat_fields(parsed, key).withColumn("field", F.struct(key, "msg_idx", "channel", "idx"))
    masked = detect.mask(leaves.withColumn("flag", detect.gauge(F.col("text")) > 0.5), secret, disabled=disabled)
    name = F.concat_ws("/", "msg_idx", "channel", "idx")
    per = masked.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(name, "text"))).alias("texts"), F.bool_or("flag").alias("quasi_flagged"))
    joined = parsed.join(per, key, "left")
    none = F.create_map().cast("map<string,string>")
    new = F.when(F.col("error").isNull(), with_texts(F.col(body), F.coalesce("texts", none)))
    book = detect.registry(leaves, secret, "field", disabled=disabled)
    book = book.select(F.col("request_id")[key].alias("request_id"), "token", "kind", "value").distinct()
    return joined.select(key, new.alias(body), "error", F.coalesce("quasi_flagged", F.lit(False)).alias("quasi_flagged")), book
