"""Remote batch requests as tables.

The request file and the result file of a chat-completion batch service are
plain JSON-lines tables: building them is ``to_json`` of a struct, reading
them back is ``from_json``; no network client is involved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curatio.functions.text import strip

ENDPOINT = "/v1/chat/completions"

RESPONSE_SCHEMA = T.StructType([
    T.StructField("custom_id", T.StringType()),
    T.StructField("response", T.StructType([T.StructField("body", T.StructType([
        T.StructField("choices", T.ArrayType(T.StructType([
            T.StructField("message", T.StructType([T.StructField("content", T.StringType())]))])))]))])),
])


def build_request(df: DataFrame, id_col: str, content_col: str, model: str, max_tokens: int) -> DataFrame:
    """one request per row, ``custom_id = id_<n>``, plus its JSON line."""
    body = F.struct(F.lit(model).alias("model"),
                    F.array(F.struct(F.lit("user").alias("role"), F.col(content_col).alias("content"))).alias("messages"),
                    F.lit(int(max_tokens)).alias("max_tokens"))
    out = df.select(F.concat(F.lit("id_"), F.col(id_col).cast("string")).alias("custom_id"),
                    F.lit("POST").alias("method"), F.lit(ENDPOINT).alias("url"), body.alias("body"))
    return out.withColumn("line", F.to_json(F.struct("custom_id", "method", "url", "body")))


def request_content(body) -> Column:
    b = F.col(body) if isinstance(body, str) else body
    return F.get(b["messages"], 0)["content"]


def fake_batch_response(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The JSON line a batch service returns for a row (for tests and
    adapters): ``{"custom_id": "id_<n>", "response": {"body": {"choices": [...]}}}``."""
    msg = F.struct(F.struct(F.col(text_col).alias("content")).alias("message"))
    resp = F.struct(F.struct(F.array(msg).alias("choices")).alias("body"))
    return df.select(F.to_json(F.struct(F.concat(F.lit("id_"), F.col(id_col).cast("string")).alias("custom_id"),
                                        resp.alias("response"))).alias("line"))


def parse_response(df: DataFrame, line: str = "line", stop: str | None = None) -> DataFrame:
    """id = text after the first ``_`` of ``custom_id``; output = first
    choice's content, cut before the stop marker and stripped."""
    p = F.from_json(F.col(line), RESPONSE_SCHEMA)
    content = F.get(p["response"]["body"]["choices"], 0)["message"]["content"]
    if stop is not None:
        content = strip(F.substring_index(content, stop, 1))
    return df.select(F.regexp_extract(p["custom_id"], r"^[^_]*_(.*)$", 1).alias("id"), content.alias("output"))
