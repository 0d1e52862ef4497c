"""Decoding model responses: a fence stripped, JSON rescued from prose, an envelope or a bare array, items one by one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fields of a finding as a response gives it: name, JSON type, whether it must be there.
FIELDS = [
    ("severity", "string", False), ("category", "string", False), ("title", "string", True), ("explanation", "string", False), ("path", "string", True), ("line_start", "integer", True), ("line_end", "integer", True),
    ("confidence", "number", False), ("evidence", "array", False), ("suggested_fix", "string", False), ("improved_code", "string", False)]
ITEM = "struct<path:string,line_start:int,line_end:int,title:string,suggested_fix:string,improved_code:string>"


def draft_schema() -> dict:
    """JSON schema of the envelope that ``decode`` takes, for providers that generate against one; made from ``FIELDS``."""
    item = {"type": "object", "properties": {n: {"type": t} | ({"minimum": 1} if t == "integer" else {}) for n, t, _ in FIELDS}, "required": [n for n, _, must in FIELDS if must]}
    return {"type": "object", "properties": {"findings": {"type": "array", "items": item}}, "required": ["findings"]}


def unfenced(payload: Column | str) -> Column:
    p = F.trim(F.col(payload) if isinstance(payload, str) else payload)
    body = F.regexp_extract(p, r"(?s)^```(?:json)?\s*\n(.*?)\n?\s*```$", 1)
    return F.when(p.rlike(r"(?s)^```(?:json)?\s*\n.*\n?\s*```$"), F.trim(body)).otherwise(p)


def rescued(text: Column) -> Column:
    """The text itself if it is JSON, else what lies between its first and last brace if that is, else null."""
    inner = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    is_json = lambda c: F.try_parse_json(c).isNotNull()
    return F.when(is_json(text), text).when((inner != "") & is_json(inner), inner)


def decode(responses: DataFrame, payload: str = "payload") -> DataFrame:
    """Adds ``entries`` (array of items as JSON text) and ``reject`` (why there are none)."""
    r = responses.withColumn("_t", unfenced(payload)).withColumn("_j", rescued(F.col("_t")))
    shape = F.schema_of_variant(F.try_parse_json("_j"))
    inner = F.expr("try_variant_get(try_parse_json(_j), '$.findings', 'variant')")
    inner_shape = F.schema_of_variant(inner)
    array_text = F.when(shape.startswith("ARRAY"), F.col("_j")).when(inner_shape.startswith("ARRAY"), F.expr("to_json(try_variant_get(try_parse_json(_j), '$.findings', 'variant'))"))
    entries = F.transform(F.expr("cast(try_parse_json(_a) as array<variant>)"), lambda v: F.to_json(v))
    reject = (F.when(F.coalesce("_t", F.lit("")) == "", "empty response").when(F.col("_j").isNull(), "invalid JSON").when(shape.startswith("ARRAY"), F.lit(None))
              .when(~shape.startswith("OBJECT"), "not an object").when(inner.isNull() | F.coalesce(inner_shape == "VOID", F.lit(False)), "no findings key").when(~inner_shape.startswith("ARRAY"), "findings is no array"))
    return r.withColumns({"_a": array_text, "reject": reject}).withColumn("entries", F.when(F.col("reject").isNull(), entries)).drop("_t", "_j", "_a")


def items(decoded: DataFrame, key: str, allowed: str | None = None, refused: bool = False) -> DataFrame:
    """One row per entry: its fields, or why it was rejected.

    With ``refused``, responses without entries give a row with their reason.  ``allowed`` names an array of the paths that a response may speak of; null allows all.  A line range that runs backwards ends where it starts; code without an explanation is dropped and the finding stays.
    """
    paths = F.col(allowed) if allowed else F.lit(None).cast("array<string>")
    # Filters come behind the explosion, where they are not pushed into the parsing and do not repeat it.
    e = decoded.select(key, "reject", paths.alias("_allowed"), F.posexplode_outer("entries").alias("ordinal", "entry"))
    e = e.filter("entry is not null or reject is not null" if refused else "entry is not null").withColumn("f", F.from_json("entry", ITEM))
    missing = lambda c: F.col(f"f.{c}").isNull()
    why = F.when(F.col("entry").isNull(), F.col("reject")).when(~F.col("entry").startswith("{"), "expected an object").when(missing("path"), "path: missing").when(missing("line_start") | missing("line_end"), "lines: missing").when(F.col("f.line_start") < 1, "line_start: below 1").when(missing("title"), "title: missing").when(~F.array_contains("_allowed", F.col("f.path")), "path: not under review")
    ok = F.col("reason").isNull()
    return e.withColumn("reason", why).select(key, "ordinal", F.when(ok, F.col("f.path")).alias("path"), F.when(ok, F.col("f.line_start")).alias("line_start"), F.when(ok, F.greatest("f.line_end", "f.line_start")).alias("line_end"),
                                              F.when(ok, F.col("f.title")).alias("title"), F.when(ok & F.col("f.suggested_fix").isNotNull(), F.col("f.improved_code")).alias("improved_code"), "reason")
