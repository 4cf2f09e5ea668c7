"""Structural validation of raw documents, before any of their content is trusted.

Documents are variants, so that absent, null and wrongly typed values can be told apart.
Level by level all objects of all documents are laid out as (doc_id, path, kind, value)
rows, joined with the table of kinds, and what does not fit comes out as AF100 findings,
one for each missing key, each value and each object with unknown keys.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.structure import KINDS, NEED_REF, NO_REF, OPEN, PATTERNS
from loomgraph.operators.graph import stored

_SCALARS = {"string", "number", "boolean", "id", "commit", "version", "share", "count", "format", "object"}


def _kinds(spark: SparkSession) -> DataFrame:
    """(kind, props): the properties of each kind with what they hold."""
    rows = []
    for kind, properties in KINDS.items():
        props = []
        for key, text in properties.items():
            needed = text.endswith(" !")
            text = text.removesuffix(" !")
            many = text.startswith("list of ")
            text = text.removeprefix("list of ")
            choices = text.removeprefix("one of ").split() if text.startswith("one of ") else None
            props.append((key, many, "choice" if choices else text, choices, needed))
        rows.append((kind, props))
    return F.broadcast(spark.createDataFrame(rows, "kind string, props array<struct<key string, many boolean, holds string, choices array<string>, needed boolean>>"))


def _depth() -> int:
    """How deep kinds nest; none holds itself."""
    inner = {k: [t.removesuffix(" !").removeprefix("list of ") for t in p.values()] for k, p in KINDS.items()}
    deep = lambda k: 1 + max((deep(x) for x in inner[k] if x in KINDS), default=0)
    return deep("document")


def validate_structural(documents: DataFrame, format_name: str) -> DataFrame:
    """(doc_id, code, severity, path) of `documents` (doc_id, raw JSON text); none for sound ones.

    Text that is not JSON, and a document that is no object, is one finding at `$`.
    """
    kinds = _kinds(documents.sparkSession)
    is_object = F.schema_of_variant("v").startswith("OBJECT")
    root = documents.select("doc_id", F.lit("$").alias("path"), F.lit("document").alias("holds"), F.try_parse_json("raw").alias("v"))
    # each level is stored, as the next and the findings read it
    level = stored(root.withColumn("bad", ~F.coalesce(is_object, F.lit(False))))
    bad = [level.where("bad").select("doc_id", "path")]
    for _ in range(_depth()):
        sites = level.where(~F.col("bad") & ~F.col("holds").isin(*_SCALARS, "choice")).select("doc_id", "path", F.col("holds").alias("kind"), "v", F.expr("try_variant_get(v, '$', 'map<string, variant>')").alias("m"))
        level = stored(_inside(sites.withColumn("keys", F.map_keys("m")).join(kinds, "kind"), format_name))
        bad.append(level.where("bad").select("doc_id", "path"))
    found = reduce(DataFrame.unionByName, bad)
    return found.select("doc_id", F.lit("AF100").alias("code"), F.lit("error").alias("severity"), "path")


def _inside(sites: DataFrame, format_name: str) -> DataFrame:
    """(doc_id, path, holds, v, bad) of all that objects (doc_id, path, kind, v, m, keys, props) hold, and of what they break themselves."""
    place = "struct<path: string, holds: string, choices: array<string>, many: boolean, v: variant, bad: boolean>"
    broken = lambda path: F.struct(path.alias("path"), F.lit(None).cast("string").alias("holds"), F.lit(None).cast("array<string>").alias("choices"), F.lit(False).alias("many"), F.lit(None).cast("variant").alias("v"), F.lit(True).alias("bad"))
    when = lambda c, path: F.when(F.coalesce(c, F.lit(False)), F.array(broken(path))).otherwise(F.array().cast(f"array<{place}>"))
    names = F.transform("props", lambda p: p["key"])
    missing = F.transform(F.filter("props", lambda p: p["needed"] & ~F.array_contains("keys", p["key"])), lambda p: broken(F.col("path")))
    unknown = when(~F.col("kind").isin(OPEN) & (F.size(F.array_except("keys", names)) > 0), F.col("path"))
    at = _condition()
    known = F.transform(
        F.filter("props", lambda p: F.array_contains("keys", p["key"])),
        lambda p: F.struct(F.concat("path", F.lit("['"), p["key"], F.lit("']")).alias("path"), p["holds"].alias("holds"), p["choices"].alias("choices"), p["many"].alias("many"), F.col("m")[p["key"]].alias("v"), F.lit(False).alias("bad")),
    )
    rows = sites.select("doc_id", F.explode(F.concat(known, missing, unknown, when(at.isNotNull(), at))).alias("x")).select("doc_id", "x.*")
    shape = F.schema_of_variant("v")
    lists = rows.where("many").withColumn("bad", ~F.coalesce(shape.startswith("ARRAY"), F.lit(False)))
    # a list is a row of its own only where it is none
    items = F.when(F.col("bad"), F.array(F.struct(F.col("path").alias("path"), F.col("v").alias("v")))).otherwise(F.transform(F.expr("try_variant_get(v, '$', 'array<variant>')"), lambda x, i: F.struct(F.concat("path", F.lit("["), i.cast("string"), F.lit("]")).alias("path"), x.alias("v"))))
    single = rows.where("not many").unionByName(lists.select("doc_id", "holds", "choices", "many", "bad", F.explode(items).alias("i")).select("doc_id", "holds", "choices", "many", "bad", "i.*"))
    return single.select("doc_id", "path", "holds", "v", (F.col("bad") | ~_fits(format_name)).alias("bad"))


def _fits(format_name: str):
    """Whether the variant `v` is what `holds` asks for."""
    shape = F.schema_of_variant("v")
    text = F.when(shape == "STRING", F.expr("try_variant_get(v, '$', 'string')"))
    number = F.when(shape.rlike("^(TINYINT|SMALLINT|INT|BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.expr("try_variant_get(v, '$', 'double')"))
    holds = F.col("holds")
    out = F.when(holds == "string", text.isNotNull()).when(holds == "boolean", shape == "BOOLEAN").when(holds == "object", shape.startswith("OBJECT"))
    for name, pattern in PATTERNS.items():
        out = out.when(holds == name, text.rlike(pattern.removesuffix("$") + r"\z"))
    out = out.when(holds == "number", number.isNotNull()).when(holds == "share", (number >= 0) & (number <= 1)).when(holds == "count", (number >= 1) & (number == F.floor(number)))
    out = out.when(holds == "format", text == format_name).when(holds == "choice", F.array_contains("choices", text))
    return F.coalesce(out.otherwise(shape.startswith("OBJECT")), F.lit(False))


def _condition():
    """Where an object breaks a rule that depends on another of its values, else null."""
    get = lambda key, kind="string": F.expr(f"try_variant_get(v, '$.{key}', '{kind}')")
    has = lambda key: F.array_contains("keys", F.lit(key))
    at = F.when((F.col("kind") == "provenance") & (get("method") == "ai_inference") & ~has("confidence"), F.col("path"))
    node = F.col("kind") == "node"
    at = at.when(node & get("type").isin(NO_REF) & has("ref"), F.concat("path", F.lit("['ref']"))).when(node & get("type").isin(NEED_REF) & ~has("ref"), F.col("path"))
    branch = (F.col("kind") == "edge") & (get("type") == "routes_to") & ~has("when") & ~F.coalesce(get("default", "boolean"), F.lit(False))
    return at.when(branch, F.col("path"))
