"""Typed call resolution over method bodies (G1, J6, J8): which method a call names, from what its receiver was last declared as.

A body is cut into tokens that matter, in order: braces, declarations, constructions and calls. Depth
is a running sum over braces. A declaration holds until its block closes, so each call is joined
with the declarations of its receiver in the same body that stand before it and still hold, and
the last one counts: an as-of join within nested scopes. A receiver without one that begins with a
capital is a class; this, or no receiver, is the caller's own class; a call on the result of
another call has no known receiver and resolves to nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import java

#: Tokens: a brace, a call on a call's result, a construction, a declaration, a call with or without receiver.
TOKEN = r"[{}]|\)\s*\.\s*[A-Za-z_$][\w$]*\s*\(|new\s+[A-Z][\w$.]*\s*\(|[A-Z][\w$.]*(?:<[^;{}()]*>)?\s+[a-z_$][\w$]*\s*[=;,:]|(?:[A-Za-z_$][\w$]*\s*\.\s*)?[A-Za-z_$][\w$]*\s*\("
STRING = r'"(?:\\.|[^"\\\n])*"'
DECLARED = r"^([A-Z][\w$.]*)(?:<[^;{}()]*>)?\s+([a-z_$][\w$]*)\s*[=;,:]$"
BUILT = r"^new\s+(?:[\w$]+\.)*([A-Z][\w$]*)\s*\($"
CALLED = r"^(?:([A-Za-z_$][\w$]*)\s*\.\s*)?([A-Za-z_$][\w$]*)\s*\($"
#: The methods by which the platform enters an exported component, by kind.
ENTRIES = {
    "activity": ("onCreate", "onNewIntent", "onStart", "onResume"),
    "activity-alias": ("onCreate", "onNewIntent"),
    "service": ("onCreate", "onStartCommand", "onBind", "onHandleIntent"),
    "receiver": ("onReceive",),
    "provider": ("onCreate", "query", "insert", "update", "delete", "call"),
}


def tokens(methods: DataFrame) -> DataFrame:
    """A row per token: body, node_key, pos, token, and depth, how many blocks of the body are open after it. A body is a method in its file."""
    plain = F.regexp_replace("code", STRING, '""')
    each = methods.select(F.struct("path", "ord").alias("body"), "node_key", F.posexplode(F.regexp_extract_all(plain, F.lit(TOKEN), F.lit(0))).alias("pos", "token"))
    step = F.when(F.col("token") == "{", 1).when(F.col("token") == "}", -1).otherwise(0)
    return each.withColumn("depth", F.sum(step).over(Window.partitionBy("body").orderBy("pos")))


def declarations(found: DataFrame) -> DataFrame:
    """Declared names with their simple type, and the place where their block closes (null: the body's end)."""
    closes = F.col("token") == "}"
    own = found.where(closes | F.col("token").rlike(DECLARED)).withColumn("block", F.col("depth") + closes.cast("int"))
    after = Window.partitionBy("body", "block").orderBy("pos").rowsBetween(1, Window.unboundedFollowing)
    ended = own.withColumn("until", F.first(F.when(closes, F.col("pos")), ignorenulls=True).over(after)).where(~closes)
    kind = F.regexp_extract("token", DECLARED, 1)
    return ended.select("body", F.regexp_extract("token", DECLARED, 2).alias("on"), F.substring_index(kind, ".", -1).alias("type"), F.col("pos").alias("at"), "until")


def resolved(methods: DataFrame) -> DataFrame:
    """Edges of calls (src, dst, confidence): methods has class_name, method_name, path, ord and code. Of methods of one class and name the first in file order is called."""
    m = methods.withColumns({"node_key": java.key(), "simple": java.simple(F.col("class_name"))})
    first = m.groupBy("simple", "method_name").agg(F.min_by("node_key", F.struct("path", "ord")).alias("dst"))
    found = tokens(m)
    built = found.withColumn("simple", F.regexp_extract("token", BUILT, 1)).where("simple <> ''").select("node_key", "simple", F.col("simple").alias("method_name"), F.lit("MEDIUM").alias("confidence"))
    calls = found.where(F.col("token").rlike(CALLED)).select("body", "node_key", "pos", F.nullif(F.regexp_extract("token", CALLED, 1), F.lit("")).alias("on"), F.regexp_extract("token", CALLED, 2).alias("method_name"))
    calls = calls.where(~F.col("method_name").isin(*java.KEYWORDS))
    holds = (F.col("at") < F.col("pos")) & (F.col("until").isNull() | (F.col("until") > F.col("pos")))
    typed = calls.join(declarations(found), ["body", "on"]).where(holds).groupBy("body", "pos").agg(F.max_by("type", "at").alias("type"))
    known = calls.join(typed, ["body", "pos"], "left").join(m.select("node_key", F.col("simple").alias("own")).distinct(), "node_key")
    simple = F.when(F.col("type").isNotNull(), F.col("type")).when(F.col("on").isNull() | (F.col("on") == "this"), F.col("own")).when(F.col("on").rlike("^[A-Z]"), F.col("on"))
    named = known.select("node_key", simple.alias("simple"), "method_name", F.when(F.col("type").isNotNull(), "LOW").otherwise("MEDIUM").alias("confidence"))
    every = built.unionByName(named.where("simple IS NOT NULL")).distinct().join(first, ["simple", "method_name"])
    sure = F.max(F.when(F.col("confidence") == "MEDIUM", 1).otherwise(0))
    return every.where("node_key <> dst").groupBy(F.col("node_key").alias("src"), "dst").agg(F.when(sure == 1, "MEDIUM").otherwise("LOW").alias("confidence"))


def component_methods(components: DataFrame, methods: DataFrame) -> DataFrame:
    """Exported components (name, kind) with their entry methods (node_key): by the full class name, and only where no class has it by the simple one."""
    m = methods.select("class_name", "method_name", java.key().alias("node_key"), java.simple(F.col("class_name")).alias("simple")).distinct()
    own = components.where("effective_exported").select("name", "kind", F.substring_index("name", ".", -1).alias("simple")).distinct()
    whole = m.select(F.col("class_name").alias("name")).distinct()
    by_name = own.join(whole, "name", "left_semi").drop("simple").join(m.select(F.col("class_name").alias("name"), "method_name", "node_key"), "name")
    by_simple = own.join(whole, "name", "left_anti").join(m.select("simple", "method_name", "node_key"), "simple").drop("simple")
    names = F.create_map(*(x for kind, of in ENTRIES.items() for x in (F.lit(kind), F.array(*map(F.lit, of)))))
    of_kind = F.coalesce(F.when(F.col("kind").isin(*ENTRIES), names[F.col("kind")]), F.array(F.lit("onCreate")))
    return by_name.unionByName(by_simple).where(F.array_contains(of_kind, F.col("method_name"))).select("name", "kind", "method_name", "node_key").distinct()
