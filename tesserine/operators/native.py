"""Native code: kinds of functions and APIs, reach over call edges, signatures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import graphs as G

#: Native functions and their category; then prefixes, in order.
API_CATEGORY = {
    "strcpy": "unsafe_string", "strcat": "unsafe_string", "sprintf": "unsafe_string", "vsprintf": "unsafe_string", "gets": "unsafe_string", "stpcpy": "unsafe_string", "scanf": "unsafe_parse", "sscanf": "unsafe_parse",
    "system": "command_exec", "popen": "command_exec", "execl": "command_exec", "execlp": "command_exec", "execv": "command_exec", "execvp": "command_exec",
    "memcpy": "unsafe_memory", "memmove": "unsafe_memory", "snprintf": "format", "vsnprintf": "format", "dlopen": "dynamic_load", "dlsym": "dynamic_load", "fopen": "file_io", "open": "file_io",
    "read": "file_io", "write": "file_io", "socket": "network", "connect": "network", "recv": "network", "send": "network", "mmap": "memory_map",
}
API_PREFIX = {"SSL_": "tls", "TLS_": "tls", "EVP_": "crypto", "AES_": "crypto", "RSA_": "crypto", "SHA": "crypto"}


def api_category(name: Column) -> Column:
    """Exact names first, then prefixes; null for the rest."""
    exact = F.create_map(*(F.lit(x) for pair in API_CATEGORY.items() for x in pair))[name]
    out = F.when(exact.isNotNull(), exact)
    for prefix, category in API_PREFIX.items():
        out = out.when(name.startswith(prefix), category)
    return out


def function_type(name: Column, exported: Column, imported: Column) -> Column:
    """P16."""
    return (
        F.when(name.startswith("Java_"), F.when(exported, "JNI_EXPORT").otherwise("JNI_INTERNAL")).when(name.isin("JNI_OnLoad", "JNI_OnUnload", "RegisterNatives"), "JNI_INTERNAL")
        .when(imported, "IMPORTED").when(exported, "EXPORTED_NATIVE").when(F.coalesce(name, F.lit("")) != "", "LIBRARY_INTERNAL").otherwise("UNKNOWN")
    )


def plain_name(name: Column) -> Column:
    """A symbol without leading underscores and version suffix."""
    return F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(name, F.lit(""))), "^_+", ""), "@.*$", "")


def loaded(calls: DataFrame, libraries: DataFrame) -> DataFrame:
    """loadLibrary calls (class_name, library) with HIGH confidence where the package has lib<library>.so, else LOW."""
    known = libraries.select(F.col("name").alias("file"), F.lit(True).alias("bundled")).distinct()
    file = F.concat(F.lit("lib"), F.col("library"), F.lit(".so"))
    return calls.withColumn("file", file).join(known, "file", "left").select("class_name", "library", F.coalesce("bundled", F.lit(False)).alias("bundled"), F.when(F.col("bundled"), "HIGH").otherwise("LOW").alias("confidence"))


def bound(bindings: DataFrame, libraries: DataFrame, functions: DataFrame) -> DataFrame:
    """Bindings (class_name, method_name, library, symbol) with their library's and exported function's identifiers, null where there are none."""
    by_file = libraries.groupBy(F.col("name").alias("library")).agg(F.min("library_id").alias("library_id"))
    by_symbol = functions.where("kind = 'exported'").groupBy("library", F.col("name").alias("symbol")).agg(F.min("function_id").alias("function_id"))
    return bindings.join(by_file, "library", "left").join(by_symbol, ["library", "symbol"], "left").select("class_name", "method_name", "library", "symbol", "library_id", "function_id")


def native_reach(calls: DataFrame, starts: DataFrame, targets: DataFrame, max_steps: int = 25) -> DataFrame:
    """The targets (node_key) that call edges (src, dst) lead to from starts in at most so many steps; a start that is a target reaches itself."""
    return G.reachable(calls, starts, max_steps).join(targets.select("node_key").distinct(), "node_key", "left_semi")


def signature_state(signatures: DataFrame, functions: DataFrame, reached: DataFrame, bindings: DataFrame) -> DataFrame:
    """Signatures (cve_id, native_symbol) with how far native code matches them; it never makes a CVE affect anything.

    functions (name), reached (api), bindings (state: RESOLVED or UNKNOWN).
    """
    key = F.lower(plain_name(F.col("native_symbol")))
    present = functions.select(F.lower(plain_name(F.col("name"))).alias("key"), F.lit(True).alias("present")).distinct()
    hit = reached.select(F.lower("api").alias("key"), F.lit(True).alias("reached")).distinct()
    known = bindings.agg(F.count("*").alias("n_bindings"), F.count_if(F.col("state") == "UNKNOWN").alias("n_unknown"))
    rows = signatures.withColumn("key", key).join(present, "key", "left").join(hit, "key", "left").crossJoin(known)  # one row
    state = F.when(F.col("present") & F.col("reached"), "MATCHED").when(F.col("present"), "PARTIAL_MATCH").when(F.col("n_bindings") == 0, "UNKNOWN").when(F.col("n_unknown") > 0, "UNRESOLVED_TARGET").otherwise("NOT_MATCHED")
    return rows.select("cve_id", "native_symbol", state.alias("state"))
