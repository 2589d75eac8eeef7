"""Rule scans over source text and manifests (R1-R4, P10, P11, W4, A20, R14 counts)."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rule, patterns, whether all of them must occur in a file (else one), severity, confidence, category, whether evidence is masked.
CODE_RULES = (
    ("ANDROID-WEBVIEW-001", (r"setJavaScriptEnabled\s*\(\s*true\s*\)",), False, "medium", "medium", "webview", False),
    ("ANDROID-WEBVIEW-002", (r"addJavascriptInterface\s*\(",), False, "high", "medium", "webview", False),
    ("ANDROID-TLS-001", (r"implements\s+X509TrustManager", r"checkServerTrusted"), True, "high", "low", "network", False),
    ("ANDROID-TLS-002", (r"ALLOW_ALL_HOSTNAME_VERIFIER|NullHostnameVerifier|setHostnameVerifier",), False, "high", "low", "network", False),
    ("ANDROID-CRYPTO-001", (r"""getInstance\s*\(\s*"(MD5|SHA-1|DES|DESede|RC4|AES/ECB[^"]*)\"""",), False, "medium", "medium", "crypto", False),
    (
        "ANDROID-SECRET-001",
        (
            r"""(?i)(password|passwd|api[_-]?key|secret|token)\s*=\s*"[^"]{6,}\"""",
            r"AKIA[0-9A-Z]{16}",
            r"""(?i)authorization\s*[:=]\s*"?bearer\s+[A-Za-z0-9._-]{10,}""",
        ),
        False, "medium", "low", "secrets", True,
    ),
)
#: Native rules and the imported symbols that trigger them.
NATIVE_RULES = {
    "ASF-NATIVE-STR-001": ("strcpy", "strcat", "sprintf", "vsprintf", "gets", "stpcpy"),
    "ASF-NATIVE-SCAN-001": ("scanf", "sscanf", "vscanf", "vsscanf"),
    "ASF-NATIVE-EXEC-001": ("system", "popen", "execl", "execlp", "execle", "execv", "execvp", "execvpe"),
    "ASF-NATIVE-TMP-001": ("mktemp", "tmpnam", "tempnam"),
    "ASF-NATIVE-CRYPTO-001": ("MD5_Init", "MD5_Update", "MD5_Final", "SHA1_Init", "SHA1_Update", "DES_set_key", "DES_ecb_encrypt", "RC4", "RC4_set_key"),
}
EVIDENCE = 5


def masked(line: Column) -> Column:
    """P10: quoted values of four characters or more lose their middle: eight or fewer keep their first."""
    values = F.regexp_extract_all(line, F.lit('"([^"]{4,})"'), F.lit(1))
    gaps = F.split(line, '"[^"]{4,}"', -1)

    def one(v: Column) -> Column:
        n = F.length(v)
        long = F.concat(F.substring(v, 1, 4), F.repeat(F.lit("*"), n - 8), F.substr(v, n - 3))
        return F.concat(F.lit('"'), F.when(n <= 8, F.concat(F.substring(v, 1, 1), F.lit("***"))).otherwise(long), F.lit('"'))

    return F.array_join(F.flatten(F.zip_with(gaps, values, lambda g, v: F.array(g, F.coalesce(one(v), F.lit(""))))), "")


def redacted_log(line: Column) -> Column:
    """Values of keys go, long tokens lose their middle, and the line ends at 300 characters."""
    keys = F.regexp_replace(line, r"(?i)\b(password|token|secret|auth|key)\s*[=:]\s*\S+", "$1=***")
    tokens = F.regexp_replace(keys, r"\b([A-Za-z0-9_-]{4})[A-Za-z0-9_-]{18,}([A-Za-z0-9_-]{2})\b", "$1***$2")
    return F.when(F.length(tokens) > 300, F.concat(F.substring(tokens, 1, 300), F.lit("…"))).otherwise(tokens)


def lines(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """A row per line: path, line (from 1), body."""
    return files.select(F.col(path).alias("path"), F.posexplode(F.split(text, "\n", -1)).alias("line", "body")).withColumn("line", F.col("line") + 1)


def scanned(files: DataFrame, rules=CODE_RULES, evidence: int = EVIDENCE) -> DataFrame:
    """A row per file and rule whose patterns (all, or one, as the rule says) occur in it, with the first lines that match any, masked where the rule says so.

    Files without any match are dropped before their lines are exploded.
    """
    any_rule = F.lit(False)
    for _, patterns, *_rest in rules:
        for p in patterns:
            any_rule = any_rule | F.col("text").rlike(p)
    hits = F.array(*(F.struct(F.lit(rule).alias("rule_id"), F.lit(k).alias("pattern"), F.lit(len(patterns) if every else 1).alias("wanted"), F.lit(mask).alias("mask"), F.col("body").rlike(p).alias("hit")) for rule, patterns, every, _, _, _, mask in rules for k, p in enumerate(patterns)))
    each = lines(files.where(any_rule)).withColumn("h", F.explode(F.filter(hits, lambda h: h["hit"])))
    per = each.groupBy("path", F.col("h.rule_id").alias("rule_id"), F.col("h.wanted").alias("wanted")).agg(
        F.count_distinct("h.pattern").alias("found"), F.count_distinct("line").alias("n_lines"),
        F.array_sort(F.collect_set(F.struct("line", F.when(F.col("h.mask"), masked(F.trim("body"))).otherwise(F.trim("body")).alias("body")))).alias("e"),
    )
    first = F.slice("e", 1, evidence)
    return per.where("found >= wanted").select("path", "rule_id", "n_lines", F.array_join(F.transform(first, lambda x: x["line"].cast("string")), ",").alias("evidence_lines"), F.get("e", F.lit(0))["body"].alias("first_evidence"))


def catalogue_hash(rules=CODE_RULES) -> str:
    """16 hex digits that name a catalogue of rules, whatever their order."""
    return hashlib.sha256(json.dumps(sorted(rules)).encode()).hexdigest()[:16]


def native_hits(symbols: DataFrame) -> DataFrame:
    """Imported symbols (library, symbol) joined with the rules' symbols, one finding per library and rule."""
    spark = symbols.sparkSession
    pairs = [(s, r) for r, names in NATIVE_RULES.items() for s in names]
    rules = spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(s).alias("symbol"), F.lit(r).alias("rule_id")) for s, r in pairs))).alias("p")).select("p.*")
    return symbols.join(F.broadcast(rules), "symbol").groupBy("library", "rule_id").agg(F.array_join(F.array_sort(F.collect_set("symbol")), ",").alias("symbols"))


def manifest_findings(manifests: DataFrame) -> DataFrame:
    """R2: manifests (package, debuggable, allow_backup, cleartext) to findings; an unknown flag gives none."""
    flags = (("debuggable", "ANDROID-MANIFEST-001", "medium"), ("allow_backup", "ANDROID-MANIFEST-002", "low"), ("cleartext", "ANDROID-MANIFEST-003", "medium"))
    found = F.filter(F.array(*(F.when(F.col(c), F.struct(F.lit(r).alias("rule_id"), F.lit(s).alias("severity"))) for c, r, s in flags)), lambda x: x.isNotNull())
    return manifests.select("package", F.explode(found).alias("f")).select("package", "f.rule_id", "f.severity")


def with_context(rows: DataFrame, pattern: str) -> DataFrame:
    """Each line with the last name that pattern's group found at or above it in its file."""
    name = F.nullif(F.regexp_extract("body", pattern, 1), F.lit(""))
    w = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("context", F.last(name, ignorenulls=True).over(w))


def encoded_strings(files: DataFrame, least: int = 24) -> DataFrame:
    """Opaque constants per file: letters and digits mixed, of at least that length."""
    found = F.filter(F.regexp_extract_all("text", F.lit(f"[A-Za-z0-9+/=]{{{least},}}"), F.lit(0)), lambda s: s.rlike("[0-9]") & s.rlike("[A-Za-z]"))
    return files.select("path", F.size(found).cast("long").alias("n_encoded"), F.coalesce(F.array_max(F.transform(found, lambda s: F.length(s))), F.lit(0)).alias("longest")).where("n_encoded > 0")
