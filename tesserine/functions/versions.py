"""Version order as column expressions (J2, R7). The order is partial: null means not comparable.

A version is digits, then parts after . - _ or +. A part is a number, a number with a qualifier,
or a qualifier. Missing parts count as the number 0, and a number is newer than any qualifier,
so 1.0-final is older than 1.0. Qualifiers outside the table are equal in rank, and two of them
that differ can't be compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AFFECTED, NOT_AFFECTED, UNKNOWN, POSSIBLY = "AFFECTED", "NOT_AFFECTED", "UNKNOWN", "POSSIBLY_AFFECTED"
#: Ranks of qualifiers, oldest first; any other has OTHER_RANK.
QUALIFIERS = {"dev": -6, "alpha": -5, "a": -5, "beta": -4, "b": -4, "milestone": -3, "m": -3, "rc": -2, "cr": -2, "snapshot": -1, "": 0, "ga": 0, "final": 0, "release": 0, "sp": 1}
OTHER_RANK = 2
CORE = r"^\s*v?([0-9]+(?:[.\-_+]\w+)*)\s*$"
OPERATOR = r"(<=|>=|<|>|==|=)\s*([\w.\-+]+)"


def _token(kind: int, number: Column, text: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), number.cast("decimal(38,0)").alias("n"), text.alias("s"))


def _qualifier(text: Column) -> Column:
    low = F.lower(text)
    rank = F.lit(OTHER_RANK)
    for name, r in QUALIFIERS.items():
        rank = F.when(low == name, r).otherwise(rank)
    return _token(1, rank, low)


def version_tokens(version: Column) -> Column:
    """The parts of a version as an array of (kind, n, s); null when it is not a version."""
    core = F.regexp_extract(version, CORE, 1)

    def part(p: Column) -> Column:
        number = _token(0, F.regexp_extract(p, "^([0-9]+)", 1), F.lit(""))
        return (
            F.when(p.rlike("^[0-9]+[A-Za-z]"), F.array(number, _qualifier(F.regexp_extract(p, "^[0-9]+(.*)$", 1))))
            .when(p.rlike("^[0-9]"), F.array(number))
            .otherwise(F.array(_qualifier(p)))
        )

    return F.when(core != "", F.flatten(F.transform(F.split(core, r"[.\-_+]"), part)))


def compare_tokens(a: Column, b: Column) -> Column:
    """-1, 0 or 1 for two token arrays; null when they can't be compared."""
    pad = _token(0, F.lit(0), F.lit(""))
    sign = lambda x, y: F.when(x < y, -1).when(x > y, 1).otherwise(0)
    apart = 9

    def each(x: Column, y: Column) -> Column:
        x, y = F.coalesce(x, pad), F.coalesce(y, pad)
        texts = F.when(x["s"] == y["s"], 0).when(x["n"] == OTHER_RANK, apart).otherwise(sign(x["s"], y["s"]))
        qualifiers = F.when(x["n"] != y["n"], sign(x["n"], y["n"])).otherwise(texts)
        return F.when(x["kind"] != y["kind"], F.when(x["kind"] == 0, 1).otherwise(-1)).when(x["kind"] == 0, sign(x["n"], y["n"])).otherwise(qualifiers)

    first = F.coalesce(F.get(F.filter(F.zip_with(a, b, each), lambda v: v != 0), F.lit(0)), F.lit(0))
    return F.when(a.isNotNull() & b.isNotNull(), F.nullif(first, F.lit(apart)))


def compare_versions(a: Column, b: Column) -> Column:
    return compare_tokens(version_tokens(a), version_tokens(b))


def with_range_state(df: DataFrame) -> DataFrame:
    """df (version and a range: introduced, fixed, last_affected, exact, raw) with state.

    A raw constraint goes before exact, and exact before bounds. The steps are separate columns, so
    each token array and each comparison is worked out once.
    """
    bounds = ("introduced", "fixed", "last_affected", "exact")
    tokens = {f"_t_{c}": version_tokens(F.col(c)) for c in ("version", *bounds)}
    parsed = F.transform(F.regexp_extract_all("raw", F.lit(OPERATOR), F.lit(0)), lambda c: F.struct(F.regexp_extract(c, OPERATOR, 1).alias("op"), version_tokens(F.regexp_extract(c, OPERATOR, 2)).alias("t")))
    out = df.withColumns({**tokens, "_raw": parsed})
    compared = {f"_c_{c}": compare_tokens(F.col("_t_version"), F.col(f"_t_{c}")) for c in bounds}
    out = out.withColumns({**compared, "_ops": F.transform("_raw", lambda k: F.struct(k["op"].alias("op"), compare_tokens(F.col("_t_version"), k["t"]).alias("c")))})
    holds = lambda k: (
        F.when(k["op"] == "<", k["c"] < 0).when(k["op"] == "<=", k["c"] <= 0).when(k["op"] == ">", k["c"] > 0).when(k["op"] == ">=", k["c"] >= 0).otherwise(k["c"] == 0)
    )
    by_raw = F.when((F.size("_ops") <= 0) | F.exists("_ops", lambda k: k["c"].isNull()), UNKNOWN).when(F.forall("_ops", holds), AFFECTED).otherwise(NOT_AFFECTED)
    exact = F.col("_c_exact")
    by_exact = F.when(exact.isNull(), UNKNOWN).when(exact == 0, AFFECTED).otherwise(NOT_AFFECTED)
    there = {c: F.col(c).isNotNull() for c in bounds[:3]}
    met = {"introduced": F.col("_c_introduced") >= 0, "fixed": F.col("_c_fixed") < 0, "last_affected": F.col("_c_last_affected") <= 0}
    none, unsure, broken = ~F.greatest(*there.values()), F.greatest(*(t & met[c].isNull() for c, t in there.items())), F.greatest(*(t & ~F.coalesce(met[c], F.lit(True)) for c, t in there.items()))
    by_bounds = F.when(none | unsure, UNKNOWN).when(broken, NOT_AFFECTED).otherwise(AFFECTED)
    nameless = F.coalesce(F.col("version"), F.lit("")).isin("", UNKNOWN) | (F.upper("version") == UNKNOWN)
    state = F.when(nameless, UNKNOWN).when(F.coalesce("raw", F.lit("")) != "", by_raw).when(F.col("exact").isNotNull(), by_exact).otherwise(by_bounds)
    return out.withColumn("state", state).drop(*tokens, *compared, "_raw", "_ops")


def worst_state(state: Column) -> Column:
    """Aggregate over ranges: any AFFECTED, else any UNKNOWN, else NOT_AFFECTED."""
    return F.when(F.bool_or(state == AFFECTED), AFFECTED).when(F.bool_or(state == UNKNOWN), UNKNOWN).otherwise(NOT_AFFECTED)


# The same in DuckDB SQL, for the oracles.
def tokens_sql(v: str) -> str:
    ranks = " ".join(f"WHEN '{k}' THEN {r}" for k, r in QUALIFIERS.items())
    qual = lambda e: f"{{'kind': 1, 'n': CAST(CASE lower({e}) {ranks} ELSE {OTHER_RANK} END AS DECIMAL(38,0)), 's': lower({e})}}"
    number = "{'kind': 0, 'n': CAST(regexp_extract(p, '^([0-9]+)', 1) AS DECIMAL(38,0)), 's': ''}"
    core = rf"regexp_extract({v}, '^\s*v?([0-9]+(?:[.\-_+]\w+)*)\s*$', 1)"
    rest = "regexp_extract(p, '^[0-9]+(.*)$', 1)"
    return f"""CASE WHEN {core} <> '' THEN flatten(list_transform(string_split_regex({core}, '[.\\-_+]'), lambda p: CASE WHEN regexp_matches(p, '^[0-9]+[A-Za-z]') THEN [{number}, {qual(rest)}]
      WHEN regexp_matches(p, '^[0-9]') THEN [{number}] ELSE [{qual("p")}] END)) END"""


def compare_sql(a: str, b: str) -> str:
    """For two columns of token lists."""
    pad = "{'kind': 0, 'n': CAST(0 AS DECIMAL(38,0)), 's': ''}"
    x, y = f"coalesce(z[1], {pad})", f"coalesce(z[2], {pad})"
    each = f"""CASE WHEN {x}.kind <> {y}.kind THEN CASE WHEN {x}.kind = 0 THEN 1 ELSE -1 END WHEN {x}.n <> {y}.n THEN CASE WHEN {x}.n < {y}.n THEN -1 ELSE 1 END
      WHEN {x}.s = {y}.s THEN 0 WHEN {x}.n = {OTHER_RANK} AND {x}.kind = 1 THEN 9 WHEN {x}.s < {y}.s THEN -1 ELSE 1 END"""
    first = f"coalesce(list_filter(list_transform(list_zip({a}, {b}), lambda z: {each}), lambda v: v <> 0)[1], 0)"
    return f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN nullif({first}, 9) END"
