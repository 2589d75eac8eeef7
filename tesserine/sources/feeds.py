"""Vulnerability feeds as JSON text: detection of the provider and normal records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What this reader takes from each provider's payload.
NVD = "cve struct<id:string,metrics:struct<score:double>,product:string>"
OSV = "id string, aliases array<string>, affected array<struct<package:struct<ecosystem:string,name:string>,ranges:array<struct<events:array<struct<introduced:string,fixed:string>>>>>>"
GHSA = "ghsa_id string, cve_id string, vulnerabilities array<struct<package:struct<ecosystem:string,name:string>,vulnerable_version_range:string,first_patched_version:string>>"
CANONICAL = "cve_id string, source string, product string, ecosystem string, raw string"


def provider(payload: Column) -> Column:
    """Whose payload this is, by the fields it has; null for what is no JSON object."""
    has = lambda path: F.get_json_object(payload, path).isNotNull()
    return F.when(has("$.cve.id"), "nvd").when(has("$.ghsa_id"), "ghsa").when(has("$.affected"), "osv").when(has("$.cve_id"), "canonical")


def records(feed: DataFrame, payload: str = "payload") -> DataFrame:
    """A row per affected range: provider, cve_id, ecosystem, product, introduced, fixed, raw. Malformed payloads and those without an identifier give none.

    Of an OSV range the last introduced and fixed events count; a GHSA entry gives its range as raw and, apart from it, its patched version.
    """
    p = F.col(payload)
    named = feed.select(p, provider(p).alias("provider"))
    row = F.struct  # one shape for all providers
    shape = lambda cve, eco, name, introduced, fixed, raw: row(cve.alias("cve_id"), eco.alias("ecosystem"), name.alias("product"), introduced.alias("introduced"), fixed.alias("fixed"), raw.alias("raw"))
    none = F.lit(None).cast("string")
    nvd, osv, ghsa, own = (F.from_json(p, s) for s in (NVD, OSV, GHSA, CANONICAL))
    last = lambda events, field: F.element_at(F.filter(F.transform(events, lambda e: e[field]), lambda v: v.isNotNull()), -1)
    osv_id = F.coalesce(F.get(F.filter(osv["aliases"], lambda a: a.startswith("CVE-")), F.lit(0)), osv["id"])
    osv_rows = F.flatten(F.transform(osv["affected"], lambda a: F.transform(a["ranges"], lambda r: shape(osv_id, F.lower(a["package"]["ecosystem"]), F.lower(a["package"]["name"]), last(r["events"], "introduced"), last(r["events"], "fixed"), none))))
    ghsa_id = F.coalesce(ghsa["cve_id"], ghsa["ghsa_id"])
    of = lambda v, fixed, raw: shape(ghsa_id, F.lower(v["package"]["ecosystem"]), F.lower(v["package"]["name"]), none, fixed, raw)
    ghsa_rows = F.flatten(F.transform(ghsa["vulnerabilities"], lambda v: F.filter(F.array(of(v, none, v["vulnerable_version_range"]), F.when(v["first_patched_version"].isNotNull(), of(v, v["first_patched_version"], none))), lambda x: x.isNotNull())))
    rows = (
        F.when(F.col("provider") == "nvd", F.array(shape(nvd["cve"]["id"], F.lit("generic"), F.lower(nvd["cve"]["product"]), none, none, none)))
        .when(F.col("provider") == "osv", osv_rows).when(F.col("provider") == "ghsa", ghsa_rows)
        .when(F.col("provider") == "canonical", F.array(shape(own["cve_id"], own["ecosystem"], own["product"], none, none, own["raw"])))
    )
    return named.withColumn("r", F.explode(rows)).select("provider", "r.*").where("cve_id IS NOT NULL")
