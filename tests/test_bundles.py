"""Bundles: one changed byte imports nothing."""

from __future__ import annotations

import glob
import os
import shutil

import pytest

from tesserine.sources import bundles as B

SCHEMAS = {"vulnerabilities": "cve_id string, source string, score double, text string", "identities": "cve_id string, kind string"}


@pytest.fixture
def bundle(spark, tmp_path):
    v = spark.createDataFrame([(f"CVE-{i:03}", "nvd", i / 2, None if i % 5 else 'x "é\n') for i in range(40)], SCHEMAS["vulnerabilities"])
    tables = {"vulnerabilities": v, "identities": spark.createDataFrame([("CVE-001", "CPE")], SCHEMAS["identities"])}
    folder = str(tmp_path / "bundle")
    return tables, folder, B.write(tables, folder, {"vulnerabilities": ["cve_id", "source"]}), str(tmp_path / "store")


def a_file(folder, k=0):
    return sorted(glob.glob(f"{folder}/tables/vulnerabilities/*.json"))[k]


def test_round_trip_and_again(spark, bundle):
    tables, folder, name, store = bundle
    assert {r.state for r in B.validated(spark, folder).collect()} == {"OK"}
    for _ in range(2):
        assert tuple(B.import_bundle(spark, folder, store, SCHEMAS).first()) == ("COMPLETE", name, 41, 0)
    back = B.imported(spark, store, "vulnerabilities").drop("import")
    assert sorted(map(str, back.collect())) == sorted(map(str, tables["vulnerabilities"].collect()))


@pytest.mark.parametrize("damage", ["byte", "missing", "added", "manifest", "no manifest", "no tables"])
def test_damage_imports_nothing(spark, bundle, damage):
    _, folder, _, store = bundle
    if damage == "byte":
        with open(a_file(folder), "r+b") as f:
            f.seek(3)
            f.write(b"~")
    elif damage == "missing":
        os.remove(a_file(folder))
    elif damage == "added":
        shutil.copy(a_file(folder), f"{folder}/tables/identities/more.json")
    elif damage == "no tables":
        shutil.rmtree(f"{folder}/tables")
    elif damage == "no manifest":
        shutil.rmtree(f"{folder}/{B.MANIFEST}")
    else:
        (part,) = [p for p in glob.glob(f"{folder}/{B.MANIFEST}/*.json") if os.path.getsize(p)][:1]
        with open(part) as f:
            lines = f.read().splitlines()
        with open(part, "w") as f:
            f.write("\n".join(lines[1:]) + ("\n" if lines[1:] else ""))
        for crc in glob.glob(f"{folder}/{B.MANIFEST}/.*.crc"):
            os.remove(crc)
    for crc in glob.glob(f"{folder}/tables/*/.*.crc"):
        os.remove(crc)
    assert B.import_bundle(spark, folder, store, SCHEMAS).first().status == "FAILED"
    assert not os.path.exists(store)
