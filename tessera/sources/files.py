"""Small files and tables of a run."""

from __future__ import annotations

import hashlib
import json
import shutil
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ontology_path(folder: str | None, name: str, named: str | None = None, private: str | None = None) -> str | None:
    """The first sorted file of an ontology, None if there is none.

    A licensed ontology is not in the common folder: it is the file ``named``
    by the user (None if that doesn't exist), else the first in the folder
    ``private`` whose name has the ontology's, whatever the case.
    """
    if named:
        return named if Path(named).is_file() else None
    if private:
        found = sorted(p for p in Path(private).glob("*.owl") if name.lower() in p.name.lower())
    else:
        found = sorted(Path(folder).glob(f"{name}-*.owl")) if folder else []
    return str(found[0]) if found else None


def write_entities(entities: DataFrame, ontology: str, path: str) -> None:
    """The entity table, one partition per ontology; rewriting one leaves the others."""
    entities.withColumn("ontology", F.lit(ontology)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("ontology").parquet(path)


def read_entities(spark: SparkSession, path: str, ontology: str) -> DataFrame:
    """An ontology that was never built is an explained error."""
    found = spark.read.parquet(path).where(F.col("ontology") == ontology)
    if found.limit(1).count() == 0:
        raise FileNotFoundError(f"no entities of {ontology} in {path}: build them first")
    return found


def dump_json(path: str, value) -> None:
    """Sorted keys, two blanks."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False) + "\n", encoding="utf-8")


def read_json(spark: SparkSession, glob: str) -> DataFrame:
    """Whole-file JSON records with the folder that each lies in as ``run_dir``."""
    return spark.read.option("multiLine", True).option("recursiveFileLookup", False).json(glob).withColumn("run_dir", F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", ""))


def file_digests(spark: SparkSession, glob: str) -> DataFrame:
    """S24."""
    return spark.read.format("binaryFile").load(glob).select("path", F.sha2("content", 256).alias("sha256"))


def write_cases(cases: DataFrame, path: str) -> None:
    """Fine-tuning cases as JSON lines."""
    cases.write.mode("overwrite").json(path)


def package(files: dict[str, str], out: str, missing: list[str]) -> dict:
    """A flat archive with a manifest; its name says if a pair is missing."""
    target = Path(out)
    if missing:
        target = target.with_name(f"{target.stem}-PARTIAL{target.suffix}")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for name, path in sorted(files.items()):
            z.write(path, name)
    manifest = {"zip": target.name, "files": sorted(files), "missing_pairs": sorted(missing), "complete": not missing}
    dump_json(str(target.with_suffix(".manifest.json")), manifest)
    return manifest


def submit(folder: str, rankings: dict[str, str], problems: dict[str, list[str]]) -> dict[str, str]:
    """Checked rankings copied into a folder that is cleared first; returns the SHA-256 of each. A ranking with problems refuses all."""
    bad = {name: found for name, found in problems.items() if found}
    if bad or not rankings:
        raise ValueError(f"nothing is submitted: {bad or 'no ranking'}")
    target = Path(folder)
    if target.exists():
        shutil.rmtree(target)
    target.mkdir(parents=True)
    digests = {}
    for name, path in sorted(rankings.items()):
        content = Path(path).read_bytes()
        (target / name).write_bytes(content)
        digests[name] = hashlib.sha256(content).hexdigest()
    return digests
