"""Settings and sample manifests: small files, read by the driver."""

from __future__ import annotations

import json
import posixpath
import tomllib

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

#: Names under which settings are looked for in a folder, in order.
NAMES = ("siftline.yaml", "siftline.toml", "config/default.yaml")
# Inputs of a sample that are files.
PATHS = ("somatic_vcf", "variant_tsv", "expression_tsv", "normal_expression_tsv", "proteome_fasta")


class ConfigError(ValueError):
    """A file of settings is not what it should be."""


def parsed(text: str, name: str) -> dict:
    """A mapping from TOML, JSON or YAML, by the name's ending; an empty file is an empty mapping."""
    if name.endswith(".toml"):
        return tomllib.loads(text)
    if name.endswith(".json"):
        found = json.loads(text or "{}")
    else:
        try:
            import yaml
        except ImportError as e:
            raise ConfigError(f"{name}: reading YAML needs the yaml package") from e
        found = yaml.safe_load(text)
    if found is None:
        return {}
    if not isinstance(found, dict):
        raise ConfigError(f"{name}: expected a mapping at the top level, got {type(found).__name__}")
    return found


def _whole(spark: SparkSession, path: str) -> str | None:
    """A small file's text, wherever Spark can read; null if there is none."""
    try:
        row = spark.read.text(path, wholetext=True).first()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return row[0] if row else ""


def read_config(spark: SparkSession, path: str | None = None, folder: str | None = None, names: tuple[str, ...] = NAMES) -> dict:
    """The settings of ``path``, which must be there, else of the first of ``names`` in ``folder``, else none."""
    if path is not None:
        text = _whole(spark, path)
        if text is None:
            raise ConfigError(f"{path}: no such file")
        return parsed(text, path)
    for name in names if folder is not None else ():
        text = _whole(spark, posixpath.join(folder, name))
        if text is not None:
            return parsed(text, name)
    return {}


def read_sample(spark: SparkSession, path: str) -> dict:
    """A sample's manifest; relative paths of its inputs are those next to the manifest.

    sample_id must be stated, exactly one of somatic_vcf and variant_tsv, and a purity must be above 0 and at most 1.
    """
    sample = read_config(spark, path)
    inputs = dict(sample.get("processed") or {})
    if not sample.get("sample_id"):
        raise ConfigError("sample_id is missing")
    if bool(inputs.get("somatic_vcf")) == bool(inputs.get("variant_tsv")):
        raise ConfigError("set exactly one of somatic_vcf and variant_tsv")
    purity = sample.get("tumor_purity")
    if purity is not None and not 0 < purity <= 1:
        raise ConfigError("tumor_purity must be above 0 and at most 1")
    base = posixpath.dirname(path)
    placed = {k: v if k not in PATHS or not v or "://" in str(v) else posixpath.join(base, str(v)) for k, v in inputs.items()}
    return sample | {"processed": placed}
