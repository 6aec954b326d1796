"""Fitted models as frozen bundles: the pipeline and a header whose hash says what it may be used for."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .digest import ordered_digest, row_digest

# Fields that say how a model was made; two bundles that agree in all others may stand for each other.
OWN_FIELDS = ("bundle_id", "training_digest", "training_rows")


def _compatibility(header: Mapping[str, object]) -> str:
    import hashlib

    shared = {k: v for k, v in header.items() if k not in OWN_FIELDS and k != "compatibility_hash"}
    return hashlib.sha256(json.dumps(shared, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()


def training_header(train: DataFrame, *, key: str, vector: str, label: str) -> dict[str, object]:
    """Number and digest of the rows a model is fitted on, in the order of their key."""
    found = ordered_digest(train, [key], row_digest(F.col(key), F.to_json(F.array(vector)), F.col(label))).first()
    return {"training_rows": found["rows"] if found else 0, "training_digest": found["content_digest"] if found else None}


def save_model(model: PipelineModel, path: str, header: Mapping[str, object], spark: SparkSession) -> None:
    """Write a fitted pipeline with its header; an existing bundle is never overwritten."""
    told = dict(header, compatibility_hash=_compatibility(header))
    model.save(f"{path}/model")
    row = spark.createDataFrame([(json.dumps(told, sort_keys=True, ensure_ascii=False),)], "value string")
    row.coalesce(1).write.mode("errorifexists").text(f"{path}/header")


def load_model(spark: SparkSession, path: str, expected: Mapping[str, object] | None = None) -> tuple[PipelineModel, dict]:
    """(pipeline, header) of a bundle. A header that was changed, or is not compatible with ``expected``, is refused."""
    header = json.loads(spark.read.text(f"{path}/header").first()["value"])
    if header["compatibility_hash"] != _compatibility(header):
        raise ValueError("the bundle's header does not have its hash")
    if expected is not None and _compatibility(expected) != header["compatibility_hash"]:
        raise ValueError("the bundle is not compatible with this run")
    return PipelineModel.load(f"{path}/model"), header
