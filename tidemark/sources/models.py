"""Fitted pipelines per fold and family on shared storage."""

from __future__ import annotations

from pyspark.ml import PipelineModel, Transformer


def _path(root: str, fold: int, family: str) -> str:
    return f"{root.rstrip('/')}/fold={fold}/family={family}"


def save_fold_model(model: PipelineModel | Transformer, root: str, fold: int, family: str) -> str:
    path = _path(root, fold, family)
    pipeline = model if isinstance(model, PipelineModel) else PipelineModel([model])
    pipeline.write().overwrite().save(path)
    return path


def load_fold_model(root: str, fold: int, family: str) -> PipelineModel:
    return PipelineModel.load(_path(root, fold, family))
