"""Configuration: a document YAML and a model YAML, merged (the model's keys win) and checked."""

from __future__ import annotations

from pathlib import Path
from typing import Any, Literal

import yaml
from pydantic import BaseModel, ConfigDict, Field, field_validator

from . import models

EXTENSIONS = ("md", "txt", "html", "htm", "docx", "pdf", "doc")


class Strict(BaseModel):
    model_config = ConfigDict(extra="forbid")


class DocumentSettings(Strict):
    doc_path: Path
    scan_extensions: list[str] = ["md"]
    exclude_paths: list[Path] = []
    additional_parser_settings: dict[str, Any] = {}
    passage_prefix: str = ""
    label: str = ""

    @field_validator("scan_extensions")
    @classmethod
    def _known(cls, value: list[str]) -> list[str]:
        if unknown := [x for x in value if x not in EXTENSIONS]:
            raise ValueError(f"unknown extensions: {unknown}")
        return value

    @field_validator("doc_path")
    @classmethod
    def _there(cls, value: Path) -> Path:
        if not value.is_dir():
            raise ValueError(f"{value} is no folder")
        return value


class EmbeddingsConfig(Strict):
    embeddings_path: Path
    document_settings: list[DocumentSettings]
    chunk_sizes: list[int] = [1024]
    encoder: str = "lexical"

    @field_validator("encoder")
    @classmethod
    def _encoder(cls, value: str) -> str:
        models.named(models.ENCODERS, value)
        return value

    @property
    def labels(self) -> list[str]:
        return [s.label for s in self.document_settings if s.label]


class Replacement(Strict):
    substring_search: str
    substring_replace: str


class SemanticSearchConfig(Strict):
    search_type: Literal["mmr", "similarity"] = "similarity"
    replace_output_path: list[Replacement] = []
    append_heading_template: str = ""
    append_template: str = ""
    max_k: int = 15
    max_char_size: int = 16384
    query_prefix: str = ""
    score_cutoff: float | None = None
    hyde: bool = False
    multiquery: bool = False
    n_versions: int = 3
    rerank: bool = True
    reranker: str = "lexical"
    max_history_length: int = Field(default=2, ge=0)

    @field_validator("reranker")
    @classmethod
    def _reranker(cls, value: str) -> str:
        models.named(models.RERANKERS, value)
        return value


class GeneratorConfig(Strict):
    type: str = "echo"
    params: dict[str, Any] = {}

    @field_validator("type")
    @classmethod
    def _known(cls, value: str) -> str:
        models.named(models.GENERATORS, value)
        return value


class Config(BaseModel):
    embeddings: EmbeddingsConfig
    llm: GeneratorConfig = GeneratorConfig()
    semantic_search: SemanticSearchConfig = SemanticSearchConfig()
    prompt_template: str = "Context information is provided below. Given only the context, answer the question.\n\n### Context:\n{context}\n\n### Question: {question}\n"
    persist_response_path: Path | None = None


def load_yaml(path: str | Path) -> dict:
    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}


def load(doc_path: str | Path, model_path: str | Path | None = None) -> Config:
    return Config(**(load_yaml(doc_path) | (load_yaml(model_path) if model_path else {})))
