"""Settings from the environment."""

from __future__ import annotations

import importlib
import os
from collections.abc import Callable, Mapping
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Config:
    ner_model_ko: str = ""
    ner_model_en: str = ""
    perplexity_model: str = ""
    #: Plug-ins as ``module:name``: what a model's name gives the pipelines' scorer, ner and client by.
    scorer: str = ""
    ner: str = ""
    client: str = ""
    company_path: str = "data/company_positions.json"
    postings_path: str = "data/postings.jsonl"
    resumes_path: str = "data/resumes.jsonl"
    ontology_path: str = "data/ontology.json"

    @classmethod
    def load(cls, env: Mapping[str, str] | None = None, prefix: str = "JOBWEAVE_") -> Config:
        """Each setting from its variable, for example JOBWEAVE_ONTOLOGY_PATH, else the default."""
        env = os.environ if env is None else env
        return cls(**{f.name: env[key] for f in fields(cls) if (key := prefix + f.name.upper()) in env})

    def plugin(self, setting: str, model: str) -> Callable | None:
        """What the setting's ``module:name`` makes of a model's name, for example a scorer factory; None if it is unset."""
        where = getattr(self, setting)
        if not where:
            return None
        module, colon, name = where.partition(":")
        if not colon:
            raise ValueError(f"{setting}: expected module:name, not {where!r}")
        return getattr(importlib.import_module(module), name)(model)
