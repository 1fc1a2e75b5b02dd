"""Settings of a run, from the environment or given."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass

# For each provider the variables of its key, address and model, and the model that it defaults to.
VARIABLES = {
    "openai": ("OPENAI_API_KEY", "OPENAI_BASE_URL", "OPENAI_MODEL", "gpt-3.5-turbo"),
    "huggingface": ("HUGGINGFACE_API_KEY", "HUGGINGFACE_BASE_URL", "HUGGINGFACE_MODEL", "mistralai/Mistral-7B-v0.1"),
    "ollama": (None, "OLLAMA_BASE_URL", "OLLAMA_MODEL", "mistral"),
}


@dataclass(frozen=True)
class Settings:
    """What a run may do and whom it asks.

    provider: mock, openai, huggingface, ollama, or a name given to providers.register. rate: calls
    a second of one task, 0 for no limit. binaries, sources: whether such files are analysed.
    """

    provider: str = "mock"
    use_llm: bool = False
    api_key: str | None = None
    base_url: str | None = None
    model: str | None = None
    temperature: float = 0.3
    max_tokens: int = 500
    timeout: int = 30
    rate: float = 0.0
    binaries: bool = True
    sources: bool = True

    @classmethod
    def from_environment(cls, env: Mapping[str, str] | None = None) -> Settings:
        env = os.environ if env is None else env
        flag = lambda name, other: env.get(name, other).lower() == "true"
        name = env.get("LLM_PROVIDER", "mock")
        key, url, model, usual = VARIABLES.get(name, (None,) * 4)
        of = lambda variable, other=None: env.get(variable, other) if variable else other
        return cls(
            name, flag("USE_LLM", "false"), of(key), of(url), of(model, usual), float(env.get("OPENAI_TEMPERATURE", "0.3")), int(env.get("OPENAI_MAX_TOKENS", "500")),
            int(env.get("API_TIMEOUT", "30")), float(env.get("LLM_CALLS_PER_SECOND", "0")), flag("ENABLE_BINARY_ANALYSIS", "true"), flag("ENABLE_SOURCE_CODE_ANALYSIS", "true"),
        )
