"""Options of a run, and the endpoints that are known by name."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Provider:
    url: str
    model: str
    requires_key: bool
    local: bool


# Endpoints of well-known servers and services.
PROVIDERS = {
    "ollama": Provider("http://127.0.0.1:11434/v1", "mistral:7b", False, True),
    "vllm": Provider("http://127.0.0.1:8000/v1", "", False, True),
    "llamacpp": Provider("http://127.0.0.1:8080/v1", "local-model", False, True),
    "lmstudio": Provider("http://127.0.0.1:1234/v1", "local-model", False, True),
    "openai": Provider("https://api.openai.com/v1", "gpt-4o-mini", True, False),
    "groq": Provider("https://api.groq.com/openai/v1", "llama-3.1-8b-instant", True, False),
    "together": Provider("https://api.together.xyz/v1", "meta-llama/Llama-3.3-70B-Instruct-Turbo", True, False),
    "openrouter": Provider("https://openrouter.ai/api/v1", "meta-llama/llama-3.3-70b-instruct", True, False),
}


def first_set(values: Mapping[str, str | None], *names: str, default: str | None = None) -> str | None:
    """The first of the named values that isn't blank, trimmed."""
    return next((v.strip() for n in names if (v := values.get(n)) and v.strip()), default)


@dataclass(frozen=True)
class Options:
    provider: str = "ollama"
    url: str = ""
    model: str = ""
    api_key: str = field(default="", repr=False)
    max_tokens: int = 4096
    timeout: float | None = None
    ner: bool = False
    ner_score: float = 0.5
    #: Rows whose model tier failed go on with the other tiers' findings; else they are blocked.
    ner_lenient: bool = False

    def endpoint(self) -> Provider:
        """The preset with this run's own values; an unknown name is a server of your own."""
        preset = PROVIDERS.get(self.provider.strip().lower(), Provider("", "", False, False))
        return Provider(self.url or preset.url, self.model or preset.model, preset.requires_key, preset.local)

    def seconds(self) -> float:
        return self.timeout if self.timeout is not None else 600.0 if self.endpoint().local else 120.0

    def unset(self) -> str | None:
        """Why nothing can be sent, or None."""
        at = self.endpoint()
        if not at.url:
            return "no endpoint is configured"
        if at.requires_key and not self.api_key.strip():
            return "the endpoint needs a key"
        return None

    def described(self) -> dict[str, object]:
        """What may be logged: the key only as set or not."""
        at = self.endpoint()
        return {"provider": self.provider, "model": at.model, "local": at.local, "key_set": bool(self.api_key.strip()), "ner": self.ner, "ner_score": self.ner_score, "max_tokens": self.max_tokens, "timeout": self.seconds()}

    @classmethod
    def from_env(cls, env: Mapping[str, str | None]) -> Options:
        number = lambda name, default: float(first_set(env, name, default=str(default)))
        timeout = first_set(env, "MODEL_TIMEOUT")
        return cls(
            provider=first_set(env, "AI_PROVIDER", default="ollama"),
            url=first_set(env, "AI_PROVIDER_URL", default=""),
            model=first_set(env, "AI_PROVIDER_MODEL", default=""),
            api_key=first_set(env, "AI_PROVIDER_APIKEY", default=""),
            max_tokens=int(number("MODEL_MAX_TOKENS", 4096)),
            timeout=float(timeout) if timeout else None,
            ner=first_set(env, "NER_ENABLED", default="false").lower() in ("1", "true", "yes", "on"),
            ner_score=number("NER_SCORE_THRESHOLD", 0.5),
            ner_lenient=first_set(env, "NER_LENIENT", default="false").lower() in ("1", "true", "yes", "on"),
        )
