"""Validated configuration of a generation job; secrets never show in it."""

from __future__ import annotations

import re
from dataclasses import dataclass, fields
from enum import Enum

from ..contract import EVOLUTIONS

HIDDEN = "***REDACTED***"
_MODEL = re.compile(r"[\w\-. /@,:]+", re.ASCII)
_REPO = re.compile(r"[\w.-]+/[\w.-]+", re.ASCII)


class QualityMode(str, Enum):
    """How often instructions are evolved: once, twice or three times."""

    FAST = "fast"
    BALANCED = "balanced"
    RESEARCH = "research"

    @property
    def evolutions(self) -> int:
        return EVOLUTIONS[self.value]


class OutputFormat(str, Enum):
    """Formats of the exported dataset."""

    ALPACA = "alpaca"
    SHAREGPT = "sharegpt"
    CHATML = "chatml"
    OPENAI = "openai"


def _printable(value: str) -> bool:
    return all(32 <= ord(c) <= 126 for c in value)


def check_secret(value: str | None) -> str | None:
    """The stripped secret; None for a blank one."""
    value = (value or "").strip() or None
    if value and len(value) > 512:
        raise ValueError("a secret has at most 512 characters")
    if value and not _printable(value):
        raise ValueError("a secret has printable ASCII characters only")
    return value


def check_models(value: str | None, required: bool, several: bool = False) -> str | None:
    """The stripped model name, or with ``several`` comma-separated names of which one at least is not blank."""
    if value is None and not required:
        return None
    value = (value or "").strip()
    names = [n.strip() for n in value.split(",")] if several else [value]
    if not any(names):
        raise ValueError("a model name is required")
    if len(value) > 255:
        raise ValueError("a model name has at most 255 characters")
    for name in names:
        if ".." in name or name.startswith(("/", "\\")) or re.match(r"[A-Za-z]:", name):
            raise ValueError("a model name is not a local path")
    if not _MODEL.fullmatch(value):
        raise ValueError("a model name has letters, digits and -_. /@,: only")
    return value


def check_folder(value: str | None) -> str | None:
    """The stripped relative folder; None for a blank one."""
    value = (value or "").strip() or None
    if value is None:
        return None
    if len(value) > 512 or ".." in value or value.startswith(("/", "\\")) or re.match(r"[A-Za-z]:", value):
        raise ValueError("a checkpoint folder is a relative path of at most 512 characters without '..'")
    if not _printable(value):
        raise ValueError("a checkpoint folder has printable ASCII characters only")
    return value


def check_repo(value: str | None) -> str | None:
    """The stripped ``user/name`` of a dataset repository; None for a blank one."""
    value = (value or "").strip() or None
    if value and (".." in value or not _REPO.fullmatch(value)):
        raise ValueError(f"not of the form user/name: {value!r}")
    return value


@dataclass(frozen=True, repr=False)
class GenerationConfig:
    """Settings of a job. Wrong ones are a ValueError when it is made."""

    teacher_model: str
    judge_model: str | None = "gpt-4o-mini"
    base_model: str = "unsloth/mistral-7b-bnb-4bit"
    use_vllm: bool = True
    api_key: str | None = None
    dataset_size: int = 2000
    quality_mode: QualityMode = QualityMode.BALANCED
    output_format: OutputFormat = OutputFormat.ALPACA
    temperature: float = 0.7
    max_new_tokens: int = 2048
    batch_size: int = 64
    use_semantic_chunking: bool = False
    enable_dedup: bool = True
    sanitize_dataset: bool = False
    checkpoint_dir: str | None = None
    train_model: bool = False
    lora_rank: int = 16
    publish_dataset: bool = False
    hf_repo: str | None = None
    hf_token: str | None = None

    def __post_init__(self) -> None:
        put = lambda name, value: object.__setattr__(self, name, value)
        put("teacher_model", check_models(self.teacher_model, True, several=True))
        put("base_model", check_models(self.base_model, True))
        put("judge_model", check_models(self.judge_model, False))
        put("quality_mode", QualityMode(self.quality_mode))
        put("output_format", OutputFormat(self.output_format))
        put("api_key", check_secret(self.api_key))
        put("hf_token", check_secret(self.hf_token))
        put("checkpoint_dir", check_folder(self.checkpoint_dir))
        put("hf_repo", check_repo(self.hf_repo))
        for name, least, most in (
            ("dataset_size", 100, 50_000),
            ("temperature", 0.0, 2.0),
            ("max_new_tokens", 128, None),
            ("batch_size", 1, None),
            ("lora_rank", 8, None),
        ):
            value = getattr(self, name)
            if value < least or (most is not None and value > most):
                raise ValueError(f"{name} is out of range: {value}")
        if self.publish_dataset and not self.hf_repo:
            raise ValueError("publishing needs hf_repo")

    @property
    def models(self) -> list[str]:
        return [n.strip() for n in self.teacher_model.split(",") if n.strip()]

    def safe_dict(self) -> dict:
        """All settings that are not None, secrets hidden."""
        shown = {f.name: getattr(self, f.name) for f in fields(self) if getattr(self, f.name) is not None}
        return {k: HIDDEN if k in ("api_key", "hf_token") else v for k, v in shown.items()}

    def __repr__(self) -> str:
        return f"{type(self).__name__}({', '.join(map('{0[0]}={0[1]!r}'.format, self.safe_dict().items()))})"


def input_errors(
    files: list[tuple[str, int]], config: dict, environment: dict | None = None
) -> list[str]:
    """What keeps a job from starting: files ``(name, bytes)``, keys, names. Empty if nothing does."""
    from ..operators.records import MAX_UPLOAD_BYTES

    environment = environment or {}
    errors = [] if files else ["at least one document is needed"]
    for name, size in files:
        if not re.fullmatch(r"[\w\-. ]+", name):
            errors.append(f"unsafe file name: {name!r}")
        if size > MAX_UPLOAD_BYTES:
            errors.append(f"file of more than 50 MB: {name!r}")
    if not config.get("use_vllm", True) and not (config.get("api_key") or environment.get("OPENAI_API_KEY")):
        errors.append("an API key is needed")
    try:
        check_models(config.get("teacher_model"), True, several=True)
    except ValueError as e:
        errors.append(str(e))
    if config.get("publish_dataset"):
        if not (config.get("hf_token") or environment.get("HF_TOKEN")):
            errors.append("publishing needs a token")
        try:
            if check_repo(config.get("hf_repo")) is None:
                errors.append("publishing needs a repository")
        except ValueError as e:
            errors.append(str(e))
    return errors


def check_publication(repo: str, token: str | None, environment: dict | None = None) -> str:
    """The token for a publication to ``repo``, given or from the environment; the upload itself needs a network."""
    token = token or (environment or {}).get("HF_TOKEN")
    if not token:
        raise ValueError("publishing needs a token")
    if check_repo(repo) is None:
        raise ValueError("publishing needs a repository")
    return token
