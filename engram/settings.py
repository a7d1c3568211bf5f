"""Settings from the environment or a file of lines NAME=value: typed, with the default where a value doesn't parse."""
from __future__ import annotations

import dataclasses
import os
from collections.abc import Mapping
from pathlib import Path

TRUE, FALSE = ("1", "true", "yes", "on"), ("0", "false", "no", "off")


@dataclasses.dataclass(frozen=True)
class Settings:
    """What a deployment may change; operators take these as arguments, so that nothing global travels to executors."""

    top_k_most: int = 100
    search_most_items: int = 10
    pool_per_channel: int = 400
    pool_total: int = 200
    token_budget_total: int = 96_000
    token_budget_target: int = 64_000
    score_ratio: float = 0.15
    least_items: int = 2
    add_budget_s: float = 40.0
    model_concurrency: int = 4
    extract_calls: int = 5
    session_chunks: int = 600
    denoise: bool = True
    transferability: bool = False
    judge_model: str = ""
    api_key: str = ""

    def judges(self) -> tuple[bool, bool]:
        """Whether the applicability judge and the transferability judge may run: the latter needs its flag and the pinned model too."""
        configured = bool(self.judge_model)
        return configured, configured and self.transferability and self.judge_model == "gpt-4o-mini"


def _typed(value: str, default):
    """value as the type of default; default where it doesn't parse."""
    low = value.strip().lower()
    if isinstance(default, bool):
        return low in TRUE if low in (*TRUE, *FALSE) else default
    if isinstance(default, str):
        return value
    try:
        return type(default)(value.strip())
    except ValueError:
        return default


def lines_of(path: str) -> dict[str, str]:
    """NAME=value lines; blank lines, comments and an `export` before a name are passed over, quotes around a value go."""
    out = {}
    for line in Path(path).read_text(encoding="utf-8").splitlines():
        name, mark, value = line.strip().removeprefix("export ").partition("=")
        if mark and not name.startswith("#"):
            value = value.strip()
            out[name.strip()] = value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "'\"" else value
    return out


def load(env: Mapping[str, str] | None = None, path: str | None = None, prefix: str = "ENGRAM_") -> Settings:
    """The environment wins over the file, the file over the defaults."""
    known = {**(lines_of(path) if path and Path(path).exists() else {}), **(os.environ if env is None else env)}
    given = {f.name: _typed(known[prefix + f.name.upper()], f.default) for f in dataclasses.fields(Settings) if known.get(prefix + f.name.upper(), "").strip()}
    return Settings(**given)
