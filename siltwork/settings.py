"""Settings by environment variables, with aliases and types."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields

#: Other names of a setting's variable; its own name in capitals comes first.
ALIASES = {"mail_db": ("MAIL_TABLE",), "data_dir": ("DATA_DIRS",), "web_results": ("MAX_SEARCH_RESULTS",)}
TRUE = ("1", "true", "yes", "on")


@dataclass(frozen=True)
class Settings:
    """Where things are and how much is asked for. Lists are comma-separated."""

    data_dir: tuple[str, ...] = ("data",)
    exclude_dirs: tuple[str, ...] = ()
    exclude_files: tuple[str, ...] = ()
    mail_db: str = ""
    imap_folders: tuple[str, ...] = ("INBOX",)
    web_results: int = 5
    rerank_top_n: int = 3
    importance_boost: float = 0.0
    preflight: bool = True
    preflight_override: bool = False

    @classmethod
    def read(cls, env: Mapping[str, str] | None = None) -> Settings:
        """From env (the process' own, if none is given); blank values count as unset, and ones of another type are errors."""
        env, given = os.environ if env is None else env, {}
        for f in fields(cls):
            raw = next((v for n in (f.name.upper(), *ALIASES.get(f.name, ())) if (v := env.get(n, "").strip())), None)
            if raw is not None:
                kind = type(f.default)
                try:
                    given[f.name] = raw.lower() in TRUE if kind is bool else tuple(x.strip() for x in raw.split(",") if x.strip()) if kind is tuple else kind(raw)
                except ValueError as error:
                    raise ValueError(f"{f.name.upper()}: {error}") from error
        return cls(**given)
