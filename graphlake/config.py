"""Settings of the pipelines; passed as literals, never as mutable session configuration."""

from __future__ import annotations

from dataclasses import dataclass


#: Languages of source files by suffix; another one is registered by adding its suffix here and its parser to operators.code_parser.PARSERS.
LANGUAGES = {".py": "python"}


@dataclass(frozen=True)
class Settings:
    chunk_words: int = 180
    chunk_overlap: int = 30
    chunk_least_words: int = 15
    similarity_threshold: float = 0.55
    similarity_k: int = 8
    dense_weight: float = 0.6
    sparse_weight: float = 0.4
    judged_pairs: int = 12
    pass_chunks: int = 150
    max_features: int = 50_000
    rrf_constant: int = 2
    rrf_first_rank: int = 0
    code_suffixes: tuple[str, ...] = tuple(LANGUAGES)
    code_excluded: tuple[str, ...] = (".git", ".venv", "venv", "__pycache__", "node_modules", ".mypy_cache", ".pytest_cache", "build", "dist", ".tox")
    code_body_chars: int = 4000
    code_module_lines: int = 60
    code_file_bytes: int = 512_000


DEFAULTS = Settings()
