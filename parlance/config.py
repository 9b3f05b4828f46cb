"""Immutable settings; passed explicitly, so nothing depends on process-wide state on the workers."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    messages_per_session: int = 5
    embedding_batch: int = 64
    judge_session: int = 20
    chunk_turns: int = 50
    extraction_window: int = 500
    extraction_overlap: int = 100
    scene_words: int = 175
    gap_hours: float = 6.0
    min_turns: int = 5
    initial_turns: int = 100
    intro_window: int = 50
    pre_intro_turns: int = 10
    verbatim_window: int = 50


DEFAULTS = Settings()
