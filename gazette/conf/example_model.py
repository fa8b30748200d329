"""A user's extraction model: its ``Literal`` fields are the closed domains of an answer."""

from __future__ import annotations

from typing import Literal


class LLMExtraction:
    topic: Literal["src0", "src1", "src2", "src3", "src4"]
    country: Literal["de", "en", "fr"]
    title_en: str
