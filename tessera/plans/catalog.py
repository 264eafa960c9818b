"""All queries of the library, by the table family that they read."""

from __future__ import annotations

from ..registry import Registry
from . import chat, corpus, evaluation, guards, packing, reports, responses, stores, tokens

REGISTRY = Registry()
for _family in (corpus, tokens, chat, evaluation, packing, reports, guards, responses, stores):
    _family.register(REGISTRY)
