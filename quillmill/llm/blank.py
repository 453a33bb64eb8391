"""What counts as a response without content."""

from __future__ import annotations

import re

#: Words that stand for a missing answer, and labels that announce one.
NOTHING = {"", "none", "null", "nil", "nan", "n a", "na", "n/a", "undefined", "no response", "no answer", "no reply", "empty", "blank", "answer", "response", "reply", "output", "assistant", "a", "antwort", "réponse", "respuesta", "no content", "no output", "not available"}
_SIGN = re.compile(r"[^\W_]")
_EDGE = re.compile(r"[\W_]+", re.UNICODE)


def is_blank(text: str | None) -> bool:
    """No answer content: null, invisible characters, punctuation only, or a word for nothing or a bare label."""
    if text is None:
        return True
    if len(text) > 40:
        return not _SIGN.search(text)
    folded = _EDGE.sub(" ", text.replace("_", " ").lower()).strip()
    return folded in NOTHING and "__" not in text
