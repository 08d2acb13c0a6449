"""Texts in chunks of whole sentences with an overlap; sizes in characters."""

from __future__ import annotations

import re

_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n{2,}")


def _units(text: str, most: int) -> list[str]:
    """Sentences; one longer than ``most`` falls into runs of words, and a single longer word stays whole."""
    out: list[str] = []
    for s in filter(None, map(str.strip, _SENTENCE.split(text))):
        if len(s) <= most:
            out.append(s)
            continue
        run: list[str] = []
        size = 0
        for w in s.split():
            if run and size + 1 + len(w) > most:
                out.append(" ".join(run))
                run, size = [], 0
            size += len(w) + bool(run)
            run.append(w)
        out.append(" ".join(run))
    return out


def chunk_text(text: str | None, *, most: int = 700, overlap: int = 120, least: int = 120) -> list[str]:
    """Chunks of ``text`` in order; each begins with the last ``overlap`` characters of the one before.

    Null and blank texts have none; a text within ``most`` is one chunk; a last chunk under ``least`` joins the one before.
    """
    text = (text or "").strip()
    if len(text) <= most:
        return [text] if text else []
    done: list[str] = []
    now = ""
    for u in _units(text, most):
        if now and len(now) + 1 + len(u) > most:
            done.append(now)
            now = now[-overlap:].lstrip()
        now = f"{now} {u}".strip()
    if now:
        if done and len(now) < least:
            done[-1] = f"{done[-1]} {now}"
        else:
            done.append(now)
    return done
