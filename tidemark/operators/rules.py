"""Rule families over text: phrases with word borders, weighted roles, vetoes, and a reason that can be checked."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Family:
    name: str
    role: str  # buyer, practitioner or reject
    weight: float
    phrases: tuple[str, ...]


@dataclass(frozen=True)
class Rules:
    families: tuple[Family, ...]
    buyer_at: float = 0.5
    practitioner_at: float = 0.4
    margin: float = 0.15
    most_reasons: int = 4


def without_urls(c: Column) -> Column:
    return F.regexp_replace(c, r"https?://\S+", " ")


def phrase_pattern(phrase: str) -> str:
    """The phrase between word borders; a border is asked for only where the phrase ends in a letter or digit."""
    before = r"(?<!\w)" if phrase[:1].isalnum() else ""
    after = r"(?!\w)" if phrase[-1:].isalnum() else ""
    return f"(?U){before}{re.escape(phrase)}{after}"


def fired(text: Column, phrases: Sequence[str]) -> Column:
    """The phrases that occur in lower-case ``text``, in their own order."""
    return F.array_compact(F.array(*[F.when(text.rlike(phrase_pattern(p)), F.lit(p)) for p in phrases]))


def classify(text: Column, rules: Rules) -> Column:
    """A struct (audience, score, ambiguous, reason); no text is no audience.

    A family counts its weight once, however many of its phrases occur. Any phrase of a reject family decides. Else the
    role with the greater sum wins if it reaches its bound, buyers before practitioners, and is ambiguous when the
    other role also does and lies within the margin.
    """
    t = F.lower(without_urls(F.coalesce(text, F.lit(""))))
    hits = {f: fired(t, f.phrases) for f in rules.families}
    def total(role: str) -> Column:
        out = F.lit(0.0)
        for f in rules.families:
            if f.role == role:
                out = out + F.when(F.size(hits[f]) > 0, F.lit(f.weight)).otherwise(0.0)
        return F.round(out, 3)

    rejected = F.lit(False)
    for f in rules.families:
        if f.role == "reject":
            rejected = rejected | (F.size(hits[f]) > 0)
    b, p = total("buyer"), total("practitioner")
    audience = F.when(rejected, "none").when((b >= rules.buyer_at) & (b >= p), "buyer").when(p >= rules.practitioner_at, "practitioner").when(b >= rules.buyer_at, "buyer").otherwise("none")
    close = ~rejected & (b >= rules.buyer_at) & (p >= rules.practitioner_at) & (F.abs(b - p) < rules.margin)
    words = F.slice(F.flatten(F.array(*[hits[f] for f in rules.families])), 1, rules.most_reasons)
    reason = F.when(F.size(words) > 0, F.concat(F.lit("[matched: "), F.array_join(words, ", "), F.lit("]"))).otherwise("")
    return F.struct(audience.alias("audience"), F.greatest(b, p).alias("score"), close.alias("ambiguous"), reason.alias("reason"))


def matched_phrases(reason: Column) -> Column:
    """The phrases read back from a stored reason."""
    return F.filter(F.transform(F.split(F.regexp_extract(reason, r"\[matched: ([^\]]*)\]", 1), ","), lambda p: F.trim(p)), lambda p: p != "")


def keep_by_words(text: Column, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> Column:
    """Kept when any included part occurs (all texts if there are none) and no excluded one does; no text is kept only without includes."""
    t = F.lower(text)
    some = lambda parts: F.exists(F.array(*[F.lit(p) for p in parts]), lambda p: F.contains(t, p))
    yes = F.coalesce(some(include), F.lit(False)) if include else F.lit(True)
    no = F.coalesce(some(exclude), F.lit(False)) if exclude else F.lit(False)
    return yes & ~no


def first_rule(text: Column, rules: Sequence[tuple[str, str]], other: str) -> Column:
    """The name of the first (name, part) whose part occurs, else ``other``."""
    t, out = F.lower(F.coalesce(text, F.lit(""))), None
    for name, part in rules:
        out = F.when(F.contains(t, F.lit(part)), name) if out is None else out.when(F.contains(t, F.lit(part)), name)
    return F.lit(other) if out is None else out.otherwise(other)
