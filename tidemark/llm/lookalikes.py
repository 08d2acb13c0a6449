"""One consistent form of text: disguised characters undone, genuine words of other scripts left alone."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Look-alikes by script, as (letters of the script, the Latin letters they resemble).
_PAIRS = {
    "C": ("аАвВсСԁеЕɡһНіІјЈкКӏМоОрРԛѕЅТуԜԝхХҮүѵЗ", "aABBcCdeEghHiIjJkKlMoOpPqsSTyWwxXYuv3"),
    "G": ("αΑΒεΕΗιΙκΚΜνΝοΟρΡτΤυΥχΧΖγ", "aABeEHiIkKMvNoOpPtTuYxXZy"),
    "A": ("օսհոց", "ouhng"),
}
_SCRIPTS = "LCGA"
_FAR = 1e9
#: Costs of the lattice beside those of the character pairs: reading a letter as its look-alike, the same into the text's
#: script in a word of several scripts, changing script between words and within one.
SUBSTITUTE, SUBSTITUTE_MIXED, BETWEEN, WITHIN = 3.0, 0.5, 2.0, 3.0

_HIDDEN = "\u00ad\u034f\u115f\u1160\u180e\u200b\u200c\u200d\u2060\u2061\u2062\u2063\u2064\u3164\ufeff\uffa0"
_BIDI = "\u200e\u200f\u202a-\u202e\u2066-\u2069"
_JOINERS = "\u200c\u200d"
#: Where letters of the other scripts and of Latin are; a text without either has one script only.
_OTHER, _LATIN = re.compile("[\u0370-\u058f\u1c80-\u1c8f\u1d2b\u1f00-\u1fff\u2de0-\u2dff\ua640-\ua69f]"), re.compile("[A-Za-z\u00c0-\u024f]")
_WORDS = re.compile(r"[^\W\d_]+(?:[\u0300-\u036f]+[^\W\d_]*)*")


def _maps() -> dict[tuple[str, str], dict[str, str]]:
    out: dict[tuple[str, str], dict[str, str]] = {}
    to_latin = {s: {a: b for a, b in zip(*p) if b.isalpha()} for s, p in _PAIRS.items()}
    for s, m in to_latin.items():
        out[s, "L"] = m
        out["L", s] = {b: a for a, b in reversed(m.items())}
    for s in to_latin:
        for t in to_latin:
            if s != t:
                out[s, t] = {a: out["L", t][b] for a, b in to_latin[s].items() if b in out["L", t]}
    return out


_MAPS = _maps()


@lru_cache(100_000)
def _script(c: str) -> str:
    name = unicodedata.name(c, "")
    return {"LATIN": "L", "CYRILLIC": "C", "GREEK": "G", "ARMENIAN": "A"}.get(name.split(" ")[0], "")


@lru_cache(100_000)
def _plain(c: str) -> str:
    """A character by itself, undone: full-width, ligature, mathematical letter or other space."""
    kind, name = unicodedata.decomposition(c), unicodedata.name(c, "")
    if unicodedata.category(c) == "Zs" or c == "\t":
        return " "
    if kind.startswith(("<wide>", "<font>")) or "FULLWIDTH" in name or (kind.startswith("<compat>") and "LIGATURE" in name and "ARABIC" not in name):
        return unicodedata.normalize("NFKC", c)
    return c


def _pictograph(c: str) -> bool:
    return c in "\ufe0f\u20e3" or 0x1F3FB <= ord(c) <= 0x1F3FF or unicodedata.category(c) == "So"


def _joins(text: str, i: int) -> bool:
    """A joiner inside an emoji, or between letters of a script that needs joiners."""
    if not 0 < i < len(text) - 1 or text[i] not in _JOINERS:
        return False
    a, b = text[i - 1], text[i + 1]
    if text[i] == "\u200d" and _pictograph(a) and _pictograph(b):
        return True
    needs = lambda c: unicodedata.bidirectional(c) == "AL" or (unicodedata.category(c)[0] in "LM" and 0x0900 <= ord(c) <= 0x0DFF)
    return needs(a) and needs(b)


def _visible(text: str) -> str:
    if not re.search(f"[{_HIDDEN}{_BIDI}]", text):
        return text
    rtl = any(unicodedata.bidirectional(c) in ("R", "AL") for c in text)
    bidi = re.compile(f"[{_BIDI}]")
    return "".join(c for i, c in enumerate(text) if not (c in _HIDDEN and not _joins(text, i)) and not (not rtl and bidi.match(c)))


def _composed(text: str) -> str:
    """A letter with the accents after it in composed form, where there is one."""
    return re.sub(r"[^\W\d_][\u0300-\u036f]+", lambda m: unicodedata.normalize("NFC", m.group()), text)


#: Adjacent letters of one script and how often they occur, over all texts; 0 stands for the border of a word.
Model = dict[tuple[int, int], float]


@lru_cache(1)
def _letters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of every letter of the scripts by its code point (0 for all else), the letters, their scripts."""
    codes = [c for c in [*range(0x41, 0x3000), *range(0xA640, 0xAC00), *range(0xFB00, 0xFB50)] if chr(c).islower() and _script(chr(c))]
    number = np.zeros(0x110000, np.int32)
    number[codes] = np.arange(1, len(codes) + 1)
    return number, np.array([0, *codes]), np.array([0, *(1 + _SCRIPTS.find(_script(chr(c))) for c in codes)])


def pair_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes ``first << 21 | second`` of neighbouring letters of one script (or a border, 0) and their counts."""
    number, letters, script = _letters()
    at = number[np.frombuffer("\n".join(t.lower() for t in texts).join("\n\n").encode("utf-32-le", "surrogatepass"), np.uint32)]
    a, b = at[:-1], at[1:]
    keep = (a + b > 0) & ((script[a] == script[b]) | (a * b == 0))
    n = np.bincount(a[keep].astype(np.int64) * len(letters) + b[keep], minlength=1)
    pair = np.flatnonzero(n)
    return letters[pair // len(letters)] << 21 | letters[pair % len(letters)], n[pair]


def model_of(codes: list[int], counts: list[int]) -> Model:
    """Costs -log P(second | first), smoothed; the entry (first, -1) is the cost of a pair never seen."""
    total: Counter = Counter()
    for c, n in zip(codes, counts):
        total[c >> 21] += n
    out = {(c >> 21, c & 0x1FFFFF): -math.log((n + 0.1) / (total[c >> 21] + 10)) for c, n in zip(codes, counts)}
    return out | {(a, -1): -math.log(0.1 / (n + 10)) for a, n in total.items()}


_NEVER = -math.log(0.01)


def _score(letters: str, model: Model) -> float:
    """Cost of a stretch of letters of one script with its borders."""
    if not model:
        return 0.0
    p, cost = 0, 0.0
    for c in [*map(ord, (x for x in letters.lower() if not unicodedata.combining(x))), 0]:
        cost += model.get((p, c)) or model.get((p, -1), _NEVER)
        p = c
    return cost


def _one_script(text: str, model: Model) -> str:
    """Letters of another script that stand in for a look-alike, by the cheapest path through the lattice of scripts.

    Each word may be read in every script of the text that it has a spelling in; a reading costs its character pairs
    in that script, each letter exchanged, and leaving the text's script. A word of several scripts without any such
    spelling, or cheaper that way, stays as it is.
    """
    if not _OTHER.search(text) or not _LATIN.search(text) and len({_script(c) for c in set(text)} - {""}) < 2:
        return text
    words = list(_WORDS.finditer(text))
    runs_of = []
    count: Counter = Counter()
    for m in words:
        runs, at = [], m.start()
        while at < m.end():
            s, end = _script(text[at]), at + 1
            while end < m.end() and (_script(text[end]) in (s, "") or unicodedata.combining(text[end])):
                end += 1
            if s:
                runs.append((at, end, s))
                count[s] += end - at
            at = end
        runs_of.append(runs)
    if len(count) < 2:
        return text
    main = count.most_common(1)[0][0]
    scripts = [s for s in _SCRIPTS if s in count]
    best = {s: 0.0 if s == main else BETWEEN for s in scripts}
    back, spelt = [], []
    for m, runs in zip(words, runs_of):
        own = {s for _, _, s in runs}
        if not own or (own == {main} and len(scripts) == 1):
            back.append({s: s for s in scripts}), spelt.append({s: None for s in scripts})
            continue
        asis = sum(_score(text[a:b], model) for a, b, _ in runs) + WITHIN * (len(runs) - 1)
        now, step, how = {}, {}, {}
        for s in scripts:
            p = min(scripts, key=lambda x: best[x] + (BETWEEN if x != s else 0))
            enter = best[p] + (BETWEEN if p != s else 0)
            cost, word = (asis if s in own else _FAR), None
            out, exchanged, fits = [], 0, True
            for a, b, r in runs:
                if r == s:
                    out.append(text[a:b])
                elif (r == "G" and len(runs) == 1 and b - a == 1) or not all(c in _MAPS[r, s] or unicodedata.combining(c) for c in text[a:b]):
                    fits = False
                    break
                else:
                    exchanged += b - a
                    out.append("".join(_MAPS[r, s].get(c, c) for c in text[a:b]))
            if fits and exchanged:
                price = SUBSTITUTE if len(runs) == 1 or s != main else SUBSTITUTE_MIXED
                spelling = _score("".join(out), model) + price * exchanged
                if spelling < cost:
                    cost, word = spelling, out
            now[s], step[s], how[s] = enter + cost, p, word
        best = now
        back.append(step), spelt.append(how)
    state = min(scripts, key=lambda s: best[s] + (0 if s == main else BETWEEN))
    out = list(text)
    for runs, step, how in zip(reversed(runs_of), reversed(back), reversed(spelt)):
        if how[state]:
            for (a, b, _), w in zip(runs, how[state]):
                out[a:b] = w if len(w) == b - a else [w, *[""] * (b - a - 1)]
        state = step[state]
    return "".join(out)


def consistent(text: str | None, model: Model | None = None) -> str | None:
    """The text in its one form. Null and empty text stay; superscripts, fractions, degree signs and emoji stay.

    Without a ``model`` of character pairs only the scripts and exchanged letters count.
    """
    if not text or (text.isascii() and "\t" not in text):
        return text
    return _one_script(_composed("".join(map(_plain, _visible(text)))), model or {})


def clean(df: DataFrame, record_id: str, text: str) -> DataFrame:
    """``(id, clean_text, changed)`` of every row of ``df``, null and empty texts too; other columns are not read.

    The character pairs are counted over all texts first; what comes to the driver is bounded by the alphabets.
    """
    rows = df.select(F.col(record_id).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, n = pair_counts([t for t in b["text"].to_pylist() if t])
            yield pa.RecordBatch.from_arrays([pa.array(codes, pa.int64()), pa.array(n, pa.int64())], names=["code", "n"])

    pairs = rows.mapInArrow(counts, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    model = df.sparkSession.sparkContext.broadcast(model_of(pairs["code"].to_pylist(), pairs["n"].to_pylist()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b["text"].to_pylist()
            out = [consistent(t, model.value) for t in texts]
            yield pa.RecordBatch.from_arrays([b["id"], pa.array(out, pa.string()), pa.array([c != t for c, t in zip(out, texts)], pa.bool_())], names=["id", "clean_text", "changed"])

    return rows.mapInArrow(run, "id bigint, clean_text string, changed boolean")
