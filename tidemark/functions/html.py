"""Plain text of HTML and of transcripts. Tags go by pattern in the JVM; entities need a table and are an Arrow UDF."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType


@pandas_udf(StringType())
def unescape(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else html.unescape(x))


def plain(c: Column) -> Column:
    """Scripts, styles and code dropped, breaks and blocks as new lines, tags dropped, entities read, spaces squeezed."""
    t = F.regexp_replace(c, r"(?is)<(script|style|pre|code)\b[^>]*>.*?</\1\s*>", " ")
    t = F.regexp_replace(t, r"(?i)<br\s*/?>|</(p|div|li|tr|h[1-6])\s*>", "\n")
    t = unescape(F.regexp_replace(F.regexp_replace(t, r"(?s)<!--.*?-->", " "), r"<[^>]*>", ""))
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[ \t\x{A0}]+", " "), r" ?\n[\n ]*", "\n"))


def strip_quotes(c: Column) -> Column:
    """Without quoted blocks of other posts."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"(?is)\[quote[^\]]*\].*?\[/quote\]", ""), r"(?is)<aside\b[^>]*quote[^>]*>.*?</aside>", ""))


def hosts_of_images(c: Column, most: int = 4) -> Column:
    """The first ``most`` different hosts of image addresses."""
    src = F.regexp_extract_all(c, F.lit(r"(?i)<img\b[^>]*\bsrc=[\"']https?://([^/\"'>]+)"), F.lit(1))
    return F.slice(F.array_distinct(F.transform(src, lambda x: F.lower(x))), 1, most)


_CUE = re.compile(r"^(?:(\d+):)?(\d+):(\d+)[.,](\d{3})\s+-->")
_VOICE = re.compile(r"^<v\s+([^>]+)>(.*?)(?:</v>)?$")


def vtt_turns(text: str | None) -> list[tuple[str | None, str, float]]:
    """(speaker, words, start in seconds) of a WebVTT transcript; neighbouring cues of one speaker are one turn.

    A cue without a voice goes on with the speaker before it. Null and empty texts have no turns.
    """
    turns: list[list] = []
    start, speaker = 0.0, None
    inside = False
    for line in (text or "").splitlines():
        line = line.strip()
        if m := _CUE.match(line):
            h, mi, s, ms = m.groups()
            start, inside = int(h or 0) * 3600 + int(mi) * 60 + int(s) + int(ms) / 1000, True
        elif not line:
            inside = False
        elif inside:
            if m := _VOICE.match(line):
                speaker, line = m.group(1).strip(), m.group(2)
            words = html.unescape(re.sub(r"<[^>]*>", "", line)).strip()
            if not words:
                continue
            if turns and turns[-1][0] == speaker:
                turns[-1][1] += " " + words
            else:
                turns.append([speaker, words, start])
    return [tuple(t) for t in turns]


def split_turn(words: str, most: int) -> list[str]:
    """A turn in parts of at most ``most`` characters, cut after a sentence where one ends in the later half, else between words."""
    out = []
    while len(words) > most:
        head = words[: most + 1]
        ends = [m.end() for m in re.finditer(r"[.!?](?=\s)", head)]
        cut = ends[-1] if ends and ends[-1] > most // 2 else head.rfind(" ")
        cut = cut if cut > 0 else most
        out.append(words[:cut].strip())
        words = words[cut:].strip()
    return [*out, words] if words else out
