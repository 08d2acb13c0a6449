"""Text functions, chunks, plain text and transcripts."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import html as H
from tidemark.functions import text as T
from tidemark.functions.chunks import chunk_text


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("body,reason", [
    (None, "too_short"), ("  ", "too_short"), ("LOL!!", "reaction_only"), ("short one", "too_short"), ("word " * 200, "too_long"), ("\U0001f600" * 6 + " this is long enough to be read by anyone", "emoji_spam"),
    ("@a @b @c @d this is long enough to be read by anyone", "mention_spam"), ("Supercalifragilistic expialidocious antidisestablishment", "too_few_words"), ("This one is a perfectly ordinary comment of some length.", None),
    ("  lol ", "reaction_only"),
])
def test_drop_reasons(spark, body, reason):
    assert one(spark, body, T.drop_reason) == reason


@pytest.mark.parametrize("body,rule", [("Beep boop, hello", "bot_phrase"), ("I am a bot. I do things", "bot_pattern"), ("I am a bot enthusiast", None), (" https://example.org/x ", "bot_pattern"), ("see https://example.org", None)])
def test_boilerplate(spark, body, rule):
    assert one(spark, body, T.boilerplate) == rule


@pytest.mark.parametrize("text,reasons", [("I wish there was an app", ["generic"]), ("just use Excel", ["tool_solves"]), ("it is bad", ["vague"]), ("it fails after 3 tries", []), (None, ["vague"])])
def test_trivial(spark, text, reasons):
    assert one(spark, text, T.trivial_reasons) == reasons


@pytest.mark.parametrize("text,n", [("306K", 306000), ("1.2m", 1200000), ("1,234", 1234), ("", None), ("many", None), ("2B", 2000000000), (None, None)])
def test_counts(spark, text, n):
    assert one(spark, text, T.parse_count) == n


@pytest.mark.parametrize("url,name", [
    ("https://www.reddit.com/r/homelab/comments/1", "r/homelab"), ("https://github.com/a/b/issues/1", "a/b"), ("https://unix.stackexchange.com/q/1", "unix"), ("https://news.ycombinator.com/item?id=1", "Hacker News"),
    ("https://forum.example.org/t/1", "forum.example.org"), ("ftp://x", None), (None, None), ("nonsense", None),
])
def test_communities(spark, url, name):
    assert one(spark, url, T.community_of) == name


def test_point_id_is_the_first_63_bits(spark):
    import hashlib

    for key in ("a", "reddit:x:1", "ü"):
        assert one(spark, key, T.point_id) == int.from_bytes(hashlib.sha256(key.encode()).digest()[:8], "big") & (2**63 - 1)


def test_chunks():
    assert chunk_text(None) == chunk_text("  ") == [] and chunk_text(" short ") == ["short"]
    text = " ".join(f"Sentence number {i} says something of no weight." for i in range(80))
    parts = chunk_text(text)
    assert len(parts) > 3 and all(len(p) <= 700 + 121 for p in parts)
    assert all(b.startswith(a[-120:].lstrip()[:50]) for a, b in zip(parts, parts[1:]))
    assert all(f"number {i} " in " ".join(parts) for i in range(80))
    assert max(map(len, chunk_text("x" * 2000))) == 2000  # one word is never cut
    assert all(len(p) <= 821 for p in chunk_text("word " * 1000))


def test_plain(spark):
    page = "<style>p{}</style><p>One &amp; <b>two</b></p><script>x()</script>three<br>four&nbsp;five<!-- no -->"
    assert one(spark, page, H.plain) == "One & two\nthree\nfour five"
    assert one(spark, None, H.plain) is None
    assert one(spark, "keep [quote=\"a\"]gone[/quote] this", H.strip_quotes) == "keep  this"
    assert one(spark, "<img src='https://A.example/x'><img src=\"http://b.example/1\"><img src='https://a.example/y'>", H.hosts_of_images) == ["a.example", "b.example"]


def test_transcripts():
    vtt = "WEBVTT\n\n00:01.000 --> 00:02.000\n<v Ann>Hello\n\n00:02.500 --> 00:03.000\nthere &amp; here\n\n1\n01:00:04.000 --> 01:00:05.000\n<v Bob>Hi</v>\n"
    assert H.vtt_turns(vtt) == [("Ann", "Hello there & here", 1.0), ("Bob", "Hi", 3604.0)] and H.vtt_turns(None) == []
    assert H.split_turn("One is here. Two is there now", 15) == ["One is here.", "Two is there", "now"]
    assert H.split_turn("abcdefghij", 4) == ["abcd", "efgh", "ij"] and H.split_turn("", 5) == []
