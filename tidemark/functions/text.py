"""Text functions as Column expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EMOJI = r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{FE0F}\x{2B50}]"
WIDE_EMOJI = r"[\x{10000}-\x{10FFFF}\x{2600}-\x{27BF}\x{FE00}-\x{FE0F}]"
#: Bodies that are a reaction and nothing else.
REACTIONS = ["+1", "this", "same", "lol", "lmao", "haha", "true", "facts", "agreed", "^"]
#: Stock sentences of automated posts.
BOT_PHRASES = [
    "expand the replies to this comment to learn how ai was used", "ai usage disclosure provided by op", "i am a bot, and this action was performed automatically",
    "please contact the moderators of this subreddit", "your submission has been removed", "your post has been removed", "has been automatically removed", "beep boop",
    "would you be willing to chat privately with a colleague", "here is a mirror of the",
]
#: Shapes of automated posts.
BOT_PATTERNS = [r"(?i)\^\(.*bot.*\)", r"(?i)\*{2,}\s*(beep|bot|automated)\b", r"^\s*https?://\S+\s*$", r"(?i)\bi('m| am) a bot\s*[.,!:;]", r"(?i)\bthis action was performed automatically\b.{0,40}\bmoderator"]
#: Generic wishes, a tool framed as the answer, and anchors of something specific.
_TOOLS = "excel|sheets?|notion|jira|slack|obsidian|vscode|airtable|zapier|photoshop|chrome"
_NOUNS = "config backup api docker database server sync crash freeze export import timeout deploy schema queue memory disk latency token cluster migration update install upgrade restore reboot".split()
GENERIC = r"(?i)\bwish (there was|someone would)\b|\bsomeone should\b|\bwould be nice if\b|\bwants? better \w+\b|\bneeds? better \w+\b|\bbetter ux\b|\bimprove (the )?ux\b|\bwhy (isn'?t|is not) there\b"
TOOL_SOLVES = rf"(?i)\b({_TOOLS})\b[^.!?]{{0,40}}\b(already|does|can do|handles|supports)\b|\b(just|simply) use\b|\bhave you tried\b|\balready exists\b"
SPECIFIC = r"(?i)\d|\b(gb|mb|kb|ms|sec|secs|min|mins|hour|hours|day|days|week|weeks)s?\b|\.\w{2,5}\b|\b(csv|yaml|json|xml|pdf|sql)\b|\b(" + "|".join(_NOUNS) + r")s?\b"


#: White space of every script, not only of ASCII.
SPACE = r"[\s\p{Z}]+"


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}|{SPACE}$", "")


def squeezed(c: Column) -> Column:
    """Trimmed, lower case, runs of white space as one space."""
    return F.trim(F.regexp_replace(F.lower(c), SPACE, " "))


def normalized(c: Column) -> Column:
    """Trimmed, lower case, without sentence marks at the ends."""
    return F.regexp_replace(F.lower(stripped(c)), "^[!.?…]+|[!.?…]+$", "")


def word_count(c: Column) -> Column:
    t = F.trim(F.regexp_replace(c, SPACE, " "))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " ")))


def emoji_count(c: Column, pattern: str = EMOJI) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def mention_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"@\w+"))


def drop_reason(body: Column, *, min_chars: int = 40, max_chars: int = 600, max_emoji: int = 5, max_mentions: int = 3, min_words: int = 6) -> Column:
    """The first rule that drops a comment, null for one that is kept; cheap tests come first."""
    b = stripped(F.coalesce(body, F.lit("")))
    low = normalized(b)
    return (
        F.when(b == "", "too_short").when(low.isin(REACTIONS), "reaction_only").when(F.length(b) < min_chars, "too_short").when(F.length(b) > max_chars, "too_long")
        .when(emoji_count(b) > max_emoji, "emoji_spam").when(mention_count(b) > max_mentions, "mention_spam").when(word_count(low) < min_words, "too_few_words")
    )


def boilerplate(body: Column) -> Column:
    """``bot_phrase`` or ``bot_pattern`` for automated text, else null."""
    low = F.lower(stripped(body))
    phrase, pattern = F.lit(False), F.lit(False)
    for p in BOT_PHRASES:
        phrase = phrase | F.contains(low, F.lit(p))
    for p in BOT_PATTERNS:
        pattern = pattern | body.rlike(p)
    return F.when(phrase, "bot_phrase").when(pattern, "bot_pattern")


def worker_drop_reason(body: Column, *, min_chars: int = 40, max_chars: int = 600, max_emoji: int = 5, max_mentions: int = 3, min_words: int = 6) -> Column:
    """The fetcher's own order of rules, ending with the automated ones; counts every @ and every wide character."""
    b = F.coalesce(body, F.lit(""))
    return (
        F.when(F.length(b) < min_chars, "too_short").when(F.length(b) > max_chars, "too_long").when(word_count(b) < min_words, "too_few_words").when(emoji_count(b, WIDE_EMOJI) > max_emoji, "emoji_spam")
        .when(F.regexp_count(b, F.lit("@")) > max_mentions, "mention_spam").when(~b.rlike(r"\p{L}"), "no_letters").otherwise(boilerplate(b))
    )


def trivial_reasons(text: Column) -> Column:
    """Reasons a text says little: generic, tool-solves, or, alone, vague; an empty array for a specific one."""
    t = F.coalesce(text, F.lit(""))
    noise = F.array_compact(F.array(F.when(t.rlike(GENERIC), "generic"), F.when(t.rlike(TOOL_SOLVES), "tool_solves")))
    return F.when(F.size(noise) > 0, noise).when(t.rlike(SPECIFIC), F.array().cast("array<string>")).otherwise(F.array(F.lit("vague")))


def length_bucket(chars: Column) -> Column:
    return F.when(chars <= 280, "short").when(chars <= 1000, "medium").otherwise("long")


def sample_rank(seed: int, key: Column) -> Column:
    """A row's place in a draw, fixed by the seed and its key alone."""
    return F.sha2(F.concat(F.lit(str(seed)), F.chr(F.lit(0)), key), 256)


def short_hash(c: Column) -> Column:
    return F.substring(F.sha1(c.cast("binary")), 1, 16)


def point_id(key: Column) -> Column:
    """The first 63 bits of the key's SHA-256."""
    h = F.sha2(key, 256)
    half = lambda a: F.conv(F.substring(h, a, 8), 16, 10).cast("bigint")
    return half(1).bitwiseAND(F.lit(2147483647)) * F.lit(4294967296) + half(9)


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def host(url: Column) -> Column:
    """Lower-case host of a web address without a leading www., else null."""
    h = F.lower(F.regexp_extract(url, r"^(?i:https?)://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    return F.nullif(F.regexp_replace(h, r"^www\.", ""), F.lit(""))


def community_of(url: Column) -> Column:
    """The community an address names, by the rule of its site; null where it names none."""
    h = host(url)
    part = lambda p: F.nullif(F.regexp_extract(url, p, 1), F.lit(""))
    return (
        F.when(h.endswith("reddit.com"), F.concat(F.lit("r/"), part(r"/r/([A-Za-z0-9_]+)"))).when(h == "news.ycombinator.com", F.lit("Hacker News"))
        .when(h == "github.com", part(r"github\.com/([^/?#]+/[^/?#]+)")).when(h.endswith(".stackexchange.com"), F.regexp_replace(h, r"\.stackexchange\.com$", "")).otherwise(h)
    )


def parse_count(c: Column) -> Column:
    """``306K`` as 306000, ``1.2M`` as 1200000, plain numbers with thousands marks; null for anything else."""
    t = F.upper(F.regexp_replace(F.trim(c), ",", ""))
    n = F.regexp_extract(t, r"^(\d+(?:\.\d+)?)\s*([KMB]?)$", 1).try_cast("double")
    unit = F.regexp_extract(t, r"^(\d+(?:\.\d+)?)\s*([KMB]?)$", 2)
    return F.round(n * F.when(unit == "K", 1000).when(unit == "M", 1000000).when(unit == "B", 1000000000).otherwise(1)).cast("bigint")


def number_or_text(c: Column) -> Column:
    """A number written as number or text, with a point or a comma; null where unreadable."""
    return F.regexp_replace(F.trim(c.cast("string")), ",", ".").try_cast("double")
