"""Personal information in free text: anchor search, local parsers, typed placeholders.

One Aho-Corasick pass over the folded text finds anchors (at-signs, schemes, identifier cues, street words, titles,
given names, digits). Each anchor starts a deterministic parser that expands to the boundaries of the item and
validates it. Text that holds no anchor costs one scan.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TYPES = ("email", "phone", "id_number", "street_address", "person_name")

# Words that announce an item.
AT_SIGNS = ["@", "＠", "(at)", "[at]", "{at}", "<at>", "&#64;", " at ", "( at )", "[ at ]", " arroba "]
ID_CUES = [
    "passport", "nino", "ni number", "national insurance", "ssn", "social security", "social is", "social number", "tax id", "tax number", "tax no",
    "taxpayer id", "tin ", "itin", "steuer-id", "steuer id", "steuernummer", "steueridentifikationsnummer", "dni", "nie ", "nif", "cpf", "bsn",
    "national id", "id card", "id no", "id number", "identity card", "identity number", "personalausweis", "reisepass", "pasaporte", "passeport",
    "driving licence", "driving license", "driver's license", "driver's licence", "drivers license", "driver license", "licence no", "license no",
    "licence number", "license number", "führerschein", "permis de conduire", "numéro de sécurité sociale", "insee", "codice fiscale",
]
STREETS = "street st road rd lane ln avenue ave close crescent cres drive terrace gardens boulevard blvd mews grove".split()
STREET_CUES = [
    *(f" {s}" for s in STREETS), "rue ", "avenue ", "boulevard ", "chemin ", "allée ", "impasse ", "quai ", "place ", "cours ", "calle ", "avda", "avenida ", "paseo ", "plaza ",
    "carrer ", "rua ", "travessa ", "viale ", "via ", "piazza ", "straße ", "strasse ", "str. ", "weg ", "platz ", "allee ", "gasse ", "ул. ", "улица ", "box ", "postfach ",
    "apartado ", "boîte postale ", "caixa postal ",
]
TITLES = "mr mrs ms miss mx dr prof professor sir herr frau señor señora sr sra monsieur madame mme mlle dona doña don".split()
GIVEN = """adam ahmed aisha alice amara amelia amina ana andrea anders andrew anika anna anouk antonio aoife arjun astrid beatriz bilal bram brigitte
callum camille carla carlos carmen caroline catherine chloe chloé claire clara daniel david deepa diego dieter dmitri eduardo elena elif elizabeth ella
eloise emily emma eric erik esther eva fatima fenna fernando fiona francesca francisco freya fumiko gabriel george gerhard giulia goran greta grzegorz
hamid hannah harriet hassan heidi helen helga henry hiroshi hugo ibrahim ines ingrid irina isabel ivan jack jacques james jan jane javier jean jennifer
joao johan john jorge jorun jose joseph juan julia karim katarzyna keziah kenji klaus kwame laila lars laura leila liam lindiwe lisa louise lucas lucia
ludo luis magda marco marek margaret maria marie mark marta martin mary matteo mehmet michael miguel mireille mohammed nadia natalia niamh nicolas nina
noah noor odalys oksana olga oliver olivia omar oscar osric paolo patricia paul pavel pedro peter petra philippa pierre priya rafael raj ravi
rosa ruth saoirse sara sarah sergei silvia simon sofia sophie stefan susan tamsin tariq thomas tobias tomas ursula wanda wei william yara yuki yusra zofia""".split()
STRONG_SURNAME = r"(?:dottir|sson|kova|etti|feather|laski|mann|croft|inho|oux|vich|escu|opoulos|enko|wicz|ström)"
SURNAME = r"(?:dottir|sson|kova|etti|feather|laski|mann|croft|inho|oux|vane|well|mont|berg|ridge|holt|vich|escu|opoulos|enko|wicz|ström|sen|son|ski|ova|ez)"
NAME_BEFORE = [
    "ask for ", "asked for ", "spoke to ", "spoke with ", "talked to ", "signed, ", "signed by ", "thanks to ", "according to ", "landlord ", "landlady ",
    "manager ", "neighbour ", "neighbor ", "colleague ", "reach ", "shows ", "gracias a ", "merci à ", "danke an ", "yesterday ", "my name is ", "contact ",
    "regards, ", "sincerely, ", "account holder ", "contact: ",
]
NAME_AFTER = [" is the contact", " has the spare key", " from support", " closed my", " promised "]
#: Of the words that stand in no name, those that stand in the capitalised name of a street.
ARTICLES = set("the of de del la las los el da do dos das di le les des du der den".split())
#: Cues next to which a plain capitalised run of two words is a name, whatever its form.
PERSON_AFTER = {" is the contact", " has the spare key", " from support"}
#: Second words of companies, offices and places.
NOT_PEOPLE = set("""support team service services customer help desk helpdesk council bank ltd inc llc gmbh corp company office department police court maps store
cloud city county town university hospital school airport station group groups hotel insurance authority agency ministry street road avenue app pro plus up""".split())
NOT_NAMES = set("""a an and are as at be but by can the do for from has have he her his i if in is it its me my no not of on or our please she so that their
them there they this to us was we were will with you your title valid support someone anyone everyone nobody people team der die das und ist nicht el la los las
le les des du de una un y e il que""".split())
NOT_PHONES = re.compile(r"(?:\b(?:order|ticket|serial|reference|ref|invoice|build|version|error|case|parcel|tracking|sku|item|model|code)(?:\s+(?:id|no|nr|number))?|#)\s*[.:#]?\s*$", re.I)
#: Words that announce some number, unless a phone is named before them or the number has an international prefix.
ANY_NUMBER = re.compile(r"\b(?:id|no|nr|number)\s*[.:#]?\s*$", re.I)
PHONE_NUMBER = re.compile(r"(?:phone|mobile|mobil|cell|tel|telefono|teléfono|telefon|téléphone|whatsapp|contact|fax|call)\s*[.:]?\s*(?:id|no|nr|number)\s*[.:#]?\s*$", re.I)

_WORD = r"[^\W\d_][^\W\d_'’]*(?:['’-][^\W\d_]+)*"
_DOT = r"(?:\s*[(\[{<]\s*(?:dot|punto|point)\s*[)\]}>]\s*|\s+(?:dot|punto|point)\s+|\.)"
_LOCAL = re.compile(r"(?:[A-Za-z0-9À-ÿ_%+-]+(?:" + _DOT + r"[A-Za-z0-9À-ÿ_%+-]+)*)\s*$", re.I)
_LOCAL_TIGHT = re.compile(r"[A-Za-z0-9À-ÿ._%+-]*[A-Za-z0-9À-ÿ_%+-]$")
_LABEL = r"(?:[^\W_]|-)+"  # letters of any script: names may be international
_DOMAIN = re.compile(rf"\s*({_LABEL}(?:\.{_LABEL})*\.[^\W\d_]{{2,24}})\b", re.I)
_DOMAIN_SPELT = re.compile(r"\s*([A-Za-z0-9-]+(?:" + _DOT + r"[A-Za-z0-9-]+)*" + _DOT + r"[A-Za-z]{2,24})\b", re.I)
_ID_LINK = re.compile(r"['’]?s?(?:\s*(?:photo\s+)?(?:card|security|insurance|identification|id)?\s*(?:no\.?|number|num\.?|nr\.?|nº|n°|#|:|is|=|:?\s*was)){0,3}\s*[:#=]?\s*", re.I)
_ID_GROUP = re.compile(r"[A-Za-z0-9][A-Za-z0-9./-]*")
_PHONES = [
    re.compile(r"\+\d{1,3}(?:[ .()/-]{0,2}\d){6,12}(?!\d)"),
    re.compile(r"00[1-9]\d{0,2}(?:[ .()/-]{0,2}\d){6,12}(?!\d)"),
    re.compile(r"(?:1[ .-]?)?\([2-9]\d{2}\)[ .-]?[2-9]\d{2}[ .-]?\d{4}(?!\d)"),
    re.compile(r"(?:1[ .-]?)?[2-9]\d{2}([ .-]?)[2-9]\d{2}\1\d{4}(?![\d])"),
    re.compile(r"0\d(?:([ .-])\d{2}){4}(?!\d)"),
    re.compile(r"\(?0[1-9]\d{1,4}\)?(?:[ ./-]?\d{2,8}){1,4}(?!\d)"),
]
_NUMBER = r"\d{1,5}(?:\s?[A-Za-z](?![A-Za-z]))?"
_UNIT = r"(?:(?:flat|apt\.?|apartment|unit|suite|room)\s+\w{1,5},\s*)?"
_TAIL = r"(?:,?\s*(?:apt\.?|apartment|flat|unit|suite)\s+\w{1,5})?"
_ORDINAL = r"\d{1,3}(?:st|nd|rd|th)"
_STREETS = [
    re.compile(_UNIT + rf"(?<!\w){_NUMBER}\s+(?P<w>(?:(?:{_WORD}|{_ORDINAL})\.?\s+){{1,6}}?)(?P<kind>{'|'.join(STREETS)})(?!\w)\.?" + _TAIL, re.I),
    re.compile(rf"(?<!\w){_NUMBER}(?:\s*(?:bis|ter|quater))?,?\s+(?P<kind>rue|avenue|boulevard|place|chemin|allée|impasse|quai|cours)\s+(?:(?:de\s+la(?!\w)|de\s+l['’]|des(?!\w)|du(?!\w)|de(?!\w)|d['’])\s*)?(?P<w>{_WORD})", re.I),
    re.compile(rf"(?<!\w)(?:calle|avda\.?|avenida|paseo|plaza|carrer|rua|travessa|viale|via|piazza)\s+(?:(?:de\s+las|de\s+los|de\s+la|de\s+el|del|delle|della|dei|degli|de|das|dos|da|do|di|las|los|la|el)\s+)?(?P<w>{_WORD}(?:\s+{_WORD})?),?\s*(?:n[º°.o]\.?\s*)?\d{{1,4}}(?:,\s*\d{{1,2}}\s?[º°ª]\s?\w?)?", re.I),
    re.compile(rf"(?<!\w)(?P<w>{_WORD}(?:straße|strasse|str\.|weg|platz|allee|gasse))\s+\d{{1,4}}\s?[a-z]?(?!\w)(?:,\s*\d{{5}}\s+{_WORD})?", re.I),
    re.compile(rf"(?<!\w)(?:ул\.|улица)\s*(?P<w>{_WORD}),?\s*(?:д\.?\s*)?\d{{1,4}}", re.I),
    re.compile(r"(?<!\w)(?:p\.?\s?o\.?\s?box|post\s+office\s+box|postfach|apartado(?:\s+de\s+correos)?|boîte\s+postale|caixa\s+postal)\s+(?:no\.?\s*)?(?P<w>\d{1,6})(?!\w)", re.I),
]
_TITLE = rf"(?:{'|'.join(sorted(TITLES, key=len, reverse=True))})"
_TITLED = re.compile(rf"(?<!\w)(?P<t>{_TITLE})\.?\s+(?P<a>{_WORD})(?:\s+(?P<b>{_WORD}))?(?:\.?\s+(?P<c>{_WORD}))?", re.I)
_GIVEN = re.compile(rf"(?P<a>{_WORD})(?:\s+[^\W\d_]\.)?\s+(?P<b>{_WORD})", re.I)
_INVERTED = re.compile(rf"(?P<b>{_WORD}),\s+$", re.I)
_RUN = re.compile(rf"(?:{_TITLE}\.?\s+)?(?P<a>{_WORD})(?:,?\s+(?:[^\W\d_]\.\s+)?(?P<b>{_WORD}))?", re.I)
_PLAIN = r"[^\W\d_a-zà-öø-ÿ][^\W\d_]*[a-zà-öø-ÿ](?:['’-][^\W\d_]+)*"
_PLAIN_RUN = re.compile(rf"(?P<a>{_PLAIN})(?:\s+[^\W\d_]\.)?\s+(?P<b>{_PLAIN})(?P<more>\s+[^\W\d_a-zà-öø-ÿ])?")
_PLAIN_END = re.compile(rf"(?<![\w'’-])(?P<a>{_PLAIN})(?:\s+[^\W\d_]\.)?\s+(?P<b>{_PLAIN})$")
_BIGRAM = re.compile(rf"(?P<a>{_WORD})(?:\s+[^\W\d_]\.)?\s+$")
_SUR = re.compile(rf".*{SURNAME}$", re.I)
_STRONG = re.compile(rf".*{STRONG_SURNAME}$", re.I)
_ASCII = {ord(a): b for a, b in zip("áàâäãåçéèêëíìîïñóòôöõúùûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")}
_GIVEN_SET = {g.translate(_ASCII) for g in GIVEN}


@lru_cache(1)
def _anchors() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    kinds: dict[str, set[str]] = {}
    for words, kind in ((AT_SIGNS, "at"), (ID_CUES, "id"), (STREET_CUES, "street"), (NAME_BEFORE, "before"), (NAME_AFTER, "after"), (list("0123456789"), "digit"), (TITLES, "title"), (sorted(_GIVEN_SET), "given"), (STRONG_SURNAME[3:-1].split("|"), "sur")):
        for w in words:
            kinds.setdefault(w.translate(_ASCII), set()).add(kind)
    for w, k in kinds.items():
        a.add_word(w, (len(w), tuple(sorted(k))))
    a.make_automaton()
    return a


def _fold(text: str) -> str:
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    return low.translate(_ASCII)


def _key(word: str) -> str:
    return _fold(word)


def _is_surname(word: str, shouting: bool) -> bool:
    return any(_SUR.match(p) and len(p) >= 5 for p in word.split("-")) or (word[:1].isupper() and not shouting and len(word) > 2)


def _sentence(low: str, end: int) -> int:
    """Where the sentence before ``end`` begins."""
    return max((i + len(x) for x in ("\n", "! ", "? ", ". ", "; ", "\x00") if (i := low.rfind(x, 0, end)) >= 0), default=0)


def _back(text: str, at: int, words: int) -> int:
    """Where the last ``words`` words before ``at`` begin, however long they are."""
    for _ in range(words):
        while at and text[at - 1].isspace():
            at -= 1
        while at and not text[at - 1].isspace():
            at -= 1
    return at


def _ahead(text: str, at: int, words: int) -> int:
    """Where the next ``words`` words after ``at`` end."""
    for _ in range(words):
        while at < len(text) and text[at].isspace():
            at += 1
        while at < len(text) and not text[at].isspace():
            at += 1
    return at


def _before(pattern: re.Pattern, text: str, at: int) -> int | None:
    """Where the match of ``pattern`` that ends at ``at`` begins; the view grows until the match ends within it."""
    view = 120
    while True:
        lo = max(0, at - view)
        m = pattern.search(text[lo:at])
        if m is None or m.start() or not lo:
            return None if m is None else lo + m.start()
        view *= 2


def _names(text: str, low: str, hits: list, taken: list[tuple[int, int]], shouting: bool) -> Iterator[tuple[int, int]]:
    plain = lambda w: _key(w) not in NOT_NAMES
    person = lambda m: not shouting and all(plain(w) and _key(w) not in NOT_PEOPLE for w in m.group("a", "b"))
    for start, end, kinds in hits:
        left = start == 0 or not (low[start - 1].isalnum() or low[start - 1] in "@._+-'’/")
        if "title" in kinds and left and (m := _TITLED.match(text, start)) and m.end("t") <= end:
            words = [m.group(g) for g in "abc"]
            fit = lambda w: bool(w) and plain(w) and ((w[0].isupper() and not shouting) or _key(w) in _GIVEN_SET or _STRONG.match(w) or (_SUR.match(w) and len(w) > 6))
            if fit(words[0]):
                last = "a"
                if words[1] and (fit(words[1]) or len(words[1]) == 1):
                    last = "b"
                    if len(words[1]) == 1 and words[2] and fit(words[2]):
                        last = "c"
                if len(m.group("a")) > 1 or last != "a":
                    yield start, m.end(last)
        if "given" in kinds and left and (end == len(low) or not (low[end].isalnum() or low[end] in "@_+")):
            if (m := _GIVEN.match(text, start)) and m.end("a") == end and plain(m.group("b")) and _is_surname(m.group("b"), shouting):
                if text[start].isupper() or _SUR.match(m.group("b")):
                    yield start, m.end("b")
            if (m := _INVERTED.search(text, _back(text, start, 2), start)) and _SUR.match(m.group("b")) and plain(m.group("b")):
                yield m.start("b"), end
        if "sur" in kinds and (end == len(low) or not (low[end].isalnum() or low[end] in "@_")):
            at = start
            while at and (low[at - 1].isalpha() or low[at - 1] in "-'’"):
                at -= 1
            if start - at >= 2 and (m := _BIGRAM.search(text, _back(text, at, 3), at)) and plain(m.group("a")) and text[at].isupper() and m.group("a")[0].isupper() and not shouting and _key(m.group("a")) in _GIVEN_SET:
                yield m.start("a"), end
        if "before" in kinds and left and (m := _RUN.match(text, end)):
            a, b = m.group("a"), m.group("b")
            if b and plain(a) and plain(b) and _SUR.match(b) and len(b) > 5 and (a[0].isupper() or _key(a) in _GIVEN_SET):
                yield m.start(), m.end("b")
            elif plain(a) and _SUR.match(a) and len(a) > 5 and (a[0].isupper() or _STRONG.match(a)):
                yield m.start(), m.end("b" if b and _key(b) in _GIVEN_SET else "a")
            elif (m := _PLAIN_RUN.match(text, end)) and person(m) and not (text[start].isupper() and m.group("more")):  # a heading has every word capitalised
                yield m.start(), m.end("b")
        if "after" in kinds:
            at = _sentence(low, start)
            while at > 0 and low[max(0, at - 5) : at].split(" ")[-2:][:1] and re.search(rf"(?:^|\W){_TITLE}\. $|\b[a-z]\. $", low[max(0, at - 8) : at]):
                at = _sentence(low, max(0, at - 2))
            if low[start:end] in PERSON_AFTER and (m := _PLAIN_END.search(text, _back(text, start, 4), start)) and person(m):
                yield m.start(), m.end("b")
            if m := _RUN.match(text, at):
                a, b = m.group("a"), m.group("b")
                if plain(a) and (_key(a) in _GIVEN_SET and b and plain(b) or _STRONG.match(a) or (_SUR.match(a) and len(a) > 5 and text[m.end("a") : m.end("a") + 1] in ",( ")):
                    yield m.start(), m.end("b") if b and (_SUR.match(b) or _key(b) in _GIVEN_SET) else m.end("a")
                elif b and plain(a) and plain(b) and a[0].isupper() and _STRONG.match(b):
                    yield m.start(), m.end("b")


def _is_street(form: int, m: re.Match) -> bool:
    """Whether the words of a street parser's match are a street's name; ``form`` is its place in ``_STREETS``."""
    if form == 5:
        return True
    words = m.group("w").split()
    keys = [_key(w.strip(".")) for w in words]
    upper = lambda w: w[:1].isupper() or w[:1].isdigit()
    allowed = ARTICLES if form == 0 else ARTICLES - {"the", "of"} if form == 2 else set()
    if any(k in NOT_NAMES | ARTICLES and k not in allowed for k in keys) or all(k in ARTICLES - {"the"} for k in keys):
        return False
    if form == 0 and (len(words) > 3 or any(w[0].isdigit() for w in words) or ARTICLES.intersection(keys)):
        # a name, not a phrase like '2 3rd party drive'
        return upper(m.group("kind")) and upper(words[0]) and all(upper(w) or k in ARTICLES for w, k in zip(words, keys))
    return form != 1 or _key(m.group("kind")) not in ("place", "cours") or upper(words[0])  # else '2 place settings'


def _other_number(text: str, at: int) -> bool:
    """Whether the words before ``at`` announce a number that is no phone."""
    lo = _back(text, at, 6)
    if NOT_PHONES.search(text, lo, at):
        return True
    return bool(ANY_NUMBER.search(text, lo, at)) and not (text[at] == "+" or text.startswith("00", at) or PHONE_NUMBER.search(text, lo, at))


def find(text: str | None) -> list[tuple[int, int, str]]:
    """Non-overlapping ``(start, end, type)`` in order. Null and empty text hold nothing; any length is read whole."""
    if not text:
        return []
    low = _fold(text)
    hits = [(e + 1 - n, e + 1, kinds) for e, (n, kinds) in _anchors().iter(low)]
    if not hits:
        return []
    found: list[tuple[int, int, str]] = []
    covered = bytearray(len(text))

    def add(start: int, end: int, kind: str) -> None:
        if start < end and not any(covered[start:end]):
            covered[start:end] = b"\x01" * (end - start)
            found.append((start, end, kind))

    for start, end, kinds in hits:
        if "at" in kinds:
            spelt = end - start > 1
            m = (_DOMAIN_SPELT if spelt else _DOMAIN).match(text, end)
            if not m:
                continue
            a = _before(_LOCAL if spelt else _LOCAL_TIGHT, text, start)
            if a is None:
                continue
            domain, sign = m.group(1), low[start:end].strip()
            if sign == "at" and not re.search(r"\bdot\b|\bpunto\b|\bpoint\b", domain, re.I):
                continue  # a preposition, not an address spelled out
            if text[max(0, a - 7) : a].lower().endswith("mailto:"):
                a -= 7
            add(a, m.end(1), "email")
    for start, end, kinds in hits:
        if "id" in kinds and (start == 0 or not low[start - 1].isalnum()):
            at = _ID_LINK.match(text, end).end()
            first = _ID_GROUP.match(text, at)
            if not first:
                continue
            stop, value = first.end(), first.group()
            while stop < len(text) and text[stop] == " " and (g := _ID_GROUP.match(text, stop + 1)):
                w = g.group()
                if not (any(c.isdigit() for c in w) and sum(c.isalpha() for c in w) <= 2 or len(w) == 1 and w.isalpha() and (w.isupper() or value[0].islower()) and w != "I" and value[-1].isdigit() and not text[g.end() : g.end() + 2].lstrip().isalpha()):
                    break
                if len(value) > 3 and not value[-1].isalnum():
                    break  # the sentence ended before this group
                value, stop = value + w, g.end()
            trimmed = value.rstrip("./-")
            stop -= len(value) - len(trimmed)
            if sum(c.isdigit() for c in trimmed) >= 5:
                add(at, stop, "id_number")
    for start, end, kinds in hits:
        if "street" in kinds:
            lo, hi = _back(text, start, 12), _ahead(text, end, 10)
            for i, p in enumerate(_STREETS):
                for m in p.finditer(text, lo, hi):
                    if m.start() > end:
                        break
                    if m.end() >= end - 1 and _is_street(i, m):
                        add(m.start(), m.end(), "street_address")
    last = -1
    for start, end, kinds in hits:
        if "digit" not in kinds or start < last or (start and (low[start - 1].isalnum() or low[start - 1] in "#$€£")) or covered[start]:
            continue
        for at in (start - 1, start):
            if at < 0 or (at < start and low[at] not in "+("):
                continue
            if at and (low[at - 1].isalnum() or (low[at - 1] in ".,-/" and at > 1 and low[at - 2].isdigit())):
                continue
            if m := next((x for p in _PHONES if (x := p.match(text, at))), None):
                digits = sum(c.isdigit() for c in m.group())
                tail = text[m.end() : m.end() + 2]
                if digits >= 9 and not (tail[:1].isalpha() or (len(tail) == 2 and tail[0] in ".-,/" and tail[1].isdigit())) and not _other_number(text, at):
                    a = at - 4 if low[max(0, at - 4) : at] == "tel:" else at
                    add(a, m.end(), "phone")
                    last = m.end()
                    break
    shouting = text.isupper()
    for a, b in _names(text, low, hits, [], shouting):
        add(a, b, "person_name")
    return sorted(found)


def redact(text: str | None, spans: list[tuple[int, int, str]]) -> str | None:
    """The text with ``[TYPE]`` in place of each span and every other character unchanged."""
    if not spans:
        return text
    out, at = [], 0
    for a, b, kind in spans:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        spans = [find(t) for t in b["text"].to_pylist()]
        clean = [redact(t, s) for t, s in zip(b["text"].to_pylist(), spans)]
        kinds = [sorted({k for _, _, k in s}) for s in spans]
        yield pa.RecordBatch.from_arrays(
            [b["table_name"], b["record_id"], pa.array(clean, pa.string()), pa.array(kinds, pa.list_(pa.string())), pa.array([len(s) for s in spans], pa.int32())],
            names=["table_name", "record_id", "clean_text", "pii_types", "n_items"],
        )


def scan(df: DataFrame, table_name: str, record_id: str, text: str) -> DataFrame:
    """``(table_name, record_id, clean_text, pii_types, n_items)``, one row per row of ``df``; other columns are not read.

    Null text stays null with no types; a row with nothing found keeps its text byte for byte. No shuffle.
    """
    rows = df.select(F.lit(table_name).alias("table_name"), F.col(record_id).cast("string").alias("record_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_scan, "table_name string, record_id string, clean_text string, pii_types array<string>, n_items int")
