"""Personal information in free text: found by type, replaced by placeholders that keep the format.

Finding. Cheap literals and digits point to places; patterns decide there. E-mail addresses count in any notation,
telephone numbers by their international or national form, official numbers only beside their label, addresses by
their street word, names by what stands around them (a role, a signature, a record, an address or number after them).

Replacing. Each value becomes ``[TYPE:pseudonym]``. The pseudonym of an official number keeps its letters, its length
and its separators; its digits are permuted by a keyed Feistel cipher over the numbers of its form, dates over the days
of their span, so equal values stay linked across documents and different ones stay apart. Of a telephone number the
last seven digits are permuted. Names, addresses and e-mail addresses get a keyed number of 20 digits. The key is the
caller's.

Defined cases: null text gives null and no rows; empty and very long texts are read whole; a value that occurs more
than once in a document gives one row; where two types overlap, the one that begins first stands, then the longer;
other columns are not read.
"""

from __future__ import annotations

import datetime
import hashlib
import hmac
import re

from pyspark.sql import DataFrame

_W = r"[^\W\d_]+(?:['’\-][^\W\d_]+)*"
_I = r"(?: [^\W\d_]\.)?"
#: Given and family name with any initial, or family name, comma and given name.
_NAME = rf"(?:{_W},[ ]{_W}{_I}|{_W}{_I}[ ]{_W})"
_TITLE = r"(?:(?:Dr|Prof|Mr|Mrs|Ms|Herr|Frau|Mme|Sra?)\.? )?"
_PHONE = (
    r"(?:\+\d{1,3}[ .\-]?(?:\(0\)[ ]?)?\d(?:[ .\-]?\d){6,12}|\(\d{3}\)[ ]?\d{3}[ \-]\d{4}|(?:1-)?\d{3}-\d{3}-\d{4}|(?:1\.)?\d{3}\.\d{3}\.\d{4}"
    r"|00\d{2}[ \-]\d{3,4}[ \-]\d{5,7}|0\d{4}[ ]\d{3}[ ]?\d{3}|0\d{2}[ ]\d{4}[ ]\d{4}|0\d(?:[ ]\d\d){4})"
)
_LOCAL_SIGNS = frozenset("._+-")
_EMAIL_DOMAIN = re.compile(r"[^\W_](?:[\w\-]*[^\W_])?(?:\.[^\W_](?:[\w\-]*[^\W_])?)*\.[^\W\d_]{2,}")
_AT, _DOT = r"(?:[ ]?[\[({<][ ]?at[ ]?[\])}>][ ]?|[ ]at[ ])", r"(?:[ ]?[\[({<][ ]?dot[ ]?[\])}>][ ]?|[ ]dot[ ]|\.)"
_MARKED_AT = re.compile(r"[\[({<][ ]?at[ ]?[\])}>]", re.I)
_TOKEN = r"[^\W_](?:[\w+\-]*[^\W_])?"
_SPELT = re.compile(rf"(?<![\w.+\-]){_TOKEN}(?:{_DOT}{_TOKEN})*{_AT}{_TOKEN}(?:{_DOT}{_TOKEN})*{_DOT}[^\W\d_]{{2,}}(?![\w\-])", re.I)

# Fixed words of official numbers and of streets.
_LABEL = (
    r"(?:SSN|social security (?:no\.?|number)|passport(?: no\.?| number)?|Reisepass(?:[ \-]?Nr\.?)?|personal id(?: no\.?)?|personal number"
    r"|identity number|identity card no\.?|ID[ \-]nr\.?|national id(?: no\.?)?|NI number|national insurance (?:no\.?|number)"
    r"|tax id(?: no\.?)?|Steuer-?ID|NIF|DNI|NIE|NINO|pasaporte(?: no\.?)?|passeport(?: no\.?)?)"
)
_NUMBER = r"(?:\d{3}[ \-]\d{2}[ \-]\d{4}|\d{8}-\d{3}[A-Z0-9]|[A-Z]{2}[ ]?\d\d[ ]?\d\d[ ]?\d\d[ ]?[A-D]|[A-Z]{1,2}\d{6,8}|\d{6}[+\-A]\d{3}[A-Z0-9]|\d{8}[A-Z]|\d{9,11})"
_LABELLED = re.compile(rf"(?i:{_LABEL})(?:[ ]?[:=#][ ]?|[ ]is[ ]|[ ])({_NUMBER})(?![\w\-])")
_BEFORE_LABEL = re.compile(rf"(?<![\w\-])({_NUMBER})(?:[ ]?\t|[ ]?\|[ ]?|[ ]?[,;][ ]?)(?i:{_LABEL})(?!\w)")
_LABEL_HINTS = ("ssn", "social security", "passport", "reisepass", "personal ", "identity ", "id-nr", "id nr", "national i", "ni number", "tax id", "steuer", "nif", "dni", "nie", "nino", "pasaporte", "passeport")
_STREETS = r"(?:Street|St|Lane|Ln|Avenue|Ave|Drive|Dr|Road|Rd|Court|Ct|Boulevard|Blvd|Terrace|Square|Close|Crescent|Way|Place)"
_CAP = r"[A-ZÀ-ÖØ-Þ][\w'’\-]*"
_ADDRESSES = re.compile(
    rf"(?<![\w.,\-/])(?:(?i:Flat|Apt\.?|Unit|Suite)[ ]\d+[A-Za-z]?,[ ])?\d{{1,5}}[A-Za-z]?[ ](?:{_CAP}[ ]){{1,3}}"
    rf"(?:{_STREETS}|{_STREETS.upper()})(?:\.(?=\W)|(?![\w]))"
    r"|(?<![\w.\-/])\d{1,5}(?:[ ]?bis)?,?[ ](?:rue|avenue|boulevard|place|chemin|allée|impasse|quai)[ ](?:de[ ]la|des|du|de|d['’])[ ]?"
    rf"(?:(?:Vieux|Vieille|Grand|Grande|Petit|Petite|Saint|Sainte|Haut|Bas)[ ])?{_CAP}"
)
_CALLES = re.compile(rf"(?<!\w)(?:Calle|Avenida|Plaza|Paseo|Camino)[ ](?:del|de[ ]la|de[ ]los|de[ ]las|de)[ ]{_CAP}(?:[ ]{_CAP})?,?[ ]\d{{1,5}}[A-Za-z]?(?!\w)", 0)
_STRASSEN = re.compile(r"(?<!\w)[A-ZÄÖÜ][\w\-]*(?:straße|strasse|str\.|weg|gasse|platz|allee|STRASSE|STRAẞE|STRAßE|WEG)[ ]\d{1,5}[A-Za-z]?(?!\w)")
_PHONES = re.compile(rf"(?<![\w.+\-/=])(?<!\d[ ])(?<!\()({_PHONE})(?![\w\-]|[ ]?\d|\.\d)")
#: Literals that a Spanish or German address has.
_CALLE_HINTS, _STRASSE_HINTS = ("Calle ", "Avenida ", "Plaza ", "Paseo ", "Camino "), ("straße ", "strasse ", "str. ", "weg ", "gasse ", "platz ", "allee ", "STRASSE ", "STRAßE ", "WEG ")

#: Where names stand: a literal to look for, how much to read before and after it, and a pattern of that window.
_NAME_RULES = [
    (" by ", 24, 120, re.compile(rf"\b[A-Z][a-zà-ÿ]+(?:ed|en) by {_TITLE}({_NAME})(?: and {_TITLE}({_NAME}))?")),
    ("@author ", 0, 70, re.compile(rf"@author {_TITLE}({_NAME})")),
    ("name=", 0, 70, re.compile(rf"name={_TITLE}({_NAME})(?=[;,&\n\r\"'\\]|$)")),
    ("user': '", 4, 70, re.compile(rf"'user': '{_TITLE}({_NAME})'")),
    ("<td>", 0, 90, re.compile(rf"<td>{_TITLE}({_NAME})</td>(?=<td>[^<]{{0,40}}</td><td>{_PHONE})")),
    (" to ", 0, 90, re.compile(rf" to {_TITLE}({_NAME}), (?=\d|Flat |Apt|Unit |Suite |Calle |Avenida |Plaza |Paseo |{_CAP}(?:straße|strasse|weg|gasse|platz|allee) \d)")),
    (" to ", 8, 90, re.compile(rf"\b(?i:thanks|credit|kudos) to {_TITLE}({_NAME})(?: and {_TITLE}({_NAME}))?(?= for |[.,;]|$)")),
    ("erci à ", 1, 90, re.compile(rf"\b[Mm]erci à {_TITLE}({_NAME})(?: et {_TITLE}({_NAME}))?(?= pour |[.,;]|$)")),
    ("racias a ", 1, 90, re.compile(rf"\b[Gg]racias a {_TITLE}({_NAME})(?: y {_TITLE}({_NAME}))?(?= por |[.,;]|$)")),
    (" an ", 16, 90, re.compile(rf"\b(?:[Dd]anke|[Dd]ank|bitte|[Ff]ragen) an {_TITLE}({_NAME})(?: und {_TITLE}({_NAME}))?(?= für |[.,;]|$)")),
    ("tudents: ", 1, 110, re.compile(rf"\b[Ss]tudents: ({_NAME})(?: and ({_NAME}))?")),
    ("As ", 1, 100, re.compile(rf"\bAs ({_NAME})(?= (?:wrote|asked|pointed|said|noted|showed|explained|put|suggested|reported)\b)")),
    ("cc ", 1, 110, re.compile(rf"(?<!\w)cc ({_NAME})(?: and ({_NAME}))?")),
    (" (", 0, 60, re.compile(rf" \({_TITLE}({_NAME})\)")),
    ("-- ", 0, 90, re.compile(rf"-- {_TITLE}({_NAME}), (?=[^,\n]{{1,30}}, {_PHONE})")),
    (" | ", 4, 90, re.compile(rf"\d \| {_TITLE}({_NAME}) \| (?={_PHONE})")),
]
#: Two or three capitalised words, for contexts that say less about what follows.
_PROPER = rf"{_CAP}(?:[ ][A-ZÀ-ÖØ-Þ]\.)?[ ]{_CAP}(?:[ ]{_CAP})?"
_NAME_RULES += [
    (" name is ", 4, 100, re.compile(rf"\b(?i:my|his|her|their) name is {_TITLE}({_PROPER})(?![\w])")),
    ("ontact ", 1, 110, re.compile(rf"\b[Cc]ontact {_TITLE}({_PROPER})(?= (?:at|on|by|via|under|if)\b)")),
    ("egards,", 12, 110, re.compile(rf"\b[Rr]egards,\s{{1,3}}({_PROPER})(?=\s*(?:\n|$))")),
]
_ROLE = re.compile(rf"\b(?:Author|Owner|Contact|Maintainer|Reviewer|Editor|Instructor|Submitted by|From): {_TITLE}({_NAME}) <")
#: A title and a name: the title is no part of it.
_TITLED = re.compile(rf"\b(?:Dr|Prof|Mr|Mrs|Ms|Herr|Frau|Mme|Sra?)\.? ({_NAME})")
_TITLE_HINTS = ("Dr ", "Dr. ", "Prof ", "Prof. ", "Mr ", "Mr. ", "Mrs ", "Mrs. ", "Ms ", "Ms. ", "Herr ", "Frau ", "Mme ", "Sr ", "Sr. ", "Sra ", "Sra. ")
_ROLE_HINTS = ("Author: ", "Owner: ", "Contact: ", "Maintainer: ", "Reviewer: ", "Editor: ", "Instructor: ", "Submitted by: ", "From: ")


def _places(text: str, literal: str):
    at = text.find(literal)
    while at >= 0:
        yield at
        at = text.find(literal, at + len(literal))


def find(text: str) -> list[tuple[int, int, str]]:
    """``begin, end, type`` of all personal values, in order and without overlaps.

    Escapes of raw JSON are read as the white space and quotes that they stand for; places do not move.
    """
    if "\\" in text:
        for escape, plain in (("\\n", " \n"), ("\\t", " \t"), ("\\r", " \r"), ('\\"', ' "')):
            text = text.replace(escape, plain)
    found: list[tuple[int, int, str]] = []
    for at in _places(text, "@"):
        begin = at
        while begin and (text[begin - 1].isalnum() or text[begin - 1] in _LOCAL_SIGNS):
            begin -= 1
        while begin < at and not text[begin].isalnum():
            begin += 1
        domain = _EMAIL_DOMAIN.match(text, at + 1) if begin < at else None
        if domain:
            found.append((begin, domain.end(), "email"))
    folded = text.lower()
    same = folded if len(folded) == len(text) else text
    spelt = {m.start() for m in _MARKED_AT.finditer(text)}
    for at in _places(same, " dot "):
        near = same.rfind(" at ", max(0, at - 320), at + 1)
        if near >= 0:
            spelt.add(near)
    for at in sorted(spelt):
        reach = 80
        while True:  # the window grows until the address lies within it
            low, high = max(0, at - reach), min(len(text), at + 2 * reach)
            hit = next((m for m in _SPELT.finditer(text, low, high) if m.start() <= at < m.end()), None)
            inside = hit and (hit.start() > low or not low) and (hit.end() < high or high == len(text))
            if inside or hit is None and reach > 1000:
                break
            reach *= 4
        if hit:
            found.append((hit.start(), hit.end(), "email"))
    phones = [(m.start(1), m.end(1)) for m in _PHONES.finditer(text)]
    found.extend((a, b, "phone") for a, b in phones)
    if any(hint in folded for hint in _LABEL_HINTS):
        for m in _LABELLED.finditer(text):
            if m.start() == 0 or not (text[m.start() - 1].isalnum() or text[m.start() - 1] == "_"):
                found.append((m.start(1), m.end(1), "id_number"))
        found.extend((m.start(1), m.end(1), "id_number") for m in _BEFORE_LABEL.finditer(text))
        found = [x for x in found if x[2] != "id_number" or possible(text[x[0] : x[1]])]
    found.extend((m.start(), m.end(), "address") for m in _ADDRESSES.finditer(text))
    if any(hint in text for hint in _CALLE_HINTS):
        found.extend((m.start(), m.end(), "address") for m in _CALLES.finditer(text))
    if any(hint in text for hint in _STRASSE_HINTS):
        found.extend((m.start(), m.end(), "address") for m in _STRASSEN.finditer(text))
    for literal, before, after, pattern in _NAME_RULES:
        for at in _places(text, literal):
            m = pattern.search(text, max(0, at - before), at + after)
            if m and m.start() <= at:
                found.extend((*m.span(g), "name") for g in range(1, pattern.groups + 1) if m.group(g))
    for literal in _TITLE_HINTS:
        for at in _places(text, literal):
            if (m := _TITLED.match(text, at, at + 90)) and m.group(1)[0].isupper() | (text[at - 3 : at] == "As "):
                found.append((*m.span(1), "name"))
    for literal in _ROLE_HINTS:
        for at in _places(text, literal):
            if m := _ROLE.match(text, at, at + 100):
                found.append((*m.span(1), "name"))
    # Addresses that end a sentence keep the stop of an abbreviation only; of overlaps the first and longest stands.
    kept: list[tuple[int, int, str]] = []
    for begin, end, kind in sorted(set(found), key=lambda x: (x[0], -x[1])):
        if not kept or begin >= kept[-1][1]:
            kept.append((begin, end, kind))
    return kept


_NINE = re.compile(r"(\d{3})[ \-](\d{2})[ \-](\d{4})")


def possible(value: str) -> bool:
    """Whether an official number may stand for a person: neither the second nor the third part of a nine-digit one is
    all zeros. First parts that no office gives out, 000 among them, are what invented persons have, so they count."""
    m = _NINE.fullmatch(value)
    return not m or m[2] != "00" and m[3] != "0000"


def bare(value: str) -> str:
    """Lower case, letters and digits only."""
    return "".join(c for c in value.lower() if c.isalnum())


def personal_values(documents: DataFrame, key: str) -> DataFrame:
    """``doc_id, pii_type, pii_value, pseudonym``: the distinct values of each document, in lower case and without
    separators, and what stands for each in the redacted text (of spellings of one value the first)."""

    def run(batches):
        import pyarrow as pa

        pseudonyms = Pseudonyms(key.encode())
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                if text:
                    values: dict[tuple[str, str], str] = {}
                    for a, b, kind in find(text):
                        values.setdefault((kind, bare(text[a:b])), text[a:b])
                    rows += [(doc, kind, value, pseudonyms.of(raw, kind)) for (kind, value), raw in values.items()]
            cols = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), *(pa.array(c, pa.string()) for c in cols[1:])], ["doc_id", "pii_type", "pii_value", "pseudonym"]
            )

    return documents.where("text is not null").select("doc_id", "text").mapInArrow(run, "doc_id long, pii_type string, pii_value string, pseudonym string")


class Pseudonyms:
    """Keyed permutations of numbers within their format."""

    ROUNDS = 8

    def __init__(self, key: bytes):
        self.key = key

    def _round(self, tag: str, turn: int, half: int, size: int) -> int:
        text = f"{tag}|{turn}|{half}".encode()
        return int.from_bytes(hmac.new(self.key, text, hashlib.sha256).digest()[:16], "big") % size

    def permute(self, value: int, size: int, tag: str) -> int:
        """A permutation of 0 ... size - 1: a balanced Feistel network over the next square, walked until inside."""
        if size < 2:
            return value
        side = int(size**0.5)
        while side * side < size:
            side += 1
        while True:
            left, right = divmod(value, side)
            for turn in range(self.ROUNDS):
                left, right = right, (left + self._round(f"{tag}|{size}", turn, right, side)) % side
            value = left * side + right
            if value < size:
                return value

    def within(self, value: int, size: int, tag: str, allowed) -> int:
        """A permutation of the numbers below ``size`` that ``allowed`` accepts: walked until accepted."""
        while True:
            value = self.permute(value, size, tag)
            if allowed(value):
                return value

    def number(self, digits: str, tag: str, allowed=lambda x: True) -> str:
        return f"{self.within(int(digits), 10 ** len(digits), tag, allowed):0{len(digits)}d}" if digits else ""

    def digits(self, value: str, tag: str) -> str:
        """``value`` with its digits permuted; letters and separators stay, and different values stay different.

        A leading date of eight digits stays a date, of six digits a date too, any other number of that form stays none;
        a nine-digit official number that is possible stays so; a check letter that was right is right again.
        """
        spots = [i for i, c in enumerate(value) if c.isascii() and c.isdigit()]
        numbers = "".join(value[i] for i in spots)
        lead = re.match(r"(\d{8})-\d{3}|(\d{6})[+\-A]\d{3}", value)
        if lead:
            form = "%Y%m%d" if lead[1] else "%y%m%d"
            day = _day(lead[1] or lead[2], form)
            if day is None:
                width = len(lead[1] or lead[2])
                new = self.number(numbers[:width], f"{tag}|no date", lambda x: _day(f"{x:0{width}d}", form) is None)
            else:
                first, days = _SPAN[form]
                new = (first + datetime.timedelta(self.permute((day - first).days, days, f"{tag}|{form}"))).strftime(form)
            new += self.number(numbers[len(new) :], f"{tag}|{new}")
        elif _NINE.fullmatch(value):
            new = self.number(numbers, tag, lambda x: x // 10**4 % 100 and x % 10**4)
        else:
            new = self.number(numbers, tag)
        out = list(value)
        for i, c in zip(spots, new):
            out[i] = c
        for form, letters in _CHECKED:
            if form.fullmatch(value) and letters[int(numbers) % len(letters)] == value[-1]:
                out[-1] = letters[int(new) % len(letters)]
        return "".join(out)

    def phone(self, value: str) -> str:
        """The last seven digits permuted, whatever stands before them: a number written with its country's code or
        with a leading zero keeps the same end, and its area stays to be read."""
        spots = [i for i, c in enumerate(value) if c.isascii() and c.isdigit()][-7:]
        out = list(value)
        for i, c in zip(spots, self.number("".join(value[i] for i in spots), "phone")):
            out[i] = c
        return "".join(out)

    def of(self, value: str, kind: str) -> str:
        """Numbers keep their format; names, addresses and e-mails, which have none, become a keyed number of 20 digits."""
        if kind == "phone":
            return self.phone(value)
        if kind == "id_number":
            return self.digits(value, kind)
        return f"{self._round(kind, 0, int.from_bytes(hashlib.sha256(bare(value).encode()).digest()[:16], 'big'), 10**20):020d}"


# Fixed check letters of numbers by their remainder: eight digits and a letter; a date, a sign, three digits and a letter.
_CHECKED = [
    (re.compile(r"\d{8}[A-Z]"), "TRWAGMYFPDXBNJZSQVHLCKE"),
    (re.compile(r"\d{6}[+\-A]\d{3}[0-9A-Z]"), "0123456789ABCDEFHJKLMNPRSTUVWXY"),
]
_SPAN = {
    "%Y%m%d": (datetime.date(1900, 1, 1), (datetime.date(2100, 1, 1) - datetime.date(1900, 1, 1)).days),
    "%y%m%d": (datetime.date(1969, 1, 1), (datetime.date(2069, 1, 1) - datetime.date(1969, 1, 1)).days),
}


def _day(digits: str, form: str) -> datetime.date | None:
    """The day that digits name, if it is one of the span of its form."""
    try:
        day = datetime.datetime.strptime(digits, form).date()
    except ValueError:
        return None
    first, days = _SPAN[form]
    return day if 0 <= (day - first).days < days else None


def replaced(text: str, pseudonyms: Pseudonyms) -> str:
    """The text with each value as ``[TYPE:pseudonym]``."""
    parts, at = [], 0
    for begin, end, kind in find(text):
        parts += [text[at:begin], f"[{kind.upper()}:{pseudonyms.of(text[begin:end], kind)}]"]
        at = end
    return "".join(parts) + text[at:]


def redacted(documents: DataFrame, key: str) -> DataFrame:
    """``doc_id, text`` with all personal values replaced; null texts stay null."""

    def run(batches):
        import pyarrow as pa

        pseudonyms = Pseudonyms(key.encode())
        for batch in batches:
            texts = [t.as_py() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([replaced(t, pseudonyms) if t else t for t in texts], pa.string())], ["doc_id", "text"]
            )

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, text string")
