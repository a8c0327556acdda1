"""Personal information in free text: found by what terms disclose, and replaced where it stands.

One pass over the texts gives every run of capitalised words with its place and the slot it stands in. From
all documents it is counted how often each term stands in a slot of a protected
entity (after a title, as judge, counsel, witness, before a verb of testimony) and
how often at all; the logarithm of that rate over the base rate, in bits, is the term's
disclosure. Terms above a threshold reveal a person wherever they stand; terms far below it
never do, even in such a slot. In the same way it is counted which words follow a run that stands in such a slot by what is before it; words that
disclose a person so put other runs before them into a protected slot as well. E-mail addresses, phone and identity numbers and street
addresses are told by form and context, and checked. A second pass judges the runs of each document by the terms'
disclosure, which the tasks read block by block from a shared table; no text and no run is shuffled.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.session import filesystem, materialize

#: Bits from which on a term reveals a person by itself, and below which it is ordinary even in a protected slot.
REVEALS, ORDINARY = 1.0, -1.5
#: Strength of the prior: a term starts at the base rate as if seen so often.
PRIOR = 4.0
#: Bits from which on the words after a run put it into a protected slot, and the strength of the prior for them.
CONTEXT_REVEALS, CONTEXT_PRIOR = 2.0, 20.0
#: Terms a task holds at once while runs are judged.
BLOCK_TERMS = 1_000_000
#: What an occurrence as side of a case counts: companies and persons stand there, so it says little.
SIDE_WEIGHT = 0.1

# Words of languages and forms.
_PARTICLES = {"van", "von", "de", "del", "der", "den", "la", "du", "da", "di"}
_TITLES = {"mr", "mrs", "ms", "mx", "miss", "dr", "prof", "professor", "herr", "frau", "mme", "mlle", "me", "maître", "judge", "justice", "richter", "richterin", "juge", "sir", "lady"}
_ORGANISATION = {"ltd", "limited", "inc", "llc", "plc", "gmbh", "ag", "se", "sa", "sarl", "kg", "bv", "nv", "board", "authority", "office", "trust", "bank", "cooperative", "insurance", "council", "city", "ministry", "company", "sons", "haulage", "clinics", "registry", "university", "association", "foundation", "group", "holding", "stadt", "société", "verein"}
_SKIP = set("the a an in on of to at by for from with under over it its we he she they there this that these those whether nothing however therefore moreover nonetheless consequently accordingly held reference costs nach der die das den dem ein eine auf aus als zu und il elle la le les un une des du au aux sur dans par".split())
_ROLES = {"registry", "info", "office", "contact", "enquiries", "inquiries", "admin", "mail", "post", "hello", "support", "kanzlei", "greffe", "service", "reception", "press", "noreply", "no-reply"}

_UP = "".join(chr(c) for c in range(0x41, 0x180) if chr(c).isupper())
_LETTER = "A-Za-zÀ-ÖØ-öø-ɏ"
_TAIL = rf"[{_LETTER}]+(?:-(?:[OD]['’])?[{_UP}][{_LETTER}]+)*"
_WORD = rf"[{_UP}](?:{_TAIL}|['’][{_UP}]{_TAIL})"
_PART = r"(?:[vV][ao]n(?:\s+de[rn])?|[dD]e(?:\s+la)?|[dD]el|[dD]er|[dD]u|[dD][ai])"
_LEAD = rf"[{_UP}](?:{_TAIL}|\.|['’][{_UP}]{_TAIL})"
#: A run of capitalised words, initials and particles; a comma only between two single words. Particles before it are added when it is judged.
_RUN = re.compile(rf"{_LEAD}(?:(?:\s+|(?<=\.))(?=[{_UP}vd])(?:{_PART}\s+)?{_LEAD})*(?:,\s+{_WORD}(?![{_LETTER}])(?=\s*(?:,|\(|\n|\s[a-z]|$)|\s+(?:V\.?|AGAINST|\./\.)\s))?")
_PIECE = re.compile(rf"{_PART}(?=\s)|{_WORD}|[{_UP}]\.")

#: What stands before a protected slot, as the last word before it, and what separates the sides of a case.
_CUES = {"coram", "before", "presiding", "counsel", "vorsitz", "vorsitzende", "vorsitzender", "besetzung", "composition", "président", "présidente", "avocat", "avocate", "rechtsanwalt", "rechtsanwältin", "témoin", "zeuge", "zeugin", "witness", "selon", "angaben"}
#: What stands after one: the usual words of testimony, residence and representation. The turns of the texts at hand are counted (see :func:`_contexts`).
_AFTER = re.compile(
    r"\s*(?:,\s+(?:who|a\s+neighbour|advocate|wohnhaft|domicilié|demeurant)\b|\(instructed\b|\(counsel\b"
    r"|(?:gave\s+evidence|resides|appeared|testified|lives)\b|(?:hat\s+ausgesagt|ist\s+erschienen|wurde\s+(?:angehört|vernommen)|wohnt)\b"
    r"|(?:demeure|(?:n['’])?a\s+(?:été\s+entendu|témoigné|(?:pas\s+)?comparu))\b|[^\S\n]J\s*$)",
    re.MULTILINE,
)
_SIDE_AFTER = re.compile(r"\s+(?:[vV]\.?|\./\.|against|AGAINST|gegen|contre)\s")
#: A line that is no running text: a label, docket, signature or case name.
_LABELLED = re.compile(rf"\s*(?:(?:{'|'.join(sorted(_CUES))}|registry)\s*:|docket\b|judge\b)", re.IGNORECASE)
_CASE_NAME = re.compile(r".*\s(?:[vV]\.?|\./\.|against|AGAINST|gegen|contre)\s")
_CITED = re.compile(r"\[\d{4}\]\s")
_CITED_NAMES = re.compile(rf"(?:\b(?:In\s+)?Re\s+)?{_WORD}(?:\s+{_WORD})*(?:\s+v\.?\s+{_WORD}(?:\s+{_WORD})*)?(?:\s+\(No\s+\d+\))?\s+$")

_AT = re.compile(r"[@\[(](?:(?<=@)|at[\])])")
_MAIL = re.compile(r"[A-Za-z0-9][\w.+-]*\s?(?:@|\[at\]|\(at\))\s?[A-Za-z0-9][\w-]*(?:(?:\.|\s?(?:\(dot\)|\[dot\])\s?)[A-Za-z0-9][\w-]*)+")
#: Where any number of five digits or more can be, with all that a phone or identity number consists of; what is looked for in numbers is looked for only there.
_NUMERIC = re.compile(r"\d(?:[A-Z\s()./+-]*+\d){4}[\dA-Z\s()./+-]*+")
#: Where a phone or identity number can be: at least seven signs of digits and what separates them.
_DIGITS = re.compile(r"\d[\d\s()./+-]{5,}\d")
#: Identity numbers by form, then by the label before them.
_ID_FORMS = (
    re.compile(r"\d{3}[-\s]\d{2}[-\s]\d{4}\b|\d{2}[\s.]?\d{3}[\s.]?\d{3}[\s.]?\d{3}\b|\d{6}[-/\s]?\d{4}\b"),
    re.compile(r"\d{6,7}(?:[A-Z]\d[A-Z])?\b"),  # after one to five capitals
)
_ID_LABEL = re.compile(
    r"\b(?:NRN|SSN|TIN|NINO|ID\s+number|[Ii]dentity\s+card|Steuer-ID|Personenkennzahl|[Aa]usweis|Reisepass|Führerschein|[Pp]assport|[Dd]riv(?:ing|er['’]?s)\s+licen[cs]e"
    r"|[Tt]ax\s+identification(?:\s+number)?|[Nn]ational\s+(?:register|[Ii]nsurance)|[Ss]ocial\s+[Ss]ecurity(?:\s+number)?|sécurité\s+sociale|numéro\s+(?:fiscal|national)|[Pp]asseport|permis\s+de\s+conduire|registre\s+national|carte\s+d['’]identité|Sozialversicherungsnummer|Steuernummer)"
    r"(?:\s+(?:[Nn]o\.?|Nr\.?|[Nn]umber|numéro|n°))?\s*:?\s+$"
)
#: A number of any other form, after a label that says it is one of identity.
_ID_ANY = re.compile(r"(?=(?:[A-Z./-]*\d){5})[A-Z]{0,5}\d[A-Z\d]*(?:[./-][A-Z\d]+)*(?![^\W_])")
_MANY_DIGITS = re.compile(r"\d(?:[A-Z./-]*\d){4}")
#: The last words of these labels.
_ID_LAST = frozenset("nrn ssn tin nino no nr number numéro n° card id steuer-id personenkennzahl ausweis reisepass personalausweis führerschein passport licence license identification register insurance security sociale fiscal national passeport conduire identité d'identité d’identité sozialversicherungsnummer steuernummer".split())
_PHONE = re.compile(r"\+\d{1,3}(?:[\s./-]\(?\d{2,7}\)?){2,5}|\(0\d{2,4}\)[\s-]?\d{2,4}(?:[\s-]?\d{2,4}){1,3}|00\d{1,3}(?:[\s/.-]\d{2,7}){2,4}|0\d{2,4}(?:[\s/-]\d{2,6}){1,3}|0\d{8,10}|\(\d{3}\)\s?\d{3}[-.\s]\d{4}(?!\d)|(?:\(555\)\s?)?555-\d{4}")
#: What says of a number right after it that it is a phone number; others are told by their form, unless their sentence speaks of other numbers.
_PHONE_CUE = re.compile(r"(?:t[eé]l(?:ephone|efon|éphone)?\.?(?:\s*(?:no|Nr)\.?)?\s*:?|[Pp]hone\s*:?|[Mm]obile?\s*:?|[Cc]all(?:er)?\b[^.;]{0,30}?|\bused|\bunder|\bunter|\bau|\bvon|\bvenait\s+du|\bnuméro|\breached\s+(?:at|on|under)|\bAnruf\w*)\s*$", re.IGNORECASE)
_OTHER_NUMBER = r"(?:docket|account|policy|invoice|konto|compte|line|ligne|aktenzeichen|rechnung|facture|dossier|iban)"
_NOT_PHONE = re.compile(rf"{_OTHER_NUMBER}(?:\s+(?:no\.?|Nr\.?|number|nummer|numéro|n°))?\s*:?\s*$", re.IGNORECASE)
_NOT_PHONE_NEAR = re.compile(rf"\b{_OTHER_NUMBER}\b", re.IGNORECASE)
#: Between numbers that are named together.
_LISTED = re.compile(r"\s*(?:,|;|/|&|(?:,\s*)?(?:and|or|und|oder|et|ou))\s*")
_PUBLIC = re.compile(r"\b(?:registry|enquiries|greffe|geschäftsstelle|switchboard)\b", re.IGNORECASE)
#: Where the sentence before a number begins: after a stop that is not of a label, a blank line, or at a line with a paragraph number or label.
_SENTENCE_END = re.compile(r"(?:(?<!\bno)(?<!\bnr)(?<!\btel)(?<!\btél)\.|[;!?])\s|\n\s*\n|(?<!,)\n(?=\s*(?:§|Rn\.|[\[(]?\d{1,3}[\]).]?\s|—|[^\W\d]+:\s))", re.IGNORECASE)
#: The number of a paragraph on the line after a phone number, before its text.
_PARAGRAPH = re.compile(r"\n\(?\d{1,3}(?:(?P<tab>\)?\.?\t)|(?:\)|\.)\s+\S)")


def _phone_end(text: str, a: int, b: int) -> int:
    """Where the phone number at a .. b ends: before a paragraph number on the next line, if what stands before that can be whole."""
    line = text.rfind("\n", a, b)
    paragraph = _PARAGRAPH.match(text, line) if line >= 0 else None
    if paragraph is None:
        return b
    digits = sum(c.isdigit() for c in text[a:line])
    whole = 10 if text.startswith(("+", "00"), a) else 9
    return line if digits >= (7 if paragraph["tab"] else whole) else b


def _is_phone(before: str) -> bool:
    """Whether a number of the form of a phone number, after this text, is one of a person."""
    if _NOT_PHONE.search(before):
        return False
    ends = [m.end() for m in _SENTENCE_END.finditer(before)]
    sentence = before[ends[-1] :] if ends else before
    return not _PUBLIC.search(sentence) and bool(_PHONE_CUE.search(before) or not _NOT_PHONE_NEAR.search(sentence))


_TOWN = rf"[{_UP}][^\W\d_]+(?:-[^\W\d_]+)*"
_ENGLISH_STREET = rf"{_WORD}(?:\s+{_WORD})?\s+(?:Street|St|Road|Rd|Avenue|Ave|Boulevard|Blvd|Crescent|Parkway|Grove|Mews|Highway|Lane|Ln|Close|Court|Ct|Quay|Square|Sq|Drive|Place|Terrace|Row|Hill|Way|Gardens)\b\.?,?\s+(?:\d{{5}}\s+)?{_TOWN}(?:,?\s+\d{{5}}\b)?"
#: Addresses from the last digit of their first number on: English streets, French streets, and the number and town of a German street.
_ADDRESS = re.compile(
    rf"\d(?:\s?(?:[A-Za-z]|bis|ter)\b)?,?\s+(?:{_ENGLISH_STREET}"
    rf"|(?:rue|avenue|impasse|chemin|allée|place|quai|boulevard|cours|route)\s+(?:(?:de\s+la|des|du|de|aux?)\s+|(?:de\s+)?[ld]['’])?{_WORD}(?:\s+{_WORD})?,\s+\d{{5}}\s+{_TOWN}"
    rf"|(?P<german>\d{{5}}\s+{_TOWN}))"
)
_HOUSE = re.compile(rf"House,\s+{_ENGLISH_STREET}|Cottage,\s+{_ENGLISH_STREET}|Lodge,\s+{_ENGLISH_STREET}|Villa,\s+{_ENGLISH_STREET}")
#: What may stand before that: flat, house name, number sign, German street.
_UNIT_BEFORE = re.compile(r"(?:(?:Flat|Apartment|Apt\.?|Unit)\s+\d+[A-Za-z]?,\s+)?(?:No\.\s+)?\Z")
_HOUSE_BEFORE = re.compile(rf"(?:(?:Flat|Apartment|Apt\.?|Unit)\s+\d+[A-Za-z]?,\s+)?(?:{_WORD}\s+)?{_WORD}\s+$")
_GERMAN_BEFORE = re.compile(rf"(?:{_WORD}(?:strasse|straße|str\.?|weg|allee|gasse|platz|ufer|ring|damm)|{_WORD}(?:[ -]{_WORD})*[ -](?:Strasse|Straße|Str\.|Weg|Allee|Gasse|Platz|Ufer|Ring|Damm))\s+$")
_NOT_PRIVATE_BEFORE = re.compile(r"(?:[Nn]otices\s+go\s+to|[Rr]egistry\s*:?|[Ss]itz\s*:?|[Rr]egistered\s+office\s*:?)\s+$")
_NOT_PRIVATE_AFTER = re.compile(r"\s*\((?:registry|greffe|Geschäftsstelle)\)")


def _one_line(surface: str) -> str:
    return " ".join(surface.split())


def term_of(word: str) -> str:
    """A word as the term it is counted as: without case and accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", word.replace("’", "'")) if not unicodedata.combining(c)).casefold()


def _line_of(text: str, at: int) -> str:
    start = text.rfind("\n", 0, at) + 1
    end = text.find("\n", at)
    return text[start : end if end >= 0 else len(text)]


def _back(text: str, a: int, words: int) -> int:
    """Where so many words before ``a`` begin."""
    size = 96
    while True:
        at = max(0, a - size)
        parts = text[at:a].rsplit(None, words)
        if len(parts) > words or not at:
            return at + len(parts[0]) if len(parts) > words else 0
        size *= 4


def _local_start(text: str, at: int) -> int:
    """Where the local part of an e-mail address before ``at`` begins; ``at`` if there is none."""
    a = at - 1 if at and text[at - 1].isspace() else at
    first = a
    while first and (text[first - 1].isalnum() or text[first - 1] in "_.+-"):
        first -= 1
    while first < a and not (text[first].isascii() and text[first].isalnum()):
        first += 1
    return first if first < a else at


def _plain_matches(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[int, int]]]:
    """E-mail addresses, identity numbers, phones and street addresses: (kind, start, end), and the spans taken."""
    found, taken = [], []
    for at in _AT.finditer(text):
        m = _MAIL.match(text, _local_start(text, at.start()))
        if m and m.start() < at.start() < m.end():
            taken.append(m.span())
            local = re.split(r"\s?(?:@|\[at\]|\(at\))", m[0])[0].lower()
            if local not in _ROLES:
                found.append(("email", *m.span()))
    numeric = [m.span() for m in _NUMERIC.finditer(text)]
    numbers = [(max(0, m.start() - 1), m.end()) for a, b in numeric for m in _DIGITS.finditer(text, a, b)]  # with a plus sign or bracket before it
    for a, b in numbers:
        for m in _ID_FORMS[0].finditer(text, a, b):
            if not text[m.start() - 1 : m.start()].isalnum() and _ID_LABEL.search(text, _back(text, m.start(), 6), m.start()):
                taken.append(m.span())
                found.append(("id_number", *m.span()))
    for m in (m for a, b in numeric for m in _ID_FORMS[1].finditer(text, a, b + 1)):  # with the sign behind, for the word's end
        a = m.start()
        while a and "A" <= text[a - 1] <= "Z":
            a -= 1
        if 1 <= m.start() - a <= 5 and not text[a - 1 : a].isalnum() and _ID_LABEL.search(text, _back(text, a, 6), a):
            taken.append((a, m.end()))
            found.append(("id_number", a, m.end()))
    for m in (m for a, b in numeric for m in _MANY_DIGITS.finditer(text, a, b)):
        a = m.start()
        while a and (text[a - 1] in "./-" or text[a - 1].isalnum()):
            a -= 1
        if text[_back(text, a, 1) : a].strip(" \n\t:.").lower() in _ID_LAST and (number := _ID_ANY.match(text, a)) and _ID_LABEL.search(text, _back(text, a, 6), a):
            if not any(x < number.end() and a < y for x, y in taken):
                taken.append(number.span())
                found.append(("id_number", *number.span()))
    for pattern in (_ADDRESS, _HOUSE):
        for m in pattern.finditer(text):
            start = m.start()
            while pattern is _ADDRESS and start and text[start - 1].isdigit():
                start -= 1
            head = _back(text, start, 6)
            if pattern is _HOUSE:
                lead = _HOUSE_BEFORE.search(text, head, start)
            elif m["german"]:
                lead = _GERMAN_BEFORE.search(text, head, start)
            elif text[start - 1 : start].isalnum() or text[start - 1 : start] == "-":
                continue
            else:
                lead = _UNIT_BEFORE.search(text, head, start)
            if lead is None:
                continue
            start = lead.start()
            taken.append((start, m.end()))
            if not _NOT_PRIVATE_BEFORE.search(text, _back(text, start, 4), start) and not _NOT_PRIVATE_AFTER.match(text, m.end()):
                found.append(("address", start, m.end()))
    number_end, personal = 0, False  # what stands before another number is not this one's label, unless they are listed together
    for m in (m for a, b in numbers for m in _PHONE.finditer(text, a, b)):
        start, end = m.start(), _phone_end(text, *m.span())
        around = text[start - 1 : start] + text[end : end + 1]
        if any(c.isalnum() or c in "+/-" for c in around) or text[end : end + 2].startswith(".") and text[end + 1 : end + 2].isdigit():
            continue
        if not (number_end and _LISTED.fullmatch(text, number_end, start)):
            personal = _is_phone(text[max(number_end, _back(text, start, 14)) : start])
        number_end = end
        if not personal or any(a < end and start < b for a, b in taken):
            continue
        taken.append((start, end))
        found.append(("phone", start, end))
    return found, taken


def _masked(text: str, taken: list[tuple[int, int]]) -> str:
    """The text with citations and other matches blotted out, places kept."""
    marks = list(taken)
    for m in _CITED.finditer(text):
        names = _CITED_NAMES.search(text, _back(text, m.start(), 12), m.start())
        marks.append((names.start() if names else m.start(), m.end()))
    out, at = [], 0
    for a, b in sorted(marks):
        if b > at:
            a = max(a, at)
            out += [text[at:a], "#" * (b - a)]
            at = b
    return "".join(out) + text[at:]


def _lines(text: str, run: str, start: int) -> Iterator[tuple[int, int]]:
    """The parts of a run of several lines: what stands on a line of a heading, or on a short one, ends there; running text goes on."""
    a, open_at = start, None
    for line in run.split("\n"):
        b = a + len(line)
        first = a if open_at is None else open_at
        whole = text[text.rfind("\n", 0, b) + 1 : b]
        if b < start + len(run) and len(whole) >= 30 and not _LABELLED.match(whole) and (len(whole) >= 100 or not _CASE_NAME.match(whole)):
            open_at = first
        else:
            yield first, b
            open_at = None
        a = b + 1


def _is_side(text: str, a: int, b: int) -> bool:
    """Whether a single V. at a .. b separates the sides of a case rather than being an initial."""
    line = _line_of(text, a)
    return len(line) < 100 and not _LABELLED.match(line) and not line.rstrip().endswith((".", ",")) and not _SIDE_AFTER.search(line.replace("V.", ""))


def _runs(text: str, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int, str, bool]]:
    """Runs of capitalised words outside citations and other matches: (start, end, slot, led; see :func:`_slot`). Slots: p protected, s side of a case name, n none."""
    text = _masked(text, taken)
    for m in _RUN.finditer(text):
        start, end = m.span()
        run = m[0]
        if run in _SKIPPED or text[end : end + 1] in _CODE or (start and ((c := text[start - 1]) in _JOINED or c.isalnum())):
            continue
        if "\n" not in run and "V." not in run and ("A" not in run or "AGAINST" not in run and "GEGEN" not in run and "CONTRE" not in run):
            found = _slot(text, start, end)
            if found:
                yield found
        else:
            for a, b in [(start, end)] if "\n" not in run else _lines(text, run, start):
                for x, y in _sides(text, a, b):
                    found = _slot(text, x, y)
                    if found:
                        yield found


_opened: dict[str, tuple[int, str, bool]] = {}
_SPACE = re.compile(r"\s*")


def _open(run: str) -> tuple[int, str, bool]:
    """Where a run begins after titles and cue words, the slot these make, and whether there were any."""
    words = run.split()
    slot, first = "n", 0
    while first < len(words) and (w := words[first]) in _OPENERS:
        if w not in _SKIPPED:
            slot = "p"
        first += 1
    if first and words[first - 1] == "Angaben" and words[first : first + 1] == ["von"]:
        first += 1
    return _after_words(run, first), slot, bool(first)


def _after_words(run: str, n: int) -> int:
    """Where a run goes on after its first ``n`` words."""
    at = _SPACE.match(run).end()
    for _ in range(n):
        while at < len(run) and not run[at].isspace():
            at += 1
        at = _SPACE.match(run, at).end()
    return at


def _slot(text: str, a: int, b: int) -> tuple[int, int, str, bool] | None:
    """The run at a .. b without titles and cue words, with the particles before it, and the slot it stands in: (start, end, slot, whether what is before it says so)."""
    run = text[a:b]
    if text[b : b + 1] == ":":  # a label, not a name
        parts = run.rsplit(None, 1)
        if len(parts) < 2:
            return None
        run = parts[0]
        b = a + len(run)
    opened = _opened.get(run)
    if opened is None:
        opened = _open(run)
        if len(_opened) < 500_000:
            _opened[run] = opened
    skip, slot, cut = opened
    start = a + skip
    if start >= b:
        return None
    last, side = "", False
    if not cut:
        near = text[max(0, a - 64) : a].rsplit(None, 1)
        if len(near) == 2 and near[1] not in _PARTICLES and near[1] not in _CUES_BEFORE:
            before, last = [], near[1]
            side = last in _SEPARATORS_AFTER
        else:
            before = text[_back(text, a, 5) : a].split()
        if before:
            last = before[-1]
            if last in _PARTICLES:
                lead = []
                while before and before[-1] in _PARTICLES and len(lead) < 2:
                    lead.insert(0, before.pop())
                if lead == ["von"] and before and before[-1] == "Angaben":
                    slot = "p"
                else:
                    start = _SPACE.match(text, _back(text, a, len(lead))).end()
                last = before[-1] if before else ""
            if last in _CUES_BEFORE:
                if last not in _LAST_OF_TWO or len(before) > 1 and before[-2].lower() in ("statement", "angaben", "zeuge", "zeugin"):
                    slot = "p"
            else:
                side = last in _SEPARATORS_AFTER
    led = slot == "p"
    if slot == "n":
        after = text[b : b + 64].split(None, 1)
        if after:
            if after[0] in _FIRST_AFTER and _AFTER.match(text, b):
                slot = "p"
            elif side or after[0] in _SEPARATORS_AFTER:
                slot = "s"
    if text.startswith("M.", start) and (rest := _after_words(text[start:b], 1)) < b - start and text[start + 2].isspace() and not (last[-1:] == ":" or side or last in ("of", "Selon")) and _FRENCH.search(text):
        start, slot, led = start + rest, "p", True
    return start, b, slot, led


_AFTER_WORDS = re.compile(r"(,|['’]s)?\s+([^\W\d_A-Z]['’\w]*)(?:\s+([^\W\d_]['’\w]*))?")


_after: dict[str, tuple[str, ...]] = {}


def _contexts(text: str, b: int) -> tuple[str, ...]:
    """The word and the two words after a run that goes on in lower case, with a comma or possessive ending before them, as the terms they are counted as."""
    m = _AFTER_WORDS.match(text, b)
    if not m:
        return ()
    found = _after.get(m[0])
    if found is None:
        one = f"\x01{(m[1] or '').replace('’', chr(39))} {m[2].replace('’', chr(39))}"
        found = (one, f"{one} {m[3].replace('’', chr(39)).lower()}") if m[3] else (one,)
        if len(_after) < 500_000:
            _after[m[0]] = found
    return found


def _sides(text: str, a: int, b: int) -> Iterator[tuple[int, int]]:
    """The parts of a run between separators written V. as in a case name."""
    at = a
    if text.startswith(("AGAINST ", "GEGEN ", "CONTRE "), a):
        at = text.index(" ", a) + 1
    elif text.startswith("V. ", a) and a and text[a - 1] == " " and _is_side(text, a, a + 2):
        at = a + 3
    for m in _SIDES.finditer(text[a:b]):
        if "V" not in m[0] or _is_side(text, a + m.start(), a + m.end()):
            yield at, a + m.start()
            at = a + m.end()
    yield at, b


_CODE = frozenset("-0123456789_@")
_JOINED = frozenset("@.+’'-_")

def _forms(words: set[str]) -> set[str]:
    return {f for w in words for f in (w.capitalize(), w.upper(), w)}


_SKIPPED = frozenset(_forms(_SKIP))
_OPENERS = frozenset(_forms(_TITLES) | {t.capitalize() + "." for t in _TITLES} | _forms(_CUES) | _SKIPPED)
_LAST_OF_TWO = {"of", "von", "wurde"}
_CUES_BEFORE = frozenset(_forms(_TITLES) | {f + "." for f in _forms(_TITLES)} | {f + ":" for f in _forms(_CUES)} | _forms({"témoin", "selon", "witness"}) | _LAST_OF_TWO)
_SEPARATORS_AFTER = frozenset({"v", "v.", "V", "V.", "./.", "against", "AGAINST", "gegen", "GEGEN", "contre", "CONTRE"})
_SIDES = re.compile(r"\s(?:V\.|AGAINST|GEGEN|CONTRE)\s")
#: The first words of what _AFTER matches.
_FIRST_AFTER = frozenset(", (instructed (counsel gave resides appeared testified lives hat ist wurde wohnt demeure a n'a n’a J".split())
_FRENCH = re.compile(r"\b(?:Aux\s+termes|Attendu\s+que|Il\s+y\s+a\s+lieu|Le\s+tribunal|La\s+requête|La\s+partie|Le\s+moyen)\b")
_FOUND = pa.list_(pa.struct([("kind", pa.string()), ("a", pa.int32()), ("b", pa.int32()), ("surface", pa.string()), ("after", pa.string())]))
_ROWS = "doc_id {key}, text string, term string, n double, protected long, found array<struct<kind: string, a: int, b: int, surface: string, after: string>>"


def _terms_of(run: str) -> tuple[str, ...]:
    return tuple(term_of(p) for p in _PIECE.findall(run) if len(p) > 2 and p.lower() not in _PARTICLES)


def _scan(keep_text: bool):
    """A mapInArrow function over (doc_id, text): a row per document with what was found and the runs (kind p, s or n), and the counts of the batch's terms."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms: dict[str, tuple[str, ...]] = {}
        for batch in batches:
            rows, said, offsets = [], [], [0]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text and (doc is not None or keep_text):
                    plain, taken = _plain_matches(text)
                    rows += [(kind, a, b, _one_line(text[a:b]), None) for kind, a, b in plain]
                    for a, b, slot, led in _runs(text, taken):
                        run = text[a:b]
                        words = terms.get(run)
                        if words is None:
                            words = _terms_of(run)
                            if len(terms) < 500_000:
                                terms[run] = words
                        if words:
                            after = _contexts(text, b)
                            rows.append((slot, a, b, run, after[-1] if after and slot == "n" else None))
                            said.append((words, slot))
                            if after:
                                said.append((after, led))
                offsets.append(len(rows))
            # each combination of words and slot once; slots are letters for runs, and whether what is before them says so for the words after them
            total, sides, protected = Counter(), Counter(), Counter()
            for (words, slot), times in Counter(said).items():
                counted = sides if slot == "s" else total
                for w in words:
                    counted[w] += times
                    if slot is True or slot == "p":
                        protected[w] += times
            for w, times in sides.items():
                total[w] += SIDE_WEIGHT * times
            n, t = batch.num_rows, len(total)
            kinds, starts, ends, surfaces, contexts = zip(*rows, strict=True) if rows else ((),) * 5
            found = pa.StructArray.from_arrays([pa.array(kinds, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(surfaces, pa.string()), pa.array(contexts, pa.string())], fields=list(_FOUND.value_type))
            columns = {
                "doc_id": (batch.column(0), pa.nulls(t, batch.column(0).type)), "text": (batch.column(1) if keep_text else pa.nulls(n, pa.string()), pa.nulls(t, pa.string())), "term": (pa.nulls(n, pa.string()), pa.array(list(total), pa.string())),
                "n": (pa.nulls(n, pa.float64()), pa.array(list(total.values()), pa.float64())), "protected": (pa.nulls(n, pa.int64()), pa.array([protected[w] for w in total], pa.int64())),
                "found": (pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), found, type=_FOUND), pa.nulls(t, _FOUND)),
            }
            for part in (0, 1):
                yield pa.RecordBatch.from_arrays([c[part] for c in columns.values()], names=list(columns))

    return scan


def disclosure(counts: DataFrame, prior: float = PRIOR) -> DataFrame:
    """term, bits of each term from its counts (term, n: occurrences, protected: in protected slots)."""
    terms = counts.groupBy("term").agg(F.sum("n").alias("n"), F.sum("protected").alias("a"))
    base = counts.agg((F.sum("protected") / F.sum("n")).alias("r")).first()["r"] or 1e-9
    rate = (F.col("a") + prior * base) / (F.col("n") + prior)
    return terms.select("term", F.log2(rate / base).alias("bits"))


def _names_in(run: str, slot: str, judged: dict[str, str]) -> list[tuple[int, int]]:
    """Where the names within a run stand, given which of its terms reveal a person (+) or are ordinary (-)."""
    pieces = [(m[0], m.start(), m.end()) for m in _PIECE.finditer(run)]
    if slot != "p" and any(p.lower() in _ORGANISATION for p, _, _ in pieces):
        return []
    kinds = []
    for p, _, _ in pieces:
        if len(p) == 2 and p[1] == ".":
            kinds.append("i")
        elif all(w in _PARTICLES for w in p.lower().split()):
            kinds.append("d")
        else:
            said = judged.get(term_of(p))
            kinds.append("w" if (said == "+" or slot != "n" and said != "-") and p.lower() not in _SKIP else "x")
    out, i = [], 0
    while i < len(pieces):
        if kinds[i] == "x":
            i += 1
            continue
        j = i
        while j < len(pieces) and kinds[j] != "x":
            j += 1
        a, b = i, j
        while b > a and kinds[b - 1] != "w":
            b -= 1
        if "w" in kinds[a:b]:
            out.append((pieces[a][1], pieces[b - 1][2]))
        i = j
    return out


_loaded: dict[str, dict[str, str]] = {}


def _block(path: str) -> dict[str, str]:
    """The judged terms in a file, the last one of each worker kept."""
    if path not in _loaded:
        system, at = filesystem(path)
        with system.open_input_file(at) as f:
            rows = pq.read_table(f, columns=["term", "sign"])
        _loaded.clear()
        _loaded[path] = dict(zip(rows["term"].to_pylist(), rows["sign"].to_pylist(), strict=True))
    return _loaded[path]


class _Judge:
    """Judges runs by the disclosure of their terms, kept in blocks of files."""

    def __init__(self, blocks: list[str]):
        self.blocks = blocks
        self.known: dict[tuple[str, str], list[tuple[int, int, str]]] = {}
        self.contexts: dict[str, bool] = {}

    def _opens(self, contexts: list[str | None]) -> np.ndarray:
        """Which of the words after a run put it into a protected slot."""
        if len(self.contexts) > 500_000:
            self.contexts = {}
        parts = {c: [c, " ".join(c.split(" ")[:2])] for c in contexts if c is not None and c not in self.contexts}
        wanted = {x for own in parts.values() for x in own}
        said: dict[str, str] = {}
        for path in self.blocks if wanted else ():
            block = _block(path)
            said |= {x: block[x] for x in wanted if x in block}
        self.contexts |= {c: any(said.get(x) == "+" for x in own) for c, own in parts.items()}
        return np.array([c is not None and self.contexts[c] for c in contexts], bool)

    def _learn(self, runs: list[tuple[str, str]]) -> None:
        """The names within each (slot, run) not judged yet."""
        if len(self.known) > 500_000:
            self.known = {}
        wanted = [x for x in runs if x not in self.known]
        terms = {t for _, run in wanted for t in _terms_of(run)}
        judged: dict[str, str] = {}
        for path in self.blocks:
            block = _block(path)
            judged |= {t: block[t] for t in terms if t in block}
        for slot, run in wanted:
            self.known[slot, run] = [(a, b, _one_line(run[a:b])) for a, b in _names_in(run, slot, judged)]

    def spans(self, column: pa.ListArray) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, list[str]]:
        """All that is personal in the documents of a batch, given what was found in each and its runs: (document, kind, start, end, surface), by document."""
        cells = column.flatten()
        owner = pc.list_parent_indices(column).to_numpy()
        kinds, surfaces = (cells.field(f).dictionary_encode() for f in (0, 3))
        start, end = (cells.field(f).to_numpy() for f in (1, 2))
        names, words = kinds.dictionary.to_pylist(), surfaces.dictionary.to_pylist()
        slots = kinds.indices.to_numpy().astype(np.int64)
        after = cells.field(4).dictionary_encode()
        opens = np.append(self._opens(after.dictionary.to_pylist()), False)[pc.fill_null(after.indices, -1).to_numpy()]
        if opens.any():
            if "p" not in names:
                names.append("p")
            slots = np.where(opens, names.index("p"), slots)
        # each combination of kind and surface once
        code, place = np.unique(slots * max(1, len(words)) + surfaces.indices.to_numpy(), return_inverse=True)
        each = [(names[c // len(words)], words[c % len(words)]) for c in code.tolist()]
        self._learn([x for x in each if len(x[0]) == 1])
        inside = [self.known[x] if len(x[0]) == 1 else [(0, -1, x[1])] for x in each]
        count = np.array([len(x) for x in inside], np.int64)
        flat = [(("name" if len(x[0]) == 1 else x[0]), *y) for x, ys in zip(each, inside, strict=True) for y in ys]
        first = np.cumsum(count) - count
        own = count[place]
        at = np.repeat(np.arange(len(place)), own)
        which = np.repeat(first[place] - (np.cumsum(own) - own), own) + np.arange(own.sum())
        a, b = (np.array([f[i] for f in flat], np.int64) for i in (1, 2)) if flat else (np.empty(0, np.int64),) * 2
        doc, low = owner[at], start[at] + a[which]
        high = np.where(b[which] < 0, end[at], start[at] + b[which])
        kind, surface = [flat[i][0] for i in which.tolist()], [flat[i][3] for i in which.tolist()]
        # what is a name at one place of a document is one wherever it stands alone there
        named = {f[3] for f in flat if f[0] == "name"}
        alone = np.array([len(x[0]) == 1 and not ys and _one_line(x[1]) in named for x, ys in zip(each, inside, strict=True)], bool)
        if alone.any():
            known = {(d, s) for d, k, s in zip(doc.tolist(), kind, surface, strict=True) if k == "name"}
            more = [(int(owner[i]), int(start[i]), int(end[i]), s) for i in np.flatnonzero(alone[place]).tolist() if (int(owner[i]), s := _one_line(each[place[i]][1])) in known]
            if more:
                d, x, y, s = zip(*more, strict=True)
                doc, low, high = np.append(doc, d), np.append(low, x), np.append(high, y)
                kind, surface = kind + ["name"] * len(more), surface + list(s)
                order = np.argsort(doc, kind="stable")
                doc, low, high = doc[order], low[order], high[order]
                kind, surface = [kind[i] for i in order.tolist()], [surface[i] for i in order.tolist()]
        return doc, kind, low, high, surface


def _scanned(documents: DataFrame, keep_text: bool) -> tuple[DataFrame, list[str]]:
    """The documents with what was found in them, written down, and the files of judged terms."""
    key = documents.schema["doc_id"].dataType.simpleString()
    rows = materialize(documents.select("doc_id", "text").mapInArrow(_scan(keep_text), _ROWS.format(key=key)), "personal")
    counts, context = rows.where("term is not null"), F.col("term").startswith("\x01")
    terms = disclosure(counts.where(~context)).select("term", F.when(F.col("bits") >= REVEALS, "+").when(F.col("bits") < ORDINARY, "-").alias("sign"))
    contexts = disclosure(counts.where(context), CONTEXT_PRIOR).select("term", F.when(F.col("bits") >= CONTEXT_REVEALS, "+").alias("sign"))
    judged = materialize(terms.unionByName(contexts).where("sign is not null"), "disclosure")
    blocks = -(-judged.count() // BLOCK_TERMS)
    if blocks:
        judged = materialize(judged.repartition(blocks, "term"), "terms")
    return rows.where("found is not null"), judged.inputFiles() if blocks else []


def find_personal(documents: DataFrame) -> DataFrame:
    """Each piece of personal information at each place: doc_id, kind, surface, start, end (characters of the text).

    ``documents``: doc_id, text; other columns are ignored. Kinds are name, address, email, phone, id_number;
    white space in a surface is one blank. Texts are read whole; null and empty ones and rows without doc_id give
    nothing; copies of a text give the same rows under each doc_id. Terms are judged by counts over all
    documents. Labels and cues are looked for among the words before and after a place, of any length.
    """
    rows, blocks = _scanned(documents, False)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judges = _Judge(blocks)
        for batch in batches:
            doc, kind, low, high, surface = judges.spans(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc)), pa.array(kind, pa.string()), pa.array(surface, pa.string()), pa.array(low, pa.int32()), pa.array(high, pa.int32())], names=["doc_id", "kind", "surface", "start", "end"])

    key = documents.schema["doc_id"].dataType.simpleString()
    return rows.where("doc_id is not null").select("doc_id", "found").mapInArrow(judge, f"doc_id {key}, kind string, surface string, start int, end int")


def clean(documents: DataFrame) -> DataFrame:
    """doc_id, text with each place of personal information (see :func:`find_personal`) replaced by its kind in brackets, such as [NAME].

    Only these places are touched: the same words in a citation or a company's name stay. Rows without doc_id are cleaned too; null and empty texts
    stay as they are. Texts are written once beside what was found in them and never shuffled.
    """
    rows, blocks = _scanned(documents, True)

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judges = _Judge(blocks)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            doc, kind, low, high, _ = judges.spans(batch.column(2))
            edges = np.searchsorted(doc, np.arange(len(texts) + 1))
            for i in np.flatnonzero(np.diff(edges)).tolist():
                own = slice(edges[i], edges[i + 1])
                texts[i] = _replaced(texts[i], list(zip(low[own].tolist(), high[own].tolist(), kind[own], strict=True)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    key = documents.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "text", "found").mapInArrow(replace, f"doc_id {key}, text string")


def _replaced(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for a, b, kind in sorted(spans, key=lambda x: (x[0], -x[1])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        elif b > at:
            out.append(f"[{kind.upper()}]")  # overlaps what is replaced already; its rest goes too
        at = max(at, b)
    return "".join(out) + text[at:]
