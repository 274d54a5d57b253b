"""Personal information in free text: find it, type it, replace it with placeholders.

A skip-chain conditional random field. Its variables are the mentions of a text that could be personal
information (spans proposed by form: numbers, codes, addresses, e-mail notations, capitalised names); its
labels are the kinds and 'none'. Unary potentials come from features of the span and the words around it;
chain potentials link neighbouring mentions; skip potentials link distant mentions whose text is the same or
that share a surname, so that a mention in a telling place decides for its repetitions. Loopy belief
propagation over each text gives the labels.

Names are proposed from capitalised words: known given names, initials and titles with what follows, and any
other run of two or three capitalised words that are not ordinary ones. What is known of given names is learned
from the entities and their aliases (``names.learn``); which words are ordinary, open sentences, stand alone or
close runs is counted over all texts (``vocabulary``). Whether a run of unknown words is a name is decided by the
field alone.

The field is trained here, piecewise: the unary part is a softmax over hashed features, fitted on mentions
of TRAIN_TEXTS texts of each table (those with the smallest hashed ids) which rules label with high
precision; every labelled name takes part again without what the rules saw (known given name, title, initial), with and
without the words around it, so that the rest must tell it. Mentions that no rule labels take no part. Chain and skip
potentials are smoothed log odds of the labels of linked mentions in the same texts; a bare surname counts there
with the label of the full name it repeats. Every text is scanned whole.

Defined results. Null and empty texts hold nothing. Of overlapping mentions the one of the longer-ranging
kind stays (e-mail, address, identity number, telephone, name). Repeated items of a text are one row of
``items`` and are all replaced in ``redacted``. Empty tables give empty results.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemic.llm import names, sample
from mnemic.llm.names import Lexicon
from mnemic.session import spread

KINDS = ("none", "email", "phone", "id_number", "address", "name")
PLACEHOLDER = {k: f"[{k.upper()}]" for k in KINDS[1:]}
TRAIN_TEXTS = 4000
DIM, STEPS, ROUNDS, DAMPING = 1 << 13, 120, 6, 0.3
#: Characters between neighbours in the chain; smoothing of the pairwise counts.
REACH, SMOOTH = 80, 2.0

#: A word in lower case is an ordinary one if this share of all texts (and three) has it; what is known of a capitalised
#: word is kept if this share has it. As a text has a bounded number of words, so have these lists.
ORDINARY, NOTED, LEAST = 4e-4, 2e-5, 3
#: A capitalised word with at least this share of texts (and OFTEN) is a frequent one.
FREQUENT, OFTEN = 2e-3, 20

# Words of streets, labels of identity numbers, labels of other numbers, endings of files, articles.
STREET = "Street St Road Rd Avenue Ave Boulevard Blvd Lane Ln Drive Dr Court Ct Crescent Terrace Row Hill Close Place Square Gardens Way Grove".split()
ID_LABELS = ("ssn", "soc. sec. number", "social security", "national insurance", "ni number", "dni", "passport", "personalausweis", "identity card", "id card", "tax number", "taxpayer id", "steuer-id", "health record", "insurance id", "patient id", "travel document", "nif", "nie",
             "aadhaar", "driver licence", "driver license", "driver's license", "driving licence", "social insurance", "residence permit", "voter id", "citizen id", "national id", "nhs number",
             "medicare", "cpf", "codice fiscale", "pesel", "bsn", "personnummer", "carte d'identité", "carta d'identità", "documento de identidad", "sozialversicherungsnummer")
THING_LABELS = ("order", "invoice", "isbn", "part", "batch", "weighed", "entry", "p.", "lot", "model", "serial", "ticket", "sku", "version")
ARTICLES = frozenset("the a an der die das den dem des ein eine einen einem einer le la les un une des du el los las una il lo gli o os as um uma".split())
# Words that end names of places, institutions and papers, and words that open names of places.
ENDS = frozenset("park bridge station valley railway river lake mountain mountains island islands bay beach coast castle church cathedral palace tower airport harbour harbor county city town village district province university school hospital hotel theatre theater library museum gallery gazette times journal news magazine press company group bank council committee club league party ministry office festival award prize act war battle treaty house hall".split())
OPENS = frozenset("north south east west northern southern eastern western new old saint lake mount upper lower great little fort port cape monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december".split())
FILES = frozenset("png jpg jpeg gif svg webp css js pdf html php".split())

_WORD = re.compile(r"[^\W_]+")
_AT = r"(?:\s?(?:@|\(at\)|\[at\]|\{at\}|\(a\))\s?)"
_DOT = r"(?:\.(?=\w)|\s?(?:\(dot\)|\[dot\]|\{dot\})\s?|\sdot\s)"
EMAIL = re.compile(rf"(?<![\w.+-])[\w][\w.+-]*(?:{_AT}[\w-]+(?:{_DOT}[\w-]+)+|\sat\s[\w-]+(?:\sdot\s[\w-]+)+)", re.I)
_EMAIL_SIGN = re.compile(r"@|[(\[{]at?[)\]}]|\sdot\s", re.I)
NUMBER = re.compile(r"(?<![\w@#.,/\-])(?:\+\d|\(\d|\d)[\d  \-./()]{5,24}\d(?![\w])")
CODE = re.compile(r"(?<![\w@/.-])(?:[A-Z]{2} ?\d\d ?\d\d ?\d\d ?[A-Z]|[A-Z]{1,3}-\d{2,6}-\d{2,6}|(?=[A-Z]{0,10}\d)(?=\d{0,10}[A-Z])[A-Z\d]{8,18})(?![\w@])", re.I)
_N = r"[^\W\d_][\w'’\-]+"
_C = r"[A-ZÀ-ÖØ-Þ][\w'’\-]+"


def _address(c: str) -> str:
    town = rf"{c}(?:\s[A-Z]{{1,2}}\d[A-Z\d]?\s\d[A-Z]{{2}}\b)?"
    code = rf"\d{{4,5}}\s{c}"
    return (
        rf"(?<![\w-])(?:(?i:flat|apt\.?|unit|suite)\s\d+\w?,\s)?\d{{1,4}}[a-h]?\s{c}(?:\s{c})?\s(?i:{'|'.join(STREET)})\b\.?,?\s{town}"
        rf"|(?<![\w-])\d{{1,4}},?\s(?i:rue|avenue|boulevard|place|chemin)\s(?:(?i:de la|du|des|de|d['’])\s?)?{c}(?:,?\s{code})"
        rf"|(?<![\w-])(?i:calle|avenida|plaza|paseo)\s(?:(?i:de la|del|de)\s)?{c}\s\d{{1,4}}(?:,?\s{code})"
        rf"|(?<![\w-])(?i:rua|travessa|praça|largo|via|viale|piazza|corso|vicolo)\s(?:(?i:della|del|delle|dei|di|das|dos|da|do|de)\s)?{c}(?:\s{c})?,?\s\d{{1,4}}\w?(?:,?\s(?:\d{{4,5}}(?:-\d{{3}})?)\s{c})"
        rf"|(?<![\w-]){c}(?i:weg|stra(?:ß|ss)e|gasse|platz|allee)\s\d{{1,4}}(?:/\d+)?\w?(?:,?\s{code})"
    )


ADDRESS = re.compile(_address(_C))
ADDRESS_ANY = re.compile(_address(_N), re.I)
_ADDRESS_SIGN = re.compile(rf"\b(?:{'|'.join(STREET)}|rue|calle|avenida|plaza|paseo|rua|travessa|praça|largo|via|viale|piazza|corso|vicolo)\b|(?:weg|stra(?:ß|ss)e|gasse|platz|allee)\s\d", re.I)
#: A sequence of capitalised words and initials; a word of it; a sequence within one line without commas.
_TOKEN = rf"(?:[A-Z](?![\w'’])\.?|{_C}\.?)"
_CAPS = re.compile(rf"(?<![\w@.+\-]){_TOKEN}(?:,?\s{_TOKEN})*(?![\w@])")
_CAP = re.compile(_TOKEN)
_RUN = re.compile(rf"(?<![\w@.+\-]){_C}(?: {_C})*(?![\w@])")
_LOWER_PAIR = re.compile(r"(?<![\w@.+\-])(?P<g>[a-z]{2,})(?:\s[a-z]\.?)?\s(?P<s>[a-z]{5,})(?![\w@])")


_ID_LABEL = re.compile(rf"(?<!\w)(?:{'|'.join(map(re.escape, ID_LABELS))})(?:\s(?:no\.?|nr\.?|number|card))?\s?[:#]?\s?$")
_THING_LABEL = re.compile(rf"(?<!\w)(?:{'|'.join(map(re.escape, THING_LABELS))})(?:\s(?:no\.?|number))?\s?[:#]?\s?$")
#: A word in lower case that stands by itself, not within an address or name of a host.
_PLAIN = re.compile(r"(?<!\S)[^\W\d_A-Z]+(?=[\s,.;:!?)](?:\s|$)|\s|$)")


def normal(item: str) -> str:
    """Lower case with only letters and digits kept."""
    return "".join(_WORD.findall(item.lower()))


class Mention:
    __slots__ = ("start", "end", "form", "key", "slots", "blind", "rule")

    def __init__(self, start: int, end: int, form: str, key: str) -> None:
        self.start, self.end, self.form, self.key = start, end, form, key
        self.slots: list[int] = []
        self.blind: tuple[list[int], list[int]] = [], []  # of a name, slots without what rules see: shape, words around
        self.rule = 0


def _slot(name: str) -> int:
    return zlib.crc32(name.encode()) % DIM


def _lower_lines(text: str) -> list[tuple[int, int]]:
    """Places of the lines that are typed in lower case throughout."""
    out, at = [], 0
    for line in text.split("\n"):
        if line.islower():
            out.append((at, at + len(line)))
        at += len(line) + 1
    return out


class Vocabulary:
    """What is known beforehand: given names, ordinary words, and how capitalised words stand in texts."""

    def __init__(self, lexicon: Lexicon, common: frozenset[str], place: dict[str, str]) -> None:
        self.lexicon, self.common, self.place = lexicon, common, place
        #: words that end names of streets, organisations and the like
        self.heads = frozenset(w.lower() for w in STREET) | ENDS | lexicon.nouns | frozenset(names.LEGAL)


def _word_counts(texts: list[str | None]) -> dict[str, list[int]]:
    """For each word the numbers of texts that have it in lower case, as the first and the last of a run of
    capitalised words, alone, and at the beginning of a sentence."""
    out: defaultdict[str, list[int]] = defaultdict(lambda: [0] * 5)
    for t in texts:
        if not t:
            continue
        for w in {w for w in _PLAIN.findall(t) if w.islower()}:
            out[w][0] += 1
        seen = set()
        for m in _RUN.finditer(t):
            run = m[0].split(" ")
            if len(run) == 1:
                seen.add((run[0], 3))
            else:
                seen |= {(run[0], 1), (run[-1], 2)}
            if not t[max(0, m.start() - 2) : m.start()].strip(" ") or t[max(0, m.start() - 2) : m.start()].strip(" ")[-1] in ".!?\n>":
                seen.add((run[0], 4))
        for w, k in seen:
            out[w][k] += 1
    return out


def _place(n: int, first: int, last: int, alone: int, start: int) -> str:
    """How a capitalised word stands in texts: what it mostly is, whether frequent, whether a sentence's opener."""
    total = first + last + alone
    most = "A" if 2 * alone >= total else "F" if first > last else "L"
    return most + ("h" if total >= max(OFTEN, FREQUENT * n) else "") + ("s" if start >= 0.9 * (first + alone) and first + alone >= last else "")


def _noted(n: int, rows: Iterator[tuple]) -> tuple[frozenset[str], dict[str, str]]:
    common, place = set(), {}
    for w, low, *k in rows:
        if low >= max(LEAST, ORDINARY * n):
            common.add(w)
        if sum(k[:3]) >= max(LEAST, NOTED * n):
            place[w] = _place(n, *k)
    return frozenset(common), place


def vocabulary(tables: list[DataFrame], lexicon: Lexicon) -> Vocabulary:
    """Counted over all texts of the tables (id, text); only words over the thresholds reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _word_counts(batch.column("text").to_pylist())
            cols = list(zip(*rows.values(), strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.string()), *(pa.array(c, pa.int64()) for c in cols)], names=["w", *"abcde"])

    texts = tables[0].select("text")
    for t in tables[1:]:
        texts = texts.unionByName(t.select("text"))
    texts = texts.filter("text <> ''")
    n = texts.count()
    sums = spread(texts).mapInArrow(count, "w string, a long, b long, c long, d long, e long").groupBy("w").agg(*[F.sum(c).alias(c) for c in "abcde"])
    kept = sums.filter((F.col("a") >= max(LEAST, ORDINARY * n)) | (F.col("b") + F.col("c") + F.col("d") >= max(LEAST, NOTED * n)))
    return Vocabulary(lexicon, *_noted(n, kept.collect()))


class _Word:
    """One word of a sequence: its place, text without a final stop, and lower form."""

    __slots__ = ("start", "end", "text", "low", "stop", "initial")

    def __init__(self, m: re.Match[str]) -> None:
        self.stop = m[0].endswith(".")
        self.text = m[0].rstrip(".")
        self.start, self.end = m.start(), m.start() + len(self.text)
        self.low, self.initial = self.text.lower(), len(self.text) == 1


def _name_at(text: str, seq: list[_Word], i: int, v: Vocabulary) -> tuple[str, int, int, str, int] | None:
    """(form, start, end, surname, next word) of the name that begins with word i of a sequence."""
    n = len(seq)
    forms = v.lexicon.forms

    def gap(k: int) -> str:  # what stands between word k and the next one
        return text[seq[k].end : seq[k + 1].start]

    title = seq[i].low in names.TITLES and i + 1 < n and "," not in gap(i)
    j = i + 1 if title else i
    first = seq[j]
    known = first.low in forms and not (len(first.low) < 4 and first.low in v.common) or first.initial and first.stop
    if known:
        ends = []
        for k in range(j + 1, min(n, j + 4)):  # given name, up to two more or initials, surname
            if "," in gap(k - 1) or seq[k - 1].stop and not (seq[k - 1].initial or seq[k - 1].low in forms):
                break
            if sum(c.isalpha() for c in seq[k].text) > 2:
                ends.append(k)
            if not (seq[k].initial or seq[k].low in forms):
                break
        if ends:
            k = ends[-1]
            return "p", first.start, seq[k].end, seq[k].text, k + 1
    if j + 1 < n and not first.initial and gap(j).startswith(",") and (seq[j + 1].low in forms or seq[j + 1].initial and seq[j + 1].stop):
        if first.low in v.common or first.low in forms:
            return None  # the comma divides a list
        k = j + 1
        end = seq[k].end + (1 if seq[k].stop else 0)
        if k + 1 < n and "," not in gap(k) and (seq[k + 1].initial or seq[k + 1].low in forms):
            k += 1
            end = seq[k].end + (1 if seq[k].stop else 0)
        return "q", first.start, end, first.text, k + 1
    if first.initial or first.low in v.common and not title:
        return None
    # words that nothing is known of, on one line
    k = j
    while k + 1 < n and gap(k) == " " and seq[k + 1].low not in v.common and not (seq[k + 1].low in forms and k + 2 < n and gap(k + 1) in " \n"):
        k += 1
    if title:
        last = min(k, j + 2)
        if last > j and not seq[last].initial and seq[last].low not in v.heads and "A" not in v.place.get(seq[last].text, ""):
            return "p", first.start, seq[last].end, seq[last].text, last + 1
        return "t", first.start, first.end, first.text, j + 1
    if k - j == 2 and "s" in v.place.get(first.text, ""):
        j, first = j + 1, seq[j + 1]
    if 1 <= k - j <= 2 and not first.initial and not seq[k].initial and not any(w.text.isupper() and not w.initial for w in seq[j : k + 1]):
        return "u", first.start, seq[k].end, seq[k].text, k + 1
    return None


def propose(text: str, v: Vocabulary) -> list[Mention]:
    """Mentions of a text by form, in order of their place."""
    out: list[Mention] = []
    if _EMAIL_SIGN.search(text):
        out += [Mention(m.start(), m.end(), "e", normal(m[0])) for m in EMAIL.finditer(text)]
    mails = [m.key for m in out]
    for m in NUMBER.finditer(text):
        digits = sum(c.isdigit() for c in m[0])
        if digits >= 7:
            out.append(Mention(m.start(), m.end(), "n", normal(m[0])))
    out += [Mention(m.start(), m.end(), "c", normal(m[0])) for m in CODE.finditer(text) if any(c.isdigit() for c in m[0]) and any(c.isalpha() for c in m[0])]
    if _ADDRESS_SIGN.search(text):
        out += [Mention(m.start(), m.end(), "d", normal(m[0])) for m in ADDRESS.finditer(text)]
        for line in _lower_lines(text):
            out += [Mention(m.start(), m.end(), "d", normal(m[0])) for m in ADDRESS_ANY.finditer(text, *line)]
    surnames: set[str] = set()
    taken: list[tuple[int, int]] = []

    def person(a: int, b: int, form: str, surname: str) -> None:
        out.append(Mention(a, b, form, surname.lower()))
        taken.append((a, b))
        if form != "u" and surname.lower() not in v.common and "s" not in v.place.get(surname, ""):
            surnames.add(surname)

    for m in _CAPS.finditer(text):
        if " " not in m[0] and "\n" not in m[0]:
            continue
        seq = [_Word(w) for w in _CAP.finditer(text, m.start(), m.end())]
        i = 0
        while i < len(seq):
            found = _name_at(text, seq, i, v)
            if found:
                *name, i = found
                person(name[1], name[2], name[0], name[3])
            else:
                i += 1
    for line in _lower_lines(text):
        for m in _LOWER_PAIR.finditer(text, *line):
            if m["g"] in v.lexicon.full and m["g"] not in v.common:
                person(m.start(), m.end(), "p", m["s"])
    for s in surnames:
        if text.count(s) > 1:
            for m in re.finditer(rf"(?<![\w@.+\-]){re.escape(s)}(?![\w@])", text):
                if not any(m.start() < y and x < m.end() for x, y in taken):
                    out.append(Mention(m.start(), m.end(), "b", s.lower()))
                    taken.append((m.start(), m.end()))
    out.sort(key=lambda x: (x.start, x.end))
    for x in out:
        _describe(text, x, v, mails)
    return out


def _describe(text: str, x: Mention, v: Vocabulary, mails: list[str]) -> None:
    """Features and, for training, the label that the rules give (KINDS index; -1 where they give none)."""
    span = text[x.start : x.end]
    before = text[max(0, x.start - 40) : x.start]
    after = text[x.end : x.end + 24]
    pre = _WORD.findall(before.lower())[-3:]
    post = _WORD.findall(after.lower())[:1]
    low = before.lower()
    label, thing = _ID_LABEL.search(low), _THING_LABEL.search(low)
    shape = re.sub(r"\d+", lambda m: str(len(m[0])), re.sub(r"[^\W\d_]+", "a", span)) if x.form in "nc" else ""
    digits = sum(c.isdigit() for c in span)
    feats = ["form" + x.form, f"{x.form}digits{digits}", f"{x.form}shape{shape}", f"{x.form}start{span[:1] if not span[:1].isalnum() else 'a' if span[:1].isalpha() else '0' if span[:1] == '0' else '9'}"]
    feats += [f"{x.form}pre1={pre[-1]}" if pre else f"{x.form}pre1-", f"{x.form}pre2={' '.join(pre[-2:])}", f"{x.form}post={post[0] if post else '-'}"]
    feats += [f"{x.form}idlabel{int(bool(label))}", f"{x.form}thing{int(bool(thing))}", f"{x.form}sign{before.rstrip()[-1:]}"]
    rule = 0
    if x.form == "e":
        last = re.split(r"\W+|\bdot\b", span.lower())[-1]
        file = last in FILES or not last.isalpha() or len(last) < 2
        feats.append(f"efile{int(file)}")
        rule = 0 if file else 1
    elif x.form == "n":
        phone = bool(re.match(r"\+|00|0\d|\(\d{3}\)", span)) and 9 <= digits <= 15 or bool(re.fullmatch(r"\d{3}[.\-]\d{3}[.\-]\d{4}", span))
        feats += [f"nphone{int(phone)}{int(bool(label))}{int(bool(thing))}"]
        rule = 3 if label else 0 if thing else 2 if phone else 0
    elif x.form == "c":
        letters = sum(c.isalpha() for c in span)
        feats.append(f"cmix{min(letters, 4)}{int(bool(label))}{int(bool(thing))}")
        rule = 3 if label and not thing else 0
    elif x.form == "d":
        rule = 4
    else:
        x.rule = _describe_name(text, x, v, mails, pre, post, before)
        return
    x.rule = rule
    x.slots = [_slot(f) for f in feats]


def _describe_name(text: str, x: Mention, v: Vocabulary, mails: list[str], pre: list[str], post: list[str], before: str) -> int:
    """Features of a name, with and without what rules see, and the label that the rules give."""
    words = text[x.start : x.end].replace(",", " ").split()
    head, last = (words[0], words[-1]) if x.form != "q" else (words[1], words[0])
    head, last = head.rstrip("."), last.rstrip(".")
    low = head.lower()
    plain = x.key in v.common
    known, initial = low in v.lexicon.forms, len(head) == 1
    line = text[text.rfind("\n", 0, x.start) + 1 : (text.find("\n", x.end) + 1 or len(text) + 1) - 1]
    place_h, place_l = v.place.get(head, "r"), v.place.get(last, "r")
    mailed = len(x.key) > 3 and any(normal(x.key) in m for m in mails)
    closing = x.key in v.heads
    article = bool(pre) and pre[-1] in ARTICLES and before.endswith(" ") and before.rstrip()[-1:].isalpha()
    sight = [f"known{int(known)}", f"title{int(any(before.rstrip(' .').lower().endswith(' ' + t) or before.rstrip(' .').lower() == t for t in names.TITLES))}", f"initial{int(initial)}", f"form{x.form}"]
    shape = ["bias", f"plain{int(plain)}", f"headplain{int(low in v.common)}", f"short{int(len(line.split()) < 5)}{int(plain)}", f"head{place_h}", f"last{place_l}", f"both{place_h}{place_l}"]
    shape += [f"mailed{int(mailed)}", f"closing{int(closing)}{int(low in OPENS)}", f"article{int(article)}", f"words{len(words)}"]
    around = [f"pre1={pre[-1]}" if pre else "pre1-", f"pre2={' '.join(pre[-2:])}", f"post={post[0] if post else '-'}", f"sign{before.rstrip()[-1:]}", f"suffix{x.key[-4:]}"]
    x.slots = [_slot(x.form + f) for f in sight + shape + around]
    x.blind = [_slot("u" + f) for f in shape], [_slot("u" + f) for f in around]
    if x.form == "u":
        x.slots = x.blind[0] + x.blind[1]
        if closing or low in OPENS:
            x.form = "v"
        if closing or article or low in OPENS or "A" in place_h or "A" in place_l or "s" in place_h or "h" in place_h or "Lh" in place_l:
            return 0
        return 5 if mailed else -1
    if x.form == "b":  # its full name tells
        return -1
    return 0 if plain or len(x.key) < 3 else 5


#: Labels that each form can take. Forms: e-mail, number, code, address (d), and of names with a known given name or
#: initial (p), the same with the surname first (q), a title (t), bare repetition (b), unknown words (u), of these
#: names of places and the like (v).
_ALLOWED = {"e": (0, 1), "n": (0, 2, 3), "c": (0, 3), "d": (0, 4), "p": (0, 5), "q": (0, 5), "t": (0, 5), "b": (0, 5), "u": (0, 5), "v": (0,)}


def links(mentions: list[Mention]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Chain links between neighbours and skip links between mentions of one key."""
    chain = [(i, i + 1) for i in range(len(mentions) - 1) if mentions[i + 1].start - mentions[i].end <= REACH]
    by: dict[tuple[str, str], int] = {}
    skip = []
    for i, m in enumerate(mentions):
        k = ("p" if m.form in "pqtbu" else m.form, m.key)
        if k in by:  # linked to the nearest earlier one: the links of a key form a path, not all pairs
            skip.append((by[k], i))
        by[k] = i
    return chain, skip


class Field:
    """Potentials of the trained field."""

    def __init__(self, texts: list[str], words: Vocabulary | None = None) -> None:
        """``words``: the vocabulary of the collection; by default that of these texts, with the prior given names."""
        if words is None:
            counts = _word_counts(texts)
            words = Vocabulary(names.PRIOR, *_noted(len(texts), ((w, *k) for w, k in counts.items())))
        self.words = words
        self.w = np.zeros((DIM, len(KINDS)))
        self.chain = np.zeros((len(KINDS), len(KINDS)))
        self.skip = np.zeros((len(KINDS), len(KINDS)))
        docs = [propose(t, words) for t in texts]
        told = [m for d in docs for m in d if m.rule >= 0]
        if told:
            self._fit(told)
            self._pairs(docs)

    def _fit(self, told: list[Mention]) -> None:
        rows = [(m.slots, m.rule, m.form) for m in told if m.form not in "uv"]
        weight = [1.0] * len(rows)
        runs = [m for m in told if m.form in "pqtuv"]
        for k in (5, 0):  # runs of unknown words: as many names as others, with and without the words around them
            some = [m for m in runs if m.rule == k]
            weight += [len(runs) / (4 * len(some))] * (2 * len(some)) if some else []
            rows += [(s, k, "u") for m in some for s in (m.blind[0] + m.blind[1], m.blind[0])]
        weight = np.array(weight)
        slots = np.fromiter((s for r, _, _ in rows for s in r), np.int64)
        row = np.repeat(np.arange(len(rows)), [len(r) for r, _, _ in rows])
        y = np.array([k for _, k, _ in rows])
        allowed = _allowed([f for _, _, f in rows])
        m1, m2 = np.zeros_like(self.w), np.zeros_like(self.w)
        target = np.eye(len(KINDS))[y]
        for i in range(1, STEPS + 1):
            z = _unary(self.w, slots, row, len(rows)) + allowed
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            d = (p - target) * weight[:, None] / len(rows)
            g = np.stack([np.bincount(slots, d[row, k], DIM) for k in range(len(KINDS))], 1) + 1e-7 * self.w
            m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
            self.w -= 0.15 * (m1 / (1 - 0.9**i)) / (np.sqrt(m2 / (1 - 0.999**i)) + 1e-8)

    def _pairs(self, docs: list[list[Mention]]) -> None:
        one = np.full(len(KINDS), SMOOTH)
        two = {"chain": np.full((len(KINDS),) * 2, SMOOTH), "skip": np.full((len(KINDS),) * 2, SMOOTH)}
        for d in docs:
            label = [m.rule for m in d]
            full = {m.key: m.rule for m in d if m.form in "pqt"}
            label = [full.get(m.key, -1) if m.form == "b" else k for m, k in zip(d, label, strict=True)]
            for k in label:
                if k >= 0:
                    one[k] += 1
            for name, pairs in zip(("chain", "skip"), links(d), strict=True):
                for i, j in pairs:
                    if label[i] >= 0 and label[j] >= 0:
                        two[name][label[i], label[j]] += 1
        p = one / one.sum()
        for name, n in two.items():
            odds = np.log(n / n.sum()) - np.log(p[:, None] * p[None, :])
            setattr(self, name, np.clip(0.5 * odds, -1.5, 1.5) if name == "chain" else np.clip(odds, -2, 2))

    def decode(self, docs: list[list[Mention]]) -> list[list[int]]:
        """Labels of the mentions of several texts: one run of loopy belief propagation over all of them."""
        flat = [m for d in docs for m in d]
        if not flat:
            return [[] for _ in docs]
        slots = np.fromiter((s for m in flat for s in m.slots), np.int64)
        row = np.repeat(np.arange(len(flat)), [len(m.slots) for m in flat])
        unary = _unary(self.w, slots, row, len(flat)) + _allowed([m.form for m in flat])
        src, dst, kind = [], [], []
        base = 0
        for d in docs:
            for k, pairs in enumerate(links(d)):
                for i, j in pairs:
                    src += [base + i, base + j]
                    dst += [base + j, base + i]
                    kind += [2 * k, 2 * k + 1]
            base += len(d)
        belief = unary.copy()
        if src:
            src, dst, kind = np.array(src), np.array(dst), np.array(kind)
            pot = np.stack([self.chain, self.chain.T, self.skip, self.skip.T])[kind]
            msg = np.zeros((len(src), len(KINDS)))
            back = np.arange(len(src)) ^ 1  # the two directions of a link follow each other
            for _ in range(ROUNDS):
                belief = unary.copy()
                np.add.at(belief, dst, msg)
                out = (belief[src] - msg[back])[:, :, None] + pot
                top = out.max(1)
                new = top + np.log(np.exp(out - top[:, None, :]).sum(1))
                new -= new.max(1, keepdims=True)
                msg = DAMPING * msg + (1 - DAMPING) * new
            belief = unary.copy()
            np.add.at(belief, dst, msg)
        best = belief.argmax(1).tolist()
        cut = np.cumsum([0] + [len(d) for d in docs])
        return [best[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]

    def find(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """For each text the (start, end, kind) of its items, in order, without overlaps."""
        docs = [propose(t, self.words) if t else [] for t in texts]
        return [settle(d, labels) for d, labels in zip(docs, self.decode(docs), strict=True)]


def _unary(w: np.ndarray, slots: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(row, w[slots, k], n) for k in range(len(KINDS))], 1)


def _allowed(forms: list[str]) -> np.ndarray:
    out = np.full((len(forms), len(KINDS)), -1e4)
    for i, f in enumerate(forms):
        out[i, list(_ALLOWED[f])] = 0
    return out


#: Which kind stays where two mentions overlap.
_RANK = {1: 0, 4: 1, 3: 2, 2: 3, 5: 4}


def settle(mentions: list[Mention], labels: list[int]) -> list[tuple[int, int, int]]:
    kept: list[tuple[int, int, int]] = []
    for m, k in sorted(((m, k) for m, k in zip(mentions, labels, strict=True) if k), key=lambda x: (_RANK[x[1]], x[0].start - x[0].end)):
        if not any(m.start < b and a < m.end for a, b, _ in kept):
            kept.append((m.start, m.end, k))
    return sorted(kept)


def train(tables: list[DataFrame], lexicon: Lexicon, limit: int = TRAIN_TEXTS) -> Field:
    """Fit on at most ``limit`` texts of each table (id, text), with the vocabulary of all of them."""
    return Field([x for t in tables for x in sample.texts(t, "id", "text", limit)], vocabulary(tables, lexicon))


def texts_of(documents: DataFrame, entities: DataFrame) -> list[tuple[str, DataFrame]]:
    return [("documents", documents.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))), ("entities", entities.select(F.col("id").cast("long").alias("id"), F.col("description").cast("string").alias("text")))]


def _scan(shared, table: str, redact: bool):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field: Field = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids, texts = part.column("id").to_pylist(), part.column("text").to_pylist()
                found = field.find(texts)
                if redact:
                    new, count = [], []
                    for t, items in zip(texts, found, strict=True):
                        bits, last = [], 0
                        for a, b, k in items:
                            bits += [t[last:a], PLACEHOLDER[KINDS[k]]]
                            last = b
                        new.append(None if t is None else "".join(bits) + t[last:])
                        count.append(len(items))
                    yield pa.RecordBatch.from_arrays([pa.array([table] * len(ids)), pa.array(ids, pa.int64()), pa.array(new, pa.string()), pa.array(count, pa.int32())], names=["table_name", "row_id", "text", "n_items"])
                else:
                    rows = {(i, KINDS[k], normal(t[a:b])) for i, t, items in zip(ids, texts, found, strict=True) for a, b, k in items}
                    cols = list(zip(*sorted(rows, key=str), strict=True)) or [(), (), ()]
                    yield pa.RecordBatch.from_arrays([pa.array([table] * len(rows), pa.string()), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())], names=["table_name", "row_id", "kind", "item"])

    return scan


def _over(documents: DataFrame, entities: DataFrame, aliases: DataFrame | None, prior: Lexicon | None, redact: bool, schema: str) -> DataFrame:
    tables = texts_of(documents, entities)
    if aliases is None:
        aliases = documents.sparkSession.createDataFrame([], "entity_id long, surface string")
    field = train([t for _, t in tables], names.learn(entities, aliases, prior))
    shared = documents.sparkSession.sparkContext.broadcast(field)  # DIM weights per kind and bounded word lists
    parts = [spread(t).mapInArrow(_scan(shared, name, redact), schema) for name, t in ((n, t if redact else t.filter("text <> '' and id is not null")) for n, t in tables)]
    return parts[0].unionByName(parts[1])


def items(documents: DataFrame, entities: DataFrame, aliases: DataFrame | None = None, prior: Lexicon | None = None) -> DataFrame:
    """(table_name, row_id, kind, item): the distinct items of each text. ``prior``: given names known beforehand."""
    return _over(documents, entities, aliases, prior, False, "table_name string, row_id long, kind string, item string").distinct()


def redacted(documents: DataFrame, entities: DataFrame, aliases: DataFrame | None = None, prior: Lexicon | None = None) -> DataFrame:
    """(table_name, row_id, text, n_items): every text with a placeholder in place of each item."""
    return _over(documents, entities, aliases, prior, True, "table_name string, row_id long, text string, n_items int")
