"""Names of persons and organisations: their normal forms, and what is known about given names.

What is known is a ``Lexicon``. ``PRIOR`` holds everyday names; ``learn`` adds what the tables themselves teach:
tokens that open the names of typed persons before many different surnames are given names, two given names that
stand for one entity (its canonical name and an alias with the same surname) are forms of one name, and words that
end the names of many typed organisations are nouns of organisations.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Titles, given names with common short forms, legal forms, nouns of organisations.
TITLES = frozenset("dr mr mrs ms miss mx prof professor rev capt sir dame".split())
GIVEN = {
    "abigail": "abby abbie", "adelaide": "addie", "agnes": "aggie nessie", "alexander": "alex alec sandy", "andrew": "andy drew", "anthony": "tony",
    "caroline": "carrie caro", "catherine": "cat cathy kate", "charles": "charlie chuck", "christopher": "chris topher kit", "cornelius": "neil corny",
    "edward": "ed eddie ted ned", "eleanor": "ellie nell nora", "elizabeth": "eliza liz beth betty", "emmeline": "emmy", "ernest": "ernie",
    "felicity": "fliss flick", "ferdinand": "nando ferdie", "florence": "flo flossie florrie", "francis": "frank", "frederick": "fred freddie freddy",
    "gabriel": "gabe", "geoffrey": "geoff jeff", "georgina": "georgie gina", "gilbert": "gil bert", "gregory": "greg", "gwendolen": "gwen",
    "hannah": "nan", "harriet": "hattie", "helena": "helly nell", "henry": "hal hank harry", "horatio": "horry", "hubert": "hubie bert",
    "ignatius": "iggy", "imogen": "immy", "irving": "irv", "isaac": "ike zac", "isabella": "izzy bella", "jacqueline": "jackie", "james": "jamie jim jimmy",
    "jennifer": "jenny jen", "jonathan": "jon jonny", "joseph": "joe", "josephine": "josie jo", "kathleen": "kath kathy kay", "kenneth": "ken kenny", "keziah": "kez kizzy",
    "kimberley": "kim", "konrad": "kon", "kristina": "tina kris", "lawrence": "larry laurie", "leonard": "len lenny leo", "leopold": "leo poldi", "lillian": "lil lily",
    "louisa": "lou", "lucinda": "lucy cindy", "margaret": "maggie meg peggy", "mary": "polly molly", "matilda": "tilly mattie", "matthew": "matt", "maximilian": "max",
    "michael": "mike mick", "octavia": "tavy", "oliver": "ollie", "ophelia": "phee", "orlando": "orly", "oswald": "oz ozzie", "quentin": "quent",
    "quillan": "quill", "quincy": "quin", "raymond": "ray", "rebecca": "becky becca", "richard": "rick dick", "robert": "rob bob bobby", "roderick": "rod roddy",
    "rosalind": "ros rosie", "samuel": "sam", "sebastian": "seb bastian", "solomon": "sol solly", "stephanie": "steph", "stephen": "steve", "susannah": "sue susie",
    "ulrich": "uli", "ulysses": "uly", "ursula": "ursie", "valentine": "val", "veronica": "nica ronnie", "victoria": "vicky tori", "vincent": "vince", "virginia": "virgie ginny",
    "vivian": "viv", "wallace": "wal wally", "walter": "wat wally walt", "wilhelmina": "willa mina", "william": "bill will billy", "winifred": "winnie", "yasmin": "yas",
    "yolanda": "yoli", "yvonne": "yvie", "zachary": "zac zack zach", "zebedee": "zeb", "zenobia": "zen", "zephyrine": "zeph",
    "adam": "", "alan": "al", "albert": "al bertie", "alice": "ali", "amanda": "mandy", "anna": "annie ann", "benjamin": "ben benny", "brian": "", "carol": "", "daniel": "dan danny",
    "david": "dave davy", "deborah": "deb debbie", "donald": "don", "dorothy": "dot dottie", "emily": "em", "emma": "", "george": "georgie", "grace": "", "helen": "nell", "jacob": "jake",
    "jane": "janie", "john": "jack johnny", "judith": "judy", "katherine": "kate katie kathy", "laura": "laurie", "maria": "mia", "mark": "", "martha": "", "nicholas": "nick nicky",
    "pamela": "pam", "patricia": "pat patty trish", "patrick": "pat paddy", "paul": "", "peter": "pete", "philip": "phil", "rachel": "rach", "ronald": "ron", "ruth": "", "sarah": "sally sadie",
    "simon": "", "susan": "sue suzie", "theodore": "ted theo", "theresa": "tess", "thomas": "tom tommy", "timothy": "tim",
}
LEGAL = {
    "ltd": "ltd", "limited": "ltd", "inc": "inc", "incorporated": "inc", "llc": "llc", "limited liability company": "llc", "corp": "corp", "corpn": "corp", "corporation": "corp",
    "plc": "plc", "public limited company": "plc", "gmbh": "gmbh", "gesellschaft mbh": "gmbh", "gesellschaft": "gmbh", "mbh": "gmbh",
}
NOUNS = frozenset("works foundation union college association company museum council trust laboratory survey exchange archive bureau department academy services agency holdings society partnership cooperative institute federation".split())
# Abbreviations of such nouns that are not plain beginnings of them.
SHORT_NOUNS = {"assn": "association", "bros": "brothers", "co": "company", "coop": "cooperative", "dept": "department", "fdn": "foundation", "hldgs": "holdings", "pship": "partnership", "svcs": "services"}

#: Entities with one pair of given names that make it two forms of one name, and its least share of the rarer one's
#: names; surnames (or first words) that a token must stand with to be a given name (or noun), at least and as a
#: share of all names of its kind, which bounds what is learned to 1 / SHARE tokens.
PAIRED, PAIR_SHARE, COMPANIONS, SHARE = 2, 0.05, 3, 1e-5
#: Types that tell a person or an organisation.
TYPED = {"person": "p", "individual": "p", "human": "p", "org": "o", "organisation": "o", "organization": "o", "company": "o"}


class Lexicon:
    """Given names, the full names that a form may stand for, and nouns of organisations."""

    def __init__(self, given: dict[str, str] | None = None, learned: Iterable[str] = (), pairs: Iterable[tuple[str, str]] = (), nouns: Iterable[str] = ()) -> None:
        given = GIVEN if given is None else given
        self.full = frozenset(given) | frozenset(learned)
        self.nouns = frozenset(nouns)
        forms = {n: {n} for n in self.full}
        for short, full in [(s, f) for f, ss in given.items() for s in ss.split()] + list(pairs):
            forms.setdefault(short, set()).add(full)
            forms.setdefault(full, {full})
        self.forms = {k: frozenset(v) for k, v in forms.items()}
        self._ends: dict[str, list[str]] = {}
        for n in self.forms:
            for end in {n[:2], n[-3:]}:
                self._ends.setdefault(end, []).append(n)
        self._known: dict[str, frozenset[str]] = {}

    def formal(self, name: str) -> frozenset[str]:
        """Given names that this one may stand for; of a misspelt one those whose forms are nearly equal and
        begin or end alike."""
        if name in self.forms or len(name) < 4:
            return self.forms.get(name, frozenset({name}))
        if name not in self._known:
            if len(self._known) >= 1 << 16:
                self._known.clear()
            ends = {*self._ends.get(name[:2], ()), *self._ends.get(name[-3:], ())}
            near = [n for n in ends if abs(len(n) - len(name)) < 3 and ratio(n, name) >= 0.8]
            self._known[name] = frozenset().union(*(self.forms[n] for n in near)) | {name}
        return self._known[name]

    def given_match(self, a: str, b: str) -> int:
        """0 different, 1 may be the same (an initial), 2 the same given name."""
        if a == b:
            return 1 if len(a) == 1 else 2
        x, y = self.formal(a), self.formal(b)
        if len(a) == 1 or len(b) == 1:
            short, full = (a, y | {b}) if len(a) == 1 else (b, x | {a})
            return int(any(f[0] == short for f in full))
        if x & y:
            return 2
        begins = any(f.startswith(a) for f in y) or any(f.startswith(b) for f in x)
        if begins and min(len(a), len(b)) <= 3:  # an abbreviation, whether or not it is a name of its own
            return 2
        if a in self.full and b in self.full:
            return 0
        return 2 if begins or ratio(a, b) >= 0.8 else 0


_DIGITS = str.maketrans("013458", "oleasb")
_TOKEN = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    """Lower case without accents and invisible characters; digits typed within words become letters."""
    text = unicodedata.normalize("NFKD", text)
    text = "".join(c for c in text if not unicodedata.combining(c) and unicodedata.category(c) != "Cf").casefold()
    return re.sub(r"(?<=[a-z])[013458](?=[a-z])|(?<=[a-z]{2})[013458]\b", lambda m: m[0].translate(_DIGITS), text)


@functools.lru_cache(1 << 16)
def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, with one machine integer as bit vector."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & where.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def ratio(a: str, b: str) -> float:
    """Longest common subsequence against the mean length."""
    return 2 * lcs(a, b) / (len(a) + len(b)) if a and b else 0.0


def shortens(a: str, b: str) -> bool:
    """Whether a abbreviates b: same first letter, and the letters of a stand in b in order."""
    if len(a) >= len(b) or a[:1] != b[:1]:
        return False
    rest = iter(b)
    return all(c in rest for c in a)


def parse(surface: str | None, lexicon: Lexicon | None = None) -> tuple[str, tuple[str, ...]] | None:
    """Kind ('o' organisation, 'p' person) and tokens of a name as typed, or None where it can be neither.

    Tokens keep their order except that what stands after a comma comes first; titles, legal forms (kept
    last, as '=form'), articles and bracketed acronyms go.
    """
    if not surface or not surface.strip():
        return None
    text = re.sub(r"\([^)]*\)", " ", surface)
    text = fold(text)
    text = re.sub(r"\b(?:[a-z]\.){2,}(?:[a-z]{1,2}\.)?", lambda m: " " + m[0].replace(".", "") + " " if m[0].replace(".", "") in LEGAL else m[0], text)
    text = text.replace("g.m.b.h", "gmbh").replace("l.l.c", "llc").replace("p.l.c", "plc").replace("co-op", "coop")
    head, comma, tail = text.partition(",")
    words = _TOKEN.findall(text)
    organised = any(w in LEGAL for w in words) or any(w in (lexicon or PRIOR).nouns or w in SHORT_NOUNS for w in words)
    if organised and len(words) >= 3:
        forms = {LEGAL[w] for w in words if w in LEGAL}
        rest = tuple(w for w in words if w not in LEGAL and w not in ("the", "of", "and", "public"))
        return ("o", rest + tuple(f"={f}" for f in sorted(forms))) if 2 <= len(rest) <= 8 else None
    if comma and _TOKEN.findall(tail):
        text = tail + " " + head
    text = text.replace("-", "")
    tokens = tuple(w for w in _TOKEN.findall(text) if w not in TITLES)
    if not 2 <= len(tokens) <= 5 or any(any(c.isdigit() for c in w) for w in tokens):
        return None
    return "p", tokens


PRIOR = Lexicon(nouns=NOUNS)
#: Knows nothing: what is left is what the tables teach.
BLANK = Lexicon(given={})


def typed_names(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """(kind, canonical, surface) of typed persons and organisations: each name next to the canonical one."""
    kinds = F.create_map(*[F.lit(x) for kv in TYPED.items() for x in kv])
    layer = F.coalesce("layer", F.lit(0)) if "layer" in entities.columns else F.lit(0)
    live = entities.filter((layer == 0) & F.col("id").isNotNull()).select(F.col("id").alias("entity_id"), F.element_at(kinds, F.lower(F.trim("type"))).alias("kind"), "canonical").filter("kind is not null and canonical is not null")
    named = aliases.select("entity_id", "surface").filter("surface is not null").join(live, "entity_id").select("entity_id", "kind", "canonical", "surface")
    return named.unionByName(live.withColumn("surface", F.col("canonical"))).distinct()


def _teaching(prior: Lexicon):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            out = []
            for eid, kind, canonical, surface in zip(df["entity_id"], df["kind"], df["canonical"], df["surface"], strict=True):
                if kind == "o":
                    words = [w for w in _TOKEN.findall(fold(re.sub(r"\([^)]*\)", " ", surface))) if w not in LEGAL and len(w) > 2 and not any(c.isdigit() for c in w)]
                    if len(words) > 1:
                        out += [("noun", words[-1], words[0])] + [("word", w, words[-1]) for w in words[:-1]]
                    continue
                x, y = parse(surface, prior), parse(canonical, prior)
                if x is None or x[0] != "p":
                    continue
                first, last = x[1][0], x[1][-1]
                if len(first) > 1 and len(last) > 2:
                    out += [("first", first, last), ("last", last, first)]
                    if y and y[0] == "p" and y[1][-1] == last and y[1][0] != first and len(y[1][0]) > 1:
                        out.append(("pair", " ".join(sorted((first, y[1][0]))), str(eid)))
            yield pd.DataFrame(out, columns=["role", "token", "companion"])

    return rows


def learn(entities: DataFrame, aliases: DataFrame, prior: Lexicon | None = None) -> Lexicon:
    """The prior lexicon and what the names of typed persons and organisations add to it, counted over all of them.

    Only tokens over the stated thresholds reach the driver: at most 1 / SHARE per role. A group's names are never
    paired with each other, only each with its canonical one. Empty tables add nothing."""
    prior = prior or PRIOR
    if not {"id", "canonical", "type"} <= set(entities.columns):
        return prior
    seen = typed_names(entities, aliases).mapInPandas(_teaching(prior), "role string, token string, companion string").groupBy("role", "token", "companion").agg(F.count(F.lit(1)).alias("names"))
    counts = seen.groupBy("role", "token").agg(F.count(F.lit(1)).alias("n"), F.sum("names").alias("names"))
    total = F.greatest(F.lit(COMPANIONS), F.ceil(F.lit(SHARE) * F.lit(seen.count())))
    rows = counts.filter((F.col("n") >= total) | (F.col("role") == "pair") & (F.col("n") >= F.greatest(F.lit(PAIRED), total - 1))).collect()
    of: dict[str, dict[str, int]] = {}
    for r in rows:
        of.setdefault(r["role"], {})[r["token"]] = r["n"] if r["role"] == "pair" else r["names"]
    first, last, noun, word = (of.get(k, {}) for k in ("first", "last", "noun", "word"))
    pairs = []
    for pair, n in of.get("pair", {}).items():
        a, b = pair.split(" ")
        if n >= PAIR_SHARE * min(first.get(a, 1), first.get(b, 1)):
            full = max((a, b), key=lambda x: (first.get(x, 0), len(x), x))
            pairs.append((b if full == a else a, full))
    given = {t for t, n in first.items() if n > 2 * last.get(t, 0)}
    # a given name that is nearly equal to a far more frequent one is a misspelling of it
    frequent = Lexicon({}, {t for t in given if first[t] >= 10 * COMPANIONS})
    for t in sorted(given):
        near = [f for f in frequent.formal(t) if f != t and first.get(f, 0) >= 10 * first[t]]
        if len(t) > 3 and near:
            pairs.append((t, max(near, key=lambda f: (first[f], f))))
    shorts = {s for s, _ in pairs}
    nouns = {t for t, n in noun.items() if n > word.get(t, 0)}
    learned = Lexicon({}, given - shorts, pairs)
    known = {s: f for s, f in prior.forms.items()}
    both = Lexicon({}, prior.full | learned.full, [(s, f) for d in (known, learned.forms) for s, fs in d.items() for f in fs if f != s], prior.nouns | nouns)
    return both
