"""PII surrogates: keyed, type-consistent, distinct and the same for every mention.

A mention's entity is its kind and its canonical form. A keyed hash of the entity
draws a surrogate of the same type and shape: digits for digits with separators
and prefixes kept and check digits valid, letters for letters of the same script
and case, given names of the gender that a title in the document shows. A name is
one entity under all its titles, and where a document has a titled name, further
mentions of it or of its last word go with it. Entities are gathered
over the whole corpus; where two would share a surrogate, or a surrogate is
someone's real value, the later entity draws again until none collides.
"""

from __future__ import annotations

import hashlib
import hmac

import regex as re
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import map_slices
from .common import broadcast_if_small, checkpoint, pick, write_table
from .spans import Spans

KINDS = ("email", "iban", "card", "ssn", "ip", "phone", "name")
EMAIL = re.compile(r"(?<![\w.+-])[\w.+-]+@[\w-]+(?:\.[\w-]+)+")
IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
CARD = re.compile(r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-])")
SSN = re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")
IP = re.compile(r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w]|\.\d)")
PHONE = re.compile(r"(?<![\w.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?)?\d{2,4}(?:[ .-]\d{2,5}){1,4}(?![\w-])")
#: Titles that show gender; "" is neither.
TITLES = {"Mr": "m", "Herr": "m", "Monsieur": "m", "Señor": "m", "Sr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Frau": "f", "Madame": "f", "Mme": "f", "Señora": "f", "Sra": "f", "Dr": "", "Prof": "", "г-н": "m", "г-жа": "f", "κ": "", "Κύριος": "m", "Κυρία": "f"}
#: Words inside a family name that stay as they are.
PARTICLES = "von van der den de da di du la le del della dos bin al".split()
_TITLE = "(?:" + "|".join(sorted(TITLES, key=len, reverse=True)) + r")\.? "
#: Scripts that put no space between words: there a name is what stands after a title, at most so many characters.
_RUN = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}"
_UNSPACED = r"(?:\p{Han}{2,4}+|\p{Katakana}{2,8}+|\p{Hiragana}{2,6}+|[\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]{2,12}+)"
#: A longer word isn't a name. Elsewhere a name ends where its word does.
MAX_WORD = 64
_LETTER = rf"(?![{_RUN}])[\p{{L}}\p{{M}}]"
_WORD = rf"(?:\p{{Lu}}\.|(?=[\p{{Lu}}\p{{Lt}}\p{{Lo}}])(?:{_LETTER}){{1,{MAX_WORD}}}+(?:['’-](?:{_LETTER}){{1,{MAX_WORD}}}+){{0,3}}+)"
NAME = re.compile(rf"(?<!\w)(?:{_TITLE})++((?:{_WORD}(?: (?:(?:{'|'.join(PARTICLES)}) ){{0,4}}{_WORD}){{0,2}})(?!(?![{_RUN}])\w|-)|{_UNSPACED})")
#: What a name is compared by: a character of a script without spaces, a word, any other character.
_TOKEN = re.compile(rf"[{_RUN}]|(?:(?![{_RUN}])\w)++|\W")
_TITLED = re.compile(rf"(?<!\w)(?:{_TITLE})+$")
#: Surrogate given names by script and gender.
GIVEN = {
    ("latin", "m"): "Adrian Bruno Carlos Daniel Emil Felix Georg Hugo Ivan Jonas Karl Lukas Martin Nico Oscar Paul Robert Simon Tomas Victor".split(),
    ("latin", "f"): "Alma Bianca Clara Diana Elena Fiona Greta Hanna Irene Julia Katrin Laura Maria Nora Olivia Paula Rosa Sofia Tamara Vera".split(),
    ("cyrillic", "m"): "Алексей Борис Виктор Григорий Дмитрий Егор Иван Максим Николай Павел".split(),
    ("cyrillic", "f"): "Анна Вера Дарья Елена Ирина Ксения Людмила Мария Наталья Ольга".split(),
    ("greek", "m"): "Αλέξανδρος Γιώργος Δημήτρης Κώστας Μιχάλης Νίκος Παύλος Σπύρος".split(),
    ("greek", "f"): "Άννα Βασιλική Γεωργία Ελένη Ιωάννα Κατερίνα Μαρία Σοφία".split(),
}
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga go ka ke ko la le lo ma me mo na ne no pa pe ra re ro sa se so ta te to va ve".split(),
    "cyrillic": "ба бе бо ва ве га го да де до за ка ко ла ле ма ме на не но па ра ре ро са се та те".split(),
    "greek": "βα γα γο δα δε ζα θα κα κε κο λα λε μα με να νε νο πα ρα ρο σα σε τα το φα χα".split(),
}
#: Ranges of letters by script, and what is drawn for a letter in them; letters of other scripts become Latin.
LETTERS = [
    ("\u0370", "\u03ff", "αβγδεζηθικλμνξοπρστυφχψω"),
    ("\u0400", "\u04ff", "абвгдежзиклмнопрстуфхцч"),
    ("\u05d0", "\u05ea", "אבגדהוזחטילמנסעפצקרשת"),
    ("\u0620", "\u064a", "ابتثجحخدذرزسشصضطظعغفقكلمنهوي"),
    ("\u0904", "\u0939", "अआइईउऊएऐओऔकखगघचछजझटठडढतथदधनपफबभमयरलवशषसह"),
    ("\u3041", "\u3096", "あいうえおかきくけこさしすせそたちつてとなにぬねのはひふへほまみむめもやゆよらりるれろわ"),
    ("\u30a1", "\u30fa", "アイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤユヨラリルレロワ"),
    ("\u3400", "\u9fff", "一三上中九二五人八六十口四大小山川工心日月木林水火田石竹花金雨青音風高黒"),
    ("\uac00", "\ud7a3", "가나다라마바사아자차카타파하고노도로모보소오조초코토포호"),
]
LATIN = "abcdefghijklmnopqrstuvwxyz"
#: Draws for one entity, after which the surrogates of its kind count as used up. Mailboxes and names grow, so theirs never are.
MAX_ATTEMPTS = 200


class Draw:
    """A stream of small integers from a keyed hash of an entity and an attempt."""

    def __init__(self, key: bytes, kind: str, canonical: str, attempt: int):
        self.key, self.seed, self.n, self.pool = key, f"{kind}\0{attempt}\0{canonical}".encode(), 0, b""

    def below(self, n: int) -> int:
        if len(self.pool) < 4:
            self.pool += hmac.new(self.key, self.seed + self.n.to_bytes(4, "big"), hashlib.sha256).digest()
            self.n += 1
        value, self.pool = int.from_bytes(self.pool[:4], "big"), self.pool[4:]
        return value % n


def luhn_digit(body: str) -> str:
    total = sum(d if k % 2 else (2 * d - 9 * (d > 4)) for k, d in enumerate(map(int, reversed(body))))
    return str(-total % 10)


def iban_check(country: str, body: str) -> str:
    number = int("".join(str(int(c, 36)) for c in body + country + "00"))
    return f"{98 - number % 97:02d}"


def ascii_digits(text: str) -> str:
    """The decimal digits of a text, of any script, as 0-9."""
    return "".join(str(int(c)) for c in text if c.isdecimal())


def like_digit(c: str, value: str) -> str:
    """A digit of the script of ``c``."""
    return chr(ord(c) - int(c) + int(value))


def fold(text: str) -> str:
    """Lower case without a change of length."""
    return "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def find(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end), in order and without overlap; of overlapping finds the earlier kind of KINDS stays.

    Digits of all scripts count. A name stands after a title: up to three words,
    initials and double names among them, in a script without spaces a few
    characters; where a document has a titled name, further mentions of it or of its
    last word are found without a title. A word of more than ``MAX_WORD`` letters is
    no name. Time grows with the length of the text, whatever it holds.
    """
    text = text or ""
    spans = Spans()
    if "@" in text:
        for m in EMAIL.finditer(text):
            spans.add("email", *m.span())
    if re.search(r"\d", text):
        for m in IBAN.finditer(text):
            body = canonical("iban", m[0])
            if 15 <= len(body) <= 34 and iban_check(body[:2], body[4:]) == body[2:4]:
                spans.add("iban", *m.span())
        for m in CARD.finditer(text):
            digits = ascii_digits(m[0])
            # Sixteen digits in a row or in fours are taken for a card also where the check digit is wrong.
            if luhn_digit(digits[:-1]) == digits[-1] or len(digits) == 16:
                spans.add("card", *m.span())
        for m in SSN.finditer(text):
            spans.add("ssn", *m.span())
        for m in IP.finditer(text):
            if all(int(x) < 256 for x in m[0].split(".")):
                spans.add("ip", *m.span())
        # What is found already ends a phone number that stands beside it.
        parts, at = [], 0
        for _, start, end in spans.found:
            parts += [text[at:start], "," * (end - start)]
            at = end
        for m in PHONE.finditer("".join(parts) + text[at:]):
            digits = ascii_digits(m[0])
            if 9 <= len(digits) <= 15 and (m[0][0] in "+(" or len(digits) >= 10) and not re.match(r"\d{4}-\d{2}-\d{2}", m[0]):
                spans.add("phone", *m.span())
    for m in NAME.finditer(text):
        spans.add("name", *m.span(1))
    for start, end in untitled(text, [text[s:e] for k, s, e in spans.found if k == "name"]):
        if all(not w[:1].islower() or w in PARTICLES for w in text[start:end].split(" ")):
            spans.add("name", start, end)
    return spans.found


def untitled(text: str, names: list[str]) -> list[tuple[int, int]]:
    """Where names, and last words of two letters at least, stand in a text, also without a title.

    The tokens of the names are a trie, along which the text is read once from each
    of its tokens: time grows with the text and the longest name. Of names that begin
    at one place the longest counts, and nothing begins inside it.
    """
    known = {*names, *(n.split(" ")[-1] for n in names if " " in n)}
    trie: dict = {}
    for name in known:
        if len(name) > 1 and not name.endswith("."):
            node = trie
            for token in _TOKEN.findall(fold(name)):
                node = node.setdefault(token, {})
            node[""] = True
    if not trie:
        return []
    # Folding keeps the length, so places in the folded text are places in the text.
    tokens = [(m[0], m.end()) for m in _TOKEN.finditer(fold(text))]
    out, at, begins = [], 0, 0
    while at < len(tokens):
        node, k, upto = trie, at, None
        while k < len(tokens) and (node := node.get(tokens[k][0])):
            k += 1
            if "" in node:
                upto = k
        if upto is None:
            begins, at = tokens[at][1], at + 1
        else:
            out.append((begins, tokens[upto - 1][1]))
            begins, at = tokens[upto - 1][1], upto
    return out


def title_of(text: str, start: int) -> str | None:
    """Gender that the titles before a name show, "" if none does; None if there is no title."""
    m = _TITLED.search(text[max(0, start - 40) : start])
    return next((g for w in m[0].split() if (g := TITLES.get(w.rstrip("."), ""))), "") if m else None


def canonical(kind: str, value: str) -> str:
    """The same for all spellings of one value."""
    if kind == "email":
        return fold(value)
    if kind == "name":
        return value.casefold()
    keep = "." if kind == "ip" else ""
    return "".join(str(int(c)) if c.isdecimal() else c for c in value if c.isdecimal() or c in keep or kind == "iban" and c.isalnum())


def is_initial(word: str) -> bool:
    return len(word) == 2 and word[1] == "."


def stands_for(short: list[str], full: list[str]) -> bool:
    """Whether a name may be a shorter form of another: the last word, before it only what the other has, as words or initials."""
    if short[-1] != full[-1] or len(short) > len(full) or short == full:
        return False
    return all(a == b or is_initial(a) and a[0] == b[0] for a, b in zip(short[:-1], full[:-1]))


def resolve(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[str, str]]:
    """Per span: entity and gender. A name's entity is the fullest form in which this document has the person with a title."""
    shown: dict[str, set[str]] = {}
    for kind, start, end in spans:
        if kind == "name" and (title := title_of(text, start)) is not None:
            shown.setdefault(canonical(kind, text[start:end]), set()).add(title)
    words = {n: n.split(" ") for n in shown}
    by_last: dict[str, list[str]] = {}
    for name in shown:
        by_last.setdefault(words[name][-1], []).append(name)

    def person(name: str, gender: set[str]) -> str:
        """Of the names this one may stand for, one whose titles don't show another gender, the longest, then the first."""
        parts = name.split(" ")
        fuller = [n for n in by_last.get(parts[-1], []) if stands_for(parts, words[n]) and len((shown[n] | gender) - {""}) < 2]
        return max(fuller, key=lambda n: (len(words[n]), -sum(map(is_initial, words[n]))), default=name)

    who = {name: person(name, titles) for name, titles in shown.items()}
    genders: dict[str, set[str]] = {}
    for name, entity in who.items():
        genders.setdefault(entity, set()).update(shown[name] - {""})
    out = []
    for kind, start, end in spans:
        entity = canonical(kind, text[start:end])
        if kind != "name":
            out.append((entity, ""))
            continue
        entity = who.get(entity) or person(entity, {title_of(text, start) or ""})
        seen = genders.get(entity, set())
        out.append((entity, next(iter(seen)) if len(seen) == 1 else ""))
    return out


def _letter(draw: Draw, c: str) -> str:
    pool = next((p for lo, hi, p in LETTERS if lo <= c <= hi), LATIN)
    return pool[draw.below(len(pool))]


def _letters(draw: Draw, like: str) -> str:
    """Letters and digits drawn, other characters, script and case kept."""
    out = []
    for c in like:
        if c.isdecimal():
            out.append(like_digit(c, str(draw.below(10))))
        elif c.isalpha():
            d = _letter(draw, c)
            out.append(d.upper() if c.isupper() else d)
        else:
            out.append(c)
    return "".join(out)


def script_of(name: str) -> str:
    for lo, hi, script in (("\u0370", "\u03ff", "greek"), ("\u0400", "\u04ff", "cyrillic")):
        if any(lo <= c <= hi for c in name):
            return script
    return "other" if any(lo <= c <= hi for c in name for lo, hi, _ in LETTERS) else "latin"


def name_surrogate(key: bytes, gender: str, name: str, attempt: int) -> list[str]:
    """A word for each word of a name, in lower case; the last is the family word."""
    # The gender chooses the list of given names and nothing else.
    draw, script, words = Draw(key, "name", name, attempt), script_of(name), name.split(" ")
    either, grown = "mf"[draw.below(2)], attempt // 3
    given = GIVEN.get((script, gender or either))
    if given:
        family = "".join(SYLLABLES[script][draw.below(len(SYLLABLES[script]))] for _ in range(4 + draw.below(2) + grown))
        before = ["-".join(given[draw.below(len(given))].casefold() for _ in w.split("-")) for w in words[:-1]]
    else:
        family = _letters(draw, words[-1]) + "".join(_letter(draw, words[-1][0]) for _ in range(grown))
        before = [_letters(draw, w) for w in words[:-1]]
    return [*(w if w in PARTICLES else b for w, b in zip(words, before)), family]


def surrogate(key: bytes, kind: str, entity: str, attempt: int = 0) -> str:
    """Canonical form of the surrogate of a canonical entity; later attempts draw from larger spaces."""
    draw = Draw(key, kind, entity, attempt)
    if kind == "name":
        return " ".join(name_surrogate(key, "", entity, attempt))
    if kind == "email":
        local, _, domain = entity.partition("@")
        name, dot, zone = domain.partition(".")
        grown = "".join(_letter(draw, local[-1]) for _ in range(attempt - 2))
        # Addresses of one domain keep one domain, whatever their mailboxes draw.
        return f"{_letters(draw, local)}{grown}@{_letters(Draw(key, 'domain', domain, 0), name)}{dot}{zone}"
    if kind == "ip":
        # Private addresses, then reserved ones, then any.
        head = "10" if attempt < 3 else str(240 + draw.below(16)) if attempt < 8 else str(draw.below(256))
        return ".".join([head, *(str(draw.below(256)) for _ in range(3))])
    if kind == "card":
        body = (entity[0] if attempt < 8 else str(draw.below(10))) + _letters(draw, entity[1:-1])
        return body + luhn_digit(body)
    if kind == "iban":
        body = _letters(draw, entity[4:])
        return entity[:2] + iban_check(entity[:2], body) + body
    if kind == "ssn":
        return ("9" if attempt < 8 else str(draw.below(10))) + _letters(draw, entity[1:])
    # Phones keep a country code of up to three digits: all but the last nine, at least the first digit.
    keep = max(1, len(entity) - 9) if attempt < 8 else 0
    return entity[:keep] + _letters(draw, entity[keep:])


def _cased(value: str, shape: str) -> str:
    """Upper case where the shape has it; what is longer than the shape stays."""
    return "".join(v.upper() if s.isupper() and len(v.upper()) == 1 else v for v, s in zip(value, shape)) + value[len(shape) :]


def dress(kind: str, shape: str, value: str) -> str:
    """Write a canonical surrogate in the shape of a mention: separators, script of digits and letter case."""
    if kind == "ip":
        zero = next(c for c in shape if c.isdecimal())
        return "".join(like_digit(zero, c) if c.isdecimal() else c for c in value)
    if kind == "email":
        return "@".join(_cased(v, s) for v, s in zip(value.split("@"), shape.split("@"), strict=True))
    chars = iter(value)
    return "".join(like_digit(c, next(chars)) if c.isdecimal() else next(chars) if kind == "iban" and c.isalnum() else c for c in shape)


def dress_name(shape: str, entity: str, words: list[str]) -> str:
    """Write a name's surrogate words in the shape of a mention, which may have fewer words than the entity, or initials."""
    mention, out = shape.split(" "), []
    for k, word in enumerate(mention):
        drawn = words[-1] if k == len(mention) - 1 else words[min(k, len(words) - 1)]
        if is_initial(word):
            out.append(drawn[0].upper() + ".")
        elif word.casefold() in PARTICLES and k < len(mention) - 1:
            out.append(word)
        else:
            out.append(drawn.upper() if word.isupper() and len(word) > 1 else "-".join(p[:1].upper() + p[1:] for p in drawn.split("-")))
    return " ".join(out)


def mentions(docs: DataFrame) -> DataFrame:
    """doc_id, th, kind, entity: distinct per document, over whole texts."""

    def run(ids, ths, texts):
        out = []
        for text in texts:
            spans = find(text)
            out.append(sorted({(k, entity) for (k, _, _), (entity, _) in zip(spans, resolve(text or "", spans), strict=True)}))
        return [ids, ths, [[{"kind": k, "entity": c} for k, c in r] for r in out]]

    found = map_slices(docs.select("doc_id", "th", "text"), run, "doc_id long, th long, m array<struct<kind:string,entity:string>>")
    return found.select("doc_id", "th", F.explode("m").alias("m")).select("doc_id", "th", "m.kind", "m.entity")


def _written(column: str) -> Column:
    """What must be distinct: a name's family word, else the whole value."""
    return F.when(F.col("kind") == "name", F.substring_index(column, " ", -1)).otherwise(F.col(column)).alias("form")


def assign(entities: DataFrame, key: bytes) -> DataFrame:
    """kind, entity, attempt, value: one distinct surrogate per entity, none of them a real entity of the corpus."""

    def draw(kinds, names, attempts):
        return [kinds, names, attempts, [surrogate(key, k, e, a) for k, e, a in zip(kinds, names, attempts, strict=True)]]

    schema = "kind string, entity string, attempt int, value string"
    real = entities.select("kind", _written("entity")).distinct()
    current = checkpoint(map_slices(entities.select("kind", "entity", F.lit(0).alias("attempt")), draw, schema))
    for _ in range(MAX_ATTEMPTS):
        # Of entities that share a surrogate the one of fewest attempts, then the smallest, keeps it.
        shown = current.select("kind", "entity", "attempt", _written("value"))
        owner = shown.groupBy("kind", "form").agg(F.min(F.struct("attempt", "entity")).alias("o"), F.count(F.lit(1)).alias("n")).where("n > 1").select("kind", "form", F.col("o.entity").alias("owner"))
        clash = shown.join(owner, ["kind", "form"]).where("entity <> owner").select("kind", "entity")
        clash = checkpoint(clash.union(shown.join(real, ["kind", "form"], "left_semi").select("kind", "entity")).distinct())
        if clash.limit(1).count() == 0:
            return current
        again = current.join(clash, ["kind", "entity"], "left_semi").select("kind", "entity", F.col("attempt") + 1)
        current = checkpoint(current.join(clash, ["kind", "entity"], "left_anti").union(map_slices(again, draw, schema)))
    raise ValueError(f"no distinct surrogate after {MAX_ATTEMPTS} draws: a kind has more entities than values")


def pseudonymize(docs: DataFrame, key: bytes) -> DataFrame:
    """One row per input row: doc_id, text with surrogates, n_found, spans (kind:start:end in the input text).

    Null texts stay null, empty ones empty. Rows that repeat doc_id and text get
    the same text. The key decides all surrogates; the same key gives the same
    ones, but for entities that collide in one corpus and not in another.
    """
    rows = pick(docs, doc_id="doc_id", text="text").select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("th"))
    found = write_table(mentions(rows), "pii_mentions")
    table = assign(found.select("kind", "entity").distinct(), key)
    # Only entities that had to draw again differ from what the key alone gives.
    redrawn = found.join(table.where("attempt > 0").select("kind", "entity", "attempt"), ["kind", "entity"])
    redrawn = redrawn.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set(F.struct("kind", "entity", "attempt"))).alias("redrawn"))
    redrawn, _ = broadcast_if_small(checkpoint(redrawn.withColumnsRenamed({"doc_id": "d", "th": "t"})), F.size("redrawn") * 128)
    joined = rows.join(redrawn, rows["doc_id"].eqNullSafe(F.col("d")) & (rows["th"] == F.col("t")), "left").select("doc_id", "text", "redrawn")

    def run(ids, texts, redrawn):
        out = [ids, [], [], []]
        for text, more in zip(texts, redrawn, strict=True):
            special = {(r["kind"], r["entity"]): r["attempt"] for r in more or []}
            spans, parts, at = find(text), [], 0
            for (kind, start, end), (entity, gender) in zip(spans, resolve(text or "", spans), strict=True):
                attempt = special.get((kind, entity), 0)
                if kind == "name":
                    made = dress_name(text[start:end], entity, name_surrogate(key, gender, entity, attempt))
                else:
                    made = dress(kind, text[start:end], surrogate(key, kind, entity, attempt))
                parts += [text[at:start], made]
                at = end
            out[1].append(text if not spans else "".join(parts) + text[at:])
            out[2].append(len(spans))
            out[3].append(",".join(f"{k}:{s}:{e}" for k, s, e in spans))
        return out

    return map_slices(joined, run, "doc_id long, text string, n_found long, spans string")
