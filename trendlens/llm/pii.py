"""Personal data, also in disguise, with spans on the source text.

Two transducers rewrite a text and keep, for every character they write, the
source characters it stands for: the first folds look-alike characters
(full-width forms, Cyrillic and Greek twins, other digits, dashes, invisible
characters), the second spelled digits and at/dot disguises. The same four
detectors run on the source (base spans) and on the rewritten text; spans
found there are mapped back. A base span always stays; a mapped span is added
unless a span of its kind already covers it, so where a disguise leaves a
fragment that is a base span, the whole extent is listed too.

To leave ordinary prose alone, a bare ``at`` or ``dot`` counts only within
``name at host dot tld``, with at least one bare ``dot`` (``name at host.tld``
reads like ordinary prose) and two of three signs that it is an address: a usual
ending, a name or host that is no plain word, an announcement such as ``mail`` or
a colon before it. Spelled digits, alone or mixed with numerals, are rewritten in
runs of any length, a ``dot`` or ``point`` between them too; the detectors decide.
Nothing has a greatest length. Each rewriting is searched, so what a later one
breaks is still found.

Each text is read where it lies (no shuffle). All patterns scan a text in time
proportional to its length. Null texts are empty. Rows are documents: repeated
rows or ids are read each. An empty table gives no row; other columns are kept by
the mask and not read by the report.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_slices, map_arrow

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match never starts inside a run of digits: what fails at its start fails within.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def emails(text: str) -> list[Span]:
    """Local part, ``@``, domain with a dot; found from each ``@``, so in linear time."""
    out, done = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append((start, domain.end()))
        done = domain.end() if domain else at + 1
        at = text.find("@", done)
    return out


def ips(text: str) -> list[Span]:
    small = lambda part: len(part := part.lstrip("0")) <= 3 and int(part or "0") <= 255
    return [m.span() for m in _IP.finditer(text) if all(map(small, m.group().split(".")))]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def cards(text: str) -> list[Span]:
    out = []
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(m.span())
    return out


def phones(text: str) -> list[Span]:
    return [m.span() for m in _PHONE.finditer(text) if 8 <= sum(map(str.isdigit, m.group())) <= 15]


_DETECTORS: dict[str, Callable[[str], list[Span]]] = {"email": emails, "ip": ips, "card": cards, "phone": phones}


def detect(text: str) -> dict[str, list[Span]]:
    """Spans of each kind, leftmost and non-overlapping per kind."""
    digits = _DIGIT.search(text) is not None
    return {kind: _DETECTORS[kind](text) if digits or kind == "email" and "@" in text else [] for kind in KINDS}


# ---- transducers ---------------------------------------------------------

class Traced:
    """A text and, per character, the source span that it stands for."""

    def __init__(self, text: str, spans: list[Span] | None = None) -> None:
        self.text, self.spans = text, spans

    def source(self, start: int, end: int) -> Span:
        """Source span of the characters start..end (end exclusive, not empty)."""
        if self.spans is None:
            return start, end
        return self.spans[start][0], self.spans[end - 1][1]

    def rewrite(self, edits: list[tuple[int, int, str]]) -> "Traced":
        """Replaces the given disjoint, sorted spans; each character written stands for its whole span."""
        if not edits:
            return self
        text, spans, done = [], [], 0
        own = self.spans if self.spans is not None else [(i, i + 1) for i in range(len(self.text))]
        for start, end, new in edits:
            text += [self.text[done:start], new]
            spans += own[done:start]
            spans += [self.source(start, end)] * len(new)
            done = end
        return Traced("".join([*text, self.text[done:]]), spans + own[done:])


# Letters that look like ASCII ones.
_TWINS = dict(zip("АВЕКМНОРСТХаеорсухіјѕԁԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧοι",
                  "ABEKMHOPCTXaeopcyxijsdqwABEZHIKMNOPTYXoi"))
_INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
_DASHES = "\u2010\u2011\u2012\u2013\u2014\u2212\ufe63"


@lru_cache(maxsize=1)
def _look_alikes() -> tuple[dict[str, str], re.Pattern]:
    """Character -> ASCII text, by rule: full-width forms, decimal digits of other scripts, twins, dashes, blanks."""
    table = dict(_TWINS)
    table.update({chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)})
    for c in range(0x80, 0x1FBFA):
        if unicodedata.category(chr(c)) == "Nd":
            table[chr(c)] = str(unicodedata.decimal(chr(c)))
    table.update(dict.fromkeys(_INVISIBLE, ""))
    table.update(dict.fromkeys(_DASHES, "-"))
    table.update({"\u00a0": " ", "\u2024": ".", "\u3002": ".", "\ufe6b": "@"})
    return table, re.compile("[" + "".join(map(re.escape, table)) + "]")


def fold_look_alikes(traced: Traced) -> Traced:
    if traced.text.isascii():
        return traced
    table, pattern = _look_alikes()
    return traced.rewrite([(m.start(), m.end(), table[m.group()]) for m in pattern.finditer(traced.text)])


# Spelled digits.
_SPELLED = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6",
            "seven": "7", "eight": "8", "nine": "9"}
_WORD = "|".join(_SPELLED)
# What can stand in a card, phone or IP once digits are spelled out: words and numerals, apart by a few signs.
_UNIT = rf"(?:{_WORD}|dot|point|plus|[0-9]+)"
_GAP = r"[\x20().,+-]+"
_SPELLED_RUN = re.compile(rf"\b{_UNIT}(?:{_GAP}{_UNIT}\b)+", re.IGNORECASE)
_SPELLED_TOKEN = re.compile(r"[a-z]+|[0-9]+", re.IGNORECASE)
# Disguised signs: in brackets anywhere; bare words between blanks only as a whole address.
_BRACKETED = re.compile(r"\x20?(?:\[\x20?(at|dot|@|\.)\x20?\]|\(\x20?(at|dot|@|\.)\x20?\)|\{\x20?(at|dot|@|\.)\x20?\}"
                        r"|<\x20?(at|dot|@|\.)\x20?>)\x20?", re.IGNORECASE)
_DIGIT_DOT = re.compile(r"(?<=[0-9])\x20dot\x20(?=[0-9])", re.IGNORECASE)
_SIGN = {"at": "@", "dot": ".", "@": "@", ".": "."}
# A bare address: what stands before the at sign (read backwards) and behind it, of any length.
_BARE_AT = re.compile(r"\x20at\x20|\x20?@\x20?", re.IGNORECASE)
_LOCAL_BACK = re.compile(r"[A-Za-z0-9_+-]++(?:(?:\.|\x20tod\x20)[A-Za-z0-9_+-]++)*+", re.IGNORECASE)
_HOST = re.compile(r"[A-Za-z0-9-]++(?:(?:\.|\x20dot\x20)[A-Za-z0-9-]++)*+", re.IGNORECASE)
_JOIN = re.compile(r"\.|\x20dot\x20", re.IGNORECASE)
_ENDING = re.compile(r"[A-Za-z]{2,}(?![A-Za-z0-9])")
# Usual endings beside those of two letters, mail hosts, and words that announce an address.
_ENDINGS = frozenset("com org net edu gov mil int info biz name pro travel museum jobs mobi tel cat asia post app dev page "
                     "cloud online site store shop tech xyz email".split())
_MAIL_HOSTS = frozenset("example mail gmail googlemail yahoo hotmail outlook icloud proton protonmail gmx aol".split())
_ANNOUNCED = re.compile(r"\b(?:e-?mails?|mails?|contact|write|reach|reply|send|address|courriel|[ée]cri\w+|schreib\w*|kontakt"
                        r"|correo|correio)\b|[:(<\[\"']\s?\Z", re.IGNORECASE)
NEAR_CHARS = 48          # how far before an address a word may announce it


def _bare_addresses(text: str) -> Iterator[tuple[int, int, list[tuple[int, int, str]]]]:
    """(start, end, edits) of ``name at host dot tld``, at least one ``dot`` in words.

    The same words are ordinary prose (``met at noon dot com boom``), so two of these must hold: a usual ending; a name
    or host that is no plain word (digits, several labels, a mail host) or a real at sign; an announcement before it.
    Each stretch between two at signs is read once in either direction.
    """
    done = 0
    for m in _BARE_AT.finditer(text):
        before, done_before = text[done:m.start()], done
        done = m.end()
        local, host = _LOCAL_BACK.match(before[::-1]), _HOST.match(text, m.end())
        if not local or not host:
            continue
        start, joins = m.start() - local.end(), list(_JOIN.finditer(text, host.start(), host.end()))
        while joins and not _ENDING.match(text, joins[-1].end()):
            joins.pop()
        if not joins:
            continue
        end = _ENDING.match(text, joins[-1].end()).end()
        local_joins = list(_JOIN.finditer(text, start, m.start()))
        if not any(" " in j.group() for j in (*joins, *local_joins)):
            continue
        ending = text[joins[-1].end():end].lower()
        name, first = text[start:m.start()], text[host.start():joins[0].start()].lower()
        shape = ("@" in m.group() or not name.isalpha() or len(joins) > 1 or not first.isalpha() or first in _MAIL_HOSTS)
        announced = _ANNOUNCED.search(text[max(start - NEAR_CHARS, done_before if done_before < start else 0, 0):start])
        if (len(ending) == 2 or ending in _ENDINGS) + shape + bool(announced) >= 2:
            yield start, end, [*((*j.span(), ".") for j in local_joins), (*m.span(), "@"), *((*j.span(), ".") for j in joins)]


def spell_signs(traced: Traced) -> Traced:
    """Bracketed signs, then bare ones."""
    lower = traced.text.lower()
    if any(sign + close in lower for sign in _SIGN for close in ("]", ")", "}", ">", " ]", " )", " }", " >")):
        edits = [(m.start(), m.end(), _SIGN[next(g for g in m.groups() if g).lower()])
                 for m in _BRACKETED.finditer(traced.text)]
        traced = traced.rewrite(edits)
    if " dot " in lower:
        edits, reach = [], 0
        for edit in sorted({e for _, _, found in _bare_addresses(traced.text) for e in found}):
            if edit[0] >= reach:  # one address's host may be the next one's name
                edits.append(edit)
                reach = edit[1]
        traced = traced.rewrite(edits)
        traced = traced.rewrite([(*m.span(), ".") for m in _DIGIT_DOT.finditer(traced.text)])
    return traced


def spell_digits(traced: Traced) -> Traced:
    """Spelled digits, with plus, dot and point between them, in runs that could hold a card, phone or IP."""
    edits, text = [], traced.text
    for m in _SPELLED_RUN.finditer(text):
        run = m.group()
        tokens = list(_SPELLED_TOKEN.finditer(run))
        words = [t.group().lower() for t in tokens]
        digits = sum(1 if w in _SPELLED else len(w) if w[0].isdigit() else 0 for w in words)
        phone = digits >= 8 and ("+" in run or "plus" in words or text[max(m.start() - 2, 0):m.start()].strip(" (")
                                 .endswith("+"))
        dots = run.count(".") + words.count("dot") + words.count("point")
        if (digits >= 16 or phone or digits >= 4 and dots >= 3) and not all(w[0].isdigit() for w in words):
            edits += [(m.start() + a, m.start() + b, new) for a, b, new in _run_edits(run, tokens)]
    return traced.rewrite(edits)


def _run_edits(run: str, tokens: list[re.Match]) -> list[tuple[int, int, str]]:
    """Edits of one run: words to signs; digits beside a dot joined to numbers up to 255, elsewhere one blank apart."""
    values = []
    for t in tokens:
        word = t.group().lower()
        values.append({"plus": "+", "dot": ".", "point": "."}.get(word) or _SPELLED.get(word, word))
    gaps = [run[a.end():b.start()] for a, b in zip(tokens, tokens[1:])]
    spoken = [not t.group()[0].isdigit() for t in tokens]
    # A dot counts between digits only: as a word between blanks, or as the sign alone.
    number = [v.isdigit() for v in values]
    sign = [v == "." and 0 < i < len(values) - 1 and number[i - 1] and number[i + 1]
            and all(g in (" ", "-") for g in gaps[i - 1: i + 1]) for i, v in enumerate(values)]
    new_gaps: list[str] = []
    for i, gap in enumerate(gaps):
        if sign[i] or sign[i + 1] or values[i] == "+" and not gap.strip(" -"):
            gap = ""
        elif number[i] and number[i + 1] and (spoken[i] or spoken[i + 1]) and len(gap) <= 2 and not gap.strip(" ,-"):
            gap = "-" if gap == "-" else " "
        new_gaps.append(gap)
    # The digits that make one number with a dot: from the dot on, as long as they are 255 at most.
    blank = lambda i: number[i] and number[i + 1] and new_gaps[i] in (" ", "-") and (spoken[i] or spoken[i + 1])
    after = [sign[i - 1] or i > 0 and new_gaps[i - 1] == "." and number[i - 1] for i in range(len(values))]
    before = [i + 1 < len(values) and (sign[i + 1] or new_gaps[i] == "." and number[i + 1]) for i in range(len(values))]
    after[0] = False
    joined = set()
    for i in range(len(values)):
        if not number[i]:
            continue
        if before[i]:
            k, digits = i - 1, values[i]
            while k >= 0 and blank(k) and len(digits := values[k] + digits) <= 3 and int(digits) <= 255:
                joined.add(k)
                k -= 1
        elif after[i] and not before[i]:
            k, digits = i, values[i]
            end = i
            while end + 1 < len(values) and blank(end):
                end += 1
            if end + 1 < len(values) and before[end]:
                continue  # a number between two dots is joined from its end
            while k < end and len(digits := digits + values[k + 1]) <= 3 and int(digits) <= 255:
                joined.add(k)
                k += 1
    edits = []
    for i, t in enumerate(tokens):
        if spoken[i] and (sign[i] or values[i] != "."):
            edits.append((t.start(), t.end(), values[i]))
        if i < len(gaps):
            gap = "" if i in joined else new_gaps[i]
            if gap != gaps[i]:
                edits.append((t.end(), tokens[i + 1].start(), gap))
    return edits


def spell_out(traced: Traced) -> Traced:
    """Signs, then digits."""
    return spell_digits(spell_signs(traced))


def _with_mapped(base: list[Span], mapped: list[Span]) -> list[Span]:
    """Base spans and the mapped ones that no other span covers, sorted."""
    own, kept, reach = set(base), [], -1
    for start, end in sorted(own.union(mapped), key=lambda s: (s[0], -s[1])):
        if end > reach or (start, end) in own:
            kept.append((start, end))
        reach = max(reach, end)
    return sorted(kept)


def find_all(text: str) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """(base spans, base spans and those of disguised data) by kind, in source characters, sorted."""
    base = detect(text)
    mapped: dict[str, list[Span]] = {kind: [] for kind in KINDS}
    plain = Traced(text)
    for rewriting in (fold_look_alikes, spell_signs, spell_digits):
        known, plain = plain, rewriting(plain)
        if plain is not known:
            for kind, spans in detect(plain.text).items():
                mapped[kind] += [plain.source(*s) for s in spans]
    if plain.spans is None:
        return base, base
    return base, {kind: _with_mapped(base[kind], mapped[kind]) for kind in KINDS}


def listed(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind in KINDS for a, b in spans[kind])


def mask(text: str) -> str:
    """The text with every span (joined where kinds overlap) replaced by ``[kind]``."""
    spans = sorted((a, b, kind) for kind, found in find_all(text)[1].items() for a, b in found)
    out, done = [], 0
    for a, b, kind in spans:
        if a >= done:
            out += [text[done:a], f"[{kind}]"]
        done = max(done, b)
    return "".join([*out, text[done:]]) if out else text


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: base counts by kind, digest of the base spans, all spans.

    The counts are of base spans; ``spans`` adds the disguised ones.
    """
    fields = ("doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, "
              "n_disguised long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, texts, more = {k: [] for k in KINDS}, [], [], []
            for text in batch.column("text").fill_null("").to_pylist():
                base, found = find_all(text)
                for kind in KINDS:
                    counts[kind].append(len(base[kind]))
                digests.append(hashlib.sha256(listed(base).encode()).hexdigest())
                texts.append(listed(found))
                more.append(sum(len(found[k]) - len(base[k]) for k in KINDS))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(counts[k], pa.int64()) for k in KINDS),
                 pa.array(digests, pa.string()), pa.array(texts, pa.string()), pa.array(more, pa.int64())],
                names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_disguised"])

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return map_arrow(plain, run, fields)


def mask_personal_data(docs: DataFrame, text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """The same rows and columns with personal data masked; null texts stay null.

    A column of text lengths named ``n_chars``, if there is one, is brought up to date.
    """
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in batch_slices(whole, place)):
            masked = [None if t is None else mask(t) for t in batch.column(place).to_pylist()]
            columns = list(batch.columns)
            columns[place] = pa.array(masked, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    out = docs.withColumn(text, F.col(text).cast("string"))
    out = map_arrow(out, run, out.schema)
    if n_chars in docs.columns and n_chars != text:
        length = F.char_length(text).cast(docs.schema[n_chars].dataType)
        out = out.withColumn(n_chars, F.coalesce(length, F.col(n_chars)))
    return out
