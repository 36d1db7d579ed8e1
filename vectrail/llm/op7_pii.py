"""Personal data in whole texts, plain or disguised, with places in the source text.

Plain identifiers are found by pattern in the text itself. Two transducers then rewrite what hides identifiers, the second
one the output of the first: one folds characters (look-alike letters, full-width forms, invisible ones, character
references), the other one words (spelled digits, "[at]" and "dot", "plus"). Each notes for every piece of its output where
it came from; the same patterns run over the last output, and spans that hold a piece that either has rewritten are mapped
back through both to source characters, and added unless they overlap a plain one. A second reading rewrites number words
in runs of any length, over commas too, and adds what overlaps nothing found before. All steps are linear in the length of
the text.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame

from vectrail.llm.common import map_batches, table

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A digit run is tried from its first digit only: a later start would fail or succeed at the same place.
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from each @: the local part is what precedes it, back to the last match."""
    out, at, free = [], text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            free = m.end()
        at = text.find("@", at + 1)
    return out


def ips(text: str) -> list[tuple[int, int]]:
    out, at = [], 0
    while m := IP.search(text, at):
        if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or "0") < 256 for p in m.groups()):
            out.append(m.span())
        at = m.end()
    return out


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in CARD.finditer(text):
        if 14 <= m.end() - m.start():
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    if "+" not in text:
        return []
    return [m.span() for m in PHONE.finditer(text) if 10 <= len(DIGIT.findall(m[0])) <= 15]


FINDERS = (emails, ips, cards, phones)


def plain_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all plain identifiers, by start, then kind."""
    return sorted((a, k, b) for k, f in enumerate(FINDERS) for a, b in f(text))


# Letters that look like an ASCII letter, and the letters they look like.
LOOKALIKE = dict(zip("асеорхуіјѕԁһкАВСЕНІЈКМОРЅТХУαεινορτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aceopxyijsdhkABCEHIJKMOPSTXYaeivoptuxABEZHIKMNOPTYX", strict=True))
# Number words.
NUMBERS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
INVISIBLE = "​‌‍⁠﻿­"
FOLDED = "Ͱ-ϿЀ-ԯ٠-٩۰-۹․．。﹒﹫！-～⁰-ₜ①-⑨\U0001d400-\U0001d7ff" + INVISIBLE
# Names of character references that hide an identifier's marks.
NAMED = {"commat": "@", "period": ".", "plus": "+", "nbsp": " ", "hyphen": "-", "lowbar": "_"}
FOLD = re.compile(rf"[{FOLDED}]|&(?:#(?:[0-9]{{1,7}}|[xX][0-9a-fA-F]{{1,6}})|{'|'.join(NAMED)});")
# Endings of hosts, and words before "at" that name no mailbox.
ENDINGS = "com|net|org|edu|gov|io|co|info|biz|dev|app|example|test|de|fr|es|it|nl|uk|eu|us|ch|at|be|ca|au|in|jp|cn|ru|br|mx|se|no|fi|dk|pl"
NO_MAILBOX = frozenset("a an and are arrive arrived available based be been bought call came found from get go good had has have he help her here hers him his hosted i in information is it join located look looked looking looks mail me meet met more not now of on online or order our page posted published read register see seen sell shop she sign site start stay stop store that the their them there these they this those to today up us visit was we website were work worked works you your".split())
_number = "|".join(NUMBERS)
_long = rf"\b(?:{_number})(?:[ -]{{1,2}}(?:{_number})\b){{6,}}+"
_any = rf"(?:(?<=[0-9]),[ ]{{1,2}})?\b(?:{_number})\b(?:(?:,[ ]{{0,2}}|[ -]{{1,2}})(?:{_number})\b)*+(?:,(?=[ ]{{1,2}}[0-9]))?"
_host = rf"[a-z0-9-]{{1,63}}(?:\.[a-z0-9-]{{1,63}}){{0,4}}?\.(?:{ENDINGS})\b"
_others = (
    r"|(?P<at>[ \t]{0,3}[\[({<][ \t]{0,3}(?:at|@)[ \t]{0,3}[\])}>][ \t]{0,3})"
    r"|(?P<dot>[ \t]{0,3}[\[({<][ \t]{0,3}(?:dot|\.)[ \t]{0,3}[\])}>][ \t]{0,3})"
    r"|(?P<wordat>(?<=[a-z0-9])[ \t]{1,3}at[ \t]{1,3}(?=[a-z0-9-]{1,63}[ \t]{1,3}dot[ \t]{1,3}[a-z0-9]))"
    rf"|(?P<hostat>(?<=[a-z0-9])[ \t]{{1,3}}at[ \t]{{1,3}}(?={_host}))"
    rf"|(?P<apart>(?<=[a-z0-9])(?:[ \t]{{1,3}}@[ \t]{{0,3}}|@[ \t]{{1,3}})(?={_host}))"
    r"|(?P<worddot>(?<=[a-z0-9])[ \t]{1,3}dot[ \t]{1,3}(?=[a-z0-9]))"
    rf"|(?P<plus>\bplus[ \t]{{1,3}}(?=[0-9]|(?:{_number})\b)|\+[ \t]{{1,3}}(?=(?:{_number})\b))"
)
WORDS = re.compile(rf"(?P<spelled>{_long}){_others}", re.IGNORECASE)
#: The second reading: number words in runs of any length, over commas too.
WORDS_ANY = re.compile(rf"(?P<spelled>{_any}){_others}", re.IGNORECASE)
NUMBER = re.compile(rf"\b(?:{_number})\b", re.IGNORECASE)
# What a text must hold, case folded, for the second transducer to write anything.
HINTS = ("dot", "plus", "+ ", "+\t", " @", "\t@", "@ ", "@\t")
BRACKETED = re.compile(r"[\[({<][ \t]{0,3}(?:at|@|dot|\.)[ \t]{0,3}[\])}>]")
AT_HOST = re.compile(r"at[ \t]{1,3}" + _host)
LAST_WORD = re.compile(r"[A-Za-z]+\Z")
MARK_OF = {"at": "@", "wordat": "@", "hostat": "@", "apart": "@", "dot": ".", "worddot": ".", "plus": "+"}

#: A piece: (start, end) in the rewritten text and (start, end) in the source.
Piece = tuple[int, int, int, int]


def fold(c: str) -> str:
    """ASCII form of a look-alike character; itself if there is none."""
    if c in INVISIBLE:
        return ""
    if c in LOOKALIKE:
        return LOOKALIKE[c]
    if c in "․。﹒":
        return "."
    n = unicodedata.normalize("NFKC", c)
    if n.isascii():
        return n
    d = unicodedata.digit(c, None)
    return c if d is None else str(d)


def folded(m: re.Match) -> str | None:
    """What the first transducer writes for a match; None leaves it as it is."""
    if m[0][0] != "&":
        c = m[0]
    elif m[0][1] != "#":
        c = NAMED[m[0][1:-1]]
    else:
        number = int(m[0][3:-1], 16) if m[0][2] in "xX" else int(m[0][2:-1])
        if not 32 <= number < 0x110000 or 0xD800 <= number < 0xE000:
            return None
        c = chr(number)
    new = fold(c)
    return None if new == m[0] else new


def reworded(m: re.Match) -> str | None:
    """What the second transducer writes for a match; None leaves it as it is."""
    kind = m.lastgroup
    if kind == "spelled":
        new = "".join(NUMBERS[w.casefold()] for w in re.findall(r"[^\W\d_]+", m[0]))
        # A comma between digits and number words becomes a blank, which the patterns allow.
        return " " + new if m[0].startswith(",") else new
    if kind == "hostat":
        before = LAST_WORD.search(m.string, max(0, m.start() - 30), m.start())
        if before and before[0].lower() in NO_MAILBOX:
            return None
    return MARK_OF[kind]


def rewrite(text: str, pattern: re.Pattern, new_of) -> tuple[str, list[Piece]]:
    """(rewritten text, pieces)."""
    out, pieces, at, size = [], [], 0, 0
    for m in pattern.finditer(text):
        new = new_of(m)
        if new is None:
            continue
        out += [text[at : m.start()], new]
        size += m.start() - at
        pieces.append((size, size + len(new), m.start(), m.end()))
        size += len(new)
        at = m.end()
    out.append(text[at:])
    return "".join(out) if pieces else text, pieces


class Layer:
    """Way back from a transducer's output to its input."""

    def __init__(self, pieces: list[Piece]):
        self.pieces = pieces
        self.ends = [p[1] for p in pieces]

    def place(self, i: int, end: bool) -> int:
        """The input position of the output's position i; inside a piece, the piece's edge."""
        pieces = self.pieces
        k = bisect_right(self.ends, i) - 1
        if k + 1 < len(pieces) and pieces[k + 1][0] < i < pieces[k + 1][1]:
            return pieces[k + 1][3 if end else 2]
        if end and k >= 0 and pieces[k][1] == i:
            return pieces[k][3] if pieces[k][0] < i else pieces[k][2]
        return i if k < 0 else pieces[k][3] + i - pieces[k][1]

    def touched(self, a: int, b: int) -> bool:
        """Whether the output from a to b holds a rewritten piece."""
        k = bisect_right(self.ends, a)
        return k < len(self.pieces) and self.pieces[k][0] < b


def hints(text: str) -> tuple[bool, bool]:
    """Whether a text holds number words, and whether it holds other words that the second transducer may rewrite."""
    low = text.casefold()
    numbers = any(w in low for w in NUMBERS) and bool(NUMBER.search(text))
    return numbers, any(h in low for h in HINTS) or bool(BRACKETED.search(low)) or bool(AT_HOST.search(low))


def disguised_spans(text: str, characters: list[Piece], words: re.Pattern | None) -> list[tuple[int, int, int, bool]]:
    """(start, kind, end, whether only characters are rewritten in it) in the source of the identifiers that the rewritten text
    shows and that hold a rewritten piece.

    text is the first transducer's output, characters are its pieces; without a pattern no words are rewritten.
    """
    new, pieces = rewrite(text, words, reworded) if words else (text, [])
    if not pieces and not characters:
        return []
    second, first = Layer(pieces), Layer(characters)
    out = []
    for a, kind, b in plain_spans(new):
        x, y = second.place(a, False), second.place(b, True)
        reworded_ = second.touched(a, b)
        if reworded_ or first.touched(x, y):
            out.append((first.place(x, False), kind, first.place(y, True), not reworded_))
    return out


def find(text: str | None) -> tuple[list, list]:
    """(plain spans, added spans) of a text; none for a null."""
    text = text or ""
    base = plain_spans(text)
    plain, characters = (text, []) if text.isascii() and "&" not in text else rewrite(text, FOLD, folded)
    added = []
    numbers, marks = hints(plain)
    for words in (WORDS, WORDS_ANY) if numbers else (WORDS,) if marks else (None,) if characters else ():
        taken = sorted((a, b, k) for a, k, b in base + added)
        for a, k, b, whole in disguised_spans(plain, characters, words):
            i = bisect_right(taken, (a, len(text) + 1, 0))
            lo = i - 1 if i and taken[i - 1][1] > a else i
            hi = lo
            while hi < len(taken) and taken[hi][0] < b:
                hi += 1
            # One that shares characters with another is added only if folded characters make that one longer.
            longer = whole and all(a <= x and y <= b and y - x < b - a and kind == k for x, y, kind in taken[lo:hi])
            if lo == hi or longer:
                added.append((a, k, b))
    return base, sorted(added)


def mask(text: str | None) -> str | None:
    """The text with every identifier replaced by its kind in brackets."""
    if not text:
        return text
    base, added = find(text)
    out, at = [], 0
    for a, k, b in sorted(base + added, key=lambda s: (s[0], -s[2], s[1])):
        if b <= at:
            continue
        out += [text[at : max(a, at)], f"[{KINDS[k].upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def detect(docs: DataFrame) -> DataFrame:
    """(doc_id, spans, base_spans) of every row: lists of (kind, start, end) in code points, end exclusive.

    A null or empty text has none; repeated rows have equal results; an empty table gives no row; texts are read whole,
    however long, and numbers of any length. Columns other than doc_id and text are not read, whatever their names.
    """

    def run(batches):
        item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        rows = lambda spans: [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans]
        for b in batches:
            found = [find(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([rows(sorted(x + y)) for x, y in found], pa.list_(item)), pa.array([rows(x) for x, _ in found], pa.list_(item))], ["doc_id", "spans", "base_spans"])

    item = "array<struct<kind:string,start:long,end:long>>"
    return map_batches(docs.select("doc_id", "text"), run, f"doc_id long, spans {item}, base_spans {item}")


def redact(docs: DataFrame) -> DataFrame:
    """docs with text masked and, where there is such a column, n_chars counted anew. Null texts stay null.

    Every row and every other column stays as it is, repeated rows and null ids too; an empty table stays empty.
    """
    names = docs.columns
    at = names.index("text")

    def run(batches):
        for b in batches:
            cols = list(b.columns)
            new = [mask(t.as_py()) for t in cols[at]]
            cols[at] = pa.array(new, cols[at].type)
            if "n_chars" in names:
                i = names.index("n_chars")
                cols[i] = pa.array([old if t is None else len(t) for t, old in zip(new, cols[i].to_pylist(), strict=True)], cols[i].type)
            yield pa.RecordBatch.from_arrays(cols, names)

    return map_batches(docs, run, docs.schema)


def op7_pii(spark, sf_dir: str) -> DataFrame:
    """Counts and digests of the spans of every document."""

    def digest(batches):
        for b in batches:
            rows = list(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True))
            join = lambda spans: ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in spans)
            counts = [[sum(s["kind"] == k for s in base) for _, base in rows] for k in KINDS]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array([hashlib.sha256(join(base).encode()).hexdigest() for _, base in rows], pa.string()), pa.array([join(s) for s, _ in rows], pa.string()), pa.array([len(s) - len(base) for s, base in rows], pa.int64())],
                ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"],
            )

    return map_batches(detect(table(spark, sf_dir, "documents")), digest, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
