"""Format-preserving Feistel pseudonyms for personal data in texts.

Validated values (card numbers by checksum, IBANs by their check digits,
social-security numbers by their rules, IPv4 addresses, calendar dates, phone
numbers, e-mail addresses, keys and secrets) are replaced inside their own
format: the value's free digits and letters are read as one number in a mixed
radix, that number is permuted by a keyed Feistel network over exactly that
domain (walking the cycle until the result is valid again), check digits are
made anew, and separators stay.  The permutation depends on the key, the kind and
the format alone, so equal values get equal pseudonyms in every document and
different values different ones; ``invert=True`` gives the values back.

Defined cases: a null text stays null with no finds, an empty one empty; whole
texts are read, whatever their length; where finds overlap, the one that starts
first, then the kind listed first, wins; a value that fails its validation is
left alone, a date outside 1900 to 2099 among them; digits are ASCII digits but for
names in addresses, which may have letters and digits of any script; repeated rows are treated alike; an empty table gives no rows;
other columns are carried only where asked for.
"""

from __future__ import annotations

import datetime
import functools
import hashlib
import math
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
_LETTERS, _DIGITS, _HEX = "abcdefghijklmnopqrstuvwxyz", "0123456789", "0123456789abcdef"


def feistel(x: int, n: int, key: bytes, tweak: str, invert: bool = False) -> int:
    """A keyed permutation of 0 .. n-1."""
    if n < 2:
        return x
    a = math.isqrt(n - 1) + 1
    b = -(-n // a)                                   # a * b >= n; values beyond n are walked over
    head = tweak.encode() + b"\0" + str(n).encode() + b"\0"

    def f(i: int, v: int, m: int) -> int:
        size = (m.bit_length() + 7) // 8 + 8
        out, k = b"", 0
        while len(out) < size:
            out += hashlib.blake2b(head + bytes((i, k)) + v.to_bytes((v.bit_length() + 8) // 8, "little"), key=key[:64], digest_size=64).digest()
            k += 1
        return int.from_bytes(out[:size], "little") % m

    while True:
        left, right = divmod(x, b)
        if not invert:
            for i in range(0, ROUNDS, 2):
                left = (left + f(i, right, a)) % a
                right = (right + f(i + 1, left, b)) % b
        else:
            for i in range(ROUNDS - 2, -1, -2):
                right = (right - f(i + 1, left, b)) % b
                left = (left - f(i, right, a)) % a
        x = left * b + right
        if x < n:
            return x


@functools.lru_cache(1000)
def _alike(page: int, category: str) -> str:
    """The characters of one category (lower-case letters, say) among 256 neighbouring code points, ASCII left out."""
    return "".join(c for c in map(chr, range(max(page << 8, 128), (page + 1) << 8)) if unicodedata.category(c) == category and c.isalnum())


def _permute(text: str, key: bytes, kind: str, invert: bool, hexa: bool = False, chunk: int = 64) -> str:
    """Letters stay letters of their case and digits digits (``hexa``: hex digits of their case).
    Beyond ASCII, a letter or digit stays of its category and among the 256 code points around it."""
    slots = []
    for i, c in enumerate(text):
        if hexa and c.lower() in _HEX:
            slots.append((i, _HEX, text.isupper()))
        elif not hexa and c.isascii() and c.isalnum():
            slots.append((i, _DIGITS if c.isdigit() else _LETTERS, c.isupper()))
        elif not hexa and c.isalnum():
            slots.append((i, _alike(ord(c) >> 8, unicodedata.category(c)), None))
    out = list(text)
    shape = "".join("h" if a is _HEX else "9" if a is _DIGITS else a[0] if up is None else "A" if up else "a" for _, a, up in slots)
    for k in range(0, len(slots), chunk):
        part, x, n = slots[k: k + chunk], 0, 1
        for i, alphabet, up in part:
            x, n = x * len(alphabet) + alphabet.index(text[i] if up is None else text[i].lower()), n * len(alphabet)
        x = feistel(x, n, key, f"{kind}/{shape[k: k + chunk]}/{k}", invert)
        for i, alphabet, up in reversed(part):
            x, d = divmod(x, len(alphabet))
            out[i] = alphabet[d].upper() if up else alphabet[d]
    return "".join(out)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 if k % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _fill(shape: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c in _DIGITS else c for c in shape)


def _card(v, key, invert):
    d = re.sub("[^0-9]", "", v)
    if not 13 <= len(d) <= 19 or not (d[0] in "3456" or 2221 <= int(d[:4]) <= 2720) or not luhn(d):
        return None
    stay = 4 if d[0] == "2" else 1                   # the network's digits stay, the last one is the checksum
    free = len(d) - stay - 1
    body = d[:stay] + str(feistel(int(d[stay:-1]), 10**free, key, f"card/{len(d)}/{d[:stay]}", invert)).zfill(free)
    return _fill(v, next(body + c for c in _DIGITS if luhn(body + c)))


def _iban_number(s: str) -> int:
    return int("".join(str(int(c, 36)) for c in s))


def _iban(v, key, invert):
    s = v.replace(" ", "")
    if not 15 <= len(s) <= 34 or _iban_number(s[4:] + s[:4]) % 97 != 1:
        return None
    body = _permute(s[4:], key, "iban/" + s[:2], invert)
    s = s[:2] + f"{98 - _iban_number(body + s[:2] + '00') % 97:02d}" + body
    it = iter(s)
    return "".join(c if c == " " else next(it) for c in v)


def _ssn(v, key, invert):
    ok = lambda d: d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"
    d = v.replace("-", "")
    if not ok(d):
        return None
    while True:
        d = str(feistel(int(d), 10**9, key, "ssn", invert)).zfill(9)
        if ok(d):
            return f"{d[:3]}-{d[3:5]}-{d[5:]}"


def _ip(v, key, invert):
    q = v.split(".")
    if any(int(x) > 255 or (len(x) > 1 and x[0] == "0") for x in q):
        return None
    x = feistel(int.from_bytes(bytes(map(int, q)), "big"), 2**32, key, "ip", invert)
    return ".".join(map(str, x.to_bytes(4, "big")))


def _date(v, key, invert):
    iso = re.fullmatch(r"(\d{4})([-/.])(\d\d)\2(\d\d)", v)
    dmy = re.fullmatch(r"(\d\d)([-/.])(\d\d)\2(\d{4})", v)
    try:
        if iso:
            day, form = datetime.date(int(iso[1]), int(iso[3]), int(iso[4])), f"%Y{iso[2]}%m{iso[2]}%d"
        elif int(dmy[3]) <= 12:
            day, form = datetime.date(int(dmy[4]), int(dmy[3]), int(dmy[1])), f"%d{dmy[2]}%m{dmy[2]}%Y"
        else:
            day, form = datetime.date(int(dmy[4]), int(dmy[1]), int(dmy[3])), f"%m{dmy[2]}%d{dmy[2]}%Y"
    except ValueError:
        return None
    lo, hi = datetime.date(1900, 1, 1).toordinal(), datetime.date(2100, 1, 1).toordinal()
    if not lo <= day.toordinal() < hi:
        return None
    month_first = form.startswith("%m")
    x = day.toordinal() - lo
    while True:                                      # a day-first date stays readable as the same form
        x = feistel(x, hi - lo, key, "date" + form, invert)
        new = datetime.date.fromordinal(lo + x)
        if not month_first or new.day > 12:
            return new.strftime(form)


def _phone(v, key, invert):
    d = re.sub("[^0-9]", "", v)
    if not 8 <= len(d) <= 15:
        return None
    keep = len(re.match(r"\+?(\d{1,3})(?=\D)|\+?(\d)|\(?", v).group().strip("+(")) if v[0] == "+" else 0
    n = len(d) - keep
    return _fill(v, d[:keep] + str(feistel(int(d[keep:]), 10**n, key, f"phone/{d[:keep]}/{n}", invert)).zfill(n))


def _email(v, key, invert):
    name, _, host = v.rpartition("@")
    sub, _, top = host.rpartition(".")
    return f"{_permute(name, key, 'email', invert)}@{_permute(sub, key, 'host', invert)}.{top}"


def _secret(v, key, invert):
    head = re.match(r"(?i)(?:\w+\s*[=:]\s*[\"']?|bearer\s+)", v)
    k = head.end() if head else 0
    return v[:k] + _permute(v[k:], key, "secret", invert)


def _prefixed(v, key, invert):
    k = re.match(r"AKIA|ASIA|gh[pousr]_|sk-|xox[abpr]-", v).end()
    return v[:k] + _permute(v[k:], key, "key", invert)


def _hex(v, key, invert):
    return _permute(v, key, "hex", invert, hexa=True) if re.search("[0-9]", v) and not v.isdigit() else None


# kinds in order of precedence: (name, pattern, rewrite)
KINDS = [
    ("email", r"(?<![\w.+%-])[^\W_][\w.+%-]*@(?:[\w-]+\.)+[^\W\d_]{2,}(?![\w-])", _email),
    ("secret", r"(?i:(?<!\w)(?:api_?key|secret(?:_key)?|token|passw(?:or)?d|access_key)\s*[=:]\s*[\"']?[A-Za-z0-9_\-+/]{8,}|(?<!\w)bearer\s+[A-Za-z0-9_\-.]{16,})", _secret),
    ("key", r"(?<!\w)(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{30,}|sk-[A-Za-z0-9_-]{20,}|xox[abpr]-[A-Za-z0-9-]{10,})(?!\w)", _prefixed),
    ("iban", r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?!\w)", _iban),
    ("hex", r"(?<!\w)(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?!\w)", _hex),
    ("card", r"(?<![\w.-])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){2}[ -][0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![\w-])", _card),
    ("ssn", r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])", _ssn),
    ("date", r"(?<![\w.-])(?:[0-9]{4}([-/.])[0-9]{2}\1[0-9]{2}|[0-9]{2}([-/.])[0-9]{2}\2[0-9]{4})(?![\w-])", _date),
    ("ip", r"(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\w|\.[0-9])", _ip),
    ("phone", r"(?<![\w+])(?:\+1[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}|\+[0-9]{1,3}(?:[ .-]?\(?[0-9]{1,4}\)?){2,5}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?!\w)", _phone),
]


def scan(text: str, key: bytes, invert: bool = False) -> tuple[str, list[tuple[str, int, int]]]:
    """(text with pseudonyms, [(kind, start, end) in the text given])."""
    hits = []
    for rank, (kind, pattern, rewrite) in enumerate(_COMPILED):
        for m in pattern.finditer(text):
            hits.append((m.start(), rank, m.end(), kind, m.group(), rewrite))
    out, spans, at = [], [], 0
    for s, _, e, kind, value, rewrite in sorted(hits, key=lambda h: h[:3]):
        if s < at:
            continue
        new = rewrite(value, key, invert)
        if new is None:
            continue
        out += (text[at:s], new)
        spans.append((kind, s, e))
        at = e
    return "".join(out) + text[at:], spans


_COMPILED = [(k, re.compile(p), f) for k, p, f in KINDS]


def pseudonymise(df: DataFrame, key: bytes, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None,
                 invert: bool = False) -> DataFrame:
    """doc_id, the rewritten text, the number of finds and their spans in the original;
    columns named in ``keep`` come along as ``__x0`` ..."""
    keep = keep or []
    typ = {f.name: f for f in df.schema.fields}

    def part(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                rows = batch.slice(i, 256)
                done = [(None, []) if t is None else scan(t, key, invert) for t in rows.column("__text").to_pylist()]
                spans = [[{"kind": k, "start": s, "end": e} for k, s, e in found] for _, found in done]
                arrays = [rows.column("__id"), pa.array([t for t, _ in done], pa.string()), pa.array([len(f) for _, f in done], pa.int64()),
                          pa.array(spans, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))]
                yield pa.RecordBatch.from_arrays(arrays + [rows.column(f"__x{k}") for k in range(len(keep))],
                                                 names=["doc_id", "text", "n_found", "spans", *(f"__x{k}" for k in range(len(keep)))])

    src = df.select(F.col(doc_id).cast("long").alias("__id"), F.col(text).cast("string").alias("__text"),
                    *(F.col(f"`{c}`").alias(f"__x{k}") for k, c in enumerate(keep)))
    return src.mapInArrow(part, "doc_id long, text string, n_found long, spans array<struct<kind:string,start:long,end:long>>"
                          + "".join(f", __x{k} {typ[c].dataType.simpleString()}" for k, c in enumerate(keep)))
