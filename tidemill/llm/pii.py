"""Format-preserving pseudonyms of personal numbers, dates and addresses.

A value is found by pattern, validated (Luhn, mod 97, calendar, octets, number plan), reduced to a canonical integer below
the size of its kind's domain, permuted by a keyed Feistel network there, and written back in the format it had.  So equal
values get equal pseudonyms in every document and format, a pseudonym is valid again, and who has the key can invert it.

Kinds: payment cards (Luhn digit made anew), IBANs (check digits made anew), social security numbers, telephone numbers (country
code kept), dates 1900-2099, IPv4 addresses, and local parts of mail addresses (mail host kept; letters stay letters, digits digits).
What fails its validation is no such value and stays as it is.

Forms: IBANs in one piece, or printed in groups of four (of a country of IBAN_LENGTH); SSNs and cards with hyphens or single spaces; telephone
numbers with + and country code in up to six groups or with the area in parentheses, and North American ones without; dates in digits
(year first, or last with four or two digits; before "T" and a time, too) and with the month's name in English (or its first three
letters), French, German or Spanish.  Two digits are the years 1969-2068 and stay so; such dates, those with the month first in digits, and names
that two languages share may get another pseudonym than the same date has in full.  "Sept" and names without their accents come back as "Sep" and with accents.
Not read: dates without separators (19840305), with the year first in two digits, with a two-digit year and one-digit parts between dots or
hyphens, other languages and short names of months; national telephone numbers but North American ones; IPv6; SSNs without separators.

Cases: a null text stays null; an empty text stays empty; whole texts are read, and names of mail addresses, of any length; repeated rows are each
rewritten alike; of patterns that begin at one place the first in the list above PATTERN counts; extra columns, of any name, are kept; an empty table stays empty.
"""

from __future__ import annotations

import datetime
import hashlib
import re
import warnings
from collections.abc import Callable, Iterator
from functools import lru_cache
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import ident, lean, map_rows
from .words import pieces, raw

ROUNDS = 10
KEY_SETTING, DEMO_KEY = "spark.tidemill.pii.key", b"demonstration only"

#: full names first, as a name is of the first table that has it; a dot after the day, or "de", puts German or Spanish first
MONTHS = {
    "en": "january february march april may june july august september october november december".split(),
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre".split(),
    "de": "januar februar märz april mai juni juli august september oktober november dezember".split(),
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split(),
    "short": "jan feb mar apr may jun jul aug sep oct nov dec".split(),
}
_SAME = {"sept": "sep", "setiembre": "septiembre", "fevrier": "février", "aout": "août", "decembre": "décembre", "maerz": "märz"}
_MONTH = "(?:" + "|".join(sorted({*(m for t in MONTHS.values() for m in t), *_SAME}, key=lambda m: (-len(m), m))) + ")"
_WORDED = re.compile(rf"(?i:([0-9]{{1,2}})(st|nd|rd|th|er|\.)?( (?:of |de )?)({_MONTH})(\.?,? (?:de |del )?)([0-9]{{4}})|({_MONTH})(\.? )([0-9]{{1,2}})(st|nd|rd|th)?(,? )([0-9]{{4}}))")

#: how long an IBAN is; a printed one ends there, whatever stands after it
IBAN_LENGTH = {x[:2]: int(x[2:]) for x in (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 GB22 GE22 GI23 GL18 "
    "GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 "
    "PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30"
).split()}
_PRINTED = "|".join(rf"{c}[0-9]{{2}}" + " [A-Z0-9]{4}" * (n // 4 - 1) + (f" [A-Z0-9]{{{n % 4}}}" if n % 4 else "") for c, n in IBAN_LENGTH.items())

PATTERN = re.compile(
    r"(?P<mail>(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,})"
    rf"|(?P<iban>(?<![0-9A-Za-z])(?=[A-Z]{{2}}[0-9]{{2}})(?:[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{11,30}}|{_PRINTED})(?![0-9A-Za-z]))"
    r"|(?P<phone>(?<![0-9A-Za-z])\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)[ .-]?[0-9]{3}[ .-]?[0-9]{4}|[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}|[0-9]{2,4}(?:[ .-][0-9]{2,4}){2,3}"
    r"|[0-9]{1,5}[ .-][0-9]{5,10}|[0-9]{1,5}(?:[ .-][0-9]{2,6}){2,4}|\([0-9]{1,5}\)[ .-]?[0-9]{1,10}(?:[ .-][0-9]{2,8}){0,3}|[0-9]{7,12})(?![0-9A-Za-z])"
    r"|(?<![0-9A-Za-z])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9A-Za-z])|(?<![0-9A-Za-z.-])[0-9]{3}-[0-9]{3}-[0-9]{4}(?![0-9A-Za-z-]))"
    r"|(?P<card>(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}(?P<c>[ -])[0-9]{4}(?P=c)[0-9]{4}(?P=c)[0-9]{4}|[0-9]{4}(?P<x>[ -])[0-9]{6}(?P=x)[0-9]{5})(?![0-9A-Za-z]))"
    r"|(?P<ssn>(?<![0-9A-Za-z-])[0-9]{3}(?P<s>[ -])[0-9]{2}(?P=s)[0-9]{4}(?![0-9A-Za-z-]))"
    r"|(?P<date>(?<![0-9A-Za-z./-])(?:[0-9]{4}(?P<y>[-/.])[0-9]{1,2}(?P=y)[0-9]{1,2}(?=[Tt][0-9]{2}:?[0-9]{2})"
    r"|(?:[0-9]{4}(?P<z>[-/.])[0-9]{1,2}(?P=z)[0-9]{1,2}|[0-9]{1,2}(?P<d>[-/.])[0-9]{1,2}(?P=d)[0-9]{4}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{2}|[0-9]{2}(?P<e>[-.])[0-9]{2}(?P=e)[0-9]{2})(?![0-9A-Za-z]|[-/][0-9]|\.[0-9]))"
    rf"|(?<![0-9A-Za-z./-])(?=[0-9]|[A-Za-z]{{3}}){re.sub(r'\((?!\?)', '(?:', _WORDED.pattern)}(?![0-9A-Za-z]))"
    r"|(?P<ip>(?<![0-9A-Za-z.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9A-Za-z]|\.[0-9]))"
)


def key_of(spark: SparkSession) -> bytes:
    """The key in the session's setting KEY_SETTING.  Without it a public one, by which anyone can invert the pseudonyms: for tests alone."""
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        warnings.warn(f"{KEY_SETTING} is not set: pseudonyms are made with a public key", stacklevel=2)
    return key.encode() if key else DEMO_KEY


class Cipher:
    """A keyed permutation of range(size) for every kind and size, and one of strings over an alphabet for each place."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, tweak: bytes, r: int, x: int) -> int:
        h = hashlib.blake2b(tweak + b":%d:%d" % (r, x), digest_size=32, key=self.key)
        return int.from_bytes(h.digest(), "big")

    def permute(self, x: int, size: int, tweak: bytes, back: bool = False, ok: Callable[[int], bool] = lambda _: True) -> int:
        """Feistel over pairs of residues modulo a and b with a b >= size, walked until the value is in range and `ok`."""
        if size < 2:
            return x
        a = isqrt(size - 1) + 1
        b = -(-size // a)
        tweak += b"/%d" % size
        while True:
            l, r = divmod(x, b)
            if not back:
                for i in range(ROUNDS):
                    if i % 2:
                        r = (r + self._round(tweak, i, l)) % b
                    else:
                        l = (l + self._round(tweak, i, r)) % a
            else:
                for i in reversed(range(ROUNDS)):
                    if i % 2:
                        r = (r - self._round(tweak, i, l)) % b
                    else:
                        l = (l - self._round(tweak, i, r)) % a
            x = l * b + r
            if x < size and ok(x):
                return x


    def permute_places(self, x: np.ndarray, sizes: np.ndarray, tweak: bytes, back: bool = False) -> np.ndarray:
        """Feistel over the two halves of a string of numbers x[i] in range(sizes[i]), in time linear in its length."""
        cut, x = (len(x) + 1) // 2, x.astype(np.int64)
        halves, bounds = [x[:cut].copy(), x[cut:].copy()], [sizes[:cut], sizes[cut:]]
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            own, other = i % 2, 1 - i % 2
            n = len(halves[own])
            stream = hashlib.shake_256(self.key + b"%d:%d/" % (len(tweak), i) + tweak + halves[other].astype("<i2").tobytes()).digest(8 * n)
            add = (np.frombuffer(stream, "<u8") % bounds[own].astype(np.uint64)).astype(np.int64)
            halves[own] = (halves[own] + (-add if back else add)) % bounds[own]
        return np.concatenate(halves)


def luhn_digit(digits: str) -> str:
    """The check digit of a payload."""
    total = sum(sum(divmod(2 * int(d), 10)) if i % 2 == 0 else int(d) for i, d in enumerate(reversed(digits)))
    return str(-total % 10)


def _mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


def _ssn_ok(x: int) -> bool:
    area, group, serial = x // 1_000_000, x // 10_000 % 100, x % 10_000
    return 0 < area < 900 and area != 666 and group > 0 and serial > 0


def _refill(shape: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


_FIRST = datetime.date(1900, 1, 1)
_DAYS = (datetime.date(2100, 1, 1) - _FIRST).days
_SHORT = range(1969, 2069)  #: the years that two digits stand for


def _at(x: int) -> datetime.date:
    return _FIRST + datetime.timedelta(x)


def _days(y: int, m: int, d: int) -> int | None:
    try:
        x = (datetime.date(y, m, d) - _FIRST).days
    except ValueError:
        return None
    return x if 0 <= x < _DAYS else None


def _ordinal(d: int) -> str:
    return "th" if 10 < d < 14 else {1: "st", 2: "nd", 3: "rd"}.get(d % 10, "th")


def _worded(value: str, cipher: Cipher, back: bool) -> str | None:
    """The pseudonym of a date with the month's name: in the same language, case and order."""
    d1, th1, of, m1, de, y1, m2, gap, d2, th2, comma, y2 = _WORDED.fullmatch(value).groups()
    day, th, name, year = d1 or d2, th1 or th2 or "", m1 or m2, y1 or y2
    first = "de" if th == "." else "es" if "de" in (of or "").lower() else "en"
    order = sorted(MONTHS, key=lambda t: t != first)
    known = lambda n: next((t, MONTHS[t].index(n)) for t in order if n in MONTHS[t])
    table, month = known(_SAME.get(name.lower(), name.lower()))
    x = _days(int(year), month + 1, int(day))
    if x is None:
        return None
    new = _at(cipher.permute(x, _DAYS, b"date", back, lambda y: known(MONTHS[table][_at(y).month - 1])[0] == table))
    out = MONTHS[table][new.month - 1]
    out = out.upper() if name.isupper() else out.capitalize() if name[0].isupper() else out
    if th[1:]:
        th = th if th.lower() == "er" else _ordinal(new.day)
    written = f"{new.day:0{len(day)}d}{th}"
    return f"{written}{of}{out}{de}{new.year:04d}" if d1 else f"{out}{gap}{written}{comma}{new.year:04d}"


def pseudonym(kind: str, value: str, cipher: Cipher, back: bool = False) -> str | None:
    """The pseudonym of a value (back: the value of a pseudonym), or None if it isn't valid."""
    digits = "".join(c for c in value if c in "0123456789")
    if kind == "card":
        body = digits[:-1]
        if luhn_digit(body) != digits[-1] or not digits.strip("0"):
            return None
        new = str(cipher.permute(int(body), 10 ** len(body), b"card%d" % len(body), back)).zfill(len(body))
        return _refill(value, new + luhn_digit(new))
    if kind == "iban":
        shape, value = value, value.replace(" ", "")
        if _mod97(value[4:] + value[:4]) != 1:
            return None
        body, n = value[4:], sum(c.isdigit() for c in value[4:])
        if not n:
            return None
        own = "".join(c for c in body if c.isdigit())
        body = _refill(body, str(cipher.permute(int(own), 10**n, value[:2].encode() + b"iban" + re.sub(r"\d", "0", body).encode(), back)).zfill(n))
        it = iter(value[:2] + str(98 - _mod97(body + value[:2] + "00")).zfill(2) + body)
        return "".join(c if c == " " else next(it) for c in shape)
    if kind == "ssn":
        x = int(digits)
        return _refill(value, str(cipher.permute(x, 10**9, b"ssn", back, _ssn_ok)).zfill(9)) if _ssn_ok(x) else None
    if kind == "phone":
        if value[0] == "+":
            code = re.match(r"\+(\d{1,3})(?=[ .(-])", value)
            n = len(code[1]) if code else 1
        else:
            n = 0
        if not 7 <= len(digits) - n or len(digits) > 15:
            return None
        code, rest = digits[:n] or "1", digits[n:]
        new = str(cipher.permute(int(rest), 10 ** len(rest), b"phone" + code.encode(), back)).zfill(len(rest))
        return _refill(value, digits[:n] + new)
    if kind == "date":
        if any(c.isalpha() for c in value):
            return _worded(value, cipher, back)
        sep = next(c for c in value if not c.isdigit())
        a, b, c = value.split(sep)
        order, short = "ymd" if len(a) == 4 else "dmy", len(a) < 3 and len(c) == 2
        if order == "dmy" and int(b) > 12 >= int(a):
            order = "mdy"
        part = {k: len(v) for k, v in zip(order, (a, b, c))}
        own = {k: int(v) for k, v in zip(order, (a, b, c))}
        x = _days(own["y"] + (0 if not short else 2000 if own["y"] < 69 else 1900), own["m"], own["d"])
        if x is None:
            return None
        # the new date must read back in the same order and century; where the date had one-digit parts they may grow
        ok = lambda y: (order != "mdy" or _at(y).day > 12) and (not short or _at(y).year in _SHORT)
        new = _at(cipher.permute(x, _DAYS, b"date" + (b"-mdy" if order == "mdy" else b""), back, ok))
        got = {"y": f"{new.year % 100:02d}" if short else f"{new.year:04d}", "m": f"{new.month:0{min(part['m'], 2)}d}", "d": f"{new.day:0{min(part['d'], 2)}d}"}
        return sep.join(got[k] for k in order)
    if kind == "ip":
        octets = [int(x) for x in value.split(".")]
        if max(octets) > 255:
            return None
        x = int.from_bytes(bytes(octets), "big")
        return ".".join(map(str, cipher.permute(x, 1 << 32, b"ip", back).to_bytes(4, "big")))
    local, host = value.split("@", 1)
    c = np.frombuffer(local.encode("ascii"), np.uint8).astype(np.int64)
    digit, upper, lower = (c >= 48) & (c < 58), (c >= 65) & (c < 91), (c >= 97) & (c < 123)
    base = np.select([digit, upper, lower], [48, 65, 97], 0)
    at = np.flatnonzero(base)
    if not len(at):
        return None
    shape = np.select([digit, upper | lower], [48, 97], c).astype(np.uint8).tobytes()
    new = cipher.permute_places((c - base)[at], np.where(digit, 10, 26)[at], b"mail" + host.lower().encode() + b"/" + shape, back)
    c[at] = base[at] + new
    return c.astype(np.uint8).tobytes().decode() + "@" + host


def rewriter(key: bytes, back: bool = False) -> Callable[[str], tuple[str, int]]:
    """text -> (text with pseudonyms, number of values)."""
    cipher = Cipher(key)
    kept = lru_cache(1 << 16)(lambda kind, value: pseudonym(kind, value, cipher, back))
    known = lambda kind, value: kept(kind, value) if len(value) < 256 else pseudonym(kind, value, cipher, back)

    def of(text: str) -> tuple[str, int]:
        n, out, done, at = 0, [], 0, 0
        while m := PATTERN.search(text, at):
            kind = next(k for k in ("mail", "iban", "phone", "card", "ssn", "date", "ip") if m[k] is not None)
            new = known(kind, m[0])
            if new is None:  # another value may begin at a later word of what is none
                at = m.end() if " " not in m[0] else m.start() + m[0].index(" ")
                continue
            n += 1
            out += text[done : m.start()], new
            done = at = m.end()
        return "".join([*out, text[done:]]), n

    return of


def _candidates(column: pa.Array) -> np.ndarray:
    """Rows that may hold a value: at least 4 digits (no kind has less), or an @."""
    data, off = raw(column)
    mark = np.zeros(len(data) + 1, np.int64)
    np.cumsum(((data >= 48) & (data <= 57)) | (4 * (data == 64)).astype(np.int64), out=mark[1:])
    return np.flatnonzero(mark[off[1:]] - mark[off[:-1]] >= 4)


def _rewrite(column: pa.Array, of: Callable[[str], tuple[str, int]]) -> tuple[pa.Array, np.ndarray]:
    column = column.cast(pa.large_string())
    at = _candidates(column)
    found = np.zeros(len(column), np.int32)
    if len(at):
        new = []
        for i, text in zip(at, column.take(pa.array(at)).to_pylist()):
            text, found[i] = of(text) if text is not None else (None, 0)
            new.append(text)
        changed = found[at] > 0
        if changed.any():
            mask = np.zeros(len(column), bool)
            mask[at[changed]] = True
            column = pa.compute.replace_with_mask(column, pa.array(mask), pa.array([t for t, c in zip(new, changed) if c], pa.large_string()))
    return column, found


def pseudonyms(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: bytes | None = None) -> DataFrame:
    """(doc_id, text, n_values) of every row: its rewritten text and how many values were replaced.  key: else that of the session (`key_of`)."""
    key = key or key_of(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = rewriter(key)
        for batch in batches:
            for b in pieces(batch, "text"):
                text, found = _rewrite(b.column(1), of)
                yield pa.RecordBatch.from_arrays([b.column(0), text.cast(pa.string()), pa.array(found)], ["doc_id", "text", "n_values"])

    narrow = docs.select(ident(id_col).cast("long").alias("id"), ident(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(lean(run), "doc_id long, text string, n_values int")


def rewrite(docs: DataFrame, text_col: str = "text", key: bytes | None = None, back: bool = False) -> DataFrame:
    """docs, all columns and rows, with pseudonyms in its text (back: with the values again).  key: else that of the session (`key_of`)."""
    key = key or key_of(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = rewriter(key, back)
        for batch in batches:
            for b in pieces(batch, batch.schema.names[at]):
                text, _ = _rewrite(b.column(at), of)
                columns = list(b.columns)
                columns[at] = text.cast(pa.string())
                yield pa.RecordBatch.from_arrays(columns, b.schema.names)

    return map_rows(docs, run)
