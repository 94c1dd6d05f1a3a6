"""Format-preserving pseudonyms for personal numbers, dates and addresses."""

from __future__ import annotations

import datetime as dt
import hashlib
import math
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import all_but, load

ROUNDS = 8
FIRST_DAY, LAST_DAY = dt.date(1900, 1, 1).toordinal(), dt.date(2099, 12, 31).toordinal()
DIGITS, LETTERS, HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef"

PATTERN = re.compile(
    r"(?P<email>(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)"
    r"|(?=[0-9A-Fa-f]{32})(?P<secret>(?<![0-9A-Za-z])(?:[0-9a-f]{40}|[0-9A-F]{40})(?![0-9A-Za-z]))"
    r"|(?=[0-9A-Fa-f]{32})(?P<hexkey>(?<![0-9A-Za-z])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![0-9A-Za-z]))"
    r"|(?=AKIA|gh[opsu]_|sk[_-]|xox)(?P<token>(?<![0-9A-Za-z_-])(?:AKIA[0-9A-Z]{16}|gh[opsu]_[0-9A-Za-z]{36,}|sk[_-][0-9A-Za-z_-]{20,}|xox[abprs]-[0-9A-Za-z-]{20,})(?![0-9A-Za-z_-]))"
    r"|(?=[A-Z]{2}\d)(?P<iban>(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z]))"
    r"|(?=[\d+(])(?:(?P<ip>(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d.]*\d))"
    r"|(?P<date>(?<!\d)(?:19|20)\d\d-\d\d-\d\d(?!\d))"
    r"|(?P<day>(?<![\d./])(?:\d{1,2}(?P<sep>[./])\d{1,2}(?P=sep)(?:19|20)\d\d|(?:19|20)\d\d(?P<gap>[./])\d\d(?P=gap)\d\d)(?![./]?\d))"
    r"|(?P<phone>(?<![\d+])\+\d{1,3} ?\(\d{3}\) ?\d{3}-\d{4}(?!\d))"
    r"|(?P<abroad>(?<![\d+])\+[1-9]\d{0,2}(?:[ .-]?\(?\d+\)?)+(?!\d))"
    r"|(?P<local>(?<![\d+.-])(?:\([2-9]\d\d\) ?|[2-9]\d\d[ .-])\d{3}[ .-]\d{4}(?![.-]?\d))"
    r"|(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))"
    r"|(?P<card>(?<!\d)\d(?:[ -]?\d){12,}(?!\d)))"
)
#: The same without cards, for the parts of a run of digits that are no card.
OTHER = re.compile(PATTERN.pattern[:PATTERN.pattern.rindex("|(?P<card>")] + ")")
#: Lengths of card numbers by issuer, for spans inside a longer run of digits.
ISSUERS = [(re.compile(r"4"), (13, 16, 19)), (re.compile(r"5[0-9]|2[2-7]|6"), range(13, 20)), (re.compile(r"3[47]"), (15,)),
           (re.compile(r"35"), range(16, 20)), (re.compile(r"3[0689]"), range(14, 20))]


def permute(value: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of range(size): a Feistel network over a square domain, walked until inside."""
    side = math.isqrt(size - 1) + 1
    width = 16 if side <= 2 ** 128 else 64
    while True:
        left, right = divmod(value, side)
        for i in range(ROUNDS):
            digest = hashlib.blake2b(f"{tweak}|{i}|{right}".encode(), key=key, digest_size=width).digest()
            left, right = right, (left + int.from_bytes(digest, "big")) % side
        value = left * side + right
        if value < size:
            return value


def permute_text(text: str, alphabet: str, key: bytes, tweak: str) -> str:
    """Permute a string over its alphabet, length kept."""
    base, value = len(alphabet), 0
    for ch in text:
        value = value * base + alphabet.index(ch)
    value = permute(value, base ** len(text), key, f"{tweak}{len(text)}")
    out = []
    for _ in text:
        value, at = divmod(value, base)
        out.append(alphabet[at])
    return "".join(reversed(out))


def permute_class(text: str, members: str, alphabet: str, key: bytes, tweak: str) -> str:
    """Permute only the characters among `members` (compared in lower case); case and all others stay."""
    places = [i for i, ch in enumerate(text) if ch.lower() in members and ch.isascii()]
    if not places:
        return text
    new = permute_text("".join(text[i].lower() for i in places), alphabet, key, tweak)
    out = list(text)
    for i, ch in zip(places, new):
        out[i] = ch.upper() if text[i].isupper() else ch
    return "".join(out)


def luhn_digit(body: str) -> str:
    total = 0
    for i, ch in enumerate(reversed(body)):
        d = int(ch) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def card_spans(text: str) -> list[tuple[int, int]]:
    """The valid cards in a run of digit groups: the whole run, else from the left the longest spans of an issuer's form."""
    groups = [(m.start(), m.end()) for m in re.finditer(r"\d+", text)]

    def valid(i, j):
        digits = "".join(ch for ch in text[groups[i][0]:groups[j][1]] if ch.isdigit())
        return 13 <= len(digits) <= 19 and luhn_digit(digits[:-1]) == digits[-1] and digits

    if valid(0, len(groups) - 1):
        return [(0, len(text))]
    out, i = [], 0
    while i < len(groups):
        for j in range(min(len(groups), i + 19) - 1, i - 1, -1):
            digits = groups[j][1] - groups[i][0] <= 37 and valid(i, j)
            if digits and any(p.match(digits) and len(digits) in sizes for p, sizes in ISSUERS):
                out.append((groups[i][0], groups[j][1]))
                i = j
                break
        i += 1
    return out


def _new_day(text: str, key: bytes) -> str | None:
    """A date as M/D/Y, else D/M/Y, D.M.Y or Y/M/D; order and digits of the parts stay."""
    sep = "/" if "/" in text else "."
    parts = text.split(sep)
    orders = ["ymd"] if len(parts[0]) == 4 else ["mdy", "dmy"] if sep == "/" else ["dmy", "mdy"]
    for order in orders:
        at = dict(zip(order, parts))
        try:
            day = dt.date(int(at["y"]), int(at["m"]), int(at["d"])).toordinal()
        except ValueError:
            continue
        new = dt.date.fromordinal(FIRST_DAY + permute(day - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, key, "date"))
        padded = len(text) == 10
        return sep.join(str(v).zfill(2 if padded else 1) for v in ({"y": new.year, "m": new.month, "d": new.day}[c] for c in order))
    return None


def new_ssn(text: str, key: bytes) -> str:
    """The next valid number on the walk: area not 000, 666 or 9xx, group not 00, serial not 0000."""
    value = int(text.replace("-", ""))
    while True:
        value = permute(value, 10 ** 9, key, "ssn")
        area, group, serial = value // 10 ** 6, value // 10 ** 4 % 100, value % 10 ** 4
        if area not in (0, 666) and area < 900 and group and serial:
            return f"{area:03}-{group:02}-{serial:04}"


def iban_check(country: str, account: str) -> str:
    """The two check digits that make the rest 1 modulo 97."""
    number = "".join(str(int(ch, 36)) for ch in account + country + "00")
    return f"{98 - int(number) % 97:02}"


def new_iban(text: str, key: bytes) -> str | None:
    """An account number with permuted digits and new check digits; letters and spaces stay."""
    compact = text.replace(" ", "")
    if not 15 <= len(compact) <= 34 or iban_check(compact[:2], compact[4:]) != compact[2:4]:
        return None
    account = permute_class(text[4:], DIGITS, DIGITS, key, "iban")
    return text[:2] + iban_check(text[:2], account.replace(" ", "")) + account


def pseudonym(kind: str, text: str, key: bytes) -> str | None:
    """The replacement of one value; None where the value is not valid for its kind."""
    if kind == "email":
        local, _, domain = text.partition("@")
        changed = permute_class(local, LETTERS, LETTERS, key, "email-letters")
        return permute_class(changed, DIGITS, DIGITS, key, "email-digits") + "@" + domain
    if kind in ("secret", "hexkey"):
        if kind == "hexkey" and (text.isdigit() or text.isalpha()):
            return None
        new = permute_class(text, HEX, HEX, key, "secret")
        return new.upper() if text.isupper() else new.lower()
    if kind == "token":
        at = 4 if text[:4] == "AKIA" or text[:2] == "gh" else re.match(r"sk[_-]|xox.-", text).end()
        if text[:2] == "sk" and not (any(ch.isdigit() for ch in text) and any(ch.isalpha() for ch in text[3:])):
            return None
        changed = permute_class(text[at:], LETTERS, LETTERS, key, "token-letters")
        return text[:at] + permute_class(changed, DIGITS, DIGITS, key, "token-digits")
    if kind == "ip":
        parts = [int(p) for p in text.split(".")]
        if any(p > 255 for p in parts):
            return None
        value = permute(int.from_bytes(bytes(parts), "big"), 2 ** 32, key, "ip")
        return ".".join(str(b) for b in value.to_bytes(4, "big"))
    if kind == "date":
        try:
            day = dt.date.fromisoformat(text).toordinal()
        except ValueError:
            return None
        return dt.date.fromordinal(FIRST_DAY + permute(day - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, key, "date")).isoformat()
    if kind == "day":
        return _new_day(text, key)
    if kind == "abroad":
        if not 8 <= sum(ch.isdigit() for ch in text) <= 15:
            return None
        at = re.match(r"\+\d{1,3}(?=\D)|\+\d", text).end()
        return text[:at] + permute_class(text[at:], DIGITS, DIGITS, key, "phone")
    if kind == "local":
        digits = "".join(ch for ch in text if ch.isdigit())
        fresh = iter(str(permute(int(digits) - 2 * 10 ** 9, 8 * 10 ** 9, key, "local-phone") + 2 * 10 ** 9))
        return "".join(next(fresh) if ch.isdigit() else ch for ch in text)
    if kind == "phone":
        at = text.index("(")
        return text[:at] + permute_class(text[at:], DIGITS, DIGITS, key, "phone")
    if kind == "ssn":
        if text[:3] in ("000", "666") or text[0] == "9" or text[4:6] == "00" or text[7:] == "0000":
            return None
        return new_ssn(text, key)
    if kind == "iban":
        return new_iban(text, key)
    digits = "".join(ch for ch in text if ch.isdigit())
    if luhn_digit(digits[:-1]) != digits[-1]:
        return None
    body = permute_text(digits[:-1], DIGITS, key, "card")
    fresh = iter(body + luhn_digit(body))
    return "".join(next(fresh) if ch.isdigit() else ch for ch in text)


def mask_text(text: str | None, key: bytes) -> tuple[str | None, int]:
    """The text with every valid value replaced, and their count."""
    if text is None:
        return None, 0
    found = 0

    def swap(m):
        nonlocal found
        kind, text = m.lastgroup, m.group()
        if kind == "abroad" and pseudonym(kind, text, key) is None:
            at = re.match(r"\+\d+", text).end()  # a shorter number, then what follows it
            for cut in [c.start() for c in re.finditer(r"(?<=[\d)])[ .-]", text)][::-1]:
                new = pseudonym(kind, text[:cut], key) if cut > at else None
                if new is not None:
                    found += 1
                    return new + PATTERN.sub(swap, text[cut:])
            return text[:1] + PATTERN.sub(swap, text[1:])
        if kind == "iban" and pseudonym(kind, text, key) is None:
            return text[:2] + PATTERN.sub(swap, text[2:])
        if kind == "card":
            out, last = [], 0
            for start, end in card_spans(text):
                out += [OTHER.sub(swap, text[last:start]), pseudonym(kind, text[start:end], key)]
                found, last = found + 1, end
            return "".join(out) + OTHER.sub(swap, text[last:])
        new = pseudonym(kind, text, key)
        found += new is not None
        return text if new is None else new

    return PATTERN.sub(swap, text), found


#: For queries on test tables only. Anyone can undo a permutation under a published key.
TEST_KEY = b"change-me"


def session_key(spark, default: bytes | None = None) -> bytes:
    """The secret of spark.fusionframe.pseudonymKey; where it is unset, `default`, or an error without one."""
    secret = spark.conf.get("spark.fusionframe.pseudonymKey", None)
    if not secret and default is None:
        raise ValueError("set spark.fusionframe.pseudonymKey to a secret of your own")
    return secret.encode("utf-8") if secret else default


def pseudonymize(docs: DataFrame, key: bytes) -> DataFrame:
    """Replace `text` and add `pii_found`, in place of any column of that name; every other column and row stays.

    Equal values get equal pseudonyms in all documents under one key. Null texts stay null, with 0 found.
    """
    @F.pandas_udf("text string, found long")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([mask_text(t, key) for t in texts], columns=["text", "found"])

    order = [F.col("_p.text").alias("text") if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns if c.lower() != "pii_found"]
    packed = docs.select(F.struct(*all_but(docs, "pii_found")).alias("_row"), run("text").alias("_p"))
    return packed.select(*order, F.col("_p.found").alias("pii_found"))


def op7_pseudonyms(spark, sf_dir) -> DataFrame:
    """All documents with pseudonyms for personal values; on test tables, where no key is set, a published one."""
    return pseudonymize(load(spark, sf_dir, "documents").select("doc_id", "text"), session_key(spark, TEST_KEY))
