"""Format-preserving pseudonyms by a keyed Feistel network.

Validated numbers, dates, addresses and secrets are replaced by others of the same format: a card
number by one that also passes its checksum, a date by a date in the same layout. Under one key
the replacement is a permutation of each format, so equal values stay equal in every document,
different ones stay different, and only the holder of the key can undo it.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import date, timedelta
from functools import lru_cache
from hashlib import blake2b
from ipaddress import IPv4Address

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: For tests and trials. A production run passes a secret of its own.
TRIAL_KEY = b"trial key, replace in production"
ROUNDS = 10
#: The alphabets of which a character keeps its own.
ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "àáâãäåæçèéêëìíîïñòóôõöøùúûüýÿßœ", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝŒ")
HEX = ("0123456789abcdef", "0123456789ABCDEF")
FIRST_DAY, DAYS = date(1900, 1, 1), 73_049


def feistel(left: int, right: int, a: int, b: int, key: bytes, tweak: str, undo: bool = False) -> tuple[int, int]:
    """A keyed permutation of the pairs in [0, a) x [0, b)."""

    def f(i: int, half: int) -> int:
        return int.from_bytes(blake2b(f"{tweak}|{i}|{half}".encode(), key=key[:64], digest_size=64).digest(), "big")

    for i in reversed(range(ROUNDS)) if undo else range(ROUNDS):
        if i % 2 == 0:
            left = (left + (-1 if undo else 1) * f(i, right)) % a
        else:
            right = (right + (-1 if undo else 1) * f(i, left)) % b
    return left, right


def permute_below(value: int, n: int, key: bytes, tweak: str, undo: bool = False) -> int:
    """A keyed permutation of [0, n): a square of at least n numbers, walked until one is below n."""
    side = max(1, int(n**0.5))
    while side * side < n:
        side += 1
    while True:
        left, right = feistel(value // side, value % side, side, side, key, tweak, undo)
        value = left * side + right
        if value < n:
            return value


def permute_characters(text: str, key: bytes, tweak: str, alphabets: tuple[str, ...] = ALPHABETS, undo: bool = False) -> str:
    """A keyed permutation of the strings with text's pattern: each character that is in an alphabet
    gets another (or the same) of that alphabet, all others stay."""
    own = [(i, next((x for x in alphabets if c in x), "")) for i, c in enumerate(text)]
    own = [(i, x) for i, x in own if x]
    halves, sizes = [], []
    for part in (own[: len(own) // 2], own[len(own) // 2 :]):
        value, size = 0, 1
        for i, x in part:
            value, size = value * len(x) + x.index(text[i]), size * len(x)
        halves.append(value)
        sizes.append(size)
    pattern = "".join(str(alphabets.index(x)) for _, x in own)
    halves = list(feistel(*halves, *sizes, key, f"{tweak}|{pattern}", undo))
    out = list(text)
    for value, part in zip(halves, (own[: len(own) // 2], own[len(own) // 2 :]), strict=True):
        for i, x in reversed(part):
            value, r = divmod(value, len(x))
            out[i] = x[r]
    return "".join(out)


def luhn(digits: str) -> int:
    """The digit that completes digits to a number with a valid checksum."""
    total = sum(d if i % 2 else (2 * d - 9 * (d > 4)) for i, d in enumerate(map(int, reversed(digits))))
    return -total % 10


def refill(pattern: str, digits: str) -> str:
    """pattern with its digits replaced by those of digits, in order."""
    own = iter(digits)
    return re.sub("[0-9]", lambda _: next(own), pattern)


def card(value: str, key: bytes, undo: bool) -> str | None:
    """13 to 19 digits with a valid Luhn digit; the first digit, which tells the scheme, stays."""
    digits = re.sub("[^0-9]", "", value)
    if luhn(digits[:-1]) != int(digits[-1]) or len(set(digits)) == 1:
        return None
    body = digits[0] + permute_characters(digits[1:-1], key, f"card{digits[0]}", undo=undo)
    return refill(value, body + str(luhn(body)))


def iban(value: str, key: bytes, undo: bool) -> str | None:
    """A valid IBAN in either case; country and letters stay, the check digits follow."""
    own = value.replace(" ", "").upper()
    number = lambda x: int("".join(str(int(c, 36)) for c in x))
    if not 15 <= len(own) <= 34 or number(own[4:] + own[:4]) % 97 != 1:
        return None
    rest = permute_characters(own[4:], key, "iban" + own[:2], ALPHABETS[:1], undo)
    check = 98 - number(rest + own[:2] + "00") % 97
    out = iter(f"{own[:2]}{check:02d}{rest}")
    return "".join(c if c == " " else next(out).lower() if c.islower() else next(out) for c in value)


def phone(value: str, key: bytes, undo: bool) -> str | None:
    """A number of 8 to 15 digits; a country code after + stays, and so does a leading 0."""
    code = re.match(r"\+(?:1|[0-9]+)", value)
    code = code[0] if code and len(code[0]) <= 4 else "+" if code else "0" if value[0] == "0" else ""
    digits = re.sub("[^0-9]", "", value[len(code) :])
    if not 8 <= len(digits) + len(code) - (code[:1] == "+") <= 15 or len(digits) < 6:
        return None
    return code + refill(value[len(code) :], permute_characters(digits, key, "phone" + code, undo=undo))


def ssn(value: str, key: bytes, undo: bool) -> str | None:
    """Area 001 to 899 but 666, group 01 to 99, serial 0001 to 9999."""
    area, group, serial = map(int, value.split("-"))
    if not (0 < area < 900 and area != 666 and group and serial):
        return None
    n = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    n = permute_below(n, 898 * 99 * 9999, key, "ssn", undo)
    area = n // (99 * 9999) + 1
    return f"{area + (area >= 666):03d}-{n // 9999 % 99 + 1:02d}-{n % 9999 + 1:04d}"


def ipv4(value: str, key: bytes, undo: bool) -> str | None:
    """Four numbers of at most 255 without leading zeros."""
    parts = value.split(".")
    if any(int(x) > 255 or (len(x) > 1 and x[0] == "0") for x in parts):
        return None
    return str(IPv4Address(permute_below(int(IPv4Address(value)), 1 << 32, key, "ipv4", undo)))


def day(value: str, key: bytes, undo: bool) -> str | None:
    """A calendar date from 1900 to 2099, year first or last; a date that fits both orders is read
    day first. Equal dates in different layouts get equal pseudonyms; days up to 12 stay such, so that
    a pseudonym is read in the order of its date. Where a day or month has one digit, so it has in the
    pseudonym, and two digits stay two; such dates are linked among themselves. A time stays."""
    sep = next(c for c in value if not c.isdigit())
    parts = value.split(sep)
    orders = ((0, 1, 2),) if len(parts[0]) == 4 else ((2, 1, 0), (2, 0, 1))
    padded = all(len(x) != 1 for x in parts)
    for order in orders:
        y, m, d = (int(parts[i]) for i in order)
        try:
            n = (date(y, m, d) - FIRST_DAY).days
        except ValueError:
            continue
        if not 0 <= n < DAYS:
            continue
        while True:
            n = permute_below(n, DAYS, key, "date" if padded else "short date", undo)
            new = FIRST_DAY + timedelta(n)
            # Without leading zeros the numbers of digits stay as well.
            if (new.day > 12) == (d > 12) and (padded or ((new.day > 9) == (d > 9) and (new.month > 9) == (m > 9))):
                break
        out = [""] * 3
        for i, x in zip(order, (new.year, new.month, new.day), strict=True):
            out[i] = f"{x:0{len(parts[i])}d}"
        return sep.join(out)
    return None


def email(value: str, key: bytes, undo: bool) -> str | None:
    """The part before @; the domain stays."""
    local, _, domain = value.rpartition("@")
    return permute_characters(local, key, "email@" + domain.lower(), undo=undo) + "@" + domain


def secret(value: str, key: bytes, undo: bool) -> str | None:
    """A key with letters and digits; hexadecimal ones stay hexadecimal, known beginnings, the beginnings of
    a token's parts and the frame of a key block stay."""
    if value.startswith("-----"):
        head, body, end = re.match(r"(-----[^-]+-----)(.*)(-----END.*)", value, re.S).groups()
        return head + permute_characters(body, key, "pem", undo=undo) + end
    if value.startswith("eyJ"):
        return ".".join("eyJ" * x.startswith("eyJ") + permute_characters(x.removeprefix("eyJ"), key, "token", undo=undo) for x in value.split("."))
    if not (re.search("[0-9]", value) and re.search("[A-Za-z]", value)):
        return None
    head = re.match(r"AKIA|gh[opsu]_|sk-|xox[abp]-", value)
    head = head[0] if head else ""
    body = value[len(head) :]
    for x in HEX:
        if all(c in x for c in body):
            return head + permute_characters(body, key, "hex", (x,), undo)
    return head + permute_characters(body, key, "secret", undo=undo)


KINDS: dict[str, Callable[[str, bytes, bool], str | None]] = {"email": email, "iban": iban, "secret": secret, "date": day, "ssn": ssn, "ipv4": ipv4, "card": card, "phone": phone}
#: What each kind looks like before it is validated, the first that fits counting.
PATTERN = re.compile(
    r"(?P<email>(?<![\w.%+-])[\w.%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?![\w-]))"
    r"|(?P<iban>(?<!\w)(?:[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?|[a-z]{2}[0-9]{2}(?: ?[a-z0-9]{4}){2,7}(?: ?[a-z0-9]{1,3})?)(?!\w))"
    r"|(?P<secret>-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]{0,20}PRIVATE KEY-----"
    r"|(?<!\w)eyJ[\w-]{8,}\.eyJ[\w-]{8,}\.[\w-]{8,}(?![\w-])|(?<!\w)(?:[0-9a-f]{32,128}|[0-9A-F]{32,128}|AKIA[0-9A-Z]{16}|gh[opsu]_[0-9A-Za-z]{36,}|sk-[0-9A-Za-z_-]{20,}|xox[abp]-[0-9A-Za-z-]{10,})(?!\w))"
    r"|(?P<date>(?<![\w./-])(?:[0-9]{4}([-/.])[0-9]{1,2}\5[0-9]{1,2}|[0-9]{1,2}([-/.])[0-9]{1,2}\6[0-9]{4})(?=T[0-9]{2}:?[0-9]{2}|(?!\w|[-/.][0-9])))"
    r"|(?P<ssn>(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-]))"
    r"|(?P<ipv4>(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\w|\.[0-9]))"
    r"|(?P<card>(?<![\w+])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\10[0-9]{4}\10[0-9]{1,7}|[0-9]{4}([ -])[0-9]{6}\11[0-9]{5})(?!\w))"
    r"|(?P<phone>(?<![\w+])(?:\+1[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}|\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}|0[1-9][0-9]{1,3}[ /-][0-9]{5,9}|\+[2-9][0-9]{0,2}(?:[ .-]?\(?[0-9]{1,5}\)?){2,6})(?!\w))"
)
MAY_HAVE = re.compile("[0-9@]|-----BEGIN")


def pseudonyms(text: str | None, key: bytes = TRIAL_KEY, undo: bool = False, memo: Callable | None = None) -> tuple[str | None, dict[str, int]]:
    """The text with its values replaced, and how many of each kind; a null text stays null."""
    found: dict[str, int] = {}
    if text is None or not MAY_HAVE.search(text):
        return text, found
    memo = memo or (lambda kind, value: KINDS[kind](value, key, undo))

    def replace(m: re.Match) -> str:
        kind = next(k for k in KINDS if m[k] is not None)
        new = memo(kind, m[0])
        if new is None:
            return m[0]
        found[kind] = found.get(kind, 0) + 1
        return new

    return PATTERN.sub(replace, text), found


def column(text: str = "text", key: bytes = TRIAL_KEY):
    """A column of struct<text, found map<string, int>>."""

    @F.pandas_udf("text string, found map<string, int>")
    def run(texts: pd.Series) -> pd.DataFrame:
        memo = lru_cache(100_000)(lambda kind, value: KINDS[kind](value, key, False))
        out = [pseudonyms(t, key, memo=memo) for t in texts]
        return pd.DataFrame(out, columns=["text", "found"])

    return run(F.col(text))


def pseudonymised(docs: DataFrame, key: bytes = TRIAL_KEY) -> DataFrame:
    """One row (doc_id, text, n_found, found) for each row of docs(doc_id, text, ...).

    found counts the values replaced by kind. A null text stays null, a text without such values is
    unchanged, numbers that fail their validation stay. Texts of any length are read whole. Repeated
    rows come back as often as they came; other columns are ignored.
    """
    out = docs.select("doc_id", column(key=key).alias("__p"))
    n = F.aggregate(F.map_values("__p.found"), F.lit(0), lambda a, x: a + x)
    return out.select("doc_id", "__p.text", n.alias("n_found"), "__p.found")


def replaced(docs: DataFrame, key: bytes = TRIAL_KEY) -> DataFrame:
    """docs with text, and n_chars where it is there, replaced."""
    out = docs.withColumn("text", column(key=key)["text"])
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out
