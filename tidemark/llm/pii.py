"""Personal data: regular expressions propose spans, checksums confirm them, words nearby move the score.

Kinds email, ip, card and phone come from the base rules and always stay. The method adds iban (as long as its country's
are, confirmed by mod-97), national_id (nine digits in groups of 3-2-4, confirmed by its number ranges) and secret (a
private key, a token that begins as a known issuer's do, a run of 20 or more key characters, confirmed by its mix and
entropy, or a value that the name of a password or key is set to by `=` or `:`). A proposed span starts from its kind's score, nearby context words raise it and words of other use before it
lower it, and it is added at `threshold` or more unless it overlaps a span that is there. Base spans get a score too,
which only informs.

Every pattern runs in time linear in the text: runs are taken whole, so no start inside a run is tried again.

Defined cases: null text is empty; a text without spans has an empty string of spans; offsets count code points, the end
exclusive; every row gives a row, whatever its id; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "national_id", "secret")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])([A-Z]{2})[0-9]{2}")
_IBAN_REST = {n: re.compile(rf"(?:\x20?[A-Z0-9]{{4}}){{{n // 4 - 1}}}" + rf"(?:\x20?[A-Z0-9]{{{n % 4}}})" * (n % 4 > 0) + r"(?![A-Za-z0-9])") for n in range(15, 35)}
# Lengths of account numbers by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22,
    "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22,
    "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30,
    "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27,
    "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31,
    "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24,
    "XK": 20,
}
_NATIONAL = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
_RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}")
_KEY_BEGIN = re.compile(r"-----BEGIN (?:[A-Z]++ ){0,3}?PRIVATE KEY-----")
# How tokens of known issuers begin.
_ISSUED = ("AKIA", "ASIA", "AIza", "ghp_", "gho_", "ghs_", "github_pat_", "glpat-", "sk_live_", "rk_live_", "sk-", "xoxb-", "xoxp-", "eyJ")
_ENTROPY = 3.0
_SETS = re.compile(r"[=:]")
#: A value ends before another sign that sets one, so that every character is looked at for one sign only.
_VALUE = re.compile(r"[=>]{0,2}[\x20\t]{0,3}[\"']?([^\s\"'<>,;=:]{6,}+={0,2})")
_AFTER_NAME = r"(?:[_-][A-Za-z0-9_-]{0,24})?[\"']?[\x20\t]{0,3}\Z"
#: Names whose value may be short, and names whose value has to look like a key.
_PASSWORD_NAME = re.compile(r"(?:password|passwd|passphrase|pwd|passwort|kennwort|contraseña|mot[\x20_-]de[\x20_-]passe)" + _AFTER_NAME, re.I)
_KEY_NAME = re.compile(r"(?:secret|token|(?<![a-z])key|apikey|credentials?|secreto|clave|clé|jeton|schlüssel)" + _AFTER_NAME, re.I)
_NAME_REACH, _KEY_VALUE = 64, 16
_DIGIT = re.compile(r"[0-9]")
_LETTER = re.compile(r"[A-Za-z]")
_WORD = re.compile(r"[^\W\d_]+")

#: Start score of each kind, and what a context word adds or takes.
_START = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.8, "national_id": 0.4, "secret": 0.4}
_BONUS, _MALUS, _NEAR = 0.3, 0.3, 48
#: What a known issuer's beginning and a name before the value add.
_ISSUER_BONUS, _NAME_BONUS = 0.4, 0.2
#: Context words in English, French, German and Spanish.
_FOR = {
    "email": set("email mail contact write courriel contactez kontakt correo contacto".split()),
    "ip": set("ip address server host adresse serveur dirección servidor".split()),
    "card": set("card credit visa payment debit carte paiement kreditkarte karte zahlung tarjeta pago".split()),
    "phone": set("phone tel call mobile fax téléphone appelez telefon anruf handy teléfono móvil llame".split()),
    "iban": set("iban bank account transfer banque compte virement konto überweisung banco cuenta transferencia".split()),
    "national_id": set("ssn social security id taxpayer sécurité sozialversicherung seguridad".split()),
    "secret": set(
        "token secret password passwd pwd key apikey auth bearer credential credentials passe jeton clé "
        "passwort kennwort schlüssel geheim contraseña clave secreto".split()
    ),
}
_AGAINST = set(
    "version order invoice isbn tracking part serial sku commande facture bestellung rechnung seriennummer versión pedido factura".split()
)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(code: str) -> bool:
    """ISO 7064 mod-97: four characters to the end, letters as 10 to 35, remainder one."""
    turned = code[4:] + code[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", done)


def _base(text: str) -> dict[str, list[tuple[int, int]]]:
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in BASE_KINDS}
    if "@" in text:
        out["email"] = list(_emails(text))
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        # Leading zeros aside, over three digits are over 255.
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out["ip"].append(m.span())
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 37:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out["card"].append(m.span())
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                out["phone"].append(m.span())
    return out


def entropy(run: str) -> float:
    """Bits a character, by the run's own frequencies."""
    return -sum(n / len(run) * math.log2(n / len(run)) for n in Counter(run).values())


def is_key(run: str) -> bool:
    """Letters and digits in turn and nothing that repeats much: no word, number or path of words."""
    changes = sum(a.isdigit() != b.isdigit() for a, b in zip(run, run[1:], strict=False))
    return changes >= max(4, len(run) // 10) and entropy(run) >= _ENTROPY


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    for m in _IBAN.finditer(text):
        if (n := IBAN_LENGTHS.get(m[1])) and (rest := _IBAN_REST[n].match(text, m.end())):
            if mod97(text[m.start() : rest.end()].replace(" ", "")):
                yield m.start(), rest.end()


def _nationals(text: str) -> Iterator[tuple[int, int]]:
    for m in _NATIONAL.finditer(text):
        if m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000":
            yield m.span()


def _secrets(text: str) -> Iterator[tuple[int, int, float]]:
    """(start, end, what is added to the score)."""
    for m in _KEY_BEGIN.finditer(text):
        yield *m.span(), 1.0
    for m in _RUN.finditer(text):
        issued = m[0].startswith(_ISSUED)
        if is_key(m[0]) or issued and any(map(str.isdigit, m[0])) and entropy(m[0]) >= _ENTROPY:
            yield *m.span(), _ISSUER_BONUS * issued


def _named_secrets(text: str) -> Iterator[tuple[int, int, float]]:
    """(start, end, what is added to the score) of values with letters and digits that a password or key is set to."""
    for m in _SETS.finditer(text):
        if not (value := _VALUE.match(text, m.end())):
            continue
        found = value[1].rstrip(".!?)]}")
        if len(found) < 6 or not _DIGIT.search(found) or not _LETTER.search(found):
            continue
        name = text[max(0, m.start() - _NAME_REACH) : m.start()]
        long = len(found) >= _KEY_VALUE and entropy(found) >= _ENTROPY
        if _PASSWORD_NAME.search(name) or long and _KEY_NAME.search(name):
            yield value.start(1), value.start(1) + len(found), _NAME_BONUS


def _score(text: str, kind: str, start: int, end: int) -> float:
    before = set(_WORD.findall(text[max(0, start - _NEAR) : start].lower()))
    near = before.union(_WORD.findall(text[end : end + _NEAR].lower()))
    return _START[kind] + _BONUS * bool(near & _FOR[kind]) - _MALUS * bool(before & _AGAINST)


def _bounded(score: float) -> float:
    return round(min(1.0, max(0.0, score)), 2)


class Taken:
    """Places that spans hold, as disjoint intervals in order."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for s, e in sorted(spans):
            if self.ends and s < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], e)
            else:
                self.starts.append(s)
                self.ends.append(e)

    def add(self, start: int, end: int) -> bool:
        """Take a place, unless it overlaps one."""
        at = bisect_left(self.starts, end)
        if at and self.ends[at - 1] > start:
            return False
        self.starts.insert(at, start)
        self.ends.insert(at, end)
        return True


def find_spans(text: str, threshold: float = 0.6) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by kind as in KINDS, then start."""
    base = _base(text)
    out = [(k, s, e, _bounded(_score(text, k, s, e))) for k in BASE_KINDS for s, e in base[k]]
    more: list[tuple[str, int, int, float]] = []
    if _DIGIT.search(text):
        more += [("iban", s, e, 0.0) for s, e in _ibans(text)] + [("national_id", s, e, 0.0) for s, e in _nationals(text)]
    # Of those that begin alike the longest, then the one that is surest.
    secrets = sorted([*_secrets(text), *_named_secrets(text)], key=lambda x: (x[0], -x[1], -x[2]))
    more += [("secret", *x) for x in secrets]
    taken = Taken([(s, e) for _, s, e, _ in out])
    for kind, s, e, extra in more:
        score = _bounded(_score(text, kind, s, e) + extra)
        if score >= threshold and taken.add(s, e):
            out.append((kind, s, e, score))
    return out


def detect(docs: DataFrame, threshold: float = 0.6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans) of every row, spans an array of (kind, start, end, score)."""

    def make():
        return lambda doc_id, text: (
            (doc_id, [dict(zip(("kind", "start", "end", "score"), x, strict=True)) for x in find_spans(text, threshold)]),
        )

    columns = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )
    schema = "doc_id long, spans array<struct<kind: string, start: int, end: int, score: double>>"
    return map_rows(columns, make, schema)


def redact(text: str, spans: list[tuple[str, int, int, float]]) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans by the first of them."""
    out, at = [], 0
    for kind, s, e, _ in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
            at = e
    return "".join([*out, text[at:]])


def digest(docs: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Counts of the base kinds, a hash of the base spans, all spans as a string, and counts of added kinds and of all."""
    found = detect(docs, threshold)

    def of(*kinds: str):
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    return found.select(
        "doc_id",
        *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(joined(of(*BASE_KINDS)), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS if k not in BASE_KINDS],
        F.size("spans").cast("long").alias("n_spans"),
    )


def base_digest_of(text: str) -> tuple[list[int], str]:
    """What `digest` says of one text: counts and hash."""
    base = _base(text)
    line = ",".join(f"{k}:{s}:{e}" for k in BASE_KINDS for s, e in base[k])
    return [len(base[k]) for k in BASE_KINDS], hashlib.sha256(line.encode()).hexdigest()
