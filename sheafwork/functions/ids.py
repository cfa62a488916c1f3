"""Identifier rules as SQL expressions: candidate patterns, checksums, issuer ranges.

Candidates are cut out of the text by one array expression and exploded; the checks then run as plain
generated code over short strings. Everything is built as SQL text, so a scan costs the driver a few
calls and stays in the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass

# Published check-digit tables.
VERHOEFF_D = (
    (0, 1, 2, 3, 4, 5, 6, 7, 8, 9),
    (1, 2, 3, 4, 0, 6, 7, 8, 9, 5),
    (2, 3, 4, 0, 1, 7, 8, 9, 5, 6),
    (3, 4, 0, 1, 2, 8, 9, 5, 6, 7),
    (4, 0, 1, 2, 3, 9, 5, 6, 7, 8),
    (5, 9, 8, 7, 6, 0, 4, 3, 2, 1),
    (6, 5, 9, 8, 7, 1, 0, 4, 3, 2),
    (7, 6, 5, 9, 8, 2, 1, 0, 4, 3),
    (8, 7, 6, 5, 9, 3, 2, 1, 0, 4),
    (9, 8, 7, 6, 5, 4, 3, 2, 1, 0),
)
VERHOEFF_P = (
    (0, 1, 2, 3, 4, 5, 6, 7, 8, 9),
    (1, 5, 7, 6, 2, 8, 3, 0, 9, 4),
    (5, 8, 0, 3, 7, 9, 6, 1, 4, 2),
    (8, 9, 1, 6, 0, 4, 3, 5, 2, 7),
    (9, 4, 5, 3, 1, 2, 6, 8, 7, 0),
    (4, 2, 8, 6, 5, 7, 3, 9, 0, 1),
    (2, 7, 9, 3, 8, 0, 6, 4, 1, 5),
    (7, 0, 4, 6, 9, 1, 3, 2, 5, 8),
)
CHINA_WEIGHTS = (7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2)
CHINA_CHECK = "10X98765432"

# Candidate patterns and finding labels.
IBAN_PATTERN = r"\b([A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}[ ]?[A-Z0-9]{0,4})\b"
CARD_PATTERN = r"\b(?:\d[ -]?){13,19}\b"
AADHAAR_PATTERN = r"\b(\d{4}[ ]?\d{4}[ ]?\d{4})\b"
CPF_PATTERN = r"\b(\d{3}\.?\d{3}\.?\d{3}-?\d{2})\b"
SIN_PATTERN = r"\b(\d{3}[ -]?\d{3}[ -]?\d{3})\b"
ZA_PATTERN = r"\b(\d{13})\b"
CHINA_PATTERN = r"\b(\d{17}[\dXx])\b"
SSN_PATTERN = r"\b(?!000|666|9\d{2})\d{3}-(?!00)\d{2}-(?!0000)\d{4}\b"
EMIRATES_PATTERN = r"\b784-?\d{4}-?\d{7}-?\d\b"
MRZ_LINE1 = r"^P[A-Z<][A-Z<]{3}[A-Z<]{39}$"
MRZ_LINE2 = r"^[A-Z0-9<]{44}$"
LOCATION = {
    "mrz": "Machine Readable Zone (MRZ)",
    "iban": "IBAN pattern (checksum-verified)",
    "card": "card number pattern (Luhn + issuer-range verified)",
    "aadhaar": "India Aadhaar (Verhoeff-verified)",
    "cpf": "Brazil CPF (mod-11 verified)",
    "sin": "Canada SIN (Luhn-verified)",
    "za_id": "South Africa ID (Luhn-verified)",
    "cn_id": "China Resident ID (MOD 11-2 verified)",
    "ssn": "US Social Security Number (structural match)",
    "emirates": "UAE Emirates ID (structural match)",
}

# Patterns of our own for categories that a model would name.
EMAIL_PATTERN = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE_PATTERN = r"\+\d{1,3}[ -]?\(?\d{2,4}\)?[ -]?\d{3,4}[ -]?\d{3,4}"
IP_PATTERN = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
SECRET_PATTERN = r"\b(?:[0-9a-f]{40}|AKIA[0-9A-Z]{16}|sk-[A-Za-z0-9]{20,})\b"


# No identifier spans one of these characters and none of them is part of a word, so cutting the
# text there changes neither the matches nor the word boundaries around them.
BREAKS = r"[\n\r\t,;:!?()\x22\x27\[\]{}<>/|]+"
# A piece without these cannot hold a match.
NEAR_DIGITS = r"\d(?:[ .-]?\d){8}"
IBAN_START = r"\p{L}\d{2} ?[\p{L}0-9]{4}"


CHARACTERS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Digits in the lower of the two numbers that a candidate's digits are held in.
LOW = 10


def halves(digits: str) -> str:
    """Fields hi and lo: a string of at most 28 digits as two numbers, of which lo has the last ten; without one, zeros."""
    if not digits:
        return "'hi', 0L, 'lo', 0L"
    return (f"'hi', IF(length({digits}) > {LOW}, TRY_CAST(substring({digits}, 1, length({digits}) - {LOW}) AS BIGINT), 0L), "
            f"'lo', TRY_CAST(substring({digits}, -{LOW}, {LOW}) AS BIGINT)")


def place(r: int) -> str:
    """The digit at place r from the right (0 is the last), by arithmetic: no string is made."""
    return f"((lo div {10 ** r}L) % 10L)" if r < LOW else f"((hi div {10 ** (r - LOW)}L) % 10L)"


def high(r: int) -> str:
    """Whether the digit at place r is at least 5, as 1 or 0."""
    return f"((lo div {5 * 10 ** r}L) % 2L)" if r < LOW else f"((hi div {5 * 10 ** (r - LOW)}L) % 2L)"


WIDEST = 20


def luhn_ok(width: int = WIDEST) -> str:
    """Mod 10 with every second digit from the right doubled; a doubled digit counts 9 less, or 1 more mod 10, from 5 on."""
    plain = " + ".join(place(r) for r in range(0, width, 2))
    doubled = " + ".join(f"2L * {place(r)} + {high(r)}" for r in range(1, width, 2))
    return f"({plain} + {doubled}) % 10L = 0"


def issuer_ok(v: str) -> str:
    """Length and leading digits of the common card networks."""
    n = f"length({v})"
    lead = lambda k, n: f"(hi div {10 ** (n - LOW - k)}L)"
    return f"""CASE WHEN substring({v}, 1, 1) = '4' THEN {n} IN (13, 16, 19)
      WHEN {n} = 14 THEN {lead(2, 14)} IN (36, 38) OR {lead(3, 14)} BETWEEN 300 AND 305
      WHEN {n} = 15 THEN {lead(2, 15)} IN (34, 37)
      WHEN {n} = 16 THEN {lead(2, 16)} BETWEEN 51 AND 55 OR {lead(4, 16)} BETWEEN 2221 AND 2720 OR {lead(4, 16)} = 6011
        OR {lead(2, 16)} = 65 OR {lead(3, 16)} BETWEEN 644 AND 649 OR {lead(6, 16)} BETWEEN 622126 AND 622925
        OR {lead(4, 16)} BETWEEN 3528 AND 3589 OR {lead(2, 16)} = 62
      ELSE {n} BETWEEN 17 AND 19 AND substring({v}, 1, 2) = '62' END"""


def iban_ok(v: str) -> str:
    """Mod 97 of the rearranged IBAN, folded character by character (A counts 10)."""
    turned = f"concat(substring({v}, 5), substring({v}, 1, 4))"
    fold = f"aggregate(split({turned}, ''), 0, (a, c) -> (a * IF(c >= 'A', 100, 10) + instr('{CHARACTERS}', c) - 1) % 97)"
    return f"length({v}) BETWEEN 15 AND 34 AND {fold} = 1"


def verhoeff_ok(width: int = 12) -> str:
    """Fold over the digits from the right through the two tables."""
    d = "array(" + ", ".join(str(x) for row in VERHOEFF_D for x in row) + ")"
    check = "0"
    for i in range(width):
        row = "array(" + ", ".join(map(str, VERHOEFF_P[i % 8])) + ")"
        check = f"get({d}, {check} * 10 + get({row}, CAST({place(i)} AS INT)))"
    return f"{check} = 0"


def weighted(weights: tuple[int, ...], width: int) -> str:
    """Sum of the leading digits of a number of ``width`` digits, times their weights."""
    return "(" + " + ".join(f"{place(width - 1 - i)} * {w}L" for i, w in enumerate(weights)) + ")"


def cpf_ok(v: str) -> str:
    """Two mod-11 digits; a number of one repeated digit is rejected."""
    def check(n: int) -> str:
        rest = f"{weighted(tuple(range(n + 1, 1, -1)), 11)} % 11L"
        return f"CASE WHEN {rest} < 2 THEN 0L ELSE 11L - {rest} END"

    return f"{check(9)} = {place(1)} AND {check(10)} = {place(0)} AND replace({v}, substring({v}, 1, 1), '') <> ''"


def za_ok(v: str) -> str:
    return (f"CAST(substring({v}, 3, 2) AS INT) BETWEEN 1 AND 12 AND CAST(substring({v}, 5, 2) AS INT) BETWEEN 1 AND 31 "
            f"AND {place(2)} IN (0L, 1L) AND {luhn_ok(13)}")


def china_ok(v: str) -> str:
    """Over the 17 digits before the check character."""
    return f"upper(substring({v}, 18, 1)) = substring('{CHINA_CHECK}', CAST({weighted(CHINA_WEIGHTS, 17)} % 11L AS INT) + 1, 1)"


MRZ_PARTS = ((1, 9), (14, 6), (22, 6))


def mrz_digits(v: str) -> str:
    """The checked parts of the second line, each character as its value mod 10 (A is 10, anything else 0)."""
    parts = ", ".join(f"substring({v}, {start}, {n})" for start, n in MRZ_PARTS)
    letters = CHARACTERS[10:]
    return f"translate(concat({parts}), '{letters}<', '{''.join(str((i + 10) % 10) for i in range(len(letters)))}0')"


def mrz_ok(v: str) -> str:
    """Passport number, birth date and expiry date of the second line each match their digit (weights 7, 3, 1)."""
    width, done, checks = sum(n for _, n in MRZ_PARTS), 0, []
    for start, n in MRZ_PARTS:
        terms = " + ".join(f"{place(width - 1 - done - i)} * {(7, 3, 1)[i % 3]}L" for i in range(n))
        checks.append(f"CAST(({terms}) % 10L AS STRING) = substring({v}, {start + n}, 1)")
        done += n
    return " AND ".join(checks)


def mrz_lines(text: str) -> str:
    """Second lines of adjacent 44-character line pairs that look like a passport zone."""
    # the patterns ask for 44 characters, and $ allows a line end of two behind them
    lines = rf"transform(split({text}, r'\r?\n'), s -> IF(length(s) < 44, '', replace(trim(s), ' ', '')))"
    pairs = (f"filter(sequence(0, size(ls) - 1), i -> length(get(ls, i)) BETWEEN 44 AND 46 "
             f"AND get(ls, i) RLIKE r'{MRZ_LINE1}' AND coalesce(get(ls, i + 1) RLIKE r'{MRZ_LINE2}', false))")
    return f"get(transform(array({lines}), ls -> transform({pairs}, i -> get(ls, i + 1))), 0)"


def matches(text: str, pattern: str, group: int = 0, strip: str = "") -> str:
    """All matches (of a group), without the characters of ``strip``."""
    found, bare = f"regexp_extract_all({text}, r'{pattern}', {group})", "x"
    for c in strip:
        bare = f"replace({bare}, '{c}', '')"
    return f"transform({found}, x -> {bare})" if strip else found


@dataclass(frozen=True)
class Family:
    """Where candidates come from ({text} stands for the text) and what makes one a finding
    (over the value v and its digits as two numbers hi and lo)."""

    candidates: str
    check: str
    category: str
    severity: str = "critical"
    method: str = "rules_checksum"
    source: str = "numeric"
    shown: str = "v"
    digits: str = "x"


_TEXT = "{text}"
FAMILIES: dict[str, Family] = {
    "mrz": Family(mrz_lines(_TEXT), mrz_ok("v"), "PASSPORT", source="text", shown="replace(substring(v, 1, 9), '<', '')",
                  digits=mrz_digits("x")),
    "iban": Family(matches(f"upper({_TEXT})", IBAN_PATTERN, 1, " "), iban_ok("v"), "IBAN", source="lettered", digits=""),
    "card": Family(matches(_TEXT, CARD_PATTERN, 0, " -"), f"({issuer_ok('v')}) AND {luhn_ok()}", "CREDIT_CARD"),
    "aadhaar": Family(matches(_TEXT, AADHAAR_PATTERN, 1, " "),
                      f"substring(v, 1, 1) NOT IN ('0', '1') AND {verhoeff_ok()}", "NATIONAL_ID"),
    "cpf": Family(matches(_TEXT, CPF_PATTERN, 1, ".-"), cpf_ok("v"), "NATIONAL_ID"),
    "sin": Family(matches(_TEXT, SIN_PATTERN, 1, " -"), luhn_ok(), "NATIONAL_ID"),
    "za_id": Family(matches(_TEXT, ZA_PATTERN, 1), za_ok("v"), "NATIONAL_ID"),
    "cn_id": Family(matches(_TEXT, CHINA_PATTERN, 1), china_ok("v"), "NATIONAL_ID", digits="substring(x, 1, 17)"),
    "ssn": Family(matches(_TEXT, SSN_PATTERN), "true", "NATIONAL_ID", "high", "rules_shape", digits=""),
    "emirates": Family(matches(_TEXT, EMIRATES_PATTERN), "true", "EMIRATES_ID", "high", "rules_shape", digits=""),
}
CONTACT: dict[str, Family] = {
    "email": Family(matches(_TEXT, EMAIL_PATTERN), "true", "EMAIL", "medium", "rules_shape", "text", digits=""),
    "phone": Family(matches(_TEXT, PHONE_PATTERN), "true", "PHONE", "medium", "rules_shape", "text", digits=""),
    "ip_address": Family(matches(_TEXT, IP_PATTERN), r"forall(split(v, '[.]'), o -> CAST(o AS INT) <= 255)", "IP_ADDRESS",
                         "low", "rules_shape", "text", digits=""),
    "credential": Family(matches(_TEXT, SECRET_PATTERN), "true", "CREDENTIAL", "critical", "rules_shape", "text", digits=""),
}


def location(name: str) -> str:
    return LOCATION.get(name, f"{name} pattern")


def cut(text: str) -> str:
    """The text cut at its breaks."""
    return f"split({text}, r'{BREAKS}')"


def pieces(parts: str, needed: str) -> str:
    """Those of the parts of a text that can hold a match at all, one per line."""
    return f"array_join(filter({parts}, p -> p RLIKE r'{needed}'), '\\n')"
