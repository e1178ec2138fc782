"""Detection rules.

A rule is one pattern in three groups, ``(before)(value)(after)``; the value is the span. Patterns are
in Java syntax with ``(?U)`` for Unicode classes and ``(?d)`` so that only ``\\n`` ends a line.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from .fixed import (
    ADDRESS_LABELS,
    AT_HANDLE,
    CONTACT_LABELS,
    DRIVE_PATH,
    DRIVE_USER,
    EMAIL_PATTERN,
    HEX_IS_LABEL,
    HISTORY_TIME,
    HOME_PATH,
    HOME_USER,
    HOST_PATTERN,
    IBAN_PATTERN,
    KEY_CLOSING,
    KEY_OPENING,
    KEY_PATTERNS,
    NAME_LABELS,
    PHONE_PATTERNS,
    PROFILE_URLS,
    PROTECTED_PATTERNS,
    SOCIAL_KEYS,
    SOCIAL_VALUE,
    SUBSCRIBER_COLUMNS,
    SUBSCRIBER_HEADER,
    TAG_PATTERN,
    U_HANDLE,
    USERNAME_ASSIGNED,
    USERNAME_KEYS,
    USERNAME_LABELS,
    USERNAME_VALUE,
    USERNAME_WORDS,
)


def listed(pattern: str) -> str:
    """``pattern`` with the letters and digits of its classes one by one instead of as ranges: the same matches.

    Java looks listed characters up in a table, ranges are compared one after the other.
    """
    out, i, inside = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            out.append(pattern[i : i + 2])
            i += 2
            continue
        if c in "[]":
            inside = c == "["
        last = pattern[i + 2 : i + 3]
        if inside and pattern[i + 1 : i + 2] == "-" and c.isalnum() and last.isalnum():
            out.append("".join(map(chr, range(ord(c), ord(last) + 1))))
            i += 3
            continue
        out.append(c)
        i += 1
    return "".join(out)


@dataclass(frozen=True)
class Rule:
    detector: str
    name: str
    pii_type: str
    confidence: float
    value: str
    before: str = ""
    after: str = ""
    flags: str = "Ud"
    # literals checked before the pattern: of every group at least one must occur in the text (needs) or
    # in its lower-cased form (low_needs); plain substring search is far cheaper than a pattern
    needs: tuple[tuple[str, ...], ...] = ()
    low_needs: tuple[tuple[str, ...], ...] = ()
    # literals of which one must occur in the lower-cased text for this rule and its neighbours with the same ones
    all_need: tuple[str, ...] = ()
    long_run: bool = False  # only texts with a run of 32 key characters
    trim: str = "none"  # none, right (separators), both (blanks)

    @property
    def plain(self) -> bool:
        """The whole match is the span."""
        return not self.before and not self.after

    @property
    def pattern(self) -> str:
        """Three groups for marking, or none when the whole match is the span.

        A test of the first character stands before the groups, so that other places are left without opening one.
        """
        if self.plain:
            pattern = f"(?{self.flags}){self.value}"
        else:
            ahead = re.match(r"(?:\(\?=\[[^\]\\]*\]\))?", self.before)[0]
            pattern = f"(?{self.flags}){ahead}({self.before[len(ahead):]})({self.value})({self.after})"
        return pattern if "i" in self.flags else listed(pattern)


# Detector order: it breaks ties between equal spans.
DETECTORS = [
    "email",
    "phone",
    "iban",
    "apikey",
    "credential",
    "filepath",
    "hostname",
    "username",
    "social",
    "fieldlabel",
    "provider_export",
    "name",
    "address",
]

# Type a detector declares for itself (only the compat filter looks at it).
DECLARED_TYPE = {
    "email": "email",
    "phone": "phone",
    "iban": "iban",
    "apikey": "apikey",
    "credential": "password",
    "filepath": "filepath_user",
    "hostname": "hostname",
    "username": "username",
    "social": "social_handle",
    "fieldlabel": "name",
    "provider_export": "username",
    "name": "name",
    "address": "address",
}


def _email() -> list[Rule]:
    # the tests in front only spare work: a start of a word, with a sign @ after its run of characters
    value = r"(?=[a-zA-Z0-9])(?<![a-zA-Z0-9_])(?=[a-zA-Z0-9._%+-]++@)" + EMAIL_PATTERN
    return [Rule("email", "address", "email", 0.95, value, needs=(("@",),))]


def _phone() -> list[Rule]:
    needs = {"international": (("+",),), "trunk_zero": (("0",),), "area_in_brackets": (("(",),)}
    return [Rule("phone", n, "phone", 0.85, v, needs=needs.get(n, ()), trim="right") for n, v in PHONE_PATTERNS]


def _iban() -> list[Rule]:
    return [Rule("iban", "account", "iban", 0.98, IBAN_PATTERN)]


def _apikey() -> list[Rule]:
    # (lookahead that a start must pass, literals as in ``needs``); they only spare work
    hints = {
        "cloud_access_id": ("(?=A)", (("IA", "CA"), ("AKIA", "ABIA", "ACCA", "ASIA"))),
        "maps_key": ("(?=AIza)", (("AIza",),)),
        "payment_key": ("(?=[sr]k_)", (("k_",), ("k_live_", "k_test_"))),
        "lower_hex": ("(?=[a-f0-9])(?<![A-Za-z0-9_])", None),
        "forge_token": ("(?=gh)", (("gh",), ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"))),
        "bot_token": (r"(?=\d{8})", ((":",),)),
    }
    rules = []
    for name, value, between in KEY_PATTERNS:
        start, literals = hints.get(name, ("", None))
        end = f"(?={KEY_CLOSING})" if between else f"(?!{HEX_IS_LABEL})" if name == "lower_hex" else ""
        rules.append(
            Rule("apikey", name, "apikey", 0.70, start + value + end, KEY_OPENING if between else "",
                 needs=literals or (), long_run=literals is None)
        )
    return rules


def _credential() -> list[Rule]:
    # own design: a secret label, an assignment sign, then the value up to quote, blank or separator
    before = (
        r"(?=[pst])(?<![A-Za-z0-9])(?:password|passwd|pwd|pass|secret|token)(?:[_-][A-Za-z0-9]+)*[\"']?\s*[=:]\s*[\"']?"
    )
    return [Rule("credential", "assigned_secret", "password", 0.90, r"[^\s\"',;]{4,}", before, flags="iUd",
                 needs=((":", "="),), low_needs=(("pass", "pwd", "secret", "token"),))]


def _filepath() -> list[Rule]:
    return [
        Rule("filepath", "drive_users", "filepath_user", 0.90, DRIVE_USER, DRIVE_PATH, r"\\", flags="iUd", needs=((":\\",),)),
        Rule("filepath", "home", "filepath_user", 0.90, HOME_USER, HOME_PATH, "/", needs=((HOME_PATH,),)),
    ]


def _hostname() -> list[Rule]:
    value = "(?=[ldpwn])" + HOST_PATTERN
    stems = tuple(p + sep for p in ("laptop", "desktop", "pc", "workstation", "nb", "notebook") for sep in "-_")
    return [Rule("hostname", "machine", "hostname", 0.70, value, flags="iUd", low_needs=(stems,))]


def _username() -> list[Rule]:
    value = USERNAME_VALUE
    return [
        Rule("username", "after_word", "username", 0.85, value,
             "(?=[fuUlLaA])" + USERNAME_WORDS, r"\b",
             needs=(("for", "user", "User", "USER", "login", "Login", "account", "Account"), (".", "-", "_"))),
        Rule("username", "assigned", "username", 0.85, value,
             "(?=[uoa])" + USERNAME_ASSIGNED, r"\b", flags="iUd",
             needs=((":", "="),), low_needs=(("user", "operator", "admin", "owner"),)),
        Rule("username", "access_log", "username", 0.85, value, " - ", r" \[", needs=((" - ",), (" [",))),
        Rule("username", "json_key", "username", 0.85, value, rf'(?=[uslamc])(?:{USERNAME_KEYS})"\s*:\s*"', '"', flags="iUd",
             needs=(('"',), (":",)), low_needs=(("user", "subscriber", "name", "caller"),)),
    ]


def _social() -> list[Rule]:
    opening = r"(?=[@u])(?:^|(?<=[\s,;:(\[{\"']))"
    rules = [
        Rule("social", "at_handle", "social_handle", 0.88, AT_HANDLE,
             opening, r"(?![A-Za-z0-9@])", flags="Udm", needs=(("@",),)),
        Rule("social", "u_handle", "social_handle", 0.88, U_HANDLE,
             opening, r"(?![A-Za-z0-9])", flags="Udm", needs=(("u/",),)),
    ]
    for site, path, user, literals in PROFILE_URLS:
        rules.append(
            Rule("social", f"url_{site}", "social_handle", 0.90, user,
                 rf"(?:https?://)?{path}", r"(?:\b|/|\?|$)", flags="iUd", low_needs=(literals,),
                 all_need=(".com/", "t.me/"))
        )
    rules.append(
        Rule("social", "field", "social_handle", 0.85, SOCIAL_VALUE,
             rf"(?=[stidryfu])(?:{SOCIAL_KEYS})[\"']?\s*[:=]\s*[\"']?", flags="iUd", needs=((":", "="),),
             low_needs=(("screen", "snap", "twitter", "instagram", "tiktok", "telegram", "discord", "reddit",
                         "youtube", "facebook", "fb", "handle"), ("user", "handle", "name")))
    )
    rules.append(
        Rule("social", "discord_tag", "social_handle", 0.90, TAG_PATTERN, needs=(("#",),))
    )
    return rules


def _fieldlabel() -> list[Rule]:
    groups = [
        ("name", 0.92, NAME_LABELS, ("name", "naam"), ("",)),
        ("username", 0.90, USERNAME_LABELS,
         ("user", "login", "screen", "nick", "account", "member", "caller", "sender", "author", "creator", "naam"),
         ("name", "naam", "id")),
        ("address", 0.88, ADDRESS_LABELS, ("address", "residence", "domicile", "adres", "verblijfplaats"), ("",)),
        ("phone", 0.88, CONTACT_LABELS, ("number", "telephone", "cell", "gsm", "telefoon", "mobiel"), ("",)),
    ]
    rules = []
    for pii_type, confidence, labels, stems, tails in groups:
        first = "".join(sorted({part[0] for part in labels.split("|")}))
        key = rf"(?=[{first}])(?:{labels})"
        forms = [
            ("colon_double", rf"{key}[\"']?\s*:\s*\"", r"[^\"]{1,100}", '"', ((":",), ('"',))),
            ("colon_single", rf"{key}[\"']?\s*:\s*'", r"[^']{1,100}", "'", ((":",), ("'",))),
            ("equals_double", rf'{key}\s*=\s*"', r"[^\"]{1,100}", '"', (("=",), ('"',))),
            ("equals_bare", rf"{key}\s*=\s*", r"[^\s,;}\]\"']{1,100}", "", (("=",),)),
        ]
        for form, before, value, after, signs in forms:
            rules.append(
                Rule("fieldlabel", f"{pii_type}_{form}", pii_type, confidence, value, before, after,
                     flags="iUd", trim="both", needs=signs, low_needs=(stems, tails))
            )
    return rules


def _provider_export() -> list[Rule]:
    rules = [
        Rule("provider_export", "target", "username", 0.95, r"[^\"]+", r'Target username\s+"+"?', r'"+"?',
             flags="iUd", trim="both", low_needs=(("target username",),))
    ]
    header = re.escape(SUBSCRIBER_HEADER)
    for position, pii_type in SUBSCRIBER_COLUMNS:
        # the data line follows the header line; it has at least 11 fields and is no ruler line
        before = (
            rf"{header}[^\n]*\n(?=\s*[^\s=-])(?=(?:[^,\n]*,){{10}})(?:[^,\n]*,){{{position}}}"
        )
        rules.append(
            Rule("provider_export", f"subscriber_{position}", pii_type, 0.93, r"[^,\n]*", before, r"[^\n]*",
                 needs=((SUBSCRIBER_HEADER,),), trim="both")
        )
    for action, pii_type in [("USERNAME", "username"), ("DISPLAY_NAME", "name"), ("PHONE", "phone")]:
        start = rf"^{HISTORY_TIME},{action},"
        rules.append(
            Rule("provider_export", f"change_{action.lower()}_old", pii_type, 0.92, r"[^,]*",
                 start, r",[^,]*,\w+$", flags="Udm", needs=((f" UTC,{action},",),), trim="both", all_need=(" utc",))
        )
        rules.append(
            Rule("provider_export", f"change_{action.lower()}_new", pii_type, 0.92, r"[^,]*",
                 rf"{start}[^,]*,", r",\w+$", flags="Udm", needs=((f" UTC,{action},",),), trim="both", all_need=(" utc",))
        )
    user = SOCIAL_VALUE
    rules.append(
        Rule("provider_export", "renamed_old", "username", 0.90, user, "^", rf",{user},{HISTORY_TIME}$",
             flags="Udm", needs=((" UTC",),), all_need=(" utc",))
    )
    rules.append(
        Rule("provider_export", "renamed_new", "username", 0.90, user, rf"^{user},", rf",{HISTORY_TIME}$",
             flags="Udm", needs=((" UTC",),), all_need=(" utc",))
    )
    return rules


RULES: list[Rule] = [
    *_email(),
    *_phone(),
    *_iban(),
    *_apikey(),
    *_credential(),
    *_filepath(),
    *_hostname(),
    *_username(),
    *_social(),
    *_fieldlabel(),
    *_provider_export(),
]

# cheap tests in front of the protected patterns: (lookahead, literals, long run); they do not change the matches
_HEX_START = "(?=[0-9a-fA-F])(?<![A-Za-z0-9_])"
_PROTECTED_HINTS = {
    "ipv4": (r"(?=\d)", ((".",),), False),
    "ipv6": ("(?=[0-9a-fA-F])", ((":",),), False),
    "md5": (_HEX_START, (), True),
    "sha1": (_HEX_START, (), True),
    "sha256": (_HEX_START, (), True),
    "mitre": ("(?=[Tt])", (("t", "T"),), False),
    "iso_time": (r"(?=\d)", (("-",), (":",)), False),
    "syslog_time": ("(?=[JFMASOND])", ((":",),), False),
    "protocol": ("(?=[THUSRFDIPNL])", (), False),
    "process": ("(?=[secprlwtdmnahbj])", (), False),
    "port": ("(?=[p:])", (), False),
    "mac": ("(?=[0-9a-fA-F])", ((":", "-"),), False),
}
PROTECTED_RULES: list[Rule] = [
    Rule("protected", name, "protected", 1.0, _PROTECTED_HINTS[name][0] + pattern, flags=flags,
         needs=_PROTECTED_HINTS[name][1], long_run=_PROTECTED_HINTS[name][2])
    for name, pattern, flags in PROTECTED_PATTERNS
]

# what any piece of a protected match looks like, or more: a value that does not is never inside one
PROTECTED_PIECE = (
    r"(?iU)^(?:[\da-f.:\s+tz-]*"  # addresses, digests, technique ids, ISO times
    r"|[a-z]{0,3}\s*[\d\s:]*"  # log times
    r"|[a-z\d]{0,10}(?:\.[ex]{0,3})?"  # names of protocols and processes
    r"|[port\s:]*\d{0,5})\z"
)
