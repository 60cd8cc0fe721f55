"""Text expressions: token boundaries, path and text patterns, redaction, excerpts."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that continue a token: digits and letters that have a case. Scripts without case are boundaries.
JOINING = r"\p{Lu}\p{Ll}\p{Lt}\p{N}"
PLACEHOLDER = "[removed]"


def marker_pattern(marker: str) -> str:
    """F-11: a literal in any case at token boundaries; a change from lower to upper case is a boundary too.

    The pattern uses no lookaround, so Java's and RE2's engines agree on whether it is found.
    """
    quote = lambda s: re.sub(r"([^\w\s])", r"\\\1", s)
    first, middle, last = marker[0], marker[1:-1], marker[-1]
    if len(marker) == 1:
        turns = [rf"\p{{Ll}}{quote(first)}(?:$|[^{JOINING}])"] if first.isupper() else []
        return "|".join([rf"(?:^|[^{JOINING}])(?iu:{quote(first)})(?:$|[^{JOINING}])", *turns])
    left = rf"(?:^|[^{JOINING}])(?iu:{quote(first)})"
    if first.lower() != first.upper():
        left = rf"(?:{left}|\p{{Ll}}{quote(first.upper())})"
    right = rf"(?iu:{quote(last)})(?:$|[^{JOINING}])"
    if last.lower() != last.upper():
        right = rf"(?:{right}|{quote(last.lower())}\p{{Lu}})"
    return left + (rf"(?iu:{quote(middle)})" if middle else "") + right


def normal_path(path: Column) -> Column:
    """F-06: backslashes become slashes, runs of slashes one."""
    return F.regexp_replace(F.regexp_replace(path, r"\\", "/"), "/+", "/")


def glob_body(glob: str, paths: bool) -> str:
    """A glob's regular expression. In paths ``*`` and ``?`` stay inside a segment, ``**`` crosses them."""
    out, i = "", 0
    while i < len(glob):
        if paths and glob.startswith("**/", i):
            out, i = out + "(?:[^/]*/)*", i + 3
        elif paths and glob.startswith("**", i):
            out, i = out + r"[^\n]*", i + 2
        elif glob[i] == "*":
            out, i = out + ("[^/]*" if paths else r"[^\n]*"), i + 1
        elif glob[i] == "?":
            out, i = out + ("[^/]" if paths else r"[^\n]"), i + 1
        else:
            out, i = out + re.sub(r"([^\w\s/])", r"\\\1", glob[i]), i + 1
    return out


def path_pattern(pattern: str) -> str:
    """F-07, F-08, F-10: the search that a path rule stands for. ``re:`` is a search as it is; a leading slash anchors."""
    if pattern.startswith("re:"):
        return pattern[3:]
    glob = re.sub("/+", "/", pattern.replace("\\", "/")).removeprefix("~/")
    if glob.endswith("/"):
        glob += "**"
    start = "^" if glob.startswith("/") else "(?:^|/)"
    return rf"{start}{glob_body(glob, True)}\z"


def text_pattern(pattern: str) -> str:
    """F-09, F-10: a text glob covers the whole text, and its ``*`` and ``?`` no line break."""
    return pattern[3:] if pattern.startswith("re:") else rf"^{glob_body(pattern, False)}\z"


#: The first letters of access key ids, by what they name (fixed values).
ACCESS_KEY_PREFIXES = ("ABIA", "ACCA", "AGPA", "AIDA", "AIPA", "AKIA", "ANPA", "ANVA", "APKA", "AROA", "ASCA", "ASIA")
#: Names whose values are secret, as whole words of a normalised key (fixed values).
SENSITIVE_NAMES = (
    "access_key", "api_key", "apikey", "auth", "authorization", "cookie", "credential", "credentials", "dsn", "encryption_key",
    "passphrase", "passwd", "password", "private_key", "pwd", "secret", "session_key", "signing_key", "ssh_key", "token",
)


#: Least length of a token that counts as one, and the lengths of a vendor's key id and of its key (fixed values).
TOKEN_CHARS, KEY_ID_CHARS, KEY_CHARS = 16, 20, 40
#: Character sets of RFC 5234, appendix B.1.
ALPHA, DIGIT, UPPER = "A-Za-z", "0-9", "A-Z"


def armour() -> str:
    """RFC 7468, section 3: a label between dashes, the same kind at both ends; labels of private keys end alike (section 10, 11)."""
    label = rf"(?:[{UPPER}{DIGIT}]+ )*PRIVATE KEY"
    return "".join(rf"-----{edge} {label}-----{rest}" for edge, rest in (("BEGIN", r"[\s\S]*?"), ("END", "")))


def key_id() -> str:
    """A vendor's unique identifier: a run of exactly so many upper-case letters and digits, which begins with a kind's prefix."""
    char = f"[{UPPER}{DIGIT}]"
    return rf"(?<!{char})(?={'|'.join(ACCESS_KEY_PREFIXES)}){char}{{{KEY_ID_CHARS}}}(?!{char})"


def named_key(done: str) -> str:
    """RFC 4648, table 1: as many base64 characters as a key has, after its name and the ``=`` of an environment or the ``:`` of JSON."""
    words, char, quote = ("AWS", "SECRET", "ACCESS", "KEY"), f"[{ALPHA}{DIGIT}+/=]", "[\"']?"
    return rf"((?i:{'[_ -]?'.join(words)}){quote}\s*[:=]\s*{quote})(?:{char}{{{KEY_CHARS}}})(?!{char})(?!{done})"


def bearer() -> str:
    """RFC 6750, section 2.1: the scheme, 1*SP and a b64token; RFC 7235, section 2.1, has the scheme in any case and quoted values."""
    return rf"((?i:bearer)[ \t]+[\"']?)[{ALPHA}{DIGIT}._~+/-]{{{TOKEN_CHARS},}}=*"


def user_information(done: str) -> str:
    """RFC 3986, section 3.2.1: what stands between ``//`` and ``@``, if it has a colon; white space and delimiters end it."""
    return rf"(://)(?!{done}@)[^\s:@/?#]+:[^\s@/?#]*(?=@)"


def secret_pattern(placeholder: str = PLACEHOLDER) -> str:
    """One search for the five shapes that a secret's own text shows; groups 1 to 3 are what stays in front of it.

    Java and Python read it alike. A key has exactly its length, so a rest that stands against a placeholder is no key.
    """
    done = re.escape(placeholder)
    return "|".join((armour(), key_id(), named_key(done), bearer(), user_information(done)))


SECRET = secret_pattern()


def casefold(text: Column) -> Column:
    """F-36: equal for texts that differ in case alone, as ß and SS or both small sigmas do."""
    return F.translate(F.lower(F.upper(text)), "ς", "σ")


def redact_secrets(text: Column, placeholder: str = PLACEHOLDER) -> Column:
    """F-12: secrets replaced, their lead kept. Twice gives the same as once. Null stays null."""
    return F.regexp_replace(text, secret_pattern(placeholder), "$1$2$3" + re.sub(r"([\\$])", r"\\\1", placeholder))


def normal_key(key: Column) -> Column:
    """F-13: camel case split, separators one underscore, lower case."""
    split = F.regexp_replace(F.regexp_replace(key, r"([a-z0-9])([A-Z])", "$1_$2"), r"([A-Z]+)([A-Z][a-z])", "$1_$2")
    return F.regexp_replace(F.lower(split), r"[^a-z0-9]+", "_")


def is_sensitive_key(key: Column, extra: tuple[str, ...] = ()) -> Column:
    return normal_key(key).rlike("(?:^|_)(?:" + "|".join(SENSITIVE_NAMES + extra) + ")(?:_|$)")


def redact_json(placeholder: str = PLACEHOLDER, extra: tuple[str, ...] = (), max_depth: int = 32, enabled: bool = True):
    """F-14, UD-08: a function over columns of JSON texts, as their shape recurses: (value string, modified boolean).

    Strings lose secrets; under a sensitive key every string goes. Containers at ``max_depth`` become empty. Texts
    that are not JSON, and null, come back as they are; so do all where it is not ``enabled``.
    """
    if not enabled:
        return lambda c: F.struct((F.col(c) if isinstance(c, str) else c).alias("value"), F.lit(False).alias("modified"))
    names = re.compile("(?:^|_)(?:" + "|".join(SENSITIVE_NAMES + extra) + ")(?:_|$)")
    # Python writes a group's absence as an empty string too
    shapes = re.compile(secret_pattern(placeholder))

    def plain(key: str) -> str:
        key = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1_\2", re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", key))
        return re.sub(r"[^a-z0-9]+", "_", key.lower())

    def clean(value, hidden: bool, depth: int):
        if isinstance(value, str):
            new = placeholder if hidden else shapes.sub(lambda m: "".join(g or "" for g in m.groups()) + placeholder, value)
            return new, new != value
        if isinstance(value, (dict, list)):
            if depth >= max_depth:
                return type(value)(), bool(value)
            if isinstance(value, dict):
                parts = {k: clean(v, hidden or bool(names.search(plain(k))), depth + 1) for k, v in value.items()}
                return {k: v for k, (v, _) in parts.items()}, any(m for _, m in parts.values())
            parts = [clean(v, hidden, depth + 1) for v in value]
            return [v for v, _ in parts], any(m for _, m in parts)
        return value, False

    # some hundred texts are in a worker at a time, where a pandas batch holds 10,000, each several times
    @F.udf("value string, modified boolean", useArrow=False)
    def redacted(text):
        try:
            value, modified = clean(json.loads(text), False, 0)
            return json.dumps(value, ensure_ascii=False, separators=(",", ":")), modified
        except (TypeError, ValueError):
            return text, False

    return redacted


def excerpt(text: Column, n: int = 400) -> Column:
    """P-07: the first ``n`` characters of an optional text."""
    return F.substring(F.coalesce(text, F.lit("")), 1, n)


def byte_cap(text: Column, n: int) -> Column:
    """F-22: at most ``n`` UTF-8 bytes, no character split."""
    raw = F.encode(text, "UTF-8")
    size = F.octet_length(text)
    lead = lambda k: F.conv(F.hex(F.substring(raw, k, 1)), 16, 10).cast("int")
    # the byte after the cut tells whether the cut splits a character; step back over continuation bytes
    cut = F.lit(n)
    for back in range(3):
        at = n - back
        inside = lead(at + 1).between(128, 191) if at >= 0 else F.lit(False)
        cut = F.when((cut == at) & inside, F.lit(at - 1)).otherwise(cut)
    pieces = F.when(cut == n, F.decode(F.substring(raw, 1, n), "UTF-8"))
    for back in range(1, 4):
        pieces = pieces.when(cut == n - back, F.decode(F.substring(raw, 1, max(0, n - back)), "UTF-8"))
    return F.when(size <= n, text).otherwise(pieces)


def clip_or_digest(text: Column, cap: int = 8192) -> Column:
    """F-23: the text itself, or its digest and length where it has over ``cap`` bytes."""
    big = F.octet_length(text) > cap
    return F.struct(F.when(~big, text).alias("value"), F.when(big, F.sha2(text, 256)).alias("digest"), F.octet_length(text).cast("long").alias("bytes"))


def verdict(reply: Column) -> Column:
    """F-24: include or exclude from a reply, fenced or bare JSON; anything else is null, for the caller to fail closed."""
    bare = F.regexp_replace(F.trim(reply), r"(?s)^```[a-z]*\s*(.*?)\s*```$", "$1")
    said = F.lower(F.trim(F.get_json_object(bare, "$.verdict")))
    return F.when(said.isin("include", "exclude"), said)


def removed_segments(before: Column, after: Column) -> Column:
    """A-21: lines of ``before`` that ``after`` lost and kept, blank lines aside."""
    lines = F.filter(F.split(before, "\n", -1), lambda x: F.trim(x) != "")
    there = F.split(after, "\n", -1)
    kept = F.size(F.filter(lines, lambda x: F.array_contains(there, x)))
    return F.struct((F.size(lines) - kept).cast("long").alias("removed"), kept.cast("long").alias("retained"))


def rewrite_fault(before: Column, after: Column, erased: Column, low: float = 0.3, high: float = 2.0, kept: Column | None = None) -> Column:
    """F-25: why a replacement is refused, the first reason in order, or null: empty, names_erased, length_ratio, lost_marker."""
    ratio = F.char_length(after) / F.char_length(before)
    lost = F.exists(kept, lambda m: F.contains(casefold(before), casefold(m)) & ~F.contains(casefold(after), casefold(m))) if kept is not None else F.lit(False)
    return (
        F.when(F.coalesce(F.trim(after), F.lit("")) == "", "empty")
        .when(F.contains(casefold(after), casefold(erased)), "names_erased")
        .when(~ratio.between(low, high), "length_ratio")
        .when(lost, "lost_marker")
    )


def strip_owner(text: Column, tokens: list[str]) -> Column:
    """F-26: without the owner's tokens and words that look like paths."""
    out = F.regexp_replace(text, r"\S*/\S+", "")
    for token in tokens:
        out = F.regexp_replace(out, "(?iu:" + re.sub(r"([^\w\s])", r"\\\1", token) + ")", "")
    return F.trim(F.regexp_replace(out, r"[ \t]+", " "))
