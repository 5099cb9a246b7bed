"""Text functions on columns: native expressions only."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Reply prefixes, patterns where quoted text begins, contact lines, deadlines.  Patterns
# take time in proportion to a text: runs are taken whole (++), from where they begin (the look
# behind), and white space from the first of several empty lines on.
REPLY_PREFIXES = ["re", "fw", "fwd", "aw", "antw", "tr", "rv", "sv", "vs"]
QUOTE_BANNERS = [
    r"(?imdU)^-+\s*Original Message\s*-+",
    r"(?imdU)^-+\s*Forwarded by\b.*$",
    r"(?mdU)^(?<!\n\n)\s*+_{10,}\s*$",
    r"(?mdU)^(?<!\n\n)\s*+-{10,}\s*$",
    r"(?mdU)^On\b.{0,160}\bwrote:\s*$",
]
CONTACT_LINE = r"(?iU)\(\d{3}\)\s*\d{3}[-.\s]?\d{4}|\b\d{3}[-.]\d{3}[-.]\d{4}\b|\b(?:tel|telephone|fax|phone|mobile|cell|e-?mail|ext)\b\s*[:.]?|(?<![\w.+-])[\w.+-]++@[\w.-]+\.\w{2,}"
DEADLINE = r"(?iU)\b(deadline|due\s+by|no\s+later\s+than|by\s+(?:end\s+of\s+day|eod|cob|monday|tuesday|wednesday|friday|thursday|saturday|sunday|tomorrow|\d{1,2}[/-]\d{1,2})|\basap\b|\burgent\b)"
# A From: line, what confirms it, and the window after it (characters, and parts
# of it between line ends, of which the first is the rest of the From: line).
FROM_LINE, FROM_CONFIRM, FROM_WINDOW, FROM_PARTS = r"(?mdU)^(?<!\n\n)\s*+From:\s+\S.*$", r"(?mdU)^\s*(?:Sent|To|Date|Subject):\s+\S", 400, 4
#: White space as Python has it.
SPACE = r"(?U)[\s\x1c-\x1f]"
SIGNATURE_LINES = 6


#: An address, from where its run of characters begins, or from where the address before it ended.
ADDRESS = r"(?:\G|(?<![A-Za-z0-9._%+'-]))[A-Za-z0-9._%+'-]++@[A-Za-z0-9.-]+"


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.get(F.transform(F.array(value), f), 0)


def collapse(text: Column) -> Column:
    """White space collapsed, trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(text, SPACE + "+", " ")))


def token_count(text: Column) -> Column:
    """Words between Unicode white space (the separators \\x1c-\\x1f included)."""
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?U)[^\s\x1c-\x1f]+"), 0)).cast("long")


def normalize_subject(subject: Column) -> Column:
    """Reply prefixes (with an optional [n]) stripped again and again, then collapsed."""
    prefix = rf"(?iU)^(?:\s*(?:{'|'.join(REPLY_PREFIXES)})\s*(?:\[\d+\])?\s*:\s*)+"
    return collapse(F.regexp_replace(F.coalesce(subject, F.lit("")), prefix, ""))


def is_linkable_subject(subject: Column, least: int = 4) -> Column:
    return F.length(subject) >= least


def normalize_address(raw: Column) -> Column:
    """Trimmed, without angle brackets, lower case; null without an @."""
    bare = F.lower(F.trim(F.regexp_replace(F.trim(raw), r"^<+|>+$", "")))
    return F.when(bare.contains("@"), bare)


def extract_addresses(text: Column) -> Column:
    """Distinct addresses in the order of their first place."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(ADDRESS), 0)
    return F.array_distinct(F.transform(found, F.lower))


def message_ids(raw: Column) -> Column:
    """Bracketed message ids, or white-space-separated ones; distinct in order."""
    raw = F.coalesce(raw, F.lit(""))
    bracketed = F.regexp_extract_all(raw, F.lit(r"<([^>]+)>"), 1)
    plain = F.filter(F.split(raw, r"\s+"), lambda x: x != "")
    return F.array_distinct(F.when(F.size(bracketed) > 0, bracketed).otherwise(plain))


def normalize_display_name(raw: Column) -> Column:
    """What stands before / and <, quotes and commas as spaces, collapsed."""
    return collapse(F.translate(F.split_part(F.split_part(raw, F.lit("/"), F.lit(1)), F.lit("<"), F.lit(1)), "\"',", "   "))


def mailbox_key(full_name: Column) -> Column:
    """surname-initial; null for fewer than two names."""
    parts = F.filter(F.split(F.lower(F.trim(full_name)), r"\s+"), lambda x: ~F.regexp_replace(x, r"\.", "").isin("jr", "sr", "ii", "iii", "iv") & (x != ""))
    surname = F.regexp_replace(F.try_element_at(parts, F.lit(-1)), "[^a-z]", "")
    initial = F.substring(F.regexp_replace(F.try_element_at(parts, F.lit(1)), "[^a-z]", ""), 1, 1)
    return F.when((F.size(parts) >= 2) & (surname != "") & (initial != ""), F.concat_ws("-", surname, initial))


def path_part(path: Column, n: int) -> Column:
    return F.split_part(path, F.lit("/"), F.lit(n))


def year(date: Column) -> Column:
    return F.year(date)


def has_deadline(text: Column) -> Column:
    return F.coalesce(F.rlike(text, F.lit(DEADLINE)), F.lit(False))


def confirmed_from(body: Column) -> Column:
    """Where the first confirmed From: line begins (from 1); null without any."""
    found = lambda g: F.regexp_extract_all(body, F.lit(f"{FROM_LINE}(?=((?s:.{{0,{FROM_WINDOW}}})))"), g)
    confirmed = F.transform(found(1), lambda w: F.rlike(F.array_join(F.slice(F.split(w, "\n"), 1, FROM_PARTS), "\n"), F.lit(FROM_CONFIRM)))
    length = lambda parts: F.aggregate(parts, F.lit(0), lambda n, x: n + F.length(x))

    def place(nth: Column) -> Column:
        return F.when(nth > 0, length(F.slice(F.split(body, FROM_LINE), F.lit(1), nth)) + length(F.slice(found(0), F.lit(1), nth - 1)) + 1)

    return F.when(body.contains("From:"), let(F.array_position(confirmed, True).cast("int"), place))


def strip_quoted(body: Column) -> Column:
    """Cut at the earliest banner or confirmed From: line, then drop > lines."""

    def strip(body: Column) -> Column:
        first = F.least(*[F.nullif(F.regexp_instr(body, F.lit(p)), F.lit(0)) for p in QUOTE_BANNERS], confirmed_from(body))
        head = let(first, lambda at: F.when(at.isNull(), body).otherwise(F.substring(body, F.lit(1), at - 1)))
        return F.array_join(F.filter(F.split(head, "\n"), lambda x: ~F.rlike(x, F.lit(r"(?U)^\s*>"))), "\n")

    return let(body, strip)


def strip_signature(body: Column) -> Column:
    """Cut at a -- line; then up to six contact lines at the end go (blank ones don't count)."""
    start = F.struct(F.lit(0).alias("dropped"), F.lit(0).alias("contacts"), F.lit(False).alias("stopped"))

    def step(s: Column, line: Column) -> Column:
        blank = F.rlike(line, F.lit(f"^{SPACE}*$"))
        contact = ~blank & (s["contacts"] < SIGNATURE_LINES) & F.rlike(line, F.lit(CONTACT_LINE))
        # nothing above the signature is looked at
        kind = F.when(s["stopped"], 0).when(blank, 1).when(contact, 2).otherwise(0)
        return let(kind, lambda k: F.struct((s["dropped"] + (k > 0).cast("int")).alias("dropped"), (s["contacts"] + (k == 2).cast("int")).alias("contacts"), (k == 0).alias("stopped")))

    def strip(body: Column) -> Column:
        at = F.nullif(F.regexp_instr(body, F.lit(r"(?mdU)^--\s*$")), F.lit(0))
        head = let(at, lambda at: F.when(at.isNull(), body).otherwise(F.substring(body, F.lit(1), at - 1)))
        dropped = lambda lines: F.aggregate(F.reverse(lines), start, step, lambda s: s["dropped"])
        return let(F.split(head, "\n"), lambda lines: F.array_join(F.slice(lines, F.lit(1), F.size(lines) - dropped(lines)), "\n"))

    return let(body, strip)


def clean_body(body: Column) -> Column:
    return F.regexp_replace(strip_signature(strip_quoted(F.coalesce(body, F.lit("")))), rf"\A{SPACE}+|{SPACE}+\z", "")


def fingerprint(*parts: Column) -> Column:
    """sha256 over the parts, null as empty, with zero characters between."""
    return F.sha2(F.concat_ws("\0", *[F.coalesce(p, F.lit("")) for p in parts]), 256)


def content_fingerprint(sender: Column, date: Column, subject: Column, body: Column) -> Column:
    return fingerprint(sender, F.date_format(date, "yyyy-MM-dd'T'HH:mm:ss"), collapse(subject), collapse(body))


def sentences(text: Column) -> Column:
    """Non-empty sentences: cut after . ! ? and at line ends."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+|\n+"), lambda x: F.trim(x) != "")


def phrase_hits(sentence: Column, phrases: list[str]) -> Column:
    """Whether any phrase stands in the (lower-case) sentence."""
    return reduce(lambda a, b: a | b, [sentence.contains(p) for p in phrases], F.lit(False))


def token_hits(words: Column, tokens: list[str]) -> Column:
    """Whether any token is among the (lower-case) words."""
    return F.arrays_overlap(words, F.array(*[F.lit(t) for t in tokens])) if tokens else F.lit(False)


def seeded_order(seed: int, *ids: Column) -> Column:
    """A reproducible random order that any engine can compute."""
    return F.sha2(F.concat_ws("|", *[i.cast("string") for i in ids], F.lit(str(seed))), 256)


def deterministic_choice(seed: Column, options: list[str]) -> Column:
    """options[first byte of sha256(seed) % n]."""
    byte = F.conv(F.substring(F.sha2(seed, 256), 1, 2), 16, 10).cast("int")
    return F.element_at(F.array(*[F.lit(o) for o in options]), byte % len(options) + 1)


def short_id(value: Column) -> Column:
    return F.concat(F.lit("c_"), F.substring(F.sha2(value, 256), 1, 16))


def cache_key(fields: dict[str, Column]) -> Column:
    """sha256 of canonical JSON: keys in order, nulls kept."""
    return F.sha2(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"}), 256)
