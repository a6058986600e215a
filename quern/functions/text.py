"""Text patterns and redaction as native column expressions. Patterns keep to what Java and RE2 both say."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The parts of an address are as long as they may be at most, so that a long run of letters costs no more than its length.
EMAIL = r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9.-]{1,255}\.[A-Za-z]{2,24}"
IBAN = r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?\b"
IPV4 = r"\b[0-9]{1,3}(?:\.[0-9]{1,3}){3}\b"

#: Phrases that try to turn a model against its instructions.
INJECTIONS = [
    r"(?i)(?:ignore|forget|disregard|override|bypass) (?:all |any |everything |of )*(?:the |your |my |these |those )?(?:previous|prior|above|earlier|system|safety|initial|original) (?:prompt|prompts|instructions|rules|guidelines|directions|messages)",
    r"(?i)you are now (?:in )?(?:dan|developer|jailbreak|unrestricted|free)",
    r"(?i)(?:act|behave|respond|pretend)(?: to be| as if you are| as if you were| as)? (?:an? )?(?:dan|unrestricted|unfiltered|jailbroken)",
    r"(?i)(?:reveal|print|show|repeat|output|leak) (?:me )?(?:the |your )?(?:full |entire |whole )?(?:system prompt|hidden instructions|initial prompt|secret instructions)",
    r"(?i)(?:enable|enter|activate|switch to) (?:developer|debug|god|jailbreak) mode",
    r"(?i)without (?:any )?(?:safety|content|ethical) (?:filters|restrictions|guidelines)",
    r"(?i)(?:password|token|api[_ ]?key) *[=:]",
]


#: Elements of a page that show no text, comments among them; elements that begin a new line; and the commonest entities (fixed values), the ampersand last.
UNSEEN = [r"(?s)<!--.*?-->", *[rf"(?is)<{t}\b[^>]*>.*?</{t}\s*>" for t in ("script", "style", "head", "template", "noscript")]]
BREAKS = r"(?i)</?(?:p|div|br|hr|li|ul|ol|dl|dt|dd|table|tr|h[1-6]|section|article|header|footer|nav|main|aside|blockquote|pre|form|body|html|title)\b[^>]*>"
TAG = r"</?[A-Za-z][^>]*>"
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]


def plain_html(html: Column) -> Column:
    """What a page says, a line for each block: elements without text go, block tags are line ends, other tags nothing. Null stays null; a tag that is not closed stays as it is.

    Native patterns for pages of known make; a page of any make needs a parser.
    """
    text = reduce(lambda t, p: F.regexp_replace(t, p, ""), UNSEEN, html)
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\s+", " "), BREAKS, "\n"), TAG, "")
    text = reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), ENTITIES, text)
    return F.regexp_replace(F.regexp_replace(text, " *\n *", "\n"), "^[ \n]+|[ \n]+$", "")


def redact(text: Column) -> Column:
    """E-mail addresses, IBANs and IPv4 addresses replaced by [EMAIL], [IBAN], [IP]. Redacting twice changes nothing more."""
    return reduce(lambda t, p: F.regexp_replace(t, p[0], p[1]), [(EMAIL, "[EMAIL]"), (IBAN, "[IBAN]"), (IPV4, "[IP]")], text)


def matches_any(text: Column, patterns: list[str]) -> Column:
    """Whether any pattern occurs; false for null texts."""
    return F.coalesce(reduce(lambda a, b: a | b, [text.rlike(p) for p in patterns]), F.lit(False))
