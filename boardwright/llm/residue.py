"""Template residue, filler, error pages and demands for scripts, found by grammars in the JVM.

Each delimiter of template languages has its own grammar. Strong delimiters ({{ }}, <%= %>, ${ } ...) hold any
expression; weak ones ({ }, < >, [ ], ( )) must hold a field name or an instruction to fill one in, because text
also uses them ("{Civil} Wing", "[Insert Sheet B]"). Code blocks are set aside, and beside words that explain templates
a placeholder counts only where placeholders make up most of the text. Filler, errors and scripts have no such discount.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of the fields that notice templates fill in.
FIELD_NAMES = (
    "title", "heading", "headline", "designation", "department", "post", "posts", "name", "number", "advt", "advtno",
    "notice", "vacancy", "vacancies", "job", "org", "organisation", "organization", "date", "location", "place",
    "institute", "office", "model", "description", "text", "content", "value", "subject", "item", "link", "url", "email",
    "phone", "address", "company", "employer", "role", "position", "deadline", "qualification", "salary", "pay", "age",
    "reference", "ref", "category", "detail", "details", "field", "variable", "placeholder",
)
#: Names of HTTP failures, as error pages give them.
FAILURES = (
    "bad request", "unauthorized", "unauthorised", "payment required", "forbidden", "not found", "page not found",
    "method not allowed", "not acceptable", "request timeout", "time-?out", "conflict", "gone", "payload too large",
    "too many requests", "server fault", "server error", "internal server error", "not implemented", "bad gateway",
    "proxy error", "service unavailable", "temporarily unavailable", "unavailable", "gateway time-?out", "unknown error",
)
#: Phrases that no heading of a notice holds, wherever they stand.
ERROR_PHRASES = (
    r"page (?:was |could )?not (?:be )?found", r"page cannot be displayed", r"page introuvable", r"resource cannot be found",
    r"internal server error", r"server error in\b", r"whitelabel error page", r"runtime error", r"fatal error:", r"uncaught \w*error",
    r"traceback \(most recent call last\)", r"something went wrong", r"this (?:page|site) (?:isn.t|is not|can.t be) (?:working|reached)",
    r"database connection (?:failed|error)", r"error establishing a database connection", r"request timed out", r"connection (?:timed out|refused|reset)",
    r"session (?:has )?expired", r"access denied", r"account (?:has been )?suspended", r"site (?:is )?under maintenance",
    r"object moved to here", r"(?:page|url|document) (?:that )?you (?:are looking for|requested|have requested)", r"(?:has been|was) moved or deleted", r"rejected by the (?:fire ?wall|server)",
    r"failed to open stream", r"^\W*(?:warning|notice|parse error|deprecated): \w+\(", r"not authori[sz]ed to (?:view|access)", r"do(?:es)? not have permission to (?:view|access)", r"syntax error,? unexpected", r"please wait,? redirecting", r"you are being redirected", r"^err_[a-z_0-9]+$", r"\berror code:? ?\d", r"\bhttp error \d",
    r"पृष्ठ उपलब्ध नहीं", r"पृष्ठ नहीं मिला", r"seite nicht gefunden", r"^index of /",
)
SCRIPT_PHRASES = (
    r"(?:enable|activate|allow|turn on|activer|aktivieren sie) (?:java ?)?scripts?\b", r"(?:java ?script|scripts?) (?:is|are|must be|needs? to be|has to be) (?:disabled|required|enabled|turned|needed|not (?:enabled|available|supported))",
    r"\bjavascript required\b", r"requires? javascript", r"जावास्क्रिप्ट सक्षम", r"\bnoscript\b", r"necessary to allow scripts", r"allow (?:java)?scripts?\b",
    r"(?:checking|verifying) your browser", r"verif(?:y|ying) (?:that )?you are (?:a )?human", r"browser (?:is )?not supported", r"(?:browser )?does(?: not|n.t) support (?:java)?scripts?", r"requires? (?:cookies|scripts?|javascript)", r"javascript to be (?:turned on|enabled)", r"enable cookies",
)
FILLER_PHRASES = (
    r"\blorem ipsum\b", r"\bipsum dolor\b", r"\bdolor sit\b", r"\bconsectetur\b", r"\baenean commodo\b", r"\bsed ut perspiciatis\b", r"\[object object\]",
    r"\bdo not publish\b", r"\btodo:? add\b", r"\b(?:enter|insert|add|type|write) (?:your |the |a )?(?:title|heading|headline|text|name|subject) here\b",
    r"\byour (?:title|heading|headline|text|name|content) here\b", r"यहाँ लिखें", r"\bsample (?:notice|post|job|page) title\b", r"\bdummy (?:entry|text|title|post)\b",
)
#: Filler and failures that count where they are the whole title, or all of it but a short tail.
WHOLE_PARTS = (
    r"placeholder", r"undefined", r"null", r"none", r"nan(?: posts?)?", r"loading", r"untitled(?: document| page| post)?", r"new page(?: \d+)?", r"heading \d+",
    r"hello world", r"title of the post", r"post title", r"title", r"qwerty", r"(?:asdf\s*)+", r"(?:abc\s+)+abc", r"(?:test\s+)+\d*", r"test", r"foo(?: bar(?: baz)?)?",
    r"x{4,}", r"#(?:ref|name|value|n/a)[!?]?", r"just a moment", r"forbidden", r"not found", r"access forbidden", r"unauthori[sz]ed", r"bad gateway", r"service unavailable",
    r"gateway time-?out", r"error", r"error \d+", r"erreur \d+", r"http \d{3}", r"err_[a-z_0-9]+", r"missing: ?[\w.]+", r"coming soon", r"sample(?: text)?", r"dummy",
)

_F = "(?:" + "|".join(FIELD_NAMES) + ")"
_NAME = r"[a-z_][\w]*(?:[.\-][\w]+)*"
_FILTERS = r"(?:\s*\|\s*[\w]+(?::[^{}]*)?)*"
_DOTTED = r"[a-z]\w*(?:[._]\w+)+"
PLACEHOLDERS = (
    rf"\{{\{{[-#/^&!]?\s*{_NAME}{_FILTERS}\s*\}}\}}", rf"[$#]\{{\s*{_NAME}\s*\}}", r"<%[=-]?[^%<>]{1,80}%>", r"<\?(?:=|php)[^?<>]{1,80}\?>", rf"\{{%-?\s*[\w.]+[^%{{}}]{{0,60}}%\}}",
    rf"%%\s*{_NAME}\s*%%", rf"@@\s*{_NAME}\s*@@", rf"\[\[\s*{_NAME}\s*\]\]", r"__[a-z][\w.]*?__", rf"&lt;\s*{_NAME}\s*&gt;", rf"[«]\s*(?:{_DOTTED}|{_F})\s*[»]",
    rf"\{{\s*(?:\d{{1,2}}|{_DOTTED}|{_F}(?:\s+(?:of\s+)?{_F})*)\s*\}}", rf"<\s*(?:{_DOTTED}|{_F}(?:\s+(?:of\s+)?{_F})*)\s*>", rf"<[^<>]{{0,40}}\b{_F}\s+here>",
    rf"\[\s*(?:insert|enter|add|type|fill in)\s+(?:the\s+|your\s+)?(?:{_F}\b)[^\[\]]{{0,40}}\]", rf"\[[^\[\]]{{0,40}}\b{_F}\b[^\[\]]{{0,20}}\b(?:goes here|to be filled|to be inserted|here)\s*\]",
    rf"\(\s*(?:enter|insert)\s+(?:the\s+|your\s+)?(?:{_F}\b)[^()]{{0,40}}\)", rf"\bxx+\s+{_F}(?:\s+(?:of\s+)?{_F})*\s+xx+\b",
    r"(?<![\w$])\$[a-z_]\w*(?:[.]\w+)*", r"(?<![\S])%[sd](?![\w%])", rf"\b(?:name of post|post title|designation|department|number) (?:goes here|to be filled)\b",
)
#: What every placeholder has; a text without needs no further look for one.
_MARKS = r"[{}<>%$@«»]|__|\[\[|&lt;|\[[^\]]{0,60}\b(?:insert|enter|add|type|fill|here|filled|inserted)\b|\(\s*(?:enter|insert)\b|\bxx|goes here|to be filled"
_CODE_BLOCK = r"(?s)```.*?```|`[^`\n]+`|<(?:pre|code)\b.*?</(?:pre|code)>"
#: What explains templates; it must stand near a placeholder. Words that headings use as well ("documentation", "syntax", "tutorial") don't do alone.
_EXPLAINED = r"\b(?:how to (?:use|write)|template (?:language|engine|variable|syntax|tag)s?|(?:in|of|with) (?:the )?templates|placeholders? (?:like|such as)|string interpolation)\b"
_NEAR = r"[^|]{0,40}?"
_ENDS = r"[\s.,!…\"'“”‘’*•»-]*"
_SEP = r"(?:\||::|\s[-–—]\s)"


def _any(patterns: tuple[str, ...]) -> str:
    return "(?:" + "|".join(patterns) + ")"


_STATUS = r"(?:[45]\d\d)"
_FAILED = _any(FAILURES)
STATUS_LINES = (
    rf"\bhttp(?: status)? ?{_STATUS}\b(?:\s*[-–—:]\s*{_FAILED})?", rf"^{_ENDS}{_STATUS}\s*(?:[-–—|:]\s*)?{_FAILED}\b", rf"(?:^|\|){_ENDS}{_FAILED} \({_STATUS}\)",
    rf"^{_ENDS}(?:error|erreur|fehler) {_STATUS}\b", rf"\b{_STATUS}\s*(?:[-–—|:]\s*)?(?:{_FAILED}){_ENDS}(?:{_SEP}|$)",
)


def cleaned(text: Column) -> Column:
    """Lower case, without format characters, white space squeezed; '' for null."""
    low = F.lower(F.regexp_replace(text, r"\p{Cf}+", ""))
    return F.coalesce(F.trim(F.regexp_replace(low, r"[\s\p{Z}]+", " ")), F.lit(""))


def _kind(low: Column) -> Column:
    """The kind of a text that is clean already; each costly grammar runs only where its marks are seen."""
    marked = low.rlike(_MARKS)
    outside = F.when(low.rlike(r"`|<(?:pre|code)\b"), F.trim(F.regexp_replace(low, _CODE_BLOCK, " "))).otherwise(low)
    filled = F.regexp_replace(outside, _any(PLACEHOLDERS), "")
    sparse = (1 - F.length(filled) / F.greatest(F.length(outside), F.lit(1))) < 0.5
    holds = _any(PLACEHOLDERS)
    tutorial = outside.rlike(_EXPLAINED) & outside.rlike(f"{_EXPLAINED}{_NEAR}{holds}|{holds}{_NEAR}{_EXPLAINED}")
    part = rf"^{_ENDS}{_any(WHOLE_PARTS)}{_ENDS}(?:$|{_SEP}(?:\s*[^\s|]+){{0,4}}\s*$)"
    phrase = lambda patterns: outside.rlike(rf"(?<![\p{{L}}\p{{M}}\p{{N}}]){_any(patterns)}")
    return (
        F.when(low == "", None)
        .when(marked & outside.rlike(_any(PLACEHOLDERS)) & ~(tutorial & sparse), "placeholder")
        .when(phrase(SCRIPT_PHRASES), "script")
        .when(phrase((*ERROR_PHRASES, *STATUS_LINES)), "error")
        .when(phrase(FILLER_PHRASES) | outside.rlike(part), "filler")
    )


def residue_kind(text: Column) -> Column:
    """'placeholder', 'filler', 'error', 'script', or null for text that is none of these (null and empty text too)."""
    return _kind(cleaned(text))


def residue(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, kind) of the rows whose text is, or contains, residue. A narrow map: no shuffle, no Python."""
    low = rows.select(F.col(key).alias("key"), cleaned(F.col(text)).alias("low"))
    return low.select(F.col("key").alias(key), _kind(F.col("low")).alias("kind")).filter("kind is not null")


def without_residue(rows: DataFrame, text: str) -> DataFrame:
    """rows without those that hold residue; null and empty texts stay."""
    return rows.filter(residue_kind(F.col(text)).isNull())
