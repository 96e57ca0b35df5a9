"""Column functions over text: tokens, keys, scripts, html, subjects, names, globs."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltwork import schema

#: A word as Unicode sees it; Java's \\w is ASCII only.
TOKEN = r"[\p{L}\p{N}_]+"


def tokenize(c: Column) -> Column:
    """Lower-cased words; null text has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(TOKEN), F.lit(0))


def text_key(c: Column) -> Column:
    """Identity of a text up to white space and case."""
    squeezed = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)[\s\x1c-\x1f]+", " "), "^ | $", "")
    return F.sha2(F.lower(squeezed), 256)


def chunk_id(digest: Column, page: Column, pos: Column) -> Column:
    return F.left(F.sha2(F.concat_ws(":", digest, page, pos), 256), F.lit(16))


def truncate(c: Column, limit: int) -> Column:
    """The first limit characters and a note of the whole length, where that is larger."""
    note = F.concat(F.left(c, F.lit(limit)), F.lit("\n\n[... truncated, "), F.length(c).cast("string"), F.lit(" characters in total]"))
    return F.when(F.length(c) <= limit, c).otherwise(note)


def carry_tail(previous: Column, overlap: int) -> Column:
    """The last overlap characters, from the first word that starts there; empty if none does."""
    if overlap <= 0:
        return F.lit("")
    tail = F.right(previous, F.lit(overlap))
    at = F.instr(tail, " ")
    cut = F.when(F.length(previous) <= overlap, tail).when(at > 0, F.substring(tail, at + 1, F.length(tail))).otherwise("")
    return F.coalesce(strip(cut), F.lit(""))


def strip(c: Column) -> Column:
    """Without white space at either end, as Unicode sees it."""
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def collapse_blank_lines(c: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(c, r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n"))


#: What html leaves behind, and its entities, both in the order they are replaced.
HTML_TAGS = ((r"(?is)<(script|style|head).*?</\1>", " "), (r"(?i)<br\s*/?>", "\n"), (r"(?i)</(p|div|tr|li|h[1-6])>", "\n"), (r"(?i)</t[dh]>", "\t"), (r"(?s)<[^>]+>", ""))
HTML_ENTITIES = (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"))


def html_to_text(html: Column) -> Column:
    """Text of a mail's html: blocks end lines, cells end with tabs, entities are replaced in a fixed order."""
    c = F.coalesce(html, F.lit(""))
    for pattern, to in HTML_TAGS:
        c = F.regexp_replace(c, pattern, to)
    for entity, to in HTML_ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(to))
    return collapse_blank_lines(c)


#: Prefixes of replies and forwards.
SUBJECT_PREFIXES = "re|fwd?|fw|aw|sv|вх|отв|пересыл|перес|відп|пересил|답장|전달"


def normalize_subject(c: Column) -> Column:
    """Without reply prefixes, however many."""
    return strip(F.regexp_replace(F.coalesce(c, F.lit("")), rf"(?iuU)^(\s*({SUBJECT_PREFIXES})\s*(\[\d+\])?\s*:\s*)+", ""))


def _count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


#: The letters that tell the languages of mails apart.
CYRILLIC, LATIN, HANGUL, UKRAINIAN = "[а-яА-ЯёЁіїєґІЇЄҐ]", "[a-zA-Z]", "[가-힣]", "[іїєґІЇЄҐ]"


def detect_lang(text: Column) -> Column:
    """ru, uk, en, ko or mixed by shares of letters; empty without letters."""
    c = F.coalesce(text, F.lit(""))
    cyr, lat, kor = _count(c, CYRILLIC), _count(c, LATIN), _count(c, HANGUL)
    total, top = cyr + lat + kor, F.greatest(cyr, lat, kor)
    return (
        F.when(total == 0, "").when(top / F.greatest(total, F.lit(1)) < schema.LANG_SHARE, "mixed")
        .when((cyr == top) & c.rlike(UKRAINIAN), "uk").when(cyr == top, "ru").when(lat == top, "en").otherwise("ko")
    )


#: Letters of each script, in the order that settles ties.
SCRIPTS = (("cyrillic", "[а-яіїєґёА-ЯІЇЄҐЁ]"), ("latin", "[a-zA-Z]"), ("hangul", "[가-힯ᄀ-ᇿ]"), ("han", "[一-鿿]"), ("kana", "[぀-ヿ]"))
RERANKED_SCRIPTS = ("latin", "han", "cyrillic")


def script_of(text: Column) -> Column:
    """The script with most letters; latin without any."""
    c = F.coalesce(text, F.lit(""))
    counts = [(name, _count(c, pattern)) for name, pattern in SCRIPTS]
    most = F.greatest(*[n for _, n in counts])
    out = F.when(most == 0, "latin")
    for name, n in counts:
        out = out.when(n == most, name)
    return out


def unsupported_script(script: Column) -> Column:
    """A note where the reranker can't judge the script, else null."""
    return F.when(~script.isin(*RERANKED_SCRIPTS), F.concat(F.lit("scores for "), script, F.lit(" are not reliable")))


def is_bulk(list_unsubscribe: Column, list_id: Column, list_post: Column, precedence: Column, auto_submitted: Column) -> Column:
    some = lambda c: F.coalesce(c, F.lit("")) != ""
    told = F.lower(F.trim(F.coalesce(precedence, F.lit("")))).isin("bulk", "list", "junk", "auto_reply")
    return some(list_unsubscribe) | some(list_id) | some(list_post) | told | (some(auto_submitted) & (F.lower(auto_submitted) != "no"))


def attachment_folder(message_id: Column) -> Column:
    return F.left(F.regexp_replace(message_id, r"[^\p{L}\p{N}_.\-]", "_"), F.lit(80))


def safe_name(raw: Column) -> Column:
    """A file name that can't leave its folder."""
    base = F.replace(F.regexp_extract(F.regexp_replace(F.coalesce(raw, F.lit("")), "/+$", ""), "([^/]*)$", 1), F.lit("\\"), F.lit("_"))
    kept = F.regexp_replace(F.regexp_replace(base, r"(?U)[^\p{L}\p{N}_\s.\-()\[\]«»]", "_"), "^[ .]+|[ .]+$", "")
    return F.when(kept == "", "attachment").otherwise(F.left(kept, F.lit(150)))


def report_name(raw: Column) -> Column:
    base = F.regexp_extract(F.coalesce(raw, F.lit("")), "([^/]*)$", 1)
    named = F.when(base == "", "report.md").otherwise(base)
    return F.when(named.endswith(".md"), named).otherwise(F.concat(named, F.lit(".md")))


#: Headings that a report needs.
SECTIONS = (("Conclusions", r"(?imuU)^#{1,4}\s*\d*\.?\s*(conclusions?|висновк\w*|выводы)\b"), ("Sources", r"(?imuU)^#{1,4}\s*\d*\.?\s*(sources?|references?|джерела|источники)\b"))


def missing_sections(content: Column) -> Column:
    return F.array_compact(F.array(*[F.when(~F.coalesce(content, F.lit("")).rlike(p), name) for name, p in SECTIONS]))


def glob_regex(glob: str) -> str:
    """A case-insensitive expression for a whole name: * and ? cross everything, [seq] and [!seq] are classes."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        end = glob.find("]", i + 2 + (glob[i + 1 : i + 2] == "!")) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif end > 0:
            inner = glob[i + 1 : end].replace("\\", "\\\\")
            out += "[" + ("^" + inner[1:] if inner[0] == "!" else inner.replace("^", "\\^")) + "]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return f"(?is)^(?:{out})$"


def matches_glob(name: Column, globs: tuple[str, ...] | list[str]) -> Column:
    out = F.lit(False)
    for g in globs:
        out = out | name.rlike(glob_regex(g))
    return F.coalesce(out, F.lit(False))


def address_regex(pattern: str) -> str:
    """What an address matches: the glob on the address or its domain; without *, the domain and its subdomains."""
    glob = glob_regex(pattern.lower())[5:-1]
    own = "" if "*" in pattern else rf"|(?:.*@)?(?:.*\.)?{re.escape(pattern.lower())}"
    return rf"(?is)^(?:(?:.*@)?{glob}{own})$"


def stem_regex(stem: str) -> str:
    """A word that starts with the stem."""
    return r"(?iuU)\b\Q" + stem.strip().replace("\\E", "") + r"\E"


def decode_folder(name: Column) -> Column:
    """A mail folder's name from modified UTF-7: &...- holds base64 of UTF-16, with a comma for the slash; &- is an ampersand."""
    parts = F.regexp_extract_all(name, F.lit("&[^-]*-|[^&]+|&[^-]*$"), F.lit(0))
    coded = lambda p: F.replace(F.substring(p, F.lit(2), F.length(p) - 2), F.lit(","), F.lit("/"))
    plain = F.transform(parts, lambda p: F.when(p == "&-", "&").when(p.startswith("&") & p.endswith("-"), F.decode(F.unbase64(coded(p)), "UTF-16BE")).otherwise(p))
    return F.array_join(plain, "")


def address_json(emails: Column, names: Column) -> Column:
    """Arrays of addresses and names as JSON text; missing ones as an empty list."""
    both = F.arrays_zip(F.coalesce(emails, F.array().cast("array<string>")).alias("email"), F.coalesce(names, F.array().cast("array<string>")).alias("name"))
    return F.to_json(F.transform(both, lambda x: F.struct(x["email"].alias("email"), F.coalesce(x["name"], F.lit("")).alias("name"))))


def addresses_of(c: Column) -> Column:
    """(email, name) from JSON text; text that is not such a list is an empty one."""
    return F.coalesce(F.from_json(c, "array<struct<email:string,name:string>>"), F.array().cast("array<struct<email:string,name:string>>"))


def emails_of(c: Column) -> Column:
    """Lower-cased addresses from JSON text, empty ones left out."""
    return F.filter(F.transform(addresses_of(c), lambda a: F.lower(F.coalesce(a["email"], F.lit("")))), lambda e: e != "")


def index_names(raw: Column, fallback: str) -> Column:
    """Distinct names of a comma list in their order; the fallback where it has none."""
    names = F.array_distinct(F.filter(F.transform(F.split(F.coalesce(raw, F.lit("")), ","), lambda n: F.trim(n)), lambda n: n != ""))
    return F.when(F.size(names) > 0, names).otherwise(F.array(F.lit(fallback)))


def thread_root(given: Column, references: Column, in_reply_to: Column, message_id: Column) -> Column:
    some = lambda c: F.when(c != "", c)
    return F.coalesce(some(given), some(F.get(references, F.lit(0))), F.when(F.size(F.coalesce(references, F.array())) <= 0, some(in_reply_to)), message_id)


def synthetic_id(date: Column, sender: Column, subject: Column) -> Column:
    """The same for the same mail in every process."""
    return F.concat(F.lit("<synthetic-"), F.left(F.sha2(F.concat_ws("|", date, sender, subject), 256), F.lit(16)), F.lit("@local>"))


def domain_of(email: Column) -> Column:
    return F.when(F.instr(email, "@") > 0, F.lower(F.substring_index(email, "@", -1))).otherwise("")


def clamp(value: Column, low: int, high: int, default: int) -> Column:
    return F.least(F.greatest(F.coalesce(value.try_cast("int"), F.lit(default)), F.lit(low)), F.lit(high))


def title_excerpt(c: Column, n: int = schema.SNIPPET) -> Column:
    return F.left(F.coalesce(c, F.lit("")), F.lit(n))
