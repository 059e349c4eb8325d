"""Text functions as Column expressions; what needs Unicode normalization is an Arrow-batched function.

White space is Unicode white space, as the engine's sources hold no-break and ideographic spaces. Positions are
0-based with exclusive ends unless said otherwise, and count code points.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SPACES = r"(?U)\s+"
# Heading forms of policy texts.
ARTICLE = r"제\s*(\p{Nd}+(?:-\p{Nd}+)?)\s*조(?:\s*의\s*(\p{Nd}+))?\s*"
MARKED_ARTICLE = rf"^###\s*{ARTICLE}(?:\[(.+)\]|\(((?:[^()]|\([^()]*\))*)\))\s*$"
PLAIN_ARTICLE = rf"^{ARTICLE}(?:\[([^\[\]]+)\]|\(((?:[^()]|\([^()]*\))*)\))\s*$"
SECTION = r"^(?:##\s*)?제\s*(\p{Nd}+)\s*(편|장|절|관)(?![\p{L}\p{N}_])\s*(.*?)\s*$"
CONTENTS_TAIL = r"\s\d{1,4}$|제\s*\d+(?:-\d+)?\s*조"
FIGURE = r"[a-z]*\d[\d,.]*[a-z가-힣%]*"
MIDDLE_DOTS = "∙ㆍ•‧·"


def let(value: Column, body) -> Column:
    """body of the value, which is computed once however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def trimmed(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def squashed(text: Column) -> Column:
    """Lower case without white space."""
    return F.regexp_replace(F.lower(text), SPACES, "")


def lines_of(text: Column) -> Column:
    """Lines as in universal line splitting; a final line end opens no further line."""
    parts = F.split(text, "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085\u2028\u2029]")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def clean_text(text: Column) -> Column:
    """No-break spaces become spaces, NULs go, runs of blanks become one, lines lose trailing blanks and the text outer white space."""
    plain = F.replace(F.replace(text, F.lit("\u00a0"), F.lit(" ")), F.lit("\u0000"), F.lit(""))
    return trimmed(F.regexp_replace(F.regexp_replace(plain, r"[ \t]+", " "), r"(?m) +$", ""))


def clean_cell(text: Column) -> Column:
    return F.regexp_replace(F.replace(clean_text(text), F.lit("|"), F.lit("\\|")), r"\s*\n\s*", "<br>")


def policy_headings(text: Column) -> Column:
    """Hierarchy headings become level 2 and whole-line article headings level 3, whatever marks they had."""
    line = lambda x: F.regexp_replace(x, r"^\s*#+\s*", "")

    def one(x: Column) -> Column:
        bare = line(x)
        is_article = bare.rlike(PLAIN_ARTICLE)
        is_section = bare.rlike(SECTION) & ~bare.rlike(CONTENTS_TAIL)
        return F.when(is_article, F.concat(F.lit("### "), bare)).when(is_section, F.concat(F.lit("## "), bare)).otherwise(x)

    return F.array_join(F.transform(F.split(text, "\n"), one), "\n")


COVER_CODE = r"^[A-Z]{1,6}\d{3,}(?:\([0-9]{2,10}\))?$"
COVER_END = r"^제\s*\d+\s*관(?![\p{L}\p{N}_])"


def cover_page(lines: Column) -> Column:
    """Lines with a mini cover styled: code, name as heading, description as quote, up to the first group heading.

    A cover is a code line first, then a name, then lines from the first note mark on as description; lines without
    this shape stay as they are.
    """
    at = F.array_position(F.transform(lines, lambda x: x.rlike(COVER_END)), True).cast("int")
    above = F.filter(F.slice(lines, F.lit(1), F.greatest(at - 1, F.lit(0))), lambda x: x != "")
    code, body = F.get(above, F.lit(0)), F.slice(above, F.lit(2), F.greatest(F.size(above) - 1, F.lit(0)))
    note = F.array_position(F.transform(body, lambda x: x.startswith("※")), True).cast("int")
    names = F.when(note > 0, F.slice(body, F.lit(1), note - 1)).otherwise(body)
    notes = F.when(note > 0, F.slice(body, note, F.size(body))).otherwise(F.array().cast("array<string>"))
    title = F.transform(names, lambda x, i: F.when(i == 0, F.concat(F.lit("# "), x)).otherwise(x))
    quoted = F.when(F.size(notes) > 0, F.concat(F.array(F.lit("")), F.transform(notes, lambda x: F.concat(F.lit("> "), x)))).otherwise(notes)
    styled = F.concat(F.array(F.concat(F.lit("**보험코드:** "), code), F.lit("")), title, quoted, F.array(F.lit("")), F.slice(lines, F.greatest(at, F.lit(1)), F.size(lines)))
    return F.when((at > 1) & F.coalesce(code.rlike(COVER_CODE), F.lit(False)) & (F.size(names) > 0), styled).otherwise(lines)


# Lines of converted pages that become headings, lists and paragraphs, and standalone page numbers.
MARKDOWN_SECTION = r"(?U)^제\s*\d+\s*[장편관](?:$|[^\p{L}\p{N}_])"
MARKDOWN_ARTICLE = r"(?U)^제\s*\d+\s*조(?:\s*의\s*\d+)?(?:\s*[(\[][^)\]]*[)\]])?\s*$"
BULLET = r"(?U)^[●■◆▶▣□◦ㆍ∙]\s*"
NUMBERED = r"(?U)^(?:㈜\s*)?\d+\.\s+\S"
CIRCLED = "^[①-⑳]"
PAGE_NUMBER = r"(?U)^(?:[-–—]?\s*\d+\s*[-–—]?|\d+\s*/\s*\d+)$"


def markdown_lines(text: Column) -> Column:
    """Lines of a converted text as Markdown: cover page, headings, lists, a paragraph for every circled number; page numbers go, blanks collapse."""
    lines = cover_page(F.transform(lines_of(clean_text(text)), trimmed))

    def tokens(x: Column) -> Column:
        item = lambda y: F.array(F.concat(F.lit("- "), y))
        head = lambda mark: F.array(F.concat(F.lit(mark), x), F.lit(""))
        return (
            F.when((x == "") | x.rlike(PAGE_NUMBER), F.array(F.lit("")))
            .when(x.rlike(MARKDOWN_SECTION), head("## "))
            .when(x.rlike(MARKDOWN_ARTICLE), head("### "))
            .when(x.rlike(CIRCLED), F.array(F.lit(""), x))
            .when(x.rlike(NUMBERED), item(x))
            .when(x.rlike(BULLET), item(F.regexp_replace(x, BULLET, "")))
            .otherwise(F.array(x))
        )

    # Of a run of blanks the first stays, none at either end.
    once = let(F.flatten(F.transform(lines, tokens)), lambda flat: F.filter(flat, lambda x, i: (x != "") | F.coalesce(F.get(flat, i - 1) != "", F.lit(False))))
    return let(once, lambda o: F.when(F.try_element_at(o, F.lit(-1)) == "", F.slice(o, F.lit(1), F.size(o) - 1)).otherwise(o))


def article_heading(line: Column) -> Column:
    """struct(article_no, sub_no, title) of an article heading, null for any other line."""
    bare = trimmed(line)
    pattern = F.when(bare.startswith("###"), F.lit(1)).otherwise(F.lit(0))

    def group(k: int) -> Column:
        return F.nullif(F.when(pattern == 1, F.regexp_extract(bare, MARKED_ARTICLE, k)).otherwise(F.regexp_extract(bare, PLAIN_ARTICLE, k)), F.lit(""))

    hit = bare.rlike(MARKED_ARTICLE) | bare.rlike(PLAIN_ARTICLE)
    title = F.coalesce(group(3), group(4), F.lit(""))
    return F.when(hit, F.struct(group(1).alias("article_no"), group(2).alias("sub_no"), title.alias("title")))


def section_heading(line: Column) -> Column:
    """struct(level, no, title) of a hierarchy heading; lines of a table of contents are none."""
    bare = trimmed(line)
    title = F.regexp_extract(bare, SECTION, 3)
    found = F.struct(F.regexp_extract(bare, SECTION, 2).alias("level"), F.regexp_extract(bare, SECTION, 1).alias("no"), title.alias("title"))
    return F.when(bare.rlike(SECTION) & ~title.rlike(CONTENTS_TAIL), found)


def body_text(lines: Column) -> Column:
    """Lines joined without page breaks and page markers."""
    kept = F.filter(lines, lambda x: (trimmed(x) != "---") & ~trimmed(x).startswith("<!-- page:"))
    return trimmed(F.array_join(kept, "\n"))


def rider_name_key(name: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(trimmed(name), r"^#+", ""), SPACES, "")
    bare = F.regexp_replace(bare, "약관$", "")
    return F.translate(bare, MIDDLE_DOTS, "")


def brackets_balance(text: Column) -> Column:
    count = lambda c: F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))
    return (count("(") == count(")")) & (count("[") == count("]"))


def bigrams(text: Column) -> Column:
    """Distinct runs of two characters."""
    steps = F.when(F.length(text) >= 2, F.sequence(F.lit(1), F.length(text) - 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(steps, lambda i: F.substr(text, i, F.lit(2))))


def fact_stated(fact: Column, text: Column) -> Column:
    """Every figure of the fact occurs, and enough of its two-character runs: half beside a figure, four fifths without.

    A fact with fewer than three such runs must occur as it is.
    """
    a, b = squashed(fact), squashed(text)
    figures = F.transform(F.regexp_extract_all(F.lower(fact), F.lit(FIGURE), F.lit(0)), lambda x: F.regexp_replace(x, SPACES, ""))
    grams = bigrams(a)
    share = F.size(F.filter(grams, lambda g: F.contains(b, g))) / F.size(grams)
    enough = F.when(F.size(grams) < 3, F.contains(b, a)).otherwise(share >= F.when(F.size(figures) > 0, 0.5).otherwise(0.8))
    return F.forall(figures, lambda x: F.contains(b, x)) & enough


def find(text: Column, part: Column, start: Column | None = None) -> Column:
    """0-based position of the first occurrence at or after start, null where there is none or the part is empty."""
    at = F.call_function("locate", part, text, F.lit(1) if start is None else start + 1)
    return F.when((at > 0) & (F.length(part) > 0), at - 1)


def line_span(text: Column, quote: Column) -> Column:
    """struct(line_start, line_end), 1-based and inclusive, of the first occurrence of the quote."""
    at = find(text, quote)
    breaks = lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))
    first = 1 + breaks(F.substr(text, F.lit(1), at))
    return F.when(at.isNotNull(), F.struct(first.alias("line_start"), (first + breaks(quote)).alias("line_end")))


def items_in_range(items: Column, start: Column, end: Column) -> Column:
    """Indices (from 0) of the items, laid end to end, that [start, end) touches; empty ones count where they lie within it."""
    none = F.lit(-1)

    def step(acc: Column, x: Column) -> Column:
        upto = acc["upto"] + F.length(x)
        hit = (acc["upto"] < end) & (upto > start)
        return F.struct(upto.alias("upto"), (acc["k"] + 1).alias("k"), F.when(hit & (acc["first"] < 0), acc["k"]).otherwise(acc["first"]).alias("first"), F.when(hit, acc["k"]).otherwise(acc["last"]).alias("last"))

    # Items that a range touches stand side by side, so the first and the last of them are enough.
    seen = F.aggregate(items, F.struct(F.lit(0).alias("upto"), F.lit(0).alias("k"), none.alias("first"), none.alias("last")), step)
    return let(seen, lambda s: F.when(s["first"] >= 0, F.sequence(s["first"], s["last"])).otherwise(F.array().cast("array<int>")))


def match_key(text: Column) -> Column:
    """Line without heading, bullet and quote marks, decoration and white space."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"^#{1,6}\s*", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"^[-*]\s+", ""), r"^>\s?", "")
    return F.regexp_replace(F.regexp_replace(bare, r"[|*`_]", ""), SPACES, "")


def search_key(text: Column) -> Column:
    return trimmed(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), SPACES, " "))


def question_key(text: Column) -> Column:
    return trimmed(F.regexp_replace(F.lower(text), SPACES, " "))


def prefix_match(haystack: Column, needle: Column, prefix: int = 20) -> Column:
    """struct(start, end) of the needle, or else of its first characters where it is longer than those."""
    whole, short = find(haystack, needle), find(haystack, F.substr(needle, F.lit(1), F.lit(prefix)))
    return F.when(whole.isNotNull(), F.struct(whole.alias("start"), (whole + F.length(needle)).alias("end"))).when(
        (F.length(needle) > prefix) & short.isNotNull(), F.struct(short.alias("start"), (short + prefix).alias("end"))
    )


def article_parts(number: Column) -> Column:
    return F.transform(F.split(number, "-"), lambda x: x.cast("int"))


def is_first_article(number: Column, sub: Column) -> Column:
    return sub.isNull() & ((number == "1") | number.rlike(r"^\d+-1$"))


def node_text(label: Column, detail: Column) -> Column:
    return F.when(F.length(detail) > 0, F.concat(label, F.lit(": "), detail)).otherwise(label)


def item_text(said: Column, properties: Column, evidence: Column) -> Column:
    """What an item says with its property values and the wording it quotes."""
    values = F.coalesce(F.map_values(properties), F.array().cast("array<string>"))
    return F.array_join(F.concat(F.array(F.coalesce(said, F.lit(""))), F.transform(values, lambda v: F.coalesce(v, F.lit("None"))), F.array(F.coalesce(evidence, F.lit("")))), " ")


def edge_text(detail: Column, source_label: Column, type_: Column, target_label: Column) -> Column:
    """The detail of an edge, else its two ends and its type."""
    return F.when(F.length(detail) > 0, detail).otherwise(F.concat(F.coalesce(source_label, F.lit("")), F.lit(" "), F.coalesce(type_, F.lit("")), F.lit(" "), F.coalesce(target_label, F.lit(""))))


def length_guarded(text: Column, most: int = 1_000_000) -> Column:
    """The text; one longer than `most` characters raises."""
    return F.when(F.length(text) > most, F.raise_error(F.concat(F.lit("text too long: "), F.length(text).cast("string")))).otherwise(text)


def file_stem(name: Column) -> Column:
    """File name without directory and last extension, in lower case."""
    return F.lower(F.regexp_replace(F.regexp_extract(name, r"([^/\\]*)$", 1), r"(?<=.)\.[^.]*$", ""))


def fingerprint(parts: dict[str, Column]) -> Column:
    """SHA-256 over the JSON of the parts in the order of their names."""
    return F.sha2(F.to_json(F.struct(*(parts[k].alias(k) for k in sorted(parts)))), 256)


@F.pandas_udf(StringType())
def name_key(names: pd.Series) -> pd.Series:
    """Compatibility form, case-folded; null stays null."""
    import unicodedata

    return names.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x).casefold())


def safe_file_name(name: Column, limit: int = 180) -> Column:
    return F.substr(trimmed(F.regexp_replace(F.regexp_replace(name, r'[\\/:*?"<>|\x00-\x1f]', "_"), SPACES, " ")), F.lit(1), F.lit(limit))
