"""Scalar text functions as column expressions. White space is spelled out, so that it's the same everywhere."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of this library (fixed value): blank, tab, line ends, vertical tab, no-break space.
SPACE = r"[ \t\r\n\f\x0b\xa0]"


def let(value: Column, then) -> Column:
    """then(value), the value computed once a row however often it's used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def squeezed(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.regexp_replace(F.regexp_replace(text, f"{SPACE}+", " "), "^ | $", "")


def search_term(text: Column, most: int = 80) -> Column:
    return F.substring(squeezed(F.coalesce(text, F.lit(""))), 1, most)


def cleaned(text: Column) -> Column:
    """No carriage returns, blanks collapsed, at most two line ends together, trimmed."""
    text = F.regexp_replace(text, "\r", "")
    text = F.regexp_replace(text, "[ \t\xa0]+", " ")
    return F.regexp_replace(F.regexp_replace(text, "\n{3,}", "\n\n"), f"^{SPACE}+|{SPACE}+$", "")


def without_controls(text: Column) -> Column:
    return squeezed(F.regexp_replace(text, r"[\x00-\x1f\x7f\x{fffd}]", " "))


def without_links(text: Column) -> Column:
    """Markdown images and links as their text."""
    return F.regexp_replace(F.regexp_replace(text, r"!\[([^\]]*)\]\([^)]*\)", "$1"), r"\[([^\]]*)\]\([^)]*\)", "$1")


def without_marker(text: Column) -> Column:
    """A line without its bullet, number or heading marks."""
    return squeezed(F.regexp_replace(text, r"^[ \t\xa0]*(#+[ \t]*|[-*\x{2022}\x{25aa}\x{25cf}]+[ \t]*|[0-9]{1,3}[.)][ \t]+)", ""))


def without_citations(text: Column) -> Column:
    """No bracketed lists of numbers such as [1, 2]; quantities such as [1/2] stay."""
    return squeezed(F.regexp_replace(text, r"\[[0-9]+([ ]*[,\x{2013}-][ ]*[0-9]+)+\]", ""))


#: Written fractions and their signs (fixed values).
FRACTIONS = {"1/2": "½", "1/3": "⅓", "2/3": "⅔", "1/4": "¼", "3/4": "¾", "1/8": "⅛", "3/8": "⅜", "5/8": "⅝", "7/8": "⅞"}
#: Units before which a percent sign is a misread half (fixed values).
UNITS = "cups?|tsp|tbsp|teaspoons?|tablespoons?|oz|lb|g|kg|ml|l"


def with_fractions(text: Column) -> Column:
    """Fractions as signs, Ib as lb, spoons without plural."""
    text = reduce(lambda t, x: F.regexp_replace(t, r"\b" + x[0].replace("/", " ?/ ?") + r"\b", x[1]), FRACTIONS.items(), text)
    text = F.regexp_replace(F.regexp_replace(text, r"(?i)\bIbs\b", "lbs"), r"\bIb\b", "lb")
    return F.regexp_replace(F.regexp_replace(text, r"(?i)\btsps?\b", "tsp"), r"(?i)\btbsps?\b", "tbsp")


def with_halves(text: Column) -> Column:
    """A percent sign read for a half, only before a unit."""
    return F.regexp_replace(text, rf"%(?=[ ]*({UNITS})\b)", "½")


def slug(text: Column) -> Column:
    """Lower case, every run of other characters than letters and digits as one blank; null if nothing is left."""
    return F.nullif(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), "^ | $", ""), F.lit(""))


def file_title(name: Column) -> Column:
    """A file's name as a title: no extension, no copy number, blanks for marks."""
    name = F.regexp_replace(name, r"\.[A-Za-z0-9]{1,5}$", "")
    return squeezed(F.regexp_replace(F.regexp_replace(name, r"\([0-9]+\)", " "), "[_-]+", " "))


def first_filled(*values: Column) -> Column:
    """The first value that is neither null nor blank."""
    return F.coalesce(*(F.nullif(squeezed(v), F.lit("")) for v in values), F.lit(None).cast("string"))


def stars(rating: Column, most: int = 5) -> Column:
    full = F.least(F.greatest(F.coalesce(F.round(rating).cast("int"), F.lit(0)), F.lit(0)), F.lit(most))
    return F.concat(F.expr("repeat('★', 0)"), F.repeat(F.lit("★"), full), F.repeat(F.lit("☆"), F.lit(most) - full))


def iso_date(text: Column) -> Column:
    """DD-MM-YYYY as a date; null where there's no such day."""
    good = text.rlike("^[0-9]{2}-[0-9]{2}-[0-9]{4}$")
    return F.when(good, F.try_to_timestamp(text, F.lit("dd-MM-yyyy"))).cast("date")


def shown_date(date: Column) -> Column:
    return F.date_format(date, "dd-MM-yyyy")


def escaped(text: Column) -> Column:
    """Text for HTML."""
    return reduce(lambda t, x: F.replace(t, F.lit(x[0]), F.lit(x[1])), [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")], text)


#: Entities that are read (fixed values); the ampersand comes last.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&amp;": "&"}


def unescaped_twice(text: Column) -> Column:
    """Entities read, and those that appear by it."""
    return unescaped(unescaped(text))


def unescaped(text: Column) -> Column:
    return reduce(lambda t, x: F.replace(t, F.lit(x[0]), F.lit(x[1])), ENTITIES.items(), text)


def html_text(html: Column) -> Column:
    """HTML as lines of text: no scripts, styles or comments; blocks and list items on lines of their own."""
    for tag in ("script", "style", "noscript", "template"):
        html = F.regexp_replace(html, f"(?is)<{tag}[^>]*>.*?</{tag}>", " ")
    html = F.regexp_replace(html, "(?s)<!--.*?-->", " ")
    html = F.regexp_replace(html, r"(?i)<br[ ]*/?>|</(p|div|li|h[1-6]|tr|section|article|header|footer|ul|ol)>|<li[^>]*>", "\n")
    text = unescaped(F.regexp_replace(html, "<[^>]*>", " "))
    text = F.regexp_replace(F.regexp_replace(text, "[ \t\r\f\xa0]+", " "), " ?\n ?", "\n")
    return F.regexp_replace(F.regexp_replace(text, "\n{2,}", "\n"), f"^{SPACE}+|{SPACE}+$", "")


def safe_html(html: Column) -> Column:
    """No scripts, event handlers or script addresses."""
    html = F.regexp_replace(html, "(?is)<script[^>]*>.*?</script>", "")
    html = F.regexp_replace(html, r"""(?i) on[a-z]+[ ]*=[ ]*("[^"]*"|'[^']*'|[^ >]+)""", "")
    return F.regexp_replace(html, r"(?i)javascript:", "")


#: Unicode blocks and their languages (fixed values) are listed in the function.
def language_by_block(text: Column) -> Column:
    """The language by Unicode block; Devanagari is Marathi with its own letter, else Hindi; else English."""
    blocks = [("0980", "09FF", "Bengali"), ("0A00", "0A7F", "Punjabi"), ("0A80", "0AFF", "Gujarati"), ("0B80", "0BFF", "Tamil"), ("0C00", "0C7F", "Telugu"), ("0C80", "0CFF", "Kannada"), ("0D00", "0D7F", "Malayalam"), ("0600", "06FF", "Arabic"), ("3040", "30FF", "Japanese"), ("AC00", "D7AF", "Korean"), ("4E00", "9FFF", "Chinese"), ("0400", "04FF", "Russian")]
    out = F.when(text.rlike(r"[\x{0900}-\x{097F}]"), F.when(text.contains("ळ"), "Marathi").otherwise("Hindi"))
    for a, b, name in blocks:
        out = out.when(text.rlike(rf"[\x{{{a}}}-\x{{{b}}}]"), name)
    return out.otherwise("English")


def words(text: Column) -> Column:
    return F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")


def sentences(text: Column) -> Column:
    return F.filter(F.split(text, r"(?<=[.!?])[ \n]+"), lambda s: s != "")


def letter_share(text: Column) -> Column:
    """Letters by characters, 0 for an empty text."""
    return F.length(F.regexp_replace(text, r"[^\p{L}]", "")) / F.greatest(F.lit(1), F.length(text))


def title_and_yield(name: Column) -> list[Column]:
    """[title, servings] of a name such as "Dal serves 4"."""
    pattern = r"(?i)^(.*[^ ])[ ]+((?:serves|makes|yields?)[ ]+[0-9].*)$"
    has = name.rlike(pattern)
    return [F.when(has, F.regexp_extract(name, pattern, 1)).otherwise(name), F.when(has, F.regexp_extract(name, pattern, 2)).otherwise("")]


def category(name: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The category of the first rule whose words occur."""
    out = None
    for pattern, value in rules:
        hit = F.lower(name).rlike(pattern)
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(default)


def capped(text: Column, most: int = 100, share: float = 0.65) -> Column:
    """At most so many words: cut at the last sentence end if that keeps enough, else with an ellipsis."""
    end = lambda short: F.length(short) - F.length(F.regexp_extract(short, r"[^.!?]*$", 0))
    cut = lambda short: let(end(short), lambda n: F.when(n >= F.length(short) * share, F.substring(short, F.lit(1), n)).otherwise(F.concat(short, F.lit("…"))))
    # Only the text's beginning is split: so many words, each with white space behind it.
    head = F.regexp_extract(text, rf"^{SPACE}*(?:[^ \t\r\n\f\x0b\xa0]+{SPACE}+){{0,{most}}}", 0)
    short = let(head, lambda h: F.when(F.length(h) < F.length(text), let(words(h), lambda w: F.when(F.size(w) == most, F.array_join(w, " ")))))
    return let(short, lambda s: F.when(s.isNull(), text).otherwise(cut(s)))
