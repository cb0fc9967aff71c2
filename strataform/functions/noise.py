"""Tests and repairs of single lines: noise of pages and scans, what a line looks like.

Patterns are the values that the tests must agree on (fixed values).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strataform.functions.text import let, squeezed, words

#: Whole lines of a page's own controls and counters.
PAGE_NOISE = (
    r"(?i)^([0-9]+ (ratings?|reviews?) ?\| ?rate now|rate now|print|share|save|masterclass certificates?|certificates?)$",
    r"(?i)^[0-9]+ ?(min|mins|minutes|hr|hrs|hours)$",
    r"(?i)^(prep|cook|total) ?time ?[:-]? ?[0-9]+ ?(min|mins|minutes|hr|hrs|hours)$",
    r"(?i)^(ratings?|reviews?) ?[:-]? ?[0-9]+$",
)
NUTRITION = (
    r"(?i)^(nutrition( ?: ?(per serving)?)?|units?|metric us|keep the screen awake.*|good food app.*|ad|low|high) ?:?",
    r"(?i)^(kcal|calories?|fat|saturates?|carbs?|carbohydrates?|sugars?|fibre|fiber|protein|salt)\b",
)
GENERIC = r"(?i)^(recipes?|ingredients?|method|directions?|instructions?|preparation|steps?|contents?|index|introduction|notes?|tips?|storage|serving suggestions?|long-term preservation methods?|for the .+|for .+)[:.]?$"
CALLS = r"(?i)\b(follow|subscribe|like|share|save|comment|link in bio|learn more|ends in)\b"
SCAN_UNIT = r"(?i)\b(cup|tsp|tbsp|lb|oz|g|kg|ml|l)\b"
UNIT = r"(?i)\b(cups?|tsp|tbsp|teaspoons?|tablespoons?|oz|lbs?|g|kg|ml|l|cloves?|pinch|inch)\b"
SCRIPT_TAG = r"(?i)</?(script|style|noscript|iframe)\b"
TRACKER = r"(?i)(window\.|document\.|google_(tags|analytics)|gtag ?\(|dataLayer|__NEXT_DATA__|googletagmanager|pagead|doubleclick|ojra\.net|bat\.bing\.com)"
STEP = r"(?i)^step ?[0-9]+"
AMOUNT = r"(?i)\b(to taste|as needed|as required|for frying|for garnish|for serving)\b"
CAPITALISED = r"^[A-Z][A-Za-z'&-]*$"
EMBEDDED = r"(?i)\b(complete|full|featured|following) (.+?) recipe\b"
#: Words that say nothing about a picture's subject, and titles of what isn't a picture of it.
COMMON_TERMS = ("with", "from", "food", "recipe", "dish", "indian")
BLOCKED_TITLE = r"(?i)\b(pdf|catalogue|catalog|nurser|book|cover|archive|document|brochure|advert|poster|label|packaging)\b"
#: Categories by the first rule whose words occur.
CATEGORIES = (
    ("pasta|noodle|spaghetti|macaroni", "pasta"),
    ("salad|slaw|lettuce|greens|vegetable", "salad"),
    ("pork|beef|lamb|steak|meat|ham|chicken", "meat"),
    ("soup|broth|stew", "soup"),
    ("curry|masala|spicy|sriracha", "curry"),
    ("cake|dessert|sweet|chocolate", "dessert"),
    ("pancake|waffle|breakfast", "breakfast"),
    ("rice|risotto", "rice"),
)
#: Headings and keys of a recipe's text, and words of a page that shows a check instead.
HEADING_SIGNAL = r"(?i)(ingredients?|directions?|instructions?|method|preparation|steps?)\b"
STRUCTURED_SIGNAL = r"(?i)(recipeIngredient|recipeInstructions|\"@type\" ?: ?\"Recipe)"
RECIPE_WORD = r"(?i)(ingredients?|directions?|instructions?|method|recipeIngredient|recipeInstructions)"
BLOCKED_SIGNAL = r"(?i)(something went wrong|security checkpoint|access denied|request unsuccessful|unusual traffic|verify you are human|are you a robot|captcha|enable javascript|please try refreshing the page|oops!)"


def any_of(line: Column, patterns: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for pattern in patterns:
        found = found | line.rlike(pattern)
    return found


def page_noise(line: Column) -> Column:
    line = squeezed(line)
    return (line == "") | any_of(line, PAGE_NOISE)


def nutrition_noise(line: Column) -> Column:
    return any_of(squeezed(line), NUTRITION)


def scan_garbage(line: Column) -> Column:
    """Marks of ownership, calls to action without a unit, many odd signs with few letters, next to no letters, bare headings."""

    def found(line: Column) -> Column:
        count = lambda kept: F.length(F.regexp_replace(line, f"[^{kept}]", ""))
        letters, digits, odd = count("A-Za-z"), count("0-9"), count("@©®™|")
        called = line.rlike(CALLS) & ~line.rlike(SCAN_UNIT)
        return (line == "") | line.rlike(GENERIC) | ((odd >= 2) & (letters < 18)) | line.rlike("[©®™]") | called | ((letters < 2) & (digits < 1))

    return let(squeezed(line), found)


def document_garbage(line: Column) -> Column:
    line = squeezed(line)
    return (line == "") | line.rlike("[©®™]") | (line.rlike(CALLS.replace("|ends in", "")) & ~line.rlike(UNIT))


def ingredient_like(line: Column) -> Column:
    """A numbered line, a number with a unit, or an amount in words; no heading and no step."""
    good = line.rlike(r"^[0-9]+[.)] ") | (line.rlike("[0-9¼½¾⅓⅔⅛⅜⅝⅞]") & line.rlike(UNIT)) | line.rlike(AMOUNT)
    return good & ~line.rlike(GENERIC) & ~line.rlike(STEP)


def title_like(line: Column, most_words: int, most_chars: int) -> Column:
    """A capital at the start of several words without a mark at the end, or at least 35 in 100 words capitalised."""
    line = squeezed(line)
    parts = words(line)
    n, capital = F.size(parts), F.size(F.filter(parts, lambda w: w.rlike(CAPITALISED)))
    ordinary = (n >= 2) & F.get(parts, F.lit(0)).rlike(CAPITALISED) & ~line.rlike("[.!?]$")
    fits = F.length(line).between(3, most_chars) & (n <= most_words) & ~line.rlike(GENERIC) & ~line.rlike(STEP)
    return F.coalesce(fits & (ordinary | (capital * 100 >= F.greatest(F.lit(100), 35 * n))), F.lit(False))


def described(text: Column, most: int = 500) -> Column:
    """A description's lines without noise, markup and trackers, as one text; null if nothing or too much is left."""
    every = F.transform(F.split(text, "\n"), squeezed)
    kept = F.array_join(F.filter(every, lambda x: ~page_noise(x) & ~x.rlike(SCRIPT_TAG) & ~x.rlike(TRACKER)), " ")
    return F.when((kept != "") & (F.length(kept) < most), kept)


def step_line(line: Column) -> Column:
    """"## step 3 - x" and "step 3. x" as "Step 3: x"."""
    line = F.regexp_replace(squeezed(line), r"(?i)(^| )#{1,6} ?step ([0-9]+) ?[:.)-]? ?", " Step $2: ")
    return squeezed(F.regexp_replace(line, r"(?i)^ ?step ([0-9]+) ?[:.)-]? ?", "Step $1: "))


def embedded_title(line: Column) -> Column:
    """What stands between "complete" (or "full", "featured", "following") and "recipe"; an empty text without it."""
    return squeezed(F.regexp_replace(F.regexp_extract(squeezed(line), EMBEDDED, 2), "[,:;.!?]+$", ""))


def bare_letters() -> tuple[str, str]:
    """Accented Latin letters and the plain ones that they decompose to, by Unicode's own rule."""
    import unicodedata

    found = [(chr(c), unicodedata.normalize("NFKD", chr(c))[0]) for c in range(0xC0, 0x250)]
    found = [(a, b) for a, b in found if a != b and b.isascii() and b.isalpha()]
    return "".join(a for a, _ in found), "".join(b for _, b in found)


def search_terms(text: Column, least: int = 4) -> Column:
    """Lower-case words of at least so many letters or digits, accents aside, without common ones."""
    plain = F.lower(F.translate(text, *bare_letters()))
    return F.filter(F.split(F.regexp_replace(plain, "[^a-z0-9 ]", " "), " +"), lambda w: (F.length(w) >= least) & ~w.isin(*COMMON_TERMS))


def suitable_image(title: Column, mime: Column, width: Column, height: Column, hits: Column) -> Column:
    """A landscape picture of enough size whose title has a term and nothing of documents."""
    ratio = width / height
    return mime.startswith("image/") & ~title.rlike(BLOCKED_TITLE) & (width >= 1200) & (height >= 800) & ratio.between(1.4, 1.8) & (hits > 0)


def queue_key(url: Column, name: Column, size: Column, modified: Column) -> Column:
    """What makes two queued items the same: the address, else name, size and time of change."""
    plain = lambda x: F.lower(F.trim(F.coalesce(x, F.lit(""))))
    other = F.concat_ws("|", plain(name), F.coalesce(size, F.lit(0)).cast("string"), F.coalesce(modified, F.lit(0)).cast("string"))
    return F.when(plain(url) != "", F.concat(F.lit("url|"), plain(url))).when(plain(name) != "", F.concat(F.lit("file|"), other))


def blocked_page(text: Column) -> Column:
    """A page that shows a check or a refusal and no word of a recipe; a blank or missing text is one."""
    return F.coalesce((squeezed(text) == "") | (text.rlike(BLOCKED_SIGNAL) & ~text.rlike(RECIPE_WORD)), F.lit(True))


def recipe_signals(text: Column) -> Column:
    """Enough text with a recipe's heading in it, or keys of structured data; never a blocked page."""
    found = ((F.length(text) >= 250) & text.rlike(HEADING_SIGNAL)) | text.rlike(STRUCTURED_SIGNAL)
    return ~blocked_page(text) & F.coalesce(found, F.lit(False))
