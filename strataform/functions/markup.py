"""Markup as column expressions: one fold over its tags and texts with a stack of open elements, inside the row.

Elements keep their extent however they are nested; those that nobody closes end with
the one that holds them, or where a like one begins, as a list item does.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from strataform.functions.text import escaped, let, squeezed, unescaped

#: A comment, a raw element with all that it holds, a tag, or text; a lone "<" is text.
TOKEN = r"""(?is)<!--.*?(?:-->|$)|<(script|style|noscript|template)\b(?:[^>"']|"[^"]*"|'[^']*')*>.*?(?:</\1\s*>|$)|</?[a-z][a-z0-9]*(?:[^>"']|"[^"]*"|'[^']*')*>|<![^>]*>|[^<]+|<"""
#: Elements without an end (fixed values).
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
#: Elements that end where one of the others begins, inside the element that bounds them (fixed values).
IMPLIED = {"li": ("li",), "p": ("p", "div", "ul", "ol", "dl", "table", "hr", "pre", "blockquote", "form", "main", "aside", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "header", "footer", "nav", "li"), "td": ("td", "th", "tr"), "th": ("td", "th", "tr"), "tr": ("tr", "tbody", "tfoot")}
BOUNDS = {"li": ("ul", "ol"), "td": ("table",), "th": ("table",), "tr": ("table",)}


def tokens(html: Column) -> Column:
    """array<struct<kind, name, text>>: open, close, void, text or raw (comments, scripts, declarations), in order."""

    def made(x: Column, name: Column) -> Column:
        raw = x.startswith("<!") | name.isin("script", "style", "noscript", "template")
        kind = F.when(name == "", F.when(raw, "raw").otherwise("text")).when(raw, "raw").when(x.startswith("</"), "close").when(name.isin(*VOID), "void").otherwise("open")
        return F.struct(kind.alias("kind"), name.alias("name"), x.alias("text"))

    return F.transform(F.regexp_extract_all(html, F.lit(TOKEN), F.lit(0)), lambda x: let(F.lower(F.regexp_extract(x, "^</?([A-Za-z][A-Za-z0-9]*)", 1)), lambda name: made(x, name)))


def last_of(stack: Column, names) -> Column:
    """The place, from 1, of the last name of the stack that is in names (a test); 0 without one."""
    return F.coalesce(F.array_max(F.filter(F.transform(stack, lambda x, k: F.when(names(x), k + 1)), lambda x: x.isNotNull())), F.lit(0))


def kept_before(stack: Column, name: Column) -> Column:
    """How many open elements stay when one of this name begins: those before the ones that it ends."""

    def before(ended: str, by: tuple[str, ...]) -> Column:
        bound = BOUNDS.get(ended, ())
        at, wall = last_of(stack, lambda x: x == ended), last_of(stack, lambda x: x.isin(*bound)) if bound else F.lit(0)
        return F.when(name.isin(*by) & F.array_contains(stack, F.lit(ended)), let(at, lambda at: F.when(at > wall, at - 1)))

    return F.least(F.size(stack), *(before(ended, by) for ended, by in IMPLIED.items()))


def folded(html: Column) -> Column:
    """array<struct<kind, name, text, depth>>: the tokens of well-formed markup: every open element is closed, in order, and nothing else is.

    depth: open elements around the token. Raw tokens and ends of what isn't open are left out.
    """
    row = "struct<kind:string,name:string,text:string,depth:int>"
    none = F.struct(F.array().cast("array<string>").alias("stack"), F.array().cast(f"array<{row}>").alias("out"))

    def token(kind, name: Column, text: Column, depth: Column) -> Column:
        return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), name.alias("name"), text.alias("text"), depth.cast("int").alias("depth"))

    def ends(stack: Column, stay: Column) -> Column:
        """Ends of the open elements after the first stay, innermost first."""
        gone = F.slice(stack, stay + 1, F.greatest(F.size(stack) - stay, F.lit(0)))
        return F.reverse(F.transform(gone, lambda x, k: token("close", x, F.lit(""), stay + k)))

    def state(stack: Column, out: Column) -> Column:
        return F.struct(stack.alias("stack"), out.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        stack, out = acc["stack"], acc["out"]

        def opened(stay: Column) -> Column:
            left = F.slice(stack, F.lit(1), stay)
            return state(F.when(x["kind"] == "open", F.array_append(left, x["name"])).otherwise(left), F.array_append(F.concat(out, ends(stack, stay)), token(x["kind"], x["name"], x["text"], stay)))

        def closed(at: Column) -> Column:
            return F.when(at == 0, acc).otherwise(state(F.slice(stack, F.lit(1), at - 1), F.concat(out, ends(stack, at - 1))))

        return (
            F.when(x["kind"] == "raw", acc)
            .when(x["kind"] == "text", state(stack, F.array_append(out, token("text", x["name"], x["text"], F.size(stack)))))
            .when(x["kind"] == "close", let(last_of(stack, lambda y: y == x["name"]), closed))
            .otherwise(let(kept_before(stack, x["name"]), opened))
        )

    return F.aggregate(tokens(html), none, step, lambda acc: F.concat(acc["out"], ends(acc["stack"], F.lit(0))))


def attribute(tag: Column, name: str) -> Column:
    """An attribute's value; null where the tag has none."""
    pattern = rf"""(?is)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))"""
    value = F.concat(*(F.regexp_extract(tag, pattern, k) for k in (1, 2, 3)))
    return F.when(tag.rlike(pattern), unescaped(value))


#: Elements around whose ends a line ends (fixed values).
LINES = ("p", "div", "li", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "section", "article", "header", "footer", "ul", "ol", "table")


def text_of(parts: Column, first: Column, last: Column) -> Column:
    """The text of the tokens from first to before last, with single blanks; blocks and breaks part words."""
    inside = F.slice(parts, first + 1, F.greatest(last - first, F.lit(0)))
    told = F.transform(inside, lambda x: F.when(x["kind"] == "text", unescaped(x["text"])).when(x["name"].isin(*LINES) | (x["name"] == "br"), " ").otherwise(""))
    return squeezed(F.array_join(told, ""))


def marked(parts: Column, fragment: str) -> Column:
    """array<struct<classes, text>> from folded(): the elements with a class that holds the fragment, in order, with their text."""
    at = F.transform(parts, lambda x, k: F.struct((x["kind"] == "open").alias("opens"), x["text"].alias("tag"), x["depth"].alias("depth"), k.alias("k")))
    own = F.filter(at, lambda x: x["opens"] & x["tag"].contains(fragment) & F.coalesce(attribute(x["tag"], "class").contains(fragment), F.lit(False)))
    end = lambda x: x["k"] + 1 + F.array_position(F.transform(F.slice(parts, x["k"] + 2, F.size(parts)), lambda y: (y["kind"] == "close") & (y["depth"] == x["depth"])), True).cast("int")
    return F.transform(own, lambda x: F.struct(attribute(x["tag"], "class").alias("classes"), text_of(parts, x["k"], end(x)).alias("text")))


def texts_with(found: Column, css_class: str) -> Column:
    """array<string> from marked(): the texts of the elements of a class; blank ones are left out."""
    return F.transform(F.filter(found, lambda x: x["classes"].rlike(rf"(?:^|\s){css_class}(?:\s|$)") & (x["text"] != "")), lambda x: x["text"])


def class_texts(html: Column, css_class: str) -> Column:
    """array<string>: the texts of the elements of a class, in order, however they are nested."""
    none = F.array().cast("array<string>")
    return F.when(F.coalesce(html.contains(css_class), F.lit(False)), let(let(folded(html), lambda parts: marked(parts, css_class)), lambda found: texts_with(found, css_class))).otherwise(none)


#: Elements that stay in sanitised markup (fixed values).
ALLOWED = ("b", "strong", "i", "em", "u", "ul", "ol", "li", "br", "p", "div")


def written(parts: Column, allowed: tuple[str, ...] = ALLOWED) -> Column:
    """Tokens of folded() as markup: allowed elements without attributes, links to records, and the text of all else."""

    def record(tag: Column) -> Column:
        return F.regexp_extract(F.coalesce(attribute(tag, "href"), F.lit("")), "^#recipe-([0-9]+)$", 1)

    none = F.struct(F.array().cast("array<string>").alias("out"), F.array().cast("array<boolean>").alias("links"))

    def step(acc: Column, x: Column) -> Column:
        def state(text: Column, links: Column = acc["links"]) -> Column:
            return F.struct(F.when(text == "", acc["out"]).otherwise(F.array_append(acc["out"], text)).alias("out"), links.alias("links"))

        plain = F.when(x["name"].isin(*allowed), F.concat(F.when(x["kind"] == "close", "</").otherwise("<"), x["name"], F.lit(">"))).otherwise("")
        link = let(record(x["text"]), lambda n: F.when(n != "", F.concat(F.lit('<a href="#recipe-'), n, F.lit('" data-recipe-id="'), n, F.lit('">'))).otherwise(""))
        return (
            F.when(x["kind"] == "text", state(escaped_text(x["text"])))
            .when((x["name"] == "a") & (x["kind"] == "open"), let(link, lambda t: state(t, F.array_append(acc["links"], t != ""))))
            .when((x["name"] == "a") & (x["kind"] == "close"), state(F.when(F.element_at(acc["links"], -1), "</a>").otherwise(""), F.slice(acc["links"], F.lit(1), F.size(acc["links"]) - 1)))
            .otherwise(state(plain))
        )

    return F.aggregate(parts, none, step, lambda acc: F.array_join(acc["out"], ""))


def source_text(parts: Column) -> Column:
    """The text of folded() tokens as the page writes it: neither read nor escaped."""
    return F.array_join(F.transform(F.filter(parts, lambda x: x["kind"] == "text"), lambda x: x["text"]), "")


def escaped_text(text: Column) -> Column:
    """Text as it stands in markup: entities stay, lone marks become entities."""
    return reduce(lambda t, x: F.regexp_replace(t, x[0], x[1]), [("&(?!#?[A-Za-z0-9]+;)", "&amp;"), ("<", "&lt;"), (">", "&gt;")], text)


def sanitised(html: Column, allowed: tuple[str, ...] = ALLOWED) -> Column:
    """Well-formed markup of a fixed list of elements, without attributes; of links those to a record; the text of all others. Scripts, styles and comments go."""
    return let(folded(html), lambda parts: written(parts, allowed))


def blocks(html: Column, allowed: tuple[str, ...] = ALLOWED) -> Column:
    """array<struct<type, html>>: each element at the top of a menu's markup as a line, sanitised; a rule is a divider; plain text gives a line for each of its own."""

    def of(parts: Column) -> Column:
        top = F.filter(F.transform(parts, lambda x, k: F.struct(x["kind"].alias("kind"), x["name"].alias("name"), x["depth"].alias("depth"), k.alias("k"))), lambda x: (x["depth"] == 0) & x["kind"].isin("open", "void"))
        end = lambda x: F.when(x["kind"] == "void", x["k"] + 1).otherwise(F.array_min(F.filter(F.transform(parts, lambda y, k: F.when((y["kind"] == "close") & (y["depth"] == 0) & (k > x["k"]), k + 1)), lambda k: k.isNotNull())))
        made = lambda x: F.struct(F.when(x["name"] == "hr", "divider").otherwise("line").alias("type"), written(F.slice(parts, x["k"] + 1, end(x) - x["k"]), allowed).alias("html"))
        told = F.array_join(F.transform(F.filter(parts, lambda x: x["kind"] == "text"), lambda x: unescaped(x["text"])), "")
        lines = F.filter(F.transform(F.split(told, "\r?\n"), squeezed), lambda x: x != "")
        plain = F.transform(lines, lambda x: F.struct(F.when(x.rlike("^[-_*=]{3,}$"), "divider").otherwise("line").alias("type"), F.when(x.rlike("^[-_*=]{3,}$"), "").otherwise(escaped(x)).alias("html")))
        return F.when(F.size(top) == 0, plain).otherwise(F.filter(F.transform(top, made), lambda b: (b["html"] != "") | (b["type"] == "divider")))

    return let(folded(html), of)
