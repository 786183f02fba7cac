"""Download links in raw web pages. Everything happens inside one row: no shuffle.

A page is cut into tokens by one pattern from its beginning to its end: comments, elements whose content is text (scripts, styles,
text areas, titles), and tags. What stands inside a comment, a script or the value of an attribute is part of that token and never a
tag of its own; a comment or script that is not closed reaches to the end of the page, as in a browser.
"""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civigrade.operators.joins import attach_counted

# File extensions of data, marks of a bot challenge.
DATA_EXTENSIONS = (".csv", ".xlsx", ".xls", ".json", ".zip", ".gz")
CHALLENGE_MARKS = ("Just a moment", "challenges.cloudflare.com", "Human Verification", "awsWafCookieDomainList")
GOVERNMENT = "gov.br"
LANGUAGE_SECTION = "pt-br"
SHARED_SECTIONS = 2

_URL = r"^([a-zA-Z][a-zA-Z0-9+.-]*):(//([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$"
_REFERENCE = r"^(//([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$"
_VALUE = r"""(?:"[^"]*+"|'[^']*+'|(?!["'])[^\s>]*+)"""
_ATTRIBUTES = rf"""(?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+{_VALUE})?)*+"""
_TEXT_ELEMENT = rf"<(script|style|textarea|title)(?=[\s/>]){_ATTRIBUTES}>.*?(?:</\1(?=[\s/>])[^>]*+(?:>|\z)|\z)"
_TOKEN = rf"(?is)<!--(?:-?>|.*?(?:--!?>|\z))|<[!?/][^>]*+(?:>|\z)|{_TEXT_ELEMENT}|<[a-z]{_ATTRIBUTES}>"
_OTHER = rf"""(?:[\s/]++|(?!href[\s=/>])[^\s/>][^\s/>=]*+(?:\s*+=\s*+{_VALUE})?)*+"""
_HREF = rf"""(?is)^<a(?=[\s/]){_OTHER}href\s*+=\s*+({_VALUE})"""
#: Pieces of an attribute value: character references, what lies between them, and single ampersands. A name without its semicolon
#: does not count before an equals sign, so that parameters of a query stay.
_PIECES = r"&#[0-9]++;?|&#[xX][0-9a-fA-F]++;?|&[A-Za-z][A-Za-z0-9]*+(?:;|(?!=))|[^&]++|&"
_BLANKS = " \t\n\f\r"
_LAST_CODE = 0x10FFFF

def _without_dots(path: Column) -> Column:
    """Path with ``.`` and ``..`` segments resolved."""
    segments = F.split(path, "/")
    last = F.element_at(segments, -1)
    ends_open = last.isin(".", "..")

    def step(kept: Column, segment: Column) -> Column:
        return (
            F.when(segment == ".", kept)
            .when(segment == "..", F.when(F.size(kept) > 1, F.slice(kept, F.lit(1), F.size(kept) - 1)).otherwise(kept))
            .otherwise(F.array_append(kept, segment))
        )

    kept = F.aggregate(segments, F.expr("array()").cast("array<string>"), step)
    joined = F.array_join(kept, "/")
    return F.when(ends_open, F.concat(joined, F.lit("/"))).otherwise(joined)


def resolve_url(page: Column, reference: Column) -> Column:
    """Absolute URL of a reference found on a page."""
    part = lambda url, g: F.regexp_extract(url, _URL, g)
    ref = lambda g: F.regexp_extract(reference, _REFERENCE, g)
    scheme, authority, page_path, page_query = part(page, 1), part(page, 2), part(page, 4), part(page, 5)
    folder = F.regexp_replace(page_path, "[^/]*$", "")
    base_folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    path, query, fragment = ref(3), ref(4), ref(5)
    merged = (
        F.when(ref(1) != "", F.concat(scheme, F.lit(":"), ref(1), _without_dots(path), query, fragment))
        .when(F.startswith(path, F.lit("/")), F.concat(scheme, F.lit(":"), authority, _without_dots(path), query, fragment))
        .when(path != "", F.concat(scheme, F.lit(":"), authority, _without_dots(F.concat(base_folder, path)), query, fragment))
        .when(query != "", F.concat(scheme, F.lit(":"), authority, page_path, query, fragment))
        .otherwise(F.concat(scheme, F.lit(":"), authority, page_path, page_query, fragment))
    )
    has_scheme = reference.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:")
    return F.when(has_scheme, reference).when(reference == "", page).otherwise(merged)


def hrefs(html: Column) -> Column:
    """``href`` of every anchor in document order, with its character references decoded."""
    tokens = F.filter(F.regexp_extract_all(html, F.lit(_TOKEN), F.lit(0)), lambda token: token.rlike(r"(?i)^<a[\s/]"))
    found = F.filter(F.transform(tokens, lambda tag: F.regexp_extract(tag, _HREF, 1)), lambda h: h != "")
    return F.transform(found, lambda h: F.btrim(unescaped(F.regexp_replace(h, "^[\"']|[\"']$", "")), F.lit(_BLANKS)))


def _named() -> Column:
    """Names of character references (with their semicolon, some without) and their characters, as the language's library lists them."""
    names = sorted(html5)
    return F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[F.lit(html5[n]) for n in names]))


def _windows_letters() -> tuple[str, str]:
    """Numbers from 128 to 159 mean the Windows letters."""
    pairs = [(chr(b), bytes([b]).decode("cp1252", "ignore")) for b in range(0x80, 0xA0)]
    return "".join(c for c, letter in pairs if letter), "".join(letter for _, letter in pairs)


def _character(number: Column) -> Column:
    """The character of a number; what is none becomes the replacement character."""
    known = number.between(1, _LAST_CODE) & ~number.between(0xD800, 0xDFFF)
    text = F.decode(F.unhex(F.lpad(F.hex(F.when(known, number).otherwise(0xFFFD)), 8, "0")), "UTF-32")
    return F.translate(text, *_windows_letters())


def unescaped(text: Column) -> Column:
    """An attribute value with its character references decoded: decimal, hexadecimal and named ones."""
    names = _named()

    def decoded(piece: Column) -> Column:
        bare = F.rtrim(F.substring(piece, F.lit(3), F.length(piece)), F.lit(";"))
        digits = F.when(piece.rlike("^&#[xX]"), F.conv(F.right(F.concat(F.lit("0000000"), F.substring(bare, 2, 64)), F.lit(15)), 16, 10)).otherwise(F.right(F.concat(F.lit("0"), bare), F.lit(18)))
        named = F.coalesce(F.try_element_at(names, F.substring(piece, F.lit(2), F.length(piece))), piece)
        return F.when(F.startswith(piece, F.lit("&#")) & (F.length(piece) > 2), _character(digits.cast("long"))).when(F.startswith(piece, F.lit("&")), named).otherwise(piece)

    whole = F.array_join(F.transform(F.regexp_extract_all(text, F.lit(_PIECES), F.lit(0)), decoded), "")
    return F.when(F.contains(text, F.lit("&")), whole).otherwise(text)


def _sections(url: Column) -> Column:
    path = F.lower(F.regexp_extract(url, _URL, 4))
    return F.filter(F.split(path, "/"), lambda s: (s != "") & (s != LANGUAGE_SECTION))


def _host(url: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(F.regexp_extract(url, _URL, 3), "^.*@", ""), ":[0-9]*$", ""))


def in_page_section(page: Column, link: Column) -> Column:
    """On one government host the first two path segments of page and link must agree; other links pass."""
    same_host = (_host(page) == _host(link)) & F.endswith(_host(page), F.lit(GOVERNMENT))
    page_parts, link_parts = _sections(page), _sections(link)
    agree = F.array(*[F.get(page_parts, F.lit(i)) == F.get(link_parts, F.lit(i)) for i in range(SHARED_SECTIONS)])
    return ~same_host | F.forall(agree, lambda x: F.coalesce(x, F.lit(False)))


def file_name(url: Column) -> Column:
    """Last path segment, whatever trailing slashes follow."""
    return F.regexp_extract(F.regexp_extract(url, _URL, 4), "([^/]*)/*$", 1)


def download_links(pages: DataFrame, extensions: tuple[str, ...] | None = DATA_EXTENSIONS, most: int | None = None) -> DataFrame:
    """Different download links of every page in document order, with ``most`` at most so many.

    ``extensions`` limits the file names; ``None`` takes every http(s) link.
    """
    def is_download(url: Column) -> Column:
        good = F.lower(url).rlike("^https?:") & in_page_section(F.col("url"), url)
        if extensions is None:
            return good
        suffix = F.lower(F.regexp_extract(file_name(url), r"[^.](\.[^.]+)$", 1))
        return good & suffix.isin(*extensions)

    links = F.transform(hrefs(F.col("html")), lambda h: resolve_url(F.col("url"), h))
    chosen = F.array_distinct(F.filter(links, is_download))
    chosen = chosen if most is None else F.slice(chosen, 1, most)
    listed = pages.select("page_id", F.col("url").alias("page_url"), F.posexplode(chosen).alias("at", "link"))
    return listed.select("page_id", "page_url", (F.col("at") + 1).alias("position"), file_name(F.col("link")).alias("name"), "link")


def first_source(candidates: DataFrame, keys: list[str], source: str, order: str) -> DataFrame:
    """The first of the candidate sources of every key, by ``order`` and then name, that has any candidate; all its candidates.

    ``candidates`` has one row per key, source and link.
    """
    first = candidates.groupBy(*keys).agg(F.min(F.struct(order, source)).alias("_first"))
    rows = attach_counted(candidates, first, keys)
    return rows.filter((F.col(source) == F.col("_first")[source]) & (F.col(order) == F.col("_first")[order])).drop("_first")


def is_bot_challenge(html: Column, characters: int | None = None) -> Column:
    """Whether a page (or its first ``characters``) holds a mark of a bot challenge."""
    head = html if characters is None else F.left(html, F.lit(characters))
    flag = F.lit(False)
    for mark in CHALLENGE_MARKS:
        flag = flag | F.contains(head, F.lit(mark))
    return flag
