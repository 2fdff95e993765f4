"""Scalar rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.operators.checks import clean_ws

# Spacing diacritics before a letter, and ligatures, in the order in which they are replaced.
LATEX = (
    ("´s", "ś"), ("´S", "Ś"), ("´c", "ć"), ("´C", "Ć"), ("´z", "ź"), ("´Z", "Ź"), ("˙z", "ż"), ("˙Z", "Ż"), ("´n", "ń"), ("´N", "Ń"), ("´o", "ó"), ("´O", "Ó"), ("˛a", "ą"), ("˛A", "Ą"), ("˛e", "ę"), ("˛E", "Ę"),
    ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "ft"), ("ﬆ", "st"),
)
# List markers in the order in which they are tried.
MARKERS = (
    ("number_with_dot", r"^\d{1,3}(\.\d+)*\.\s"), ("number_with_bracket", r"^\d{1,3}\)\s?"), ("letter_with_bracket", r"^[a-z]\)\s?"),
    ("bullet", r"^[••●○■]"), ("dash", r"^[-−\x{2013}\x{2014}]"), ("number_in_brackets", r"^\[\d+\]\s?"), ("listing", r"^\d+\s"),
)
# A line that defines an acronym.
ACRONYM_LINE = r"^([A-ZĄĆĘŁŃÓŚŹŻ0-9]{2,}([^\p{L}\p{N}_]|$)|\S{1,15}\s*[-–—−‐:=]\s+)"
# Words by which a closing chapter is found.
HEADINGS_OF_END = ("podsumowanie", "zakończenie", "wnioski końcowe", "wnioski", "conclusions", "conclusion", "final remarks", "summary")
# Forms of citations, style after style.
CITATIONS = (
    ("numeric", r"\[\s*\d+\s*(?:[,;\-–]\s*\d+\s*)*\]"), ("harvard", r"\([A-ZŚĆŻŹŁ][^()0-9]+(?:19|20)\d{2}[^()]*\)"), ("mla", r"\([A-ZŚĆŻŹŁ][a-ząćęłńóśźż]+\s+\d{1,4}\)"),
    ("footnote", r"(?:^|\n)\s*\d+[\.\)]?\s*[A-ZŚĆŻŹŁ]\.\s+[A-ZŚĆŻŹŁ][a-ząćęłńóśźż]+"), ("alpha", r"\[[A-Za-zŚĆŻŹŁąćęłńóśźż]{2,6}\d{2}[a-z]?\]"), ("acm", r"\[[A-ZŚĆŻŹŁ][A-Za-zŚĆŻŹŁąćęłńóśźż\s\.\,]+?\s+(?:19|20)\d{2}\]"),
)
# Capitals that are no acronyms.
NO_ACRONYMS = (
    "PRACA", "MAGISTERSKA", "INŻYNIERSKA", "DYPLOMOWA", "STRESZCZENIE", "ABSTRACT", "SŁOWA", "KLUCZOWE", "KEYWORDS", "WYKAZ", "SKRÓTÓW", "ABBREVIATIONS", "ENGINEERING", "THESIS", "UNIVERSITY", "POLITECHNIKA", "OECD",
    "WSTĘP", "CEL", "PRACY", "TEORIA", "PRZEGLĄD", "ROZWIĄZAŃ", "OPIS", "WYNIKI", "ZAKOŃCZENIE", "DODATEK", "INSTRUKCJA", "PROGRAMISTY", "DYPLOMU", "UŻYTKOWNIKA", "BIBLIOGRAFIA", "SPIS", "TREŚCI", "RYSUNKÓW",
    "TABEL", "LISTA", "SYMBOLI", "TAK", "NIE", "APLIKACJI", "TESTY",
)
AROUND = "():;,.!?[]\n\t \"„”«»“‟‘’"
# Forms of a page number at the foot of a page.
FOOTERS = r"^\d+$|strona\s+\d+|str\.\s*\d+|^\d+\s*/\s*\d+$|^\d+\s+z\s+\d+$|page\s+\d+"
# Fonts of formulas.
MATH_FONTS = ("math", "cmmi", "cmr", "cmsy", "symbol")
# Letters that only Polish has among the languages at hand, and frequent words.
POLISH = r"[ąęłńśźż]|(^|[^\p{L}])(się|nie|jest|oraz|dla|przez)([^\p{L}]|$)"


def is_polish(text: Column) -> Column:
    """A plain stand-in for a language detector: Polish or else English."""
    return F.lower(text).rlike(POLISH)


def fix_latex(text: Column) -> Column:
    for a, b in LATEX:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def tidy_output(text: Column) -> Column:
    """Without leading dashes and bullets, one pair of quotes around it and one final dot."""
    t = F.trim(F.regexp_replace(F.trim(text), r"^[-• ]+", ""))
    t = F.regexp_replace(t, '^["„”](.*)["„”]$', "$1")
    return F.trim(F.regexp_replace(t, r"\.$", ""))


def page_format(width: Column, height: Column, tolerance: float = 10.0) -> Column:
    """A3 to A5 in either orientation, in points."""
    fits = lambda a, b: ((F.abs(width - a) <= tolerance) & (F.abs(height - b) <= tolerance)) | ((F.abs(width - b) <= tolerance) & (F.abs(height - a) <= tolerance))
    return F.when(fits(420, 595), "A5").when(fits(595, 842), "A4").when(fits(842, 1191), "A3").otherwise("incorrect")


def orientation(width: Column, height: Column) -> Column:
    return F.when(height < width, "landscape").otherwise("portrait")


def marker(text: Column, active: Column | None = None) -> Column:
    """The first list marker that a block begins with; null for a paragraph. With an active marker only that one is tried."""
    t = F.trim(text)
    if active is None:
        return F.coalesce(*(F.when(t.rlike(pattern), name) for name, pattern in MARKERS))
    own = F.coalesce(*(F.when((active == name) & t.rlike(pattern), name) for name, pattern in MARKERS))
    return F.when(active.isNull(), marker(text)).otherwise(own)


def strip_marker(text: Column) -> Column:
    t = F.trim(text)
    cut = (F.when(t.rlike(pattern), F.trim(F.regexp_replace(t, pattern, ""))) for _, pattern in MARKERS)
    return F.coalesce(*cut, t)


def is_acronym_line(text: Column) -> Column:
    return F.trim(text).rlike(ACRONYM_LINE)


def is_footer(text: Column, y0: Column, page: Column, height: Column) -> Column:
    """A block low on the page that has the form of a page number or the page's number as a word."""
    t = F.lower(F.trim(text))
    own = F.rlike(t, F.concat(F.lit(r"(^|[^\p{L}\p{N}_])"), page.cast("string"), F.lit(r"([^\p{L}\p{N}_]|$)")))
    return (y0 >= height * 0.88) & (t.rlike(FOOTERS) | own)


def is_keywords(text: Column) -> Column:
    return F.lower(text).rlike(r"^(keywords|key words|słowa kluczowe)")


def math_kind(text: Column, words: Column, chars: Column, math_words: Column) -> Column:
    """Of a block's words in a row, their number, their characters, and those in a font of formulas: 0 with leader dots, 1 if more than 30 % are spaces, 2 if more than 40 % of the words are in such fonts."""
    density = (words - 1) / (chars + words - 1)
    return F.when(text.rlike(r"(?:\.\s*){4,}"), 0).when(density > 0.3, 1).when(math_words / words > 0.4, 2).otherwise(0)


def heading_level(number: Column) -> Column:
    return F.regexp_count(number, F.lit(r"\.")) + 1


def is_toc_line(text: Column) -> Column:
    return text.rlike(r"\.{4,} *[0-9]+$")


def citations(text: Column) -> Column:
    """Citations in six styles, style after style."""
    found = lambda name, p: F.regexp_extract_all(text, F.lit(p), F.lit(0))
    return F.flatten(F.array(*(F.transform(found(n, p), lambda x: F.btrim(x, F.lit(" \t\r\n"))) if n == "footnote" else found(n, p) for n, p in CITATIONS)))


# A line of contents, words of headings of lists, and figures' names before their number.
TOC_LINE = r"(?:\.{3,}|\.\s\.\s\.)[\s\.]*\d+"
LIST_HEADINGS = r"(^|[^\p{L}\p{N}_])(rozdział|chapter|spis tabel|spis wykresów|bibliografia|zakończenie|wstęp|spis rycin|procent|odpowiedź|źródło|tabela|rycina)([^\p{L}\p{N}_]|$)"
FIGURE = r"(?:rys(?:unek|\.)?|wykres|schemat|fot(?:ografia|\.)?|wys\.?)\s*(\d+(?:\.\d+)*)"
SHORT_FIGURE = r"rys(?:unek|\.)?\s*(\d+(?:\.\d+)?)"


def is_toc_heading(text: Column) -> Column:
    """A heading that belongs to a list: leader dots, a word of such lists, or a number that is no section's before a word."""
    t = clean_ws(text)
    return (t != "") & (t.rlike(r"\.{3,}|\.\s\.\s\.") | F.lower(t).rlike(LIST_HEADINGS) | t.rlike(r"^\d+\s*$|^\d+\s+[A-ZĄĆĘŁŃÓŚŹŻa-ząćęłńóśźż].*"))


def figure_number(text: Column, short: bool = False) -> Column:
    """The number behind a figure's name, with any number of dots, or one at most."""
    return F.regexp_extract(F.lower(text), SHORT_FIGURE if short else FIGURE, 1)


def chunks(text: Column, size: int) -> Column:
    """Pieces of ``size`` characters; none of an empty text."""
    n = F.ceil(F.length(text) / size).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(text, i * size + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def trimmed_fragment(text: Column, size: int = 1600) -> Column:
    """At most ``size`` characters, cut behind the last sentence end beyond 60 % of them, else before the last space."""
    t = F.substring(text, 1, size)
    stop = size - F.length(F.regexp_extract(t, r"([^.!?]*)$", 1))
    space = F.length(F.regexp_extract(t, r"^(.*) [^ ]*$", 1))
    return F.when(F.length(text) <= size, text).when((stop > size * 0.6) & t.rlike(r"[.!?]"), F.substring(t, F.lit(1), stop)).when(space > 0, F.substring(t, F.lit(1), space)).otherwise(t)


def bare_word(word: Column) -> Column:
    return F.btrim(word, F.lit(AROUND))


def potential_acronym(word: Column) -> Column:
    """Two to ten characters that aren't small, dotted initials, digits or words of a title page: all capitals, two or more behind a small beginning, or capitals in brackets."""
    w = bare_word(word)
    n, capitals = F.length(w), F.regexp_count(w, F.lit(r"\p{Lu}"))
    upper = lambda t: t.rlike(r"\p{Lu}") & ~t.rlike(r"\p{Ll}")
    plain = (n >= 2) & (n <= 10) & ~w.rlike(r"^([A-Z]\.)+[A-Z]?$") & ~(w.rlike(r"\p{Ll}") & ~w.rlike(r"\p{Lu}")) & ~w.rlike(r"[\p{Nd}_+#<>*/\\]") & ~w.isin(*NO_ACRONYMS)
    inner = F.substring(word, F.lit(2), F.length(word) - 2)
    return plain & (upper(w) | (~w.rlike(r"^\p{Lu}") & (capitals >= 2)) | (word.rlike(r"^\(.*\)$") & upper(inner) & (F.length(inner) >= 2)))


def is_roman(word: Column) -> Column:
    return word.rlike(r"^[IVXLCDM]+$")


def initials(definition: Column) -> Column:
    """Upper-case first letters of the words."""
    return F.upper(F.array_join(F.transform(F.filter(F.split(definition, r"[ -]", -1), lambda w: w != ""), lambda w: F.substring(w, 1, 1)), ""))


def is_subsequence(short: Column, long: Column) -> Column:
    """Whether the characters of ``short`` occur in ``long`` in their order."""
    return F.rlike(long, F.concat(F.lit("^.*"), F.array_join(F.split(short, ""), ".*")))


def parsed_score(reply: Column) -> Column:
    """score of a JSON reply, or of the first brace to the last; 0, 50 and 100 count, anything else is 0."""
    whole = F.get_json_object(reply, "$.score")
    inner = F.get_json_object(F.regexp_extract(reply, r"(?s)\{.*\}", 0), "$.score")
    n = F.coalesce(whole, inner).try_cast("int")
    return F.when(n.isin(0, 50, 100), n).otherwise(0)


def effective_dpi(px: Column, box_width: Column) -> Column:
    """Pixels by inch of the shown width, cut to a whole number; without a width a sixth of the pixels."""
    return F.when(box_width > 0, (px / (box_width / 72)).cast("int")).otherwise((px / 6).cast("int"))


def search_query(text: Column) -> Column:
    return F.url_encode(F.concat(F.lit('"'), F.left(clean_ws(text), F.lit(300)), F.lit('"')))


def ending(text: Column, size: int = 9000) -> Column:
    """Of the text with single spaces, from the latest heading word of a conclusion, else the last ``size`` characters; at most ``size``."""
    text = F.trim(F.regexp_replace(F.replace(text, F.lit("\u00a0"), F.lit(" ")), r"[ \t\n\r\f\x0B]+", " "))
    low = F.lower(text)
    place = lambda h: F.length(low) - F.length(F.substring_index(low, h, -1)) - len(h) + 1
    at = F.greatest(*(F.when(F.contains(low, F.lit(h)), place(h)).otherwise(0) for h in HEADINGS_OF_END))
    return F.trim(F.when(at > 0, F.substring(text, at, F.lit(size))).otherwise(F.right(text, F.lit(size))))
