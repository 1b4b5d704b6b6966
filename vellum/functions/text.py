"""Text as columns: cleaning, tokens, stems, language; built-in functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.config import BARS

#: The stop words of the two languages.
STOPWORDS = {
    "en": """
    the and for are but not you all any can had her was one our out day get has him his how man new now old see two way who boy did its let put say she
    too use that with have this will your from they know want been good much some time very when come here just like long make many over such take than
    them well were what will would there their which about could other into more only your after also back because before between both down each even
    first from most must never other same should still take these those through under until where while would
    """.split(),
    "it": """
    che non per con una del della delle dei degli nel nella nelle nei negli sul sulla come piu meno anche quando dove perche quale quali questo questa
    questi queste quello quella quelli quelle sono stato stata stati state essere avere fatto fare dopo prima ancora sempre mai ogni altro altra altri
    altre tutto tutta tutti tutte molto poco solo gli agli dal dalla dalle dai dagli suo sua suoi sue mio mia miei mie loro nostro nostra vostro cosa
    senza sotto sopra tra fra oltre quindi allora infatti invece mentre poi cui chi cui era erano sarà sara essa esso esse essi
    """.split(),
}
#: Fixed value: a token is a letter, then letters, marks, apostrophes and hyphens.
TOKEN = r"\p{L}[\p{L}\p{M}'’-]*"
FRONTMATTER = r"\A---\r?\n[\s\S]*?\r?\n---[ \t]*\r?\n?"
#: What is not prose, in the order of removal.
NOT_PROSE = (
    (FRONTMATTER, " "),
    (r"(?dm)^(```|~~~)[^\n]*\n[\s\S]*?^\1[ \t]*$", " "),
    (r"(?dm)^(?:```|~~~)[\s\S]*", " "),
    (r"`[^`\n]+`", " "),
    (r"\$\$[\s\S]*?\$\$", " "),
    (r"\$[^$\n]+\$", " "),
    (r"!\[\[[^\]]*\]\]", " "),
    (r"https?://\S+|www\.\S+", " "),
    (r"\[\[([^\]]+)\]\]", " $1 "),
    (r"[|#^]", " "),
)


def clean(body: Column, max_chars: int | None = None) -> Column:
    """The prose of a note, whole unless a bound is given; null counts as empty."""
    text = F.coalesce(body, F.lit(""))
    if max_chars is not None:
        text = F.substring(text, 1, max_chars)
    return reduce(lambda c, rule: F.regexp_replace(c, *rule), NOT_PROSE, text)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def counted(token: Column, lang: str) -> Column:
    """Whether a surface form counts: long enough and no stop word."""
    return (F.length(token) >= BARS.min_token) & ~token.isin(STOPWORDS[lang])


def ends(c: Column, *suffixes: str) -> Column:
    return reduce(lambda a, s: a | c.endswith(s), suffixes[1:], c.endswith(suffixes[0]))


def cut(c: Column, n: int) -> Column:
    return F.substring(c, F.lit(1), F.length(c) - n)


def singular(c: Column) -> Column:
    """Plural endings of English; a word that an exception names is left as it is."""
    ies = F.when(ends(c, "eies", "aies"), c).otherwise(F.concat(cut(c, 3), F.lit("y")))
    es = F.when(ends(c, "aes", "ees", "oes"), c).otherwise(cut(c, 1))
    s = F.when(ends(c, "us", "ss"), c).otherwise(cut(c, 1))
    return F.when(F.length(c) <= 3, c).when(c.endswith("ies"), ies).when(c.endswith("es"), es).when(c.endswith("s"), s).otherwise(c)


#: Endings of English words and how many letters must remain.
ENDINGS = (("ingly", 3), ("edly", 3), ("ing", 3), ("ed", 4), ("ly", 4))


def stem(token: Column, lang: str) -> Column:
    """The light stem of a lower-case token."""
    return ending_cut(token, singular(token), lang)


def ending_cut(token: Column, one: Column, lang: str) -> Column:
    """The stem of a token whose singular is `one`."""
    if lang == "it":
        return F.when(F.length(token) <= 3, token).when((F.length(token) > 5) & ends(token, "zione", "zioni") | ends(token, "a", "e", "i", "o"), cut(token, 1)).otherwise(token)
    out = F.when(F.length(token) <= 3, token)
    for suffix, least in ENDINGS:
        out = out.when(one.endswith(suffix) & (F.length(one) - len(suffix) >= least), cut(one, len(suffix)))
    return out.otherwise(one)


def stemmed(words: DataFrame, lang: str) -> DataFrame:
    """(path, stem) of rows (path, token). The singular is a column of its own: put in for each of its uses it makes code too large to be compiled."""
    one = words.select("path", "token", singular(F.col("token")).alias("_one"))
    return one.select("path", ending_cut(F.col("token"), F.col("_one"), lang).alias("stem"))


def language_hits(text: Column) -> Column:
    """(en, it): how many tokens are stop words of each language."""
    hits = lambda lang: F.size(F.filter(tokens(text), lambda t: t.isin(STOPWORDS[lang])))
    return F.struct(hits("en").alias("en"), hits("it").alias("it"))


def prefixes(folders: list[str]) -> list[str]:
    """Lower-case folder prefixes with one slash at the end; empty and bare ones go."""
    trimmed = (f.strip().lower().lstrip("/").rstrip("/") for f in folders)
    return [f"{t}/" for t in trimmed if t]


def in_folders(path: Column, folders: list[str]) -> Column:
    return reduce(lambda a, p: a | F.lower(path).startswith(p), prefixes(folders), F.lit(False))


def parent(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def basename(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.md$", "")


def normal(path: Column) -> Column:
    """A path without doubled, leading or trailing slashes."""
    return F.regexp_replace(F.regexp_replace(path, "/+", "/"), "^/|/$", "")


def community_colour(i: Column, on_paper: bool = False) -> Column:
    """One hue per community between 212 and 306 degrees, in steps of the golden ratio; two bands of lightness."""
    hue = 212 + (i * 0.6180339887 % 1) * 94
    low, high = (42, 30) if on_paper else (70, 54)
    return F.format_string("hsl(%.1f, 66%%, %d%%)", hue, F.when(i % 2 == 0, low).otherwise(high))
