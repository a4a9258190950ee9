"""Text functions as Column expressions: tokens, weights, estimates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import _bound

#: CJK unified ideographs, characters of words, and weights of tokens by their number of CJK characters.
CJK = "一-鿿"
WORD = "a-z0-9_"
WEIGHTS = {2: 1.0, 3: 1.35}
LONG_WEIGHT = 1.55


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _grams(runs: Column, n: int) -> Column:
    """All ``n``-character pieces of each run."""
    one = lambda r: F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(r) - (n - 1), F.lit(1))), lambda i: F.substring(r, i, F.lit(n)))
    return F.flatten(F.transform(F.filter(runs, lambda r: F.char_length(r) >= n), one))


def lowered(text: Column | str) -> Column:
    return F.lower(F.coalesce(_column(text), F.lit("")))


def cjk_tokens(text: Column | str) -> Column:
    """Of each CJK run its characters and pairs."""
    runs = F.regexp_extract_all(lowered(text), F.lit(f"[{CJK}]+"), F.lit(0))
    # Pieces of runs are costly also where there is no run.
    return F.when(_column(text).rlike(f"[{CJK}]"), F.concat(_grams(runs, 1), _grams(runs, 2))).otherwise(F.array().cast("array<string>"))


def tokens(text: Column | str) -> Column:
    """Lower-case Latin words and numbers, and of each CJK run its characters and pairs; null is no token."""
    return F.concat(F.regexp_extract_all(lowered(text), F.lit(f"[{WORD}]+"), F.lit(0)), cjk_tokens(text))


#: Characters that carry no meaning of their own, for phrases and for coverage; courtesies and fillers of questions.
PHRASE_STOP = "的了是在我你他她它这那吗呢吧啊哦与及或就都也很只个对为被把让到着说从和"
COVER_STOP = "的了吗呢啊呀哦吧和与及是在有这那个我你它把被对于为以"
POLITE = "^(?:请问|麻烦你|帮我看看|帮我|我想问一下|我想知道|想问一下|能不能|拜托|帮忙)+"
NOISE = "谢谢|打扰了|麻烦了|来着|的话|吗|呢|啊|呀|哦|吧|嗯"


def _pieces(text: Column | str) -> tuple[Column, Column]:
    """Latin words and CJK runs of a text."""
    low = F.lower(F.coalesce(_column(text), F.lit("")))
    return F.regexp_extract_all(low, F.lit("[a-z0-9_]+"), F.lit(0)), F.regexp_extract_all(low, F.lit(f"[{CJK}]+"), F.lit(0))


def phrase_tokens(text: Column | str) -> Column:
    """Latin words; of CJK runs the pieces of one to three characters that aren't all stop characters, and runs of two to six whole.

    A run of two or three characters is there twice, as a piece and as a run.
    """
    words, runs = _pieces(text)
    told = lambda grams: F.filter(grams, lambda g: ~g.rlike(f"^[{PHRASE_STOP}]+$"))
    return F.concat(words, *[told(_grams(runs, n)) for n in (1, 2, 3)], F.filter(runs, lambda r: F.char_length(r).between(2, 6)))


def pair_tokens(text: Column | str) -> Column:
    """Latin words and, of CJK runs, the pairs of characters; a run of one character is itself."""
    words, runs = _pieces(text)
    return F.concat(words, F.filter(runs, lambda r: F.char_length(r) == 1), _grams(runs, 2))


def cover_tokens(text: Column | str) -> Column:
    """Distinct words of two characters or more; of a piece with CJK characters its characters but for stop characters."""
    low = F.lower(F.coalesce(_column(text), F.lit("")))
    pieces = F.filter(F.split(F.regexp_replace(low, r"[^\p{L}\p{N}_]", " "), " "), lambda p: p != "")
    cjk = lambda p: p.rlike(f"[{CJK}]")
    chars = F.filter(F.split(F.array_join(F.filter(pieces, cjk), ""), ""), lambda c: (c != "") & ~c.rlike(f"[{COVER_STOP}]"))
    return F.array_distinct(F.concat(F.filter(pieces, lambda p: ~cjk(p) & (F.char_length(p) > 1)), chars))


def rewritten(question: Column | str) -> Column:
    """A question without courtesies and fillers; itself if nothing else is left."""
    base = F.trim(F.coalesce(_column(question), F.lit("")))
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(base, POLITE, ""), NOISE, ""), "^[ ，,。.？?、]+|[ ，,。.？?、]+$", "")
    return F.when(bare == "", base).otherwise(bare)


def line_key(line: Column | str) -> Column:
    """A line without white space, bullets and numbering, to tell repeated lines."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(_column(line), F.lit("")), r"[\s　]+", ""), r"^[-*•·◦\d.、）)]+", "")


def without_repeated_lines(text: Column | str) -> Column:
    """A text without lines whose key, of six characters or more, an earlier line has.

    Lines are sorted by key, so that each looks at its neighbour alone, and then
    by place again.
    """
    lines = F.split(F.coalesce(_column(text), F.lit("")), "\n")
    keyed = F.array_sort(F.transform(lines, lambda x, at: F.struct(line_key(x).alias("key"), at.alias("at"), x.alias("line"))))
    first = lambda own: F.filter(own, lambda x, k: (F.char_length(x["key"]) < 6) | (k == 0) | (F.get(own, k - 1)["key"] != x["key"]))
    placed = F.array_sort(F.transform(_bound(keyed, first), lambda x: F.struct(x["at"], x["line"])))
    return F.array_join(F.transform(placed, lambda x: x["line"]), "\n")


def headings(text: Column | str) -> Column:
    """Headings of the first and second level of a Markdown text."""
    return F.regexp_extract_all(F.coalesce(_column(text), F.lit("")), F.lit(r"(?m)^#{1,2}\s+(.+?)\s*$"), F.lit(1))


def token_weight(token: Column | str) -> Column:
    """Single characters count little, longer CJK terms more."""
    t = _column(token)
    size = F.char_length(t)
    out = F.when(size == 1, F.when(t.rlike(f"[{CJK}]"), 0.18).otherwise(0.5))
    cjk = t.rlike(f"^[{CJK}]+$")
    for n, weight in WEIGHTS.items():
        out = out.when(cjk & (size == n), weight)
    return out.when(cjk & size.between(4, 6), LONG_WEIGHT).otherwise(1.0)


def estimate_tokens(text: Column | str) -> Column:
    """CJK characters / 1.4 + others / 4, rounded down, plus one; 0 for an empty or null text."""
    t = F.coalesce(_column(text), F.lit(""))
    cjk = F.char_length(F.regexp_replace(t, f"[^{CJK}]", ""))
    return F.when(t == "", 0).otherwise(F.floor(cjk / 1.4 + (F.char_length(t) - cjk) / 4.0) + 1).cast("long")


def word_count(text: Column | str) -> Column:
    """CJK characters plus pieces between white space."""
    t = F.trim(F.coalesce(_column(text), F.lit("")))
    pieces = F.size(F.filter(F.split(t, r"\s+"), lambda p: p != ""))
    return (F.char_length(F.regexp_replace(t, f"[^{CJK}]", "")) + pieces).cast("long")


def normalised(text: Column | str) -> Column:
    """Lower case without white space and punctuation, to tell repeated notes."""
    return F.lower(F.regexp_replace(F.coalesce(_column(text), F.lit("")), r"[\s\p{P}]+", ""))


def chunk_ref(source: Column | str, index: Column | str, page: Column | str | None = None) -> Column:
    """``source#index``, with ``@pN`` where there is a page."""
    base = F.concat(_column(source), F.lit("#"), _column(index).cast("string"))
    return base if page is None else F.concat(base, F.coalesce(F.concat(F.lit("@p"), _column(page).cast("string")), F.lit("")))
