"""Text column expressions. All are JVM-side; no Python UDFs.

Helpers here replace bare ``trim``/``split``: Spark's ``trim`` strips spaces
only and ``split`` keeps empty strings at the ends.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for equal results.
# ---------------------------------------------------------------------------
# Words removed from titles before stemming (20 words).
STOP_WORDS = (
    "and", "or", "the", "of", "a", "in", "for", "to", "at", "by", "an",
    "is", "as", "on", "except", "special", "all", "other", "with", "from",
)
# Occupation code: two digits, dash, four digits, dot, two digits, as a prefix.
CODE_PATTERN = r"^\d{2}-\d{4}\.\d{2}"
# Query prefix used by the app and by training anchors.
QUERY_PREFIX = "Represent this job for retrieval: "
# Major group labels keyed by the first two characters of a code.
MAJOR_GROUPS = {
    "11": "Management", "13": "Business & Finance", "15": "Computer & Math",
    "17": "Architecture & Engineering", "19": "Life & Physical Science",
    "21": "Community & Social Service", "23": "Legal", "25": "Education",
    "27": "Arts & Media", "29": "Healthcare Practitioners", "31": "Healthcare Support",
    "33": "Protective Service", "35": "Food Preparation", "37": "Building & Grounds",
    "39": "Personal Care", "41": "Sales", "43": "Office & Admin Support",
    "45": "Farming & Fishing", "47": "Construction", "49": "Installation & Repair",
    "51": "Production", "53": "Transportation", "55": "Military",
}
# Old taxonomy titles and their current names (exact whole-value replace).
TAXONOMY_FIXES = {
    "Software Developers, Applications": "Software Developers",
    "Software Developers, Systems Software": "Software Developers",
    "Accountants": "Accountants and Auditors",
    "Financial Managers, Branch or Department": "Financial Managers",
    "Stock Clerks, Sales Floor": "Stockers and Order Fillers",
    "Secondary School Teachers, Except Special and Vocational Education":
        "Secondary School Teachers, Except Special and Career/Technical Education",
    "Medical Secretaries": "Medical Secretaries and Administrative Assistants",
    "Financial Analysts": "Financial and Investment Analysts",
    "Software Quality Assurance Engineers and Testers":
        "Software Quality Assurance Analysts and Testers",
    "Legal Secretaries": "Legal Secretaries and Administrative Assistants",
}
# Whitespace as Python's str.split()/strip() see it (Unicode, plus \x1c-\x1f).
WS = r"[\t\n\x0b\x0c\r\x1c-\x1f \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
# The part of that set outside Java's ASCII \s, mapped to spaces before splitting
# (only in rows that hold one).
_EXOTIC_CLASS = r"[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_EXOTIC_WS = "\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000"
# Confidence tiers (percent): label thresholds and the colour thresholds.
TIER_HIGH, TIER_MODERATE = 65.0, 50.0
COLOUR_HIGH, COLOUR_MID = 72.0, 58.0
# Title boost per shared title word.
TITLE_BOOST = 0.03
# ---------------------------------------------------------------------------


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# The same whitespace set as literal characters, for btrim.
_WS_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
             + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000")


def strip_ws(c) -> Column:
    """Strip leading and trailing whitespace (Python's set, not only spaces);
    native ``btrim`` with the character set, no regex."""
    return F.btrim(col_(c), F.lit(_WS_CHARS))


def blank_to_empty(c) -> Column:
    """Null becomes ''; the value is stripped."""
    return F.coalesce(strip_ws(col_(c)), F.lit(""))


def is_blank(c) -> Column:
    return blank_to_empty(c) == F.lit("")


def words(c) -> Column:
    """Whitespace tokens of the text, case kept, no empty strings."""
    # translate (a per-character map) then an ASCII split: same tokens as a
    # split on the full class, at the cost of the plain pattern
    x = col_(c)
    flat = F.when(x.rlike(_EXOTIC_CLASS), F.translate(x, _EXOTIC_WS, " " * len(_EXOTIC_WS))).otherwise(x)
    return F.array_remove(F.split(flat, r"\s+"), "")


def tokens(c) -> Column:
    """``text.lower().split()``: lower-cased whitespace tokens."""
    return words(F.lower(col_(c)))


def word_count(c) -> Column:
    return F.size(words(F.coalesce(col_(c), F.lit(""))))


def stem(w: Column, mode: str = "exact") -> Column:
    """Suffix stemmer. ``exact`` keeps the reference rule: a word longer than 5
    ending in ``ers`` loses two characters (``workers`` -> ``worke``); else a
    word longer than 3 ending in ``s`` loses one. ``fixed`` drops one character
    for ``ers`` too."""
    n = F.length(w)
    cut_ers = 2 if mode == "exact" else 1
    return (
        F.when((n > 5) & w.endswith("ers"), F.left(w, n - cut_ers))
        .when((n > 3) & w.endswith("s"), F.left(w, n - 1))
        .otherwise(w)
    )


def title_words(c, stop_words=STOP_WORDS, stemming: str | None = "exact") -> Column:
    """Set of title words: lower tokens, stop words and 1-char words removed
    before stemming; punctuation kept. ``stemming=None`` with ``stop_words=()``
    gives the plain word set used by the app."""
    toks = tokens(F.coalesce(col_(c), F.lit("")))
    if stop_words:
        # native set difference first (also de-duplicates), so the lambdas
        # below only see distinct words; same set as filtering every token
        stops = F.array(*[F.lit(s) for s in stop_words])
        toks = F.filter(F.array_except(toks, stops), lambda x: F.length(x) > 1)
    else:
        toks = F.array_distinct(toks)
    if stemming:
        toks = F.array_distinct(F.transform(toks, lambda x: stem(x, stemming)))
    return toks


def normalized_key(c) -> Column:
    """Join key: stripped and lower-cased. Null stays null (the reference turns
    it into the text 'nan')."""
    return F.lower(strip_ws(col_(c)))


def is_code(c) -> Column:
    """True when the stripped text starts with an occupation code."""
    # \p{Nd}: any Unicode decimal digit, which is what Python's re means by \d
    return F.coalesce(strip_ws(col_(c)).rlike(CODE_PATTERN.replace(r"\d", r"\p{Nd}")), F.lit(False))


def major_group(code) -> Column:
    """First two characters of a code mapped to its major group, else 'Other'."""
    m = F.create_map(*[F.lit(x) for kv in MAJOR_GROUPS.items() for x in kv])
    return F.coalesce(F.element_at(m, F.left(F.coalesce(col_(code), F.lit("")), F.lit(2))),
                      F.lit("Other"))


def confidence_tier(pct, high: float = TIER_HIGH, moderate: float = TIER_MODERATE) -> Column:
    p = col_(pct)
    return F.when(p >= high, "High").when(p >= moderate, "Moderate").otherwise("Low")


def colour_tier(pct, high: float = COLOUR_HIGH, mid: float = COLOUR_MID) -> Column:
    """Colour band of a confidence (percent): the app colours with 72 / 58,
    while its labels and counts use 65 / 50 (``confidence_tier``)."""
    p = col_(pct)
    return F.when(p >= high, "conf-high").when(p >= mid, "conf-mid").otherwise("conf-low")


def importance_weight(rating) -> Column:
    """Rating on a 1-5 scale to a 0-1 weight: round((r-1)/4, 2). Null, blank,
    'nan' and non-numbers give 0.5; no clamping. Spark ``round`` is half-up on
    the decimal value (Python rounds the binary value)."""
    r = strip_ws(col_(rating))
    num = r.try_cast("double")
    return (
        F.when(r.isNull() | (r == "") | (F.lower(r) == "nan") | num.isNull() | F.isnan(num), F.lit(0.5))
        .otherwise(F.round((num - F.lit(1.0)) / F.lit(4.0), 2))
    )


def query_text(title, desc, prefix: str = "", strip: bool = False) -> Column:
    """``title + ' ' + desc``. Production and eval do not strip; the app and
    training strip; ``prefix`` is put in front."""
    t = F.coalesce(col_(title), F.lit(""))
    d = F.coalesce(col_(desc), F.lit(""))
    body = F.concat(t, F.lit(" "), d)
    if strip:
        body = strip_ws(body)
    return F.concat(F.lit(prefix), body) if prefix else body


def joined_parts(parts, caps=None) -> Column:
    """Non-empty texts joined by a space. ``caps``: characters kept of each
    (None: all); by default every text is taken whole."""
    whole = [F.coalesce(col_(p), F.lit("")) for p in parts]
    cut = [p if n is None else F.left(p, F.lit(n)) for p, n in zip(whole, caps or [None] * len(whole), strict=True)]
    return F.array_join(F.filter(F.array(*cut), lambda x: x != F.lit("")), " ")


def profile_text(title, desc, alt, skills, caps=None) -> Column:
    """Title, description, alternate titles and skills joined and stripped.
    ``caps`` as in ``joined_parts`` (the reference keeps 400 / 200 / 300
    characters of the last three)."""
    return strip_ws(joined_parts((title, desc, alt, skills), caps))


def short_label(c, n: int) -> Column:
    """First n characters plus an ellipsis when the text is longer."""
    x = col_(c)
    return F.concat(F.left(x, F.lit(n)), F.when(F.length(x) > n, F.lit("…")).otherwise(F.lit("")))


# textwrap's break after a hyphen inside a word: the hyphen follows two
# letters (or letter-hyphen-letter) and a letter (optionally hyphen) letter
# follows. "Letter" is a word character that is not a digit.
_LT = r"[^\d\W]"
# Both need the hyphen, looked at first: letters are slow to tell.
_HYPHEN_END = rf"(?<=-)(?:(?<={_LT}{{2}}-)|(?<={_LT}-{_LT}-))(?={_LT}-?{_LT})"
# It also breaks before and after two or more hyphens between words: a run of
# any length is found forwards, from the character in front of it.
_WP = r"[\w!\"'&.,?]"
_DASHES = rf"({_WP})(-{{2,}})(?=\w)"


def chunk_text(c, width: int = 800, hyphens: bool = False) -> Column:
    """Greedy packing of whitespace words into chunks of at most ``width``
    characters joined by single spaces, like ``textwrap.wrap`` on single-spaced
    text. With ``hyphens`` a chunk may also end after a hyphen inside a word,
    as ``textwrap`` does (``well-`` / ``known``); without, words are never
    split. Blank text gives an empty array.

    One JVM regex does the packing: on whitespace-collapsed text,
    ``\\S(?:.{0,w-2}\\S)?(?= |$)`` matches, from the start of a word, the longest
    run of at most ``w`` characters that ends at a word end - exactly the
    greedy rule. Rows holding an unbreakable run longer than ``width`` or, with
    ``hyphens``, two or more hyphens between words (both rare) take the
    piece-by-piece fold, which cuts and breaks them as ``textwrap`` does."""
    return chunk_flat(single_spaced(c), width, hyphens)


def single_spaced(c) -> Column:
    """Text with whitespace as ``textwrap`` collapses it: its set is ASCII only;
    the spaces left at the ends are trimmed."""
    # single spaces, nearly all of it, are left where they stand
    return F.regexp_replace(F.regexp_replace(F.coalesce(col_(c), F.lit("")), r"\s{2,}|[\t-\r]", " "), "^ | $", "")


def chunk_flat(c, width: int = 800, hyphens: bool = False) -> Column:
    """``chunk_text`` of text that is ``single_spaced``."""
    flat = col_(c)
    body = f"(\\S(?:.{{0,{max(width - 2, 0)}}}\\S)?)"
    fast = F.regexp_extract_all(flat, F.lit(f"(?s){body}(?= |$)"), 1)
    if hyphens:
        # only rows holding a hyphen pay for the hyphen alternatives
        with_h = F.regexp_extract_all(flat, F.lit(f"(?sU){body}(?:(?= |$)|{_HYPHEN_END})"), 1)
        fast = F.when(F.instr(flat, "-") > 0, with_h).otherwise(fast)
    # the fold is needed only for an unbreakable run longer than the width
    runs = flat if not hyphens else F.when(
        F.instr(flat, "-") > 0, F.regexp_replace(flat, f"(?U){_HYPHEN_END}", " ")).otherwise(flat)
    has_long = runs.rlike(f"(?<!\\S)\\S{{{width + 1}}}")  # tried where a run starts
    if hyphens:  # dash runs between words are marked, and packed, by the fold
        has_long = has_long | ((F.instr(flat, "--") > 0) & flat.rlike(f"(?U){_DASHES}"))
    return F.when(has_long, _chunk_fold(flat, width, hyphens)).otherwise(fast)


def _cut_run(run: Column, room: Column, hyphens: bool) -> Column:
    """Characters of an over-long run that fit into ``room``: up to and with
    the last hyphen there that follows some other character, else all."""
    if not hyphens:
        return room
    head = F.left(run, room)
    at = F.length(head) - F.instr(F.reverse(head), "-")  # before the last hyphen
    return F.when((F.instr(head, "-") > 0) & F.left(head, at).rlike("[^-]"), at + 1).otherwise(room)


def _chunk_fold(flat: Column, width: int, hyphens: bool) -> Column:
    """``flat``: text with single spaces. Pieces are the words or, with
    hyphens, their breakable parts; a piece that starts a word has a space in
    front."""
    marked = flat
    if hyphens:
        marked = F.regexp_replace(F.regexp_replace(flat, f"(?U){_HYPHEN_END}", "\u0001"), f"(?U){_DASHES}", "$1\u0001$2\u0001")
    pieces = F.filter(F.split(F.regexp_replace(marked, " ", "\u0001 "), "\u0001"), lambda p: p != F.lit(""))
    init = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

    def step(acc, piece):
        cur, done = acc["cur"], acc["done"]
        body = F.ltrim(piece)
        glue = F.when((cur != "") & piece.startswith(" "), F.lit(" ")).otherwise(F.lit(""))
        fits = F.length(cur) + F.length(glue) + F.length(body) <= width
        closed = F.when(cur == "", done).otherwise(F.concat(done, F.array(cur)))
        short = F.when(fits, F.struct(done.alias("done"), F.concat(cur, glue, body).alias("cur"))).otherwise(
            F.struct(closed.alias("done"), body.alias("cur")))
        # an over-long run fills the open chunk, then chunks of its own; two cuts cover more than a width
        room = F.lit(width) - F.length(cur) - F.length(glue)
        opened = F.concat(cur, glue)
        first = F.when(room > 0, _cut_run(body, room, hyphens)).otherwise(F.lit(0))
        start = F.struct(F.when(room > 0, F.concat(done, F.array(F.concat(opened, F.left(body, first)))))
                         .otherwise(closed).alias("done"),
                         F.substring(body, first + 1, F.length(body)).alias("cur"))

        def again(a, _):
            n = _cut_run(a["cur"], F.lit(width), hyphens)
            return F.when(F.length(a["cur"]) <= width, a).otherwise(
                F.struct(F.concat(a["done"], F.array(F.left(a["cur"], n))).alias("done"),
                         F.substring(a["cur"], n + 1, F.length(a["cur"])).alias("cur")))

        turns = F.sequence(F.lit(1), F.lit(2) * F.ceil(F.length(body) / F.lit(width)).cast("int") + 2)
        return F.when(F.length(body) <= width, short).otherwise(F.aggregate(turns, start, again))

    out = F.aggregate(pieces, init, step)
    return F.when(out["cur"] == "", out["done"]).otherwise(F.concat(out["done"], F.array(out["cur"])))
