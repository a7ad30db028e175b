"""Name and ticker functions as column expressions: clean-up, look-alikes, glosses, affixes, and how a ticker comes from a name."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from loomwright.functions import segment as S
from loomwright.functions import text as T

#: Characters without width, and where emoji are (fixed values).
ZERO_WIDTH = r"[\x{200B}-\x{200F}\x{2060}-\x{2064}\x{FEFF}\x{00AD}]"
EMOJI = r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{FE0E}\x{FE0F}\x{200D}]"
#: Cyrillic and Greek letters and the Latin ones they look like (fixed values).
LOOKALIKES = "АВЕКМНОРСТХУІЈЅаеорсухіјѕԁɡΑΒΕΖΗΙΚΜΝΟΡΤΥΧορνικατυ"
LATIN_FORMS = "ABEKMHOPCTXYIJSaeopcyxijsdgABEZHIKMNOPTYXopvikatu"
#: Alphabet of base 58: no 0, O, I and l (fixed values).
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"


def mixed(text: Column) -> Column:
    """Whether a word of the text mixes Latin letters with Cyrillic or Greek ones."""
    return F.exists(F.split(text, r"\s+"), T.homoglyph_word)


def unmasked(text: Column) -> Column:
    """Look-alikes put back to Latin, in texts with a mixed word only."""
    return F.when(mixed(text), F.translate(text, LOOKALIKES, LATIN_FORMS)).otherwise(text)


def scripts_in_order(text: Column) -> Column:
    """Names of the scripts of a text, Latin aside, in the order in which they appear."""
    block = lambda c: reduce(lambda rest, name: F.when(T.has_script(c, name), name).otherwise(rest), [n for n in T.SCRIPTS if n != "latin"], F.lit(None).cast("string"))
    return F.array_distinct(F.array_compact(F.transform(F.split(text, ""), block)))


def normal_name(name: Column) -> Column:
    """The name in plain words: width-less characters and emoji out, look-alikes back, folded, camel case split, lower case, punctuation to spaces, repeated letters twice, digits for letters undone."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), EMOJI, " "), ZERO_WIDTH, "")
    words = F.lower(T.split_camel(T.fold(unmasked(bare))))
    spaced = F.regexp_replace(F.regexp_replace(words, r"[^\w+.\-]+", " "), r"(?<!\d)[.](?!\d)", " ")
    tokens = F.split(T.squeeze(F.trim(F.regexp_replace(spaced, r"\s+", " "))), " ")
    return F.array_join(F.transform(tokens, lambda t: F.coalesce(T.deleet(t), t)), " ")


def obfuscation(name: Column) -> Column:
    """What hides the name, as an array of codes in a fixed order."""
    bare = F.regexp_replace(name, ZERO_WIDTH, "")
    words = F.split(F.lower(T.split_camel(T.fold(unmasked(bare)))), r"[^\w]+")
    codes = [
        F.when(name.rlike(r"[\x{FF01}-\x{FF5E}]"), "fullwidth"), F.when(name.rlike(ZERO_WIDTH), "zero_width"), F.when(mixed(bare), "homoglyph"),
        F.when(F.exists(words, lambda w: T.squeeze(w) != w), "repeated_letters"), F.when(F.exists(words, lambda w: T.deleet(w).isNotNull()), "leet"),
    ]
    return F.array_compact(F.array(*codes))


def clean_ticker(symbol: Column) -> Column:
    """Ticker form of any text: emoji and width-less characters out, folded, no leading marks, no spaces, upper case, twenty characters at most."""
    return T.ticker_case(F.trim(T.fold(F.regexp_replace(F.regexp_replace(F.coalesce(symbol, F.lit("")), ZERO_WIDTH, ""), EMOJI, ""))))


def ticker_base(ticker: Column, known: list[str], suffixes: list[str], prefixes: list[str], least: int = 3, rounds: int = 4) -> Column:
    """The ticker without affixes: one in each round, suffixes before prefixes and long ones first, until it is known or nothing more can go."""
    by_length = lambda xs: sorted(xs, key=lambda x: (-len(x), x))

    def step(t: Column) -> Column:
        out = F.when(t.isin(*known), t)
        for s in by_length(suffixes):
            out = out.when(t.endswith(s) & (F.length(t) - len(s) >= least), F.left(t, F.length(t) - len(s)))
        for p in by_length(prefixes):
            out = out.when(t.startswith(p) & (F.length(t) - len(p) >= least), F.substring(t, len(p) + 1, T.REST))
        return out.otherwise(t)

    return reduce(lambda t, _: F.transform(F.array(t), step)[0], range(rounds), F.upper(ticker))


def glossed(text: Column, words: dict[str, str]) -> Column:
    """Runs of Han characters by a dictionary, the longest entry first at each place; characters without an entry stay."""
    longest = sorted(words, key=lambda w: (-len(w), w))
    pieces = F.regexp_extract_all(text, F.lit("(?s)" + "|".join(longest) + "|."), 0)
    table = F.create_map(*[F.lit(x) for w in longest for x in (w, f" {words[w]} ")])
    return F.trim(F.regexp_replace(F.array_join(F.transform(pieces, lambda p: F.coalesce(table[p], p)), ""), r"\s+", " "))


def prefer_acronym(parts: Column, words: list[str]) -> Column:
    """Camel-case parts where a lone capital before what is no word takes its first letter along, if the rest is a word: X+Doge stays, A+Idoge becomes AI+doge."""
    known = F.array(*map(F.lit, words))

    def joins(k: Column) -> Column:
        one, nxt = F.get(parts, k), F.get(parts, k + 1)
        low = F.lower(nxt)
        return F.coalesce(one.rlike("^[A-Z]$") & nxt.rlike("^[A-Z][a-z]{2,}$") & ~F.array_contains(known, low) & F.array_contains(known, F.substring(low, 2, T.REST)), F.lit(False))

    return F.transform(parts, lambda p, k: F.when(joins(k), F.concat(p, F.left(F.get(parts, k + 1), F.lit(1)))).when((k > 0) & joins(k - 1), F.substring(p, 2, T.REST)).otherwise(p))


def title_surfaces(title: Column, least: int = 4) -> Column:
    """Forms by which a title may be found: with its parenthesis as words, whole, and without the parenthesis; none for titles in other scripts or of lists and categories."""
    low = F.lower(F.trim(F.replace(T.fold(title), F.lit("_"), F.lit(" "))))
    base, inner = F.trim(F.regexp_replace(low, r"\s*\([^)]*\)\s*$", "")), F.regexp_extract(low, r"\(([^)]*)\)\s*$", 1)
    shown = F.when((F.length(base) >= 6) | ((F.length(base) >= least) & base.contains(" ")), base)
    forms = F.array(F.when((inner != "") & (base != ""), F.concat_ws(" ", base, inner)), low, shown)
    cleaned = F.transform(F.array_compact(forms), lambda s: F.trim(F.regexp_replace(F.regexp_replace(s, "[^a-z0-9 ]+", " "), " +", " ")))
    kept = F.array_distinct(F.filter(cleaned, lambda s: F.length(s) >= least))
    refused = low.rlike(r"^(list of|category:|file:|template:|special:)") | low.rlike(r"[^\x00-\x7F]")
    return F.when(refused, F.array().cast("array<string>")).otherwise(kept)


def spelled_inside(short: Column, long: Column) -> Column:
    """Whether the letters of ``short`` occur in ``long`` in order."""
    return F.regexp_like(long, F.array_join(F.split(short, ""), ".*"))


def explain_ticker(ticker: Column, base: Column, tokens: Column, known: list[str], slang: list[str]) -> Column:
    """How a ticker comes from a name, as a struct of rule and confidence; the first rule that fits wins."""
    t, full = F.lower(base), F.lower(ticker)
    compact = F.array_join(tokens, "")
    initials = lambda xs: F.array_join(F.transform(xs, lambda x: F.left(x, F.lit(1))), "")
    main = F.filter(tokens, lambda x: ~x.isin("the", "a", "of", "in", "and"))
    no_vowels = lambda x: F.regexp_replace(x, "[aeiou]", "")
    near = lambda a, b: (a == b) | ((F.length(a) != F.length(b)) & (F.levenshtein(a, b) <= 1))  # noqa: E731  (one letter more or less)
    bare = no_vowels(compact)
    rules = [
        (t == "", "empty", 0.0),
        (compact == "", "unrelated", 0.2),
        (F.upper(t).isin(*known), "known", 0.9),
        ((full == compact) | F.array_contains(tokens, full) | (t == compact) | F.array_contains(tokens, t), "equals", 0.95),
        ((F.size(tokens) >= 2) & (initials(tokens) == t), "acronym", 0.85),
        ((F.size(tokens) >= 2) & (initials(main) == t), "acronym", 0.8),
        (t.isin(*slang), "slang", 0.85),
        ((F.length(t) >= 3) & (F.left(t, F.lit(1)) == F.left(compact, F.lit(1))) & spelled_inside(t, compact) & ((bare != "") & (near(bare, t) | t.startswith(F.left(bare, F.length(t))))), "vowel_drop", 0.9),
        ((F.length(t) >= 3) & (F.left(t, F.lit(1)) == F.left(compact, F.lit(1))) & spelled_inside(t, compact), "subsequence", 0.8),
        (F.exists(tokens, lambda x: (F.length(no_vowels(x)) >= 3) & near(no_vowels(x), t)), "vowel_drop", 0.85),
        (t.contains("w") & (F.contains(compact, F.replace(t, F.lit("w"), F.lit("r"))) | F.contains(compact, F.replace(t, F.lit("w"), F.lit("l")))), "baby_talk", 0.6),
        ((F.length(t) >= 3) & (S.partial_ratio(t, compact) >= 0.85 - 1e-9), "fuzzy", 0.6),
    ]
    chain = reduce(lambda rest, r: F.when(r[0], F.struct(F.lit(r[1]).alias("rule"), F.lit(r[2]).alias("confidence"))).otherwise(rest), reversed(rules), F.struct(F.lit("unrelated").alias("rule"), F.lit(0.4).alias("confidence")))
    return chain


def _tenths(size: Column) -> Column:
    """A number from 0 with one decimal, its exact value rounded, halves to even."""
    whole = F.floor(size)
    rest = size - whole.cast("double")  # exact
    # Ten times the rest against the middle of two tenths, doubled and shared out so that nothing is rounded where it is close: 4 r against q - 16 r.
    low = F.floor(rest * 10)
    q = (2 * low + 1).cast("double")
    up = (4 * rest > q - 16 * rest) | ((4 * rest == q - 16 * rest) & (low % 2 == 1))
    digit = low + F.when(up, 1).otherwise(0)
    return F.concat((whole + F.floor(digit / 10)).cast("string"), F.lit("."), (digit % 10).cast("string"))


def fixed(x: Column, tenths: bool = False) -> Column:
    """A number with one decimal or none as C prints it: its exact binary value rounded, halves to even. (``format_string`` rounds the shortest digits that tell the number, halves up.)"""
    size = F.abs(x)
    if tenths:
        # Ten times the number is a half itself wherever rounding it hides on which side of one it is; only these and very large ones are looked at closer.
        n = F.rint(size * 10).cast("long")
        near = F.concat(F.floor(n / 10).cast("string"), F.lit("."), (n % 10).cast("string"))
        text = F.when((size < 1e14) & (size * 10 - F.floor(size * 10) != 0.5), near).otherwise(F.transform(F.array(size), _tenths)[0])
    else:
        text = F.rint(size).cast("long").cast("string")
    odd = F.when(F.isnan(x), "nan").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf").otherwise(F.format_string("%.1f" if tenths else "%.0f", x))
    return F.when(size < float(1 << 62), F.concat(F.when(x < 0, "-").otherwise(""), text)).when(x.isNotNull(), odd)


def duration(seconds: Column) -> Column:
    """Seconds as s, min, h or d."""
    whole = lambda x: F.floor(x).cast("long").cast("string")
    return (
        F.when(seconds < 120, F.concat(whole(seconds), F.lit(" s"))).when(seconds < 7200, F.concat(whole(seconds / 60), F.lit(" min")))
        .when(seconds < 172_800, F.concat(fixed(seconds / 3600, tenths=True), F.lit(" h"))).otherwise(F.concat(whole(seconds / 86_400), F.lit(" d")))
    )


def dollars(value: Column) -> Column:
    """Thousands as k, millions as M."""
    return F.when(value >= 1e6, F.concat(F.lit("$"), fixed(value / 1e6, tenths=True), F.lit("M"))).otherwise(F.concat(F.lit("$"), fixed(value / 1e3), F.lit("k")))


def image_score(distance: Column, same: int = 8, edited: int = 14) -> Column:
    """1 at distance 0, 0.9 at ``same``, 0.7 at ``edited``, 0.1 six further on, 0 beyond; straight between."""
    score = (
        F.when(distance <= same, 1 - 0.1 * distance / same).when(distance <= edited, 0.9 - 0.2 * (distance - same) / (edited - same))
        .when(distance <= edited + 6, 0.7 - 0.6 * (distance - edited) / 6).otherwise(0.0)
    )
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 3)


def slot(ts: Column, seconds: int = 600) -> Column:
    """The time rounded down to a slot."""
    return F.timestamp_seconds(F.floor(F.unix_micros(ts.cast("timestamp")) / (seconds * 1_000_000)) * seconds).cast("timestamp_ntz")


def base36(n: Column) -> Column:
    """A whole number in base 36, lower case."""
    return F.lower(F.conv(n.cast("string"), 10, 36))


@F.pandas_udf(BinaryType())
def base58_decode(text: pd.Series) -> pd.Series:
    """Bytes of base-58 text; null for text with other characters."""
    value = {c: k for k, c in enumerate(BASE58)}

    def one(x):
        if x is None or any(c not in value for c in x):
            return None
        n = 0
        for c in x:
            n = n * 58 + value[c]
        return b"\0" * (len(x) - len(x.lstrip("1"))) + n.to_bytes((n.bit_length() + 7) // 8, "big")

    return text.map(one)


def is_address(text: Column) -> Column:
    """Whether a text is 32 bytes in base 58."""
    return text.rlike(f"^[{BASE58}]{{32,44}}$") & (F.octet_length(base58_decode(text)) == 32)
