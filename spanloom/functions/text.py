"""Column functions over text: normalisation, classifiers and case rules.

Patterns spell out their character classes: the engine's shorthand classes cover ASCII
only, while texts hold any script. All are built-in expressions except ``normalize_full``.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# fixed values: characters read as an apostrophe
APOSTROPHES = "'‘’ʻʼʽ`´"
# fixed values: suffixes in the order in which they are tried
AFFIXES = (
    "larining", "ларининг", "lardagi", "лардаги", "gacha", "гача", "dagi", "даги",
    "ning", "нинг", "lari", "лари", "ligi", "лиги", "lik", "лик", "dan", "дан",
    "lar", "лар", "ga", "га", "da", "да", "ni", "ни", "si", "си", "i", "и",
)
# fixed values: frequent words by language; words with an apostrophe never match, since words are runs of letters
STOP_WORDS = {
    "uz-latn": """va bilan uchun bo'lgan bolgan deb ham bu kerak yil lekin ammo shuningdek hamda
        yoki emas edi qilib haqida ular uning bir necha ko'proq koproq bosh yangi degan bo'yicha esa
        hozir juda qilgan bergan berilgan amalga oshirildi mumkin kelib chiqqan tomonidan davomida
        oldin keyin barcha qildi bo'lib bolib qanday nima qachon qayerda sababli natijasida ushbu""".split(),
    "uz-cyrl": """ва билан учун бўлган деб ҳам бу керак йил лекин аммо шунингдек ҳамда ёки эмас
        эди қилиб ҳақида улар унинг бир неча кўпроқ бош янги деган бўйича эса ҳозир жуда қилган берган
        берилган амалга оширилди мумкин келиб чиққан томонидан давомида олдин кейин барча қилди
        бўлиб қандай нима қачон қаерда сабабли натижасида ушбу мазкур""".split(),
    "ru": """что это который которые были был была как для не на по из за или но также если уже
        когда очень более менее чтобы этом этой этого всех своих может года году лет россии сообщает
        отметил заявил около после перед между тысяч рублей""".split(),
    "en": """the and of to in is for with on that this are was were will has have been from as
        at by it its their they which about would could should not but or you your we our more than
        said also can may new one two first year years""".split(),
    "tr": "ve bir için ile bu olarak daha çok sonra kadar".split(),
}
SPACES = r"[\s\x{00A0}]+"


def length_bucket(text: Column) -> Column:
    """Name of the size class of a text, by code points."""
    n = F.length(text)
    return F.when(n < 200, "<200").when(n < 1000, "200-999").when(n < 3000, "1000-2999").otherwise(">=3000")


def normalize(text: Column) -> Column:
    """Lower case, one apostrophe, single spaces, no outer space.

    Built-in expressions only; agrees with ``normalize_full`` on ASCII and Latin-1 text.
    """
    x = F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))
    x = F.translate(x, APOSTROPHES, "'" * len(APOSTROPHES))
    return F.trim(F.regexp_replace(x, SPACES, " "))


FOLD = str.maketrans(dict.fromkeys(APOSTROPHES, "'"))


def folded(text: str) -> str:
    """Compatibility composition, full case folding, one apostrophe, single spaces."""
    return " ".join(unicodedata.normalize("NFKC", text).casefold().translate(FOLD).split())


@F.arrow_udf(StringType())
def normalize_full(texts: pa.Array) -> pa.Array:
    """``normalize`` for any script: compatibility forms and full case folding as well.

    Arrow batches; texts of ASCII alone, whose form the built-ins have, take a vectorised way.
    """
    plain = pc.fill_null(pc.string_is_ascii(texts), True)
    if pc.all(plain).as_py() is not False:
        x = pc.replace_substring(pc.ascii_lower(texts), "`", "'")
        return pc.ascii_trim_whitespace(pc.replace_substring_regex(x, r"[\s\x0b\x1c-\x1f]+", " "))
    return pa.array([None if t is None else folded(t) for t in texts.to_pylist()], pa.string())


def digest(normalized: Column) -> Column:
    """128-bit hexadecimal digest; only its equality matters."""
    return F.md5(normalized)


def letters(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))


def alphabet_ok(text: Column) -> Column:
    """At least two fifths letters, and any Cyrillic or basic Latin letter."""
    return (letters(text) >= 0.4 * F.length(text)) & text.rlike(r"[\x{0400}-\x{04FF}A-Za-z]")


def script_of(text: Column) -> Column:
    """``both``, ``cyr`` or ``lat``; texts with neither alphabet count as Latin."""
    cyr, lat = text.rlike(r"[\x{0400}-\x{04FF}]"), text.rlike("[A-Za-z]")
    return F.when(cyr & lat, "both").when(cyr, "cyr").otherwise("lat")


def span_script(text: Column) -> Column:
    """Script of a mention: any Cyrillic letter decides."""
    return F.when(text.rlike(r"[\x{0400}-\x{04FF}]"), "cyr").otherwise("lat")


def words(text: Column) -> Column:
    """Words between white space, no-break space included."""
    return F.regexp_extract_all(text, F.lit(r"[^\s\x{00A0}]+"), F.lit(0))


MIXED = r"[A-Za-z][\x{0400}-\x{04FF}]|[\x{0400}-\x{04FF}][A-Za-z]"
LETTER_DIGIT = r"\p{L}[0-9]|[0-9]\p{L}"
#: one letter, digit or underline among other signs, a letter first
SINGLE = r"^\p{L}[^\p{L}\p{N}_]*$"
WORD_START, WORD_END = r"(?<![^\s\x{00A0}])", r"(?![^\s\x{00A0}])"


def ocr_counts(text: Column) -> dict[str, Column]:
    """Number of words, of those with mixed scripts or letters next to digits, and of single letters.

    Words are counted where they stand: no list of them is made. Give the counts columns of
    their own before using them more than once.
    """
    return {
        "ocr_words": F.regexp_count(text, F.lit(r"[^\s\x{00A0}]+")),
        # a text with neither digits nor Cyrillic letters has none, which one quick look shows
        "ocr_noisy": F.when(~text.rlike(r"[0-9\x{0400}-\x{04FF}]"), 0).otherwise(F.regexp_count(text, F.lit(rf"{WORD_START}[^\s\x{{00A0}}]*?(?:{MIXED}|{LETTER_DIGIT})"))),
        "ocr_single": F.regexp_count(text, F.lit(rf"{WORD_START}\p{{L}}[^\p{{L}}\p{{N}}_\s\x{{00A0}}]*{WORD_END}")),
    }


def ocr_shares(counts: dict[str, Column]) -> tuple[Column, Column]:
    """Shares of noisy words and of single letters; (1, 1) without words."""
    n, noisy, single = (counts[k] for k in ("ocr_words", "ocr_noisy", "ocr_single"))
    return F.when(n == 0, 1.0).otherwise(noisy / n), F.when(n == 0, 1.0).otherwise(single / n)


def ocr_noise(text: Column) -> tuple[Column, Column]:
    return ocr_shares(ocr_counts(text))


def affix(mention: Column) -> Column:
    """The first listed suffix that leaves more than two characters, or the empty string."""
    low = F.lower(mention)
    hits = [F.when(F.endswith(low, F.lit(a)) & (F.length(low) > len(a) + 2), F.lit(a)) for a in AFFIXES]
    return F.coalesce(*hits, F.lit(""))


def detect_language(text: Column) -> Column:
    """Language with the largest share of its frequent words; under 0.03 ``undetermined``.

    Letters that only one alphabet has raise its share, and a language whose alphabet is
    absent has none. Ties go to the language named first. Words and shares are variables of
    outer lambdas, so that each is computed once a text.
    """
    cyr, lat = text.rlike(r"[\x{0400}-\x{04FF}]"), text.rlike("[A-Za-z]")

    def among(stop: list[str]) -> Callable[[Column], Column]:
        return lambda w: w.isin(*stop)

    def shares(tokens: Column) -> Column:
        n = F.size(tokens)
        out = []
        for k, stop in STOP_WORDS.items():
            share = F.when(n == 0, 0.0).otherwise(F.size(F.filter(tokens, among(stop))) / n)
            if k == "uz-cyrl":
                share = share + F.when(text.rlike("[ўқғҳЎҚҒҲ]"), 0.05).otherwise(0.0)
            out.append(F.when(cyr if k in ("uz-cyrl", "ru") else lat, share).otherwise(0.0))
        return F.when(n > 0, F.array(*out)).otherwise(F.array(F.lit(0.0)))

    def choose(share: Column) -> Column:
        top = F.array_max(share)
        names = F.array(*map(F.lit, STOP_WORDS))
        return F.when(top < 0.03, "undetermined").otherwise(F.element_at(names, F.array_position(share, top).cast("int")))

    tokens = F.array(F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0)))
    return F.element_at(F.transform(F.transform(tokens, shares), choose), 1)


def fold_apostrophes(text: Column) -> Column:
    return F.translate(text, APOSTROPHES, "'" * len(APOSTROPHES))


def same_length_case(text: Column, upper: bool) -> Column:
    """Case of every character that stays one character in it; offsets into the text stay valid."""
    case = F.upper if upper else F.lower
    return F.array_join(F.transform(F.split(text, ""), lambda c: F.when(F.length(case(c)) == 1, case(c)).otherwise(c)), "")


def title_case(text: Column) -> Column:
    """First letter of each run of letters in upper case, the others in lower case, length kept."""
    chars = F.split(text, "")
    before = F.concat(F.array(F.lit(" ")), F.slice(chars, 1, F.greatest(F.size(chars) - 1, F.lit(0))))

    def one(c: Column, p: Column) -> Column:
        case = F.when(p.rlike(r"^\p{L}$"), F.lower(c)).otherwise(F.upper(c))
        return F.when(F.length(case) == 1, case).otherwise(c)

    return F.array_join(F.zip_with(chars, before, one), "")


def case_like(text: Column, model: Column) -> Column:
    """``text`` in the case pattern of ``model``: all upper, first letter lower, or as it is; length kept."""
    all_upper = (F.length(model) > 1) & (F.upper(model) == model) & (F.lower(model) != model)
    low = F.regexp_replace(model, r"[^\p{L}]", "").rlike(r"^\p{Ll}")
    return F.when(all_upper, same_length_case(text, True)).when(low, same_length_case(text, False)).otherwise(text)


WORD_CHAR = r"^[\p{L}\p{N}'‘’ʻʼʽ`´]$"


def is_word_char(c: Column) -> Column:
    """A letter, digit or apostrophe."""
    return c.rlike(WORD_CHAR)


def abbreviation_dot(text: Column, dot: Column, start: Column) -> Column:
    """Whether the dot at ``dot`` follows a single letter of the span that starts at ``start``."""
    one, two = F.substring(text, dot, F.lit(1)), F.substring(text, dot - 1, F.lit(1))
    return (dot - 1 >= start) & one.rlike(r"^\p{L}$") & ((dot - 2 < start) | ~two.rlike(r"^\p{L}$"))


def tag_prefix(tag: Column) -> Column:
    return F.split_part(tag, F.lit("-"), F.lit(1))


def tag_label(tag: Column) -> Column:
    return F.when(tag == "O", F.lit(None)).otherwise(F.split_part(tag, F.lit("-"), F.lit(2)))
