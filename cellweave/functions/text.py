"""Address text normalisation as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Numerals that may start a number, those that may continue it, and what they mean.
NUMERAL_START = "一二两三四五六七八九十"
NUMERAL_MORE = "零一二两三四五六七八九十百千万亿壹贰叁肆伍陆柒捌玖貮"
NUMERAL_VALUES = {
    "零": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9,
    "十": 10, "百": 100, "千": 1000, "万": 10000, "亿": 100000000,
    "壹": 1, "贰": 2, "叁": 3, "肆": 4, "伍": 5, "陆": 6, "柒": 7, "捌": 8, "玖": 9, "貮": 2,
}
NUMERAL_UNITS = "十百千万亿"
_DIGITS = "".join(k for k, v in NUMERAL_VALUES.items() if v < 10)
_DIGIT_VALUES = "".join(str(v) for v in NUMERAL_VALUES.values() if v < 10)

_WIDE = "decimal(38,0)"

# Runs kept as words: 2 to 50 Chinese characters, letters, digits or underscores.
WORD = r"[一-龥_a-zA-Z0-9]{2,50}"


def _numeral_value(token: Column) -> Column:
    """Value of a numeral run with a unit character, read from the right.

    A unit scales the digits to its left; a smaller unit further left multiplies it. A
    unit at the very start counts as one of itself when it is the largest so far. Null
    beyond 38 digits.
    """
    state0 = F.struct(F.lit(0).cast(_WIDE).alias("total"), F.lit(1).cast(_WIDE).alias("unit"))
    table = F.create_map(*[x for k, v in NUMERAL_VALUES.items() for x in (F.lit(k), F.lit(v).cast(_WIDE))])
    chars = F.reverse(F.split(token, ""))
    coded = F.transform(chars, lambda ch, i: F.struct(F.element_at(table, ch).alias("v"), (i == F.length(token) - 1).alias("lead")))

    def step(s, ch):
        v = ch["v"]
        is_unit = v >= 10
        grown = F.when(v > s["unit"], v).otherwise(F.try_multiply(s["unit"], v).cast(_WIDE))
        return F.struct(
            F.try_add(s["total"], F.when(~is_unit, F.try_multiply(s["unit"], v)).when(ch["lead"] & (v > s["unit"]), v).otherwise(F.lit(0)).cast(_WIDE)).cast(_WIDE).alias("total"),
            F.when(is_unit, grown).otherwise(s["unit"]).alias("unit"),
        )

    return F.aggregate(coded, state0, step, lambda s: F.when(s["unit"].isNotNull(), s["total"]))


def cn_digits(c: Column) -> Column:
    """Replace numeral runs inside text by Arabic digits.

    The text is cut into numeral runs and the rest by one pattern; runs without a unit are
    spelled out digit by digit, leading zeros dropped; a run worth more than 38 digits stays.
    """
    number = f"[{NUMERAL_START}][{NUMERAL_MORE}]*"
    other = f"[^{NUMERAL_START}]+"
    pieces = F.regexp_extract_all(c, F.lit(f"({number}|{other})"), F.lit(1))

    def convert(p):
        digits = F.regexp_replace(F.translate(p, _DIGITS, _DIGIT_VALUES), "^0+(?=.)", "")
        return (
            F.when(~p.rlike(f"^[{NUMERAL_START}]"), p)
            .when(p.rlike(f"[{NUMERAL_UNITS}]"), F.coalesce(_numeral_value(p).cast("string"), p))
            .otherwise(digits)
        )

    return F.when(c.isNotNull(), F.array_join(F.transform(pieces, convert), ""))


def keep_words(c: Column) -> Column:
    """Join the runs of 2 to 50 word characters; everything else, single ones too, goes."""
    return F.array_join(F.regexp_extract_all(c, F.lit(f"({WORD})"), F.lit(1)), "")


def half_width(c: Column, remove_blank: bool = True) -> Column:
    """Full-width forms to their plain ones; optionally without any white space."""
    wide = "　" + "".join(chr(i) for i in range(0xFF01, 0xFF5F))
    plain = " " + "".join(chr(i - 0xFEE0) for i in range(0xFF01, 0xFF5F))
    r = F.translate(c, wide, plain)
    return F.regexp_replace(r, r"(?U)\s+", "") if remove_blank else r


def normalize(c: Column, width_first: bool = False) -> Column:
    """Numerals, words, width in the established order; ``width_first`` keeps full-width letters."""
    if width_first:
        return keep_words(cn_digits(half_width(c)))
    return half_width(keep_words(cn_digits(c)))


def label_of(c: Column) -> Column:
    """Display name: the text before a bracket of either kind."""
    return F.split(c, "[（(]")[0]
