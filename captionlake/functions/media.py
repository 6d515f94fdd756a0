"""Column functions for picture geometry, dubbing clips and estimates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from captionlake.functions.udf import vectorised

# Aspect ratios, estimate factors, keyword sets of moods, Thai number words.
ASPECTS = {"9:16": 9 / 16, "1:1": 1.0, "4:5": 4 / 5, "16:9": 16 / 9}
ESTIMATES = {"accurate": (0.3, 0.9), "balanced": (0.55, 1.6), "fast": (0.4, 1.2)}
MOODS = [
    ("playful", "กวน|ตลก|ขำ|เล่น|ทะเล้น|เจ้าเล่ห์"),
    ("surprised", "ตกใจ|ประหลาดใจ|ตื่นเต้น|ช็อก"),
    ("serious", "จริงจัง|เข้ม|นิ่ง|ดุ|เด็ดขาด"),
    ("angry", "โกรธ|โมโห|เดือด|หงุดหงิด"),
    ("sad", "เศร้า|เสียใจ|เหงา|อ่อนโยน"),
]
THAI_DIGITS = ["ศูนย์", "หนึ่ง", "สอง", "สาม", "สี่", "ห้า", "หก", "เจ็ด", "แปด", "เก้า"]
THAI_PLACES = ["", "สิบ", "ร้อย", "พัน", "หมื่น", "แสน"]


def half_up(x: Column) -> Column:
    """Rounding that takes halves upwards."""
    return F.floor(x + 0.5)


def _pairs(x: Column) -> Column:
    """The nearest even number of pixels, halves upwards, but two at least."""
    return F.greatest(F.lit(2.0), half_up(x / 2) * 2.0)


def _within(value: Column, low: float, high: float, missing: float) -> Column:
    number = F.coalesce(value.cast("double"), F.lit(float(missing)))
    return F.when(number < low, float(low)).when(number > high, float(high)).otherwise(number)


def normalize_crop(style: Column) -> Column:
    """A crop style struct with every field inside its limits; opposite edges together take 90 percent at most."""
    fields = [F.when(style["aspect"].isin("original", "free", *ASPECTS), style["aspect"]).otherwise("original").alias("aspect")]
    fields += [_within(style[place], 0, 100, 50).alias(place) for place in ("x", "y")]
    for sides in (("left", "right"), ("top", "bottom")):
        edges = [_within(style[side], 0, 90, 0) for side in sides]
        share = 90 / F.greatest(F.lit(90.0), edges[0] + edges[1])
        fields += [(edge * share).alias(side) for edge, side in zip(edges, sides, strict=True)]
    return F.struct(*fields)


def _axis(size: Column, fitting: Column, aspect: Column, place: Column, before: Column, after: Column) -> tuple[Column, Column]:
    """Length and start of what is left along one axis.

    Whole for ``original``; between two edges (percent of the size) for ``free``; else ``fitting``, the length that the aspect leaves, at
    ``place`` percent of the room beside it. Starts and edges fall on even pixels.
    """
    down = lambda x, most: F.greatest(F.lit(0.0), F.least(most, F.floor(x / 2) * 2.0))
    start = down(size * before / 100, size - 2)
    end = F.greatest(start + 2, down(size * (100 - after) / 100, size))
    length = F.least(_pairs(size), fitting)
    room = F.greatest(F.lit(0.0), size - length)
    by = lambda whole, free, cut: F.when(aspect == "original", whole).when(aspect == "free", free).otherwise(cut)
    return by(size, end - start, length), by(F.lit(0.0), start, down(room * place / 100, room))


def crop_geometry(width: Column, height: Column, style: Column) -> Column:
    """struct<active, width, height, x, y> of the picture that a crop style leaves, with even sizes and places.

    style: a column that normalize_crop() has made, so that its limits are worked out once. An aspect leaves, along each axis, the whole
    of it or what the other axis allows, whichever is less.
    """
    w, h = (F.greatest(F.lit(2.0), half_up(side) * 1.0) for side in (width, height))
    ratio = F.try_element_at(F.create_map(*[F.lit(v) for pair in ASPECTS.items() for v in pair]), style["aspect"])
    across = _axis(w, _pairs(_pairs(h) * ratio), style["aspect"], style["x"], style["left"], style["right"])
    down = _axis(h, _pairs(_pairs(w) / ratio), style["aspect"], style["y"], style["top"], style["bottom"])
    changed = (across[0] != w) | (down[0] != h) | (across[1] > 0) | (down[1] > 0)
    active = (style["aspect"] != "original") & changed
    return F.struct(active.alias("active"), *[c.cast("long").alias(n) for n, c in (("width", across[0]), ("height", down[0]), ("x", across[1]), ("y", down[1]))])


def full_hd_geometry(width: Column, height: Column) -> Column:
    """struct<width, height>: the size scaled into full HD, upright or not, with even sides."""
    w, h = F.greatest(F.lit(2.0), width.cast("double")), F.greatest(F.lit(2.0), height.cast("double"))
    scale = F.when(h > w, F.least(1080 / w, 1920 / h)).otherwise(F.least(1920 / w, 1080 / h))
    return F.struct(_pairs(w * scale).cast("long").alias("width"), _pairs(h * scale).cast("long").alias("height"))


def duration_fit(actual: Column, slot: Column, most: float = 1.18, tolerance: float = 0.04) -> Column:
    """struct<status, rate>: fit, stretch, needs_edit, or failed where a duration is missing or not positive."""
    bad = actual.isNull() | slot.isNull() | F.isnan(actual.cast("double")) | F.isnan(slot.cast("double")) | (actual <= 0) | (slot <= 0)
    rate = actual / slot
    status = F.when(bad, "failed").when(actual <= slot + tolerance, "fit").when(rate <= most, "stretch").otherwise("needs_edit")
    return F.struct(status.alias("status"), F.when(status.isin("stretch", "needs_edit"), rate).otherwise(1.0).alias("rate"))


def take_fit(raw: Column, final: Column, slot: Column, pause_before: Column, pause_after: Column) -> Column:
    """A take needs an edit where its raw sound doesn't fit between the pauses or its final sound doesn't fit the slot."""
    first = duration_fit(raw, slot - pause_before - pause_after)["status"]
    return F.when((first == "needs_edit") | (duration_fit(final, slot)["status"] == "needs_edit"), "needs_edit").otherwise("fit")


def atempo_chain(rate: Column) -> Column:
    """Filter text that changes tempo in steps of at most 2."""
    value = F.when(rate.isNull() | F.isnan(rate) | (rate == 0), 1.0).otherwise(rate)
    up = F.greatest(F.lit(0), F.ceil(F.log2(value)) - 1).cast("int")
    down = F.greatest(F.lit(0), F.ceil(-F.log2(value)) - 1).cast("int")
    rest = value / F.pow(F.lit(2.0), up) * F.pow(F.lit(2.0), down)
    return F.concat(F.repeat(F.lit("atempo=2,"), up), F.repeat(F.lit("atempo=0.5,"), down), F.format_string("atempo=%.5f", rest))


def transcription_estimate(duration: Column, quality: Column) -> Column:
    """struct<low, high>: seconds that a transcription is expected to take."""

    def side(i: int, least: int) -> Column:
        factor = F.lit(ESTIMATES["accurate"][i])
        for name, pair in ESTIMATES.items():
            factor = F.when(quality == name, F.lit(pair[i])).otherwise(factor)
        return F.greatest(F.lit(least), half_up(duration * factor)).cast("long")

    return F.struct(side(0, 8).alias("low"), side(1, 15).alias("high"))


def emotion_category(emotion: Column) -> Column:
    """The first mood whose keywords occur in the text."""
    out = F.lit("normal")
    for name, words in reversed(MOODS):
        out = F.when(F.lower(F.coalesce(emotion, F.lit(""))).rlike(words), name).otherwise(out)
    return out


def parse_pronunciations(text: Column) -> Column:
    """array<struct<source, target>>: lines ``a = b``, ``a => b`` or ``a → b``, the first 100 of them."""
    pattern = r"^\s*(.+?)\s*(?:=>|=|→)\s*(.+?)\s*$"
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), lambda x: x.rlike(pattern))
    squeeze = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    rules = F.transform(lines, lambda x: F.struct(squeeze(F.regexp_extract(x, pattern, 1)).alias("source"), squeeze(F.regexp_extract(x, pattern, 2)).alias("target")))
    return F.slice(F.filter(rules, lambda r: (r["source"] != "") & (r["target"] != "")), 1, 100)


def apply_pronunciations(text: Column, rules: Column) -> Column:
    """Each rule's source, taken literally and in any case, becomes its target, in the order of the rules."""
    quote = lambda c: F.concat(F.lit("(?iu)\\Q"), F.replace(c, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    literal = lambda c: F.regexp_replace(c, "([\\\\$])", "\\\\$1")
    return F.aggregate(rules, text, lambda acc, r: F.regexp_replace(acc, quote(r["source"]), literal(r["target"])))


def thai_integer(number: int) -> str:
    """A whole number in Thai words, by groups of six digits."""
    if number == 0:
        return THAI_DIGITS[0]
    head, tail = divmod(number, 1_000_000)
    out = [thai_integer(head) + "ล้าน"] if head else []
    digits = [int(d) for d in str(tail)] if tail else []
    for i, digit in enumerate(digits):
        place = len(digits) - 1 - i
        if digit == 0:
            continue
        if place == 1 and digit <= 2:
            out.append("สิบ" if digit == 1 else "ยี่สิบ")
        elif place == 0 and digit == 1 and len(digits) > 1:
            out.append("เอ็ด")
        else:
            out.append(THAI_DIGITS[digit] + THAI_PLACES[place])
    return "".join(out)


def number_words(text: str) -> str:
    """A number with thousands commas and decimals in Thai words, decimals digit by digit."""
    whole, _, decimals = text.replace(",", "").partition(".")
    return thai_integer(int(whole)) + ("จุด" + "".join(THAI_DIGITS[int(d)] for d in decimals) if decimals else "")


@vectorised("string")
def numbers_to_thai(texts: pd.Series) -> pd.Series:
    """Stand-alone numbers of a text in Thai words."""
    import regex

    pattern = regex.compile(r"(?<![\p{L}\p{N}])[0-9][0-9,]*(?:\.[0-9]+)?(?![\p{L}\p{N}])")
    known: dict[str, str] = {}

    def words(m) -> str:
        if m[0] not in known:
            known[m[0]] = number_words(m[0])
        return known[m[0]]

    return texts.map(lambda t: pattern.sub(words, t), na_action="ignore")
