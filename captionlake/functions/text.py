"""Column functions for caption text, time codes and file names."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from captionlake.functions.udf import columnar

# Marks that cling to the word before them, and Thai signs that can't begin a word.
ATTACHED = "^[ๆฯ,.!?…]"
THAI_RISK = "^[\\u0E30-\\u0E3A\\u0E47-\\u0E4E]|^ๆ+$"
LOCALES = {"thai": "th", "english": "en", "auto": "th"}


def locale_of(language: str) -> str:
    return LOCALES.get((language or "th").lower(), language or "th")


def grapheme_count(text: Column) -> Column:
    """Extended grapheme clusters (null: 0)."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("\\X"))


def thai_risk(text: Column) -> Column:
    return F.coalesce(text.rlike(THAI_RISK), F.lit(False))


def attaches_to_previous(text: Column) -> Column:
    return F.coalesce(text.rlike(ATTACHED), F.lit(False))


def collapse_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


@columnar("array<struct<text:string,is_word:boolean,space_before:boolean>>")
def placed_words(texts: pa.Array, words: pa.Array) -> pa.Array:
    """Each text as its words, in order, with the marks (without white space) that follow each; marks before the first word are an item of their own.

    A word is looked for from the end of the one before, so a text is passed over once, whatever its length.
    """
    out, is_word, spaced, edges = [], [], [], [0]
    for text, found in zip(texts.to_pylist(), words.to_pylist(), strict=True):
        end, first = 0, True
        for word in found or []:
            at = text.index(word, end)
            gap = text[end:at]
            if marks := "".join(gap.split()):
                if first:
                    out.append(marks)
                    is_word.append(False)
                    spaced.append(False)
                else:
                    out[-1] += marks
            out.append(word)
            is_word.append(True)
            spaced.append(not first and gap[-1:].isspace())
            end, first = at + len(word), False
        if marks := "".join((text or "")[end:].split()):
            if first:
                out.append(marks)
                is_word.append(False)
                spaced.append(False)
            else:
                out[-1] += marks
        edges.append(len(out))
    items = pa.StructArray.from_arrays([pa.array(out, pa.string()), pa.array(is_word, pa.bool_()), pa.array(spaced, pa.bool_())], names=["text", "is_word", "space_before"])
    return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), items)


def segmented(text: Column, language: str) -> Column:
    """placed_words() by the JVM's dictionary segmentation: sentences() gives the words without marks."""
    return placed_words(text, F.flatten(F.sentences(text, F.lit(locale_of(language)), F.lit(""))))


def word_segments(text: Column, language: str = "th") -> Column:
    """array<struct<text, space_before>>: the words of the text, marks joined to the word before; marks before the first word are left out."""
    words = F.filter(segmented(collapse_spaces(text), language), lambda w: w["is_word"])
    return F.transform(words, lambda w: F.struct(w["text"].alias("text"), w["space_before"].alias("space_before")))


def srt_time(seconds: Column) -> Column:
    """HH:MM:SS,mmm; negative is 0, milliseconds are cut, a day wraps."""
    ms = F.floor(F.greatest(seconds, F.lit(0.0)) * 1000).cast("long")
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    return F.concat(pad(F.expr("0") + F.floor(ms / 3600000) % 24, 2), F.lit(":"), pad(F.floor(ms / 60000) % 60, 2), F.lit(":"), pad(F.floor(ms / 1000) % 60, 2), F.lit(","), pad(ms % 1000, 3))


def ass_time(seconds: Column) -> Column:
    """H:MM:SS.cc, centiseconds floored."""
    pad = lambda c: F.lpad(c.cast("string"), 2, "0")
    whole = F.floor(seconds)
    return F.concat(
        F.floor(seconds / 3600).cast("string"), F.lit(":"), pad(F.floor(seconds / 60) % 60), F.lit(":"), pad(whole % 60), F.lit("."), pad(F.floor((seconds % 1) * 100))
    )


def ass_escape(text: Column) -> Column:
    full = F.translate(text, "\\{}\r", "／（）")
    return F.replace(full, F.lit("\n"), F.lit("\\N"))


def ass_color(value: Column, default: str = "FFFFFF") -> Column:
    """RRGGBB (with or without #, short values filled with F) as &H00BBGGRR."""
    digits = F.regexp_replace(F.when((value == "") | value.isNull(), F.lit(default)).otherwise(value), "[^0-9a-fA-F]", "")
    rgb = F.substring(F.rpad(digits, 6, "F"), 1, 6)
    return F.concat(F.lit("&H00"), F.substring(rgb, 5, 2), F.substring(rgb, 3, 2), F.substring(rgb, 1, 2))


def subtitle_seconds(code: Column) -> Column:
    """[h:]mm:ss[,.]f in seconds, null where it isn't a time code."""
    pattern = r"^(?:(\d+):)?(\d{1,2}):(\d{2})[,.](\d{1,3})$"
    part = lambda i: F.regexp_extract(F.trim(code), pattern, i)
    hours = F.when(part(1) == "", F.lit(0.0)).otherwise(part(1).cast("double"))
    return F.when(F.trim(code).rlike(pattern), hours * 3600 + part(2).cast("double") * 60 + part(3).cast("double") + F.rpad(part(4), 3, "0").cast("double") / 1000)


def repair_filename(name: Column) -> Column:
    """A name whose UTF-8 bytes were read as Latin-1 is read again; any other name stays."""
    broken = name.rlike("[à¸à¹Ã]") & name.rlike(r"^[\x00-\xFF]*$")
    again = F.try_validate_utf8(F.encode(F.when(broken, name), "ISO-8859-1").cast("string"))
    return F.when(broken & again.isNotNull() & ~again.contains("\ufffd"), again).otherwise(F.coalesce(name, F.lit("")))


def metric_key(text: Column) -> Column:
    """Lower case without punctuation, symbols and white space; Thai marks stay."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[\p{P}\p{S}\s]+", "")


def hypothesis_key(text: Column) -> Column:
    """Lower-case letters and digits only, of text that is already in NFKC form."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", "")
