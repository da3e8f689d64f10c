"""Scalar expressions on text, numbers and small arrays. All are Catalyst expressions; null in gives what each says."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F


def squeeze(c: Column) -> Column:
    """Trimmed, with runs of white space as one space; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"(?U)\s+", " "))


def nonblank(c: Column) -> Column:
    """squeeze(), or null if nothing stays."""
    return F.nullif(squeeze(c), F.lit(""))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(squeeze(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def token(c: Column) -> Column:
    """Lower case; & as the word and; all but a-z0-9 as single underscores, none at the ends."""
    spelled = F.replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), F.lit("&"), F.lit(" and "))
    return F.regexp_replace(F.regexp_replace(spelled, "[^a-z0-9]+", "_"), "^_+|_+$", "")


@cache
def _unaccented() -> tuple[str, str]:
    """Letters and digits that compatibility decomposition makes one character and combining accents, and those characters."""
    found = {}
    for code in (*range(0xA0, 0xD800), *range(0xF900, 0x10000)):
        c = chr(code)
        base = unicodedata.normalize("NFKD", c)
        base = base[:1] + "".join(x for x in base[1:] if not 0x300 <= ord(x) <= 0x36F)
        if len(base) == 1 and base != c and base.isalnum() and ord(base) < 0x10000:
            found[c] = base.lower() if len(base.lower()) == 1 else base
    return "".join(found), "".join(found.values())


def fold(c: Column) -> Column:
    """Lower case without accents, vowel points or punctuation, words one space apart, in any script; a text of
    punctuation alone stays as it is, null is empty."""
    low = F.lower(squeeze(c))
    plain = F.regexp_replace(F.translate(low, *_unaccented()), "[\u0300-\u036f\u064b-\u0652\u0640]+", "")
    plain = F.trim(F.regexp_replace(plain, r"[^\p{L}\p{N}\p{M}]+", " "))
    return F.when(plain != "", plain).otherwise(low)


def isrc(c: Column) -> Column:
    """Upper-case letters and digits alone; null if none."""
    return F.nullif(F.upper(F.regexp_replace(F.coalesce(c, F.lit("")), "[^A-Za-z0-9]", "")), F.lit(""))


def isrc_squeezed(c: Column) -> Column:
    """The corpus builder's form: upper case, white space as single spaces; null if blank."""
    return F.upper(nonblank(c))


def isrc_trimmed(c: Column) -> Column:
    """The service's form: trimmed upper case; null if blank."""
    return F.nullif(F.upper(F.trim(c)), F.lit(""))


def strict_double(v: Column) -> Column:
    """A number of a VARIANT; null for texts and booleans."""
    return F.when(F.schema_of_variant(v).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(v, "$", "double"))


def strict_int(v: Column) -> Column:
    """A whole number of a VARIANT, also one written with a fraction of zero; null for all else."""
    number = strict_double(v)
    return F.when(number == F.floor(number), F.floor(number))


def lenient_int(c: Column) -> Column:
    return F.coalesce(c.try_cast("bigint"), c.try_cast("double").try_cast("bigint"))


def lenient_double(c: Column) -> Column:
    return c.try_cast("double")


def cleaned(items: Column) -> Column:
    """Array of strings without blanks; null is an empty array."""
    return F.filter(F.transform(F.coalesce(items, F.array().cast("array<string>")), squeeze), lambda x: x != "")


def year(c: Column) -> Column:
    """Of a column of whole numbers the number as it is; of texts the first year from 1900 to 2099 that stands alone; of others null."""
    found = F.regexp_extract(c.cast("string"), r"(?U)\b((?:19|20)[0-9]{2})\b", 1)
    kind = F.typeof(c)
    return F.when(kind.isin("tinyint", "smallint", "int", "bigint"), c.cast("string").try_cast("int")).when(kind == "string", F.nullif(found, F.lit("")).try_cast("int"))


def playlist_id(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, "playlist[/:]([a-zA-Z0-9]+)", 1), F.lit(""))


def percent(part: Column, total: Column) -> Column:
    """100 * part / total to two places; 0 where the total isn't positive."""
    return F.when(total > 0, F.round(100.0 * part / total, 2)).otherwise(F.lit(0.0))


def band(count: Column) -> Column:
    """Coverage bands."""
    return F.when(count < 5, "<5").when(count < 20, "5-19").when(count < 50, "20-49").when(count < 100, "50-99").otherwise(">=100")


def half_up(c: Column) -> Column:
    return F.floor(c + 0.5)


def artists_key(artists: Column) -> Column:
    return F.array_join(F.filter(F.transform(artists, token), lambda x: x != ""), "::")


def alias_key(title: Column, artists: Column) -> Column:
    """title::artists in tokens; null if either is empty."""
    t, a = token(title), artists_key(artists)
    return F.when((t != "") & (a != ""), F.concat(t, F.lit("::"), a))


def canonical_key(isrc_: Column, mbid: Column, source_id: Column, alias: Column, track_id: Column) -> Column:
    """The strongest key that a record has."""
    return F.coalesce(
        F.concat(F.lit("isrc:"), F.upper(nonblank(isrc_))), F.concat(F.lit("mbid:"), nonblank(mbid)), F.concat(F.lit("spotify:"), nonblank(source_id)),
        F.concat(F.lit("alias:"), alias), F.concat(F.lit("track_id:"), F.coalesce(track_id, F.lit("None"))),
    )


def track_id(isrc_: Column, mbid: Column, source_id: Column, title: Column, artists: Column) -> Column:
    """Corpus rule: ISRC, recording id, source id, text."""
    text = F.concat(F.lit("text:"), slug(title), F.lit("|"), F.array_join(F.transform(artists, slug), "|"))
    return F.coalesce(F.concat(F.lit("isrc:"), isrc(isrc_)), F.concat(F.lit("mbid:"), nonblank(mbid)), F.concat(F.lit("spotify:"), nonblank(source_id)), text)


def playlist_track_id(isrc_: Column, source_id: Column, title: Column, artists: Column) -> Column:
    """Playlist rule: source id, ISRC, a short hash of title and artists."""
    text = F.substring(F.sha1(F.to_json(F.struct(title.alias("title"), artists.alias("artists")))), 1, 16)
    return F.coalesce(nonblank(source_id), isrc(isrc_), F.concat(F.lit("hash:"), text))


def content_key(ids: Column, steer: Column) -> Column:
    """sha256 of the sorted ids and, if there is one, the trimmed lower-case steer (its first 500 characters)."""
    asked = F.lower(F.trim(F.substring(F.coalesce(steer, F.lit("")), 1, 500)))
    body = F.array_join(F.array_sort(F.array_compact(ids)), ",")
    return F.sha2(F.concat(body, F.when(asked != "", F.concat(F.lit("\nSTEER:"), asked)).otherwise(F.lit(""))), 256)


def utc_second() -> Column:
    """The time of this run to the second, ISO text in UTC."""
    return F.date_format(F.date_trunc("second", F.current_timestamp()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
